"""Burrows-Wheeler transforms of small string collections, and their merge.

A shard holds its strings one after the other, each followed by symbol 0 (bytes
count from 1), its rotations ordered by their first ``depth`` symbols, and the
transform (the symbol before each rotation). Two shards are merged from their
transforms: stable sorting of a transform gives the step from each row to the row
one symbol on; the interleave of the two row orders by a short common prefix is
refined by looking that many symbols ahead, which doubles the prefix each time.
Rows of a shard are in order already, so a refinement merges ordered runs, and
rows whose block has become single drop out. The blocks left at full depth are
the intervals of rows with a common prefix of ``depth`` symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FIRST = 7  # symbols in the first key: 257 ** 7 < 2 ** 63


@dataclass
class Shard:
    """Transform, and each row's place in the text (of all merged shards, one after the other)."""
    transform: np.ndarray
    place: np.ndarray
    block: np.ndarray  # first row of each row's block of equal prefixes


def _depths(depth: int) -> list[tuple[int, int]]:
    """(prefix before, symbols to look ahead) of each refinement from ``FIRST`` to ``depth``."""
    out, h = [], FIRST
    while h < depth:
        out.append((h, min(h, depth - h)))
        h += out[-1][1]
    return out


def _first_key(symbols: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(symbols[0]), np.int64)
    for s in symbols:
        key = key * 257 + s
    return key


def _blocks(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By element: the first row of its run of equal keys in ``order``; and the rows of runs longer than one."""
    first, shared = _runs(key[order])
    block = np.empty(len(key), np.int32)
    block[order] = first
    return block, np.flatnonzero(shared)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each value's run of equals, and whether the run has more than one value."""
    edge = np.ones(len(ordered) + 1, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=edge[1:-1])
    start = np.flatnonzero(edge[:-1]).astype(np.int32)
    number = np.cumsum(edge[:-1], dtype=np.int32) - 1
    return start[number], ~(edge[:-1] & edge[1:])


def _refine(order: np.ndarray, block: np.ndarray, shared: np.ndarray, ahead, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Refine ``order`` (elements by prefix) and ``block`` (by element: first row of its block) to ``depth``.

    ``shared``: rows whose block has more than one row; the others are settled.
    ``ahead(elements, k)`` gives the elements k symbols on.
    """
    for _, look in _depths(depth):
        if not len(shared):
            break
        e = order[shared]
        key = block[e].astype(np.int64) << 32 | block[ahead(e, look)]
        by = np.argsort(key)
        e = e[by]
        order[shared] = e
        start, more = _runs(key[by])
        block[e] = shared[start]
        shared = shared[more]
    return order, block


def build(text: np.ndarray, depth: int, offset: int = 0) -> Shard:
    """Shard of one text of symbols (strings ended by 0) with places counted from ``offset``."""
    n = len(text)
    ring = np.resize(text, n + FIRST)  # goes round
    key = _first_key([ring[k:k + n] for k in range(FIRST)])
    order = np.argsort(key).astype(np.int32)

    def ahead(e: np.ndarray, k: int) -> np.ndarray:
        on = e + np.int32(k % n)
        return np.where(on >= n, on - n, on)

    order, block = _refine(order, *_blocks(key, order), ahead, depth)
    return Shard(text[order - 1], order + offset, block[order])


def _steps(transform: np.ndarray):
    """Rows k symbols on, for the rows of a transform."""
    power = {1: np.argsort(transform, kind="stable").astype(np.int32)}  # row of the rotation one symbol on
    k = 1
    while k < 256:
        power[2 * k] = power[k][power[k]]
        k *= 2

    def ahead(rows: np.ndarray, k: int) -> np.ndarray:
        bit = 1
        while k:
            if k & 1:
                rows = power[bit][rows]
            k, bit = k >> 1, bit * 2
        return rows

    return ahead


def merge(a: Shard, b: Shard, depth: int) -> Shard:
    """The shard of both texts, from the two transforms by interleave refinement."""
    na = len(a.transform)
    steps = _steps(a.transform), _steps(b.transform)

    def ahead(rows: np.ndarray, k: int) -> np.ndarray:
        out = np.empty_like(rows)
        left = rows < na
        out[left] = steps[0](rows[left], k)
        out[~left] = steps[1](rows[~left] - na, k) + na
        return out

    keys = []
    for part, step in ((a, steps[0]), (b, steps[1])):
        first, rows, symbols = np.sort(part.transform, kind="stable"), np.arange(len(part.transform), dtype=np.int32), []
        for _ in range(FIRST):
            symbols.append(first[rows])
            rows = step(rows, 1)
        keys.append(_first_key(symbols))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable").astype(np.int32)  # two ordered runs, merged
    order, block = _refine(order, *_blocks(key, order), ahead, depth)
    return Shard(np.concatenate([a.transform, b.transform])[order], np.concatenate([a.place, b.place])[order], block[order])


def merged(texts: list[np.ndarray], depth: int) -> Shard:
    """One shard of all texts: each text's own, merged two by two."""
    shards, offset = [], 0
    for text in texts:
        shards.append(build(text, depth, offset))
        offset += len(text)
    while len(shards) > 1:
        pairs = [merge(*shards[i:i + 2], depth) for i in range(0, len(shards) - 1, 2)]
        shards = pairs + shards[2 * len(pairs):]
    return shards[0]


def repeated_windows(strings: list[bytes], weights: list[int], depth: int, shard_bytes: int) -> list[np.ndarray]:
    """For each string the starts of its ``depth``-byte windows that occur twice in all, weights counted."""
    texts, here, size, starts, at = [], [], 0, [], 0
    for s in strings:
        here.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1)
        here.append(np.zeros(1, np.uint16))
        starts.append(at)
        at += len(s) + 1
        size += len(s) + 1
        if size >= shard_bytes:
            texts.append(np.concatenate(here))
            here, size = [], 0
    if here:
        texts.append(np.concatenate(here))
    shard = merged(texts, depth)
    lengths = np.array([len(s) for s in strings])
    first = np.array(starts)
    owner = np.searchsorted(first, shard.place, side="right") - 1
    whole = first[owner] + lengths[owner] - shard.place >= depth
    total = np.bincount(shard.block[whole], np.asarray(weights, np.float64)[owner[whole]], minlength=len(shard.block))
    found = np.flatnonzero(whole)
    found = found[total[shard.block[found]] >= 2]
    owner, start = owner[found], shard.place[found] - first[owner[found]]
    by = np.lexsort((start, owner))
    owner, start = owner[by], start[by]
    cuts = np.searchsorted(owner, np.arange(len(strings) + 1))
    return [start[a:b] for a, b in zip(cuts, cuts[1:])]
