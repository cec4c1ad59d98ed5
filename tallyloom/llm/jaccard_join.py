"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles, sketched by ``COORDINATES`` min-hash
tokens. A run is a random tree: at each node every coordinate is chosen with
probability 1 / (similarity x COORDINATES), by a hash of the node, and a set goes
to the child named by its own token there. Sets that share a chosen token meet in
the child. Nodes of one set die, nodes of up to ``LEAF`` sets are searched by
brute force, larger ones are split further, ``MAX_DEPTH`` times at most. A pair of
just the wanted similarity has one common child on average at each node it shares,
so a fixed share of the runs finds it at that depth; runs are repeated until the
target recall (``runs_for``).

Leaves compare sketches and link sets that may be similar, with a margin of 3.6
standard errors. The components of these links are then compared exactly, all
pairs in blocks of a bounded size, on the whole shingle sets: similarity 0.8 or
more is a link. Every pair is counted once, whatever number of leaves it met in.

Scale: equal sets are one set with a count of copies, so a group of copies costs
one row. Paths are shuffled without sketches, which only rows of shared nodes
fetch. A leaf is walked breadth first and visited sets drop out, so a tight group
costs about its size; leaves that stay larger are searched in pairs of blocks.
Components larger than a block are dealt to blocks by hash
(a block's number comes from the component's totals, no set is numbered) and compared block by
block, each block pair a task; pairs themselves are never emitted, only each
set's number of links and one link per set to its group's smallest member.

Nulls and empty texts: no shingles, no links, a class of their own. Texts of one
to four words are one shingle. Repeated rows are copies. Empty input: empty output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import (Scratch, byte_buffer, free_name, mix64, prefix_hashes, span_hashes, text_batches,
                                  with_row_id, word_hashes, word_spans)
from tallyloom.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 64
TARGET_RECALL = 0.999
LEAF = 20_000
MAX_DEPTH = 3
BLOCK_SETS, BLOCK_SHINGLES = 2000, 1 << 20
LOOSE = SIMILARITY - 3.6 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)
FACTORS = mix64(np.arange(1, COORDINATES + 1) * 7919) | np.uint64(1)


def runs_for(recall: float, depth: int = MAX_DEPTH) -> int:
    """Runs until a pair of just the wanted similarity meets at ``depth`` with probability ``recall``.

    Such a pair has about one common child (Poisson) at each node it shares.
    """
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, starts = byte_buffer(texts)
    first, last, begin = word_spans(data, starts)
    sums = prefix_hashes(word_hashes(data, first, last))
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        at = np.arange(a, max(b - SHINGLE + 1, min(a + 1, b)))
        out.append(np.unique(span_hashes(sums, at, np.minimum(at + SHINGLE, b))))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash tokens (unsigned 32 bit), one row for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for j, factor in enumerate(FACTORS):
        out[:, j] = np.minimum.reduceat(((flat * factor) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketches(rows: DataFrame) -> DataFrame:
    """(row, doc_id, n, a, b, tokens): set size, 128-bit digest of the set, and sketch; n = 0: no shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            sets = shingle_sets(batch.column(1))
            full = [i for i, s in enumerate(sets) if len(s)]
            tokens: list[bytes | None] = [None] * len(sets)
            if full:
                for i, t in zip(full, sketch([sets[i] for i in full])):
                    tokens[i] = t.tobytes()
            a = np.array([mix64(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
            b = np.array([np.bitwise_xor.reduce(mix64(s + np.uint64(77))) if len(s) else 0 for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(a.view(np.int64)),
                pa.array(b.view(np.int64)), pa.array(tokens, pa.binary())], names=["row", "doc_id", "n", "a", "b", "tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "text", "doc_id").mapInArrow(
        run, f"row long, doc_id {kind}, n long, a long, b long, tokens binary")


def children(sets: DataFrame, roots: list[int] | None = None) -> DataFrame:
    """(path, node): the children each set goes to, from its ``path`` or from all roots."""
    limit = np.uint64(int(2.0 ** 64 / (SIMILARITY * COORDINATES)))
    step = mix64(np.arange(COORDINATES) + 31)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, COORDINATES)
            froms = [np.full(n, r, np.uint64) for r in roots] if roots else [np.asarray(batch.column(2)).view(np.uint64)]
            paths, nodes = [], []
            for path in froms:
                chosen = mix64(path[:, None] ^ step[None, :]) < limit
                at, j = np.nonzero(chosen)
                paths.append(mix64(mix64(path[at] + step[j]) + tokens[at, j]))
                nodes.append(at)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(paths).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(nodes)))],
                names=["path", "node"])

    return sets.select("node", "tokens", *([] if roots else ["path"])).mapInArrow(run, "path long, node long")


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first ``keys`` columns, as one table for each key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([np.asarray(batch.column(i)) for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = columns[a].tolist()
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def walk(tokens: np.ndarray) -> np.ndarray:
    """Component of each sketch when sketches that agree on ``LOOSE`` of their tokens are linked."""
    label = np.full(len(tokens), -1)
    rest = np.arange(len(tokens))
    while len(rest):
        queue = [int(rest[0])]
        label[rest[0]] = rest[0]
        rest = rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = (tokens[rest] == tokens[x]).mean(1) >= LOOSE
            found = rest[near]
            label[found] = label[x]
            queue += found.tolist()
            rest = rest[~near]
    return label


def leaf_links(leaves: DataFrame) -> DataFrame:
    """(a, b): each set of a leaf with the smallest-numbered set of its component in the leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1):
            node = np.asarray(group.column(1))
            tokens = np.frombuffer(b"".join(group.column(2).to_pylist()), np.uint32).reshape(len(node), COORDINATES)
            label = walk(tokens)
            order = np.unique(label)
            least = np.array([node[label == x].min() for x in order])
            b = least[np.searchsorted(order, label)]
            other = node != b
            yield pa.RecordBatch.from_arrays([pa.array(b[other]), pa.array(node[other])], names=["a", "b"])

    return leaves.select("path", "node", "tokens").repartition("path").sortWithinPartitions("path").mapInArrow(run, "a long, b long")


def in_blocks(sized: DataFrame) -> DataFrame:
    """(path, node) of the last leaves: those of more than ``LEAF`` sets in all pairs of blocks of half that size."""
    blocks = F.ceil(F.col("size") * 2 / LEAF)
    large = sized.where(F.col("size") > LEAF).withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    pairs = large.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "node")
    return sized.where(F.col("size") <= LEAF).select("path", "node").unionByName(pairs)


def loose_components(sets: DataFrame, scratch: Scratch, runs: int) -> DataFrame:
    """(node, label) of the sets that some leaf links to another."""
    roots = [int(x) for x in mix64(np.arange(1, runs + 1) * 104729)]
    active, links = children(sets, roots), []
    for depth in range(1, MAX_DEPTH + 1):
        active = scratch.write(active, f"children{depth}")
        sizes = scratch.write(active.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"sizes{depth}")
        sized = scratch.write(active.join(sizes.hint("merge"), "path"), f"paths{depth}")  # two plain shuffles: a hot path is split
        scratch.drop(f"children{depth}", f"sizes{depth}")
        ready = in_blocks(sized) if depth == MAX_DEPTH else sized.where(F.col("size") <= LEAF).select("path", "node")
        links.append(scratch.write(leaf_links(ready.join(sets.hint("merge"), "node")).distinct(), f"leaves{depth}"))
        large = sized.where(F.col("size") > LEAF)
        if depth == MAX_DEPTH or large.isEmpty():
            break
        active = children(large.join(sets.hint("merge"), "node")).distinct()
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return scratch.write(components(every, scratch, "loose"), "loose")


def exact_rows(blocks: DataFrame) -> DataFrame:
    """Compare all sets of two blocks (or within one): (node, links, least) by exact similarity.

    ``links``: copies of the other block's similar sets; ``least``: the smallest
    node of the set's component within the pair of blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 3):
            group = group.combine_chunks()
            node, side, copies = (np.asarray(group.column(i)) for i in (3, 4, 5))
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in group.column(6)]
            first, second = np.asarray(group.column(1))[0], np.asarray(group.column(2))[0]
            similar = similar_pairs(sets)
            np.fill_diagonal(similar, False)
            inner = similar.copy()
            if first != second:  # pairs inside a block are compared where it meets itself
                similar &= side[:, None] != side[None, :]
            least = node.copy()
            while True:
                spread = np.array([min(least[i], least[row].min()) if row.any() else least[i] for i, row in enumerate(inner)])
                if (spread == least).all():
                    break
                least = spread
            yield pa.RecordBatch.from_arrays([
                pa.array(node), pa.array((similar @ copies).astype(np.int64)), pa.array(least)], names=["node", "links", "least"])

    return (blocks.repartition("label", "first", "second").sortWithinPartitions("label", "first", "second")
            .select("label", "first", "second", "node", "block", "copies", "shingles")
            .mapInArrow(run, "node long, links long, least long"))


def similar_pairs(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Matrix of the pairs whose Jaccard similarity is at least ``SIMILARITY``."""
    size = np.array([len(s) for s in sets], np.float64)
    of = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[at] > 1
    of, at = of[keep], (np.cumsum(count > 1) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        a, b = np.searchsorted(at, [low, low + columns])
        part = np.zeros((len(sets), int(at[b - 1]) - low + 1), np.float32)
        part[of[a:b], at[a:b] - low] = 1
        common += part @ part.T
    union = size[:, None] + size[None, :] - common
    return common >= SIMILARITY * union - 1e-9


def jaccard_classes(docs: DataFrame, scratch: Scratch | None = None, stored: bool = False,
                    recall: float = TARGET_RECALL) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, class_id, n_links, least.

    n_links: other rows of similarity 0.8 or more, copies included. class_id: the
    smallest doc_id of the component of such links; ``least``: its smallest row.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard-join")
    rows = with_row_id(docs, scratch, ["doc_id", "text"], "row", stored)
    return classes_of(rows, scratch, recall)


def classes_of(rows: DataFrame, scratch: Scratch, recall: float = TARGET_RECALL) -> DataFrame:
    """``jaccard_classes`` for rows (row, doc_id, text) whose keys don't change."""
    seen = scratch.write(sketches(rows), "sketches")
    some = seen.where("n > 0")
    sets = scratch.write(some.groupBy("a", "b", "n").agg(
        F.min_by("tokens", "row").alias("tokens"), F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")), "sets")
    loose = loose_components(sets.select("node", "tokens"), scratch, runs_for(recall))
    sized = scratch.write(loose.join(sets.select("node", "n", "copies"), "node"), "sized")
    parts = scratch.write(sized.groupBy("label").agg(F.greatest(
        F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("long").alias("parts")), "parts")
    blocks = scratch.write(sized.join(parts.hint("merge"), "label").select(
        "node", "label", F.pmod(F.xxhash64("node"), "parts").alias("block"), (F.col("parts") - 1).alias("last"), "copies"), "blocks")
    whole = rows.select("row", "text").join(blocks.withColumnRenamed("node", "row").hint("merge"), "row")
    exact = scratch.write(exact_rows(block_pairs(whole)), "exact")
    links = exact.groupBy("node").agg(F.sum("links").alias("links"))
    final = components(exact.select(F.col("least").alias("a"), F.col("node").alias("b")), scratch, "exact")
    nodes = sets.join(links, "node", "left").join(final, "node", "left").select(
        "a", "b", "n", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "node").alias("label"))
    nodes = scratch.write(nodes, "nodes")
    placed = some.select("row", "doc_id", "a", "b", "n").join(nodes.hint("merge"), ["a", "b", "n"]).select("row", "doc_id", "label", "n_links")
    placed = scratch.write(placed.unionByName(seen.where("n = 0").select(
        "row", "doc_id", F.col("row").alias("label"), F.lit(0).cast("long").alias("n_links"))), "placed")
    names = scratch.write(placed.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min("row").alias("least")), "names")
    return placed.join(names.hint("merge"), "label").select("row", "doc_id", "class_id", "n_links", "least")


def block_pairs(whole: DataFrame) -> DataFrame:
    """(label, first, second, node, block, copies, shingles): each set once for each block its block meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(sets, pa.binary())],
                                             names=["node", "label", "block", "last", "copies", "shingles"])

    sets = whole.select("row", "text", "label", "block", "last", "copies").mapInArrow(
        run, "node long, label long, block long, last long, copies long, shingles binary")
    return sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).select(
        "label", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "node", "block", "copies", "shingles")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns), of each class the first row only."""
    scratch = Scratch(docs.sparkSession, "jaccard-keep")
    row = free_name(docs, "row_key")
    rows = with_row_id(docs, scratch, docs.columns, row)
    found = classes_of(rows.select(F.col(row).alias("row"), "doc_id", "text"), scratch)
    kept = scratch.write(found.where("row = least").select(F.col("row").alias(row)), "kept")
    return rows.join(kept.hint("merge"), row, "left_semi").drop(row)
