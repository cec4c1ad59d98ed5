"""BPE encoding and decoding: speculate, verify, merge exactly only where needed.

Speculate: each distinct word (piece of the pre-tokeniser) is cut greedily into
the longest vocabulary entries. Verify: a cut is the merge result exactly when
every adjacent pair of its tokens is stable, that is, when merging the two
tokens' bytes on their own gives the same two tokens; all pairs of a batch of
new words are tested together with numpy. Only words with an unstable pair are
merged exactly, by lowest rank first.

Scale: one pass over the table without a shuffle. A task keeps one model and
bounded caches (whole words that repeat cost one dictionary look-up); when a
cache is full it starts afresh, so memory doesn't grow with the data.

Nulls and empty texts: no tokens, empty decoded text. The tokenizer file's
special tokens found in a text become their ids, as its library does by default.
Where two begin at one place the file's order decides, and flags that strip white space
around them aren't used: the given vocabulary has one special token, without flags.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tallyloom.llm.common import free_name, text_batches, texts_of

# The pre-tokenising pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 400_000
SHORT_WORD = 40  # bytes; up to here a plain scan for the lowest rank beats a heap
NO_TOKEN = 1 << 40
GAP = chr(0x100)  # no byte: separates words in a scan


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    """Encoder and decoder for one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items()
                    if all(c in letters for c in word)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content in self.special:
            as_bytes.pop(content.encode(), None)
        self.ids = as_bytes
        self.single = [as_bytes[bytes([b])] for b in range(256)]
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in as_bytes.items():
            self.matcher.add_word(b.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.bytes_of = {i: b for b, i in as_bytes.items()} | {i: c.encode() for c, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        halves = [(as_bytes[bytes(letters[c] for c in a)], as_bytes[bytes(letters[c] for c in b)]) for a, b in pairs]
        self.rank = {pair: r for r, pair in enumerate(halves)}
        self.merged = [self.ids[self.bytes_of[a] + self.bytes_of[b]] for a, b in halves]
        # for pair tests: the last merge that makes each token, and the sorted pair table
        size = max(self.bytes_of) + 1
        self.left, self.right = np.arange(size), np.arange(size)
        self.made_at = np.full(size, -1)
        for r, (a, b) in enumerate(halves):
            t = self.merged[r]
            if self.made_at[t] < 0:
                self.left[t], self.right[t], self.made_at[t] = a, b, r
        self.size = size
        codes = np.array([a * size + b for a, b in halves], np.int64)
        order = np.argsort(codes)
        self.codes, self.code_rank = codes[order], order.astype(np.int64)
        by_id = [self.bytes_of.get(i, b"") for i in range(size)]
        self.text_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.text_sizes = np.array([len(b) for b in by_id])
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.cut = regex.compile(PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.chunks: dict[str, bytes] = {}
        self.tested = self.failed = 0

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_rank[at], NO_TOKEN)

    def stable_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether merging their joined bytes gives the pair again.

        Undo the later of the two tokens' last merges step by step; the pair is
        unstable when two parts that touch at the border could merge before the
        merge that was undone. Ranks below: a merge across the border comes
        first on the left part's side when ranks are equal in time.
        """
        a, b = a.copy(), b.copy()
        stable = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), NO_TOKEN)  # rank of the merge that was last undone
        from_left = np.zeros(len(a), bool)  # whether that was a merge of the left token
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            across = self._pair_rank(x, y)
            # an undone merge on the right side at the same rank starts later in the text
            clash = (across < lim) | ((across == lim) & ~from_left[live] & (lim < NO_TOKEN))
            stable[live[clash]] = False
            live = live[~clash]
            x, y = a[live], b[live]
            ra, rb = self.made_at[x], self.made_at[y]
            ended = (ra < 0) & (rb < 0)
            live, x, y, ra, rb = live[~ended], x[~ended], y[~ended], ra[~ended], rb[~ended]
            undo_left = ra > rb  # equal ranks: the left one was merged first, so undo the right one first
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            limit[live] = np.where(undo_left, ra, rb)
            from_left[live] = undo_left
        return stable

    def _greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match cut of all words in one left-to-right scan: token ids and each one's word."""
        text = GAP.join([w.decode("latin-1") for w in words])
        found = np.fromiter((x for pair in self.matcher.iter_long(text) for x in pair), np.int64).reshape(-1, 2)
        ends = np.cumsum([len(w) + 1 for w in words])
        return found[:, 1], np.searchsorted(ends, found[:, 0], side="right")

    def merge_exactly(self, word: bytes) -> list[int]:
        """The merges of BPE by lowest rank, leftmost first; a heap keeps it n log n for long words."""
        n = len(word)
        if n <= SHORT_WORD:
            return self._merge_short(word)
        token = [self.ids[word[i:i + 1]] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1)
                if (r := self.rank.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if token[i] != x or j >= n or token[j] != y:
                continue
            token[i], token[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for p in (before[i], i):
                if p >= 0 and (q := after[p]) < n and (s := self.rank.get((token[p], token[q]))) is not None:
                    heapq.heappush(heap, (s, p, token[p], token[q]))
        return [t for t in token if t >= 0]

    def _merge_short(self, word: bytes) -> list[int]:
        rank, merged, none = self.rank.get, self.merged, NO_TOKEN
        tokens = [self.single[b] for b in word]
        ranks = [rank(p, none) for p in zip(tokens, tokens[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            tokens[i:i + 2] = [merged[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((tokens[i - 1], tokens[i]), none)
            if i < len(ranks):
                ranks[i] = rank((tokens[i], tokens[i + 1]), none)
        return tokens

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Token ids (little-endian bytes) of each piece: greedy cut, all pairs tested at once, exact merges for the rest."""
        raw = [w.encode() for w in words]
        flat, of = self._greedy(raw)
        border = of[1:] == of[:-1]
        pairs, back = np.unique((flat[:-1] * self.size + flat[1:])[border], return_inverse=True)
        wrong = ~self.stable_pairs(pairs // self.size, pairs % self.size)[back]
        bad = set(of[1:][border][wrong].tolist())
        self.tested += len(words)
        self.failed += len(bad)
        ends = np.searchsorted(of, np.arange(len(raw) + 1)).tolist()
        flat = flat.astype("<u4")
        merge = self.merge_exactly
        return [array("I", merge(w)).tobytes() if i in bad else flat[ends[i]:ends[i + 1]].tobytes()
                for i, w in enumerate(raw)]

    def _learn(self, chunks: Iterable[str]) -> None:
        """Encode new chunks (runs of pieces) and keep their ids as little-endian bytes."""
        simple, mixed = [], {}
        for c in chunks:  # one run of letters, with or without a space before, is one piece
            if c.isalpha() or c[0] == " " and c[1:].isalpha():
                simple.append(c)
            else:
                mixed[c] = self.cut(c)
        words = list({w for pieces in mixed.values() for w in pieces}.union(simple))
        ids = dict(zip(words, self.encode_words(words)))
        for chunk in simple:
            self.chunks[chunk] = ids[chunk]
        for chunk, pieces in mixed.items():
            self.chunks[chunk] = b"".join([ids[p] for p in pieces])

    def _chunks(self, text: str) -> list[str]:
        """The text cut before single spaces, where a new piece always begins; texts with two
        spaces in a row, whose white space belongs together, are cut into pieces instead."""
        if "  " in text:
            return self.cut(text)
        head, *rest = text.split(" ")
        return [head, *[" " + w for w in rest]] if head else [" " + w for w in rest]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        marks = [self.split_special(t) if self.split_special else [t] for t in texts]
        parts = [[self._chunks(p) if i % 2 == 0 else None for i, p in enumerate(m)] for m in marks]
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.clear()
        new = {c for ps in parts for p in ps if p for c in p}.difference(self.chunks)
        self._learn(new)
        look = self.chunks.__getitem__
        out = []
        for m, ps in zip(marks, parts):
            out.append(b"".join([b"".join(map(look, p)) if p is not None else
                                 np.array([self.special[s]], "<u4").tobytes() for s, p in zip(m, ps)]))
        return out

    def decode(self, ids: bytes) -> str:
        """Text of ids (special tokens too); bytes that are no UTF-8 become U+FFFD."""
        tokens = np.frombuffer(ids, "<u4")
        sizes = self.text_sizes[tokens]
        ends = np.cumsum(sizes)
        at = np.repeat(self.text_starts[tokens] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.text_bytes[at].tobytes().decode("utf-8", "replace")


_MODELS: dict[str, SpeculativeBpe] = {}


def model(path: str) -> SpeculativeBpe:
    """The task process's model of a file, loaded once."""
    if path not in _MODELS:
        _MODELS[path] = SpeculativeBpe(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with its columns and ``ids``: the text's ids as an array of integers.

    ``path``: tokenizer file, readable at the same place on every executor. If
    ``docs`` has a column named like ``ids``, underscores are added to the new one.
    """
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(free_name(docs, ids), T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in text_batches(batches, at):
            raw = bpe.encode_batch(texts_of(batch, at))
            flat = pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))
            ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, schema[-1].name])

    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ``lossless`` (decoded = text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in text_batches(batches):
            texts = texts_of(batch)
            raw = bpe.encode_batch(texts)
            decoded = [bpe.decode(r) for r in raw]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(r) // 4 for r in raw], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                pa.array([d == t for d, t in zip(decoded, texts)])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
