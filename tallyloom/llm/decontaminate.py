"""Benchmark decontamination: n-gram seeds, rare ones first, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. A first scan counts in how many
documents each n-gram of the benchmark occurs. An item's rare seeds are its
n-grams that aren't far more common than the median one of those that occur. A
second scan joins passages to items on all n-grams: each run of hits gives a
window of the text around the item's place. Windows with a rare seed come first;
those of common n-grams alone are aligned too, unless too few of the item's words
stand close together for the least score, or for a better one than the document
has. The window is aligned with the item word by word (match +2, mismatch or gap
-1). A document leaks an item when the best local score is at least ``MIN_SCORE``
of the item's full score, so edited, cut or extended copies count too, in however
many documents they stand. A copy without any n-gram of the item isn't found.

An item of fewer than ``NGRAM`` words is its own seed: it matches where all its words
stand in a row, as half of one or two words says nothing.

Scale: the benchmark is the query set. It is read in blocks of about
``BLOCK_BYTES`` of text, and only a block's n-gram hashes and words are sent to
the tasks (some 40 bytes a word); each block costs two scans of the documents and no shuffle but one
count per n-gram and split. No seed, hit or window is capped.

Nulls and empty texts: never leak. Items without a word match nothing; null items are
skipped; of repeated items each reports its own matches; ids of any type are
returned as they are. Empty tables: no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tallyloom.llm.common import (byte_buffer, mix64, prefix_hashes, span_hashes, text_batches, word_hashes, word_spans)

NGRAM = 3
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, 1
SPAN = 3 - 2 * MIN_SCORE  # no passage that reaches MIN_SCORE has more than SPAN times the item's words
RARE_TIMES, RARE_PLUS = 4, 16  # a rare seed is in at most 4 times the item's median number of documents, plus 16
MAX_HITS = 1 << 20  # hits of items in texts that are expanded at once; more of a single text are handled alone
BLOCK_BYTES = 32 << 20
SIEVE_BITS = 22, 26  # at least, at most; some 16 places for each n-gram between

LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and each text's first word plus the end."""
    data, starts = byte_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    first, last, begin = word_spans(data, starts, LETTERS)
    return word_hashes(data, first, last), begin


def ngrams(words: np.ndarray, begin: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each place, and whether they are all in one text."""
    if len(words) < n:
        return np.empty(0, np.uint64), np.empty(0, bool)
    at = np.arange(len(words) - n + 1)
    inside = np.ones(len(at), bool)
    for k in range(1, n):
        cut = begin[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(at))]] = False
    return span_hashes(prefix_hashes(words), at, at + n), inside


def sized(gram: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams shorter than ``NGRAM`` apart from the others."""
    return gram if n == NGRAM else mix64(gram + np.uint64(n))


@dataclass
class Items:
    """A block of the benchmark: item ids, their words, and the n-grams with the places they stand at."""
    ids: list
    words: np.ndarray
    begin: np.ndarray
    grams: np.ndarray  # distinct, sorted
    first: np.ndarray  # of each n-gram's places, plus the end
    item: np.ndarray
    place: np.ndarray
    seed: np.ndarray  # whether the n-gram is a rare seed of the item
    sieve: np.ndarray

    sizes: list[int]  # of n-grams: ``NGRAM``, and the lengths of shorter items

    @classmethod
    def of(cls, ids: list, texts: pa.Array) -> Items:
        """All n-grams of the items."""
        words, begin = words_of(texts)
        length = np.diff(begin)
        sizes = [n for n in range(1, NGRAM + 1) if (length == n).any() or n == NGRAM]
        gram, at = [], []
        for n in sizes:
            value, inside = ngrams(words, begin, n)
            here = np.flatnonzero(inside)
            if n < NGRAM:
                here = here[length[np.searchsorted(begin, here, side="right") - 1] == n]
            gram.append(sized(value[here], n))
            at.append(here)
        gram, at = np.concatenate(gram), np.concatenate(at)
        order = np.argsort(gram, kind="stable")
        gram, at = gram[order], at[order]
        grams, first = np.unique(gram, return_index=True)
        item = np.searchsorted(begin, at, side="right") - 1
        bits = min(max(SIEVE_BITS[0], 4 + int(len(grams)).bit_length()), SIEVE_BITS[1])
        sieve = np.zeros(1 << bits, bool)
        sieve[grams >> np.uint64(64 - bits)] = True
        return cls(ids, words, begin, grams, np.append(first, len(at)), item, at - begin[item], np.ones(len(at), bool), sieve, sizes)

    def hits(self, words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the texts where an n-gram of the block stands, and its number."""
        shift = np.uint64(64 - (len(self.sieve).bit_length() - 1))
        places, numbers = [], []
        for n in self.sizes:
            gram, inside = ngrams(words, begin, n)
            gram = sized(gram, n)
            at = np.flatnonzero(self.sieve[gram >> shift] & inside)
            number = np.searchsorted(self.grams, gram[at])
            same = number < len(self.grams)
            same[same] = self.grams[number[same]] == gram[at[same]]
            places.append(at[same])
            numbers.append(number[same])
        at, number = np.concatenate(places), np.concatenate(numbers)
        order = np.argsort(at, kind="stable")
        return at[order], number[order]

    def rare(self, documents: np.ndarray) -> np.ndarray:
        """Marks of the n-gram places that are rare seeds, given each n-gram's number of documents."""
        count = np.repeat(documents, np.diff(self.first))
        there = np.flatnonzero(count)  # an n-gram that occurs nowhere says nothing about the others
        order = there[np.lexsort((count[there], self.item[there]))]
        start = np.searchsorted(self.item[order], np.arange(len(self.ids) + 1))
        size = np.diff(start)
        middle = np.zeros(len(self.ids))
        middle[size > 0] = count[order][(start[:-1] + size // 2)[size > 0]]
        return count <= RARE_TIMES * middle[self.item] + RARE_PLUS

    def leaks(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(text number, item number, score, first word, words) of each leaked item's best passage."""
        words, begin = words_of(texts)
        at, number = self.hits(words, begin)
        text = np.searchsorted(begin, at, side="right") - 1
        total = np.cumsum(np.diff(self.first)[number])
        start = 0
        while start < len(at):
            stop = int(np.searchsorted(total, (total[start - 1] if start else 0) + MAX_HITS, side="right"))
            if stop < len(at):  # whole texts
                stop = max(int(np.searchsorted(text, text[stop])), int(np.searchsorted(text, text[start], side="right")))
            yield from self.passages(words, begin, at[start:stop], number[start:stop])
            start = stop

    def windows(self, begin: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, first word, end) of the runs of hits, those with a rare seed first."""
        times = np.diff(self.first)[number]
        at = np.repeat(at, times)
        entry = np.repeat(self.first[number], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        item = self.item[entry]
        text = np.searchsorted(begin, at, side="right") - 1
        order = np.lexsort((at - self.place[entry], item, text))
        at, entry, item, text = at[order], entry[order], item[order], text[order]
        length = np.diff(self.begin)[item]
        slack = length // 2 + 2
        low = np.maximum(at - self.place[entry] - slack, begin[text])
        high = np.minimum(at - self.place[entry] + length + slack, begin[text + 1])
        fresh = np.ones(len(at), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (low[1:] >= high[:-1])
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(at)) - 1
        rare = np.logical_or.reduceat(self.seed[entry], first)
        ahead = np.argsort(~rare, kind="stable")
        return text[first][ahead], item[first][ahead], low[first][ahead], high[last][ahead]

    def passages(self, words: np.ndarray, begin: np.ndarray, at: np.ndarray, number: np.ndarray
                 ) -> Iterator[tuple[int, int, float, int, int]]:
        """As ``leaks``, from the hits of whole texts; of equal scores the first passage."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        known: dict[tuple[int, bytes], tuple[float, int, int]] = {}
        for t, n, a, b in zip(*(x.tolist() for x in self.windows(begin, at, number))):
            wanted = self.words[self.begin[n]:self.begin[n + 1]]
            for low, high, most in likely(words[a:b], wanted):
                have = best.get((t, n), (0.0, 0))
                if most < have[0]:
                    continue
                memo = (n, words[a + low:a + high].tobytes())
                if memo not in known:
                    known[memo] = align(words[a + low:a + high], wanted)
                score, start, size = known[memo]
                share = score / (MATCH * len(wanted))
                start += a + low - int(begin[t])
                if share >= (MIN_SCORE if len(wanted) >= NGRAM else 1.0) and (share, -start) > (have[0], -have[1]):
                    best[t, n] = (share, start, size)
        for (t, n), found in best.items():
            yield t, n, *found


def likely(passage: np.ndarray, item: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Parts of the passage that can reach ``MIN_SCORE``: start, end, and a bound of the score's share.

    With m words matched and e edits 2 m - e is at least 2 MIN_SCORE n for n words of
    the item, so m is MIN_SCORE n at least, and the part spans m + e <= SPAN n words.
    """
    n, size = len(item), len(passage)
    shared = np.isin(item, passage).sum()
    if shared < MIN_SCORE * n:
        return
    sums = np.concatenate([[0], np.cumsum(np.isin(passage, item))])
    span = int(SPAN * n)
    count = sums[np.minimum(np.arange(size) + span, size)] - sums[:-1]
    at = np.flatnonzero(count >= MIN_SCORE * n)
    if not len(at):
        return
    for part in np.split(at, np.flatnonzero(np.diff(at) >= span) + 1):
        yield int(part[0]), min(int(part[-1]) + span, size), min(int(shared), int(count[part].max())) / n


def align(passage: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: best local score, and the start and number of the passage's words in it.

    A row of the table at a time: gaps along the row are a running maximum. Each
    cell carries where its alignment began in the passage.
    """
    n = len(passage)
    step = GAP * np.arange(n + 1)
    score, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, start, end = 0, 0, 0
    place = np.arange(n + 1)
    for word in item:
        fit = np.where(passage == word, MATCH, MISMATCH)
        up, diagonal = score - GAP, np.zeros(n + 1, np.int64)
        diagonal[1:] = score[:-1] + fit
        from_diagonal = diagonal >= up
        row = np.where(from_diagonal, diagonal, up)
        came = np.where(from_diagonal, np.concatenate([[0], origin[:-1]]), origin)
        fresh = row <= 0
        row[fresh], came[fresh] = 0, place[fresh]
        reach = np.maximum.accumulate(row + step)
        source = np.maximum.accumulate(np.where(row + step == reach, place, 0))
        score, origin = reach - step, came[source]
        at = int(score.argmax())
        if score[at] > best:
            best, start, end = int(score[at]), int(origin[at]), at
    return float(best), start, end - start


def blocks_of(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, pa.Array]]:
    """The items in blocks of about ``block_bytes``; one block at a time comes to the driver."""
    ids, texts, size = [], [], 0
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
        if size >= block_bytes:
            yield ids, pa.array(texts, pa.string())
            ids, texts, size = [], [], 0
    if ids:
        yield ids, pa.array(texts, pa.string())


def seeded(docs: DataFrame, ids: list, texts: pa.Array) -> Items:
    """The block with its rare n-grams marked, after one scan of the documents for their counts."""
    every = Items.of(ids, texts)
    shared = docs.sparkSession.sparkContext.broadcast(every)  # a block: bounded by its bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seen = shared.value, np.zeros(len(every.grams), np.int64)
        for batch in text_batches(batches, 0):
            words, begin = words_of(batch.column(0))
            at, number = items.hits(words, begin)
            text = np.searchsorted(begin, at, side="right") - 1
            pairs = np.unique(text * len(seen) + number)
            seen += np.bincount(pairs % max(len(seen), 1), minlength=len(seen))
        n = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(seen[n], pa.int64())], names=["gram", "docs"])

    found = docs.select("text").mapInArrow(count, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))
    documents = np.zeros(len(every.grams), np.int64)
    for row in found.collect():  # at most one row for each n-gram of the block
        documents[row["gram"]] = row["docs"]
    return replace(every, seed=every.rare(documents))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item it leaks: doc_id, item_id, score, first_word, n_words."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("item_id", benchmark.schema["item_id"].dataType),
                           T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()),
                           T.StructField("n_words", T.LongType())])
    out = docs.sparkSession.createDataFrame([], schema)
    kind = benchmark.select("item_id").limit(0).toArrow().schema.field(0).type
    for ids, texts in blocks_of(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(seeded(docs, ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in text_batches(batches):
                t, n, score, at, size = zip(*found) if (found := list(items.leaks(batch.column(1)))) else [()] * 5
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(t, pa.int64())), pa.array([items.ids[i] for i in n], kind),
                    pa.array(score, pa.float64()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=schema.names)

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` (all columns) that leak no item of the benchmark."""
    at = docs.columns.index("text")
    out = docs
    for ids, texts in blocks_of(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(seeded(docs, ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in text_batches(batches, at):
                clean = np.ones(batch.num_rows, bool)
                clean[[t for t, *_ in shared.value.leaks(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
