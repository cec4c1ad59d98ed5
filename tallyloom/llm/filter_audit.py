"""Filter interaction audit: what each filter removes in every order of application.

A document's verdict is a bit mask, one bit for each filter it fails. All figures of
all orders are sums of counts over masks, so the texts are judged once. Four filters
depend on the text alone; the fifth (E) fails a document whose text stands under a
smaller doc_id anywhere in the table.

E has a prepass. Every text's hash adds one to ``PROBES`` cells of a counting Bloom
sketch; each task counts its own rows (0, 1, or 2 for more), the parts are merged,
and a cell is kept as one bit: two or more. A text with a cell below two is unique
for certain. Only the others, possible repeats, are shuffled by their full text for
the smallest id that has it; a possible repeat fails E unless it is that id's row.
Equality is that of whole texts; hashes (128 bits) only lead a verdict back to the
row with that id.

Scale: two map-only passes read the texts, one for the masks and hashes (a written
table of some 40 bytes a row) and one that shuffles possible repeats, combined
to a text and its least id before the shuffle, so a hot text is a row for each task.
The sketch has 8 to 16 cells a row up to ``MOST_CELLS`` bits (64 MB, about 67
million rows), which bounds what a broadcast holds; beyond it fills, which sends more
texts through the shuffle but changes no result. Labels meet rows combined by id,
and what is left is a few counts for each source, mask and label.

Nulls and empty texts: a null text is empty, so it fails A, and E if a smaller id
has an empty text. A null doc_id is larger than all others; rows of one id don't make
each other fail E. A null source counts as the empty one. Labels of a null id are
left out; of several labels of one id a 1 wins. Empty input: empty output.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import Scratch, mix64

FILTERS = "ABCDE"
MIN_WORDS = 200
PROBES = 3
CHUNK = 1 << 20  # cells of a sketch that are merged together
MOST_CELLS = 1 << 29
FLUSH = 1 << 20  # cells that a task counts before it sends them on
NO_ID = (1 << 63) - 1
ODD = mix64(np.arange(1, PROBES + 1)) | np.uint64(1)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text (not null) fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < MIN_WORDS, 100 * kinds < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]
    out = F.lit(0)
    for i, bad in enumerate(fails):
        out = out + F.when(bad, 1 << i).otherwise(0)
    return out.cast("int")


def verdicts(docs: DataFrame) -> DataFrame:
    """(id, part, mask, h, g): each row's filters A to D and two hashes of its text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("source", F.lit("")).alias("part"),
        text_mask(text).alias("mask"), text_hash(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("g"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def sketch_cells(rows: int) -> int:
    """A power of two of 8 to 16 cells for each row, ``CHUNK`` at least and ``MOST_CELLS`` at most."""
    return min(max(1 << (8 * max(rows, 1) - 1).bit_length(), CHUNK), MOST_CELLS)


def probes(h: np.ndarray, cells: int) -> np.ndarray:
    """The cells of each hash, a row for each probe."""
    return mix64(h.view(np.uint64)[None, :] * ODD[:, None]) & np.uint64(cells - 1)


def count_cells(hashes: DataFrame, cells: int) -> DataFrame:
    """(chunk, once, more): places in a chunk of the sketch that a task's rows hit once, and more often."""
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        chunk, place = cell // CHUNK, (cell % CHUNK).astype("<u4")
        names = np.unique(chunk)
        cuts = np.append(np.searchsorted(chunk, names), len(chunk))
        once, more = [], []
        for a, b in zip(cuts, cuts[1:]):
            single = n[a:b] == 1
            once.append(place[a:b][single].tobytes())
            more.append(place[a:b][~single].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
                                          names=["chunk", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(probes(np.asarray(batch.column(0)), cells).ravel())
            size += len(held[-1])
            if size >= FLUSH:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return hashes.mapInArrow(run, "chunk int, once binary, more binary")


def merge_cells(parts: DataFrame) -> DataFrame:
    """(chunk, bits): the merged sketch, a bit for each cell hit twice or more."""
    def bits(chunk: int, cell: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(cell >= 2).tobytes()], pa.binary())],
                                          names=["chunk", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, np.zeros(CHUNK, np.uint8)
        for batch in batches:
            for chunk, once, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if chunk != now:
                    if now is not None:
                        yield bits(now, cell)
                    now, cell = chunk, np.zeros(CHUNK, np.uint8)
                place = np.frombuffer(once.as_buffer(), "<u4")  # each place once in a part
                cell[place] = np.minimum(cell[place] + 1, 2)
                cell[np.frombuffer(more.as_buffer(), "<u4")] = 2
        if now is not None:
            yield bits(now, cell)

    return parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk int, bits binary")


def possible_repeat(hashes: DataFrame, cells: int):
    """A function of a hash column: false only for texts that occur once."""
    sketch = np.zeros(cells // 8, np.uint8)
    for row in merge_cells(count_cells(hashes, cells)).toLocalIterator():  # ``cells`` bits in all
        sketch[row["chunk"] * (CHUNK // 8):(row["chunk"] + 1) * (CHUNK // 8)] = np.frombuffer(row["bits"], np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(sketch)

    @F.pandas_udf("boolean")
    def found(h: pd.Series) -> pd.Series:
        cell = probes(h.to_numpy(np.int64, copy=True), cells)
        bit = shared.value[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        return pd.Series(bit.all(0))

    return found


def with_repeats(docs: DataFrame, scratch: Scratch, cells: int | None = None) -> DataFrame:
    """(id, part, mask): each row's full mask, bit 4 for filter E."""
    rows = scratch.write(verdicts(docs), "verdicts")
    found = possible_repeat(rows.select("h"), cells or sketch_cells(rows.count()))
    text = F.coalesce("text", F.lit(""))
    # by full text; an id's own hashes then lead back to its row
    least = scratch.write(
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
        .where(found(text_hash(F.col("text")))).groupBy("text").agg(F.min("id").alias("id"))
        .select("id", text_hash(F.col("text")).alias("h"), F.xxhash64("text", F.lit(1)).alias("g")).distinct()
        .withColumn("first", F.lit(True)), "least")
    marked = rows.withColumn("maybe", found("h"))
    judged = marked.where("maybe").join(least, ["id", "h", "g"], "left").select(
        "id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << 4)).alias("mask"))
    return marked.where("not maybe").select("id", "part", "mask").unionByName(judged)


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): additive counts of the rows (id, part, mask)."""
    named = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    combined = rows.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return combined.join(named, "id", "left").groupBy("part", "mask", is_one("good"), is_one("toxic")).agg(F.sum("n").alias("n"))


def orders(counts: DataFrame) -> DataFrame:
    """The report: a row for each part, order of the filters and step, from the mask counts.

    An order's step fails the documents whose mask has the step's bit and none of the
    steps before; ``shapley`` weighs each set of filters before by the orders that have it.
    """
    masks = range(1 << len(FILTERS))
    total = lambda kind, m: F.sum(F.when((F.col("mask") == m) & kind, F.col("n")).otherwise(0))
    kinds = {"n": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    parts = counts.groupBy("part").agg(*[F.array(*[total(kind, m) for m in masks]).alias(name) for name, kind in kinds.items()])

    def over(name: str, wanted) -> Column:
        """Sum of the counts of the masks that ``wanted`` holds for."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(masks) - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(
            wanted(m), F.element_at(F.col(name), m + 1)).otherwise(F.lit(0).cast("long")))

    has = lambda m, bit: m.bitwiseAND(bit) != 0
    at_step = parts.withColumn("shapley", F.array(*[shapley(i) for i in range(len(FILTERS))]))
    steps = F.array(*[F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << FILTERS.index(o[k])).alias("bit"),
                               F.lit(sum(1 << FILTERS.index(x) for x in o[:k])).alias("before"))
                      for o in permutations(FILTERS) for k in range(len(FILTERS))])
    rows = at_step.withColumn("at", F.explode(steps)).select("*", "at.*")
    bit, before = F.col("bit"), F.col("before")
    lost = lambda m: has(m, bit) & ~has(m, before)
    return rows.select(
        "part", "filter_order", "step", over("n", lambda m: ~has(m, before.bitwiseOR(bit))).alias("kept"), over("n", lost).alias("removed"),
        over("n", lambda m: has(m, bit) & has(m, before)).alias("redundant"), over("n", lambda m: m == bit).alias("unique_fails"),
        over("good", lost).alias("good_lost"), over("toxic", lost).alias("toxic_lost"),
        F.element_at("shapley", F.instr(F.lit(FILTERS), F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))).alias("shapley"))


def shapley(i: int) -> Column:
    """Documents that filter number ``i`` removes, summed over all orders, from the counts by mask."""
    size = len(FILTERS)
    out = F.lit(0).cast("long")
    for m in range(1 << size):
        if not m >> i & 1:
            continue
        others = bin(m).count("1") - 1  # the filter removes the document where it comes before all of these
        out = out + F.element_at("n", m + 1) * F.lit(factorial(size) // (others + 1)).cast("long")
    return out


def audit(docs: DataFrame, labels: DataFrame, cells: int | None = None) -> DataFrame:
    """One row per source value, order of the five filters and step.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. ``cells``: size of the sketch, by default from the number
    of rows; a smaller one sends more texts through the shuffle and changes nothing.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    counts = scratch.write(mask_counts(with_repeats(docs, scratch, cells), labels), "counts")
    return orders(counts)
