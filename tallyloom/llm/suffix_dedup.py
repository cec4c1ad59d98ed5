"""Suffix-array dedup: repeated 400-byte strings from merged shard transforms.

A window is a 400-byte string of one text. Each window is named by the hash of
its anchor, the 32-byte string of smallest hash in it (the first of equals), so
equal windows have equal names. Consecutive windows with one anchor are a
segment. Spark counts the names: a window whose name occurs once can't repeat.
The distinct segments of the other names, each with its number of occurrences,
go to tasks by name; there they form shards whose Burrows-Wheeler transforms are
merged (``bwt``). An interval of rows with a common prefix of 400 bytes whose
segments occur at least twice in all is a repeated window; all its rows, copies
included, are removed wherever they occur. Windows are judged on the input.

Scale: one row per segment, about one in 185 bytes, is written; segments and names
are counted by aggregates, combined before the shuffle, that join back, so a name or a
segment in a third of all texts is never in one task. Of
equal segments only one goes to the transforms, so copies cost nothing there; a
name of one distinct segment is a collection of one string, whose rows are
intervals of their own with the segment's weight, and needs no transform. A name with more than ``SPLIT`` distinct segments is split: windows that hold the
bytes left of the anchor, and those that hold the bytes right of it, get new
names from those longer strings, again and again until names are small or the
name is the window itself, where many pieces are one interval. A task holds one batch of
``BATCH_BYTES`` at most, or one name's pieces. Each
text is shuffled twice by its row, to cut out segments and to remove bytes.

Nulls and empty texts: no bytes, nothing removed. Texts under 400 bytes have no
windows. Repeated rows are occurrences like any other, whatever their doc_id. Long
texts are handled ``SLICE_BYTES`` at a time, in some 60 bytes of memory for each; a
text has under 2 GB.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.bwt import repeated_windows
from tallyloom.llm.common import (BYTE_VALUES, OTHER_VALUES, Scratch, byte_buffer, prefix_hashes, span_hashes, text_batches,
                                  with_row_id)
from tallyloom.llm.jaccard_join import groups_of

WINDOW = 400
ANCHOR = 32
SPLIT = 1500
BATCH_BYTES = 1 << 20
SHARD_BYTES = 1 << 19
TEXT_BYTES = 1 << 19  # of whole texts that are cut into segments at once
SLICE_BYTES = 1 << 20  # of a single longer text
PLACE_BITS = 31  # of the window's anchor key, the low bits hold its place
LOW_BITS = np.uint64((1 << PLACE_BITS) - 1)


def anchors(data: np.ndarray, starts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window of the texts, and of its anchor."""
    n = len(data) - ANCHOR + 1
    span = WINDOW - ANCHOR + 1
    if len(data) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blocks = np.full(-(-n // span) * span, np.iinfo(np.uint64).max)
    key = blocks[:n]
    key[:] = span_hashes(sums, slice(0, n), slice(ANCHOR, n + ANCHOR))
    key &= ~LOW_BITS
    key |= np.arange(n, dtype=np.uint64)
    blocks = blocks.reshape(-1, span)
    windows = len(data) - WINDOW + 1
    least = np.minimum.accumulate(blocks, axis=1).ravel()[span - 1:span - 1 + windows]
    np.minimum.accumulate(blocks[:, ::-1], axis=1, out=blocks[:, ::-1])
    np.minimum(least, blocks.ravel()[:windows], out=least)
    least &= LOW_BITS
    inside = np.zeros(len(data) + 1, np.int32)
    sizes = np.diff(starts)
    long = sizes >= WINDOW
    np.add.at(inside, starts[:-1][long], 1)
    np.add.at(inside, starts[1:][long] - WINDOW + 1, -1)
    keep = np.cumsum(inside, dtype=np.int32)[:windows] > 0
    return np.flatnonzero(keep), least[keep].view(np.int64)


def segments(row: pa.Array, data: np.ndarray, starts: np.ndarray, offset: int) -> pa.RecordBatch:
    """``segment_rows`` of texts held in a row, or of a slice of one text that begins at ``offset``."""
    sums = prefix_hashes(BYTE_VALUES[data])
    first, place = anchors(data, starts, sums)
    of = np.searchsorted(starts, first, side="right") - 1
    fresh = np.ones(len(first), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(fresh)
    begin, of, place = first[at], of[at], place[at]
    end = first[np.append(at[1:], len(first)) - 1] + WINDOW if len(at) else begin
    del first, fresh  # of all windows
    other = prefix_hashes(OTHER_VALUES[data])
    a, b = span_hashes(sums, begin, end), span_hashes(other, begin, end)
    by = np.lexsort((begin, a, of))
    first = np.ones(len(by), bool)
    first[1:] = (a[by][1:] != a[by][:-1]) | (of[by][1:] != of[by][:-1])
    lead = by[first]  # the first occurrence of each segment in its text
    occurrences = pa.ListArray.from_arrays(
        pa.array(np.append(np.flatnonzero(first), len(by)).astype(np.int32)), pa.array((begin - starts[of] + offset)[by].astype(np.int32)))
    return pa.RecordBatch.from_arrays([
        pa.array(span_hashes(sums, place[lead], place[lead] + ANCHOR).view(np.int64)), pa.array(a[lead].view(np.int64)),
        pa.array(b[lead].view(np.int64)), row.take(pa.array(of[lead])), occurrences,
        pa.array((end - begin)[lead].astype(np.int32)), pa.array((place - begin)[lead].astype(np.int32))],
        names=["name", "a", "b", "row", "starts", "size", "anchor"])


def segment_rows(rows: DataFrame) -> DataFrame:
    """(name, a, b, row, starts, size, anchor): each segment of each text with a 128-bit digest.

    starts: first bytes of the segment's occurrences in the text (many where the
    text repeats itself); size: bytes; anchor: the anchor's place in the segment.
    A long text is cut in slices that share ``WINDOW - 1`` bytes, so each window is
    in one; where that cuts a segment, both parts keep the anchor's name.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1, TEXT_BYTES):
            data, starts = byte_buffer(batch.column(1))
            for at in range(0, max(len(data) - WINDOW + 1, 1), SLICE_BYTES) if batch.num_rows == 1 else [0]:
                end = at + SLICE_BYTES + WINDOW - 1 if batch.num_rows == 1 else len(data)
                cut = np.minimum(starts, len(data[at:end])) if batch.num_rows == 1 else starts
                yield segments(batch.column(0), data[at:end], cut, at)

    return rows.select("row", "text").mapInArrow(
        run, "name long, a long, b long, row long, starts array<int>, size int, anchor int")


def split_hot(pieces: DataFrame, scratch: Scratch, limit: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Split names of more than ``limit`` pieces until there is none; also the windows that are sure.

    A piece has ``bytes``, its ``core`` (from, to: bytes that all its windows
    hold) and the place ``low`` of its first byte in the segment. With s bytes of
    a window outside the core, the windows that hold the s/2 bytes left of it
    and those that hold the bytes right of it are two pieces with longer cores.
    A core of a whole window can't be split: more than ``limit`` pieces of that
    name are one interval, and each window in it is repeated.
    """
    level, cold, sure = 0, [], []
    while True:
        hot = scratch.write(pieces.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(limit, 1))
                            .select("name"), f"hot{level}")
        if hot.isEmpty():
            found = pieces.sparkSession.createDataFrame([], "a long, b long, start int, count int")
            return reduce(DataFrame.unionByName, [*cold, pieces]), reduce(DataFrame.unionByName, sure, found)
        cold.append(pieces.join(hot, "name", "left_anti"))
        large = pieces.join(hot, "name", "left_semi")
        can = F.col("core_to") - F.col("core_from") < WINDOW
        sure.append(large.where(~can).select("a", "b", F.col("low").cast("int").alias("start"), F.lit(1).alias("count")))
        split = large.where(can)
        near = F.floor((WINDOW - F.col("core_to") + F.col("core_from") + 1) / 2).cast("int")
        edge = F.col("core_from") - near  # windows that start here or before hold the bytes left of the core
        size = F.octet_length("bytes")

        def part(low: Column, end: Column, core_from: Column, core_to: Column, side: int) -> DataFrame:
            cut = split.select("a", "b", "weight", "name", "low", "bytes", low.cast("int").alias("from"), end.cast("int").alias("end"),
                               core_from.cast("int").alias("f"), core_to.cast("int").alias("t"))
            cut = cut.where(F.col("end") - F.col("from") >= WINDOW)
            core = F.substring("bytes", F.col("f") + 1, F.col("t") - F.col("f"))
            return cut.select(
                F.xxhash64("name", F.lit(side), core).alias("name"), "a", "b", "weight", (F.col("low") + F.col("from")).alias("low"),
                F.substring("bytes", F.col("from") + 1, F.col("end") - F.col("from")).alias("bytes"),
                (F.col("f") - F.col("from")).alias("core_from"), (F.col("t") - F.col("from")).alias("core_to"))

        left = part(F.lit(0), F.least(size, edge + WINDOW), edge, F.col("core_to"), 0)
        right = part(F.greatest(F.lit(0), edge + 1), size, F.col("core_from"), edge + 1 + WINDOW, 1)
        cold[-1] = cold[-1].select(*left.columns)
        pieces = scratch.write(left.unionByName(right), f"pieces{level}")
        level += 1


def name_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
    """The pieces of whole names, ``BATCH_BYTES`` at most at once; a name beyond that alone."""
    held, size = [], 0
    for group in groups_of(batches, 1):
        if held and size + group.nbytes > BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append(group)
        size += group.nbytes
    if held:
        yield held


def repeats(pieces: DataFrame) -> DataFrame:
    """(a, b, start, count): runs of repeated windows of each segment, by merged transforms."""
    def judge(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        number: dict[tuple[int, bytes], int] = {}
        name, raw = table.column("name").to_pylist(), table.column("bytes").to_pylist()
        of = np.array([number.setdefault(x, len(number)) for x in zip(name, raw)])
        weight = np.bincount(of, np.asarray(table.column("weight")))
        found = repeated_windows([b for _, b in number], weight.tolist(), WINDOW, SHARD_BYTES)
        runs = []
        for at in found:
            cut = np.flatnonzero(np.diff(at) > 1) + 1
            begin = np.concatenate([[0], cut]).astype(np.int64) if len(at) else cut
            runs.append((at[begin], np.diff(np.append(begin, len(at)))))
        count = np.array([len(r[0]) for r in runs])[of]
        rows = np.repeat(np.arange(len(of)), count)
        start = np.concatenate([runs[i][0] for i in of]) + np.repeat(np.asarray(table.column("low")), count)
        length = np.concatenate([runs[i][1] for i in of])
        pick = pa.array(rows)
        return pa.RecordBatch.from_arrays([
            table.column("a").take(pick).combine_chunks(), table.column("b").take(pick).combine_chunks(),
            pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], names=["a", "b", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(judge, name_batches(batches))

    return (pieces.select("name", "a", "b", "weight", "low", "bytes").repartition("name").sortWithinPartitions("name")
            .mapInArrow(run, "a long, b long, start int, count int"))


def covered(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the stretches that the windows of the runs (start, count) cover."""
    by = np.argsort(start, kind="stable")
    start, end = start[by], start[by] + count[by] + WINDOW - 1
    reach = np.maximum.accumulate(end) if len(end) else end
    fresh = np.append(True, start[1:] > reach[:-1])[:len(start)]
    at = np.flatnonzero(fresh)
    return start[at], reach[np.append(at[1:], len(start)) - 1] if len(at) else reach


def cut_bytes(found: DataFrame) -> DataFrame:
    """Remove the bytes covered by the windows in ``runs`` (start, count)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            n, gone, spans, kept = [], [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                raw = text.as_buffer() if text.is_valid else None
                data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
                low = high = np.empty(0, np.int64)
                if runs.is_valid:
                    low, high = covered(np.asarray(runs.values.field("start"), np.int64), np.asarray(runs.values.field("count"), np.int64))
                n.append(len(data))
                gone.append(int((high - low).sum()))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(low, high)])
                kept.append(b"".join(data[a:b].tobytes() for a, b in zip([0, *high.tolist()], [*low.tolist(), len(data)])))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "runs").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def suffix_dedup(docs: DataFrame, stored: bool = False, split: int = SPLIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans (removed byte ranges), kept (bytes).

    ``stored``: see ``with_row_id``.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    rows = with_row_id(docs, scratch, ["doc_id", "text"], "row", stored).select("row", "text", "doc_id")
    segments = scratch.write(segment_rows(rows), "segments")
    lead = [F.first(c).alias(c) for c in ("row", "start", "size", "anchor")]  # all of one occurrence
    kinds = scratch.write(segments.withColumn("start", F.col("starts")[0]).groupBy("name", "a", "b").agg(
        F.sum(F.size("starts")).alias("weight"), *lead), "kinds")
    names = scratch.write(kinds.groupBy("name").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("kinds"))
                          .where("total > 1").select("name", "kinds"), "names")
    shared = scratch.write(kinds.join(names.hint("merge"), "name"), "shared")
    scratch.drop("kinds", "names")
    alone = shared.where("kinds = 1").select("a", "b", F.lit(0).alias("start"), (F.col("size") - WINDOW + 1).alias("count"))
    wanted = shared.where("kinds > 1").groupBy("row").agg(F.collect_list(F.struct(
        "name", "a", "b", "start", "size", "anchor", "weight")).alias("parts"))
    pieces = rows.select("row", F.col("text").cast("binary").alias("text")).join(wanted.hint("merge"), "row").select(
        "text", F.explode("parts").alias("p")).select(
        "p.name", "p.a", "p.b", "p.weight", F.lit(0).alias("low"), F.substring("text", F.col("p.start") + 1, F.col("p.size")).alias("bytes"),
        F.col("p.anchor").alias("core_from"), (F.col("p.anchor") + ANCHOR).alias("core_to"))
    pieces, sure = split_hot(scratch.write(pieces, "pieces-1"), scratch, split)
    found = scratch.write(repeats(pieces).unionByName(sure).unionByName(alone).groupBy("a", "b").agg(F.collect_list(F.struct("start", "count")).alias("found")), "found")
    runs = segments.select("a", "b", "row", "starts").join(found.hint("merge"), ["a", "b"]).select(
        "row", "found", F.explode("starts").alias("at")).groupBy("row").agg(
        F.flatten(F.collect_list(F.transform("found", lambda x: F.struct(
            (F.col("at") + x["start"]).alias("start"), x["count"].alias("count"))))).alias("runs"))
    return cut_bytes(rows.join(scratch.write(runs, "runs").hint("merge"), "row", "left"))
