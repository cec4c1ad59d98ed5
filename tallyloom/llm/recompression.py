"""Substring dedup by recompression.

Every text is a string of word symbols. A round replaces maximal runs of one
symbol, or adjacent pairs (a, b) with a on the left and b on the right side of a
hashed split of the alphabet, by new symbols. A new symbol's name is a
fingerprint of what it replaces, so every task gives equal runs and pairs the
same name and no table of rules has to be shared. What a round does inside a
window of words depends on the window alone but for its edges; dropping the edge
symbols whose fate outside words decide leaves interior symbols that equal
windows share wherever they stand.

Each window is named by one interior symbol of its last non-empty round, the
longest one. Spark counts the names: a window can only repeat in another document
if its symbol occurs in another document. Only windows under such shared symbols
are then compared, by 128-bit digests of their words (two independent halves),
which verifies the repeat and finds the smallest document that has it.

Scale: texts of the same words are handled once (a digest of the words joined by
one space, 32 bytes a row, is grouped first). One row per name and text, about one in five words, is
shuffled by name, and the digests of windows under shared symbols. Each batch of
texts first decides what it can by itself, and sends its decided rows under keys of
their own; a name or a window in a third of all documents is a few rows for each
batch (``CHUNK_BYTES`` of text) in its group. Texts are shuffled once, by row.

Nulls and empty texts: no words. A null doc_id is larger than all others. Rows of
one doc_id don't remove each other's words; of texts of the same words, whatever
white space is between them, with different ids all but the smallest lose all words covered by windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.llm.common import (OTHER_VALUES, Scratch, byte_buffer, mix64, prefix_hashes, span_hashes, text_batches,
                                  with_row_id, word_hashes, word_spans)

WINDOW = 13
PAIR_ROUNDS = 4
SLICE_WORDS = 1 << 20  # whose windows are named at once; more of a longer text follow
NO_ID = (1 << 63) - 1
RUN, LEFT, RIGHT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


class Symbols:
    """The symbols of a batch of texts in one round: names, first words, and which start a text."""

    def __init__(self, name: np.ndarray, start: np.ndarray, opens: np.ndarray):
        self.name, self.start, self.opens = name, start, opens

    def runs(self) -> tuple[Symbols, np.ndarray]:
        """Name maximal runs; also each symbol's number in the new round."""
        fresh = np.ones(len(self.name), bool)
        fresh[1:] = (self.name[1:] != self.name[:-1]) | self.opens[1:]
        at = np.flatnonzero(fresh)
        length = np.diff(np.append(at, len(self.name))).astype(np.uint64)
        name = np.where(length > 1, mix64(self.name[at] * RUN + length), self.name[at])
        return Symbols(name, self.start[at], self.opens[at]), np.cumsum(fresh) - 1

    def sides(self, number: int) -> np.ndarray:
        """The round's hashed split of the alphabet: whether each symbol is on the left side."""
        return (mix64(self.name + np.uint64(number)) >> np.uint64(40)) & np.uint64(1) == 1

    def pairs(self, left: np.ndarray) -> tuple[Symbols, np.ndarray]:
        """Name each left symbol followed by a right one; also each symbol's number in the new round."""
        joined = np.zeros(len(self.name), bool)
        joined[:-1] = left[:-1] & ~left[1:] & ~self.opens[1:]
        name = self.name.copy()
        at = np.flatnonzero(joined)
        name[at] = mix64(self.name[at] * LEFT + self.name[at + 1] * RIGHT)
        kept = np.ones(len(self.name), bool)
        kept[at + 1] = False
        return Symbols(name[kept], self.start[kept], self.opens[kept]), np.cumsum(kept) - 1


def name_windows(words: np.ndarray, begin: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts: first word, the name of its interior symbol, and that symbol's place.

    ``words``: hashes of all texts' words in a row; ``begin``: each text's first word plus the end.
    """
    at = np.arange(max(len(words) - window + 1, 0))
    text = np.searchsorted(begin, at, side="right")
    at = at[at + window <= begin[np.minimum(text, len(begin) - 1)]]
    opens = np.zeros(len(words), bool)
    opens[begin[:-1][begin[:-1] < len(words)]] = True
    now = Symbols(words, np.arange(len(words)), opens)
    low, high = at.copy(), at + window
    name, place = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for number in range(PAIR_ROUNDS + 2):
        before, was_low, was_high, was_live = now, low, high, live
        if number == PAIR_ROUNDS + 1:
            ended = np.ones(len(live), bool)
        elif number == 0:
            now, new = before.runs()
            low, high = new[low] + 1, new[high - 1]
            ended = low >= high
        else:
            left = before.sides(number)
            now, new = before.pairs(left)
            low, high = new[low] + ~left[low], new[high - 1] + ~left[high - 1]
            ended = low >= high
        chosen = longest(before, was_low[ended], was_high[ended], len(words))
        name[was_live[ended]] = mix64(before.name[chosen] + np.uint64(number))
        place[was_live[ended]] = before.start[chosen] * (PAIR_ROUNDS + 2) + number
        low, high, live = low[~ended], high[~ended], live[~ended]
        if not len(live):
            break
    return at, name, place


def named_in_slices(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``name_windows``, ``SLICE_WORDS`` of them at a time: a window's name depends on its words alone."""
    if len(words) <= 2 * SLICE_WORDS:
        return name_windows(words, begin)
    parts = []
    for low in range(0, len(words), SLICE_WORDS):
        high = min(low + SLICE_WORDS + WINDOW - 1, len(words))
        at, name, place = name_windows(words[low:high], np.unique(np.clip(begin - low, 0, high - low)))
        parts.append((at + low, name, place + low * (PAIR_ROUNDS + 2)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def longest(symbols: Symbols, low: np.ndarray, high: np.ndarray, end: int) -> np.ndarray:
    """In each range of symbols the one of most words, then of smallest name, then the first."""
    length = np.diff(np.append(symbols.start, end))
    best = low.copy()
    for step in range(1, int((high - low).max()) if len(low) else 0):
        here = np.minimum(low + step, len(length) - 1)
        a, b = length[here], length[best]
        better = (low + step < high) & ((a > b) | (a == b) & (symbols.name[here] < symbols.name[best]))
        best = np.where(better, here, best)
    return best


def segments(texts: pa.Array) -> tuple:
    """The texts' words and their segments: runs of windows with one interior symbol.

    Gives bytes, first and last byte of each word, each text's first word, the
    windows' first words, the first window of each segment, its text and its name.
    """
    data, starts = byte_buffer(texts)
    first, last, begin = word_spans(data, starts)
    words = word_hashes(data, first, last)
    at, name, place = named_in_slices(words, begin)
    fresh = np.ones(len(at), bool)
    text = np.searchsorted(begin, at, side="right") - 1
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    segment = np.flatnonzero(fresh)
    return data, first, last, begin, words, at, segment, text[segment], name[segment]


def symbol_rows(rows: DataFrame) -> DataFrame:
    """(key, row, content): each name in each text once; ``content`` is a hash of the text's words
    that tells copies (as ``words_digest`` groups them) from other texts with the same symbol.

    Of the copies in a batch of texts only the first stands for all. What the batch
    decides stays out of the name's group: a name in two contents of it is shared,
    so its rows have no content and a key of their own (``own_key``), and only two
    rows without a text, of two contents, go to the name. So a name has a few rows
    for each batch, however many texts hold it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            _, _, _, begin, words, *_, text, name = segments(batch.column(1))
            content = span_hashes(prefix_hashes(words), begin[:-1], begin[1:])
            id_, row = np.asarray(batch.column(2)), np.asarray(batch.column(0))
            by = np.lexsort((row, id_, content))
            first = np.zeros(len(by), bool)
            first[by] = np.append(True, content[by][1:] != content[by][:-1])[:len(by)]
            mine = first[text]
            name, text = name[mine], text[mine]
            _, once = np.unique(in_text(name, text), return_index=True)
            name, text = name[once], text[once]
            names, at, n = np.unique(name, return_index=True, return_counts=True)  # the contents of a name's texts differ
            shared = n[np.searchsorted(names, name)] > 1
            again = names[n > 1]
            low, high = text[at[n > 1]], text[len(name) - 1 - np.unique(name[::-1], return_index=True)[1][n > 1]]
            own = own_key(name[shared], row[text[shared]])
            key = np.concatenate([name[~shared], own, again, again])
            out_row = pa.concat_arrays([pa.array(row[text[~shared]]), pa.array(row[text[shared]]), pa.nulls(2 * len(again), pa.int64())])
            said = content.view(np.int64)
            out = pa.concat_arrays([pa.array(said[text[~shared]]), pa.nulls(int(shared.sum()), pa.int64()),
                                    pa.array(said[low]), pa.array(said[high])])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), out_row, out], names=["key", "row", "content"])

    return rows.select("row", "text", "id").mapInArrow(run, "key long, row long, content long")


def own_key(name: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A key that spreads the rows of a name; applied again it gives the name back."""
    return name ^ mix64(row.astype(np.int64).view(np.uint64) + np.uint64(1))


def words_digest(text: Column) -> Column:
    """Digest of the text's words joined by one space: equal for texts that differ in white space only."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.sha2(words.cast("binary"), 256)


def in_text(name: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One hash for a name and the number of its text in the batch."""
    return mix64(name + mix64(text))


def window_rows(live: DataFrame) -> DataFrame:
    """(a, b, row, id, place, more): digests of the windows of the segments in ``names`` and ``keys`` of each text.

    A window that stands under a smaller id in the same batch of texts is decided:
    it has no id and a key of its own. Only the batch's smallest id of a window
    goes to the window's group, in one row for a text: ``more`` are the places where the
    text has the window again (else null).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            data, first, last, begin, words, at, segment, text, name = segments(batch.column(1))
            row, id_ = np.asarray(batch.column(0)), np.asarray(batch.column(3))
            names, keys = batch.column(4), batch.column(5)
            count = lambda x: np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(x)))
            of, spread = count(names), count(keys)
            back = own_key(np.asarray(keys.flatten()).view(np.uint64), row[spread])
            wanted = np.concatenate([in_text(np.asarray(names.flatten()).view(np.uint64), of), in_text(back, spread)])
            chosen = np.isin(in_text(name, text), wanted)
            at = at[np.repeat(chosen, np.diff(np.append(segment, len(at))))]
            of = np.searchsorted(begin, at, side="right") - 1
            other = prefix_hashes(word_hashes(data, first, last, OTHER_VALUES))
            a, b = span_hashes(prefix_hashes(words), at, at + WINDOW), span_hashes(other, at, at + WINDOW)
            by = np.lexsort((of, b, a))  # equal windows of one text in their order
            a, b, of, place = a[by], b[by], of[by], (at - begin[of])[by].astype(np.int32)
            window = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
            text = window | np.append(True, of[1:] != of[:-1])[:len(a)]
            least = np.minimum.reduceat(id_[of], np.flatnonzero(window))[np.cumsum(window) - 1] if len(a) else id_[of]
            lead = np.flatnonzero(text)
            count = np.diff(np.append(lead, len(a))) - 1
            ends = pa.array(np.append(0, np.cumsum(count)).astype(np.int32), mask=np.append(count == 0, False))
            a, b, of, least = a[lead], b[lead], of[lead], least[lead]
            decided = least < id_[of]
            a[decided] = own_key(a[decided], row[of[decided]])
            yield pa.RecordBatch.from_arrays([
                pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(row[of]), pa.array(id_[of], mask=decided),
                pa.array(place[lead]), pa.ListArray.from_arrays(ends, pa.array(place[~text]))], names=["a", "b", "row", "id", "place", "more"])

    return live.select("row", "text", "doc_id", "id", "names", "keys").mapInArrow(
        run, "a long, b long, row long, id long, place int, more array<int>")


def cut_words(found: DataFrame) -> DataFrame:
    """Remove the words covered by the windows in ``places`` (``every``: by any window)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            data, starts = byte_buffer(batch.column(1))
            first, last, begin = word_spans(data, starts)
            n, gone, digest, kept = [], [], [], []
            raw = data.tobytes()
            for i, (every, places) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                size = int(begin[i + 1] - begin[i])
                cover = np.zeros(size + 1, np.int32)
                if every and size >= WINDOW:
                    cover[0], cover[size] = 1, -1
                elif places.is_valid:
                    where = np.asarray(places.values, np.int64)
                    np.add.at(cover, where, 1)
                    np.add.at(cover, where + WINDOW, -1)
                stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0) + begin[i]
                text = b" ".join([raw[a:b] for a, b in zip(first[stay].tolist(), last[stay].tolist())])
                n.append(size)
                gone.append(size - len(stay))
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()),
                pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "every", "places").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def substring_dedup(docs: DataFrame, stored: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept.

    Words covered by a window that also starts in a document with a smaller
    doc_id are removed; ``kept`` joins the others by one space. ``stored``: see
    ``with_row_id``.
    """
    scratch = Scratch(docs.sparkSession, "recompression")
    rows = with_row_id(docs, scratch, ["doc_id", "text"], "row", stored).withColumn(
        "id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).select("row", "text", "doc_id", "id")
    digest = rows.select("row", "id", words_digest(F.col("text")).alias("digest"))
    groups = scratch.write(digest.groupBy("digest").agg(
        F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    copies = scratch.write(digest.join(groups.hint("merge"), "digest").where(F.col("row") != F.col("first.row")).select(
        "row", (F.col("id") > F.col("first.id")).alias("every"), F.col("first.row").alias("twin")), "copies")
    by_name = Window.partitionBy("key")
    own = F.when(F.col("content").isNull(), F.col("key"))
    shared = scratch.write(
        symbol_rows(rows).withColumn("low", F.min("content").over(by_name)).withColumn("high", F.max("content").over(by_name))
        .where("row IS NOT NULL AND (content IS NULL OR low < high)").groupBy("row").agg(
            F.collect_list(F.when(F.col("content").isNotNull(), F.col("key"))).alias("names"), F.collect_list(own).alias("keys"))
        .join(copies, "row", "left_anti"), "shared")
    by_window = Window.partitionBy("a", "b")
    gone = (window_rows(rows.join(shared.hint("merge"), "row")).withColumn("least", F.min("id").over(by_window))
            .where("id IS NULL OR least < id").groupBy("row").agg(F.concat(
                F.collect_list("place"), F.flatten(F.collect_list("more"))).alias("places")))
    gone = scratch.write(gone, "gone")
    marks = gone.select("row", F.lit(False).alias("every"), "places").unionByName(
        copies.where("every").select("row", "every", F.lit(None).cast("array<int>").alias("places"))).unionByName(
        copies.where("not every").join(gone.withColumnRenamed("row", "twin").hint("merge"), "twin").select("row", "every", "places"))
    found = rows.join(marks.hint("merge"), "row", "left")
    return cut_words(found.withColumn("every", F.coalesce("every", F.lit(False))))
