"""Helpers shared by the corpus operators: shared storage, row keys, batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyloom.session import ensure_checkpoint_dir

# Text bytes that a task handles at once in numpy; longer single texts are handled alone.
CHUNK_BYTES = 4 << 20
MOST_FILES = 50_000  # whose numbers are broadcast; a row of some 200 bytes each


class Scratch:
    """Tables written to the shared folder of ``spark.checkpoint.dir``.

    A written table cuts lineage: later steps reread it from shared storage, so
    a lost executor costs the rereading of its splits, not the steps before.
    ``drop`` removes a table that a later one replaces; the rest goes when the
    application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._fs().deleteOnExit(self._path(self.root))

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._fs().delete(self._path(f"{self.root}/{table}"), True)


def with_row_id(docs: DataFrame, scratch: Scratch, columns: list[str], row: str, stored: bool = False) -> DataFrame:
    """The named columns with a unique long row key ``row``.

    Document ids may be null or repeated, so joins use this key. It is the same in
    every later read, however the files are then split and whichever executors are
    there. With ``stored``, which says that ``docs`` is itself a plain read of Parquet
    files, it is the row's place in its file after the file's number among all files,
    written once; no text is copied. Otherwise (or with more than ``MOST_FILES`` files)
    the frame is written with its keys and reread.
    """
    if stored and "_metadata" not in docs.columns:
        paths = scratch.write(docs.select(F.col("_metadata.file_path").alias("__path")).distinct(), "paths")
        if paths.count() <= MOST_FILES:
            number = F.row_number().over(Window.orderBy("__path")).cast("long")
            files = scratch.write(paths.select("__path", number.alias("__file")), "files")
            placed = docs.select(*columns, F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at"))
            return placed.join(F.broadcast(files), "__path").select(  # a row for each of at most ``MOST_FILES`` files
                *columns, (F.shiftleft("__file", 40) + F.col("__at")).alias(row))
    return scratch.write(docs.select(*columns).withColumn(row, F.monotonically_increasing_id()), "rows")


def below_cut(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The rows of smallest hash of ``keys``, somewhat more than ``limit`` of them; all when there are no more.

    The rows are counted first and those beyond the expected cut dropped where they are read.
    """
    total = rows.count()
    cut = int((limit + 4 * limit ** 0.5) / max(total, 1) * 2.0 ** 64) - (1 << 63)
    return rows if total <= limit or cut >= 1 << 63 else rows.where(F.xxhash64(*keys) < cut)


def hash_sample(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """At most ``limit`` rows, those of smallest hash of ``keys``; no task or driver gets more than about as many."""
    return below_cut(rows, limit, *keys).orderBy(F.xxhash64(*keys), *keys).limit(limit)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column (in any case) has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def text_batches(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the record batches with about ``limit`` bytes of text each."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """The texts as Python strings, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts in a row (null: none) and each text's start, plus the end."""
    raw = [(t.as_buffer() if hasattr(t, "as_buffer") else None) for t in texts]
    parts = [np.frombuffer(b, np.uint8) if b is not None and b.size else np.empty(0, np.uint8) for b in raw]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint8)), starts


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising mixer (multiply and xor-shift), the same on every machine."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BASE = np.uint64(0x9E6C63D0876A3F35)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. n - 1`` modulo 2**64, kept for the process up to a few chunks' size."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(-(-max(n, 1) >> 20) << 20, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * CHUNK_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Running sums of values times powers; ``span_hashes`` reads any span's hash from them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the values from start to end: equal for equal spans wherever they are."""
    return mix64((sums[end] - sums[start]) * powers(BASE_INVERSE, len(sums))[start])


BYTE_VALUES = mix64(np.arange(1, 257))
OTHER_VALUES = mix64(np.arange(1001, 1257))  # for a second, independent hash


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False


def word_spans(data: np.ndarray, starts: np.ndarray, kept: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of ``kept`` bytes, by default none of ``[\\x20\\x09-\\x0D]``),
    and each text's first word plus the end.

    ``data`` holds all texts' bytes one after the other, ``starts`` each one's start plus the end.
    """
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = kept[data]
    begin = solid[1:] & ~solid[:-1]
    stop = solid[:-1] & ~solid[1:]
    cuts = starts[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[solid[cuts] & solid[cuts + 1]]  # a word that ends at one text's end and one that starts the next
    begin[both] = stop[both] = True
    first, last = np.flatnonzero(begin), np.flatnonzero(stop)
    return first, last, np.searchsorted(first, starts)


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Hash of each word, the same wherever it stands; about ``CHUNK_BYTES`` of the bytes are handled at once."""
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        low = int(first[at])
        end = max(at + 1, int(np.searchsorted(last, low + CHUNK_BYTES, side="right")))
        sums = prefix_hashes(values[data[low:int(last[end - 1])]])
        out[at:end] = span_hashes(sums, first[at:end] - low, last[at:end] - low)
        at = end
    return out
