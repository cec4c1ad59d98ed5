"""Token counts: separator scan over flat, unindexed token files.

A file is a plain run of little-endian unsigned ids (16 bits; 32 for a vocabulary
that needs them), each document ended by id 0; there is no index of where documents start. Files are read as blocks;
numpy finds all separators of a block at once, and what a document has before a
block's first separator is stitched to the blocks before by a prefix scan over
the blocks' summaries (tokens after the last separator, or the whole block).

Scale: blocks are scanned independently, so a file or a document of any number of
blocks is split over tasks. Only one summary row per block takes part in the
scan; it runs per file, in two levels (``BLOCKS_PER_RUN`` blocks, then runs), so
no window holds more than one run, or one row per run of a file. Whole documents
inside a block never leave it. The token files themselves are written by a map-
only job, one file for each read split. The task that writes a file also writes the
names of its documents, in their order, to a file of the same number; both are
committed together, so no later job has to find a row's place again.

Nulls and empty texts: no tokens, count 0. Tokens after a file's last separator
(a file cut short) count as a document with ``ended`` false; an empty file has
no document. Empty input: empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyloom.llm.common import Scratch, text_batches, texts_of

END = 0  # id of the end of a document; vocabulary ids are stored plus one
WIDTHS = {2: "<u2", 4: "<u4"}  # bytes an id
TOKENS, NAMES = 0, 1  # the two kinds of files
BLOCK_BYTES = 1 << 20
BLOCKS_PER_RUN = 1024


def width_for(ids: int) -> int:
    """Bytes that each of ``ids`` ids plus one, and the end id, fit into."""
    for width in sorted(WIDTHS):
        if ids < 1 << 8 * width:
            return width
    raise ValueError(f"{ids} ids don't fit into {max(WIDTHS)} bytes")


def encode_ids(docs: DataFrame, vocabulary: str, width: int) -> DataFrame:
    """(kind, place, value): for each row its ids plus one as bytes, then its name, with its place in the split.

    A name is ``=`` and the hexadecimal text of the doc_id, ``-`` for null. ``vocabulary``:
    tokenizer file, readable at the same place on every executor.
    """
    names = ["kind", "place", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallyloom.llm.bpe import model
        bpe = model(vocabulary)
        ids: list[pa.Array] = []
        place = 0
        for batch in text_batches(batches, 0):
            raw = [(np.frombuffer(r, "<u4") + 1).astype(WIDTHS[width]).tobytes() for r in bpe.encode_batch(texts_of(batch, 0))]
            at = np.arange(place, place + len(raw))
            place += len(raw)
            ids.append(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), TOKENS, np.int32)), pa.array(at), pa.array(raw, pa.binary())], names=names)
        at = 0
        for column in ids:  # a few bytes a row of one split
            value = [b"-" if x is None else b"=" + x.encode().hex().encode() for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), NAMES, np.int32)), pa.array(np.arange(at, at + len(value))),
                                              pa.array(value, pa.binary())], names=names)
            at += len(value)

    return docs.select("text", F.col("doc_id").cast("string").alias("doc_id")).mapInArrow(run, "kind int, place long, value binary")


def write_token_files(ids: DataFrame, path: str, width: int) -> None:
    """Write each partition's rows as one flat file of each kind, every row followed by the end id.

    Spark's text writer puts a row's bytes as they are and then the line
    separator, which is the end id here.
    """
    (ids.sortWithinPartitions("kind", "place").select(F.col("value").cast("string").alias("value"), "kind")
     .write.partitionBy("kind").option("lineSep", "\0" * width).text(path))


def document_names(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(part, doc_no, name): the names beside the token files; one file of names is at most 2 GB."""
    files = spark.read.format("binaryFile").load(f"{path}/kind={NAMES}")
    lines = F.split(F.col("content").cast("string"), "\0" * width)  # ends with an empty one
    return files.select(part_of("path"), F.posexplode(lines).alias("doc_no", "name")).where("name <> ''")


def part_of(path: str):
    return F.regexp_extract(path, r"part-(\d+)-[^/]*$", 1).cast("long").alias("part")


def token_blocks(spark: SparkSession, path: str, block: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the flat files under ``path``: (file, block, data). One file is at most 2 GB here."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content", "length")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block).cast("long"))
    return files.where(F.col("length") > 0).select("path", "content", F.explode(blocks).alias("block")).select(
        F.col("path").alias("file"), "block",
        F.substring(F.col("content"), (F.col("block") * block + 1).cast("int"), F.lit(block)).alias("data"))


def scan_blocks(blocks: DataFrame, width: int = 2) -> DataFrame:
    """One row per block: (file, block, n_ends, head, tail, inner).

    ``head``: tokens before the first end id; ``tail``: after the last one; both
    are the block's size where there is none. ``inner``: counts of the documents
    between the block's end ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails, counts, inner = [], [], [], []
            for value in batch.column(2):
                ids = np.frombuffer(value.as_buffer(), WIDTHS[width])
                ends = np.flatnonzero(ids == END)
                counts.append(len(ends))
                heads.append(int(ends[0]) if len(ends) else len(ids))
                tails.append(len(ids) - 1 - int(ends[-1]) if len(ends) else len(ids))
                inner.append(np.diff(ends) - 1)
            flat = pa.array(np.concatenate(inner).astype(np.int64)) if inner else pa.array([], pa.int64())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in inner])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(heads, pa.int64()),
                pa.array(tails, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                names=["file", "block", "n_ends", "head", "tail", "inner"])

    return blocks.select("file", "block", "data").mapInArrow(
        run, "file string, block long, n_ends long, head long, tail long, inner array<long>")


def stitch(scanned: DataFrame, run_blocks: int = BLOCKS_PER_RUN) -> DataFrame:
    """Add ``carry`` (tokens of the open document before the block), ``before`` (documents
    ended before the block) and ``last`` (the file's last block) by a two-level prefix scan."""
    keyed = scanned.withColumn("run", F.floor(F.col("block") / run_blocks))
    # carry after some blocks: the tail of the last block with an end id plus all whole blocks after it;
    # as running sums: tokens since the start minus tokens up to the last end id
    size = F.when(F.col("n_ends") > 0, F.col("head") + F.col("tail") + F.col("n_ends") + F.aggregate(
        "inner", F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.col("head"))
    keyed = keyed.withColumn("size", size)
    inside = Window.partitionBy("file", "run").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn(
        "open_at", F.when(F.col("n_ends") > 0, F.col("at") + F.col("size") - F.col("tail")))
    runs = local.groupBy("file", "run").agg(
        F.sum("size").alias("run_size"), F.max("open_at").alias("run_open"), F.sum("n_ends").alias("run_ends"), F.max("block").alias("top"))
    over_runs = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("run_at", F.coalesce(F.sum("run_size").over(over_runs), F.lit(0))).withColumn(
        "opened", F.max(F.col("run_at") + F.col("run_open")).over(over_runs)).withColumn(
        "ends_before", F.coalesce(F.sum("run_ends").over(over_runs), F.lit(0))).withColumn(
        "last_block", F.max("top").over(Window.partitionBy("file"))).select(
        "file", "run", "run_at", "opened", "ends_before", "last_block")
    both = local.join(starts, ["file", "run"])
    opened = F.greatest(F.coalesce("opened", F.lit(0)), F.coalesce(F.col("run_at") + F.max("open_at").over(before), F.lit(0)))
    return both.select(
        "file", "block", "n_ends", "head", "tail", "inner", (F.col("run_at") + F.col("at") - opened).alias("carry"),
        (F.col("ends_before") + F.coalesce(F.sum("n_ends").over(before), F.lit(0))).alias("before"),
        (F.col("block") == F.col("last_block")).alias("last"))


def count_documents(blocks: DataFrame, run_blocks: int = BLOCKS_PER_RUN, width: int = 2) -> DataFrame:
    """One row per document of the files: (file, doc_no, n_tokens, ended), doc_no from 0 in each file."""
    joined = stitch(scan_blocks(blocks, width), run_blocks)
    first = F.array((F.col("carry") + F.col("head")).cast("long"))
    ended = F.when(F.col("n_ends") > 0, F.concat(first, "inner")).otherwise(F.array().cast("array<long>"))
    open_ = F.when(F.col("last"), F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))).otherwise(0)
    counts = F.concat(F.transform(ended, lambda n: F.struct(n.alias("n_tokens"), F.lit(True).alias("ended"))),
                      F.when(open_ > 0, F.array(F.struct(open_.cast("long").alias("n_tokens"), F.lit(False).alias("ended"))))
                      .otherwise(F.array().cast("array<struct<n_tokens:bigint,ended:boolean>>")))
    return joined.select("file", "before", F.posexplode(counts).alias("at", "doc")).select(
        "file", (F.col("before") + F.col("at")).alias("doc_no"), "doc.n_tokens", "doc.ended")


def document_token_counts(docs: DataFrame, vocabulary: str, width: int | None = None) -> DataFrame:
    """(doc_id, n_tokens): write ``docs`` as flat token files, count by the scan, and name the counts.

    Document n of token file p has the name in line n of names file p, which the same
    task wrote; so counts and names meet in an equi-join. ``width``: bytes an id, by
    default what the vocabulary needs. A name without a count is an error.
    """
    from tallyloom.llm.bpe import model
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "token-counts")
    path, width = f"{scratch.root}/tokens", width or width_for(model(vocabulary).size)
    if docs.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens")).where(F.lit(False))
    write_token_files(encode_ids(docs, vocabulary, width), path, width)
    counts = count_documents(token_blocks(spark, f"{path}/kind={TOKENS}"), width=width).select(part_of("file"), "doc_no", "n_tokens")
    name = F.when(F.col("name") != "-", F.decode(F.unhex(F.substring("name", 2, 1 << 30)), "utf-8")).cast(docs.schema["doc_id"].dataType)
    missing = F.raise_error(F.lit("a document's tokens weren't found")).cast("long")
    return document_names(spark, path, width).join(counts, ["part", "doc_no"], "left").select(
        name.alias("doc_id"), F.coalesce("n_tokens", missing).alias("n_tokens"))
