"""Exact dedup by distributed MSD radix partitioning.

All texts start in one group. Each round takes the next bytes (a digit) of every
text still in play and splits its group by them. A group of one text is done; so
is a group whose texts ended inside the digit, which are then equal byte for
byte. No digest decides equality: texts are equal when every digit was equal.

Scale: a round is one aggregation over (group, digit), combined before the
shuffle, and one join with the groups that have at least two texts. These are
written first, so the join reads two plain shuffles and a hot group (one text
holding a third of all rows) is split by adaptive execution; the hint keeps this
plan at every size, as the number of groups grows with the data. A group's name is
its smallest row key, so no numbering pass is needed. Digits widen eightfold, so
a text of n bytes takes about log8(n / 32) rounds; single texts leave at once.

Nulls and empty texts: a null text counts as empty; texts that are empty after
normalisation form one group. A null document id sorts after all others.
Repeated rows are rows of the same group. Empty input: empty output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import Scratch, free_name, with_row_id

FIRST_DIGIT = 32
DIGIT_GROWTH = 8
MAX_DIGIT = 1 << 20
SPACES = " \t\n\x0b\x0c\r"


def without_spaces(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def radix_classes(rows: DataFrame, scratch: Scratch, row: str, key: str) -> DataFrame:
    """Classes of equal ``key`` (binary): (row, carried columns, ``class``, ``alone``).

    ``class`` is the smallest row key of the class; ``alone`` marks classes of
    one row. All other columns are carried through unchanged.
    """
    carried = [c for c in rows.columns if c not in (row, key)]
    active = rows.withColumn("__group", F.lit(-1).cast("long"))
    width, done, level = FIRST_DIGIT, [], 0
    while True:
        digit = F.substring(F.col(key), 1, width)
        split = active.withColumn("__digit", digit)
        groups = scratch.write(
            split.groupBy("__group", "__digit")
            .agg(F.min(row).alias("__next"), F.count(F.lit(1)).alias("__size"))
            .where(F.col("__size") > 1)
            .select("__group", "__digit", "__next"), f"groups{level}")
        sorted_ = split.join(groups.hint("merge"), ["__group", "__digit"], "left").select(
            row, *carried, F.col("__next"),
            F.when(F.octet_length("__digit") < width, F.lit(True)).otherwise(F.lit(False)).alias("__ended"),
            F.when(F.col("__next").isNotNull(), F.expr(f"substring({key}, {width + 1})")).alias(key))
        sorted_ = scratch.write(sorted_, f"level{level}")
        finished = F.col("__next").isNull() | F.col("__ended")
        done.append(sorted_.where(finished).select(
            row, *carried, F.coalesce("__next", row).alias("class"), F.col("__next").isNull().alias("alone")))
        scratch.drop(f"groups{level}")
        active = sorted_.where(~finished).select(row, *carried, key, F.col("__next").alias("__group"))
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)
        width, level = min(width * DIGIT_GROWTH, MAX_DIGIT), level + 1


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its class of equal normalised texts and the row that stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, row (a key unique in
    this result). Of equal texts the one with the most code points stays, then
    the smallest doc_id, then the first row.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = with_row_id(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), scratch,
                       ["doc_id", "text"], "row")
    return decisions(rows, scratch, "row")


def decisions(rows: DataFrame, scratch: Scratch, row: str) -> DataFrame:
    """``exact_dedup`` for rows (doc_id, text, row key) already written."""
    norm = without_spaces(F.col("text"))
    keyed = rows.select(
        F.col(row).alias("row"), "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
        F.sha2(norm.cast("binary"), 256).alias("text_sha256"), norm.cast("binary").alias("key"))
    classes = radix_classes(keyed, scratch, "row", "key")
    stays = F.max_by(F.struct("doc_id", "row"), F.struct(
        "n_chars", F.col("doc_id").isNotNull(), -F.coalesce("doc_id", F.lit(0)), -F.col("row")))
    best = scratch.write(
        classes.where(~F.col("alone")).groupBy("class")
        .agg(stays.alias("best"), F.count(F.lit(1)).alias("group_size")), "best")
    shared = classes.where(~F.col("alone")).join(best, "class").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "row")
    single = classes.where(F.col("alone")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", "row")
    return single.unionByName(shared)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay, one of each class of equal texts."""
    scratch = Scratch(docs.sparkSession, "drop-copies")
    row = free_name(docs, "row_key")
    rows = with_row_id(docs, scratch, docs.columns, row)
    kept = decisions(rows.select("doc_id", "text", row), scratch, row).where("kept").select(F.col("row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)
