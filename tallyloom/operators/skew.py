"""Joins that stay balanced when one key holds a large share of the rows.

Adaptive execution splits a skewed sort-merge join when both sides are plain
shuffles of their rows. The other side of a join against an aggregate (one row
per key) has no shuffle of its own, so there nothing is split
(``tests/test_skew.py`` shows both cases); ``salted_join`` is for those joins.

- Rows with a null key match nothing: they are dropped from inner and semi joins
  before any shuffle and pass the others beside the join.
- Keys with more than ``1 / (8 x shuffle partitions)`` of the rows are found by
  one count per key, combined before the shuffle; there are at most that many.
- The hot keys' rows on the other side are copied once for each of as many
  salts as there are shuffle partitions, and the hot rows get a salt by their
  hash, so a hot key is joined by all tasks, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> int:
    """Ways to split a hot group: as many as there are shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, key: str, max_hot: int | None = None) -> DataFrame:
    """Non-null keys with more than 1/max_hot of the rows (at most max_hot keys).

    The total is summed from the same per-key counts, whose shuffle is shared.
    """
    counts = df.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter(F.col("_n") * F.lit(max_hot or 8 * spread(df)) > total).select(key)


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner",
                buckets: int | None = None, max_hot: int | None = None) -> DataFrame:
    """``big.join(small, key, how)`` that stays balanced when ``big`` has hot keys.

    ``how`` is one of inner, left, left_semi, left_anti (joins whose result
    rows are driven by ``big``). Lazy: no job runs here.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    ways = buckets or spread(big)
    present = big.where(F.col(key).isNotNull())
    hot = hot_keys(present, key, max_hot).withColumn("_hot", F.lit(True))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(ways))
    marked = present.join(F.broadcast(hot), key, "left").withColumn(  # at most max_hot rows
        "_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0).cast("long"))).drop("_hot")
    other = small.select(key).distinct() if how in ("left_semi", "left_anti") else small
    other = other.where(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))).otherwise(
        F.array(F.lit(0).cast("long")))
    copies = other.withColumn("_salt", F.explode(salts)).drop("_hot")
    joined = marked.join(copies, [key, "_salt"], how).drop("_salt")
    if how in ("inner", "left_semi"):
        return joined
    beside = big.where(F.col(key).isNull())
    if how == "left_anti":
        return joined.unionByName(beside)
    return joined.unionByName(beside, allowMissingColumns=True)
