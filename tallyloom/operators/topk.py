"""Top-n picks and top-k per group.

``pick_n`` is ``orderBy(...).limit(n)``, which Spark runs as a bounded
per-partition top-n followed by one merge of at most n rows per partition (no
full sort), so the result has a proven size bound of ``n`` rows and may be
broadcast. Every ordering ends on the key, so ties resolve the same way on
any partitioning; "random" is an order on ``md5(key:seed)``, deterministic for
a seed.

``top_k_per_group`` ranks within a group in two stages when asked: first
within (group, hash bucket of a spread column), keeping k per bucket, then
within the group over at most k x buckets rows. A group holding a third of
all rows is ranked by many tasks, not one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOW_ALIASES = {
    "top": "top", "top_revenue": "top", "ascending": "top",
    "bottom": "bottom", "lowest_revenue": "bottom", "least_revenue": "bottom", "descending": "bottom",
    "random": "random",
}


def order_for(how: str, key: str, measure: str, seed: int = 42) -> list[Column]:
    if how not in HOW_ALIASES:
        raise ValueError(f"unknown order {how!r}; known: {sorted(HOW_ALIASES)}")
    h = HOW_ALIASES[how]
    if h == "top":
        return [F.col(measure).desc_nulls_last(), F.col(key).asc()]
    if h == "bottom":
        return [F.col(measure).asc_nulls_last(), F.col(key).asc()]
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))).asc(), F.col(key).asc()]


def pick_n(df: DataFrame, key: str, measure: str, n: int, how: str = "top", seed: int = 42) -> DataFrame:
    """At most ``n`` rows of ``df`` (one row per key): top, bottom or random."""
    return df.orderBy(*order_for(how, key, measure, seed)).limit(int(n))


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], k: int,
                    spread_col: str | None = None, buckets: int = 0,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group (``row_number`` over ``order_cols``).

    ``order_cols`` must be a total order inside a group. With ``spread_col``
    and ``buckets > 1`` the ranking is done in two stages (see module doc).
    """
    out = df
    if spread_col and buckets > 1:
        b = F.pmod(F.xxhash64(F.col(spread_col)), F.lit(buckets))
        w1 = Window.partitionBy(*group_cols, b).orderBy(*order_cols)
        out = out.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k).drop("_r1")
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return out.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
