"""Summary statistics, exact at any number of rows.

Quantiles (linear interpolation) are found by distributed selection
(``exact_quantiles``): no task holds the values of a group. Counts and maxima over a
frame are scalar aggregates; no window spans a whole frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_QS = [0.0, 0.25, 0.5, 0.75, 1.0]
BUCKETS = 256  # that a group's values are counted in


def exact_quantiles(vals: DataFrame, group: str, value: str, qs: Sequence[float], out: str = "quantiles",
                    buckets: int = BUCKETS) -> DataFrame:
    """(group, n, ``out``): per group the number of values and their quantiles ``qs``, linearly interpolated.

    Equal values are counted first, a row each. A sketch of each group proposes
    the edges of ``buckets`` buckets; rows are counted exactly by bucket, and only
    the buckets that hold a wanted rank are ranked, each in a window of its own.
    The edges decide how even the buckets are, not the result. The widest window is
    over a group's buckets; a ranked bucket has about 1/``buckets`` of its values.
    Nulls and NaN are left out.
    """
    v = vals.select(F.col(group), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = v.groupBy(group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    edges = v.groupBy(group).agg(
        F.percentile_approx("_v", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), F.lit(16 * buckets)).alias("_edges"),
        F.count(F.lit(1)).alias("_total"))
    edges = edges.withColumn("_edges", F.array_distinct("_edges"))
    same = lambda a, b: F.col(f"{a}.{group}").eqNullSafe(F.col(f"{b}.{group}"))
    tagged = counted.alias("c").join(edges.alias("e"), same("c", "e")).select(
        "c.*", "_total", F.size(F.filter("_edges", lambda e: e <= F.col("_v"))).alias("_bucket"))
    sizes = tagged.groupBy(group, "_bucket").agg(F.sum("_n").alias("_size"), F.first("_total").alias("_total"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    position = lambda q: (F.col("_total") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(position(q)), F.ceil(position(q))) for q in qs])))
    wanted = (sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
              .withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_size"))))
              .where(F.size("_ranks") > 0).select(group, "_bucket", "_start", "_ranks"))
    inside = Window.partitionBy(group, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (tagged.alias("t").join(wanted.alias("w"), same("t", "w") & (F.col("t._bucket") == F.col("w._bucket")))
             .select(f"t.{group}", "t._bucket", "_v", "_n", "_total", "_start", "_ranks")
             .withColumn("_end", F.col("_start") + F.sum("_n").over(inside))
             .withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_n"))))))
    at = found.groupBy(group).agg(F.first("_total").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def interpolated(q: float) -> Column:
        where = (F.col("n") - 1) * F.lit(float(q))
        low, high = F.floor(where), F.ceil(where)
        a, b = F.element_at("_at", low), F.element_at("_at", high)
        return F.when(low == high, a).otherwise((high - where) * a + (where - low) * b)

    return at.select(group, "n", F.array(*[interpolated(q) for q in qs]).alias(out))


def _values(long: DataFrame, group: str, value: str, clip_upper: float | None) -> DataFrame:
    v = F.col(value)
    if clip_upper is not None:
        v = F.least(v, F.lit(float(clip_upper)))
    return long.withColumn("_v", v.cast("double")).filter(F.col("_v").isNotNull())


def _fences(vals: DataFrame, group: str, min_count: int) -> DataFrame:
    """One row per group of at least ``min_count`` values: quantiles and fences.

    Quantiles interpolate between inputs (fractions .25/.75), so they are kept
    to 9 decimals: rounding them coarser would hit exact ties.
    """
    means = vals.groupBy(group).agg(F.round(F.avg("_v"), 6).alias("mean"))
    quantiles = exact_quantiles(vals, group, "_v", _QS, "_q").filter(F.col("n") >= min_count)
    five = quantiles.join(means, group).select(group, "n", "mean", *[
        F.round(F.col("_q")[i], 9).alias(name) for i, name in enumerate(["min", "q1", "median", "q3", "max"])])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return five.withColumn("lower_fence", F.round(F.col("q1") - reach, 9)).withColumn(
        "upper_fence", F.round(F.col("q3") + reach, 9))


def five_number_summary(long: DataFrame, group: str, value: str, min_count: int = 0,
                        clip_upper: float | None = None) -> DataFrame:
    """Per group: n, mean, min, q1, median, q3, max, 1.5-IQR fences and the
    number of values outside them. Groups with fewer than ``min_count``
    non-null values are dropped. ``clip_upper`` caps values first.
    """
    vals = _values(long, group, value, clip_upper)
    fences = _fences(vals, group, min_count)
    outside = (vals.select(group, "_v").join(fences, group)
               .filter((F.col("_v") < F.col("lower_fence")) | (F.col("_v") > F.col("upper_fence")))
               .groupBy(group).agg(F.count("*").alias("outliers")))
    return fences.join(outside, group, "left").withColumn("outliers", F.coalesce("outliers", F.lit(0)).cast("long"))


def outlier_rows(long: DataFrame, group: str, value: str, min_count: int = 0,
                 clip_upper: float | None = None) -> DataFrame:
    """The rows of ``long`` whose value lies outside its group's fences."""
    vals = _values(long, group, value, clip_upper)
    fences = _fences(vals, group, min_count).select(group, "lower_fence", "upper_fence")
    return vals.join(fences, group).filter(
        (F.col("_v") < F.col("lower_fence")) | (F.col("_v") > F.col("upper_fence"))).select(*long.columns)


def relative_size(df: DataFrame, col: str, out: str) -> DataFrame:
    """``col / max(col)`` over the frame; the max is a scalar subquery."""
    mx = df.agg(F.max(col)).scalar()
    return df.withColumn(out, F.try_divide(F.col(col).cast("double"), mx.cast("double")))


def quantile_cap(df: DataFrame, col: str, q: float = 0.95, ceiling: float = 10.0,
                 out: str | None = None) -> DataFrame:
    """``least(col, min(ceiling, quantile_q(col)))`` — an outlier-robust cap (a scalar of the frame)."""
    cap = cap_value(df, col, q, ceiling).agg(F.max("cap")).scalar()
    return df.withColumn(out or f"{col}_display", F.least(F.col(col).cast("double"), cap))


def cap_value(df: DataFrame, col: str, q: float = 0.95, ceiling: float = 10.0) -> DataFrame:
    """One row, ``cap``: the smaller of the ceiling and the quantile of the column; no row without values."""
    whole = exact_quantiles(df.select(F.lit(0).alias("_all"), F.col(col).alias("_value")), "_all", "_value", [q], "_q")
    return whole.select(F.round(F.least(F.lit(float(ceiling)), F.col("_q")[0]), 9).alias("cap"))
