"""Product counts, product selection and product rotation.

Rotation needs, per SKU, the gaps in days between consecutive lines. Lines are
first reduced to one row per (SKU, day) — a map-side-combined aggregate — and
gaps are taken between consecutive days of a SKU: that window holds at most one
row per calendar day per SKU, however many lines a SKU has. The gap multiset is
the same as the line-level one: the first line of a day carries the gap from
the previous day, the other lines of that day carry 0. Mean and sample
standard deviation of the gaps then follow from exact integer sums; those of the
quantities from each day's count, mean and squared deviations, merged around the
SKU's mean, which stays exact for large quantities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, money_sum
from ..operators.stats import five_number_summary, outlier_rows, relative_size
from ..operators.topk import pick_n


def kpi_products(counts: DataFrame, sales: DataFrame) -> DataFrame:
    """One row: total products (sum over category rows of ``counts``), SKUs
    sold in ``sales``, SKUs in exactly one order, unsold = total - sold.
    Zeros when either input is empty."""
    total = counts.agg(F.coalesce(F.sum("total_products"), F.lit(0)).cast("bigint").alias("t"))
    per_sku = sales.groupBy("sku").agg(F.count_distinct("order_id").alias("n_orders"))
    sold = per_sku.agg(F.count("*").alias("sold"),
                       F.count_if(F.col("n_orders") == 1).alias("single"))
    # Both sides are single-row aggregates: the total is attached as a scalar
    # subquery, no join; it stands in the plan once, as a column.
    row = sold.withColumn("t", total.scalar())
    t, s, one = F.col("t"), F.col("sold"), F.col("single")
    empty = (t.isNull()) | (t == 0) | (s == 0)
    return row.select(
        F.when(empty, F.lit(0)).otherwise(t).cast("bigint").alias("total_products"),
        F.when(empty, F.lit(0)).otherwise(s).cast("bigint").alias("unique_products_sold"),
        F.when(empty, F.lit(0)).otherwise(one).cast("bigint").alias("single_order_products"),
        F.when(empty, F.lit(0)).otherwise(t - s).cast("bigint").alias("products_not_sold"))


def product_revenue(sales: DataFrame, measure: str = "net", key: str = "sku") -> DataFrame:
    """Per item revenue: 'net' = sum of sales_amount (any sign); 'gross' =
    sum of incl-tax totals, only items with a positive sum."""
    items = sales.filter(F.col(key).isNotNull())
    if measure == "net":
        return items.groupBy(key).agg(money_sum("sales_amount").alias("total_revenue"))
    if measure == "gross":
        return (items.groupBy(key).agg(money_sum("base_row_total_incl_tax").alias("total_revenue"))
                     .filter(F.col("total_revenue") > 0))
    raise ValueError(f"unknown measure {measure!r}")


def select_products(sales: DataFrame, n: int, how: str = "top", measure: str = "net",
                    seed: int = 42, key: str = "sku") -> DataFrame:
    """At most n items (SKUs by default) by revenue: top, bottom or random
    (deterministic for a seed)."""
    return pick_n(product_revenue(sales, measure, key), key, "total_revenue", n, how, seed)


def _day_rows(sales: DataFrame) -> DataFrame:
    """One row per (SKU, day) with the line moments rotation needs. As in
    the source, bad or missing quantities and prices count as 0."""
    q = F.coalesce(F.col("qty_ordered").try_cast("double"), F.lit(0.0))
    price = F.coalesce(F.col("base_price").try_cast("double"), F.lit(0.0))
    return sales.groupBy("sku", "order_date").agg(
        F.count("*").alias("line_count"),
        F.avg(q).alias("q_mean"), (F.var_pop(q) * F.count("*")).alias("q_dev"),
        F.sum(F.col("sales_amount").cast(MONEY)).alias("rev"),
        F.sum(price.cast(MONEY)).alias("p_sum"))


def _with_gaps(daily: DataFrame) -> DataFrame:
    w = Window.partitionBy("sku").orderBy("order_date")  # rows per SKU = its sales days
    prev = F.lag("order_date").over(w)
    return (daily.withColumn("_prev", prev)
                 .withColumn("gap_sum", F.coalesce(F.datediff("order_date", "_prev"), F.lit(0)))
                 .withColumn("gap_count", F.col("line_count") - F.when(F.col("_prev").isNull(), 1).otherwise(0))
                 .drop("_prev"))


def sku_days(sales: DataFrame) -> DataFrame:
    """One row per (SKU, day): lines that day and the gap from the SKU's
    previous day. ``gap_sum`` is the sum of the line-level gaps of that day
    (the first line's gap, others 0) and ``gap_count`` the number of lines
    that have a previous line (all but the SKU's very first)."""
    daily = sales.groupBy("sku", "order_date").agg(F.count("*").alias("line_count"))
    return _with_gaps(daily)


def gap_days(sales: DataFrame) -> DataFrame:
    """Gaps between consecutive lines of a SKU, in run-length form per day."""
    return sku_days(sales).select("sku", "order_date", "line_count",
                                  F.col("gap_sum").cast("bigint").alias("gap_sum"),
                                  F.col("gap_count").cast("bigint").alias("gap_count"))


def rotation_metrics(sales: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Per SKU (of ``products`` when given): mean/sd of gap days, mean/sd of
    quantity, both CVs, net revenue, mean price, line count. SKUs with a
    single line drop. CV days = sd/mean if mean > 0 and more than one gap,
    else 0; CV quantity = sd/mean if mean > 0 else 0; one gap gives sd 0.

    One pass over the lines: every statistic is reduced per (SKU, day) first,
    then per SKU (at most one row per calendar day each).
    """
    lines = sales
    if products is not None:
        lines = lines.join(products.select("sku"), "sku", "left_semi")
    whole = Window.partitionBy("sku")
    n_day = F.col("line_count")
    days = (_with_gaps(_day_rows(lines))
            .withColumn("_mean", F.sum(n_day * F.col("q_mean")).over(whole) / F.sum(n_day).over(whole))
            .withColumn("_off", F.col("q_mean") - F.col("_mean")))
    m = days.groupBy("sku").agg(
        F.sum("line_count").alias("order_count"),
        F.sum("gap_sum").cast("bigint").alias("g_sum"),
        F.sum(F.col("gap_sum").cast("bigint") * F.col("gap_sum")).alias("g_sq"),
        F.sum("gap_count").cast("bigint").alias("g_n"),
        F.first("_mean").alias("q_mean"), F.sum(F.col("q_dev") + n_day * F.col("_off") * F.col("_off")).alias("q_dev"),
        F.round(F.sum("rev"), 4).cast("double").alias("total_revenue"),
        F.sum("p_sum").alias("p_sum")).filter(F.col("order_count") > 1)
    n = F.col("g_n").cast("double")
    mean_d = F.col("g_sum") / n
    # sample variance from exact integer sums: (n*sum_sq - sum^2) / (n*(n-1))
    var_d = F.try_divide((F.col("g_n") * F.col("g_sq") - F.col("g_sum") * F.col("g_sum")).cast("double"),
                         (F.col("g_n") * (F.col("g_n") - 1)).cast("double"))
    sd_d = F.when(F.col("g_n") > 1, F.sqrt(var_d)).otherwise(F.lit(0.0))
    cv_d = F.when((mean_d > 0) & (F.col("g_n") > 1), sd_d / mean_d).otherwise(F.lit(0.0))
    avg_q = F.col("q_mean")
    sd_q = F.sqrt(F.col("q_dev") / (F.col("order_count") - 1))  # more than one line each
    cv_q = F.when(avg_q > 0, sd_q / avg_q).otherwise(F.lit(0.0))
    return m.select(
        "sku",
        F.round(mean_d, 6).alias("avg_days_between_orders"),
        F.round(avg_q, 6).alias("avg_quantity_per_order"),
        F.round(sd_d, 6).alias("days_std"),
        F.round(sd_q, 6).alias("quantity_std"),
        F.round(cv_d, 6).alias("days_coefficient_of_variation"),
        F.round(cv_q, 6).alias("quantity_coefficient_of_variation"),
        "total_revenue",
        F.round(F.col("p_sum").cast("double") / F.col("order_count"), 6).alias("base_price"),
        "order_count")


def rotation_variance(metrics: DataFrame, kind: str = "days") -> DataFrame:
    """Add ``coefficient_of_variation`` / ``std_deviation`` of the chosen kind."""
    if kind not in ("days", "quantity"):
        raise ValueError(f"unknown kind {kind!r}")
    return metrics.withColumn("coefficient_of_variation", F.col(f"{kind}_coefficient_of_variation")) \
                  .withColumn("std_deviation", F.col(f"{kind}_std"))


def _long_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.select("sku", F.stack(F.lit(2), F.lit("avg_days_between_orders"), F.col("avg_days_between_orders"),
                                         F.lit("avg_quantity_per_order"), F.col("avg_quantity_per_order"))
                          .alias("metric", "value"))


def rotation_distribution(metrics: DataFrame, min_skus: int = 5) -> DataFrame:
    """Five-number summary, IQR fences and outlier count of mean gap days and
    mean quantity over SKUs; no rows when fewer than ``min_skus`` SKUs."""
    return five_number_summary(_long_metrics(metrics), "metric", "value", min_count=min_skus)


def rotation_outliers(metrics: DataFrame, min_skus: int = 5) -> DataFrame:
    """The SKUs outside the fences of ``rotation_distribution``, with their value."""
    return outlier_rows(_long_metrics(metrics), "metric", "value", min_count=min_skus).select("metric", "sku", "value")


def rotation_bubble(metrics: DataFrame, kind: str = "days", min_skus: int = 5) -> DataFrame:
    """Chart table: x = mean gap, y = mean quantity, size =
    sqrt(price / max price) * 80 + 20, colour = CV of ``kind``; empty when
    fewer than ``min_skus`` SKUs."""
    m = relative_size(rotation_variance(metrics, kind), "base_price", "size_rel")
    enough = metrics.agg(F.count("*") >= min_skus).scalar()
    return (m.filter(enough)
            .select("sku", F.col("avg_days_between_orders").alias("x"),
                    F.col("avg_quantity_per_order").alias("y"),
                    F.round(F.sqrt("size_rel") * 80 + 20, 6).alias("size"),
                    F.col("coefficient_of_variation").alias("color")))
