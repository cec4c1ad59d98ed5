"""Promotion attribution, selection, KPIs and chart tables.

Attribution rule (per order line): parse the rule list, keep the tokens that
name a *used* promotion (``ctb_discount_used > 0``, duplicates kept), and split
the line's net revenue (incl. tax - discount, lines with net <= 0 or bad money
skipped) evenly over them; each matching token also adds 1 line and the line's
quantity to its promotion.

How it is planned: a line's split depends only on its rule text, so lines are
first reduced to one row per (rule text, SKU) with exact sums (map-side
combined, so a hot rule text or SKU never meets in one task). Each of those
rows is expanded into its parsed tokens, tokens of unused promotions are
dropped (semi join), and a window over the (text, SKU) partition — a handful of
rows each, and already the partitioning of the aggregate — counts the matching
tokens. One linear plan: the lines are read once, no Python loop, no per-line
explode of the fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.rules import parse_rule_ids
from ..operators.topk import order_for

ORIGINAL_PRICE = "base_original_price"
PROMO_ATTRS = ("rule_id", "name", "discount_amount", "ctb_discount_used", "ctb_units_used",
               "from_date", "to_date")


def used_promotions(promotions: DataFrame) -> DataFrame:
    return promotions.filter(F.col("ctb_discount_used") > 0)


def net_amount(sales: DataFrame) -> DataFrame:
    net = (F.col("base_row_total_incl_tax").try_cast("double")
           - F.col("base_discount_amount").try_cast("double"))
    return sales.withColumn("_net", net)


def attribution(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Per used promotion with matching lines: revenue share sum (exact
    decimal), line count, quantity, distinct SKUs."""
    lines = net_amount(sales).filter(F.col("_net") > 0)
    per_text_sku = lines.groupBy("applied_rule_ids", "sku").agg(
        F.sum(F.col("_net").cast(MONEY)).alias("s_net"),
        F.sum(F.coalesce(F.col("qty_ordered").try_cast("double"), F.lit(0.0)).cast(MONEY)).alias("s_qty"),
        F.count("*").alias("n_lines"))
    tok = per_text_sku.select("*", F.explode(parse_rule_ids("applied_rule_ids")).alias("rule_id"))
    matched = tok.join(used_promotions(promotions).select("rule_id").distinct(), "rule_id", "left_semi")
    m = F.count("*").over(Window.partitionBy("applied_rule_ids", "sku"))
    joined = matched.withColumn("m", m)
    return joined.groupBy("rule_id").agg(
        F.sum((F.col("s_net") / F.col("m")).cast(MONEY)).alias("revenue_dec"),
        F.sum("n_lines").alias("order_count"),
        F.sum("s_qty").alias("item_dec"),
        F.count_distinct("sku").alias("unique_sku_count"))


def promotion_metrics(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Every used promotion (0 when no line matched) with revenue, line and
    item counts, distinct SKUs, its attributes, duration (+1 day), units per
    day, average price per item and margin (revenue - discount spent);
    ordered by revenue, highest first. The average price is the mean
    ``base_original_price`` over the lines listing the promotion when the lines
    have that column, else revenue per item."""
    base = used_promotions(promotions).select(*PROMO_ATTRS)
    att = attribution(sales, promotions)
    m = base.join(att, "rule_id", "left")
    rev = F.coalesce(F.col("revenue_dec"), F.lit(0).cast(MONEY))
    items = F.coalesce(F.col("item_dec"), F.lit(0).cast(MONEY))
    duration = F.datediff("to_date", "from_date") + 1
    revenue = F.round(rev, 4).cast("double")
    item_count = F.round(items, 4).cast("double")
    metrics = m.select(
        "rule_id",
        revenue.alias("revenue"),
        F.coalesce(F.col("order_count"), F.lit(0)).cast("bigint").alias("order_count"),
        item_count.alias("item_count"),
        F.coalesce(F.col("unique_sku_count"), F.lit(0)).cast("bigint").alias("unique_sku_count"),
        "name", "discount_amount", "ctb_discount_used", "ctb_units_used", "from_date", "to_date",
        duration.alias("duration_days"),
        F.round(F.when(duration > 0, F.col("ctb_units_used") / duration).otherwise(F.lit(0.0)), 6)
         .alias("units_sold_per_day"),
        F.round(revenue / F.when(item_count == 0, F.lit(1.0)).otherwise(item_count), 6)
         .alias("avg_price_per_item"),
        F.round(rev - F.col("ctb_discount_used").cast(MONEY), 4).cast("double").alias("profit_margin"),
    )
    if ORIGINAL_PRICE in sales.columns:
        price = F.coalesce("_price", F.lit(0.0)).alias("avg_price_per_item")
        metrics = metrics.join(_original_prices(sales).withColumnRenamed("avg_price_per_item", "_price"), "rule_id", "left").select(
            *[price if c == "avg_price_per_item" else c for c in metrics.columns])
    return metrics.orderBy(F.col("revenue").desc(), F.col("rule_id"))


def promotion_revenue(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """The attribution core alone: revenue, lines, items and promotion dates."""
    return promotion_metrics(sales, promotions).select(
        "rule_id", "name", "revenue", "order_count", "item_count", "discount_amount",
        "ctb_discount_used", "ctb_units_used", "from_date", "to_date", "duration_days")


def promotion_avg_original_price(sales: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per promotion in ``metrics``: mean ``base_original_price`` over lines
    listing it (every parsed token, duplicates kept; 0 when none), or, when
    the lines carry no such column, revenue / items (items 0 counts as 1)."""
    if ORIGINAL_PRICE not in sales.columns:
        return metrics.select("rule_id", F.round(
            F.col("revenue") / F.when(F.col("item_count") == 0, F.lit(1.0)).otherwise(F.col("item_count")), 6
        ).alias("avg_price_per_item"))
    return (metrics.select("rule_id").join(_original_prices(sales), "rule_id", "left")
                   .withColumn("avg_price_per_item", F.coalesce("avg_price_per_item", F.lit(0.0))))


def _original_prices(sales: DataFrame) -> DataFrame:
    """(rule_id, avg_price_per_item): mean original price of the lines listing each rule."""
    priced = sales.filter(F.col("base_original_price").isNotNull())
    per_text = priced.groupBy("applied_rule_ids").agg(
        F.sum(F.col("base_original_price").cast(MONEY)).alias("s_price"), F.count("*").alias("n"))
    tok = per_text.select("s_price", "n", F.explode(parse_rule_ids("applied_rule_ids")).alias("rule_id"))
    return tok.groupBy("rule_id").agg(
        F.round(F.sum("s_price").cast("double") / F.sum("n"), 6).alias("avg_price_per_item"))


def select_promotions(metrics: DataFrame, n: int, how: str = "top", seed: int = 42) -> DataFrame:
    """Top, lowest (revenue > 0 only; when none is positive, the top ones) or
    random n promotions. Bounded by n rows."""
    if how in ("lowest", "lowest_revenue", "bottom"):
        # positives first (lowest revenue first), then the rest by revenue
        # descending; if the n picked rows hold any positive one, only the
        # positives are kept. The check runs over the n picked rows only.
        pos = F.col("revenue") > 0
        key = [F.when(pos, 0).otherwise(1), F.when(pos, F.col("revenue")).otherwise(-F.col("revenue")),
               F.col("rule_id")]
        picked = metrics.orderBy(*key).limit(int(n))
        any_pos = F.max(pos.cast("int")).over(Window.partitionBy())
        return picked.withColumn("_any", any_pos).filter((F.col("_any") == 0) | pos).drop("_any")
    return metrics.orderBy(*order_for(how, "rule_id", "revenue", seed)).limit(int(n))


def promotion_bubble(data: DataFrame, x_axis: str = "discount_amount", y_axis: str = "ctb_units_used",
                     size_metric: str = "avg_price_per_item") -> DataFrame:
    """Chart table: x, y, size = sqrt(|size metric|) + 20, colour = revenue,
    margin; NULLs become 0."""
    def z(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return data.select("rule_id", "name", z(x_axis).alias("x"), z(y_axis).alias("y"),
                       F.round(F.sqrt(F.abs(z(size_metric))) + 20, 6).alias("size"),
                       z("revenue").alias("color"), z("profit_margin").alias("profit_margin"))


def kpi_promotions(stats: DataFrame, details: DataFrame, label: str,
                   start=None, end=None) -> DataFrame:
    """One row for a period label: promotions overlapping it, how many were
    used (units > 0), externally funded (ctb discount > 0), average and
    maximum clipped duration. ``start``/``end`` restrict the details to one
    year (the combined range uses all details)."""
    d = details
    if start is not None and end is not None:
        d = d.filter((F.col("to_date") >= F.lit(str(start)).cast("date"))
                     & (F.col("from_date") <= F.lit(str(end)).cast("date")))
    # one scalar subquery (a struct of both counts), evaluated once
    counts = d.agg(F.struct(F.count_if(F.col("ctb_units_used") > 0).alias("used"),
                            F.count_if(F.col("ctb_discount_amount") > 0).alias("funded"))).scalar()
    row = stats.filter(F.col("year") == label)
    return row.select(
        F.col("year").alias("label"),
        F.col("promotion_count").alias("total_promotions"),
        counts.getField("used").alias("used_promotions"),
        counts.getField("funded").alias("externally_funded"),
        F.col("average_duration_days").alias("avg_duration_days"),
        F.col("max_duration_days"))
