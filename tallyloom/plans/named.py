"""The named queries of the shop database, as lazy DataFrame plans.

``T`` is the dict of shop tables from ``tallyloom.sources.tables``.
Filters are written on stored columns (dates as ranges) so Catalyst pushes them
into the scans; order-level joins shuffle on the order key once (AQE splits a
skewed order key there); product and rule dimensions are broadcast by AQE when
their measured bytes allow. No function here runs a job.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_name, in_years, month_label, to_date_lit, weekday_rank, year_at_most
from ..functions.money import money_avg, money_sum, ratio
from ..functions.predicates import CHANNEL_PREFIXES, exclude_channels
from ..functions.rules import exact_rule_tokens, parse_rule_ids
from ..operators.joins import range_overlap_join, token_membership_join

# Fixed values of the source schema (defaults, overridable): product
# attribute ids of the category used by the sales fact, the category used by
# the seasonality query, and the brand.
CATEGORY_ATTR = 168
SEASONALITY_ATTR = 80
BRAND_ATTR = 81


def monthly_sales_trend(T: dict[str, DataFrame], state: str = "complete") -> DataFrame:
    """Orders in ``state``: count and paid total per 'yyyy-MM'."""
    o = T["sales_order"].filter(F.col("state") == state)
    return (o.groupBy(month_label("created_at").alias("month"))
             .agg(F.count("entity_id").alias("order_count"),
                  money_sum("base_total_paid").alias("total_revenue"))
             .orderBy("month"))


def sales_by_day_hour(T: dict[str, DataFrame], state: str = "complete") -> DataFrame:
    """Orders by weekday name and hour: count, paid total, mean; Monday first."""
    o = T["sales_order"].filter(F.col("state") == state)
    return (o.groupBy(day_name("created_at").alias("day_of_week"),
                      F.hour("created_at").alias("hour_of_day"))
             .agg(F.count("entity_id").alias("order_count"),
                  money_sum("base_total_paid").alias("total_revenue"),
                  money_avg("base_total_paid").alias("avg_order_value"))
             .orderBy(weekday_rank("day_of_week"), "hour_of_day"))


def campaign_timings(T: dict[str, DataFrame], as_of) -> DataFrame:
    """Promotions with their length in days (open end counts up to ``as_of``)."""
    p = T["promotion"]
    return (p.select("rule_id", F.col("name").alias("campaign_name"), "from_date", "to_date",
                     "discount_amount",
                     F.datediff(F.coalesce("to_date", to_date_lit(as_of)), "from_date").alias("duration_days"),
                     "is_active")
             .orderBy(F.col("from_date").desc()))


PROMOTION_DETAIL_COLS = ("rule_id", "name", "from_date", "to_date", "discount_amount",
                         "ctb_discount_amount", "ctb_units_used", "ctb_limit_units",
                         "ctb_limit_discount", "ctb_discount_used")


def promotion_details(T: dict[str, DataFrame], start, end) -> DataFrame:
    """Promotions overlapping [start, end]; open-ended ones drop (NULL end)."""
    p = T["promotion"]
    return (p.filter((F.col("to_date") >= to_date_lit(start)) & (F.col("from_date") <= to_date_lit(end)))
             .select(*PROMOTION_DETAIL_COLS)
             .orderBy(F.col("from_date").desc()))


def date_ranges(spark, ranges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Small literal frame of labelled ranges: (label, start_date, end_date, ord)."""
    rows, values = [], {}
    for i, (label, start, end) in enumerate(ranges):
        rows.append(f"SELECT :label{i} AS label, :start{i} AS start_date, :end{i} AS end_date, {i + 1} AS ord")
        values |= {f"label{i}": label, f"start{i}": _dt.date.fromisoformat(str(start)), f"end{i}": _dt.date.fromisoformat(str(end))}
    return spark.sql(" UNION ALL ".join(rows), args=values)


def promotion_duration_stats(T: dict[str, DataFrame], ranges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Per labelled range: promotions overlapping it and their clipped length.

    Length = days from max(start, from_date) to min(end, to_date), +1.
    Result column ``year`` holds the range label; rows follow ``ranges`` order.
    """
    spark = T["promotion"].sparkSession
    dr = date_ranges(spark, ranges)
    joined = range_overlap_join(T["promotion"], dr, "from_date", "to_date", "start_date", "end_date")
    clipped = F.datediff(F.least("to_date", "end_date"), F.greatest("from_date", "start_date")) + 1
    return (joined.withColumn("clipped", clipped)
                  .groupBy(F.col("label").alias("year"), "ord")
                  .agg(F.count_distinct("rule_id").alias("promotion_count"),
                       F.round(F.avg("clipped"), 2).alias("average_duration_days"),
                       F.max("clipped").alias("max_duration_days"),
                       F.min("clipped").alias("min_duration_days"))
                  .orderBy("ord").drop("ord"))


def category_seasonality(T: dict[str, DataFrame], attribute_id: int = SEASONALITY_ATTR,
                         store_id: int | None = None, state: str = "complete") -> DataFrame:
    """Per category label and month: distinct orders, units, line revenue.

    Labels are joined without a store filter by default, so a label present
    for k stores multiplies the sums by k (COUNT DISTINCT is unaffected).
    """
    labels = T["attribute_option"]
    if store_id is not None:
        labels = labels.filter(F.col("store_id") == store_id)
    # Product side first: attribute rows and their labels, keyed by product.
    cat = (T["product_attribute_int"].filter(F.col("attribute_id") == attribute_id)
           .join(labels.select(F.col("option_id").alias("value"), F.col("value").alias("category_name")),
                 "value")
           .select(F.col("entity_id").alias("product_id"), "category_name"))
    orders = T["sales_order"].filter(F.col("state") == state).select(
        F.col("entity_id").alias("order_id"), "created_at")
    items = T["sales_item"].select("order_id", "product_id", "qty_ordered", "base_row_total")
    lines = items.join(orders, "order_id").join(cat, "product_id")
    return (lines.groupBy("category_name", month_label("created_at").alias("month"))
                 .agg(F.count_distinct("order_id").alias("order_count"),
                      money_sum("qty_ordered").alias("units_sold"),
                      money_sum("base_row_total").alias("category_revenue"))
                 .orderBy("category_name", "month"))


def promotion_impact(T: dict[str, DataFrame], as_of, match: str = "exact",
                     per_order: bool = False, state: str = "complete") -> DataFrame:
    """Per promotion name: orders, paid, discount, mean discount share, units.

    An order line matches a rule when its rule list holds the rule id
    (``match='exact'``: the literal token, as FIND_IN_SET; ``'parsed'``: the
    cleaned integer list) and the order time lies between the rule's dates
    (open end = ``as_of``). Order-level money is summed once per matching
    (line, rule), as the source query does; ``per_order=True`` counts each
    (order, rule) once instead.
    """
    orders = T["sales_order"].filter(F.col("state") == state).select(
        F.col("entity_id").alias("order_id"), "created_at", "base_total_paid",
        F.col("base_discount_amount").alias("order_discount"), "base_subtotal")
    items = T["sales_item"].select("order_id", "qty_ordered", "applied_rule_ids")
    promos = T["promotion"].select("rule_id", F.col("name").alias("promotion_name"),
                                   "from_date", "to_date")
    lines = items.join(orders, "order_id")
    if match == "exact":
        tokens = exact_rule_tokens("applied_rule_ids")
        matched = token_membership_join(lines, promos, tokens, "rule_id", as_text=True)
    elif match == "parsed":
        tokens = F.array_distinct(parse_rule_ids("applied_rule_ids"))
        matched = token_membership_join(lines, promos, tokens, "rule_id", as_text=False)
    else:
        raise ValueError(f"unknown match {match!r}")
    matched = matched.filter(F.col("created_at").between(
        F.col("from_date"), F.coalesce(F.col("to_date"), to_date_lit(as_of))))
    if per_order:
        matched = (matched.groupBy("order_id", "rule_id", "promotion_name")
                          .agg(F.first("base_total_paid").alias("base_total_paid"),
                               F.first("order_discount").alias("order_discount"),
                               F.first("base_subtotal").alias("base_subtotal"),
                               F.sum("qty_ordered").alias("qty_ordered")))
    return (matched.groupBy("promotion_name")
                   .agg(F.count_distinct("order_id").alias("order_count"),
                        money_sum("base_total_paid").alias("total_revenue"),
                        money_sum("order_discount").alias("total_discount"),
                        F.round(F.avg(ratio(F.col("order_discount"), F.col("base_subtotal"), None)), 6)
                         .alias("avg_discount_percentage"),
                        money_sum("qty_ordered").alias("units_sold"))
                   .orderBy(F.col("total_revenue").desc()))


def _lines_of(T: dict[str, DataFrame], products: DataFrame) -> DataFrame:
    """(order_id, product_id) of the lines of ``products``: other products' lines
    drop before the order join."""
    return T["sales_item"].select("order_id", "product_id").join(
        products.select("product_id"), "product_id", "left_semi")


def _sold_in(T: dict[str, DataFrame], products: DataFrame, years: Iterable[int],
             channel_prefixes: Iterable[str]) -> DataFrame:
    """Distinct orders per product of ``products`` among kept orders in ``years``.

    The products' lines are joined with the (year-pruned) orders, then distinct
    (product, order) counted per product.
    """
    orders = (T["sales_order"]
              .filter(exclude_channels("increment_id", channel_prefixes) & in_years("created_at", years))
              .select(F.col("entity_id").alias("order_id")))
    return (_lines_of(T, products).join(orders, "order_id")
                 .groupBy("product_id")
                 .agg(F.count_distinct("order_id").alias("order_count")))


def _products_existing(T: dict[str, DataFrame], category_ids: Iterable[int], year: int,
                       attr: int) -> DataFrame:
    """(category_num, product_id), each once: counts of its rows are distinct counts of products."""
    cats = (T["product_attribute_int"]
            .filter((F.col("attribute_id") == attr) & F.col("value").isin(list(category_ids)))
            .where(F.col("entity_id").isNotNull())
            .select(F.col("value").alias("category_num"), F.col("entity_id").alias("product_id")).distinct())
    existing = T["product"].filter(year_at_most("created_at", year)).select(
        F.col("entity_id").alias("product_id"))
    return cats.join(existing, "product_id", "left_semi")


def product_counts_year(T: dict[str, DataFrame], year: int, category_ids: Iterable[int],
                        channel_prefixes: Iterable[str] = CHANNEL_PREFIXES,
                        attr: int = CATEGORY_ATTR) -> DataFrame:
    """Per category: products existing by ``year``, sold that year, sold in
    exactly one order, unsold."""
    base = _products_existing(T, category_ids, year, attr)
    per_product = (base.join(_sold_in(T, base, [year], channel_prefixes), "product_id", "left")
                       .withColumn("order_count", F.coalesce("order_count", F.lit(0))))
    n = F.col("order_count")
    return per_product.groupBy("category_num").agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(n > 0).alias("sold_products"),
        F.count_if(n == 1).alias("single_order_products"),
        F.count_if(n == 0).alias("unsold_products"))


def product_counts_cross_year(T: dict[str, DataFrame], years: Iterable[int], category_ids: Iterable[int],
                              channel_prefixes: Iterable[str] = CHANNEL_PREFIXES,
                              attr: int = CATEGORY_ATTR) -> DataFrame:
    """Per category over several years: sold in more than one order, in
    exactly one, never (orders summed over the years)."""
    years = list(years)
    base = _products_existing(T, category_ids, max(years), attr)
    # Per-year distinct-order counts, then summed per product (the source's
    # two-level aggregate); an order has one year, so this equals the count
    # of distinct orders over all the years.
    orders = (T["sales_order"]
              .filter(exclude_channels("increment_id", channel_prefixes) & in_years("created_at", years))
              .select(F.col("entity_id").alias("order_id"), F.year("created_at").alias("sales_year")))
    per_year = (_lines_of(T, base).join(orders, "order_id")
                .groupBy("product_id", "sales_year")
                .agg(F.count_distinct("order_id").alias("order_count")))
    per_product = per_year.groupBy("product_id").agg(F.sum("order_count").alias("total_orders"))
    joined = (base.join(per_product, "product_id", "left")
                  .withColumn("total_orders", F.coalesce("total_orders", F.lit(0))))
    n = F.col("total_orders")
    return joined.groupBy("category_num").agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(n > 1).alias("multiple_order_products"),
        F.count_if(n == 1).alias("single_order_products"),
        F.count_if(n == 0).alias("unsold_products"))
