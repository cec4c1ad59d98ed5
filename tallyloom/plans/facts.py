"""The item-sales fact and the filters every page applies to it.

The fact is one row per order line of the chosen categories, with the order's
date and customer fields and the product's brand. It is built product side
first (attributes, labels, brand are all keyed by product id, so they share
one partitioning), then joined to the lines on product id and to the kept
orders on order id.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import in_years, year_ranges
from ..operators.materialize import materialize
from ..operators.skew import salted_join
from ..functions.predicates import (CHANNEL_PREFIXES, REGISTERED_GROUPS, exclude_channels,
                                    is_guest, is_registered)
from .named import BRAND_ATTR, CATEGORY_ATTR

FACT_COLS = ("sku", "category_num", "item_id", "order_id", "order_date", "qty_ordered",
             "base_price", "base_discount_amount", "base_row_total_incl_tax", "applied_rule_ids",
             "customer_is_guest", "customer_group_id", "hashed_customer_email", "brand_id")
BASIC_COLS = FACT_COLS[:10]


def item_sales_fact(T: dict[str, DataFrame], category_ids: Iterable[int], salt: str,
                    detail: str = "full", category_attr: int = CATEGORY_ATTR,
                    brand_attr: int = BRAND_ATTR,
                    channel_prefixes: Iterable[str] = CHANNEL_PREFIXES,
                    label_store: int = 0, years: Iterable[int] | None = None) -> DataFrame:
    """Order lines of ``category_ids`` with customer flags, salted e-mail
    hash (NULL e-mail gives NULL) and brand; marketplace orders removed.

    ``years`` optionally keeps only orders placed in those years, written as
    ranges on the stored order timestamp so the predicate reaches the order
    table's scan (row-group / partition pruning); the page filter
    ``filter_years`` on ``order_date`` then selects the same rows.

    The joins are left to AQE: the product side (products of the chosen
    categories with label and brand) is broadcast when its measured bytes allow,
    else best sellers are split as skewed partitions. No job runs here.

    ``detail='basic'``: the shorter projection without customer and brand
    columns, dated by the line's own timestamp when the line table has one
    (else by its order's).
    """
    attrs = T["product_attribute_int"]
    cat = (attrs.filter((F.col("attribute_id") == category_attr)
                        & F.col("value").isin(list(category_ids)))
                .select(F.col("entity_id").alias("product_id"), F.col("value").alias("category_num")))
    labels = (T["attribute_option"].filter(F.col("store_id") == label_store)
              .select(F.col("option_id").alias("category_num")))
    products = T["product"].select(F.col("entity_id").alias("product_id"))
    dims = products.join(cat, "product_id").join(labels, "category_num")
    if detail == "full":
        brand = (attrs.filter(F.col("attribute_id") == brand_attr)
                      .select(F.col("entity_id").alias("product_id"), F.col("value").alias("brand_id")))
        dims = dims.join(brand, "product_id", "left")

    items = T["sales_item"]
    line_ts = "created_at" in items.columns
    item_cols = ["sku", "item_id", "order_id", "product_id", "qty_ordered", "base_price",
                 "base_discount_amount", "base_row_total_incl_tax", "applied_rule_ids"]
    if line_ts and detail != "full":
        item_cols.append(F.col("created_at").alias("line_created_at"))
    lines = items.select(*item_cols).join(dims, "product_id")

    orders = T["sales_order"].filter(exclude_channels("increment_id", channel_prefixes))
    if years:
        orders = orders.filter(created_in_years("created_at", years))
    if detail == "full":
        orders = orders.select(F.col("entity_id").alias("order_id"), "created_at",
                               "customer_is_guest", "customer_group_id", "customer_email")
        fact = lines.join(orders, "order_id")
        return fact.select(
            "sku", "category_num", "item_id", "order_id",
            F.to_date("created_at").alias("order_date"),
            "qty_ordered", "base_price", "base_discount_amount", "base_row_total_incl_tax",
            "applied_rule_ids", "customer_is_guest", "customer_group_id",
            F.sha2(F.concat(F.col("customer_email"), F.lit(salt)), 256).alias("hashed_customer_email"),
            "brand_id")
    if detail != "basic":
        raise ValueError(f"unknown detail {detail!r}")
    orders = orders.select(F.col("entity_id").alias("order_id"), "created_at")
    fact = lines.join(orders, "order_id")
    ts = F.col("line_created_at") if line_ts else F.col("created_at")
    return fact.select("sku", "category_num", "item_id", "order_id", F.to_date(ts).alias("order_date"),
                       "qty_ordered", "base_price", "base_discount_amount",
                       "base_row_total_incl_tax", "applied_rule_ids")


def created_in_years(col: str, years: Iterable[int]):
    """Timestamp ranges [Jan 1, Jan 1 next) for the years, pushable to scans."""
    pred = None
    for lo, hi in year_ranges(years):
        p = ((F.col(col) >= F.lit(f"{lo} 00:00:00").cast("timestamp_ntz"))
             & (F.col(col) < F.lit(f"{hi} 00:00:00").cast("timestamp_ntz")))
        pred = p if pred is None else (pred | p)
    return pred


NUMERIC_COLS = ("base_row_total_incl_tax", "base_discount_amount", "qty_ordered", "base_price")


def normalise_lines(fact: DataFrame) -> DataFrame:
    """Date as DATE; money and quantity as DOUBLE with bad or NULL values 0;
    ``sales_amount = incl_tax - discount`` added only when absent."""
    out = fact
    if "order_date" in out.columns:
        out = out.withColumn("order_date", F.to_date("order_date"))
    for c in NUMERIC_COLS:
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    if "sales_amount" not in out.columns:
        out = out.withColumn("sales_amount",
                             F.col("base_row_total_incl_tax") - F.col("base_discount_amount"))
    return out


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` when it has every column in ``names``, else an empty frame of the
    same schema (schema check only, no job runs)."""
    missing = [n for n in names if n not in df.columns]
    return df if not missing else df.where(F.lit(False))


def filter_years(df: DataFrame, years: Iterable[int] | None, col: str = "order_date") -> DataFrame:
    if not years:
        return df
    return df.filter(in_years(col, years))


def filter_categories(df: DataFrame, categories: Iterable[int] | None) -> DataFrame:
    if not categories:
        return df
    return df.filter(F.col("category_num").isin(list(categories)))


def filter_discount_free(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Only lines without discount (``base_discount_amount == 0``)."""
    return df.filter(F.col("base_discount_amount") == 0) if enabled else df


def filter_customer_type(df: DataFrame, customer_types: Sequence[str] | None,
                         registered_groups: Iterable[int] = REGISTERED_GROUPS) -> DataFrame:
    """None: no filter. Both 'Guest' and 'Registered': all rows. 'Guest':
    guest orders. 'Registered': orders of the registered groups. Anything else
    (including an empty list): no rows."""
    if customer_types is None:
        return df
    types = set(customer_types)
    if {"Guest", "Registered"} <= types:
        return df
    if "Guest" in types:
        return df.filter(is_guest("customer_is_guest"))
    if "Registered" in types:
        return df.filter(is_registered("customer_group_id", registered_groups))
    return df.where(F.lit(False))


def customer_order_counts(df: DataFrame, email: str = "hashed_customer_email") -> DataFrame:
    """Distinct orders per (non-null) customer e-mail hash, with its status.

    The distinct count is planned as a two-step aggregate (email, order) ->
    email with map-side combine, so a customer with very many rows does not
    gather them in one task.
    """
    return (df.filter(F.col(email).isNotNull())
              .groupBy(email)
              .agg(F.count_distinct("order_id").alias("unique_order_count"))
              .withColumn("customer_status",
                          F.when(F.col("unique_order_count") == 1, F.lit("New")).otherwise(F.lit("Returning"))))


def filter_customer_status(df: DataFrame, customer_status: Sequence[str] | None,
                           email: str = "hashed_customer_email", reuse: bool = False) -> DataFrame:
    """New = exactly one distinct order among the current rows, Returning =
    more than one. None, empty or both: no filter. NULL e-mails drop when the
    filter applies. Must run after the other filters (it reads their result).

    The rows are read twice (to count orders per e-mail, then to keep the
    matching rows). With ``reuse`` they are checkpointed first, in a job that
    runs here; select the columns that are needed before."""
    if not customer_status:
        return df
    wanted = set(customer_status)
    if {"New", "Returning"} <= wanted:
        return df
    if "New" in wanted:
        keep = F.col("unique_order_count") == 1
    elif "Returning" in wanted:
        keep = F.col("unique_order_count") > 1
    else:
        return df.where(F.lit(False))
    df = materialize(df, reuse)
    keys = customer_order_counts(df, email).filter(keep).select(email)
    # The keys are an aggregate, which AQE doesn't split a join against: an
    # e-mail with a large share of the rows (a placeholder address) is salted.
    return salted_join(df, keys, email, "left_semi")


def add_sales_amount(df: DataFrame) -> DataFrame:
    if "sales_amount" in df.columns:
        return df
    return df.withColumn("sales_amount", F.col("base_row_total_incl_tax") - F.col("base_discount_amount"))


def apply_filters(fact: DataFrame, categories: Iterable[int] | None = None, discount_free: bool = False,
                  years: Iterable[int] | None = None, customer_types: Sequence[str] | None = None,
                  customer_status: Sequence[str] | None = None,
                  registered_groups: Iterable[int] = REGISTERED_GROUPS, reuse: bool = False) -> DataFrame:
    """All page filters in their fixed order: category, discount, year,
    customer type, then New/Returning (which depends on the rows left)."""
    out = filter_categories(fact, categories)
    out = filter_discount_free(out, discount_free)
    out = filter_years(out, years)
    out = add_sales_amount(out)
    out = filter_customer_type(out, customer_types, registered_groups)
    return filter_customer_status(out, customer_status, reuse=reuse)


def filter_flags(sales: DataFrame, registered_groups: Iterable[int] = REGISTERED_GROUPS,
                 email: str = "hashed_customer_email") -> DataFrame:
    """One row describing what the lines contain: whether any line has a
    discount, any guest / registered order, any New / Returning customer,
    and the distinct years and categories (bounded by the calendar and the
    category list). Useful to key stored results by the filters in effect."""
    counts = customer_order_counts(sales, email)
    status = counts.agg(F.coalesce(F.bool_or(F.col("unique_order_count") == 1), F.lit(False)).alias("n"),
                        F.coalesce(F.bool_or(F.col("unique_order_count") > 1), F.lit(False)).alias("r"))
    return sales.agg(
        F.array_sort(F.collect_set(F.year("order_date"))).alias("years"),
        F.array_sort(F.collect_set("category_num")).alias("category_ids"),
        (~F.coalesce(F.every(F.col("base_discount_amount") == 0), F.lit(True))).alias("include_discounts"),
        F.coalesce(F.bool_or(F.col("customer_is_guest") == 1), F.lit(False)).alias("has_guest"),
        F.coalesce(F.bool_or(F.col("customer_group_id").isin(list(registered_groups))), F.lit(False))
         .alias("has_registered"),
    ).select("*", status.select("n").scalar().alias("has_new"), status.select("r").scalar().alias("has_returning"))
