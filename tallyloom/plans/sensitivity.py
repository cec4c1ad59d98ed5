"""Product sensitivity to discount levels.

For each chosen SKU: daily quantity on days with promoted lines (per discount
bucket and overall) divided by daily quantity on days with rule-free lines.
A line is "rule-free" when its parsed rule list is empty; a promoted line's
bucket comes from the highest discount among its rules (unknown rule = 0).

Plan (one linear pass over the lines): lines are reduced to one row per
(SKU, day, rule text) — map-side combined — and only those rows are expanded
into their parsed rules, looked up (default discount 0) and reduced to the
highest discount, which gives each row its kind (rule-free or a bucket).
Conditional sums per (SKU, day) and then per SKU yield, in one row per SKU,
the baseline and every bucket's quantity and day count; that row is stacked
into the six output rows, so absent buckets are filled without a join and
per-SKU work is bounded by the calendar, not by the SKU's line count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import BUCKET_ORDER, OVERALL, discount_bucket, parse_rule_ids
from ..operators.joins import lookup_join
from ..operators.stats import five_number_summary

BASELINE = "__baseline__"


def rule_discount_lookup(promotions: DataFrame) -> DataFrame:
    """rule_id -> discount (NULL discount counts 0)."""
    return promotions.select("rule_id", F.coalesce(F.col("discount_amount").cast("double"),
                                                   F.lit(0.0)).alias("discount"))


def text_max_discount(texts: DataFrame, promotions: DataFrame, text_col: str = "applied_rule_ids") -> DataFrame:
    """Per distinct rule text: highest discount among its parsed rules
    (unknown rule 0); texts without rules are absent."""
    tok = texts.select(text_col, F.explode(parse_rule_ids(text_col)).alias("rule_id"))
    looked = lookup_join(tok, rule_discount_lookup(promotions), "rule_id", {"discount": 0.0})
    return looked.groupBy(text_col).agg(F.max("discount").alias("max_discount"))


def max_rule_discount(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """Lines with ``max_discount`` (0 when the line has no parsed rule) and
    ``has_rules``."""
    texts = sales.select("applied_rule_ids").distinct()
    tmax = text_max_discount(texts, promotions)
    out = sales.join(tmax, "applied_rule_ids", "left")
    return (out.withColumn("max_discount", F.coalesce("max_discount", F.lit(0.0)))
               .withColumn("has_rules", F.size(parse_rule_ids("applied_rule_ids")) > 0))


def _day_text_kinds(sales: DataFrame, promotions: DataFrame) -> DataFrame:
    """(sku, order_date, applied_rule_ids, qty, kind) with one row per
    (SKU, day, rule text)."""
    day_text = sales.groupBy("sku", "order_date", "applied_rule_ids").agg(
        F.sum(F.coalesce(F.col("qty_ordered"), F.lit(0.0))).alias("qty"))
    tok = day_text.select("*", F.explode_outer(parse_rule_ids("applied_rule_ids")).alias("rule_id"))
    looked = lookup_join(tok, rule_discount_lookup(promotions), "rule_id", {"discount": 0.0})
    per = looked.groupBy("sku", "order_date", "applied_rule_ids").agg(
        F.first("qty").alias("qty"), F.max("discount").alias("max_discount"),
        F.count("rule_id").alias("n_rules"))
    kind = F.when(F.col("n_rules") == 0, F.lit(BASELINE)).otherwise(discount_bucket("max_discount"))
    return per.withColumn("kind", kind)


_PROMO_LABELS = BUCKET_ORDER[:-1]


def _col(label: str) -> str:
    return "b%d" % BUCKET_ORDER.index(label)


def sku_sensitivity_row(sales: DataFrame, promotions: DataFrame, products: DataFrame) -> DataFrame:
    """One row per chosen SKU with sales: baseline quantity/days and, per
    bucket and overall, promoted quantity and days."""
    lines = sales.join(products.select("sku"), "sku", "left_semi")
    rows = _day_text_kinds(lines, promotions)
    k, q = F.col("kind"), F.col("qty")
    day_aggs = [F.sum(F.when(k == BASELINE, q)).alias("bq"), F.count(F.when(k == BASELINE, 1)).alias("bn"),
                F.sum(F.when(k != BASELINE, q)).alias("oq"), F.count(F.when(k != BASELINE, 1)).alias("on")]
    for label in _PROMO_LABELS:
        c = _col(label)
        day_aggs += [F.sum(F.when(k == label, q)).alias(c + "q"), F.count(F.when(k == label, 1)).alias(c + "n")]
    daily = rows.groupBy("sku", "order_date").agg(*day_aggs)
    sku_aggs = [F.coalesce(F.sum("bq"), F.lit(0.0)).alias("b_qty"),
                F.count_if(F.col("bn") > 0).alias("baseline_days"),
                F.coalesce(F.sum("oq"), F.lit(0.0)).alias("o_qty"),
                F.count_if(F.col("on") > 0).alias("o_days")]
    for label in _PROMO_LABELS:
        c = _col(label)
        sku_aggs += [F.coalesce(F.sum(c + "q"), F.lit(0.0)).alias(c + "_qty"),
                     F.count_if(F.col(c + "n") > 0).alias(c + "_days")]
    per_sku = daily.groupBy("sku").agg(*sku_aggs)
    bd = F.col("baseline_days")
    return per_sku.withColumn("baseline_qty", F.when(bd > 0, F.col("b_qty") / bd).otherwise(F.lit(0.0)))


def discount_sensitivity(sales: DataFrame, promotions: DataFrame, products: DataFrame) -> DataFrame:
    """Six rows (five buckets and Overall) per chosen SKU that has a positive
    daily baseline: baseline_qty, promo_qty (daily), ratio, day counts.
    Buckets without promoted lines get promo 0 and ratio 1.0."""
    per_sku = sku_sensitivity_row(sales, promotions, products).filter(F.col("baseline_qty") != 0)
    cells = [F.struct(F.lit(label).alias("discount_bucket"), F.col(_col(label) + "_qty").alias("p_qty"),
                      F.col(_col(label) + "_days").alias("promo_days")) for label in _PROMO_LABELS]
    cells.append(F.struct(F.lit(OVERALL).alias("discount_bucket"), F.col("o_qty").alias("p_qty"),
                          F.col("o_days").alias("promo_days")))
    z = per_sku.select("sku", "baseline_qty", "baseline_days", F.explode(F.array(*cells)).alias("c"))
    days = F.col("c.promo_days")
    promo_qty = F.when(days > 0, F.col("c.p_qty") / days).otherwise(F.lit(0.0))
    ratio = F.when(days > 0, promo_qty / F.col("baseline_qty")).otherwise(F.lit(1.0))
    return z.select("sku", F.col("c.discount_bucket").alias("discount_bucket"),
                    F.round("baseline_qty", 6).alias("baseline_qty"),
                    F.round(promo_qty, 6).alias("promo_qty"),
                    F.round(ratio, 6).alias("sensitivity_ratio"),
                    F.col("baseline_days").cast("bigint").alias("baseline_days"),
                    days.cast("bigint").alias("promo_days"))


def promo_only_products(sales: DataFrame, promotions: DataFrame, products: DataFrame) -> DataFrame:
    """Chosen SKUs left out of the sensitivity because their daily baseline
    quantity is 0 (no rule-free line, or rule-free quantity 0)."""
    return (sku_sensitivity_row(sales, promotions, products)
            .filter(F.col("baseline_qty") == 0).select("sku"))


def sensitivity_distribution(sens: DataFrame, clip: float = 10.0) -> DataFrame:
    """Per bucket (display order): box statistics of the ratio capped at ``clip``."""
    order = F.array_position(F.array(*[F.lit(b) for b in BUCKET_ORDER]), F.col("discount_bucket"))
    s = five_number_summary(sens, "discount_bucket", "sensitivity_ratio", clip_upper=clip)
    return s.withColumn("bucket_order", order.cast("int")).orderBy("bucket_order")
