"""Market-basket rules for chosen items: support, confidence, lift.

N = distinct orders in the filtered lines. For each chosen item a (a bounded
pick of n items), partners b are the other items of the orders containing a;
count(a, b) = orders holding both. Only (chosen, any) pairs are formed, never
all pairs of an order, so the pair rows are bounded by n x (order size) per
order. The top partners per a are ranked in two stages (bucketed by partner
hash, then merged) so a popular item does not rank all its partners in one
task. Direction is flipped to the higher-confidence side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from ..operators.skew import salted_join, spread
from ..operators.stats import quantile_cap
from ..operators.topk import top_k_per_group


def order_items(sales: DataFrame, item: str = "sku") -> DataFrame:
    """Distinct (order_id, item) with non-null item."""
    return sales.filter(F.col(item).isNotNull()).select("order_id", F.col(item).alias("item")).distinct()


def basket_item_support(sales: DataFrame, item: str = "sku", reuse: bool = False) -> DataFrame:
    """Per item: orders containing it and its share of all orders. The
    distinct (order, item) table feeds both the order total and the item
    counts; with ``reuse`` it (two columns) is checkpointed in a job that runs
    here, instead of being rebuilt from the lines twice."""
    oi_all = materialize(sales.select("order_id", F.col(item).alias("item")).distinct(), reuse)
    n_orders = oi_all.select(F.count_distinct("order_id")).scalar()
    oi = oi_all.filter(F.col("item").isNotNull())
    return (oi.groupBy("item").agg(F.count("*").alias("order_count"))
              .withColumn("support", F.round(F.col("order_count") / n_orders, 9))
              .withColumnRenamed("item", item))


def pair_counts(sales: DataFrame, products: DataFrame, item: str = "sku",
                salted: bool = False) -> DataFrame:
    """(a, b, pair_count) for chosen a and every other item b sharing an order.

    ``salted`` spreads orders that hold a large share of the rows
    (``operators.skew.salted_join``): their partner rows are dealt over salts
    and their chosen rows (at most n per order) replicated.
    """
    return _pairs_from(order_items(sales, item), products, item, salted)


def _pairs_from(oi: DataFrame, products: DataFrame, item: str, salted: bool) -> DataFrame:
    chosen = oi.join(products.select(F.col(item).alias("item")), "item", "left_semi").withColumnRenamed("item", "a")
    partners = oi.withColumnRenamed("item", "b")
    if salted:
        joined = salted_join(partners, chosen, "order_id", "inner")
    else:
        joined = chosen.join(partners, "order_id")
    return (joined.filter(F.col("a") != F.col("b"))
                  .groupBy("a", "b").agg(F.count("*").alias("pair_count")))


def top_partners(pairs: DataFrame, k: int = 5, buckets: int | None = None) -> DataFrame:
    """At most k partners per a, most shared orders first, ties by partner key."""
    return top_k_per_group(pairs, ["a"], [F.col("pair_count").desc(), F.col("b").asc()], k,
                           spread_col="b", buckets=buckets or spread(pairs))


def basket_pairs(sales: DataFrame, products: DataFrame, item: str = "sku", partners: int = 5,
                 salted: bool = False, reuse: bool = False) -> DataFrame:
    """Rules for the chosen items, sorted by lift (highest first).

    The distinct (order, item) table feeds the order count, the item counts
    and both sides of the pair join; with ``reuse`` it (two columns) is
    checkpointed in a job that runs here, instead of being rebuilt from the
    lines for each of them. The counts are joined to the top partners, at most
    ``partners`` rows per chosen item, which AQE broadcasts."""
    oi_all = materialize(sales.select("order_id", F.col(item).alias("item")).distinct(), reuse)
    n_orders = oi_all.select(F.count_distinct("order_id")).scalar().cast("double")
    oi = oi_all.filter(F.col("item").isNotNull())
    counts = oi.groupBy("item").agg(F.count("*").alias("cnt"))
    top = top_partners(_pairs_from(oi, products, item, salted), partners)
    ca = counts.select(F.col("item").alias("a"), F.col("cnt").alias("ca"))
    cb = counts.select(F.col("item").alias("b"), F.col("cnt").alias("cb"))
    t = top.join(ca, "a").join(cb, "b")
    support = F.col("pair_count") / n_orders
    conf_ab = F.col("pair_count") / F.col("ca")
    conf_ba = F.col("pair_count") / F.col("cb")
    lift = support / ((F.col("ca") / n_orders) * (F.col("cb") / n_orders))
    keep = conf_ab >= conf_ba
    return t.select(
        F.when(keep, F.col("a")).otherwise(F.col("b")).alias("product_a"),
        F.when(keep, F.col("b")).otherwise(F.col("a")).alias("product_b"),
        F.round(support, 9).alias("support"),
        F.round(F.when(keep, conf_ab).otherwise(conf_ba), 9).alias("confidence"),
        F.round(lift, 6).alias("lift"),
        F.col("pair_count").alias("count"),
        F.when(keep, F.col("ca")).otherwise(F.col("cb")).alias("product_a_count"),
        F.when(keep, F.col("cb")).otherwise(F.col("ca")).alias("product_b_count"),
    ).orderBy(F.col("lift").desc(), "product_a", "product_b")


def basket_lift_display(pairs: DataFrame, min_pairs: int = 3, q: float = 0.95,
                        ceiling: float = 10.0) -> DataFrame:
    """Pairs with ``lift_display`` = lift capped at min(ceiling, q-quantile);
    empty when fewer than ``min_pairs`` pairs. Count and quantile are scalar
    aggregates, so give it stored pairs, or they are computed three times."""
    enough = pairs.agg(F.count("*") >= min_pairs).scalar()
    return quantile_cap(pairs, "lift", q, ceiling, "lift_display").filter(enough)
