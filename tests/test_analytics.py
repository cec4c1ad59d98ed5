"""Hand-sized frames for attribution, rotation, basket, sensitivity, plus
invariants; expected values are worked out by hand (SURVEY §2.9)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import basket, promotions, products, sensitivity

D = dt.date

SALES_SCHEMA = ("order_id long, item_id long, sku string, order_date date, qty_ordered double, "
                "base_price double, base_row_total_incl_tax double, base_discount_amount double, "
                "applied_rule_ids string")
PROMO_SCHEMA = ("rule_id long, name string, discount_amount double, ctb_discount_used double, "
                "ctb_units_used long, from_date date, to_date date")


# ------------------------------------------------------------ attribution
SALES_ROWS = [
    (1, 11, "A", D(2000, 1, 1), 2.0, 5.0, 110.0, 10.0, "1,2"),      # two rules split 100
    (1, 12, "B", D(2000, 1, 1), 1.0, 5.0, 50.0, 0.0, "1,c-1"),      # duplicate rule: both shares to 1
    (2, 21, "A", D(2000, 1, 2), 3.0, 5.0, 20.0, 20.0, "1"),         # net 0: skipped
    (2, 22, "C", D(2000, 1, 2), 1.0, 5.0, 30.0, None, "2"),         # bad money: skipped
    (3, 31, "C", D(2000, 1, 3), 4.0, 5.0, 40.0, 0.0, "3,x"),        # rule 3 is unused
    (3, 32, None, D(2000, 1, 3), 1.0, 5.0, 8.0, 0.0, "2"),          # null sku: counted, no SKU
    (4, 41, "A", D(2000, 1, 4), 1.0, 5.0, 9.0, 0.0, None),          # no rules
]
PROMO_ROWS = [
    (1, "one", 10.0, 5.0, 20, D(2000, 1, 1), D(2000, 1, 10)),
    (2, "two", 20.0, 1.0, 0, D(2000, 1, 1), None),                  # open end
    (3, "three", 30.0, 0.0, 5, D(2000, 1, 1), D(2000, 1, 2)),       # not used
    (4, "four", 35.0, 2.0, 7, D(2000, 1, 1), D(2000, 1, 1)),        # used, never sold
]


# rule 1: 100 / 2 from line 11, all 50 of line 12 (named twice, so two lines and both halves);
# rule 2: 100 / 2 from line 11, 8 from line 32 (no SKU); rule 4: never sold. Items: line
# quantities, line 12 twice.
ATTRIBUTED = {1: (100.0, 3, 4.0, 2), 2: (58.0, 2, 3.0, 1), 4: (0.0, 0, 0.0, 0)}


def test_promotion_metrics_by_hand(spark):
    s = spark.createDataFrame(SALES_ROWS, SALES_SCHEMA)
    p = spark.createDataFrame(PROMO_ROWS, PROMO_SCHEMA)
    got = {r.rule_id: r for r in promotions.promotion_metrics(s, p).collect()}
    assert {k: (r.revenue, r.order_count, r.item_count, r.unique_sku_count) for k, r in got.items()} == ATTRIBUTED
    assert got[2].duration_days is None and got[2].units_sold_per_day == 0.0
    assert got[1].duration_days == 10 and got[1].units_sold_per_day == 2.0
    assert got[4].revenue == 0.0 and got[4].avg_price_per_item == 0.0
    assert got[1].profit_margin == round(got[1].revenue - 5.0, 4)


def test_attributed_revenue_sums_to_eligible_net(spark):
    s = spark.createDataFrame(SALES_ROWS, SALES_SCHEMA)
    p = spark.createDataFrame(PROMO_ROWS, PROMO_SCHEMA)
    total = sum(r.revenue for r in promotions.promotion_metrics(s, p).collect())
    assert total == pytest.approx(100.0 + 50.0 + 8.0, abs=1e-6)  # lines 11, 12 and 32


def test_original_price_gives_the_average_price(spark):
    s = spark.createDataFrame(SALES_ROWS, SALES_SCHEMA).withColumn("base_original_price", F.when(F.col("item_id") != 22, 90.0 + F.col("item_id")))
    p = spark.createDataFrame(PROMO_ROWS, PROMO_SCHEMA)
    m = promotions.promotion_metrics(s, p)
    got = {r.rule_id: r.avg_price_per_item for r in m.collect()}
    # rule 1 is listed by line 11, twice by 12 and by 21 (its zero net does not matter here); rule 2 by 11 and 32
    assert got == {1: (101 + 102 + 102 + 111) / 4, 2: (101 + 122) / 2, 4: 0.0}
    size = {r.rule_id: r["size"] for r in promotions.promotion_bubble(m).collect()}
    assert size[1] == round(math.sqrt(104.0) + 20, 6)


def test_select_promotions_lowest_falls_back_to_top(spark):
    m = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, -1.0)], "rule_id long, revenue double")
    got = [r.rule_id for r in promotions.select_promotions(m, 2, "lowest").collect()]
    assert got == [1, 2]
    m2 = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 0.0)], "rule_id long, revenue double")
    assert [r.rule_id for r in promotions.select_promotions(m2, 5, "lowest").collect()] == [2, 1]


# ------------------------------------------------------------ rotation
ROT_ROWS = [
    (1, 1, "ONE", D(2000, 1, 1), 1.0, 2.0, 10.0, 0.0, None),          # one line: dropped
    (1, 2, "TWO", D(2000, 1, 1), 2.0, 2.0, 10.0, 0.0, None),
    (2, 3, "TWO", D(2000, 1, 11), 4.0, 4.0, 10.0, 0.0, None),         # one gap of 10: sd 0, CV 0
    (1, 4, "SAME", D(2000, 1, 1), 1.0, 1.0, 5.0, 0.0, None),
    (2, 5, "SAME", D(2000, 1, 1), 3.0, 1.0, 5.0, 0.0, None),          # same day: gap 0
    (3, 6, "SAME", D(2000, 1, 4), 0.0, 1.0, 5.0, 0.0, None),          # zero quantity
    (4, 7, "SAME", D(2000, 1, 10), 2.0, 1.0, 5.0, 0.0, None),
    (5, 8, "ZERO", D(2000, 2, 1), 0.0, 1.0, 5.0, 0.0, None),
    (6, 9, "ZERO", D(2000, 2, 1), 0.0, 1.0, 5.0, 0.0, None),          # all gaps 0, qty mean 0
    (7, 10, "NULLQ", D(2000, 3, 1), None, 1.0, 5.0, 0.0, None),       # missing quantity counts 0
    (8, 11, "NULLQ", D(2000, 3, 5), 4.0, 1.0, 5.0, 0.0, None),
]


# mean gap, mean quantity, sd of gaps, sd of quantity, both CVs
ROTATION = {
    "TWO": (10.0, 3.0, 0.0, math.sqrt(2), 0.0, math.sqrt(2) / 3),
    "SAME": (3.0, 1.5, 3.0, math.sqrt(5 / 3), 1.0, math.sqrt(5 / 3) / 1.5),   # gaps 0, 3, 6; quantities 1, 3, 0, 2
    "ZERO": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "NULLQ": (4.0, 2.0, 0.0, math.sqrt(8), 0.0, math.sqrt(2)),               # quantities 0, 4
}


def _rotation(spark, rows):
    s = spark.createDataFrame(rows, SALES_SCHEMA).withColumn(
        "sales_amount", F.col("base_row_total_incl_tax") - F.col("base_discount_amount"))
    return {r.sku: (r.avg_days_between_orders, r.avg_quantity_per_order, r.days_std, r.quantity_std,
                    r.days_coefficient_of_variation, r.quantity_coefficient_of_variation)
            for r in products.rotation_metrics(s).collect()}


def test_rotation_by_hand(spark):
    got = _rotation(spark, ROT_ROWS)
    assert set(got) == set(ROTATION)
    for sku, want in ROTATION.items():
        assert got[sku] == pytest.approx(want, abs=1e-6), sku


def test_rotation_deviation_of_large_quantities(spark):
    rows = [(i, i, "BIG", D(2000, 1, 1 + i // 2), 1e9 + i, 2.0, 10.0, 0.0, None) for i in range(1, 4)]
    assert _rotation(spark, rows)["BIG"][3] == 1.0
    lines = spark.createDataFrame(rows, SALES_SCHEMA)
    assert lines.select(F.stddev_samp("qty_ordered")).first()[0] == 1.0


def test_rotation_outliers_name_the_sku(spark):
    rows = [(f"S{i}", 5.0 + i % 3, 2.0) for i in range(20)] + [("FAR", 90.0, 2.0)]
    m = spark.createDataFrame(rows, "sku string, avg_days_between_orders double, avg_quantity_per_order double")
    assert [tuple(r) for r in products.rotation_outliers(m).collect()] == [("avg_days_between_orders", "FAR", 90.0)]
    box = {r.metric: r.outliers for r in products.rotation_distribution(m).collect()}
    assert box == {"avg_days_between_orders": 1, "avg_quantity_per_order": 0}


# ------------------------------------------------------------ basket
# Seven orders; A is in 4, B in 4, C in 3, D in 2, E in 2, F and G in 1. Partners of A: B and C in
# two orders, D in one. Partners of B, the first five: A and C in two, D, E and F in one (G is cut).
# The product of the smaller count comes first; lift is both * 7 / (count of one * count of other).
BASKET = [
    ("A", "B", 2, 0.5, 0.875), ("B", "A", 2, 0.5, 0.875), ("C", "A", 2, 0.666666667, 1.166667),
    ("C", "B", 2, 0.666666667, 1.166667), ("D", "A", 1, 0.5, 0.875), ("D", "B", 1, 0.5, 0.875),
    ("E", "B", 1, 0.5, 0.875), ("F", "B", 1, 1.0, 1.75),
]


def test_basket_by_hand(spark):
    oi = [(1, "A"), (1, "B"), (1, "C"), (2, "A"), (2, "B"), (3, "A"), (3, "D"), (4, "B"), (5, "E"),
          (6, "A"), (6, "C"), (7, "B"), (7, "C"), (7, "D"), (7, "E"), (7, "F"), (7, "G")]
    s = spark.createDataFrame(oi, "order_id long, sku string")
    chosen = spark.createDataFrame([("A",), ("B",)], "sku string")
    pairs = lambda **how: sorted((r.product_a, r.product_b, r["count"], r.confidence, r.lift)
                                 for r in basket.basket_pairs(s, chosen, **how).collect())
    assert pairs() == pairs(salted=True) == pairs(reuse=True) == BASKET


def test_top_partners_two_stage_equals_single_stage(spark):
    rows = [("a", f"b{i:03d}", (i * 7) % 11) for i in range(200)]
    pairs = spark.createDataFrame(rows, "a string, b string, pair_count long")
    two = sorted(tuple(r) for r in basket.top_partners(pairs, 5, buckets=8).collect())
    one = sorted(tuple(r) for r in basket.top_partners(pairs, 5, buckets=1).collect())
    assert two == one and len(two) == 5


# ------------------------------------------------------------ sensitivity
def test_sensitivity_rules(spark):
    rows = [
        # sku P: baseline 2 days (qty 2+4), promoted at 15 % and 30 %, unknown rule (0 %)
        (1, 1, "P", D(2000, 1, 1), 2.0, 1.0, 10.0, 0.0, None),
        (2, 2, "P", D(2000, 1, 2), 4.0, 1.0, 10.0, 0.0, ""),
        (3, 3, "P", D(2000, 1, 3), 6.0, 1.0, 10.0, 0.0, "1"),      # 15 -> ≤15%
        (4, 4, "P", D(2000, 1, 3), 3.0, 1.0, 10.0, 0.0, "99"),     # unknown rule -> 0 -> ≤15%
        (5, 5, "P", D(2000, 1, 4), 9.0, 1.0, 10.0, 0.0, "1,4"),    # max(15, 30) -> 30%
        # sku Q: promo only
        (6, 6, "Q", D(2000, 1, 1), 1.0, 1.0, 10.0, 0.0, "1"),
        # sku R: baseline only
        (7, 7, "R", D(2000, 1, 1), 5.0, 1.0, 10.0, 0.0, None),
    ]
    promos = [(1, "p1", 15.0, 1.0, 1, D(2000, 1, 1), None), (4, "p4", 30.0, 1.0, 1, D(2000, 1, 1), None)]
    s = spark.createDataFrame(rows, SALES_SCHEMA)
    p = spark.createDataFrame(promos, PROMO_SCHEMA)
    chosen = spark.createDataFrame([("P",), ("Q",), ("R",)], "sku string")
    got = {(r.sku, r.discount_bucket): r for r in sensitivity.discount_sensitivity(s, p, chosen).collect()}
    assert {k[0] for k in got} == {"P", "R"}
    assert len(got) == 12  # six rows per kept SKU
    base = 3.0  # (2 + 4) / 2 days
    assert got[("P", "≤15%")].promo_qty == 9.0 and got[("P", "≤15%")].sensitivity_ratio == 3.0
    assert got[("P", "30%")].promo_qty == 9.0 and got[("P", "30%")].promo_days == 1
    assert got[("P", "Overall")].promo_qty == 9.0 and got[("P", "Overall")].promo_days == 2
    assert got[("P", "20%")].sensitivity_ratio == 1.0 and got[("P", "20%")].promo_days == 0
    assert all(r.baseline_qty == base for (k, _), r in got.items() if k == "P")
    assert got[("R", "Overall")].sensitivity_ratio == 1.0
    only = [r.sku for r in sensitivity.promo_only_products(s, p, chosen).collect()]
    assert only == ["Q"]


# ------------------------------------------------------------ determinism
def test_same_rows_at_1_and_16_partitions(spark, tables):
    from tallyloom.plans import facts
    key = lambda rows: sorted(tuple(r) for r in rows)
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        s = facts.apply_filters(facts.item_sales_fact(tables, [601, 602], "s"), years=[1999, 2000])
        out.append(key(promotions.promotion_metrics(s, tables["promotion"]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert out[0] == out[1]


# ------------------------------------------------------------ invariants
def test_new_and_returning_partition_nonnull_emails(spark, tables):
    from tallyloom.plans import facts
    s = facts.apply_filters(facts.item_sales_fact(tables, [601, 602], "s"), years=[1999, 2000])
    new = facts.filter_customer_status(s, ["New"]).count()
    ret = facts.filter_customer_status(s, ["Returning"]).count()
    assert new + ret == s.filter(F.col("hashed_customer_email").isNotNull()).count()


def test_lift_is_symmetric_and_direction_has_higher_confidence(spark, tables):
    from tallyloom.plans import facts
    s = facts.apply_filters(facts.item_sales_fact(tables, [601, 602], "s"), years=[1999, 2000])
    chosen = products.select_products(s, 10, "top", key="brand_id")
    rows = basket.basket_pairs(s, chosen, item="brand_id").collect()
    assert rows
    n = s.select("order_id").distinct().count()
    for r in rows:
        assert r.confidence == pytest.approx(r["count"] / r.product_a_count, abs=1e-9)
        assert r.product_a_count <= r.product_b_count
        assert r.lift == pytest.approx(r["count"] * n / (r.product_a_count * r.product_b_count), rel=1e-6)
