"""Hand-sized frames: rule parsing, buckets, customer filters, growth, duration."""

import datetime as dt

from pyspark.sql import functions as F

from tallyloom.functions.rules import discount_bucket, exact_rule_tokens, parse_rule_ids
from tallyloom.plans import facts, named, sales as sales_plans


def test_parse_rule_ids(spark):
    rows = [(None,), ("",), ("5",), ("c-5",), (" 5 , c-7",), ("x,5",), ("5,c-5",), ("1.5",), ("12,c-7, x",),
            (" c- 5",), ("c--5,+7",), ("5 5,--5,c-",), (",5,,6,",)]
    df = spark.createDataFrame(rows, "ids string")
    got = [r[0] for r in df.select(parse_rule_ids("ids")).collect()]
    assert got == [[], [], [5], [5], [5, 7], [5], [5, 5], [], [12, 7], [5], [-5, 7], [], [5, 6]]


def test_exact_tokens_match_once(spark):
    df = spark.createDataFrame([("5,5",), ("c-5",), (None,)], "ids string")
    got = [sorted(r[0]) for r in df.select(exact_rule_tokens("ids")).collect()]
    assert got == [["5"], ["c-5"], []]


def test_discount_bucket_edges(spark):
    vals = [0.0, 15.0, 15.01, 20.0, 25.0, 30.0, 30.5, 35.0]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    got = [r[0] for r in df.select(discount_bucket("d")).collect()]
    assert got == ["≤15%", "≤15%", "20%", "20%", "25%", "30%", "≥35%", "≥35%"]


FACT_SCHEMA = ("order_id long, sku string, order_date date, hashed_customer_email string, "
               "customer_is_guest int, customer_group_id long, category_num int, "
               "base_discount_amount double, base_row_total_incl_tax double, qty_ordered double")


def _fact(spark, rows):
    return spark.createDataFrame(rows, FACT_SCHEMA)


def test_customer_status_after_year_filter(spark):
    d99, d00 = dt.date(1999, 5, 1), dt.date(2000, 5, 1)
    rows = [
        (1, "A", d99, "e1", 0, 1, 601, 0.0, 10.0, 1.0),
        (2, "A", d00, "e1", 0, 1, 601, 0.0, 10.0, 1.0),   # e1: 2 orders overall, 1 in 2000
        (3, "B", d00, "e2", 0, 1, 601, 0.0, 10.0, 1.0),
        (3, "C", d00, "e2", 0, 1, 601, 0.0, 10.0, 1.0),   # same order twice: still New
        (4, "B", d00, None, 0, 1, 601, 0.0, 10.0, 1.0),   # null e-mail drops when filtering
        (5, "B", d00, "e3", 0, 1, 601, 0.0, 10.0, 1.0),
        (6, "B", d00, "e3", 0, 1, 601, 0.0, 10.0, 1.0),
    ]
    f = _fact(spark, rows)
    new_all = {r.order_id for r in facts.apply_filters(f, customer_status=["New"]).collect()}
    assert new_all == {3}
    new_2000 = {r.order_id for r in facts.apply_filters(f, years=[2000], customer_status=["New"]).collect()}
    assert new_2000 == {2, 3}
    ret_2000 = {r.order_id for r in facts.apply_filters(f, years=[2000], customer_status=["Returning"]).collect()}
    assert ret_2000 == {5, 6}
    both = facts.apply_filters(f, customer_status=["New", "Returning"]).count()
    assert both == len(rows)


def test_customer_type_rules(spark):
    d = dt.date(2000, 1, 1)
    rows = [(1, "A", d, "e", 1, 0, 601, 0.0, 1.0, 1.0), (2, "A", d, "e", 0, 2, 601, 0.0, 1.0, 1.0),
            (3, "A", d, "e", 0, 3, 601, 0.0, 1.0, 1.0)]
    f = _fact(spark, rows)
    ids = lambda df: sorted(r.order_id for r in df.collect())
    assert ids(facts.filter_customer_type(f, None)) == [1, 2, 3]
    assert ids(facts.filter_customer_type(f, ["Guest", "Registered"])) == [1, 2, 3]
    assert ids(facts.filter_customer_type(f, ["Guest"])) == [1]
    assert ids(facts.filter_customer_type(f, ["Registered"])) == [2]
    assert ids(facts.filter_customer_type(f, [])) == []


def test_growth_rate_missing_month_zero_base_single(spark):
    s = spark.createDataFrame(
        [(dt.date(2000, 1, 5), 10.0), (dt.date(2000, 2, 5), 0.0), (dt.date(2000, 4, 5), 5.0)],
        "order_date date, sales_amount double")
    got = [(r.period, r.previous_sales, r.growth_rate) for r in sales_plans.growth_rate(s).collect()]
    # March is missing: April compares with February (previous present month);
    # February's base is 10 -> -100 %, April's base is 0 -> NULL.
    assert got == [("2000-01", None, None), ("2000-02", 10.0, -100.0), ("2000-04", 0.0, None)]
    one = spark.createDataFrame([(dt.date(2000, 1, 5), 10.0)], "order_date date, sales_amount double")
    assert [(r.previous_sales, r.growth_rate) for r in sales_plans.growth_rate(one).collect()] == [(None, None)]


def test_promotion_duration_clipping(spark):
    promos = spark.createDataFrame([
        (1, dt.date(1998, 12, 1), dt.date(1999, 1, 10)),   # clipped at the start: 10 days
        (2, dt.date(1999, 12, 25), dt.date(2000, 1, 5)),   # clipped at the end: 7 days in 1999
        (3, dt.date(1999, 6, 1), None),                    # open end never overlaps
        (4, dt.date(1999, 7, 1), dt.date(1999, 7, 1)),     # one day
    ], "rule_id long, from_date date, to_date date")
    T = {"promotion": promos}
    got = named.promotion_duration_stats(T, [("1999", "1999-01-01", "1999-12-31")]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.year, r.promotion_count, r.max_duration_days, r.min_duration_days) == ("1999", 3, 10, 1)
    assert r.average_duration_days == round((10 + 7 + 1) / 3, 2)


def test_year_filter_is_pushed_to_scan(spark, tables):
    """Year filters are range predicates on the order timestamp; Catalyst moves
    them below the joins into the orders branch."""
    f = facts.apply_filters(facts.item_sales_fact(tables, [601, 602], "s"), years=[1999, 2000])
    plan = f._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderdate" in plan


def test_product_counts_add_up(spark, tables):
    rows = named.product_counts_year(tables, 1999, [601, 602]).collect()
    for r in rows:
        assert r.sold_products + r.unsold_products == r.total_products
        assert r.single_order_products <= r.sold_products
