"""Plan-shape checks: pushdown on stored tables, bounded broadcasts, no
unbounded collects in the hot path."""

import os

from pyspark.sql import functions as F

from tallyloom.plans import facts
from tallyloom.sources.tables import SHOP_TABLES, open_tables


def _formatted(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_year_range_reaches_stored_order_scan(spark, tables, tmpdir_path):
    for name in SHOP_TABLES:
        tables[name].write.parquet(os.path.join(tmpdir_path, f"{name}.parquet"))
    T = open_tables(spark, tmpdir_path)
    f = facts.item_sales_fact(T, [601, 602], "s", years=[1999, 2000])
    plan = _formatted(facts.apply_filters(f, years=[1999, 2000]))
    order_scan = [b for b in plan.split("\n\n") if "sales_order.parquet" in b and "Scan parquet" in b][0]
    pushed = [line for line in order_scan.split("\n") if line.startswith("PushedFilters")][0]
    assert "GreaterThanOrEqual(created_at,1999-01-01" in pushed and "LessThan(created_at," in pushed
    assert "ReadSchema: struct<entity_id:bigint,increment_id:string,created_at" in order_scan
    full = facts.item_sales_fact(T, [601, 602], "s")
    assert f.count() == facts.filter_years(full, [1999, 2000]).count()


def test_no_python_udfs_in_plans(spark, tables):
    import __spark_entry__ as E
    for key in ("promotion_metrics", "discount_sensitivity", "rotation_metrics", "seasonal_decompose"):
        plan = _formatted(E.queries()[key](spark, "/root/testdata/sf0.001"))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, key


def test_non_local_master_requires_shared_checkpoint_dir():
    import pytest
    from tallyloom.session import ensure_checkpoint_dir

    class _SC:
        master = "spark://cluster:7077"

        def getCheckpointDir(self):
            return None

    class _Conf:
        def get(self, k, d=None):
            return d

    class _S:
        sparkContext = _SC()
        conf = _Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_S())


def _jobs_started(spark, build):
    """Jobs that run while ``build`` makes a plan."""
    import uuid
    sc, group = spark.sparkContext, f"building-{uuid.uuid4().hex}"  # jobs of other calls aren't counted
    sc.setJobGroup(group, "plan building")
    try:
        build()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_building_plans_starts_no_job(spark, tables):
    from tallyloom.plans import basket, named, products, promotions
    fact = facts.item_sales_fact(tables, [601, 602], "s", years=[1999, 2000])
    lines = facts.apply_filters(fact, categories=[601], years=[1999], customer_status=["Returning"])
    plans = [
        lambda: facts.item_sales_fact(tables, [601, 602], "s", years=[1999, 2000]),
        lambda: facts.item_sales_fact(tables, [601, 602], "s", detail="basic"),
        lambda: facts.apply_filters(fact, categories=[601], customer_types=["Guest"], customer_status=["New"]),
        lambda: named.category_seasonality(tables),
        lambda: named.promotion_impact(tables, "2001-12-31"),
        lambda: named.promotion_duration_stats(tables, [("a", "1999-01-01", "1999-12-31")]),
        lambda: basket.basket_pairs(lines, products.select_products(lines, 5)),
        lambda: basket.basket_item_support(lines),
        lambda: products.rotation_metrics(lines),
        lambda: promotions.promotion_metrics(lines, tables["promotion"]),
    ]
    assert [_jobs_started(spark, p) for p in plans] == [0] * len(plans)
    assert _jobs_started(spark, lambda: basket.basket_item_support(lines, reuse=True)) > 0  # asked for


def test_lines_are_cut_to_the_products_before_the_order_join(spark, tables):
    from tallyloom.plans import named
    plan = named.product_counts_year(tables, 1999, [601])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    below = plan[plan.rindex("Join Inner, (order_id"):] if "Join Inner, (order_id" in plan else plan
    assert "LeftSemi" in below


def test_no_window_over_a_whole_frame(spark, tables):
    import __spark_entry__ as E
    for key in ("rotation_distribution", "rotation_bubble", "basket_lift_display", "quantile_cap", "relative_size"):
        plan = _formatted(E.queries()[key](spark, "/root/testdata/sf0.001"))
        assert "windowspecdefinition(specifiedwindowframe" not in plan, key


def test_only_few_literal_ranges_are_broadcast(spark, tables):
    """Literal frames up to the bound take the broadcast; larger and other frames the interval join, with the same rows."""
    from tallyloom.operators import joins
    p = tables["promotion"].where("to_date IS NOT NULL")
    frames = {n: spark.sql("SELECT * FROM VALUES " + ", ".join(
        f"({i}, DATE'1999-{1 + i % 12:02d}-{1 + i % 28:02d}', DATE'2000-{1 + i % 12:02d}-15')" for i in range(n)) + " AS t(i, a, b)")
        for n in (50, joins.MAX_RANGES + 1)}
    frames["stored"] = p.select(F.col("rule_id").alias("i"), F.col("from_date").alias("a"), F.col("to_date").alias("b"))
    for name, ranges in frames.items():
        got = joins.range_overlap_join(p, ranges, "from_date", "to_date", "a", "b")
        assert ("NestedLoop" in _formatted(got)) == (name == 50)
        want = p.join(F.broadcast(ranges), (F.col("to_date") >= F.col("a")) & (F.col("from_date") <= F.col("b")))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() > 0


def test_usage_pipeline_on_stored_tables(spark, tables, tmpdir_path):
    """The README usage example, on the shop tables stored as Parquet."""
    from tallyloom.plans import basket, catalog, products, promotions, sales
    for name in SHOP_TABLES:
        tables[name].write.parquet(os.path.join(tmpdir_path, f"{name}.parquet"))
    T = open_tables(spark, tmpdir_path)
    years, cats = [1999, 2000], [601, 602]
    fact = facts.item_sales_fact(T, cats, salt="s", years=years)
    lines = facts.apply_filters(fact, categories=cats, years=years,
                                customer_types=["Guest", "Registered"], customer_status=["Returning"])
    assert sales.growth_rate(lines, "quarter").count() > 0
    metrics = promotions.promotion_metrics(lines, T["promotion"])
    assert 0 < promotions.select_promotions(metrics, 150, "lowest").count() <= 150
    chosen = products.select_products(lines, 15, "top")
    assert basket.basket_pairs(lines, chosen).count() >= 0
    assert catalog.run_query(T, "promotion_impact", {"as_of": "2001-12-31"}).count() > 0
    # same rows as the fixture-derived tables
    direct = facts.apply_filters(facts.item_sales_fact(tables, cats, "s", years=years), categories=cats,
                                 years=years, customer_status=["Returning"])
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, direct.collect()))


def test_many_range_overlaps_combine_pairs_in_a_hash_aggregate(spark, tables):
    """A least text over the pairs would sort all pairs of a task first."""
    from datetime import date, datetime, timedelta

    from tallyloom.plans.registry import _join_range_overlap_many
    orders = [(datetime(1999, 1, 1 + d, 5), g) for d in (0, 3, 20) for g in (None, 1, 2, 10)] * 2 + [(None, 1)]
    promotions = [(1, date(1999, 1, 4), date(1999, 1, 6)), (2, date(1999, 1, 30), date(1999, 2, 9)), (3, date(1999, 1, 1), None),
                  (4, date(2001, 1, 1), date(2001, 2, 1)), (5, date(1999, 1, 2), date(1999, 1, 3))]
    T = tables | {"sales_order": spark.createDataFrame(orders, "created_at timestamp, customer_group_id long"),
                  "promotion": spark.createDataFrame(promotions, "rule_id long, from_date date, to_date date")}
    found = _join_range_overlap_many(T)

    ranges = {(f"{g or 0}:{at.date()}", at.date(), at.date() + timedelta(days=7 + 4 * (g or 0))) for at, g in orders if at}
    wanted = {}
    for rule, opens, closes in promotions:
        met = [r for r in ranges if closes and closes >= r[1] and opens <= r[2]]
        if met:
            wanted[rule] = (len(met), min(r[0] for r in met), max(r[2] for r in met))
    assert wanted and {r["rule_id"]: tuple(r)[1:] for r in found.collect()} == wanted

    plan = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    over = plan[next(i for i, line in enumerate(plan) if line.strip(" :+-").startswith("Union")) - 1]
    assert "HashAggregate" in over and "SortAggregate" not in over and "min(" in over, over
