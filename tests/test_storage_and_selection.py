"""Plain number text, stored versions, SQL without views, interval join, exact quantiles, declared schemas."""

import datetime as dt
import json
import math
import os
import random
import threading
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import plain_number
from tallyloom.operators import joins, stats
from tallyloom.operators.topk import order_for
from tallyloom.plans import catalog, named
from tallyloom.sources import exports, results
from tallyloom.sources.tables import open_tables, shop_tables_from_tpch
from tests.conftest import SF_SMALL
from tests.test_plans import _formatted, _jobs_started


# ------------------------------------------------------------------ number text
def spelled(x: float) -> str:
    text = format(Decimal(repr(x)), "f")
    return text if "." in text else text + ".0"


def test_plain_number_text(spark):
    rng = random.Random(3)
    values = [1e7, 1e-4, 1e15, 0.0, -0.0, 1.0, -1.5e-7, 11868190.96, 123456789.123, 2e23, 9007199254740993.0, 1.7976931348623157e308,
              2.2250738585072014e-308, 0.1 + 0.2, 1 / 3, 100.0, 1e22, 1e21, 4.35, 2.0 ** -44, 1.1e-5]
    values += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-20, 20) for _ in range(2000)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r[0] for r in df.select(plain_number(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got[:20] == [spelled(v) for v in values[:20]]
    for text, v in zip(got, values):  # of two texts of the shortest length either may come
        assert float(text) == v and len(text) == len(spelled(v)) and "E" not in text.upper()
    odd = spark.createDataFrame([(None, None, None), (math.nan, None, 3), (math.inf, Decimal("0.00000000"), 4), (-math.inf, Decimal("12.50000000"), 5)],
                                "v double, d decimal(28,8), i int")
    rows = odd.select(*[plain_number(F.col(c), odd.schema[c].dataType) for c in odd.columns]).collect()
    assert list(map(tuple, rows)) == [(None, None, None), (None, None, "3"), ("inf", "0.00000000", "4"), ("-inf", "12.50000000", "5")]
    single = spark.createDataFrame([(1e7,), (0.1,)], "v float")
    assert [r[0] for r in single.select(plain_number(F.col("v"), single.schema["v"].dataType)).collect()] == ["10000000.0", "0.1"]


def test_exports_write_plain_numbers(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 1e7), (2, 1e-4), (3, 1e15), (4, None), (5, math.nan)], "id int, v double").coalesce(1)
    when = dt.datetime(2024, 1, 1)
    text = {}
    for name, path in (("csv", exports.export_csv(df, tmpdir_path, "plain", when)), ("meta", exports.export_with_metadata(df, tmpdir_path, "q", None, "m", when))):
        lines = []
        for part in sorted(f for f in os.listdir(path) if f.startswith("part-")):
            with open(os.path.join(path, part)) as fh:
                lines += fh.read().splitlines()
        text[name] = lines
    assert text["csv"] == ["id,v", "1,10000000.0", "2,0.0001", "3,1000000000000000.0", "4,", "5,"]
    assert text["meta"][-5:] == [",,1,10000000.0", ",,2,0.0001", ",,3,1000000000000000.0", ",,4,", ",,5,"]


# ---------------------------------------------------------------- stored results
T0 = dt.datetime(2024, 1, 1)


def stored(spark, root, n, hours, **more):
    return results.result_table(spark, root, "q", None, lambda: spark.range(n), now=T0 + dt.timedelta(hours=hours), **more)


def folder(root):
    return os.path.join(root, results.result_key("q"))


def test_interrupted_switch_leaves_the_version_before(spark, tmpdir_path, monkeypatch):
    assert stored(spark, tmpdir_path, 5, 0).count() == 5

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(results, "_add_record", lost)
    with pytest.raises(OSError):
        stored(spark, tmpdir_path, 7, 30)  # the data is written, the record isn't
    monkeypatch.undo()
    assert stored(spark, tmpdir_path, 9, 1).count() == 5  # still the first version, not a miss
    with open(os.path.join(folder(tmpdir_path), results.RECORD + "0000000009-x"), "w") as fh:
        fh.write('{"name": "q", "built')  # a record cut short isn't one
    assert stored(spark, tmpdir_path, 9, 1).count() == 5
    assert stored(spark, tmpdir_path, 9, 30).count() == 9
    assert stored(spark, tmpdir_path, 11, 31).count() == 9


def test_two_builders_at_once_add_a_version_each(spark, tmpdir_path):
    def build_meanwhile():
        stored(spark, tmpdir_path, 3, 0)
        return spark.range(4)

    got = results.result_table(spark, tmpdir_path, "q", None, build_meanwhile, now=T0)
    assert got.count() == 4 and stored(spark, tmpdir_path, 9, 1).count() in (3, 4)
    assert len([f for f in os.listdir(folder(tmpdir_path)) if f.startswith(results.RECORD)]) == 2


def test_expiry_keeps_the_newest_and_the_grace_time(spark, tmpdir_path):
    versions = lambda: sorted(f for f in os.listdir(folder(tmpdir_path)) if f.startswith(results.DATA))
    first = stored(spark, tmpdir_path, 1, 0)
    stored(spark, tmpdir_path, 2, 30)
    assert len(versions()) == 2 and first.count() == 1  # within the grace time a reader keeps its files
    stored(spark, tmpdir_path, 3, 60)
    assert len(versions()) == 2  # the first went: 60 h is past 24 + 24
    assert results.result_expire(spark, tmpdir_path, now=T0 + dt.timedelta(hours=61)) == 0
    assert results.result_expire(spark, tmpdir_path, now=T0 + dt.timedelta(hours=600)) == 2
    assert len(versions()) == 1 and spark.read.parquet(os.path.join(folder(tmpdir_path), versions()[0])).count() == 3
    orphan = os.path.join(folder(tmpdir_path), results.DATA + "0000000001-orphan")
    os.makedirs(orphan)
    later = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    assert results.result_expire(spark, tmpdir_path, now=later) == 0
    assert results.result_expire(spark, tmpdir_path, now=later + dt.timedelta(hours=49)) == 1 and not os.path.exists(orphan)


def test_records_name_their_result(spark, tmpdir_path):
    results.result_table(spark, tmpdir_path, "a b", {"x": 1}, lambda: spark.range(2), now=T0)
    base = os.path.join(tmpdir_path, results.result_key("a b", {"x": 1}))
    (record,) = [f for f in os.listdir(base) if f.startswith(results.RECORD)]
    with open(os.path.join(base, record)) as fh:
        info = json.load(fh)
    assert info["name"] == "a b" and json.loads(info["args"]) == {"x": 1} and os.path.isdir(os.path.join(base, info["data"]))


# ------------------------------------------------------------- SQL without views
def test_sql_leaves_a_users_views_alone(spark, tables):
    spark.range(3).createOrReplaceTempView("product")
    spark.range(4).createOrReplaceTempView("own_view")
    before = {t.name for t in spark.catalog.listTables()}
    want = tables["product"].count()
    assert catalog.run_sql(spark, tables, "SELECT count(*) AS n FROM product").first().n == want != 3
    assert spark.table("product").count() == 3
    assert catalog.run_sql(spark, tables, "WITH x AS (SELECT * FROM Product) SELECT (SELECT count(*) FROM x) + count(*) AS n FROM own_view; ").first().n == want + 4
    assert catalog.run_sql(spark, tables, "SELECT '{product}' AS a, :x AS b, count(*) AS n FROM own_view -- product", {"x": "{}"}).first() == ("{product}", "{}", 4)
    assert catalog.run_sql(spark, tables, "SELECT count(*) AS n FROM own_view WHERE id >= ?", [2]).first().n == 2
    assert {t.name for t in spark.catalog.listTables()} == before
    spark.catalog.dropTempView("product")
    spark.catalog.dropTempView("own_view")


def test_sql_of_two_table_sets_in_two_threads(spark, tables):
    sets = [{"product": tables["product"].limit(n)} for n in (2, 5)]
    got: dict[int, set] = {0: set(), 1: set()}

    def run(i):
        for _ in range(6):
            got[i].add(catalog.run_sql(spark, sets[i], "SELECT count(*) AS n FROM product").first().n)

    threads = [threading.Thread(target=run, args=(i,)) for i in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got == {0: {2}, 1: {5}}


# ---------------------------------------------------------------- interval join
def test_interval_join_equals_nested_loop(spark):
    rng = random.Random(5)
    day = lambda n: dt.date.fromordinal(n)

    def interval(i):
        a = rng.choice([rng.randint(1, 3_652_059), rng.randint(730_000, 730_400), 730_119, 1, 3_652_059])
        b = min(max(a + rng.choice([0, 0, 1, 7, 31, 365, 40_000, 3_000_000, -5]), 1), 3_652_059)
        return (i, None if rng.random() < 0.05 else day(a), None if rng.random() < 0.05 else day(b))

    facts, ranges = [interval(i) for i in range(300)], [interval(i) for i in range(1500)]
    f = spark.createDataFrame(facts, "fid int, from_d date, to_d date")
    r = spark.createDataFrame(ranges, "rid int, start_d date, end_d date").repartition(2)
    got = joins.range_overlap_join(f, r, "from_d", "to_d", "start_d", "end_d").select("fid", "rid").collect()
    want = {(a, b) for a, x, y in facts for b, s, e in ranges if None not in (x, y, s, e) and y >= s and x <= e}
    assert len(got) == len(want) and {tuple(p) for p in got} == want and len(want) > 5000
    assert "NestedLoop" not in _formatted(joins.interval_join(f, r, "from_d", "to_d", "start_d", "end_d"))


def test_interval_join_of_times_within_a_day(spark):
    at = lambda h: dt.datetime(2024, 5, 1, h)
    f = spark.createDataFrame([(1, at(8), at(10)), (2, at(11), at(12))], "fid int, a timestamp_ntz, b timestamp_ntz")
    r = spark.createDataFrame([(1, at(9), at(9)), (2, at(10), at(11)), (3, at(13), at(14))], "rid int, s timestamp_ntz, e timestamp_ntz")
    got = joins.interval_join(f, r, "a", "b", "s", "e").select("fid", "rid").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 2)]


# -------------------------------------------------------------- exact quantiles
def test_exact_quantiles_of_more_values_than_a_task_holds(spark):
    rng = np.random.default_rng(7)
    groups = {"wide": rng.normal(0, 1, 30_000), "ties": rng.integers(0, 4, 5_000).astype(float), "near": 1 + rng.random(9_000) * 1e-9,
              "one": np.array([5.0]), "two": np.array([1.0, 2.0]), "scales": 10.0 ** rng.integers(-300, 300, 3_000), "signs": np.array([-0.0, 0.0, -1.0, 1.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("wide", None), ("wide", math.nan), ("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r.g: r for r in stats.exact_quantiles(df, "g", "v", qs).collect()}
    assert set(got) == {*groups, None} and got[None].quantiles == [3.0] * 6
    for g, vs in groups.items():
        assert got[g].n == len(vs)
        assert got[g].quantiles == pytest.approx(np.quantile(vs, qs).tolist(), rel=1e-12, abs=1e-300)
    plan = _formatted(stats.exact_quantiles(df, "g", "v", qs))
    assert "percentile(" not in plan and "WindowSpec" not in plan


def test_ranked_buckets_are_a_small_share(spark):
    df = spark.range(100_000).select(F.lit("all").alias("g"), F.hash("id").cast("double").alias("v"))
    got = stats.exact_quantiles(df, "g", "v", [0.5], buckets=64).first()
    values = sorted(r.v for r in df.select("v").collect())
    assert got.quantiles == [(values[49_999] + values[50_000]) / 2]


def test_quantile_cap_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "lift double")
    assert stats.quantile_cap(df, "lift").count() == 0 and stats.cap_value(df, "lift").count() == 0


# ------------------------------------------------------- schemas, plans, orders
def test_opening_tables_starts_no_job(spark, tables, tmpdir_path):
    for name, df in tables.items():
        df.write.parquet(os.path.join(tmpdir_path, f"{name}.parquet"))
    assert _jobs_started(spark, lambda: shop_tables_from_tpch(spark, SF_SMALL)) == _jobs_started(spark, lambda: open_tables(spark, tmpdir_path)) == 0
    declared, read = open_tables(spark, tmpdir_path), open_tables(spark, tmpdir_path, schemas=None)
    for name in tables:
        assert [(f.name, f.dataType) for f in declared[name].schema] == [(f.name, f.dataType) for f in read[name].schema]


def test_product_counts_need_no_expand(tables):
    for df in (named.product_counts_year(tables, 1999, [601, 602]), named.product_counts_cross_year(tables, [1999, 2000], [601, 602])):
        assert "Expand" not in _formatted(df)


def test_product_counts_count_products_once(spark, tables):
    doubled = tables | {"product_attribute_int": tables["product_attribute_int"].unionByName(tables["product_attribute_int"])}
    for args in (([601, 602],), ([601],)):
        assert sorted(map(tuple, named.product_counts_year(doubled, 1999, *args).collect())) == sorted(map(tuple, named.product_counts_year(tables, 1999, *args).collect()))


def test_unknown_order_is_an_error():
    with pytest.raises(ValueError, match="unknown order"):
        order_for("best", "sku", "revenue")
