"""Seasonal decomposition against a numpy model of the textbook method, and
result-store / export round trips."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.plans import catalog, decompose
from tallyloom.sources import exports, results


def _model(x, model):
    """Moving-average decomposition: centred trend (half weights for even p),
    least-squares end extrapolation over the nearest p points, centred
    seasonal means."""
    x = np.asarray(x, float)
    n = len(x)
    p = min(12, n // 2)
    filt = np.r_[0.5, np.ones(p - 1), 0.5] / p if p % 2 == 0 else np.ones(p) / p
    h = len(filt) // 2
    trend = np.full(n, np.nan)
    for i in range(h, n - h):
        trend[i] = np.dot(filt, x[i - h:i + h + 1])
    f, b = h, n - 1 - h
    fl, bf = min(f + p, b), max(f, b - p)
    k, c = np.polyfit(np.arange(f, fl), trend[f:fl], 1)
    trend[:f] = k * np.arange(0, f) + c
    k, c = np.polyfit(np.arange(bf, b), trend[bf:b], 1)
    trend[b + 1:] = k * np.arange(b + 1, n) + c
    mult = model == "multiplicative"
    detr = x / trend if mult else x - trend
    pa = np.array([detr[i::p].mean() for i in range(p)])
    pa = pa / pa.mean() if mult else pa - pa.mean()
    seas = np.tile(pa, n // p + 1)[:n]
    resid = x / seas / trend if mult else detr - seas
    return p, trend, seas, resid


def _series(spark, values, start_year=2000):
    rows = [(dt.date(start_year + i // 12, i % 12 + 1, 15), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "order_date date, sales_amount double")


@pytest.mark.parametrize("n,model", [(12, "additive"), (24, "multiplicative"), (14, "additive"),
                                     (30, "multiplicative"), (13, "multiplicative")])
def test_decompose_matches_model(spark, n, model):
    rng = np.random.default_rng(n)
    vals = np.round(100 + 10 * np.sin(np.arange(n) / 2.0) + rng.uniform(0, 5, n) + np.arange(n), 2)
    got = decompose.seasonal_decompose(_series(spark, vals), model).orderBy("idx").collect()
    p, trend, seas, resid = _model(vals, model)
    assert len(got) == n and got[0].period == p
    assert [r.trend for r in got] == pytest.approx(trend, abs=6e-5)
    assert [r.seasonal for r in got] == pytest.approx(seas, abs=6e-5)
    assert [r.resid for r in got] == pytest.approx(resid, abs=6e-5)
    if model == "additive":
        for r in got:
            assert r.trend + r.seasonal + r.resid == pytest.approx(r.observed, abs=3e-4)


def test_decompose_refusals(spark):
    assert decompose.seasonal_decompose(_series(spark, range(1, 12)), "additive").count() == 0
    vals = [5.0] * 12 + [0.0] + [5.0] * 11
    assert decompose.seasonal_decompose(_series(spark, vals), "multiplicative").count() == 0
    assert decompose.seasonal_decompose(_series(spark, vals), "additive").count() == 24


def test_result_table_reuse_and_expiry(spark, tmpdir_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumn("v", F.col("id") * 2)

    t0 = dt.datetime(2024, 1, 1, 0, 0)
    a = results.result_table(spark, tmpdir_path, "q", {"x": 1}, build, now=t0)
    b = results.result_table(spark, tmpdir_path, "q", {"x": 1}, build, now=t0 + dt.timedelta(hours=23))
    assert len(calls) == 1 and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    results.result_table(spark, tmpdir_path, "q", {"x": 1}, build, now=t0 + dt.timedelta(hours=25))
    assert len(calls) == 2  # expired
    results.result_table(spark, tmpdir_path, "q", {"x": 2}, build, now=t0)
    assert len(calls) == 3  # other arguments, other key
    assert results.result_invalidate(spark, tmpdir_path, "q", {"x": 1})
    results.result_table(spark, tmpdir_path, "q", {"x": 1}, build, now=t0)
    assert len(calls) == 4
    assert results.result_invalidate(spark, tmpdir_path)  # all
    assert not os.path.exists(tmpdir_path)


def test_empty_result_not_stored(spark, tmpdir_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(0)

    results.result_table(spark, tmpdir_path, "e", None, build)
    results.result_table(spark, tmpdir_path, "e", None, build)
    assert len(calls) == 2


def test_exports_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, s string")
    when = dt.datetime(2024, 2, 3, 4, 5, 6)
    p = exports.export_csv(df, tmpdir_path, "my report!", when)
    assert p.endswith("my_report__20240203_040506.csv")
    back = spark.read.schema(df.schema).option("header", True).csv(p)
    assert sorted(map(tuple, back.collect())) == [(1, "a b"), (2, "c")]
    pj = exports.export_json(df, tmpdir_path, None, when)
    assert os.path.basename(pj) == "query_export_20240203_040506.json"
    assert sorted(map(tuple, spark.read.schema(df.schema).json(pj).collect())) == [(1, "a b"), (2, "c")]
    assert exports.export_csv(df.limit(0), tmpdir_path, "empty") is None
    assert not any(n.startswith("empty") for n in os.listdir(tmpdir_path))


def test_export_with_metadata_block_first(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(20)], "id long, s string").repartition(3)
    when = dt.datetime(2024, 2, 3, 4, 5, 6)
    p = exports.export_with_metadata(df, tmpdir_path, "SELECT id,\n s FROM t", {"a": 1}, None, when)
    assert os.path.basename(p) == "SELECT_id__20240203_040506.csv"
    parts = sorted(f for f in os.listdir(p) if f.startswith("part-"))
    with open(os.path.join(p, parts[0])) as fh:
        lines = fh.read().splitlines()
    assert lines[0].startswith("Metadata,Value")
    assert lines[1].startswith('Query,"SELECT id,  s FROM t"')
    assert lines[4].startswith("Row Count,20")
    for part in parts[1:]:
        with open(os.path.join(p, part)) as fh:
            assert all(line.startswith(",,") for line in fh.read().splitlines())
    assert spark.read.csv(p).count() == 20 + 6
    assert exports.export_with_metadata(df.limit(0), tmpdir_path, "SELECT 1") is None


def test_named_query_exports(spark, tables, tmpdir_path):
    when = dt.datetime(2024, 2, 3, 4, 5, 6)
    args = {"as_of": "2001-12-31"}
    want = catalog.run_query(tables, "campaign_timings", args).count()
    p = catalog.export_query(tables, "campaign_timings", tmpdir_path, args, "csv", when)
    assert os.path.basename(p) == "campaign_timings_20240203_040506.csv"
    assert spark.read.option("header", True).csv(p).count() == want
    assert spark.read.json(catalog.export_query(tables, "campaign_timings", tmpdir_path, args, "json", when)).count() == want
    p = catalog.export_query(tables, "campaign_timings", os.path.join(tmpdir_path, "m"), args, "csv+metadata", when)
    assert spark.read.csv(p).where("_c0 = 'Row Count'").first()[1] == str(want)
    with pytest.raises(ValueError):
        catalog.export_query(tables, "campaign_timings", tmpdir_path, args, "xlsx")


def test_registered_query_runs_by_name(tables):
    own = dict(catalog.CATALOG)
    catalog.register("big_orders", lambda T, least: T["sales_order"].where(F.col("base_total_paid") >= least), own)
    assert catalog.run_query(tables, "big_orders", {"least": 1e9}, own).count() == 0
    assert len(catalog.CATALOG) == 11 and "big_orders" not in catalog.CATALOG
    with pytest.raises(KeyError):
        catalog.run_query(tables, "big_orders", {"least": 1})


def test_sql_placeholders_outside_quotes_only(spark, tables):
    text = """SELECT '%s' AS a, "%sale%" AS b, count(*) AS n FROM sales_order -- %s
        WHERE state = %s /* %s */ AND increment_id NOT LIKE '%sale%' AND base_total_paid >= %s"""
    row = catalog.run_sql(spark, tables, text, ["complete", 1000]).first()
    want = tables["sales_order"].where("state = 'complete' AND base_total_paid >= 1000").count()
    assert (row.a, row.b, row.n) == ("%s", "%sale%", want) and want > 0


def test_result_of_other_data_is_another_result(spark, tmpdir_path):
    for source, n in (("one", 3), ("two", 4), ("one", 3)):
        got = results.result_table(spark, tmpdir_path, "q", None, lambda: spark.range(n), source=source)
        assert got.count() == n


def test_rebuild_leaves_a_readers_files(spark, tmpdir_path):
    t0 = dt.datetime(2024, 1, 1)
    old = results.result_table(spark, tmpdir_path, "q", None, lambda: spark.range(5), now=t0)
    new = results.result_table(spark, tmpdir_path, "q", None, lambda: spark.range(7), now=t0 + dt.timedelta(days=2))
    assert (old.count(), new.count()) == (5, 7)
