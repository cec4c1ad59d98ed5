"""A key holding a third of the rows: results stay whole, AQE splits joins of two
plain shuffles but not joins against an aggregate, and the salted join does."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from tallyloom.operators.skew import hot_keys, salted_join
from tallyloom.plans import facts
from tallyloom.operators.topk import top_k_per_group


def _skewed_fact(spark, n=30000):
    # one e-mail owns every third row, spread over many orders
    return (spark.range(n)
            .withColumn("order_id", F.col("id") % 9000)
            .withColumn("hashed_customer_email",
                        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 4000).cast("string"))))
            .withColumn("sku", F.concat(F.lit("S"), (F.col("id") % 97).cast("string"))))


@contextmanager
def shuffled(spark):
    """No broadcast, and partitions of a few KB count as skewed."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _largest_share(df):
    """Share of the rows that the largest partition of a result holds."""
    sizes = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_aqe_splits_plain_joins_but_not_joins_with_an_aggregate(spark):
    with shuffled(spark):
        f = _skewed_fact(spark)
        names = f.select("hashed_customer_email").distinct()
        other = spark.createDataFrame([(r[0],) for r in names.collect()], "hashed_customer_email string")
        plain = f.join(other, "hashed_customer_email")
        assert plain.count() == f.count()
        plain.collect()
        assert "skew=true" in _plan(plain)
        grouped = f.join(f.groupBy("hashed_customer_email").agg(F.count("*").alias("n")), "hashed_customer_email", "left_semi")
        grouped.collect()
        assert "skew=true" not in _plan(grouped)


def test_hot_email_semi_join_is_salted(spark):
    with shuffled(spark):
        f = _skewed_fact(spark)
        out = facts.filter_customer_status(f, ["Returning"])
        expected = f.groupBy("hashed_customer_email").agg(F.count_distinct("order_id").alias("c")) \
                    .filter("c > 1").join(f, "hashed_customer_email").count()
        assert out.count() == expected
        plain = f.join(facts.customer_order_counts(f).filter("unique_order_count > 1"), "hashed_customer_email", "left_semi")
        assert _largest_share(out) < 0.25 < _largest_share(plain)


def test_null_keys_stay_out_of_the_salted_join(spark):
    with shuffled(spark):
        f = _skewed_fact(spark).withColumn("hashed_customer_email", F.when(F.col("id") % 2 == 0, F.col("hashed_customer_email"))).repartition(8)
        keys = f.groupBy("hashed_customer_email").agg(F.count("*").alias("n")).filter("n > 2").select("hashed_customer_email")
        nulls = f.where("hashed_customer_email IS NULL").count()
        anti = salted_join(f, keys, "hashed_customer_email", "left_anti").where("hashed_customer_email IS NULL")
        assert anti.count() == nulls and _largest_share(anti) < 0.3  # no partition holds them
        assert salted_join(f, keys, "hashed_customer_email", "left").where("hashed_customer_email IS NULL").count() == nulls
        semi = salted_join(f, keys, "hashed_customer_email", "left_semi")
        assert semi.where("hashed_customer_email IS NULL").isEmpty()
        assert [r[0] for r in hot_keys(f, "hashed_customer_email", 10).collect()] == ["hot"]


def test_hot_group_top_k_keeps_whole_result(spark):
    # one group with a third of the rows: two-stage ranking equals one-stage
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("a"),
        F.col("id").cast("string").alias("b"), (F.col("id") * 7919 % 1000).alias("pair_count"))
    order = [F.col("pair_count").desc(), F.col("b").asc()]
    two = sorted(map(tuple, top_k_per_group(rows, ["a"], order, 5, "b", 16).collect()))
    one = sorted(map(tuple, top_k_per_group(rows, ["a"], order, 5).collect()))
    assert two == one and len(two) == 51 * 5


def test_salted_join_equals_plain_join(spark):
    big = _skewed_fact(spark, 6000)
    agg = big.groupBy("hashed_customer_email").agg(F.count("*").alias("n"))
    # several rows per key on the small side, some keys missing from it
    small = agg.unionByName(agg.withColumn("n", -F.col("n"))).filter(~F.col("hashed_customer_email").endswith("7"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, salted_join(big, small, "hashed_customer_email", how, buckets=8, max_hot=10).collect()))
        b = sorted(map(tuple, big.join(small, "hashed_customer_email", how).collect()))
        assert a == b, how
