"""Join building blocks.

The only explicit broadcast is of literal frames of labelled ranges, checked
against a row bound; any other frame of ranges takes the interval join. Other
joins are left to Spark, where AQE turns a sort-merge join into a broadcast join
only after measuring the shuffled side in bytes, and splits skewed partitions when
both inputs are plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RANGES = 1000
DAY_BITS = 22  # days of the years 1 to 9999, counted from ``FIRST_DAY``
FIRST_DAY = -719_162  # 0001-01-01 as days since 1970


def token_membership_join(lines: DataFrame, dim: DataFrame, tokens: Column, dim_key: str,
                          as_text: bool = True, token_col: str = "_token") -> DataFrame:
    """Rows of ``lines`` joined to ``dim`` rows whose key is one of ``tokens``.

    The list-membership theta join (``FIND_IN_SET(key, list)``) becomes
    explode + equi-join, so it runs as a hash/sort-merge join instead of a
    nested loop over every (line, rule) pair. With ``as_text`` the key is
    compared as its decimal text (exact token match). Both sides are plain
    shuffles, so a popular rule is split by AQE.
    """
    exploded = lines.select("*", F.explode(tokens).alias(token_col))
    key = F.col(dim_key).cast("string") if as_text else F.col(dim_key)
    return exploded.join(dim.withColumn(token_col, key), token_col).drop(token_col)


def range_overlap_join(facts: DataFrame, ranges: DataFrame, from_col: str, to_col: str,
                       start_col: str, end_col: str) -> DataFrame:
    """Pairs (fact, range) whose [from, to] overlaps [start, end].

    A literal ``ranges`` frame of at most ``MAX_RANGES`` rows (checked without a
    job: a literal frame knows its size) is broadcast and tested against each
    fact; any other takes ``interval_join``. NULL ends do not overlap (SQL
    comparison semantics).
    """
    size = ranges._jdf.queryExecution().optimizedPlan().maxRows()
    if size.isEmpty() or size.get() > MAX_RANGES:
        return interval_join(facts, ranges, from_col, to_col, start_col, end_col)
    cond = (F.col(to_col) >= F.col(start_col)) & (F.col(from_col) <= F.col(end_col))
    return facts.join(F.broadcast(ranges), cond, "inner")


def _day(column: Column) -> Column:
    return F.unix_date(column.cast("date")) - FIRST_DAY


def _covering(low: Column, high: Column) -> Column:
    """The dyadic nodes (level, number) that make up the days low..high: two a level at most.

    A node of a level is 2**level days. On each level the interval left is cut to
    whole nodes of the next: an odd first node and an even last one are taken.
    """
    node = lambda level, n: F.struct(F.lit(level).alias("level"), n.cast("long").alias("number"))
    none = F.array().cast("array<struct<level:int,number:bigint>>")
    state = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), none.alias("found"))

    def step(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        first = (a <= b) & (a % 2 == 1)
        last = (F.when(first, a + 1).otherwise(a) <= b) & (b % 2 == 0)
        mine = F.concat(s["found"], F.when(first, F.array(F.struct(level.alias("level"), a.alias("number")))).otherwise(none),
                        F.when(last, F.array(F.struct(level.alias("level"), b.alias("number")))).otherwise(none))
        a, b = F.when(first, a + 1).otherwise(a), F.when(last, b - 1).otherwise(b)
        return F.struct(F.when(a <= b, F.floor(a / 2).cast("long")).otherwise(1).alias("a"),  # 1..0 when nothing is left
                        F.when(a <= b, F.floor(b / 2).cast("long")).otherwise(0).alias("b"), mine.alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(DAY_BITS - 1)), state, step, lambda s: F.concat(
        s["found"], F.when(s["a"] <= s["b"], F.array(node(DAY_BITS, s["a"]))).otherwise(none)))


def _ancestors(day: Column) -> Column:
    """The node of each level that holds a day."""
    return F.transform(F.sequence(F.lit(0), F.lit(DAY_BITS)), lambda level: F.struct(
        level.alias("level"), F.floor(day / F.pow(F.lit(2.0), level)).cast("long").alias("number")))


def interval_join(facts: DataFrame, ranges: DataFrame, from_col: str, to_col: str, start_col: str, end_col: str) -> DataFrame:
    """Pairs (fact, range) whose [from, to] overlaps [start, end], for any number of ranges.

    Two intervals overlap when the later one begins inside the other. A begin is a
    day and lies in one node of each dyadic level; an interval is made up of at
    most two nodes a level, however long it is. So each pair meets in one node, in
    an equi-join on nodes: ranges that begin inside a fact's interval, then facts
    that begin inside a range's, after its first day. The exact comparison follows,
    for times within a day. Both sides are plain shuffles, so adaptive execution
    splits a node that many intervals share.
    """
    exact = (F.col(to_col) >= F.col(start_col)) & (F.col(from_col) <= F.col(end_col))
    f, r = facts.columns, ranges.columns

    def spans(df: DataFrame, a: str, b: str) -> DataFrame:
        low, high = F.least(_day(F.col(a)), _day(F.col(b))), F.greatest(_day(F.col(a)), _day(F.col(b)))
        return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"_low": low, "_high": high})

    own, other = spans(facts, from_col, to_col), spans(ranges, start_col, end_col)
    begin = lambda df: df.withColumn("_node", F.explode(_ancestors(F.col("_low")))).drop("_low", "_high")
    cover = lambda df, after: df.where(F.col("_low") + after <= F.col("_high")).withColumn(
        "_node", F.explode(_covering(F.col("_low") + after, F.col("_high")))).drop("_low", "_high")
    inside = cover(own, 0).join(begin(other), "_node")
    around = begin(own).join(cover(other, 1), "_node")
    return inside.select(*f, *r).unionByName(around.select(*f, *r)).where(exact)


def semi_join(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Rows of ``df`` whose key appears in ``keys`` (``left_semi``)."""
    return df.join(keys, on, "left_semi")


def lookup_join(df: DataFrame, dim: DataFrame, on, value_cols: dict[str, object]) -> DataFrame:
    """Left join a lookup and default missing values (dict lookup with default)."""
    out = df.join(dim, on, "left")
    for c, default in value_cols.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(default)))
    return out
