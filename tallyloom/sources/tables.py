"""Open the shop tables.

A deployment keeps the six shop tables (orders, order lines, promotions,
products, product attributes, attribute labels) as Parquet (or reads them once
through ``spark.read.jdbc`` with a partition column). ``open_tables`` returns
them as a dict of lazy DataFrames; every plan in this package takes that dict.

``shop_tables_from_tpch`` builds the same six tables from the TPC-H-like test
tables, following the mapping in FIXTURES.md, so the analytics can be run and
checked on generated data. It is lazy too: no table is materialised.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import DRIVER_SCHEMAS, SHOP_SCHEMAS

SHOP_TABLES = (
    "sales_order",            # one row per order
    "sales_item",             # one row per order line
    "promotion",              # catalogue price rules
    "product",                # product entities
    "product_attribute_int",  # long (EAV) integer attributes of products
    "attribute_option",       # option labels per store
)


def open_tables(spark: SparkSession, path: str, fmt: str = "parquet", names: tuple[str, ...] = SHOP_TABLES,
                schemas: Mapping[str, str] | None = SHOP_SCHEMAS) -> dict[str, DataFrame]:
    """Read ``{path}/{name}.{fmt}`` for each shop table (lazy).

    Columns come from ``schemas`` (DDL text by table), so opening starts no job;
    tables it doesn't name, or all with None, have theirs read from the files.
    """
    def reader(name: str):
        declared = (schemas or {}).get(name)
        return spark.read.schema(declared) if declared else spark.read

    return {n: reader(n).format(fmt).load(f"{path.rstrip('/')}/{n}.{fmt}") for n in names}


def open_jdbc_tables(spark: SparkSession, url: str, properties: dict[str, str],
                     partitioning: dict[str, tuple[str, int, int, int]] | None = None,
                     names: tuple[str, ...] = SHOP_TABLES,
                     table_names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Read the shop tables from a database in parallel.

    ``partitioning[name] = (column, lower, upper, num_partitions)`` splits a
    large table into range reads on a numeric column (e.g. the order id), so
    the read is spread over executors instead of one connection; small
    dimension tables are read whole. ``table_names`` maps our names to the
    database's. (Not exercised by the tests: no database is available here.)
    """
    out = {}
    for n in names:
        db_table = (table_names or {}).get(n, n)
        part = (partitioning or {}).get(n)
        if part:
            col, lo, hi, k = part
            out[n] = spark.read.jdbc(url, db_table, column=col, lowerBound=lo, upperBound=hi,
                                     numPartitions=k, properties=properties)
        else:
            out[n] = spark.read.jdbc(url, db_table, properties=properties)
    return out


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy read of a driver table, by its declared columns."""
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Category option ids by part type. Fixed values of the test mapping
# (FIXTURES.md): ECONOMY 601, LARGE 602, MEDIUM 603, PROMO 604, SMALL 605,
# anything else 606.
_TYPE_OPTION = {"ECONOMY": 601, "LARGE": 602, "MEDIUM": 603, "PROMO": 604, "SMALL": 605}
_OTHER_OPTION = 606
_OPTION = "CAST(CASE p_type {} ELSE {} END AS INT)".format(
    " ".join(f"WHEN '{label}' THEN {option}" for label, option in _TYPE_OPTION.items()), _OTHER_OPTION)

# Columns of the mapping, as SQL expressions over the driver tables.
_SALES_ORDER = (
    "o_orderkey AS entity_id",
    """concat(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN 'EBAY'
                   WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 0 THEN 'AMZ' ELSE '1' END, CAST(o_orderkey AS STRING)) AS increment_id""",
    "timestampadd(MINUTE, o_orderkey * 37 % 1440, o_orderdate) AS created_at",
    "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'processing' ELSE 'canceled' END AS state",
    "o_totalprice AS base_total_paid", "coalesce(sub, 0.0D) AS base_subtotal", "coalesce(disc, 0.0D) AS base_discount_amount",
    "CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS customer_is_guest",
    "CASE WHEN o_custkey % 3 = 0 THEN 0L ELSE 1 + o_custkey % 9 END AS customer_group_id",
    """CASE WHEN o_custkey % 50 = 0 THEN NULL
            WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN concat('g', CAST(o_orderkey AS STRING), '@example.com')
            ELSE concat('c', CAST(o_custkey AS STRING), '@example.com') END AS customer_email""")
_SALES_ITEM = (
    "l_orderkey * 10 + l_linenumber AS item_id", "l_orderkey AS order_id", "l_partkey AS product_id",
    "concat('SKU-', CAST(l_partkey AS STRING)) AS sku", "l_quantity AS qty_ordered", "l_extendedprice / l_quantity AS base_price",
    "l_extendedprice AS base_row_total", "l_extendedprice * (1 + l_tax) AS base_row_total_incl_tax",
    "l_extendedprice * l_discount AS base_discount_amount",
    """CASE WHEN l_discount < 0.025D THEN NULL WHEN l_discount < 0.055D THEN CAST(l_suppkey AS STRING)
            WHEN l_discount < 0.085D THEN concat('c-', CAST(l_suppkey AS STRING), ', ', CAST((l_suppkey + l_partkey) % 10 AS STRING))
            ELSE concat('bad,', CAST(l_suppkey AS STRING), ',c-', CAST(l_suppkey AS STRING)) END AS applied_rule_ids""")
_FROM_DATE = "date_add(DATE'1998-11-01', CAST(s_suppkey * 11 % 700 AS INT))"
_PROMOTION = (
    "s_suppkey AS rule_id", "s_name AS name", f"{_FROM_DATE} AS from_date",
    f"CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE date_add({_FROM_DATE}, CAST(5 + s_suppkey % 60 AS INT)) END AS to_date",
    "CAST(10 + 5 * (s_suppkey % 6) AS DOUBLE) AS discount_amount", "CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 END AS is_active",
    "CASE WHEN s_suppkey % 3 = 0 THEN 0.0D ELSE abs(s_acctbal) / 100 END AS ctb_discount_amount",
    "s_suppkey % 5 * 20 AS ctb_units_used", "100 AS ctb_limit_units", "1000.0D AS ctb_limit_discount",
    "CASE WHEN s_suppkey % 7 = 0 THEN 0.0D ELSE abs(s_acctbal) END AS ctb_discount_used")
_PRODUCT = ("p_partkey AS entity_id", "date_add(DATE'1995-01-01', CAST(p_size * 60 AS INT)) AS created_at")
# One row of a part gives its rows: two categories and, but for every twentieth part, a brand.
_ATTRIBUTES = (
    "p_partkey AS entity_id",
    f"""inline(filter(array(named_struct('attribute_id', 168, 'value', {_OPTION}), named_struct('attribute_id', 80, 'value', {_OPTION}),
                            named_struct('attribute_id', 81, 'value', try_cast(substring(p_brand, 7) AS INT))),
                  a -> a.attribute_id <> 81 OR p_partkey % 20 <> 0))""")
_OPTIONS = (f"{_OPTION} AS option_id", "explode(array(0, 1)) AS store_id", "p_type AS value")


class LazyTables(Mapping):
    """Tables by name, each built when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def __or__(self, other: Mapping[str, DataFrame]) -> LazyTables:
        out = LazyTables(self._makers | {name: partial(other.__getitem__, name) for name in other})
        out._made = {name: df for name, df in self._made.items() if name not in other}
        return out


def shop_tables_from_tpch(spark: SparkSession, sf_dir: str) -> LazyTables:
    """Derive the six shop tables from orders/lineitem/part/supplier, those that are asked for."""
    source = partial(read_source, spark, sf_dir)

    def sales_order() -> DataFrame:
        # Order money: pre-aggregated per order before the join (map-side combine).
        money = source("lineitem").groupBy("l_orderkey").agg(
            F.expr("sum(l_extendedprice) AS sub"), F.expr("sum(l_extendedprice * l_discount) AS disc"))
        return source("orders").join(money, F.expr("o_orderkey = l_orderkey"), "left").selectExpr(*_SALES_ORDER)

    return LazyTables({
        "sales_order": sales_order,
        "sales_item": lambda: source("lineitem").selectExpr(*_SALES_ITEM),
        "promotion": lambda: source("supplier").selectExpr(*_PROMOTION),
        "product": lambda: source("part").selectExpr(*_PRODUCT),
        "product_attribute_int": lambda: source("part").selectExpr(*_ATTRIBUTES),
        # Two stores label every option: one row per (option, store) via explode, no join needed.
        "attribute_option": lambda: source("part").selectExpr(*_OPTIONS).distinct(),
    })
