"""Declared schemas, so that opening a table reads no file footer.

Fixed values: the columns of the shop tables (FIXTURES.md) and of the driver
tables they are derived from, as DDL text.
"""

from __future__ import annotations

SHOP_SCHEMAS = {
    "sales_order": (
        "entity_id BIGINT, increment_id STRING, created_at TIMESTAMP_NTZ, state STRING, base_total_paid DOUBLE, "
        "base_subtotal DOUBLE, base_discount_amount DOUBLE, customer_is_guest INT, customer_group_id BIGINT, customer_email STRING"),
    "sales_item": (
        "item_id BIGINT, order_id BIGINT, product_id BIGINT, sku STRING, qty_ordered DOUBLE, base_price DOUBLE, "
        "base_row_total DOUBLE, base_row_total_incl_tax DOUBLE, base_discount_amount DOUBLE, applied_rule_ids STRING"),
    "promotion": (
        "rule_id BIGINT, name STRING, from_date DATE, to_date DATE, discount_amount DOUBLE, is_active INT, "
        "ctb_discount_amount DOUBLE, ctb_units_used BIGINT, ctb_limit_units INT, ctb_limit_discount DOUBLE, ctb_discount_used DOUBLE"),
    "product": "entity_id BIGINT, created_at DATE",
    "product_attribute_int": "entity_id BIGINT, attribute_id INT, value INT",
    "attribute_option": "option_id INT, store_id INT, value STRING",
}

DRIVER_SCHEMAS = {
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
        "o_orderpriority STRING"),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
        "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
}
