"""Sales KPIs, monthly series and growth.

Per-period tables have one row per calendar period, so windows over them
(``lag``) are bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_label, period_label
from ..functions.money import money_sum


def kpi_revenue_quantity(sales: DataFrame) -> DataFrame:
    """One row: total net revenue and total quantity (0 on empty input)."""
    return sales.agg(
        F.coalesce(money_sum("sales_amount"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(money_sum("qty_ordered"), F.lit(0.0)).alias("total_quantity"))


def monthly_units_sales(sales: DataFrame) -> DataFrame:
    """Per 'yyyy-MM': units and net sales."""
    return (sales.groupBy(month_label("order_date").alias("year_month"))
                 .agg(money_sum("qty_ordered").alias("qty_ordered"),
                      money_sum("sales_amount").alias("sales_amount"))
                 .orderBy("year_month"))


def period_totals(sales: DataFrame, grain: str = "month", measure: str = "sales_amount") -> DataFrame:
    return sales.groupBy(period_label("order_date", grain).alias("period")) \
                .agg(money_sum(measure).alias(measure))


def growth_rate(sales: DataFrame, grain: str = "month", measure: str = "sales_amount") -> DataFrame:
    """Per present period: value, previous present period's value and percent
    growth. Missing periods are not filled; a zero previous value gives NULL."""
    p = period_totals(sales, grain, measure)
    w = Window.orderBy("period")  # one row per calendar period
    prev = F.lag(measure).over(w)
    return (p.withColumn("previous_sales", prev)
             .withColumn("growth_rate",
                         F.round(F.try_divide(F.col(measure) - F.col("previous_sales"),
                                              F.col("previous_sales")) * 100, 6))
             .orderBy("period"))
