"""Classical seasonal decomposition of monthly sales (moving averages).

Textbook method with the options the dashboards use: period p = min(12, n//2)
over the n present months (missing months are not filled, positions count);
trend = centred moving average of width p (even p: half weights at both ends);
the p//2 undefined trend points at each end are extrapolated by a least-squares
line through the nearest p defined points (front: positions [f, min(f+p, b)),
back: [max(f, b-p), b), f/b = first/last defined position); seasonal = mean of
the detrended values at each position mod p, centred (additive: minus their
mean; multiplicative: divided by it); resid = the rest. Needs n >= 12 months;
multiplicative needs every value > 0. A series that fails a check gives no rows.

Plan: months are summed per series (a map-side-combined aggregate), then each
series becomes one row holding its months as an array — bounded by the
calendar, not by the data — and all arithmetic runs as higher-order array
functions inside the JVM. Several series (``series_cols``) decompose in
parallel, one row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_label
from ..functions.money import money_sum

# Output decimals: money-sized parts keep those of money, factors (multiplicative
# seasonal and residual) twice as many.
MONEY_DIGITS, RATIO_DIGITS = 4, 8


def monthly_series(sales: DataFrame, series_cols: Sequence[str] = (), measure: str = "sales_amount") -> DataFrame:
    """One row per series: ``pts`` = array of (month, value) sorted by month."""
    monthly = sales.groupBy(*series_cols, month_label("order_date").alias("month")) \
                   .agg(money_sum(measure).alias("value"))
    return monthly.groupBy(*series_cols).agg(
        F.array_sort(F.collect_list(F.struct("month", "value"))).alias("pts"))


def _trend_arrays(series: DataFrame, max_period: int) -> DataFrame:
    e = F.expr
    s = (series.withColumn("x", e("transform(pts, q -> q.value)"))
               .withColumn("months", e("transform(pts, q -> q.month)"))
               .withColumn("n", F.size("x"))
               .withColumn("p", F.least(F.lit(max_period), F.floor(F.col("n") / 2).cast("int")))
               .withColumn("h", F.floor(F.col("p") / 2).cast("int")))
    # centred moving average; NULL where the window does not fit
    s = s.withColumn("tr", e("""transform(sequence(0, n - 1), i ->
        CASE WHEN i >= h AND i <= n - 1 - h THEN
          (aggregate(slice(x, i - h + 1, 2 * h + 1), 0D, (a, v) -> a + v)
           - CASE WHEN p % 2 = 0 THEN 0.5 * (x[i - h] + x[i + h]) ELSE 0D END) / p
        END)"""))
    return s


def _fit(lo: str, hi: str, name: str) -> list[tuple[str, str]]:
    """Least-squares line through (j, tr[j]) for j in [lo, hi)."""
    js = f"sequence({lo}, {hi} - 1)"
    return [
        (f"{name}_mj", f"aggregate({js}, 0D, (a, j) -> a + j) / ({hi} - {lo})"),
        (f"{name}_mt", f"aggregate({js}, 0D, (a, j) -> a + tr[j]) / ({hi} - {lo})"),
        (f"{name}_k", f"aggregate({js}, 0D, (a, j) -> a + (j - {name}_mj) * (tr[j] - {name}_mt))"
                      f" / aggregate({js}, 0D, (a, j) -> a + (j - {name}_mj) * (j - {name}_mj))"),
        (f"{name}_c", f"{name}_mt - {name}_k * {name}_mj"),
    ]


def _decompose_arrays(series: DataFrame, model: str, max_period: int, min_periods: int) -> DataFrame:
    mult = model.startswith("m")
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model {model!r}")
    s = series.filter(F.size("pts") >= min_periods)
    if mult:
        s = s.filter(F.expr("forall(pts, q -> q.value > 0)"))
    s = _trend_arrays(s, max_period)
    s = s.withColumn("f", F.col("h")).withColumn("b", F.col("n") - 1 - F.col("h"))
    for name, expr in (_fit("f", "least(f + p, b)", "ff") + _fit("greatest(f, b - p)", "b", "bf")):
        s = s.withColumn(name, F.expr(expr))
    e = F.expr
    s = s.withColumn("trend", e("""transform(sequence(0, n - 1), i ->
        CASE WHEN i < f THEN ff_k * i + ff_c WHEN i > b THEN bf_k * i + bf_c ELSE tr[i] END)"""))
    op = "/" if mult else "-"
    s = s.withColumn("detr", e(f"transform(sequence(0, n - 1), i -> x[i] {op} trend[i])"))
    s = s.withColumn("pa", e("""transform(sequence(0, p - 1), r ->
        aggregate(filter(sequence(0, n - 1), j -> j % p = r), 0D, (a, j) -> a + detr[j])
        / size(filter(sequence(0, n - 1), j -> j % p = r)))"""))
    s = s.withColumn("pa_mean", e("aggregate(pa, 0D, (a, v) -> a + v) / p"))
    s = s.withColumn("sa", e(f"transform(pa, v -> v {op} pa_mean)"))
    s = s.withColumn("seasonal", e("transform(sequence(0, n - 1), i -> sa[i % p])"))
    resid = ("transform(sequence(0, n - 1), i -> x[i] / seasonal[i] / trend[i])" if mult
             else "transform(sequence(0, n - 1), i -> detr[i] - seasonal[i])")
    return s.withColumn("resid", e(resid))


def seasonal_decompose(sales: DataFrame, model: str = "multiplicative", max_period: int = 12,
                       min_periods: int = 12, series_cols: Sequence[str] = (),
                       measure: str = "sales_amount") -> DataFrame:
    """Rows (series..., month, idx, observed, trend, seasonal, resid, period)."""
    digits = RATIO_DIGITS if model == "multiplicative" else MONEY_DIGITS
    s = _decompose_arrays(monthly_series(sales, series_cols, measure), model, max_period, min_periods)
    z = s.select(*series_cols, "p", F.posexplode(F.arrays_zip("months", "x", "trend", "seasonal", "resid"))
                 .alias("idx", "r"))
    return z.select(*series_cols, F.col("r.months").alias("month"), "idx",
                    F.col("r.x").alias("observed"),
                    F.round("r.trend", MONEY_DIGITS).alias("trend"),
                    F.round("r.seasonal", digits).alias("seasonal"),
                    F.round("r.resid", digits).alias("resid"),
                    F.col("p").alias("period"))


def moving_trend(sales: DataFrame, max_period: int = 12, min_periods: int = 12,
                 series_cols: Sequence[str] = (), measure: str = "sales_amount") -> DataFrame:
    """The centred moving average alone (NULL at the ends, no extrapolation)."""
    s = monthly_series(sales, series_cols, measure).filter(F.size("pts") >= min_periods)
    s = _trend_arrays(s, max_period)
    z = s.select(*series_cols, F.posexplode(F.arrays_zip("months", "tr")).alias("idx", "r"))
    return z.select(*series_cols, F.col("r.months").alias("month"), "idx",
                    F.round("r.tr", MONEY_DIGITS).alias("trend"))
