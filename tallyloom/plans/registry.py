"""Registered queries over the driver's test tables.

Every entry takes ``(spark, sf_dir)``, derives the shop tables from the whole
driver tables (``shop_tables_from_tpch``) and runs one operator with the test
arguments of FIXTURES.md. Nothing here subsets rows: work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import weekday_rank, day_name
from ..operators.joins import interval_join, range_overlap_join
from ..operators.stats import cap_value
from ..sources.tables import shop_tables_from_tpch
from . import catalog, named

# Fixed test arguments (FIXTURES.md "Test arguments").
YEARS = (1999, 2000)
CATEGORIES = (601, 602)
AS_OF = "2001-12-31"
SALT = "test-salt"
SEED = 42
RANGES = (("1999", "1999-01-01", "1999-12-31"),
          ("2000", "2000-01-01", "2000-12-31"),
          ("1999-2000", "1999-01-01", "2000-12-31"))
PERIOD_START, PERIOD_END = "1999-01-01", "2000-12-31"

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
PLANS: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {}  # the same over any shop tables
FLAGSHIP = "promotion_metrics"


def query(name: str):
    def deco(fn: Callable[[dict[str, DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(shop_tables_from_tpch(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name], PLANS[name] = run, fn
        return fn
    return deco


# ---------------------------------------------------------------- step 1
@query("src_tables")
def _src_tables(T):
    """The mapped order table, whole."""
    return T["sales_order"]


@query("sql_params")
def _sql_params(T):
    spark = T["sales_order"].sparkSession
    return catalog.run_sql(spark, T, """
        SELECT date_format(created_at, 'yyyy-MM') AS month, COUNT(entity_id) AS order_count,
               CAST(ROUND(SUM(CAST(base_total_paid AS DECIMAL(28,8))), 4) AS DOUBLE) AS total_revenue
        FROM sales_order WHERE state = :state AND base_total_paid >= :min_paid
        GROUP BY date_format(created_at, 'yyyy-MM')""",
        {"state": "processing", "min_paid": 1000})


CATALOG_ARGS = {
    "monthly_sales_trend": {"state": "complete"}, "sales_by_day_hour": {}, "campaign_timings": {"as_of": AS_OF},
    "promotion_details": {"start": PERIOD_START, "end": PERIOD_END}, "promotion_duration_stats": {"ranges": RANGES},
    "category_seasonality": {"attribute_id": 80}, "promotion_impact": {"as_of": AS_OF},
    "product_counts_year": {"year": YEARS[0], "category_ids": CATEGORIES},
    "product_counts_cross_year": {"years": YEARS, "category_ids": CATEGORIES},
    "item_sales_fact": {"category_ids": CATEGORIES, "salt": SALT}, "item_sales_basic": {"category_ids": CATEGORIES, "salt": SALT},
}


@query("query_catalog")
def _query_catalog(T):
    """Every named query, called by name: its number of rows."""
    counts = [catalog.run_query(T, name, args).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("query"), "n_rows")
              for name, args in CATALOG_ARGS.items()]
    return reduce(DataFrame.unionByName, counts)


@query("monthly_sales_trend")
def _monthly_sales_trend(T):
    return named.monthly_sales_trend(T)


@query("sales_by_day_hour")
def _sales_by_day_hour(T):
    return named.sales_by_day_hour(T)


@query("order_custom")
def _order_custom(T):
    """Weekday-name ordering key (FIELD-style custom order)."""
    o = T["sales_order"].filter(F.col("state") == "complete")
    return (o.groupBy(day_name("created_at").alias("day_of_week"),
                      F.hour("created_at").alias("hour_of_day"))
             .agg(F.count("*").alias("_n"))
             .select("day_of_week", "hour_of_day", weekday_rank("day_of_week").alias("day_rank"))
             .orderBy("day_rank", "hour_of_day"))


@query("campaign_timings")
def _campaign_timings(T):
    return named.campaign_timings(T, AS_OF)


@query("promotion_details")
def _promotion_details(T):
    return named.promotion_details(T, PERIOD_START, PERIOD_END)


@query("promotion_duration_stats")
def _promotion_duration_stats(T):
    return named.promotion_duration_stats(T, RANGES)


@query("join_range_overlap")
def _join_range_overlap(T):
    spark = T["promotion"].sparkSession
    dr = named.date_ranges(spark, RANGES)
    return range_overlap_join(T["promotion"], dr, "from_date", "to_date",
                              "start_date", "end_date").select("rule_id", "label")


@query("join_range_overlap_many")
def _join_range_overlap_many(T):
    """Promotions against the order days as ranges: a range for each day and customer group, of one to six weeks."""
    day, group = F.to_date("created_at"), F.coalesce("customer_group_id", F.lit(0))
    ranges = T["sales_order"].select(group.alias("range_group"), day.alias("start_date"),
                                     F.date_add(day, (7 + group * 4).cast("int")).alias("end_date")).distinct()
    pairs = interval_join(T["promotion"], ranges, "from_date", "to_date", "start_date", "end_date")
    # A group's least label is that of its first day, so pairs are combined by numbers and days, which a hash
    # aggregate holds; a least text would sort all pairs of a task first.
    groups = pairs.groupBy("rule_id", "range_group").agg(F.count("*").alias("n"), F.min("start_date").alias("first_day"),
                                                         F.max("end_date").alias("last_day"))
    label = F.concat_ws(":", "range_group", F.date_format("first_day", "yyyy-MM-dd"))
    return groups.groupBy("rule_id").agg(F.sum("n").alias("n_ranges"), F.min(label).alias("first_label"),
                                         F.max("last_day").alias("last_day"))


# ---------------------------------------------------------------- step 2
from . import facts, products, sales  # noqa: E402
from ..functions.predicates import exclude_channels  # noqa: E402
from ..operators.joins import semi_join, token_membership_join  # noqa: E402
from ..functions.rules import exact_rule_tokens  # noqa: E402


def fact(T):
    return facts.item_sales_fact(T, CATEGORIES, SALT)


def sales_lines(T, *reuse: str):
    """The filtered sales lines used by the analytics pages (years,
    categories); the fact prunes orders by year at the scan. With columns named
    in ``reuse``, just these are checkpointed, for operators that read the lines
    several times."""
    from ..operators.materialize import materialize
    lines = facts.apply_filters(facts.item_sales_fact(T, CATEGORIES, SALT, years=YEARS),
                                categories=CATEGORIES, years=YEARS)
    return materialize(lines.select(*reuse), True) if reuse else lines


@query("item_sales_fact")
def _item_sales_fact(T):
    return fact(T)


@query("item_sales_basic")
def _item_sales_basic(T):
    return facts.item_sales_fact(T, CATEGORIES, SALT, detail="basic")


@query("exclude_channels")
def _exclude_channels(T):
    return T["sales_order"].filter(exclude_channels("increment_id")).select("entity_id", "increment_id")


@query("filter_years")
def _filter_years(T):
    return facts.filter_years(fact(T), YEARS)


@query("filter_categories")
def _filter_categories(T):
    return facts.filter_categories(fact(T), [CATEGORIES[0]])


@query("filter_discount_free")
def _filter_discount_free(T):
    return facts.filter_discount_free(fact(T))


@query("filter_customer_type")
def _filter_customer_type(T):
    return facts.filter_customer_type(facts.filter_years(fact(T), YEARS), ["Guest"])


@query("filter_customer_status")
def _filter_customer_status(T):
    return facts.filter_customer_status(facts.filter_years(fact(T), YEARS), ["New"])


@query("apply_filters")
def _apply_filters(T):
    return facts.apply_filters(fact(T), categories=CATEGORIES, years=YEARS,
                               customer_types=["Registered"], customer_status=["Returning"])


@query("normalise_lines")
def _normalise_lines(T):
    """The fact with amounts as text, some of them no number, some missing."""
    item = F.col("item_id")
    text = fact(T).select(*[
        F.when(item % 7 == i, F.lit("n/a")).when(item % 11 == i, F.lit(None)).otherwise(F.col(c).cast("string")).alias(c)
        if (i := facts.NUMERIC_COLS.index(c) if c in facts.NUMERIC_COLS else -1) >= 0 else F.col(c) for c in facts.FACT_COLS])
    return facts.normalise_lines(text).withColumn("sales_amount", F.round("sales_amount", 6))


@query("require_columns")
def _require_columns(T):
    """Rows left when all wanted columns are there, and when one is missing."""
    wanted = ["sku", "order_id", "applied_rule_ids"]
    count = lambda df, case: facts.require_columns(df, wanted).agg(F.count("*").alias("n_rows")).select(
        F.lit(case).alias("case"), "n_rows")
    return count(fact(T), "present").unionByName(count(fact(T).drop("applied_rule_ids"), "missing"))


@query("join_isin_set")
def _join_isin_set(T):
    """Lines of the 50 top-revenue SKUs."""
    s = sales_lines(T)
    top = products.select_products(s, 50, "top")
    return semi_join(s, top.select("sku"), "sku")


# ---------------------------------------------------------------- step 3
@query("category_seasonality")
def _category_seasonality(T):
    return named.category_seasonality(T, 80)


@query("product_counts_year")
def _product_counts_year(T):
    return named.product_counts_year(T, YEARS[0], CATEGORIES)


@query("product_counts_cross_year")
def _product_counts_cross_year(T):
    return named.product_counts_cross_year(T, YEARS, CATEGORIES)


@query("join_semi_exists")
def _join_semi_exists(T):
    """Category products that exist by the first test year (EXISTS as semi join)."""
    return named._products_existing(T, CATEGORIES, YEARS[0], named.CATEGORY_ATTR)


@query("agg_conditional_distinct")
def _agg_conditional_distinct(T):
    return named.product_counts_year(T, YEARS[1], CATEGORIES)


@query("agg_multi_level")
def _agg_multi_level(T):
    return named.product_counts_cross_year(T, [YEARS[0] - 1, *YEARS], CATEGORIES)


@query("promotion_impact")
def _promotion_impact(T):
    return named.promotion_impact(T, AS_OF)


@query("promotion_impact_parsed")
def _promotion_impact_parsed(T):
    return named.promotion_impact(T, AS_OF, match="parsed", per_order=True)


@query("join_token_membership")
def _join_token_membership(T):
    """(line, rule) pairs whose rule text holds the rule id as a token."""
    lines = T["sales_item"].select("item_id", "order_id", "applied_rule_ids")
    return token_membership_join(lines, T["promotion"].select("rule_id"),
                                 exact_rule_tokens("applied_rule_ids"), "rule_id").select(
        "item_id", "order_id", "rule_id")


@query("kpi_revenue_quantity")
def _kpi_revenue_quantity(T):
    return sales.kpi_revenue_quantity(sales_lines(T))


@query("kpi_products")
def _kpi_products(T):
    counts = facts.filter_categories(named.product_counts_cross_year(T, YEARS, CATEGORIES), CATEGORIES)
    return products.kpi_products(counts, sales_lines(T))


@query("monthly_units_sales")
def _monthly_units_sales(T):
    return sales.monthly_units_sales(sales_lines(T))


@query("growth_rate_month")
def _growth_rate_month(T):
    return sales.growth_rate(sales_lines(T), "month")


@query("growth_rate_quarter")
def _growth_rate_quarter(T):
    return sales.growth_rate(sales_lines(T), "quarter")


# ---------------------------------------------------------------- step 5
@query("select_products_top")
def _select_products_top(T):
    return products.select_products(sales_lines(T), 150, "top")


@query("select_products_bottom")
def _select_products_bottom(T):
    return products.select_products(sales_lines(T), 150, "bottom")


@query("select_products_random")
def _select_products_random(T):
    return products.select_products(sales_lines(T), 150, "random", seed=SEED)


@query("select_products_gross")
def _select_products_gross(T):
    return products.select_products(sales_lines(T), 300, "top", measure="gross")


@query("gap_days")
def _gap_days(T):
    return products.gap_days(sales_lines(T))


@query("rotation_metrics")
def _rotation_metrics(T):
    """Rotation over every SKU of the filtered lines."""
    return products.rotation_metrics(sales_lines(T))


@query("rotation_variance")
def _rotation_variance(T):
    m = products.rotation_metrics(sales_lines(T))
    return products.rotation_variance(m, "quantity").select("sku", "coefficient_of_variation", "std_deviation")


def _rotation_selected(T, n):
    s = sales_lines(T, "sku", "order_date", "qty_ordered", "base_price", "sales_amount")
    return products.rotation_metrics(s, products.select_products(s, n, "top"))


@query("rotation_distribution")
def _rotation_distribution(T):
    return products.rotation_distribution(_rotation_selected(T, 300))


@query("rotation_outliers")
def _rotation_outliers(T):
    return products.rotation_outliers(_rotation_selected(T, 300))


@query("rotation_bubble")
def _rotation_bubble(T):
    return products.rotation_bubble(_rotation_selected(T, 150), "days")


# ---------------------------------------------------------------- step 4
from . import basket, promotions, sensitivity  # noqa: E402
from ..operators.materialize import materialize  # noqa: E402
from ..functions.rules import discount_bucket, parse_rule_ids  # noqa: E402
from ..operators.stats import relative_size  # noqa: E402

N_PROMOTIONS = 150  # promotions per chart (source default)
N_BASKET = 15       # items per basket (source default)
N_SENSITIVITY = 300  # products per sensitivity chart (source default)


def metrics(T):
    return promotions.promotion_metrics(sales_lines(T), T["promotion"])


@query("parse_rule_ids")
def _parse_rule_ids(T):
    ids = parse_rule_ids("applied_rule_ids")
    return T["sales_item"].select(
        "applied_rule_ids",
        F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("rule_ids"),
        F.size(ids).alias("n_rules"))


@query("promotion_metrics")
def _promotion_metrics(T):
    return metrics(T)


@query("promotion_metrics_original_price")
def _promotion_metrics_original_price(T):
    """Lines that carry an original price: it gives the average price."""
    return promotions.promotion_metrics(sales_lines(T).withColumn(
        "base_original_price", F.when(F.col("item_id") % 5 > 0, F.col("base_price") + 1)), T["promotion"])


@query("promotion_revenue")
def _promotion_revenue(T):
    return promotions.promotion_revenue(sales_lines(T), T["promotion"])


@query("promotion_avg_original_price")
def _promotion_avg_original_price(T):
    s = sales_lines(T).withColumn("base_original_price", F.col("base_price"))
    return promotions.promotion_avg_original_price(s, metrics(T))


@query("select_promotions_top")
def _select_promotions_top(T):
    return promotions.select_promotions(metrics(T), N_PROMOTIONS, "top")


@query("select_promotions_lowest")
def _select_promotions_lowest(T):
    return promotions.select_promotions(metrics(T), N_PROMOTIONS, "lowest")


@query("select_promotions_random")
def _select_promotions_random(T):
    return promotions.select_promotions(metrics(T), N_PROMOTIONS, "random", SEED)


@query("promotion_bubble")
def _promotion_bubble(T):
    return promotions.promotion_bubble(promotions.select_promotions(metrics(T), N_PROMOTIONS, "top"),
                                       "discount_amount", "units_sold_per_day")


@query("floor_positive")
def _floor_positive(T):
    """Lines with a positive net amount; every third line was refunded twice over."""
    net = F.col("sales_amount") - F.when(F.col("item_id") % 3 == 0, 2 * F.col("base_row_total_incl_tax")).otherwise(0.0)
    return sales_lines(T).withColumn("sales_amount", F.round(net, 6)).filter(F.col("sales_amount") > 0)


@query("join_merge_left")
def _join_merge_left(T):
    att = promotions.attribution(sales_lines(T), T["promotion"])
    return att.select("rule_id", F.round("revenue_dec", 4).cast("double").alias("revenue"),
                      "order_count").join(T["promotion"].select("rule_id", "name", "discount_amount"),
                                          "rule_id", "left")


@query("relative_size")
def _relative_size(T):
    return relative_size(metrics(T), "revenue", "revenue_rel").select(
        "rule_id", F.round("revenue_rel", 6).alias("revenue_rel"))


@query("kpi_promotions")
def _kpi_promotions(T):
    stats = named.promotion_duration_stats(T, RANGES)
    details = named.promotion_details(T, PERIOD_START, PERIOD_END)
    return promotions.kpi_promotions(stats, details, RANGES[0][0], RANGES[0][1], RANGES[0][2])


@query("kpi_promotions_combined")
def _kpi_promotions_combined(T):
    stats = named.promotion_duration_stats(T, RANGES)
    details = named.promotion_details(T, PERIOD_START, PERIOD_END)
    return promotions.kpi_promotions(stats, details, RANGES[2][0])


# ---------------------------------------------------------------- step 6
def basket_items(T, key="sku"):
    s = sales_lines(T, "order_id", key, "sales_amount")
    return s, products.select_products(s, N_BASKET, "top", key=key)


@query("basket_item_support")
def _basket_item_support(T):
    return basket.basket_item_support(sales_lines(T))


@query("basket_pairs")
def _basket_pairs(T):
    s, chosen = basket_items(T)
    return basket.basket_pairs(s, chosen, reuse=True)


@query("basket_pairs_brand")
def _basket_pairs_brand(T):
    s, chosen = basket_items(T, "brand_id")
    return basket.basket_pairs(s, chosen, item="brand_id", reuse=True)


@query("basket_pairs_salted")
def _basket_pairs_salted(T):
    s, chosen = basket_items(T, "brand_id")
    return basket.basket_pairs(s, chosen, item="brand_id", salted=True, reuse=True)


@query("join_self_pairs")
def _join_self_pairs(T):
    s, chosen = basket_items(T)
    return basket.pair_counts(s, chosen)


@query("top_partners")
def _top_partners(T):
    s, chosen = basket_items(T, "brand_id")
    return basket.top_partners(basket.pair_counts(s, chosen, "brand_id"))


@query("basket_lift_display")
def _basket_lift_display(T):
    s, chosen = basket_items(T, "brand_id")
    return basket.basket_lift_display(materialize(basket.basket_pairs(s, chosen, item="brand_id", reuse=True), True))


@query("quantile_cap")
def _quantile_cap(T):
    s, chosen = basket_items(T, "brand_id")
    pairs = basket.basket_pairs(s, chosen, item="brand_id", reuse=True)
    return cap_value(pairs, "lift").select(F.col("cap").alias("lift_cap"))


# ---------------------------------------------------------------- step 7
def sensitivity_products(s):
    return products.select_products(s, N_SENSITIVITY, "top", measure="gross")


@query("max_rule_discount")
def _max_rule_discount(T):
    return sensitivity.max_rule_discount(sales_lines(T), T["promotion"]).select(
        "sku", "order_id", "item_id", "applied_rule_ids", "max_discount", "has_rules")


@query("discount_bucket")
def _discount_bucket(T):
    return sensitivity.max_rule_discount(sales_lines(T), T["promotion"]).select(
        "sku", "order_id", "item_id", "max_discount", discount_bucket("max_discount").alias("discount_bucket"))


@query("join_map_lookup")
def _join_map_lookup(T):
    texts = T["sales_item"].select("applied_rule_ids").distinct()
    tok = texts.select("applied_rule_ids", F.explode(parse_rule_ids("applied_rule_ids")).alias("rule_id"))
    from ..operators.joins import lookup_join
    return lookup_join(tok, sensitivity.rule_discount_lookup(T["promotion"]), "rule_id", {"discount": 0.0})


SENSITIVITY_COLS = ("sku", "order_date", "qty_ordered", "applied_rule_ids", "base_row_total_incl_tax", "sales_amount")


def _sensitivity(T):
    s = sales_lines(T, *SENSITIVITY_COLS)
    return sensitivity.discount_sensitivity(s, T["promotion"], sensitivity_products(s))


@query("discount_sensitivity")
def _discount_sensitivity(T):
    return _sensitivity(T)


@query("fill_missing_buckets")
def _fill_missing_buckets(T):
    return _sensitivity(T).filter(F.col("promo_days") == 0)


@query("promo_only_products")
def _promo_only_products(T):
    s = sales_lines(T, *SENSITIVITY_COLS)
    return sensitivity.promo_only_products(s, T["promotion"], sensitivity_products(s))


@query("sensitivity_distribution")
def _sensitivity_distribution(T):
    return sensitivity.sensitivity_distribution(_sensitivity(T))


# ---------------------------------------------------------------- step 8
from . import decompose  # noqa: E402


@query("seasonal_decompose")
def _seasonal_decompose(T):
    """Multiplicative (the pages' default model), one series."""
    return decompose.seasonal_decompose(sales_lines(T), "multiplicative")


@query("seasonal_decompose_additive")
def _seasonal_decompose_additive(T):
    return decompose.seasonal_decompose(sales_lines(T), "additive")


@query("seasonal_decompose_by_category")
def _seasonal_decompose_by_category(T):
    """Additive, one series per category, over every year of the fact."""
    return decompose.seasonal_decompose(facts.add_sales_amount(fact(T)), "additive",
                                        series_cols=["category_num"])


@query("moving_trend")
def _moving_trend(T):
    return decompose.moving_trend(sales_lines(T))


# ---------------------------------------------------------------- step 9
import datetime as _dt  # noqa: E402
import uuid as _uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources import exports, results  # noqa: E402

EXPORT_TIME = _dt.datetime(2001, 12, 31, 12, 0, 0)


def _scratch(spark, kind: str) -> str:
    """A fresh folder under the shared checkpoint folder, removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tallyloom-{kind}/{_uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


@query("result_table")
def _result_table(T):
    spark = T["sales_order"].sparkSession
    root = _scratch(spark, "results")
    build = lambda: named.monthly_sales_trend(T)
    store = lambda: results.result_table(
        spark, root, "monthly_sales_trend", {"state": "complete"}, build, source="driver tables")
    store()
    return store()  # the second call is served from the stored table


@query("result_invalidate")
def _result_invalidate(T):
    spark = T["sales_order"].sparkSession
    root = _scratch(spark, "results")
    build = lambda: named.sales_by_day_hour(T)
    results.result_table(spark, root, "sales_by_day_hour", None, build)
    results.result_invalidate(spark, root, "sales_by_day_hour")
    return results.result_table(spark, root, "sales_by_day_hour", None, build)


@query("export_csv")
def _export_csv(T):
    spark = T["sales_order"].sparkSession
    df = sales.monthly_units_sales(sales_lines(T))
    path = exports.export_csv(df, _scratch(spark, "exports"), "monthly units", EXPORT_TIME)
    return spark.read.schema(df.schema).option("header", True).csv(path)


@query("export_csv_text")
def _export_csv_text(T):
    """The files' own text, number by number, of totals of every size."""
    spark = T["sales_order"].sparkSession
    df = named.monthly_sales_trend(T).select(
        "month", "total_revenue", (F.col("total_revenue") * 1e3).alias("thousandfold"),
        F.when(F.col("month") < "1996", F.col("total_revenue")).alias("some"))
    path = exports.export_csv(df, _scratch(spark, "exports"), "raw", EXPORT_TIME)
    return spark.read.schema(", ".join(f"{c} string" for c in df.columns)).option("header", True).csv(path)


@query("export_json")
def _export_json(T):
    spark = T["sales_order"].sparkSession
    df = named.promotion_details(T, PERIOD_START, PERIOD_END)
    path = exports.export_json(df, _scratch(spark, "exports"), "promotion details", EXPORT_TIME)
    return spark.read.schema(df.schema).json(path)


@query("export_with_metadata")
def _export_with_metadata(T):
    spark = T["sales_order"].sparkSession
    df = named.monthly_sales_trend(T)
    path = exports.export_with_metadata(df, _scratch(spark, "exports"), "SELECT month, orders\nFROM sales",
                                        {"state": "complete"}, None, EXPORT_TIME)
    names = ["Metadata", "Value", *df.columns]
    return spark.read.schema(", ".join(f"`{c}` string" for c in names)).csv(path)


def _read_back(df, path, case):
    """(case, folder, n_rows) of an export, from the files it wrote; no rows for a path of None."""
    read = df.sparkSession.read.schema(df.schema).option("header", True)
    rows = read.csv(path).select(F.col("_metadata.file_path").alias("file")) if path else df.select(
        F.lit(None).cast("string").alias("file")).where(F.lit(False))
    return rows.agg(F.max(F.element_at(F.split("file", "/"), -2)).alias("folder"), F.count("*").alias("n_rows")).select(
        F.lit(case).alias("case"), "folder", "n_rows")


@query("export_naming")
def _export_naming(T):
    """Folder names of exports named by hand, after the query text, and by default."""
    df = named.promotion_details(T, PERIOD_START, PERIOD_END)
    root = _scratch(df.sparkSession, "exports")
    cases = {"given": ("Résumé: 50% off/2000", None), "query": (None, "  SELECT *, max(x) FROM sales_order o\nWHERE 1"),
             "default": (None, None)}
    return reduce(DataFrame.unionByName, [
        _read_back(df, exports.export_csv(df, f"{root}/{case}", base, EXPORT_TIME, text), case)
        for case, (base, text) in cases.items()])


@query("export_empty")
def _export_empty(T):
    """An export without rows leaves nothing; the control beside it does."""
    root = _scratch(T["sales_order"].sparkSession, "exports")
    periods = {"empty": ("1900-01-01", "1900-12-31"), "control": (PERIOD_START, PERIOD_END)}
    return reduce(DataFrame.unionByName, [
        _read_back(df := named.promotion_details(T, *period), exports.export_csv(df, root, case, EXPORT_TIME), case)
        for case, period in periods.items()])


@query("filter_flags")
def _filter_flags(T):
    """Any/all flags of the filtered lines (years and categories as text)."""
    f = facts.filter_flags(sales_lines(T))
    return f.select(F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"),
                    F.array_join(F.transform("category_ids", lambda c: c.cast("string")), ",").alias("category_ids"),
                    "include_discounts", "has_guest", "has_registered", "has_new", "has_returning")


# ---------------------------------------------------------------- plain names
# The SURVEY keys with several variants above also answer to their plain name
# (the reference's defaults: monthly growth, top revenue).
QUERIES["growth_rate"] = QUERIES["growth_rate_month"]
QUERIES["select_products"] = QUERIES["select_products_top"]
QUERIES["select_promotions"] = QUERIES["select_promotions_top"]
