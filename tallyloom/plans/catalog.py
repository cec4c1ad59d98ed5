"""Named, parameterised queries: call by name with a dict of arguments.

``run_sql`` is the parameterised-SQL path: Spark binds the values (no string
formatting of user values into SQL) and the shop tables, which the text names like
any table. No view of the session is made or replaced, so a user's own view of the
same name stays, and threads with different tables don't meet.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..sources import exports
from . import facts, named

QueryFn = Callable[..., DataFrame]

CATALOG: dict[str, QueryFn] = {
    "monthly_sales_trend": named.monthly_sales_trend,
    "sales_by_day_hour": named.sales_by_day_hour,
    "campaign_timings": named.campaign_timings,
    "promotion_details": named.promotion_details,
    "promotion_duration_stats": named.promotion_duration_stats,
    "category_seasonality": named.category_seasonality,
    "promotion_impact": named.promotion_impact,
    "product_counts_year": named.product_counts_year,
    "product_counts_cross_year": named.product_counts_cross_year,
    "item_sales_fact": facts.item_sales_fact,
    "item_sales_basic": partial(facts.item_sales_fact, detail="basic"),
}


def register(name: str, fn: QueryFn, catalog: dict[str, QueryFn] = CATALOG) -> None:
    """Extension point: add a named query."""
    catalog[name] = fn


def run_query(T: dict[str, DataFrame], name: str, args: Mapping[str, object] | None = None,
              catalog: Mapping[str, QueryFn] = CATALOG) -> DataFrame:
    """Look up ``name`` and call it with ``args``; unknown names raise KeyError."""
    if name not in catalog:
        raise KeyError(f"unknown query {name!r}; known: {sorted(catalog)}")
    return catalog[name](T, **dict(args or {}))


def export_query(T: dict[str, DataFrame], name: str, out_dir: str, args: Mapping[str, object] | None = None,
                 fmt: str = "csv", when: dt.datetime | None = None,
                 catalog: Mapping[str, QueryFn] = CATALOG) -> str | None:
    """Run a named query and export its result, named after the query.

    ``fmt``: csv, json, or csv+metadata (a block naming query and arguments above
    the rows). Returns the path, or None for an empty result.
    """
    df = run_query(T, name, args, catalog)
    if fmt == "csv":
        return exports.export_csv(df, out_dir, name, when)
    if fmt == "json":
        return exports.export_json(df, out_dir, name, when)
    if fmt == "csv+metadata":
        return exports.export_with_metadata(df, out_dir, name, dict(args or {}), name, when)
    raise ValueError(f"unknown export format {fmt!r}")


# Quoted text and comments, which hold no placeholder, or a placeholder.
_MARKS = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|%s""", re.DOTALL)


def run_sql(spark: SparkSession, T: dict[str, DataFrame], text: str,
            params: Mapping[str, object] | Sequence[object] | None = None) -> DataFrame:
    """Run SQL text over the shop tables with bound parameters.

    Named parameters use ``:name``; positional ones may be written ``?`` or
    the DB-API ``%s`` (rewritten to ``?`` outside quoted text and comments). The
    text is one query; a table of ``T`` hides a view or table of that name in it.
    """
    if params is not None and not isinstance(params, Mapping):
        text, params = _MARKS.sub(lambda m: "?" if m[0] == "%s" else m[0], text), list(params)
    elif params is not None:
        params = dict(params)
    used = {n: T[n] for n in T if re.search(rf"\b{re.escape(n)}\b", text, re.IGNORECASE)}
    if not used:
        return spark.sql(text, args=params)
    heads = ", ".join(f"`{n}` AS (SELECT * FROM {{{n}}})" for n in used)
    body = text.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    return spark.sql(f"WITH {heads}\n(\n{body}\n)", args=params, **used)  # an inner WITH may follow
