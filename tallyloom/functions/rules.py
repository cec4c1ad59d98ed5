"""Promotion rule-id lists carried as comma text on order lines.

Two readings exist and both are kept:

- ``exact`` (SQL ``FIND_IN_SET``): a token matches a rule id only if it is
  exactly its decimal text; a line matches a rule at most once.
- ``parsed``: tokens are trimmed, a leading ``c-`` is dropped, tokens that are
  not integers are skipped, duplicates are kept ('5,c-5' is [5, 5]).

All of it is native higher-order-function code, no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import as_col

# One comma-separated token: optional spaces, optional "c-" prefix, optional
# spaces, a signed integer, optional spaces, then a comma or the end.
_RULE_TOKEN = r"(?:^|,)\s*(?:c-)?\s*([+-]?[0-9]+)\s*(?=,|$)"


def rule_tokens(ids: Column | str) -> Column:
    """Raw comma tokens; NULL text gives an empty array."""
    return F.split(F.coalesce(as_col(ids), F.lit("")), ",")


def exact_rule_tokens(ids: Column | str) -> Column:
    """Distinct raw tokens (what ``FIND_IN_SET`` can match)."""
    return F.array_distinct(F.filter(rule_tokens(ids), lambda t: t != F.lit("")))


def parse_rule_ids(ids: Column | str) -> Column:
    """'12,c-7, x' -> [12, 7]; NULL or '' -> []; duplicates kept.

    A single regular-expression pass extracts the tokens that are integers
    after trimming and dropping a leading ``c-``; other tokens are skipped.
    """
    found = F.regexp_extract_all(F.coalesce(as_col(ids), F.lit("")), F.lit(_RULE_TOKEN), F.lit(1))
    as_ids = F.transform(found, lambda t: t.try_cast("bigint"))
    return F.filter(as_ids, lambda x: x.isNotNull())


# Discount bucket edges (percent, inclusive upper bounds) and
# labels, in display order, followed by the label of the all-promotions row.
BUCKET_EDGES = ((15, "≤15%"), (20, "20%"), (25, "25%"), (30, "30%"))
BUCKET_TOP = "≥35%"
OVERALL = "Overall"
BUCKET_ORDER = tuple(label for _, label in BUCKET_EDGES) + (BUCKET_TOP, OVERALL)


def discount_bucket(discount: Column | str) -> Column:
    """Map a discount percentage to its bucket label."""
    d = as_col(discount)
    expr = None
    for edge, label in BUCKET_EDGES:
        expr = F.when(d <= edge, F.lit(label)) if expr is None else expr.when(d <= edge, F.lit(label))
    return expr.otherwise(F.lit(BUCKET_TOP))
