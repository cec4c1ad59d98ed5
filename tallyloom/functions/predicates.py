"""Row predicates of the sales fact."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import as_col

# Fixed values of the source system: marketplace order-number prefixes and the
# customer groups that count as registered.
CHANNEL_PREFIXES = ("EBAY", "AMZ")
REGISTERED_GROUPS = (1, 2, 7, 8, 9)


def exclude_channels(increment_id: Column | str, prefixes: Iterable[str] = CHANNEL_PREFIXES) -> Column:
    """``increment_id NOT LIKE 'P%'`` for each prefix (NULL ids fail the test).

    Case-sensitive; ``startswith`` keeps it a pushable string-prefix filter.
    """
    c = as_col(increment_id)
    pred = F.lit(True)
    for p in prefixes:
        pred = pred & ~c.startswith(p)
    return pred


def is_guest(flag: Column | str = "customer_is_guest") -> Column:
    return as_col(flag) == 1


def is_registered(group: Column | str = "customer_group_id",
                  groups: Iterable[int] = REGISTERED_GROUPS) -> Column:
    return as_col(group).isin(list(groups))
