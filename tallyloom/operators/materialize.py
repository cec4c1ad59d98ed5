"""Materialise a DataFrame that several branches of one plan read.

Spark recomputes a forked lineage once per branch (a self-join or two
aggregates over the same rows scan the sources twice). Where a fork is
inherent and its input is large, the input is checkpointed once to the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir`` (reliable
storage: the job survives executor loss, and the lineage is cut). This runs a
job while the plan is built, so it is only done where the caller asks for it, on
the columns the caller selected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def materialize(df: DataFrame, enabled: bool) -> DataFrame:
    """``df.checkpoint(eager=True)`` when enabled, else ``df`` unchanged."""
    if not enabled:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
