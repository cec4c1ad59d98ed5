"""Keyed result reuse across jobs, on shared storage.

``result_table`` returns a stored result when one exists for the same name and
arguments and is younger than ``max_age_hours``; otherwise it builds the
DataFrame, writes it as Parquet to a folder of its own under ``{root}/{key}`` and
then adds a record for it. The key holds the name, the arguments and ``source``,
which names the data read. Empty results are not stored. Reading the stored table
back also cuts the lineage of long plans.

Records are written once, under rising version numbers, and never changed: a
record is written beside its place and renamed into it, so it is there whole or
not at all, and the newest whole one counts. An interrupted build leaves the
version before in force; two builders at once add a version each. A rebuild
removes what is older than the maximum age plus ``GRACE_HOURS``, so a reader of
the version before keeps its files meanwhile (``result_expire`` does so for all
keys; ``result_invalidate`` removes at once).

``root`` must be a folder every executor can reach (the cluster's shared
storage, e.g. under ``spark.checkpoint.dir``), never a machine-local folder.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exports import file_stem

GRACE_HOURS = 24.0
RECORD, DATA = "record-", "data-"


def result_key(name: str, args: Mapping[str, object] | None = None, source: str = "") -> str:
    """Stable key: readable name prefix + md5 of name, arguments and data source."""
    payload = json.dumps([name, source, dict(args or {})], sort_keys=True, default=str)
    return f"{file_stem(name)[:60]}-{hashlib.md5(payload.encode()).hexdigest()}"


def default_root(spark: SparkSession) -> str:
    """``{checkpoint dir}/tallyloom-results`` (the shared folder the cluster names)."""
    ck = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not ck:
        raise ValueError("no spark.checkpoint.dir configured; pass root explicitly")
    return ck.rstrip("/") + "/tallyloom-results"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _listed(spark: SparkSession, base: str) -> list:
    """Names and times (UTC) of what lies in a folder, by name."""
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    return sorted((f.getPath().getName(), dt.datetime.fromtimestamp(f.getModificationTime() / 1000, dt.timezone.utc).replace(tzinfo=None))
                  for f in fs.listStatus(p))


def _add_record(spark: SparkSession, base: str, version: str, info: dict) -> None:
    fs, draft = _fs(spark, f"{base}/.{RECORD}{version}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(info).encode()))
    out.close()
    if not fs.rename(draft, _fs(spark, f"{base}/{RECORD}{version}")[1]):
        raise OSError(f"cannot add record {version} in {base}")


def _record(spark: SparkSession, base: str, name: str) -> dict | None:
    """A record's contents; None if it can't be read."""
    try:
        return json.loads(spark.read.text(f"{base}/{name}", wholetext=True).first()[0])
    except Exception:  # unreadable = not there
        return None


def _newest(spark: SparkSession, base: str) -> dict | None:
    """The newest readable record whose data is there."""
    for name, _ in reversed(_listed(spark, base)):
        if name.startswith(RECORD):
            info = _record(spark, base, name)
            if info is not None and _exists(spark, f"{base}/{info['data']}"):
                return info
    return None


def _now(now: dt.datetime | None) -> dt.datetime:
    return now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def result_table(spark: SparkSession, root: str | None, name: str, args: Mapping[str, object] | None,
                 build: Callable[[], DataFrame], max_age_hours: float = 24.0,
                 now: dt.datetime | None = None, source: str = "") -> DataFrame:
    """Fresh stored result for (name, args, source), else build, store and return it.

    ``source`` names the data the result is built from (a path and its version)."""
    root = root or default_root(spark)
    base = f"{root.rstrip('/')}/{result_key(name, args, source)}"
    now = _now(now)
    known = _newest(spark, base)
    if known is not None and now - dt.datetime.fromisoformat(known["built_at"]) <= dt.timedelta(hours=max_age_hours):
        return spark.read.parquet(f"{base}/{known['data']}")
    df = build()
    # Write the data once and check the written copy (cheap) instead of
    # computing the result twice; empty results are not kept.
    last = max([int(n[len(RECORD):].split("-")[0]) for n, _ in _listed(spark, base) if n.startswith(RECORD)], default=0)
    version = f"{last + 1:010d}-{uuid.uuid4().hex}"
    data = f"{base}/{DATA}{version}"
    df.write.parquet(data)
    stored = spark.read.schema(df.schema).parquet(data)
    if stored.isEmpty():
        fs, p = _fs(spark, data)
        fs.delete(p, True)
        return df.where(F.lit(False))
    _add_record(spark, base, version, {"name": name, "args": json.dumps(dict(args or {}), sort_keys=True, default=str),
                                       "built_at": now.isoformat(), "data": DATA + version})
    _expire(spark, base, now, max_age_hours + GRACE_HOURS)
    return stored


def _expire(spark: SparkSession, base: str, now: dt.datetime, hours: float) -> int:
    """Remove versions built over ``hours`` ago, but the newest, and remains of builds that ended without a record."""
    listed, limit = _listed(spark, base), now - dt.timedelta(hours=hours)
    records = [n for n, _ in listed if n.startswith(RECORD)]
    gone = 0
    for name, written in listed:
        version = name.lstrip(".").split("-", 1)[-1]
        own = RECORD + version
        if own in records:  # the data goes first, so a record without data is what an interruption leaves
            info = _record(spark, base, own)
            old = own != records[-1] and (info is None or dt.datetime.fromisoformat(info["built_at"]) < limit)
        else:
            old = name.lstrip(".").startswith((RECORD, DATA)) and written < limit
        if old:
            fs, p = _fs(spark, f"{base}/{name}")
            gone += bool(fs.delete(p, True))
    return gone


def result_expire(spark: SparkSession, root: str | None, max_age_hours: float = 24.0, grace_hours: float = GRACE_HOURS,
                  now: dt.datetime | None = None) -> int:
    """Remove versions past the maximum age plus the grace time from all keys; how many folders and records went."""
    root = root or default_root(spark)
    return sum(_expire(spark, f"{root.rstrip('/')}/{key}", _now(now), max_age_hours + grace_hours)
               for key, _ in _listed(spark, root))


def result_invalidate(spark: SparkSession, root: str | None, name: str | None = None,
                      args: Mapping[str, object] | None = None, source: str = "") -> bool:
    """Drop one stored result (name, args, source) or, with no name, all of them."""
    root = root or default_root(spark)
    target = root if name is None else f"{root.rstrip('/')}/{result_key(name, args, source)}"
    fs, p = _fs(spark, target)
    if not fs.exists(p):
        return False
    return bool(fs.delete(p, True))
