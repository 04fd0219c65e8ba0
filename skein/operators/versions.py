"""Time travel, change capture, expiry, visibility and quotas over log tables.

A log holds (version, type, id, data, ts) rows, type being insert, update or delete and data the new value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of_version(log: DataFrame, version: int) -> DataFrame:
    """(id, data) of the rows that are live at a version: the last entry of each id, if no deletion. One shuffle, combined on the map side."""
    last = log.filter(F.col("version") <= version).groupBy("id").agg(F.max_by(F.struct("type", "data"), "version").alias("last"))
    return last.filter("last.type != 'delete'").select("id", "last.data")


def as_of_timestamp(log: DataFrame, ts) -> DataFrame:
    last = log.filter(F.col("ts") <= ts).groupBy("id").agg(F.max_by(F.struct("type", "data"), F.struct("ts", "version")).alias("last"))
    return last.filter("last.type != 'delete'").select("id", "last.data")


def count_at_version(log: DataFrame, version: int) -> DataFrame:
    return as_of_version(log, version).agg(F.count(F.lit(1)).alias("count"))


def list_versions(log: DataFrame) -> DataFrame:
    return log.select("version", "type", "id", "ts").orderBy("version")


def collect_garbage(log: DataFrame, max_versions: int = 1000, keep: int = 100) -> DataFrame:
    """The log itself while it has at most max_versions entries, else its newest `keep`."""
    size = log.agg(F.count(F.lit(1)).alias("n"))
    first = log.orderBy(F.desc("version")).limit(keep).agg(F.min("version").alias("first"))
    edge = size.crossJoin(first)  # one row
    return log.crossJoin(F.broadcast(edge)).filter((F.col("n") <= max_versions) | (F.col("version") >= F.col("first"))).select(*log.columns)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change) between two states (id, data): added, removed or modified."""
    a, b = old.select("id", F.col("data").alias("a"), F.lit(1).alias("in_a")), new.select("id", F.col("data").alias("b"), F.lit(1).alias("in_b"))
    kind = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, "id", "full_outer").select("id", kind.alias("change")).filter("change IS NOT NULL")


def replay(base: DataFrame, log: DataFrame) -> DataFrame:
    """base (id, data) after a log: rows without entries stay, the others take their last entry."""
    last = log.groupBy("id").agg(F.max_by(F.struct("type", "data"), "version").alias("last"))
    met = base.select("id", F.col("data").alias("old")).join(last, "id", "full_outer")
    return met.filter("last IS NULL OR last.type != 'delete'").select("id", F.when(F.col("last").isNull(), F.col("old")).otherwise(F.col("last.data")).alias("data"))


def changes_since(log: DataFrame, cursor: int, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Entries from a cursor on, in order; nothing is lost, however old the cursor."""
    hit = log.filter(F.col("version") >= cursor)
    return hit.filter(F.col("type").isin(*kinds)) if kinds else hit


def visible(created: Column, deleted: Column, reader: int, committed: Column) -> Column:
    """Snapshot isolation: created by a committed transaction before the reader (or by itself), and not so deleted."""
    born = (created == reader) | ((created < reader) & committed)
    gone = deleted.isNotNull() & ((deleted == reader) | (deleted < reader))
    return born & ~gone


def live(df: DataFrame, now: Column, expires: str = "expire_at") -> DataFrame:
    """Rows that haven't expired; a null expiry never does."""
    return df.filter(F.col(expires).isNull() | (F.col(expires) > now))


def expiring_before(df: DataFrame, t: Column, expires: str = "expire_at") -> DataFrame:
    return df.filter(F.col(expires) < t)


def remaining_seconds(now: Column, expires: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(expires) - F.unix_timestamp(now))


def compare_and_set(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, version, data, status) after updates (id, expected, data) that only hold where the version is as expected."""
    w = wanted.select("id", "expected", F.col("data").alias("new_data"))
    met = table.join(w, "id", "left")
    ok = F.col("expected") == F.col("version")
    status = F.when(F.col("expected").isNull(), "untouched").when(ok, "updated").otherwise("conflict")
    return met.select("id", F.when(ok, F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.when(ok, F.col("new_data")).otherwise(F.col("data")).alias("data"), status.alias("status"))


def quota_violations(usage: DataFrame, limits: Mapping[str, int], default: int) -> DataFrame:
    """(tenant, used, allowed) of tenants over their limit, from rows (tenant)."""
    allowed = F.lit(default)
    for tenant, n in limits.items():
        allowed = F.when(F.col("tenant") == tenant, F.lit(n)).otherwise(allowed)
    return usage.groupBy("tenant").agg(F.count(F.lit(1)).alias("used")).withColumn("allowed", allowed).filter("used > allowed")


def next_tier(current: Column, vectors: Column, memory: Column, idle: Column, limits: Mapping[str, tuple[int, int]]) -> Column:
    """One step: shared or dedicated tenants over their (vectors, memory) limit go up; idle ones under half of the limit below go down."""

    def over(name: str) -> Column:
        return (vectors > limits[name][0]) | (memory > limits[name][1])

    def under(name: str) -> Column:
        return idle & (vectors < limits[name][0] * 0.5) & (memory < limits[name][1] * 0.5)

    return (
        F.when((current == "shared") & over("shared"), "dedicated")
        .when((current == "dedicated") & over("dedicated"), "premium")
        .when((current == "dedicated") & under("shared"), "shared")
        .when((current == "premium") & under("dedicated"), "dedicated")
        .otherwise(current)
    )


def consistent(level: str, lag_ms: Column, position: Column, max_lag_ms: int = 0, token: int = 0) -> Column:
    """Whether a replica may answer: strong, eventual, bounded (by lag) or session (by position)."""
    return {"strong": lag_ms == 0, "eventual": F.lit(True), "bounded": lag_ms <= max_lag_ms, "session": position >= token}[level]


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key (ties: any whole row, the greatest)."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_sk_rank", rank).filter("_sk_rank = 1").drop("_sk_rank")
