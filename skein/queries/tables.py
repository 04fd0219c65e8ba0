"""Collections, versions, change capture, expiry, quotas, streaming metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import versions as v
from skein.queries.common import LOG_SQL, change_log, collection, table, vectors
from skein.sources import collections as c
from skein.streaming.ingest import windowed


def as_of_version(spark, d):
    return v.as_of_version(change_log(spark, d), 5000)


def as_of_timestamp(spark, d):
    return v.as_of_timestamp(change_log(spark, d), F.lit("2024-01-15").cast("timestamp"))


def count_at_version(spark, d):
    return v.count_at_version(change_log(spark, d), 3000)


def version_diff(spark, d):
    log = change_log(spark, d)
    return v.compare(v.as_of_version(log, 4000), v.as_of_version(log, 8000))


def replay(spark, d):
    base = spark.range(0, 200).select("id", F.lit(-1.0).alias("data"))
    return v.replay(base, change_log(spark, d))


def garbage(spark, d):
    return v.collect_garbage(change_log(spark, d), 1000, 100).select("version", "type", "id")


def list_versions(spark, d):
    return v.list_versions(change_log(spark, d)).select("version", "type", "id")


def cdc_since(spark, d):
    return v.changes_since(change_log(spark, d), 9000, ("insert", "delete")).select("version", "type", "id")


def _ttl(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 > 0, F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("expire_at"))


NOW = "2024-01-20 12:00:00"


def ttl_live(spark, d):
    return v.live(_ttl(spark, d), F.lit(NOW).cast("timestamp")).select("event_id")


def ttl_remaining(spark, d):
    e = _ttl(spark, d).filter("expire_at IS NOT NULL")
    return e.select("event_id", v.remaining_seconds(F.lit(NOW).cast("timestamp"), F.col("expire_at")).alias("remaining"))


def ttl_expiring(spark, d):
    return v.expiring_before(_ttl(spark, d), F.lit("2024-01-10").cast("timestamp")).select("event_id")


def mvcc_visible(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 50).alias("born"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 60).alias("gone"))
    return e.filter(v.visible(F.col("born"), F.col("gone"), 30, F.col("born") % 9 != 0)).select("event_id")


def compare_and_set(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("version"), F.col("p_retailprice").alias("data"))
    w = p.filter("id % 3 = 0").select("id", F.lit(10).alias("expected"), F.lit(1.0).alias("data"))
    return v.compare_and_set(p, w)


def quotas(spark, d):
    u = table(spark, d, "orders").select(F.col("o_orderpriority").alias("tenant"))
    return v.quota_violations(u, {"1-URGENT": 10_000_000}, 100)


def tenant_tiers(spark, d):
    u = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    now = F.element_at(F.array(*map(F.lit, ("shared", "dedicated", "premium"))), (F.col("id") % 3 + 1).cast("int"))
    return u.select("id", v.next_tier(now, F.col("n"), F.col("n") * 10, F.col("id") % 2 == 0, {"shared": (12, 1000), "dedicated": (20, 190)}).alias("tier"))


def replicas(spark, d):
    e = table(spark, d, "events")
    lag, pos = F.col("event_id") % 100, F.col("event_id")
    return e.select("event_id", *(v.consistent(n, lag, pos, 20, 500).alias(n) for n in ("strong", "eventual", "bounded", "session")))


def upserted(spark, d):
    old = vectors(spark, d).select("id", "label")
    return c.upsert(old, spark.range(490, 520).select("id", F.lit(77).alias("label")))


def backup_roundtrip(spark, d):
    """A base without some rows and with others changed, brought up to date by its increment."""
    now = collection(spark, d)
    base = now.filter("id % 10 <> 0").withColumn("metadata", F.when(F.col("id") % 7 == 0, F.create_map(F.lit("label"), F.lit("old"))).otherwise(F.col("metadata")))
    inc = c.incremental(now.filter("id % 11 <> 0"), base)
    return c.restore(base, [inc]).select("id", F.col("metadata")["label"].alias("label"))


def latest_by_user(spark, d):
    return v.latest(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id")


def window_metrics(spark, d):
    """The streaming aggregation, over the table as one batch."""
    return windowed(table(spark, d, "events")).select(F.col("window_start").cast("date").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def dedup_contents(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def asof(version: str) -> str:
    return f"SELECT id, data FROM (SELECT id, arg_max(type, version) AS t, arg_max(data, version) AS data FROM ({LOG_SQL}) WHERE {version} GROUP BY id) WHERE t <> 'delete'"


TTL = "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN ts + INTERVAL 3 DAY END AS expire_at FROM events"
QUERIES = {
    "as_of_version": (as_of_version, asof("version <= 5000")),
    "as_of_timestamp": (as_of_timestamp, f"SELECT id, data FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, version DESC) AS r FROM ({LOG_SQL}) WHERE ts <= TIMESTAMP '2024-01-15') WHERE r = 1 AND type <> 'delete'"),
    "count_at_version": (count_at_version, f"SELECT count(*) AS count FROM ({asof('version <= 3000')})"),
    "version_diff": (version_diff, f"SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.data IS DISTINCT FROM b.data THEN 'modified' END AS change FROM ({asof('version <= 4000')}) a FULL JOIN ({asof('version <= 8000')}) b ON a.id = b.id) WHERE change IS NOT NULL"),
    "replay_log": (replay, f"SELECT coalesce(b.id, l.id) AS id, CASE WHEN l.id IS NULL THEN -1.0::DOUBLE ELSE data END AS data FROM (SELECT range AS id FROM range(200)) b FULL JOIN (SELECT id, arg_max(type, version) AS t, arg_max(data, version) AS data FROM ({LOG_SQL}) GROUP BY id) l ON b.id = l.id WHERE l.id IS NULL OR t <> 'delete'"),
    "collect_garbage": (garbage, f"SELECT version, type, id FROM ({LOG_SQL}) WHERE (SELECT count(*) FROM events) <= 1000 OR version >= (SELECT min(event_id) FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100))"),
    "list_versions": (list_versions, f"SELECT version, type, id FROM ({LOG_SQL})"),
    "cdc_since": (cdc_since, f"SELECT version, type, id FROM ({LOG_SQL}) WHERE version >= 9000 AND type IN ('insert', 'delete')"),
    "ttl_live": (ttl_live, f"SELECT event_id FROM ({TTL}) WHERE expire_at IS NULL OR expire_at > TIMESTAMP '{NOW}'"),
    "ttl_remaining": (ttl_remaining, f"SELECT event_id, CAST(greatest(0, floor(epoch(expire_at)) - epoch(TIMESTAMP '{NOW}')) AS BIGINT) AS remaining FROM ({TTL}) WHERE expire_at IS NOT NULL"),
    "ttl_expiring": (ttl_expiring, f"SELECT event_id FROM ({TTL}) WHERE expire_at < TIMESTAMP '2024-01-10'"),
    "mvcc_visible": (mvcc_visible, "SELECT event_id FROM (SELECT event_id, event_id % 50 AS b, CASE WHEN event_id % 4 = 0 THEN event_id % 60 END AS g FROM events) WHERE (b = 30 OR (b < 30 AND b % 9 <> 0)) AND NOT (g IS NOT NULL AND g <= 30)"),
    "compare_and_set": (compare_and_set, "SELECT p_partkey AS id, p_size + CASE WHEN p_partkey % 3 = 0 AND p_size = 10 THEN 1 ELSE 0 END AS version, CASE WHEN p_partkey % 3 = 0 AND p_size = 10 THEN 1.0 ELSE p_retailprice END AS data, CASE WHEN p_partkey % 3 <> 0 THEN 'untouched' WHEN p_size = 10 THEN 'updated' ELSE 'conflict' END AS status FROM part"),
    "quota_violations": (quotas, "SELECT * FROM (SELECT o_orderpriority AS tenant, count(*) AS used, CASE WHEN o_orderpriority = '1-URGENT' THEN 10000000 ELSE 100 END AS allowed FROM orders GROUP BY 1) WHERE used > allowed"),
    "tenant_tiers": (tenant_tiers, """SELECT id, CASE WHEN t = 'shared' AND n > 12 THEN 'dedicated' WHEN t = 'dedicated' AND (n > 20 OR n * 10 > 190) THEN 'premium' WHEN t = 'dedicated' AND id % 2 = 0 AND n < 6 THEN 'shared'
        WHEN t = 'premium' AND id % 2 = 0 AND n < 10 AND n * 10 < 95 THEN 'dedicated' ELSE t END AS tier FROM (SELECT o_custkey AS id, count(*) AS n, ['shared', 'dedicated', 'premium'][o_custkey % 3 + 1] AS t FROM orders GROUP BY o_custkey)"""),
    "replica_consistency": (replicas, "SELECT event_id, event_id % 100 = 0 AS strong, true AS eventual, event_id % 100 <= 20 AS bounded, event_id >= 500 AS session FROM events"),
    "upsert": (upserted, "SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT BETWEEN 490 AND 519 UNION ALL SELECT range, 77 FROM range(490, 520)"),
    "incremental_backup": (backup_roundtrip, "SELECT vec_id AS id, CAST(label AS VARCHAR) AS label FROM embeddings WHERE vec_id % 11 <> 0"),
    "latest_by_user": (latest_by_user, "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1"),
    "window_metrics": (window_metrics, "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "content_addresses": (dedup_contents, "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1"),
}
