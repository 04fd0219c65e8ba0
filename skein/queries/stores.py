"""Sources and sinks by round trips, streams that take what is there, names of tables, plans as text, and small operators by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import fusion, graph, knn, memory, places, text_search, versions
from skein.plans import dialect, planner
from skein.plans.storage import fresh_path
from skein.queries.common import ENTITIES_SQL, collection, entities, relations, table, vectors
from skein.queries.ranking import bm25_sql
from skein.queries.search import Q0, dist, q0
from skein.sources import collections as c
from skein.streaming import ingest


def json_roundtrip(spark, d):
    """A collection written as JSON lines and read again: vectors to the bit, metadata with its absent keys."""
    path = fresh_path(spark, "json")
    c.export_json(collection(spark, d), path)
    back = c.import_json(spark, path)
    same = back.join(vectors(spark, d).select("id", F.col("embedding").alias("own")), "id")
    return same.select("id", (F.col("embedding") == F.col("own")).alias("same"), F.col("metadata")["label"].alias("label"), F.col("metadata")["size"].alias("size"))


def saved(spark, d):
    """Opened again after being saved twice: the second writing replaces the first."""
    path = fresh_path(spark, "saved")
    c.save(collection(spark, d).limit(3), path)
    c.save(collection(spark, d), path)
    return c.read(spark, path).select("id", F.size("embedding").alias("dim"), F.size("metadata").alias("keys"))


def counts(spark, d):
    """How many vectors, of which dimension, and the vector of one row."""
    v = vectors(spark, d)
    one = knn.vector_of(v, 7)
    return v.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).withColumn("first", F.round(F.lit(one[0]), 6))


def added(spark, d):
    """Single rows and a batch added to a collection, one of them in place of its own."""
    base = collection(spark, d)
    new = base.filter("id < 5").select((F.col("id") * 3 + 1_000_000).alias("id"), "embedding", "metadata")
    changed = base.filter("id = 3").withColumn("metadata", F.create_map(F.lit("label"), F.lit("new")))
    return c.upsert(c.upsert(base, new), changed).select("id", F.col("metadata")["label"].alias("label"))


def compacted(spark, d):
    """Tombstones of every fifth row applied."""
    v = vectors(spark, d)
    return c.compact(v, v.filter("id % 5 = 0")).select("id")


def restored(spark, d):
    """A base and two increments merged: changed, new and deleted rows."""
    one = collection(spark, d)
    two = c.upsert(c.delete(one, one.filter("id % 10 = 0")), one.filter("id = 1").withColumn("metadata", F.create_map(F.lit("label"), F.lit("x"))))
    three = c.upsert(two, one.filter("id = 2").select((F.col("id") + 1_000_000).alias("id"), "embedding", "metadata"))
    return c.restore(one, [c.incremental(two, one), c.incremental(three, two)]).select("id", F.col("metadata")["label"].alias("label"))


STATEMENTS = ("SELECT index, label FROM t ANN(query=[0.1, 0.2], k=5, metric=euclidean) WHERE size > 8 LIMIT 3", "SELECT count(*) FROM t WHERE label = 'a'", "DELETE FROM t WHERE size > 3")
WRONG = ("SELEC x FROM t", "SELECT index FROM t ANN(k=5)", "UPDATE t SET")


def explained(spark, d):
    """The first two lines of plans, statement by statement, with the strategy."""
    rows = []
    for i, text in enumerate(STATEMENTS):
        lines = dict(x.split(": ", 1) for x in dialect.explain(text).split("\n"))
        rows.append((i, lines["statement"], lines["table"], lines["strategy"], lines.get("k")))
    return spark.createDataFrame(rows, "i long, statement string, name string, strategy string, k string")


def errors(spark, d):
    """Statements that don't parse say so."""
    rows = []
    for text in WRONG:
        try:
            dialect.parse(text)
            rows.append((text, False))
        except ValueError as e:
            rows.append((text, bool(str(e))))
    return spark.createDataFrame(rows, "statement string, refused boolean")


def schema_changes(spark, d):
    found = c.schema_diff({"a": "long", "b": "string", "c": "double"}, {"b": "string", "c": "long", "d": "date"})
    return spark.createDataFrame(sorted(found.items()), "name string, change string")


def aliases(spark, d):
    """Names set, moved, swapped and removed; a name without an alias is its own table."""
    a = c.Aliases()
    a.set("live", "v1")
    a.set("next", "v2")
    a.set("old", "v0")
    a.swap("live", "next")
    a.set("old", "v3")
    removed, again = a.remove("old"), a.remove("old")
    return spark.createDataFrame([(a.resolve("live"), a.resolve("next"), a.resolve("other"), removed, again, len(a.names), "old" in a.names)], "live string, following string, other string, removed boolean, again boolean, n long, known boolean")


def bm25_added(spark, d):
    """A document added to the corpus is found, and moves the statistics of all."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    new = spark.createDataFrame([(10_000_000, "thanthe of the onre")], "doc_id long, text string")
    return text_search.bm25_search(docs.union(new), "of thanthe", 15).select("doc_id", F.round("score", 6).alias("score"))


def weighted_signals(spark, d):
    p = table(spark, d, "part")
    score = fusion.weighted_expression({"size": 0.5, "price": 0.25, "absent": 9.0}, {"size": F.col("p_size"), "price": F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice"))})
    return p.select("p_partkey", F.round(score, 6).alias("score"))


def merged_memories(spark, d):
    """A turn's text joined with the next one's."""
    m = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))
    return memory.merge_contents(m, m.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))


def resolved(spark, d):
    """Entities by name and type, by the nearest vector of the type, and not at all."""
    e = entities(spark, d)
    v = vectors(spark, d).select("id", F.concat(F.lit("e"), "id").alias("name"), F.lit("x").alias("type"), "embedding")
    rows = [(1, graph.resolve(e, "EUROPE", "region")), (2, graph.resolve(e, "EUROPE", "nation")), (3, graph.resolve(v, "nobody", "x", q0(spark, d), 0.99)), (4, graph.resolve(v, "e5", "x")), (5, graph.resolve(v, "nobody", "y", q0(spark, d)))]
    return spark.createDataFrame(rows, "i long, id long")


def typed_equals(spark, d):
    """Numbers of different types, equal within a tolerance."""
    return table(spark, d, "orders").filter(places.typed_equal(F.col("o_totalprice").cast("float").cast("double"), F.col("o_totalprice"), 1e9)).filter(places.typed_equal(F.col("o_orderkey").cast("int"), F.col("o_orderkey").cast("double"))).select("o_orderkey")


def committed(spark, d):
    """What a reader sees of transactions of which every third never committed."""
    e = table(spark, d, "events")
    return e.filter(versions.visible(F.col("event_id"), F.when(F.col("event_id") % 4 == 0, F.col("event_id") + 10), 2000, F.col("event_id") % 3 != 0)).select("event_id")


def _messages(spark, d) -> str:
    """Vectors as JSON messages {id, vector, metadata, ts} in files, with rows that don't parse among them."""
    path = fresh_path(spark, "messages")
    good = vectors(spark, d).select(F.to_json(F.struct("id", F.col("embedding").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"))).alias("value"))
    bad = spark.createDataFrame([("{not json",), ('{"id": 1}',)], "value string")
    good.union(bad).repartition(4).write.text(path)
    return path


def _streamed(spark, stream, kind):
    """The rows that a stream gives in all; its files and its checkpoint are in the shared folder."""
    out, mark = fresh_path(spark, "stream"), fresh_path(spark, "checkpoint")
    ingest.sink(stream, out, mark).awaitTermination()
    again = ingest.sink(stream, out, mark)  # started once more it finds nothing new
    again.awaitTermination()
    return spark.read.schema(kind).parquet(out)


def stream_ingest(spark, d):
    """Messages of files become vectors: what doesn't parse, or the filter refuses, is skipped; a restart adds nothing."""
    raw = spark.readStream.schema("value string").text(_messages(spark, d))
    rows = ingest.extract(raw, keep=F.col("id") % 2 == 0).select("id", F.col("metadata")["label"].alias("label"), F.size("vector").alias("dim"))
    return _streamed(spark, rows, "id long, label string, dim int")


def stream_deduplicated(spark, d):
    """Each message given twice is taken once."""
    path = _messages(spark, d)
    raw = spark.readStream.schema("value string").text(path)
    twice = ingest.extract(raw).select("id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("turn"))
    return _streamed(spark, ingest.deduplicated(twice, ["id"]).select("id"), "id long")


def stream_seek(spark, d):
    """Start anew from the beginning, two files a batch: everything is there again, and the statistics count it."""
    path = _messages(spark, d)
    seen = []
    for _ in range(2):
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(path)
        query = ingest.sink(ingest.extract(stream).select("id"), fresh_path(spark, "stream"), fresh_path(spark, "checkpoint"))
        query.awaitTermination()
        seen.append(sum(p["numInputRows"] for p in query.recentProgress))
    return spark.createDataFrame([(seen[0], seen[1], bool(ingest.stats(query)))], "first long, again long, told boolean")


def cdc_subscription(spark, d):
    """Each batch of the chosen kinds of changes goes to a handler once."""
    path, got = fresh_path(spark, "log"), fresh_path(spark, "got")
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "delete").otherwise("insert").alias("type"))
    e.repartition(3).write.parquet(path)
    stream = spark.readStream.schema("event_id long, type string").parquet(path)
    ingest.subscribe(stream, lambda batch, number: batch.write.mode("append").parquet(got), fresh_path(spark, "checkpoint"), ("delete",)).awaitTermination()
    return spark.read.schema("event_id long, type string").parquet(got)


def plan_rules(spark, d):
    """Strategies over sizes and selectivities."""
    rows = []
    for n in (500, 5_000, 50_000, 2_000_000):
        for sel in (0.0, 0.005, 0.2):
            p = planner.choose(n, 128, 10, sel or None)
            rows.append((n, sel, p.strategy, p.oversample, p.ef_search, p.nprobe, round(p.recall, 6)))
    return spark.createDataFrame(rows, "n long, selectivity double, strategy string, oversample long, ef long, nprobe long, recall double")


def index_rules(spark, d):
    rows = [(n, dim, mem, planner.suggest_index(dim, n, mem)) for n in (100, 10_000, 600_000, 5_000_000) for dim in (32, 64, 256) for mem in (0, 1 << 30)]
    return spark.createDataFrame(rows, "n long, dim long, memory long, kind string")


def _mmr_sql(k: int, oversample: int = 4, balance: float = 0.7) -> str:
    """Unrolled greedy rounds over the nearest k * oversample rows."""
    b = f"{balance}::DOUBLE"
    steps = [
        f"""c AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v, 1 - {dist('cosine')} / 2 AS sim FROM embeddings ORDER BY {dist('cosine')}, vec_id LIMIT {k * oversample}),
        r AS MATERIALIZED (SELECT id, v, (sim - (SELECT min(sim) FROM c)) / ((SELECT max(sim) FROM c) - (SELECT min(sim) FROM c)) AS rel, sim FROM c),
        s AS MATERIALIZED (SELECT x.id AS a, y.id AS b, 1 - {dist('cosine', 'x.v', 'y.v')} / 2 AS sim FROM r x, r y),
        p1 AS MATERIALIZED (SELECT id, 1 AS rank, {b} * rel AS score FROM r ORDER BY score DESC, sim DESC, id LIMIT 1)"""
    ]
    for i in range(2, k + 1):
        steps.append(f"p{i} AS MATERIALIZED (SELECT * FROM p{i - 1} UNION ALL (SELECT r.id, {i}, {b} * rel - (1 - {b}) * max(s.sim) AS score FROM r JOIN s ON s.a = r.id JOIN p{i - 1} p ON p.id = s.b WHERE r.id NOT IN (SELECT id FROM p{i - 1}) GROUP BY r.id, rel, r.sim ORDER BY score DESC, r.sim DESC, r.id LIMIT 1))")
    return f"WITH {', '.join(steps)} SELECT id, rank, round(score, 6) AS score FROM p{k}"


def mmr(spark, d):
    return knn.mmr(vectors(spark, d), q0(spark, d), 10).select("id", "rank", F.round("score", 6).alias("score"))


def dfs(spark, d):
    return graph.dfs(graph.as_edges(relations(spark, d)), 100, 3)


LABEL = "CAST(label AS VARCHAR)"
KG = "(SELECT CAST(n_nationkey + 100 AS BIGINT) AS s, CAST(n_regionkey AS BIGINT) AS o FROM nation UNION ALL SELECT CAST(s_suppkey + 1000 AS BIGINT), CAST(s_nationkey + 100 AS BIGINT) FROM supplier)"
QUERIES = {
    "json_roundtrip": (json_roundtrip, f"SELECT vec_id AS id, true AS same, {LABEL} AS label, CASE WHEN vec_id % 3 <> 0 THEN CAST(vec_id % 17 AS VARCHAR) END AS size FROM embeddings"),
    "save_and_open": (saved, "SELECT vec_id AS id, CAST(len(embedding) AS INT) AS dim, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 3 END AS keys FROM embeddings"),
    "collection_counts": (counts, "SELECT count(*) AS n, CAST(max(len(embedding)) AS INT) AS dim, (SELECT round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id = 7) AS first FROM embeddings"),
    "add_vectors": (added, f"SELECT vec_id AS id, CASE WHEN vec_id = 3 THEN 'new' ELSE {LABEL} END AS label FROM embeddings UNION ALL SELECT vec_id * 3 + 1000000, {LABEL} FROM embeddings WHERE vec_id < 5"),
    "compact": (compacted, "SELECT vec_id AS id FROM embeddings WHERE vec_id % 5 <> 0"),
    "merge_backups": (restored, f"SELECT vec_id AS id, CASE WHEN vec_id = 1 THEN 'x' ELSE {LABEL} END AS label FROM embeddings WHERE vec_id % 10 <> 0 UNION ALL SELECT vec_id + 1000000, {LABEL} FROM embeddings WHERE vec_id = 2"),
    "explain_statements": (explained, "SELECT * FROM (VALUES (0, 'select', 't', 'ann', '5'), (1, 'select', 't', 'scan', NULL), (2, 'delete', 't', 'scan', NULL)) v(i, statement, name, strategy, k)"),
    "statement_errors": (errors, "SELECT unnest([" + ", ".join("'" + t + "'" for t in WRONG) + "]) AS statement, true AS refused"),
    "schema_diff": (schema_changes, "SELECT * FROM (VALUES ('a', 'removed'), ('c', 'changed'), ('d', 'added')) v(name, change)"),
    "aliases": (aliases, "SELECT 'v2' AS live, 'v1' AS following, 'other' AS other, true AS removed, false AS again, 2 AS n, false AS known"),
    "bm25_after_addition": (bm25_added, "WITH documents AS (SELECT doc_id, text FROM main.documents UNION ALL SELECT 10000000, 'thanthe of the onre') SELECT id AS doc_id, round(s, 6) AS score FROM (" + bm25_sql(["of", "thanthe"], 15) + ")"),
    "weighted_signals": (weighted_signals, "SELECT p_partkey, round(0.5::DOUBLE * p_size + CASE WHEN p_partkey % 3 > 0 THEN 0.25::DOUBLE * p_retailprice ELSE 0 END, 6) AS score FROM part"),
    "merge_memories": (merged_memories, "WITH m AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations) SELECT a.id AS a, b.id AS b, concat_ws('. ', a.text, b.text) AS content FROM m a JOIN m b ON b.id = a.id + 1"),
    "resolve_entities": (resolved, f"SELECT 1 AS i, (SELECT id FROM ({ENTITIES_SQL}) WHERE name = 'EUROPE' AND type = 'region') AS id UNION ALL SELECT 2, NULL UNION ALL SELECT 3, (SELECT vec_id FROM embeddings ORDER BY {dist('cosine')}, vec_id LIMIT 1) UNION ALL SELECT 4, 5 UNION ALL SELECT 5, NULL"),
    "typed_equals": (typed_equals, "SELECT o_orderkey FROM orders"),
    "transaction_view": (committed, "SELECT event_id FROM events WHERE (event_id = 2000 OR (event_id < 2000 AND event_id % 3 <> 0)) AND NOT (event_id % 4 = 0 AND event_id + 10 <= 2000)"),
    "stream_ingest": (stream_ingest, f"SELECT vec_id AS id, {LABEL} AS label, CAST(len(embedding) AS INT) AS dim FROM embeddings WHERE vec_id % 2 = 0"),
    "stream_deduplicated": (stream_deduplicated, "SELECT vec_id AS id FROM embeddings"),
    "stream_seek": (stream_seek, "SELECT count(*) + 2 AS first, count(*) + 2 AS again, true AS told FROM embeddings"),
    "cdc_subscription": (cdc_subscription, "SELECT event_id, 'delete' AS type FROM events WHERE event_id % 7 = 0"),
    "planner_table": (plan_rules, """WITH g AS (SELECT unnest([500, 5000, 50000, 2000000]) AS n), s AS (SELECT unnest([0.0::DOUBLE, 0.005::DOUBLE, 0.2::DOUBLE]) AS selectivity)
        SELECT n, selectivity, CASE WHEN n <= 1000 THEN 'exact_scan' WHEN selectivity > 0 AND selectivity < 0.01 THEN 'oversample_filter' ELSE 'index_search' END AS strategy,
        CASE WHEN n > 1000 AND selectivity > 0 AND selectivity < 0.01 THEN least(CAST(floor(10 / selectivity * 1.5) AS BIGINT), n) ELSE 10 END AS oversample, 50 AS ef,
        CASE WHEN n < 10000 THEN greatest(4, n // 1000) WHEN n < 100000 THEN greatest(8, n // 5000) ELSE least(128, greatest(16, n // 20000)) END AS nprobe,
        round(CASE WHEN n <= 1000 THEN 1.0 WHEN selectivity > 0 AND selectivity < 0.01 THEN 0.95 ELSE 1 - 1 / (1 + 50 / 10.0::DOUBLE) END, 6) AS recall FROM g, s"""),
    "index_suggest_table": (index_rules, """SELECT n, dim, memory, CASE WHEN memory > 0 AND n::BIGINT * dim * 4 > CAST(floor(memory * 0.7) AS BIGINT) THEN CASE WHEN dim >= 64 AND n >= 1000000 THEN 'diskann' ELSE 'ivfdisk' END
        WHEN n <= 500 THEN 'flat' WHEN n <= 20000 AND dim <= 64 THEN 'kdtree' WHEN n >= 500000 AND dim >= 128 THEN 'ivfpq' ELSE 'hnsw' END AS kind
        FROM (SELECT unnest([100, 10000, 600000, 5000000]) AS n), (SELECT unnest([32, 64, 256]) AS dim), (SELECT unnest([0, 1073741824]) AS memory)"""),
    "mmr": (mmr, _mmr_sql(10)),
    "dfs_preorder": (dfs, f"""WITH RECURSIVE b AS (SELECT s AS src, o AS dst, 0 AS side FROM {KG} UNION ALL SELECT o, s, 1 FROM {KG}),
        w(id, depth, walk, path) AS (SELECT CAST(100 AS BIGINT), 0, [CAST(100 AS BIGINT)], '' UNION ALL SELECT b.dst, w.depth + 1, list_append(w.walk, b.dst), w.path || b.side || lpad(CAST(b.dst AS VARCHAR), 12, '0') FROM w JOIN b ON b.src = w.id WHERE w.depth < 3 AND NOT list_contains(w.walk, b.dst))
        SELECT id, CAST(row_number() OVER (ORDER BY path) - 1 AS INT) AS position, CAST(depth AS INT) AS depth FROM w"""),
}
