"""Fusion, rank expressions, phased ranking, memory and importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import fusion, knn, memory, text_search
from skein.queries.common import table, vectors
from skein.queries.search import Q0, dist, hits, q0

TERM = "of the anthe onre"
TOK = "list_filter(regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'), lambda x: len(x) <= 256)"


def bm25_sql(terms: list[str], k: int | None = 10) -> str:
    """(id, s) with BM25 over documents."""
    t = TOK.format(c="coalesce(text, '')")
    score = " + ".join(
        f"CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) ELSE 0 END" for i in range(len(terms))
    )
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(terms)))
    return f"""SELECT id, s FROM (SELECT id, {score} AS s FROM (SELECT id, len(t)::DOUBLE AS dl, {tf} FROM (SELECT doc_id AS id, {t} AS t FROM documents)) c,
        (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl, {df} FROM (SELECT t, {tf} FROM (SELECT {t} AS t FROM documents))) g) WHERE s > 0""" + (f" ORDER BY s DESC, id LIMIT {k}" if k else "")


def _sides(spark, d):
    v = knn.topk(vectors(spark, d), q0(spark, d), 30).select("id", "distance")
    t = text_search.bm25_search(table(spark, d, "documents"), TERM, 30).select(F.col("doc_id").alias("id"), "score")
    return v, t


def hybrid(mode):
    def run(spark, d):
        v, t = _sides(spark, d)
        return fusion.hybrid(v, t, 10, mode).select("id", F.round("score", 6).alias("score"))

    fused = "coalesce(vs, 0) * 0.5 + coalesce(ts, 0) * 0.5" if mode == "linear" else "coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + tr), 0)"
    return run, f"""WITH v AS (SELECT id, 1 / (1 + d) AS s, row_number() OVER (ORDER BY d, id) AS r FROM ({hits(Q0, 30)})),
        t AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS r FROM ({bm25_sql(text_search.query_terms(TERM), 30)})),
        vn AS (SELECT id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS vs, r AS vr FROM v), tn AS (SELECT id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS ts, r AS tr FROM t),
        f AS (SELECT coalesce(vn.id, tn.id) AS id, {fused} AS s FROM vn FULL JOIN tn ON vn.id = tn.id)
        SELECT id, round(s, 6) AS score FROM f ORDER BY s DESC, id LIMIT 10"""


def weighted_rrf(spark, d):
    from pyspark.sql import Window as W

    p = table(spark, d, "part")
    by = lambda c: p.orderBy(F.desc(c), "p_partkey").limit(50).select(F.col("p_partkey").alias("id"), F.row_number().over(W.orderBy(F.desc(c), "p_partkey")).alias("rank"))
    return fusion.weighted_rrf([(by("p_retailprice"), 0.4), (by("p_size"), 0.4), (by("p_name"), 0.2)], 20).select("id", F.round("score", 9).alias("score"))


def rank_expression(spark, d):
    near = knn.topk(vectors(spark, d), q0(spark, d), 40).select("id", "distance")
    signals = vectors(spark, d).select("id", F.col("label").cast("double").alias("popularity"), (F.col("id") % 30).cast("double").alias("age"))
    found = fusion.rank_search(near, signals, "0.6 * _score + 0.3 * decay_exp(age, 0, 10) + 0.1 * clamp(log(popularity + 1) / 3, 0, 1) - unknown", 10)
    return found.select("id", F.round("score", 6).alias("score"))


def decays(spark, d):
    p = table(spark, d, "part")
    x, o, s = F.col("p_size").cast("double"), F.lit(20.0), F.lit(8.0)
    return p.select("p_partkey", F.round(fusion.decay_exp(x, o, s), 9).alias("e"), F.round(fusion.decay_gauss(x, o, s), 9).alias("g"), F.round(fusion.decay_linear(x, o, s), 9).alias("l"))


def phases(spark, d):
    """Nearest 60, then an expression over label, then a filter."""
    found = fusion.pipeline(
        vectors(spark, d),
        [
            lambda df: knn.topk(df, q0(spark, d), 60),
            lambda df: df.withColumn("score", fusion.rank_expression("_score * (1 + label)", 1 / (1 + F.col("distance")), {"label": F.col("label")})).orderBy(F.desc("score"), "id").limit(30),
            lambda df: df.filter("label <> 9").orderBy(F.desc("score"), "id").limit(10),
        ],
    )
    return found.select("id", F.round("score", 6).alias("score"))


def temporal_decay(spark, d):
    e = table(spark, d, "events")
    age = (F.lit(1706745600) - F.unix_timestamp("ts")).cast("double")
    return e.select("event_id", F.round(memory.temporal_decay(age), 9).alias("decay"))


def informativeness(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(memory.informativeness(F.col("text")), 6).alias("score"))


def content_scores(spark, d):
    c = table(spark, d, "conversations")
    t = F.col("text")
    return c.select("conv_id", "turn", *(F.round(f(t), 6).alias(n) for n, f in (("specificity", memory.specificity), ("salience", memory.salience), ("density", memory.entity_density), ("content", memory.content_score))))


def access_scores(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", F.least(F.lit(1.0), F.abs("value") / 100.0).alias("relevance"))
    return memory.access_scores(e, F.to_timestamp(F.lit("2024-02-01 00:00:00"))).select("id", F.round("access_score", 6).alias("access_score"))


def importance(spark, d):
    e = table(spark, d, "events")
    s = memory.importance(F.lit(0.4), F.when(F.col("event_id") % 2 == 0, 0.9), F.lit(0.2), F.lit(0.5), memory.structural_score(F.col("event_id") % 4, F.lit(1), F.lit(0)))
    return e.select("event_id", F.round(s, 9).alias("score"))


def retention(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_list(((F.lit(1706745600) - F.unix_timestamp("ts")) / 86400.0)).alias("times"), F.max((F.lit(1706745600) - F.unix_timestamp("ts")) / 86400.0).alias("age"))
    return e.select("id", F.round(memory.retention(F.lit(1.0), F.col("age"), F.col("times")), 6).alias("retention"))


def memory_search(spark, d):
    near = knn.topk(vectors(spark, d), q0(spark, d), 30).select("id", "distance")
    scores = vectors(spark, d).select("id", (F.col("label") / 10.0).alias("importance"))
    return memory.memory_search(near, scores, 10).select("id", F.round("score", 6).alias("score"))


def memory_candidates(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return memory.candidates(c, 0.3).select("id", "pos", "memory_type", F.round("importance", 6).alias("importance"))


def memory_links(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, "supports").otherwise("similar").alias("kind"), F.lit(0.8).alias("strength"))
    return memory.links_both_ways(o).select("src", "dst", "kind", F.round("strength", 6).alias("strength"))


AGE = "((1706745600 - floor(epoch(ts)))::DOUBLE / 3600)"
DECAY = f"greatest(exp(-{AGE} / (168 / 0.693147::DOUBLE)), 0.1::DOUBLE)"
TOP = lambda col: f"SELECT p_partkey AS id, row_number() OVER (ORDER BY {col} DESC, p_partkey) AS r FROM part ORDER BY {col} DESC, p_partkey LIMIT 50"
WORDS = "regexp_extract_all(text, '[A-Za-z0-9]+')"
UNIT = "least(1.0, greatest(0.0, {}))".format
QUERIES = {
    "hybrid_linear": hybrid("linear"),
    "hybrid_rrf": hybrid("rrf"),
    "weighted_rrf": (weighted_rrf, "SELECT id, round(s, 9) AS score FROM (SELECT id, sum(s) AS s FROM (" + " UNION ALL ".join(f"SELECT id, {w}::DOUBLE / (60 + r) AS s FROM ({TOP(c)})" for c, w in (("p_retailprice", 0.4), ("p_size", 0.4), ("p_name", 0.2))) + ") GROUP BY id) ORDER BY s DESC, id LIMIT 20"),
    "rank_expression": (rank_expression, f"""SELECT id, round(s, 6) AS score FROM (SELECT id, 0.6 / (1 + d) + 0.3 * exp(-(id % 30)::DOUBLE / 10) + 0.1 * least(1, greatest(0, CASE WHEN label + 1 > 0 THEN ln(label + 1) ELSE 0 END / 3)) AS s
        FROM ({hits(Q0, 40)}) JOIN embeddings ON id = vec_id) ORDER BY s DESC, id LIMIT 10"""),
    "decay_functions": (decays, "SELECT p_partkey, round(exp(-abs(p_size - 20.0::DOUBLE) / 8), 9) AS e, round(exp(-0.5 * pow((p_size - 20.0::DOUBLE) / 8, 2)), 9) AS g, round(greatest(0.0, 1 - abs(p_size - 20.0::DOUBLE) / 8), 9) AS l FROM part"),
    "phased_ranking": (phases, f"SELECT id, round(s, 6) AS score FROM (SELECT id, label, (1 + label) / (1 + d) AS s FROM ({hits(Q0, 60)}) JOIN embeddings ON id = vec_id ORDER BY s DESC, id LIMIT 30) WHERE label <> 9 ORDER BY s DESC, id LIMIT 10"),
    "temporal_decay": (temporal_decay, f"SELECT event_id, round(CASE WHEN {AGE} <= 0 THEN 1.0 WHEN {AGE} < 24 THEN least({DECAY} * (1 + 0.3::DOUBLE * (1 - {AGE} / 24)), 1.0) ELSE {DECAY} END, 9) AS decay FROM events"),
    "informativeness": (informativeness, f"""SELECT doc_id, round(CASE WHEN n > 0 THEN 0.4::DOUBLE * {UNIT('(u / n - 0.2::DOUBLE) / 0.6::DOUBLE')} + 0.3::DOUBLE * {UNIT('1 - abs(a / n - 5.5::DOUBLE) / 4')} + 0.3::DOUBLE * {UNIT('1 - abs(CASE WHEN e > 0 THEN n / e ELSE n END - 17.5::DOUBLE) / 15')} ELSE 0 END, 6) AS score
        FROM (SELECT doc_id, len({WORDS})::DOUBLE AS n, len(list_distinct(list_transform({WORDS}, lambda w: lower(w))))::DOUBLE AS u, len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE AS a, len(regexp_extract_all(text, '[.!?]'))::DOUBLE AS e FROM documents)"""),
    "content_scores": (content_scores, None),
    "access_scores": (access_scores, """SELECT id, round(least(1.0, 0.3 * least(1.0, ln(1.0 + n) / ln(101.0)) + 0.3 * CASE WHEN age < 24 THEN least(d * (1 + 0.3 * (1 - age / 24)), 1.0) ELSE d END + 0.2 * relevance
        + 0.2 * CASE WHEN n >= 2 THEN exp(-pow(ln(span / (n - 1) / 48 + 0.1), 2) / 2) ELSE 0.5 END), 6) AS access_score
        FROM (SELECT *, greatest(exp(-age / (168 / 0.693147::DOUBLE)), 0.1) AS d FROM (SELECT user_id AS id, count(*)::DOUBLE AS n, avg(least(1.0, abs(value) / 100)) AS relevance, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::DOUBLE / 3600 AS span, (1706745600 - floor(epoch(max(ts))))::DOUBLE / 3600 AS age FROM events GROUP BY 1))"""),
    "importance": (importance, """SELECT event_id, round((0.3::DOUBLE * 0.4 + CASE WHEN event_id % 2 = 0 THEN 0.25::DOUBLE * 0.9 ELSE 0 END + 0.2::DOUBLE * 0.2 + 0.15::DOUBLE * 0.5 + 0.1::DOUBLE * (0.6 * (1 - exp(-0.3 * (event_id % 4 + 1)))))
        / (0.3::DOUBLE + CASE WHEN event_id % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END + 0.2 + 0.15 + 0.1), 9) AS score FROM events"""),
    "retention": (retention, "SELECT user_id AS id, round(exp(-0.01 * max(t)) + 0.1 * sum(1 / t), 6) AS retention FROM (SELECT user_id, (1706745600 - floor(epoch(ts)))::DOUBLE / 86400 AS t FROM events) GROUP BY 1"),
    "memory_search": (memory_search, f"SELECT id, round(s, 6) AS score FROM (SELECT id, 0.6 * greatest(0, 1 - d / 2) + 0.4 * label / 10 AS s FROM ({hits(Q0, 30)}) JOIN embeddings ON id = vec_id) ORDER BY s DESC, id LIMIT 10"),
    "memory_candidates": (memory_candidates, None),
    "memory_links": (memory_links, "SELECT o_custkey AS src, o_orderkey AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 'supports' ELSE 'similar' END AS kind, 0.8::DOUBLE AS strength FROM orders UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'supports' ELSE 'similar' END, 0.72::DOUBLE FROM orders"),
}
