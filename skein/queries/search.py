"""Exact vector search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skein.operators import knn
from skein.queries.common import collection, scaled, vectors

Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
DIST = {
    "cosine": "list_cosine_distance({a}, {b})",
    "euclidean": "list_distance({a}, {b})",
    "dot": "-list_inner_product({a}, {b})",
    "manhattan": "list_sum(list_transform(list_zip({a}, {b}), lambda t: abs(t[1] - t[2])))",
    "hamming": "CAST(list_sum(list_transform(list_zip({a}, {b}), lambda t: CASE WHEN (t[1] > 0) <> (t[2] > 0) THEN 1 ELSE 0 END)) AS DOUBLE)",
}
SCALED = "list_transform(embedding::DOUBLE[], lambda x: x * (1 + label))"


def dist(metric: str, a: str = "embedding::DOUBLE[]", b: str = Q0) -> str:
    return DIST[metric].format(a=a, b=b)


def q0(spark, d):
    return knn.vector_of(vectors(spark, d), 0)


def rounded(df, *extra):
    return df.select("id", F.round("distance", 6).alias("distance"), *extra)


def _metric(metric):
    def run(spark, d):
        return rounded(knn.topk(scaled(spark, d), q0(spark, d), 10, metric))

    return run, f"SELECT vec_id AS id, round(d, 6) AS distance FROM (SELECT vec_id, {dist(metric, SCALED)} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10"


def knn_batch(spark, d):
    """Queries are the rows whose id 20 divides, against all rows."""
    v = vectors(spark, d)
    return knn.join_topk(v, v.filter("id % 20 = 0"), 5).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def range_search(spark, d):
    return rounded(knn.within(vectors(spark, d), q0(spark, d), 0.9))


def threshold_search(spark, d):
    return rounded(knn.topk_threshold(vectors(spark, d), q0(spark, d), 50, 0.8))


def knn_filtered(spark, d):
    return rounded(knn.topk(vectors(spark, d), q0(spark, d), 10, where=F.col("label") == 3))


def knn_postfiltered(spark, d):
    return rounded(knn.topk_postfiltered(vectors(spark, d), q0(spark, d), 10, F.col("label") == 3))


def range_filtered(spark, d):
    return rounded(knn.within(vectors(spark, d).filter("label = 2"), q0(spark, d), 1.1))


def group_search(spark, d):
    return knn.group_topk(vectors(spark, d), q0(spark, d), "label", 5, 3).select("group", "id", "group_rank", "hit_rank", F.round("distance", 6).alias("distance"))


def multi_query(spark, d):
    v = vectors(spark, d)
    q = np.array([knn.vector_of(v, i) for i in (0, 1, 2)])
    return knn.multi_query_rrf(v, q, 10).select("id", F.round("score", 9).alias("score"), F.round("distance", 6).alias("distance"), "hits")


def recommend_by_id(spark, d):
    v = vectors(spark, d)
    p, n = np.array([knn.vector_of(v, i) for i in (1, 2)]), np.array([knn.vector_of(v, 3)])
    return rounded(knn.recommend(v, p, n, 10, exclude=(1, 2, 3)))


def discover(spark, d):
    v = vectors(spark, d)
    return rounded(knn.discover(v, knn.vector_of(v, 4), knn.vector_of(v, 5), 10))


def centroid_search(spark, d):
    v = vectors(spark, d)
    c = knn.weighted_centroid(knn.vector_of(v, 6), [knn.vector_of(v, 7), knn.vector_of(v, 8)], [0.5, -0.25])
    return rounded(knn.topk(v, c, 10))


def multivec(mode):
    def run(spark, d):
        chunks = vectors(spark, d).select((F.col("id") % 50).alias("doc_id"), F.col("id").alias("chunk_id"), "embedding")
        found = knn.best_chunk_topk(chunks, q0(spark, d), 10, mode)
        return found.select("doc_id", F.round("distance", 6).alias("distance"), "best_chunk")

    agg = {"max": "min", "avg": "avg", "sum": "sum"}[mode]
    return run, f"SELECT doc_id, round(m, 6) AS distance, best_chunk FROM (SELECT vec_id % 50 AS doc_id, {agg}(d) AS m, arg_min(vec_id, d) AS best_chunk FROM (SELECT vec_id, {dist('cosine')} AS d FROM embeddings) GROUP BY 1) ORDER BY m, doc_id LIMIT 10"


def late_interaction(spark, d):
    v = vectors(spark, d)
    q = np.array([knn.vector_of(v, i) for i in (9, 10)])
    found = knn.maxsim(v.withColumn("doc_id", F.col("id") % 50), q, 10)
    return found.select("doc_id", F.round("score", 6).alias("score"))



def scroll_page(spark, d):
    from skein.sources.collections import scroll

    return scroll(vectors(spark, d), 20, 30).select("id", "label")


def hits(query: str, k: int) -> str:
    return f"SELECT vec_id AS id, {dist('cosine', b=query)} AS d FROM embeddings ORDER BY d, vec_id LIMIT {k}"


def _vec(i: int) -> str:
    return f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {i})"


def combined(expr: str, ids: tuple[int, ...]) -> str:
    """A query vector by component out of rows: expr over v1, v2, ..."""
    zipped = "list_zip(" + ", ".join(_vec(i) for i in ids) + ")"
    return f"(SELECT list_transform({zipped}, lambda t: {expr}))"


GROUP_SQL = f"""
WITH h AS (SELECT label, vec_id, {dist('cosine')} AS d FROM embeddings WHERE label IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS hit_rank FROM h),
g AS (SELECT label, row_number() OVER (ORDER BY d, label) AS group_rank FROM r WHERE hit_rank = 1)
SELECT label AS "group", vec_id AS id, CAST(group_rank AS INT) AS group_rank, CAST(hit_rank AS INT) AS hit_rank, round(d, 6) AS distance
FROM r JOIN g USING (label) WHERE hit_rank <= 3 AND group_rank <= 5"""
MULTI_SQL = " UNION ALL ".join(f"SELECT id, d, row_number() OVER (ORDER BY d, id) AS r FROM ({hits(_vec(i), 20)})" for i in (0, 1, 2))

QUERIES = {
    **{f"knn_{m}": _metric(m) for m in DIST},
    "knn_batch": (knn_batch, f"""SELECT query_id, id, CAST(r AS INT) AS rank, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM
        (SELECT q.vec_id AS query_id, e.vec_id AS id, {dist('cosine', 'e.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)) WHERE r <= 5"""),
    "range_search": (range_search, f"SELECT vec_id AS id, round({dist('cosine')}, 6) AS distance FROM embeddings WHERE {dist('cosine')} <= 0.9"),
    "threshold_search": (threshold_search, f"SELECT id, round(d, 6) AS distance FROM ({hits(Q0, 50)}) WHERE d <= 0.8"),
    "knn_filtered": (knn_filtered, f"SELECT vec_id AS id, round(d, 6) AS distance FROM (SELECT vec_id, {dist('cosine')} AS d FROM embeddings WHERE label = 3) ORDER BY d, vec_id LIMIT 10"),
    "knn_postfiltered": (knn_postfiltered, f"SELECT id, round(d, 6) AS distance FROM ({hits(Q0, 40)}) JOIN embeddings ON id = vec_id WHERE label = 3 ORDER BY d, id LIMIT 10"),
    "range_filtered": (range_filtered, f"SELECT vec_id AS id, round({dist('cosine')}, 6) AS distance FROM embeddings WHERE label = 2 AND {dist('cosine')} <= 1.1"),
    "group_search": (group_search, GROUP_SQL),
    "multi_query_rrf": (multi_query, f"SELECT id, round(s, 9) AS score, round(d, 6) AS distance, n AS hits FROM (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS s, min(d) AS d, count(*) AS n FROM ({MULTI_SQL}) GROUP BY id) ORDER BY s DESC, id LIMIT 10"),
    "recommend_by_id": (recommend_by_id, f"SELECT vec_id AS id, round(d, 6) AS distance FROM (SELECT vec_id, {dist('cosine', b=combined('(t[1] + t[2]) / 2 - 0.5 * t[3]', (1, 2, 3)))} AS d FROM embeddings WHERE vec_id NOT IN (1, 2, 3)) ORDER BY d, vec_id LIMIT 10"),
    "discover": (discover, f"SELECT id, round(d, 6) AS distance FROM ({hits(combined('t[1] - t[2]', (4, 5)), 10)})"),
    "centroid_search": (centroid_search, f"SELECT id, round(d, 6) AS distance FROM ({hits(combined('t[1] + 0.5 * t[2] - 0.25 * t[3]', (6, 7, 8)), 10)})"),
    **{f"multivec_{m}": multivec(m) for m in ("max", "avg", "sum")},
    "late_interaction_maxsim": (late_interaction, f"""SELECT doc_id, round(s, 6) AS score FROM (SELECT vec_id % 50 AS doc_id, max(list_inner_product(embedding::DOUBLE[], {_vec(9)})) + max(list_inner_product(embedding::DOUBLE[], {_vec(10)})) AS s
        FROM embeddings GROUP BY 1) ORDER BY s DESC, doc_id LIMIT 10"""),
    "scroll_page": (scroll_page, "SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id LIMIT 30 OFFSET 20"),
}
