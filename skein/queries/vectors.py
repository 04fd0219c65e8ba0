"""Codecs, approximate indexes, near-duplicate vectors and plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skein.functions.distance import distance
from skein.operators import ann, ann_batch, knn, quant
from skein.queries.common import scaled, vectors
from skein.queries.search import SCALED, q0
from skein.queries.search import dist as DIST


def quant_train(spark, d):
    return quant.train(vectors(spark, d)).select("dim", *(F.round(c, 6).alias(c) for c in ("lo", "hi", "mean", "std")))


def sq8(spark, d):
    v = vectors(spark, d)
    book = quant.train(v)
    back = quant.decode(quant.encode(F.col("embedding"), book), book)
    err = F.array_max(F.zip_with("embedding", back, lambda a, b: F.abs(a - b)))
    return v.select("id", F.aggregate(quant.encode(F.col("embedding"), book), F.lit(0), lambda s, x: s + x).alias("code_sum"), (err < 0.005).alias("close"))


def binary_hamming(spark, d):
    v = vectors(spark, d)
    q = quant.binary(F.array(*map(F.lit, q0(spark, d))))
    return v.select("id", quant.hamming(quant.binary(F.col("embedding")), q).alias("bits"))


def ternary(spark, d):
    t = quant.ternary(F.col("embedding"), 0.1)
    return vectors(spark, d).select("id", F.size(F.filter(t, lambda x: x == 1)).alias("up"), F.size(F.filter(t, lambda x: x == -1)).alias("down"))


def stated(spark, d):
    """(vectors, ids) of the query rows: those whose id 20 divides."""
    rows = vectors(spark, d).filter("id % 20 = 0").orderBy("id").select("id", "embedding").collect()
    return np.array([r["embedding"] for r in rows], float), [r["id"] for r in rows]


#: Index families at their own settings: lists probed, codes, and rows reranked by exact distance.
FAMILIES = {
    "ivf": (lambda v: ann_batch.inverted(v, 64, 32), 10),
    "ivf_pq": (lambda v: ann_batch.inverted(v, 64, 32, lambda x, centres: ann_batch.product(x, 16, 64, centres)), 60),
    "ivf_sq8": (lambda v: ann_batch.inverted(v, 64, 32, lambda x, _: ann_batch.scalar(x)), 20),
    "ivf_rotated": (lambda v: ann_batch.inverted(v, 64, 32, lambda x, _: ann_batch.rotated(x)), 40),
    "pq": (lambda v: ann_batch.product(v, 16, 64), 60),
    "sq8": (lambda v: ann_batch.scalar(v), 20),
    "rotated": (lambda v: ann_batch.rotated(v), 40),
    "lsh": (lambda v: ann_batch.hashed(v, 64, 6), 10),
}


def measured(spark, d, family):
    """(recall, share of rows let pass) of a family's ten nearest against the exact ones, over all stated queries."""
    v = vectors(spark, d)
    make, keep = FAMILIES[family]
    index, (q, ids) = make(v), stated(spark, d)
    found = ann_batch.search(index, q, ids, 10, keep)
    exact = knn.batch_topk(v, q, ids, 10, "euclidean").select("query_id", "id")
    hit = found.join(exact, ["query_id", "id"], "left_semi").count()
    return hit / exact.count(), ann_batch.scanned(index, q, ids).agg(F.sum("rows")).first()[0] / (len(ids) * v.count())


def search_found(family):
    """How many neighbours a family gives its queries, and that none is given twice or at a wrong distance; tests hold its recall."""

    def run(spark, d):
        v = vectors(spark, d)
        make, keep = FAMILIES[family]
        q, ids = stated(spark, d)
        found = ann_batch.search(make(v), q, ids, 10, keep)
        pairs = found.join(v.select("id", "embedding"), "id").join(v.select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), "query_id")
        right = F.abs(distance("euclidean", F.col("embedding"), F.col("query")) - F.col("distance")) < 1e-6
        return pairs.groupBy("query_id").agg(F.countDistinct("id").alias("n"), F.bool_and(right).alias("right"), F.min("distance").alias("nearest")).select("query_id", "n", "right", F.round("nearest", 6).alias("nearest"))

    return run, "SELECT vec_id AS query_id, least(10, (SELECT count(*) FROM embeddings)) AS n, true AS right, 0.0::DOUBLE AS nearest FROM embeddings WHERE vec_id % 20 = 0"


def pq_within(spark, d):
    """Range search through codes: the slack is more than any coding error here, so it is exact."""
    v = vectors(spark, d)
    q, ids = stated(spark, d)
    found = ann_batch.within(ann_batch.product(v, 16, 64), q, ids, 0.9, 1.2)
    return found.select("query_id", "id", F.round("distance", 6).alias("distance"))


def lsh_within(spark, d):
    """Range search in shared buckets, of copies: equal vectors share all of them."""
    v = vectors(spark, d).select("id", "embedding")
    both = v.union(v.select(F.col("id") + 100_000, "embedding"))
    q, ids = stated(spark, d)
    return ann_batch.within(ann_batch.hashed(both), q, ids, 1e-5).select("query_id", "id")


def code_pairs(spark, d):
    """Distances between codes of rows and their successors."""
    v = vectors(spark, d)
    book = quant.train(v)
    coded = v.select("id", quant.encode(F.col("embedding"), book).alias("a"))
    met = coded.join(coded.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return met.select("id", F.round(quant.code_code_distance(F.col("a"), F.col("b"), book), 6).alias("distance"))


def lsh_pairs(spark, d):
    v = vectors(spark, d)
    both = v.select("id", "embedding").union(v.filter("id % 25 = 0").select(F.col("id") + 100_000, "embedding"))
    return ann.lsh_pairs(both, 1e-5).select("a", "b")


def dedup_first_wins(spark, d):
    v = vectors(spark, d)
    after = max(100_000, (v.agg(F.max("id")).first()[0] or 0) + 1)  # a copy's id is no other row's
    both = v.select("id", "embedding").union(v.filter("id % 25 = 0").select(F.col("id") + after, "embedding"))
    return ann.first_wins(both, ann.lsh_pairs(both, 1e-5)).select("id")


QUERIES = {
    "quant_train": (quant_train, "SELECT CAST(i - 1 AS INT) AS dim, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1"),
    "sq8_roundtrip": (sq8, """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT i, min(x) AS lo, max(x) AS hi FROM e GROUP BY i),
        c AS (SELECT vec_id, x, lo, hi, floor((x - lo) / (hi - lo) * 255 + 0.5) AS code FROM e JOIN b USING (i)) SELECT vec_id AS id, CAST(sum(code) AS INT) AS code_sum, max(abs(x - (lo + (hi - lo) * code / 255))) < 0.005 AS close FROM c GROUP BY vec_id"""),
    "binary_hamming": (binary_hamming, "SELECT vec_id AS id, CAST(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda t: CASE WHEN (t[1] > 0) <> (t[2] > 0) THEN 1 ELSE 0 END)) AS INT) AS bits FROM embeddings"),
    "ternary": (ternary, "SELECT vec_id AS id, CAST(len(list_filter(embedding, lambda x: x::DOUBLE > 0.1::DOUBLE)) AS INT) AS up, CAST(len(list_filter(embedding, lambda x: x::DOUBLE < -0.1::DOUBLE)) AS INT) AS down FROM embeddings"),
    **{f"{family}_search": search_found(family) for family in FAMILIES},
    "pq_within": (pq_within, f"SELECT q.vec_id AS query_id, e.vec_id AS id, round({DIST('euclidean', 'e.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND {DIST('euclidean', 'e.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')} <= 0.9"),
    "lsh_within": (lsh_within, "SELECT q.vec_id AS query_id, unnest([q.vec_id, q.vec_id + 100000]) AS id FROM embeddings q WHERE q.vec_id % 20 = 0"),
    "code_pair_distance": (code_pairs, """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT i, min(x) AS lo, max(x) AS hi FROM e GROUP BY i),
        c AS (SELECT vec_id, i, lo + (hi - lo) * floor((x - lo) / (hi - lo) * 255 + 0.5) / 255 AS y FROM e JOIN b USING (i)) SELECT a.vec_id AS id, round(sqrt(sum((a.y - z.y) * (a.y - z.y))), 6) AS distance FROM c a JOIN c z ON z.vec_id = a.vec_id + 1 AND z.i = a.i GROUP BY 1"""),
    "lsh_pairs": (lsh_pairs, "SELECT vec_id AS a, vec_id + 100000 AS b FROM embeddings WHERE vec_id % 25 = 0"),
    "dedup_first_wins": (dedup_first_wins, "SELECT vec_id AS id FROM embeddings"),
}
