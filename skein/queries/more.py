"""Bloom filters, named fields, namespaces, shards, similarity joins, further codecs, context graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import bloom
from skein.operators import ann, graph, knn, memory
from skein.queries.common import RELATIONS_SQL, relations, table, vectors
from skein.queries.graphs import _vector_kg
from skein.queries.search import Q0, dist, hits, q0
from skein.sources import collections as c


def bloom_members(spark, d):
    """No key that went in is missing: customers with orders, looked up among all."""
    o = table(spark, d, "orders")
    b = bloom.merge(bloom.build(o.filter("o_orderkey % 2 = 0"), "o_custkey", 200_000, 0.001), bloom.build(o.filter("o_orderkey % 2 = 1"), "o_custkey", 200_000, 0.001))
    return bloom.maybe(o, "o_custkey", b, 200_000, 0.001).select(F.col("value").alias("o_custkey"))


def named_fields(spark, d):
    """Two fields of a row, each with its own metric."""
    v = vectors(spark, d).withColumn("title", F.reverse("embedding"))
    a = knn.topk(v, q0(spark, d), 5, "dot").select(F.lit("body").alias("field"), "id", F.round("distance", 6).alias("distance"))
    return a.union(knn.topk(v, q0(spark, d), 5, "manhattan", vec_col="title").select(F.lit("title").alias("field"), "id", F.round("distance", 6).alias("distance")))


def namespace_search(spark, d):
    v = vectors(spark, d).withColumn("namespace", F.concat(F.lit("t"), F.col("id") % 4))
    return knn.topk(v, q0(spark, d), 10, where=F.col("namespace") == "t2").select("id", F.round("distance", 6).alias("distance"))


def shard_sizes(spark, d):
    """Every key has one shard of eight, either way."""
    o = table(spark, d, "orders").select(c.shard(F.col("o_orderkey"), 8).alias("h"), c.ring_shard(F.col("o_orderkey"), 8).alias("r"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("r").alias("r0"), F.max("r").alias("r1"))


def similarity_join(spark, d):
    v = vectors(spark, d)
    return knn.join_within(v, 0.6).select("a", "b", F.round("distance", 6).alias("distance"))


def similar_memories(spark, d):
    return memory.similar_pairs(vectors(spark, d), 0.6, 10).select("a", "b", F.round("similarity", 6).alias("similarity"))


def extracted_scores(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(memory.extracted_score(F.col("text")), 6).alias("score"))


def token_set_encoding(spark, d):
    """Unit vectors of 320 components out of ten token vectors each."""
    sets = vectors(spark, d).groupBy((F.col("id") % 50).alias("doc_id")).agg(F.collect_list("embedding").alias("tokens"))
    code = sets.select("doc_id", ann.token_set_vectors(sets, 64).alias("v"))
    return code.select("doc_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


def context_search(spark, d):
    e, r = _vector_kg(spark, d)
    e = e.withColumn("user_id", F.concat(F.lit("u"), F.col("id") % 3))
    return graph.context_search(e, r, q0(spark, d), 0.2, user_id="u1").select("id", "p", "o", F.round("score", 6).alias("score"))


def entity_expansion(spark, d):
    near = knn.topk(vectors(spark, d), q0(spark, d), 10).select("id")
    links = vectors(spark, d).select("id", (F.col("label") + 100).cast("long").alias("entity"))
    return graph.expand(near, links, relations(spark, d))


def types(column: str):
    def run(spark, d):
        if column == "p":
            return relations(spark, d).select("p").distinct()
        from skein.queries.common import entities

        return entities(spark, d).select("type").distinct()

    return run


UNITS = f"SELECT vec_id AS id, {dist('cosine', 'a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS d"
NEAR = f"SELECT q, id, d FROM (SELECT b.vec_id AS q, a.vec_id AS id, {dist('cosine', 'a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} AS d, row_number() OVER (PARTITION BY b.vec_id ORDER BY {dist('cosine', 'a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, a.vec_id) AS r FROM embeddings a, embeddings b) WHERE r <= 11 AND q <> id"
QUERIES = {
    "bloom_members": (bloom_members, "SELECT DISTINCT o_custkey FROM orders"),
    "named_fields": (named_fields, f"""(SELECT 'body' AS field, vec_id AS id, round(d, 6) AS distance FROM (SELECT vec_id, {dist('dot')} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 5)
        UNION ALL (SELECT 'title', vec_id, round(d, 6) FROM (SELECT vec_id, {dist('manhattan', 'list_reverse(embedding::DOUBLE[])')} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 5)"""),
    "namespace_search": (namespace_search, f"SELECT vec_id AS id, round(d, 6) AS distance FROM (SELECT vec_id, {dist('cosine')} AS d FROM embeddings WHERE vec_id % 4 = 2) ORDER BY d, vec_id LIMIT 10"),
    "shard_sizes": (shard_sizes, "SELECT count(*) AS n, 0 AS h0, 7 AS h1, 0 AS r0, 7 AS r1 FROM orders"),
    "similarity_join": (similarity_join, f"SELECT a.vec_id AS a, b.vec_id AS b, round({dist('cosine', 'a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')}, 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {dist('cosine', 'a.embedding::DOUBLE[]', 'b.embedding::DOUBLE[]')} <= 0.6"),
    "similar_memories": (similar_memories, f"SELECT a, b, round(max(s), 6) AS similarity FROM (SELECT least(q, id) AS a, greatest(q, id) AS b, 1 - d / 2 AS s FROM ({NEAR})) WHERE s >= 0.6 GROUP BY a, b"),
    "extracted_scores": (extracted_scores, None),
    "token_set_encoding": (token_set_encoding, "SELECT DISTINCT vec_id % 50 AS doc_id, 320 AS n, 1.0::DOUBLE AS norm FROM embeddings"),
    "context_search": (context_search, f"SELECT vec_id AS id, 'next' AS p, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS o, round(1 - d, 6) AS score FROM (SELECT vec_id, {dist('cosine')} AS d FROM embeddings WHERE vec_id % 3 = 1) WHERE 1 - d >= 0.2"),
    "entity_expansion": (entity_expansion, f"SELECT DISTINCT h.id, r.s, r.p, r.o FROM ({hits(Q0, 10)}) h JOIN embeddings e ON e.vec_id = h.id JOIN ({RELATIONS_SQL}) r ON r.s = e.label + 100 OR r.o = e.label + 100"),
    "kg_predicates": (types("p"), f"SELECT DISTINCT p FROM ({RELATIONS_SQL})"),
    "kg_entity_types": (types("type"), "SELECT unnest(['region', 'nation', 'supplier']) AS type"),
}
