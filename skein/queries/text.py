"""Tokens, BM25, phrases, sparse vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.text import STOP_WORDS, stem_all, tokens
from skein.operators import text_search as ts
from skein.plans.storage import fresh_path
from skein.queries.common import table
from skein.queries.ranking import TOK, bm25_sql

PHRASE = "of the"


def docs(spark, d):
    return table(spark, d, "documents")


def token_counts(spark, d):
    t = tokens(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("n_distinct"), F.size(tokens(F.col("text"), stop_words=True)).alias("n_content"))


def doc_freq(spark, d):
    return ts.doc_freq(docs(spark, d))


def bm25_top(spark, d):
    return ts.bm25_search(docs(spark, d), "the of thanthe onre", 10).select("doc_id", F.round("score", 6).alias("score"))


def bm25_all(spark, d):
    return ts.bm25(docs(spark, d), ["and", "ering", "and"]).select("doc_id", F.round("score", 6).alias("score"))


def bm25_without(spark, d):
    """After documents are removed, statistics are those of the rest."""
    return ts.bm25_search(docs(spark, d).filter("doc_id % 7 <> 0"), "the of", 20).select("doc_id", F.round("score", 6).alias("score"))


def index_stats(spark, d):
    return ts.index_stats(docs(spark, d)).select("documents", "terms", "postings", F.round("avg_len", 6).alias("avg_len"))


def phrase(spark, d):
    return ts.phrase_search(docs(spark, d), PHRASE).select("doc_id", F.size("positions").alias("n"), F.round("score", 6).alias("score"))


def phrase_stemmed(spark, d):
    return ts.phrase_search(docs(spark, d), "of the", 50, language="en").select("doc_id", F.size("positions").alias("n"), F.round("score", 6).alias("score"))


def _index(spark, d):
    return ts.Postings.build(docs(spark, d), fresh_path(spark, "postings"))


def bm25_indexed(spark, d):
    """The same search over written postings: only those of its terms are read."""
    return _index(spark, d).search("the of thanthe onre", 10).select("doc_id", F.round("score", 6).alias("score"))


def phrase_indexed(spark, d):
    return _index(spark, d).phrase(PHRASE).select("doc_id", F.size("positions").alias("n"), F.round("score", 6).alias("score"))


def stems(spark, d):
    each = docs(spark, d).filter("lang = 'en'").select(F.explode(stem_all("en")(tokens(F.col("text")))).alias("stem"))
    return each.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


def _sparse(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("dim")).agg(F.sum("l_quantity").alias("value"))


QUERY = {1: 0.5, 17: 1.0, 42: 2.0, 99: 0.25, 150: 1.5, 199: 0.75}


def sparse_dot(spark, d):
    return ts.sparse_topk(_sparse(spark, d), QUERY, 20).select("id", F.round("score", 6).alias("score"))


def sparse_threshold(spark, d):
    return ts.sparse_topk(_sparse(spark, d), QUERY, None, 30.0).select("id", F.round("score", 6).alias("score"))


T = TOK.format(c="coalesce(text, '')")
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
W8 = "CASE l_partkey " + " ".join(f"WHEN {k} THEN {w}::DOUBLE" for k, w in QUERY.items()) + " END"
SPARSE = f"SELECT l_orderkey AS id, sum(l_quantity * {W8}) AS s FROM lineitem WHERE l_partkey IN ({', '.join(map(str, QUERY))}) GROUP BY 1"
QUERIES = {
    "token_counts": (token_counts, f"SELECT doc_id, CAST(len(t) AS INT) AS n, CAST(len(list_distinct(t)) AS INT) AS n_distinct, CAST(len(list_filter(t, lambda x: x NOT IN ({STOPS}))) AS INT) AS n_content FROM (SELECT doc_id, {T} AS t FROM documents)"),
    "doc_freq": (doc_freq, f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({T})) AS term FROM documents) GROUP BY 1"),
    "bm25_top10": (bm25_top, f"SELECT id AS doc_id, round(s, 6) AS score FROM ({bm25_sql(['the', 'of', 'thanthe', 'onre'], 10)})"),
    "bm25_repeated_term": (bm25_all, f"""SELECT id AS doc_id, round(2 * coalesce(a, 0) + coalesce(b, 0), 6) AS score FROM (SELECT coalesce(x.id, y.id) AS id, x.s AS a, y.s AS b FROM ({bm25_sql(['and'], None)}) x FULL JOIN ({bm25_sql(['ering'], None)}) y ON x.id = y.id)"""),
    "bm25_after_removal": (bm25_without, "WITH documents AS (SELECT * FROM main.documents WHERE doc_id % 7 <> 0) SELECT id AS doc_id, round(s, 6) AS score FROM (" + bm25_sql(["the", "of"], 20) + ")"),
    "index_stats": (index_stats, f"SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT term) AS terms, count(*) AS postings, (SELECT round(avg(len({T})), 6) FROM documents) AS avg_len FROM (SELECT unnest(list_distinct({T})) AS term FROM documents)"),
    "phrase_search": (phrase, f"""SELECT doc_id, CAST(n AS INT) AS n, round(s, 6) AS score FROM (SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS n FROM (SELECT doc_id, {T} AS t FROM documents)) p
        JOIN ({bm25_sql(['of', 'the'], None)}) b ON b.id = p.doc_id WHERE n > 0"""),
    "bm25_postings": (bm25_indexed, f"SELECT id AS doc_id, round(s, 6) AS score FROM ({bm25_sql(['the', 'of', 'thanthe', 'onre'], 10)})"),
    "phrase_postings": (phrase_indexed, f"""SELECT doc_id, CAST(n AS INT) AS n, round(s, 6) AS score FROM (SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS n FROM (SELECT doc_id, {T} AS t FROM documents)) p
        JOIN ({bm25_sql(['of', 'the'], None)}) b ON b.id = p.doc_id WHERE n > 0"""),
    "phrase_search_stemmed": (phrase_stemmed, None),
    "stem_counts": (stems, None),
    "sparse_dot_topk": (sparse_dot, f"SELECT id, round(s, 6) AS score FROM ({SPARSE}) ORDER BY s DESC, id LIMIT 20"),
    "sparse_threshold": (sparse_threshold, f"SELECT id, round(s, 6) AS score FROM ({SPARSE}) WHERE s >= 30"),
}
