"""BM25, phrase and sparse retrieval over postings tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from skein.functions.text import once, stem, tokens
from skein.plans.storage import settle

K1, B = 1.2, 0.75
#: Tokens in a sorted run of postings, but for a longer document; stems that a task remembers.
RUN, STEMS = 1_000_000, 500_000


def postings(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, doc_len): one row a document and term."""
    each = docs.select(F.col(doc_col).alias("doc_id"), once(tokens(F.col(text_col))).alias("t"))
    return each.select("doc_id", F.size("t").alias("doc_len"), F.explode("t").alias("term")).groupBy("doc_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf")).select("doc_id", "term", "tf", "doc_len")


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(n_docs, avg_len): one row."""
    n = F.size(tokens(F.col(text_col)))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(n).alias("avg_len"))


def index_stats(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(documents, terms, postings, avg_len), in one pass: a document is a row a distinct term and one of no term, with its length."""
    each = docs.select(once(tokens(F.col(text_col))).alias("t"))
    each = each.select(F.size("t").alias("n"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("term"))
    by_term = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("len"))
    documents = F.coalesce(F.max(F.when(F.col("term").isNull(), F.col("df"))), F.lit(0).cast("long"))
    stats = by_term.agg(documents.alias("documents"), F.count("term").alias("terms"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("df"))), F.lit(0).cast("long")).alias("postings"), F.sum("len").alias("len"))
    return stats.select("documents", "terms", "postings", F.when(F.col("documents") > 0, F.col("len") / F.col("documents")).alias("avg_len"))


def doc_freq(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    each = docs.select(F.col(doc_col).alias("doc_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def term_score(tf: Column, df: Column, doc_len: Column, n_docs: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    return idf(n_docs, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len))


def query_terms(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall("[a-z0-9]+", query.translate({c: c + 32 for c in range(65, 91)}))))


def bm25(docs: DataFrame, terms: Sequence[str], k: int | None = None, doc_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of documents that hold a query term; a term given twice counts twice.

    One pass over the text: a document's counts of the few query terms are columns, and document
    frequencies and lengths are one aggregate row, joined back by broadcast.
    """
    distinct = list(dict.fromkeys(terms))
    each = docs.select(F.col(doc_col).alias("doc_id"), once(tokens(F.col(text_col))).alias("t"))
    counts = each.select("doc_id", F.size("t").alias("doc_len"), *((F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(distinct)))
    found = _with_score(counts, terms, k1, b)
    return found.orderBy(F.desc("score"), "doc_id").limit(k) if k else found


def _with_score(counts: DataFrame, terms: Sequence[str], k1: float = K1, b: float = B, *more: str) -> DataFrame:
    """(doc_id, score, more..) of documents (doc_id, doc_len, tf0, tf1, ..: of each distinct term) that hold a term."""
    distinct = list(dict.fromkeys(terms))
    stats = counts.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(distinct))))
    joined = counts.filter(" OR ".join(f"tf{i} > 0" for i in range(len(distinct))) or "false").crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i, w in enumerate(distinct):
        score = score + terms.count(w) * F.when(F.col(f"tf{i}") > 0, term_score(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("doc_len"), F.col("n_docs"), F.col("avg_len"), k1, b)).otherwise(0.0)
    return joined.select("doc_id", score.alias("score"), *more).filter("score > 0")


def bm25_search(docs: DataFrame, query: str, k: int, **options) -> DataFrame:
    return bm25(docs, query_terms(query), k, **options)


def phrase_search(docs: DataFrame, phrase: str, k: int | None = None, language: str | None = None, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, positions) of documents that hold the terms one after another; positions start at 0.

    With a language, words and phrase are stemmed. The score is the sum of the terms' BM25.
    """
    words = query_terms_all(phrase)
    if not words:
        raise ValueError("the phrase has no terms")
    each = docs.select(F.col(doc_col).alias("doc_id"), once(tokens(F.col(text_col))).alias("t"))
    if language:
        words = [stem(w, language) for w in words]
        counts = _stem_counts(each, words, language)
    else:
        starts = F.filter(F.sequence(F.lit(0), F.size("t") - len(words)), lambda i: F.slice("t", i + 1, len(words)) == F.array(*map(F.lit, words)))
        held = (F.size("t") >= len(words)) & F.array_contains("t", words[0])
        counts = each.select("doc_id", F.size("t").alias("doc_len"), *((F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(dict.fromkeys(words))), F.when(held, starts).otherwise(F.array().cast("array<int>")).alias("positions"))
    # a few numbers a document, which statistics and scores both read: the texts are cut once
    found = _with_score(settle(counts, "phrase"), words, K1, B, "positions").filter(F.size("positions") > 0)
    return found.orderBy(F.desc("score"), "doc_id").limit(k) if k else found


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each array begins among all values (and where the last ends), from 0, and the values."""
    ends = column.offsets.to_numpy()
    return ends - ends[0], column.values.slice(ends[0], ends[-1] - ends[0])


def _stem_counts(each: DataFrame, words: Sequence[str], language: str) -> DataFrame:
    """(doc_id, doc_len, tf0, tf1, .., positions) of documents (doc_id, t) for stems: only a batch's distinct tokens are stemmed."""
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    want = [place[w] for w in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ends, values = _flat(batch.column("t"))
            sizes, coded = np.diff(ends), values.dictionary_encode()
            which = np.empty(len(coded.dictionary), np.int64)
            for i, w in enumerate(coded.dictionary.to_pylist()):
                if (at := known.get(w)) is None:
                    at = known[w] = place.get(stem(w, language), -1)
                which[i] = at
            if len(known) > STEMS:
                known.clear()
            found = which[coded.indices.to_numpy()]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            out = {"doc_id": batch.column("doc_id"), "doc_len": pa.array(sizes, pa.int32())}
            for i in range(len(place)):
                out[f"tf{i}"] = pa.array(np.bincount(doc[found == i], minlength=len(sizes)), pa.int32())
            n = max(0, len(found) - len(want) + 1)
            begins = doc[:n] == doc[len(want) - 1 :][:n]
            for i, w in enumerate(want):
                begins &= found[i : i + n] == w
            at = np.flatnonzero(begins)
            own = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(sizes)))]).astype(np.int32)
            out["positions"] = pa.ListArray.from_arrays(own, pa.array(at - ends[doc[at]], pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    number = IntegerType()
    return each.mapInArrow(run, StructType([each.schema["doc_id"], StructField("doc_len", number), *(StructField(f"tf{i}", number) for i in range(len(place))), StructField("positions", ArrayType(number))]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of documents (doc_id, t) in runs by term and document; a run's last row has no term, but its tokens and documents."""
    for batch in batches:
        ends = _flat(batch.column("t"))[0]
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + RUN, "right")) - 1)
            part = batch.slice(begin, end - begin)
            begin = end
            starts, values = _flat(part.column("t"))
            sizes, coded = np.diff(starts), values.dictionary_encode()
            by_term = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(by_term), np.int64)
            rank[by_term] = np.arange(len(by_term))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            key = rank[coded.indices.to_numpy()] * len(sizes) + doc
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            term, owner = np.divmod(key[first], len(sizes))
            total = len(key)
            yield pa.RecordBatch.from_pydict({
                "term": pa.concat_arrays([coded.dictionary.take(pa.array(by_term[term])), pa.nulls(1, coded.dictionary.type)]),
                "doc_id": pa.concat_arrays([part.column("doc_id").take(pa.array(owner)), pa.nulls(1, part.column("doc_id").type)]),
                "doc_len": pa.array(np.append(sizes[owner], total), pa.int32()),
                "positions": pa.ListArray.from_arrays(np.append(first, [total, total + 1]).astype(np.int32), pa.array(np.append((np.arange(total) - starts[doc])[order], len(sizes)), pa.int32())),
            })


class Postings:
    """An inverted index in Parquet: a search reads the postings of its own terms, not the texts.

    Rows (term, doc_id, doc_len, positions) lie in runs of some documents each, sorted by term and doc_id, so nothing is
    shuffled to build them and a filter on terms prunes the pages of every run by their least and greatest term. The
    corpus's size and mean length lie beside them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.rows, self.stats = spark.read.parquet(f"{path}/postings").filter("term IS NOT NULL"), spark.read.parquet(f"{path}/stats")

    @staticmethod
    def build(docs: DataFrame, path: str, doc_col: str = "doc_id", text_col: str = "text") -> "Postings":
        """Index docs; a null text has no terms and still counts as a document."""
        each = docs.select(F.col(doc_col).alias("doc_id"), tokens(F.col(text_col)).alias("t"))
        schema = StructType([StructField("term", StringType()), StructField("doc_id", each.schema["doc_id"].dataType), StructField("doc_len", IntegerType()), StructField("positions", ArrayType(IntegerType()))])
        each.mapInArrow(_runs, schema).write.mode("overwrite").parquet(f"{path}/postings")
        ends = docs.sparkSession.read.schema(schema).parquet(f"{path}/postings").filter("term IS NULL")
        documents = F.coalesce(F.sum(F.get("positions", F.lit(0))), F.lit(0).cast("long"))
        ends.agg(documents.alias("n_docs"), (F.sum("doc_len") / documents).alias("avg_len")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return Postings(docs.sparkSession, path)

    def _scored(self, terms: Sequence[str], *also: Column) -> DataFrame:
        """(doc_id, score, also..): also are aggregates over a document's postings (term, at)."""
        hit = self.rows.filter(F.col("term").isin(*set(terms))).select("term", "doc_id", "doc_len", F.size("positions").alias("tf"), *([F.col("positions").alias("at")] if also else []))
        counts = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a query term
        met = hit.join(F.broadcast(counts), "term").crossJoin(F.broadcast(self.stats))  # stats is one row
        weight = F.element_at(F.create_map(*(F.lit(x) for t in set(terms) for x in (t, terms.count(t)))), F.col("term"))
        score = weight * term_score(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("n_docs"), F.col("avg_len"))
        return met.groupBy("doc_id").agg(F.sum(score).alias("score"), *also).filter("score > 0")

    def search(self, query: str, k: int) -> DataFrame:
        """(doc_id, score) of the k best documents by BM25."""
        terms = query_terms(query)
        if not terms:
            raise ValueError("the query has no terms")
        return self._scored(terms).orderBy(F.desc("score"), "doc_id").limit(k)

    def phrase(self, phrase: str, k: int | None = None) -> DataFrame:
        """(doc_id, score, positions) of documents that hold the terms one after another, as phrase_search gives them."""
        words = query_terms_all(phrase)
        if not words:
            raise ValueError("the phrase has no terms")
        named = {w: f"at{i}" for i, w in enumerate(dict.fromkeys(words))}
        found = self._scored(words, *(F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("at")))).alias(n) for w, n in named.items()))
        found = found.filter(" AND ".join(f"size({n}) > 0" for n in named.values()))
        begins = lambda i, w: F.transform(named[w], lambda at: at - i)
        starts = F.col(named[words[0]])
        for i, w in enumerate(words[1:], 1):
            starts = F.array_intersect(starts, begins(i, w))
        found = found.select("doc_id", "score", F.sort_array(starts).alias("positions")).filter(F.size("positions") > 0)
        return found.orderBy(F.desc("score"), "doc_id").limit(k) if k else found


def query_terms_all(phrase: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", phrase.translate({c: c + 32 for c in range(65, 91)}))


def sparse_topk(vectors: DataFrame, query: dict[int, float], k: int | None = None, min_score: float | None = None, id_col: str = "id", dim_col: str = "dim", value_col: str = "value") -> DataFrame:
    """(id, score): dot product with rows of a long table (id, dim, value); only the query's dimensions are read."""
    if not query:
        raise ValueError("the query is empty")
    weight = F.element_at(F.create_map(*(x for d, w in query.items() for x in (F.lit(d), F.lit(float(w))))), F.col(dim_col))
    hit = vectors.filter(F.col(dim_col).isin(*query)).groupBy(id_col).agg(F.sum(F.col(value_col).cast("double") * weight).alias("score"))
    if min_score is not None:
        hit = hit.filter(F.col("score") >= min_score)
    return hit.orderBy(F.desc("score"), id_col).limit(k) if k else hit
