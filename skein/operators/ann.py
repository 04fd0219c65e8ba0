"""Approximate search as pruning: inverted lists (plain, scalar- or product-coded, replicated) and LSH tables.

An index is a table with a list or bucket column; a search reads only the probed ones and reranks exactly.
Graph indexes (HNSW, Vamana) have no use on a cluster: their searches are given by inverted lists or exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skein.functions.distance import distance, distance_to
from skein.plans.storage import settle

#: Vectors that centres and codebooks are fitted on, at most.
SAMPLE = 20_000


def sample_vectors(df: DataFrame, id_col: str = "id", vec_col: str = "embedding", n: int = SAMPLE) -> np.ndarray:
    rows = df.filter(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(n).select(vec_col).collect()
    return np.array([r[0] for r in rows], float)


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(0)
    return centres


@dataclass
class InvertedLists:
    """Centres, and rows with their list_id; border keeps a row in its second list too when that is nearly as near."""

    centres: np.ndarray
    rows: DataFrame

    @staticmethod
    def build(df: DataFrame, lists: int = 64, border: float = 0.0, id_col: str = "id", vec_col: str = "embedding") -> "InvertedLists":
        centres = kmeans(sample_vectors(df, id_col, vec_col), lists)
        @pandas_udf("array<int>")
        def assign(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), float)
            d = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0))
            two = np.argsort(d, axis=1, kind="stable")[:, :2]
            one = np.take_along_axis(d, two, 1)
            return pd.Series([t[:2].tolist() if border and len(t) > 1 and m[1] <= border * m[0] else t[:1].tolist() for t, m in zip(two, one)])

        rows = df.filter(F.col(vec_col).isNotNull()).withColumn("list_id", F.explode(assign(F.col(vec_col))))
        return InvertedLists(centres, settle(rows, "lists"))

    def save(self, path: str) -> None:
        """Partitioned by list, so that a probe reads only its folders."""
        self.rows.write.partitionBy("list_id").parquet(path)

    def probe(self, query: Sequence[float], nprobe: int) -> list[int]:
        d = ((self.centres - np.asarray(query, float)) ** 2).sum(1)
        return np.argsort(d, kind="stable")[:nprobe].tolist()

    def search(self, query: Sequence[float], k: int, nprobe: int = 4, metric: str = "euclidean", where: Column | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
        rows = self.rows.filter(F.col("list_id").isin(self.probe(query, nprobe)))
        rows = rows.filter(where) if where is not None else rows
        near = rows.select(F.col(id_col).alias("id"), distance_to(metric, vec_col, query).alias("distance"))
        return near.groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(k)  # a border row is in two lists


def pq_train(x: np.ndarray, subspaces: int = 8, codes: int = 64, seed: int = 42) -> np.ndarray:
    width = x.shape[1] // subspaces
    return np.stack([kmeans(x[:, s * width : (s + 1) * width], codes, 12, seed) for s in range(subspaces)])


def pq_encode(vec: Column, books: np.ndarray) -> Column:
    @pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), float).reshape(len(v), books.shape[0], books.shape[2])
        near = np.stack([((books[s] ** 2).sum(1) - 2 * x[:, s] @ books[s].T).argmin(1) for s in range(books.shape[0])], 1)
        return pd.Series(near.tolist())

    return run(vec)


def pq_distance(codes: Column, books: np.ndarray, query: Sequence[float]) -> Column:
    """Table-lookup distance of a query to codes: one literal table a subspace."""
    q = np.asarray(query, float).reshape(books.shape[0], books.shape[2])
    total = F.lit(0.0)
    for s in range(len(books)):
        table = F.array(*map(F.lit, ((books[s] - q[s]) ** 2).sum(1).tolist()))
        total = total + F.get(table, F.get(codes, F.lit(s)))
    return F.sqrt(total)


def pq_search(coded: DataFrame, books: np.ndarray, query: Sequence[float], k: int, rerank: int = 200, metric: str = "euclidean", id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The `rerank` nearest by code (column codes), then the k nearest of them exactly."""
    near = coded.withColumn("_sk_adc", pq_distance(F.col("codes"), books, query)).orderBy("_sk_adc", id_col).limit(max(k, rerank))
    return near.select(F.col(id_col).alias("id"), distance_to(metric, vec_col, query).alias("distance")).orderBy("distance", "id").limit(k)


def sq8_search(rows: DataFrame, codebook: DataFrame, query: Sequence[float], k: int, rerank: int = 100, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The `rerank` nearest by 8-bit codes (column codes), then the k nearest of them exactly."""
    from skein.operators.quant import code_distance

    near = rows.withColumn("_sk_sq", code_distance(F.col("codes"), list(query), codebook)).orderBy("_sk_sq", id_col).limit(max(k, rerank))
    return near.select(F.col(id_col).alias("id"), distance_to("euclidean", vec_col, query).alias("distance")).orderBy("distance", "id").limit(k)


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated_codes(vec: Column, dim: int, bits: int = 4, seed: int = 42) -> Column:
    """(norm, codes): a unit vector, rotated at random so that its components are alike, in `bits` bits each."""
    turn, top = rotation(dim, seed), (1 << bits) - 1
    span = 3.0 / np.sqrt(dim)

    @pandas_udf("struct<norm:double,codes:array<int>>")
    def run(v: pd.Series) -> pd.DataFrame:
        x = np.array(v.tolist(), float).reshape(len(v), dim)
        norm = np.sqrt((x * x).sum(1))
        y = x / np.where(norm == 0, 1, norm)[:, None] @ turn
        codes = np.clip(np.floor((y + span) / (2 * span) * top + 0.5), 0, top).astype(int)
        return pd.DataFrame({"norm": norm, "codes": codes.tolist()})

    return run(vec)


def rotated_search(coded: DataFrame, query: Sequence[float], k: int, bits: int = 4, rerank: int = 100, seed: int = 42, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Greatest dot product with the rotated codes (column code), then exact cosine."""
    q = np.asarray(query, float) @ rotation(len(query), seed)
    span, top = 3.0 / np.sqrt(len(query)), (1 << bits) - 1
    approx = -distance("dot", F.transform("code.codes", lambda c: c * (2 * span / top) - span), q.tolist())
    near = coded.withColumn("_sk_dot", approx).orderBy(F.desc("_sk_dot"), id_col).limit(max(k, rerank))
    return near.select(F.col(id_col).alias("id"), distance_to("cosine", vec_col, query).alias("distance")).orderBy("distance", "id").limit(k)


def token_set_vectors(sets: DataFrame, dim: int, projections: int = 10, reduced: int = 16, seed: int = 42, col: str = "tokens") -> Column:
    """One unit vector a set of token vectors: for each random plane, the mean of a random reduction of the tokens on either side."""
    rng = np.random.default_rng(seed)
    planes, mats = rng.standard_normal((projections, dim)), rng.standard_normal((projections, dim, reduced)) / np.sqrt(reduced)

    @pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        def one(tokens):
            x = np.array([list(t) for t in tokens], float).reshape(-1, dim)
            out = []
            for p, m in zip(planes, mats):
                side, y = x @ p > 0, x @ m
                out += [y[s].mean(0) if s.any() else np.zeros(reduced) for s in (side, ~side)]
            flat = np.concatenate(out)
            n = np.sqrt((flat * flat).sum())
            return (flat / n if n else flat).tolist()

        return v.map(one)

    return run(F.col(col))


def lsh_keys(vec: Column, dim: int, tables: int = 8, bits: int = 12, seed: int = 42) -> Column:
    """An array of (table, bucket) structs: signs of random projections."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))

    @pandas_udf("array<long>")
    def run(v: pd.Series) -> pd.Series:
        x = np.array(v.tolist(), float).reshape(len(v), dim)
        signs = (x @ planes.T > 0).reshape(len(v), tables, bits)
        return pd.Series(((signs * (1 << np.arange(bits))).sum(2) + (np.arange(tables) << bits)).tolist())

    return run(vec)


def lsh_search(df: DataFrame, query: Sequence[float], k: int, metric: str = "euclidean", tables: int = 8, bits: int = 12, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Exact ranking of the rows that share a bucket with the query."""
    planes = np.random.default_rng(42).standard_normal((tables * bits, len(query)))
    mine = ((planes @ np.asarray(query, float) > 0).reshape(tables, bits) * (1 << np.arange(bits))).sum(1) + (np.arange(tables) << bits)
    hit = df.filter(F.arrays_overlap(lsh_keys(F.col(vec_col), len(query), tables, bits), F.array(*map(F.lit, mine.tolist()))))
    return hit.select(F.col(id_col).alias("id"), distance_to(metric, vec_col, query).alias("distance")).orderBy("distance", "id").limit(k)


def lsh_pairs(df: DataFrame, epsilon: float, tables: int = 8, bits: int | None = None, dim: int = 64, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, distance), a < b, of rows that share a bucket and lie within epsilon.

    Unless given, bits follow the rows, so that a bucket holds a few rows at any size.
    """
    bits = bits or min(40, max(12, (df.count() // 4).bit_length()))
    keyed = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.explode(lsh_keys(F.col(vec_col), dim, tables, bits)).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance("euclidean", F.col("a.v"), F.col("b.v")).alias("distance"))
    return met.filter(F.col("distance") <= epsilon).distinct()


def first_wins(df: DataFrame, pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows that insertion in id order would keep: a row goes if a kept row before it is its duplicate.

    Settled in rounds: a row is kept when all its earlier partners are gone, gone when one of them is kept.
    """
    from skein.plans.storage import drop, settle

    open_ = settle(pairs.select("a", "b").distinct(), "pairs")
    gone = None
    while not open_.isEmpty():
        later = open_.select(F.col("b").alias("a")).distinct()
        kept = open_.select("a").distinct().join(later, "a", "left_anti")
        lost = settle(open_.join(kept, "a", "left_semi").select("b").distinct(), "gone")
        gone = lost if gone is None else gone.union(lost)
        after = settle(open_.join(kept, "a", "left_anti").join(lost, "b", "left_anti").join(lost.withColumnRenamed("b", "a"), "a", "left_anti"), "pairs")
        drop(open_)
        open_ = after
    return df if gone is None else df.join(gone.withColumnRenamed("b", id_col), id_col, "left_anti")
