"""Exact nearest-neighbour search: single, batch, range, threshold, filtered, grouped, recommended, diversified."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.distance import distance_to, matrix, of_pairs, rough

Vector = Sequence[float]


def vector_of(df: DataFrame, key: int, id_col: str = "id", vec_col: str = "embedding") -> list[float]:
    """The vector of one row (a point lookup that the scan filters)."""
    row = df.filter(F.col(id_col) == key).select(vec_col).first()
    if row is None or row[0] is None:
        raise KeyError(f"no vector with {id_col} = {key}")
    return [float(x) for x in row[0]]


def with_distance(df: DataFrame, query: Vector, metric: str = "cosine", vec_col: str = "embedding") -> DataFrame:
    # A generator of one row: a filter above reads the distance instead of computing it anew, in code that is too deep to compile.
    return df.withColumn("distance", F.explode(F.array(distance_to(metric, vec_col, query))))


def topk(df: DataFrame, query: Vector, k: int, metric: str = "cosine", where: Column | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows, ties by id; `where` holds before ranking, so it never costs neighbours."""
    rows = df.filter(where) if where is not None else df
    return with_distance(rows, query, metric, vec_col).filter("distance IS NOT NULL").orderBy("distance", id_col).limit(k)


def topk_postfiltered(df: DataFrame, query: Vector, k: int, where: Column, oversample: int = 4, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The other order, for callers that need it: the nearest k * oversample rows, then the filter, then k."""
    return topk(df, query, k * oversample, metric, None, id_col, vec_col).filter(where).orderBy("distance", id_col).limit(k)


def within(df: DataFrame, query: Vector, radius: float, metric: str = "cosine", limit: int | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """All rows at most `radius` away, nearest first when limited."""
    if radius < 0 and metric != "dot":
        raise ValueError("radius must not be negative")
    near = with_distance(df, query, metric, vec_col).filter(F.col("distance") <= radius)
    return near.orderBy("distance", id_col).limit(limit) if limit else near


def topk_threshold(df: DataFrame, query: Vector, k: int, threshold: float, metric: str = "cosine", id_col: str = "id") -> DataFrame:
    return topk(df, query, k, metric, None, id_col).filter(F.col("distance") <= threshold)


class Nearest:
    """The k nearest rows so far of each of a block of queries, by distance and then id."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = q, k, metric
        self.distance = np.full((len(q), k), np.inf)
        self.id = np.full((len(q), k), np.iinfo(np.int64).max)

    def bound(self) -> np.ndarray:
        """What a row may be away from each query to count; infinite while a query has less than k rows."""
        return self.distance[:, -1]

    def offer(self, x: np.ndarray, ids: np.ndarray, may: np.ndarray | None = None) -> None:
        """Take in a block of rows; may: which pairs of query and row count (queries by rows), all if left out."""
        if may is None or np.count_nonzero(may) > may.size >> 4:
            d, off = rough(self.metric, self.q, x)
            bound = self.bound()
            if len(ids) > self.k and (open_ := np.flatnonzero(np.isinf(bound))).size:
                bound, some = bound.copy(), d[open_]
                if may is not None:
                    some[~may[open_]] = np.inf
                bound[open_] = np.partition(some, self.k - 1, axis=1)[:, self.k - 1]
            enters = d <= (bound + 2 * off).astype(d.dtype)[:, None]  # the few rows that may enter
            may = enters if may is None else enters & may
        r, c = np.nonzero(may)
        if not len(r):
            return
        d = np.concatenate([of_pairs(self.metric, self.q[r[i : i + 65536]], x[c[i : i + 65536]]) for i in range(0, len(r), 65536)])
        enters = d <= self.bound()[r]
        r, c, d = r[enters], c[enters], d[enters]
        at = np.unique(r)  # the queries whose rows change
        n, k = len(at), self.k
        row, dist = np.append(np.repeat(np.arange(n), k), np.searchsorted(at, r)), np.append(self.distance[at].ravel(), d)
        name = np.append(self.id[at].ravel(), ids[c])
        order = np.lexsort((name, dist, row))
        best = order[np.searchsorted(row[order], np.arange(n))[:, None] + np.arange(k)]
        self.distance[at], self.id[at] = dist[best], name[best]

    def found(self, names: np.ndarray) -> pa.RecordBatch:
        """(query_id, id, distance); names: the queries' ids."""
        r, c = np.nonzero(np.isfinite(self.distance))
        return pa.RecordBatch.from_pydict({"query_id": pa.array(names[r]), "id": pa.array(self.id[r, c]), "distance": pa.array(self.distance[r, c])})


def batch_topk(df: DataFrame, queries: np.ndarray, query_ids: Sequence[int], k: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding", block: int = 8192) -> DataFrame:
    """(query_id, id, distance, rank) of every query's k nearest rows.

    Queries (a driver-side array, so bounded) meet rows in blocks of vectors; a partition hands on k rows a
    query at most, and a window ranks those.
    """
    q = np.asarray(queries, np.float64)
    qid = np.asarray(query_ids, np.int64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_d = np.full((len(q), k), np.inf)
        top_i = np.full((len(q), k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                vectors = part.column("vector")
                good = np.array([v is not None and len(v) == q.shape[1] for v in vectors], bool) if vectors.null_count or len(vectors.flatten()) != len(part) * q.shape[1] else None
                if good is not None:
                    part = part.filter(pa.array(good))
                if not part.num_rows:
                    continue
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
                ids = part.column("id").to_numpy(zero_copy_only=False)
                for a in range(0, len(q), 256):
                    d, had, who = matrix(metric, q[a : a + 256], x), top_d[a : a + 256], top_i[a : a + 256]
                    bound = had[:, -1]
                    if len(ids) > k and np.isinf(bound).any():
                        bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
                    r, c = np.nonzero(d <= bound[:, None])  # the few rows that may enter
                    if not len(r):
                        continue
                    n = len(had)
                    row, dist = np.append(np.repeat(np.arange(n), k), r), np.append(had.ravel(), d[r, c])
                    name = np.append(who.ravel(), ids[c])
                    order = np.lexsort((name, dist, row))
                    best_ = order[np.searchsorted(row[order], np.arange(n))[:, None] + np.arange(k)]
                    top_d[a : a + 256], top_i[a : a + 256] = dist[best_], name[best_]
        r, c = np.nonzero(np.isfinite(top_d))
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(qid[r]), "id": pa.array(top_i[r, c]), "distance": pa.array(top_d[r, c])})

    near = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector")).mapInArrow(best, "query_id long, id long, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def join_topk(df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding", rows_block: int = 65_536, query_block: int = 65_536) -> DataFrame:
    """batch_topk for a query table of any size (same columns as df): blocks of queries meet blocks of rows, a task each.

    A pair of blocks hands on k rows a query; nothing of either table is collected. Small tables are cut
    into 8 blocks a side too, for as many tasks; all pairs are compared, so the work grows as their number.
    A task holds its two blocks and k rows a query.
    """
    n, q = df.count(), queries.count()
    rb, qb = (min(max(8, -(-m // block)), max(1, m // 1024)) for m, block in ((n, rows_block), (q, query_block)))
    salt = F.xxhash64(id_col)
    own, other = (lambda m, name: F.pmod(salt, F.lit(m)).cast("int").alias(name)), (lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name))
    of = lambda d: d.filter(F.col(vec_col).isNotNull())
    same = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector"), F.size(vec_col).alias("size")]  # only vectors of one length compare
    a = of(df).select(*same, own(rb, "r"), other(qb, "q"), F.lit(False).alias("asks"))
    b = of(queries).select(*same, other(rb, "r"), own(qb, "q"), F.lit(True).alias("asks"))

    def best(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group["asks"].to_numpy()
        vectors = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        ids, found = group["id"].to_numpy(), []
        at, rows = np.flatnonzero(asks), np.flatnonzero(~asks)
        x, x_ids = vectors[rows].astype(float), ids[rows]
        for i in range(0, len(at) if len(rows) else 0, 256):
            mine = at[i : i + 256]
            near = Nearest(vectors[mine].astype(float), k, metric)
            for j in range(0, len(rows), 2048):
                near.offer(x[j : j + 2048], x_ids[j : j + 2048])
            found.append(near.found(ids[mine]))
        return pa.Table.from_batches(found, pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())]))

    met = a.unionByName(b).repartitionByRange(2 * rb * qb, "r", "q")  # by hash, some tasks would get several pairs of blocks
    near = met.groupBy("r", "q", "size").applyInArrow(best, "query_id long, id long, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def join_within(df: DataFrame, radius: float, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding", block: int = 4096) -> DataFrame:
    """(a, b, distance), a < b, of all pairs at most `radius` apart, exactly: blocks of rows meet, a task each pair.

    The work grows with the square of the rows, as an exact join must without a structure to prune by; a task
    holds two blocks and hands on only pairs within the radius.
    """
    n = max(1, -(-df.count() // block))
    rows = df.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"), F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("own"))
    every = F.sequence(F.lit(0), F.lit(n - 1))
    spread = rows.withColumn("other", F.explode(every)).select("id", "vector", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def near(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["own"] == group["x"]], group[group["own"] == group["y"]]
        out = {"a": [], "b": [], "distance": []}
        if len(left) and len(right):
            v, w, ids, jds = np.array(left["vector"].tolist(), float), np.array(right["vector"].tolist(), float), left["id"].to_numpy(), right["id"].to_numpy()
            for at in range(0, len(v), 256):
                d = matrix(metric, v[at : at + 256], w)
                i, j = np.nonzero(d <= radius)
                a, b = ids[at + i], jds[j]
                keep = (a < b) if group["x"].iloc[0] == group["y"].iloc[0] else (a != b)
                out["a"] += np.minimum(a, b)[keep].tolist()
                out["b"] += np.maximum(a, b)[keep].tolist()
                out["distance"] += d[i, j][keep].tolist()
        return pd.DataFrame(out)

    return spread.groupBy("x", "y").applyInPandas(near, "a long, b long, distance double")


def multi_query_rrf(df: DataFrame, queries: np.ndarray, k: int, metric: str = "cosine", rrf_k: int = 60, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Several queries' 2k nearest each, fused: (id, score, distance, hits)."""
    near = batch_topk(df, queries, range(len(queries)), 2 * k, metric, id_col, vec_col)
    return near.groupBy("id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"), F.min("distance").alias("distance"), F.count(F.lit(1)).alias("hits")).orderBy(F.desc("score"), "id").limit(k)


def group_topk(df: DataFrame, query: Vector, by: str, groups: int = 10, hits: int = 3, metric: str = "cosine", oversample: int | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The nearest `groups` values of `by` (null left out) with up to `hits` rows each: (group, id, distance, group_rank, hit_rank).

    With oversample, only the nearest groups * hits * oversample rows are grouped; without, every row is.
    """
    rows = with_distance(df, query, metric, vec_col)
    if oversample:
        rows = rows.orderBy("distance", id_col).limit(groups * hits * oversample)
    rows = rows.filter(F.col(by).isNotNull()).select(F.col(by).alias("group"), F.col(id_col).alias("id"), "distance")
    each = rows.withColumn("hit_rank", F.row_number().over(W.partitionBy("group").orderBy("distance", "id"))).filter(F.col("hit_rank") <= hits)
    heads = each.filter("hit_rank = 1").orderBy("distance", "group").limit(groups)
    heads = heads.select("group", F.row_number().over(W.orderBy("distance", "group")).alias("group_rank"))  # `groups` rows
    return each.join(F.broadcast(heads), "group").select("group", "id", "distance", "group_rank", "hit_rank")


def _unit(v: np.ndarray) -> list[float]:
    n = float(np.sqrt((v * v).sum()))
    return (v / n if n else v).tolist()


def recommend(df: DataFrame, positive: np.ndarray, negative: np.ndarray | None, k: int, positive_weight: float = 1.0, negative_weight: float = 0.5, exclude: Sequence[int] = (), id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Nearest rows by cosine to the weighted mean of liked vectors less that of disliked ones."""
    q = positive_weight * np.asarray(positive, float).mean(0)
    if negative is not None and len(negative):
        q = q - negative_weight * np.asarray(negative, float).mean(0)
    where = ~F.col(id_col).isin(*exclude) if exclude else None
    return topk(df, _unit(q), k, "cosine", where, id_col, vec_col)


def discover(df: DataFrame, target: Vector, context: Vector, k: int, exclude: Sequence[int] = (), id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    where = ~F.col(id_col).isin(*exclude) if exclude else None
    return topk(df, _unit(np.asarray(target, float) - np.asarray(context, float)), k, "cosine", where, id_col, vec_col)


def weighted_centroid(target: Vector, context: Sequence[Vector], weights: Sequence[float]) -> list[float]:
    c = np.asarray(context, float).reshape(-1, len(target))
    w = np.asarray(weights, float)
    return ((np.asarray(target, float) + (w[:, None] * c).sum(0)) / (1 + np.abs(w).sum())).tolist()


def mmr(df: DataFrame, query: Vector, k: int, oversample: int = 4, balance: float = 0.7, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Maximal marginal relevance over the nearest k * oversample rows: (id, rank, score, relevance).

    Greedy, so sequential; the candidates are bounded by k * oversample and ranked in one small group.
    """
    balance = min(1.0, max(0.0, balance))
    near = topk(df, query, k * oversample, metric, None, id_col, vec_col).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"), "distance")

    def pick(rows):
        rows = rows.sort_values(["distance", "id"]).reset_index(drop=True)
        x = np.array(rows["vector"].tolist(), float)
        sim = similarity(metric, rows["distance"].to_numpy())
        low, high = (sim.min(), sim.max()) if len(sim) else (0, 0)
        rel = (sim - low) / (high - low) if high > low else np.ones(len(sim))
        pair = similarity(metric, matrix(metric, x, x)) if len(x) else np.zeros((0, 0))
        worst, free, out = np.zeros(len(x)), np.ones(len(x), bool), []
        for rank in range(min(k, len(x))):
            gain = np.where(free, balance * rel - (1 - balance) * (worst if rank else 0), -np.inf)
            at = int(gain.argmax())
            out.append((rows["id"][at], rank + 1, float(gain[at]), float(rel[at])))
            free[at] = False
            worst = pair[at] if not rank else np.maximum(worst, pair[at])
        return pd.DataFrame(out, columns=["id", "rank", "score", "relevance"])

    return near.withColumn("_sk_all", F.lit(1)).groupBy("_sk_all").applyInPandas(pick, "id long, rank int, score double, relevance double")


def similarity(metric: str, d):
    """A similarity that falls with the distance: cosine 1 - d/2, dot a logistic curve, else 1 / (1 + d)."""
    if metric == "cosine":
        return 1 - d / 2
    if metric == "dot":
        return 1 / (1 + np.exp(d))
    return 1 / (1 + d)


def best_chunk_topk(chunks: DataFrame, query: Vector, k: int, mode: str = "max", metric: str = "cosine", doc_col: str = "doc_id", chunk_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """Documents by their chunks' distances: the least (max similarity), the mean or the sum; with the best chunk."""
    agg = {"max": F.min, "avg": F.avg, "sum": F.sum}[mode]
    d = with_distance(chunks, query, metric, vec_col).filter("distance IS NOT NULL")
    best = F.min(F.struct("distance", chunk_col))
    return d.groupBy(doc_col).agg(agg("distance").alias("distance"), best[chunk_col].alias("best_chunk")).orderBy("distance", doc_col).limit(k)


def maxsim(tokens: DataFrame, query: np.ndarray, k: int, doc_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    """Late interaction: the sum over query tokens of the best dot product with a document's tokens; greatest first."""
    best = [F.max(-distance_to("dot", vec_col, q.tolist())).alias(f"q{i}") for i, q in enumerate(np.asarray(query, float))]
    each = tokens.groupBy(doc_col).agg(*best)
    total = sum((F.col(f"q{i}") for i in range(1, len(best))), F.col("q0"))
    return each.select(doc_col, total.alias("score")).orderBy(F.desc("score"), doc_col).limit(k)
