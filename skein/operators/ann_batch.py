"""Approximate search of many queries at once: one scorer an index family, one pass over the rows that may count.

A scorer gives, for blocks of queries and rows, the distance of each query to each row's code, infinite where the
index rules the row out. A row knows how far its code lies off it (`error`), so a code rules its row out where the
row can't be among the nearest; whatever a code leaves open is ranked by its exact distance. Families compose:
inverted lists rule rows out, codes rank the rest. A task holds a block of queries by a block of rows and, a query,
its k nearest so far, whatever the tables' sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from skein.functions.distance import of_pairs, rough
from skein.operators.ann import kmeans, rotation, sample_vectors
from skein.operators.knn import Nearest
from skein.plans.storage import settle

#: Of a block of rows (vectors, columns): the distances to their codes, queries by rows.
Scorer = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]
#: Queries and rows that meet at once, and pairs in a batch that a range search hands on.
QUERIES, ROWS, PAIRS = 256, 2048, 50_000
#: Columns of one number a row; other columns of codes are arrays of ints.
NUMBERS = ("error", "norm")


@dataclass
class Index:
    """Rows with the columns that a scorer reads, and the scorer of a set of queries; lists tells which lists it probes."""

    rows: DataFrame
    columns: tuple[str, ...]
    scorer: Callable[[np.ndarray], Scorer]
    lists: Callable[[np.ndarray], list[int]] | None = None


def _numpy(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of arrays of one length as a matrix."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _coded(df: DataFrame, code: Callable[[np.ndarray], dict[str, np.ndarray]], names: Sequence[str]) -> DataFrame:
    """df's rows with a vector, and names..; code gives an array of ints, or one number, a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = code(_numpy(batch.column("embedding")).astype(float))
                for n in names:
                    if n in NUMBERS:
                        batch = batch.append_column(n, pa.array(found[n], pa.float64()))
                    else:
                        each = found[n].reshape(batch.num_rows, -1)
                        batch = batch.append_column(n, pa.ListArray.from_arrays(np.arange(0, each.size + 1, each.shape[1], dtype=np.int32), pa.array(each.ravel(), pa.int32())))
                yield batch

    some = df.filter("embedding IS NOT NULL")
    return some.mapInArrow(run, StructType([*some.schema.fields, *(StructField(n, DoubleType() if n in NUMBERS else ArrayType(IntegerType())) for n in names)]))


def _off(x: np.ndarray, decoded: np.ndarray) -> np.ndarray:
    """How far rows lie off their decoded codes."""
    return np.sqrt(((x - decoded) ** 2).sum(1))


def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def flat(df: DataFrame) -> Index:
    """Every row, by its own vector."""
    return Index(df.select("id", "embedding"), (), lambda q: lambda x, _: rough("euclidean", q, x)[0])


def inverted(df: DataFrame, lists: int = 64, nprobe: int = 4, inner: Callable[[DataFrame, np.ndarray], Index] | None = None) -> Index:
    """Rows in the list of their nearest centre; a query looks into its nprobe nearest lists, ranked by `inner` or exactly."""
    centres = kmeans(sample_vectors(df), lists)
    base = (inner or (lambda d, _: flat(d)))(df, centres)
    placed = _coded(base.rows, lambda x: {"list": _near(x, centres)}, ("list",))
    columns, inner_scorer = base.columns, base.scorer
    rows = placed.select("id", "embedding", *columns, F.get("list", F.lit(0)).alias("list_id"))

    def probes(q: np.ndarray) -> np.ndarray:
        apart = (q * q).sum(1)[:, None] - 2 * q @ centres.T + (centres**2).sum(1)
        return np.argsort(apart, axis=1, kind="stable")[:, :nprobe]

    def scorer(q: np.ndarray) -> Scorer:
        rank, open_ = inner_scorer(q), np.zeros((len(q), len(centres)), bool)
        np.put_along_axis(open_, probes(q), True, 1)
        return lambda x, c: np.where(open_[:, c["list_id"]], rank(x, c), np.inf)

    return Index(settle(rows, "lists"), (*columns, "list_id"), scorer, lambda q: np.unique(probes(q)).tolist())


def product(df: DataFrame, subspaces: int = 8, codes: int = 64, centres: np.ndarray | None = None) -> Index:
    """Product codes of vectors, or of what they lie off their centre; a block's distances are one product with its decoded codes."""
    sample = sample_vectors(df)
    rest = sample - centres[_near(sample, centres)] if centres is not None else sample
    width = sample.shape[1] // subspaces
    books = np.stack([kmeans(rest[:, s * width : (s + 1) * width], codes, 12) for s in range(subspaces)])

    def decode(c: np.ndarray) -> np.ndarray:
        parts = np.concatenate([books[s][c[:, s]] for s in range(subspaces)], 1)
        return parts + centres[c[:, -1]] if centres is not None else parts

    def code(x: np.ndarray) -> dict[str, np.ndarray]:
        home = _near(x, centres) if centres is not None else np.zeros(len(x), int)
        parts = (x - centres[home] if centres is not None else x).reshape(len(x), subspaces, width)
        near = np.stack([_near(parts[:, s], books[s]) for s in range(subspaces)], 1)
        found = np.concatenate([near, home[:, None]], 1)
        return {"codes": found, "error": _off(x, decode(found))}

    return Index(_coded(df.select("id", "embedding"), code, ("codes", "error")), ("codes", "error"), lambda q: lambda _, c: rough("euclidean", q, decode(c["codes"]))[0])


def scalar(df: DataFrame, bits: int = 8) -> Index:
    """Each component in `bits` bits between its least and greatest value over all rows."""
    each = df.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()
    lo, hi = np.array([r["lo"] for r in each], float), np.array([r["hi"] for r in each], float)
    step = np.where(hi > lo, hi - lo, 1.0) / ((1 << bits) - 1)

    def code(x: np.ndarray) -> dict[str, np.ndarray]:
        found = np.floor((x - lo) / step + 0.5).astype(int)
        return {"codes": found, "error": _off(x, lo + found * step)}

    return Index(_coded(df.select("id", "embedding"), code, ("codes", "error")), ("codes", "error"), lambda q: lambda _, c: rough("euclidean", q, lo + c["codes"] * step)[0])


def rotated(df: DataFrame, bits: int = 4, seed: int = 42) -> Index:
    """Unit vectors, turned at random so that their components are alike, in `bits` bits each, and the vectors' lengths."""
    dim = df.select(F.size("embedding")).filter("size(embedding) > 0").first()[0]
    turn, top, span = rotation(dim, seed), (1 << bits) - 1, 3.0 / np.sqrt(dim)

    def decode(c: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return norm[:, None] * ((c * (2 * span / top) - span) @ turn.T)

    def code(x: np.ndarray) -> dict[str, np.ndarray]:
        norm = np.sqrt((x * x).sum(1))
        found = np.clip(np.floor((x / np.where(norm == 0, 1, norm)[:, None] @ turn + span) / (2 * span) * top + 0.5), 0, top).astype(int)
        return {"codes": found, "norm": norm, "error": _off(x, decode(found, norm))}

    names = ("codes", "norm", "error")
    return Index(_coded(df.select("id", "embedding"), code, names), names, lambda q: lambda _, c: rough("euclidean", q, decode(c["codes"], c["norm"]))[0])


def hashed(df: DataFrame, tables: int = 16, bits: int = 8, seed: int = 42) -> Index:
    """Random-plane buckets in several tables; a row counts if it shares one with the query."""
    dim = df.select(F.size("embedding")).filter("size(embedding) > 0").first()[0]
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))
    small = np.min_scalar_type((1 << bits) - 1)

    def keys(x: np.ndarray) -> np.ndarray:
        return ((x @ planes.T > 0).reshape(len(x), tables, bits) * (1 << np.arange(bits))).sum(2)

    def scorer(q: np.ndarray) -> Scorer:
        mine = keys(q).astype(small)

        def run(x: np.ndarray, c: dict[str, np.ndarray]) -> np.ndarray:
            theirs, met = c["codes"].astype(small), np.zeros((len(q), len(x)), bool)
            for t in range(tables):  # a block of bits a table, never a block of all tables
                met |= mine[:, t, None] == np.ascontiguousarray(theirs[:, t])
            return np.where(met, rough("euclidean", q, x)[0], np.inf)

        return run

    return Index(_coded(df.select("id", "embedding"), lambda x: {"codes": keys(x)}, ("codes",)), ("codes",), scorer)


def _blocks(index: Index, q: np.ndarray, run: Callable[[Iterator], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over (place and distances to codes of a block of queries, vectors, ids, errors of a block of rows), in as many tasks as there are cores.

    A task's result grows with the queries, so more tasks than cores would only multiply it.
    """
    rows, columns, make = index.rows.select("id", "embedding", *index.columns), index.columns, index.scorer
    if index.lists is not None:
        rows = rows.filter(F.col("list_id").isin(index.lists(q)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator:
        scorers = [(a, make(q[a : a + QUERIES])) for a in range(0, len(q), QUERIES)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, c = _numpy(part.column("embedding")).astype(float), {n: _numpy(part.column(n)) for n in columns}
                ids, error = _numpy(part.column("id")).astype(np.int64), c.get("error", np.zeros(len(x)))
                for a, score in scorers:
                    yield a, score(x, c), x, ids, error

    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(lambda batches: run(each(batches)), schema)


def _slack(q: np.ndarray, x: np.ndarray, error: np.ndarray) -> np.ndarray:
    """error, and what rounding may take off a distance."""
    return error + 2e-6 * (np.sqrt((q * q).sum(1).max(initial=0)) + np.sqrt((x * x).sum(1).max(initial=0)) + error)


def search(index: Index, queries: np.ndarray, ids: Sequence[int], k: int, keep: int | None = None, metric: str = "euclidean") -> DataFrame:
    """(query_id, id, distance, rank): of a stated set of queries the k nearest by exact distance of the rows that the index lets pass.

    The `keep` nearest of a block by code are ranked first; then all whose code doesn't rule out that they are
    nearer. Codes bound Euclidean distances: for another metric every row that passes is ranked.
    """
    q, qid, most = np.asarray(queries, float), np.asarray(ids, np.int64), max(k, keep or k)

    def run(blocks: Iterator) -> Iterator[pa.RecordBatch]:
        best: dict[int, Nearest] = {}
        for a, approx, x, row, error in blocks:
            near = best.setdefault(a, Nearest(q[a : a + QUERIES], k, metric))
            if metric != "euclidean":
                near.offer(x, row, np.isfinite(approx))
                continue
            first = np.flatnonzero(np.isinf(near.bound()))
            if len(first) and approx.shape[1] > most:
                chosen = np.zeros(approx.shape, bool)
                chosen[first[:, None], np.argpartition(approx[first], most - 1, axis=1)[:, :most]] = True
                chosen &= np.isfinite(approx)
                near.offer(x, row, chosen)
            else:
                chosen = None
            may = approx <= near.bound()[:, None] + _slack(near.q, x, error)
            may &= np.isfinite(approx)
            near.offer(x, row, may & ~chosen if chosen is not None else may)
        for a, near in best.items():
            yield near.found(qid[a : a + QUERIES])

    found = _blocks(index, q, run, "query_id long, id long, distance double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def within(index: Index, queries: np.ndarray, ids: Sequence[int], radius: float, slack: float | None = None, metric: str = "euclidean") -> DataFrame:
    """(query_id, id, distance) of all rows within a radius that the index lets pass: those whose code isn't off by enough to rule them out.

    slack: no code is off by more, where the caller knows; a row's own error counts where it is less.
    """
    q, qid = np.asarray(queries, float), np.asarray(ids, np.int64)

    def run(blocks: Iterator) -> Iterator[pa.RecordBatch]:
        made, n = [], 0
        for a, approx, x, row, error in blocks:
            mine = q[a : a + QUERIES]
            may = np.isfinite(approx)
            if metric == "euclidean":
                may &= approx <= radius + _slack(mine, x, error if slack is None else np.minimum(error, slack))
            if np.count_nonzero(may) > may.size >> 4:
                d, off = rough(metric, mine, x)
                may &= d <= radius + off
            r, c = np.nonzero(may)
            d = of_pairs(metric, mine[r], x[c])
            hit = d <= radius
            if hit.any():
                made.append((qid[a + r[hit]], row[c[hit]], d[hit]))
                n += len(made[-1][0])
            if n >= PAIRS:
                yield _pairs(made)
                made, n = [], 0
        if made:
            yield _pairs(made)

    return _blocks(index, q, run, "query_id long, id long, distance double")


def _pairs(made: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(np.concatenate(x)) for n, x in zip(("query_id", "id", "distance"), zip(*made))})


def scanned(index: Index, queries: np.ndarray, ids: Sequence[int]) -> DataFrame:
    """(query_id, rows): how many rows the index lets pass for each query."""
    q, qid = np.asarray(queries, float), np.asarray(ids, np.int64)

    def run(blocks: Iterator) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(q), np.int64)
        for a, approx, *_ in blocks:
            seen[a : a + len(approx)] += np.isfinite(approx).sum(1)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(qid), "rows": pa.array(seen)})

    return _blocks(index, q, run, "query_id long, rows long").groupBy("query_id").agg(F.sum("rows").alias("rows")).filter("rows > 0")
