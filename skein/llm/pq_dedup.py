"""Near-duplicate embeddings by product quantisation.

Vectors, scaled to length 1, lie in inverted lists of a coarse k-means; the residual to the list's centre is
coded by subspace. Every vector searches the others. A vector within `radius` of the query lies in another
list only if the query is within `radius` of the plane between the two centres, so lists are probed whose
plane is at most margin * radius away. Margin 1 loses nothing. The way to a neighbour seldom points straight
at a plane, though; how far that goes depends on the data and their dimension, so the margin is measured on
the sample, at vectors that lie just inside the radius: all but one in a thousand must be reached from
either end alone, and a pair is found when one end reaches the other. In a list, distances to the codes
(one product of matrices with the vectors that they stand for), less each row's own coding error (kept with
it), bound the true distance from below, and rows within the bound are reranked by exact cosine in double
precision: no neighbour in a probed list is lost. A pair is met once, from one of the ends that reach the
other, and counts at both. Vectors are written once, list by list, and each task reads the lists it searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import files
from skein.llm.worker import lean
from skein.operators.components import connected_components
from skein.plans.storage import fresh_path, remove, settle

#: Lists: the square root of the rows, so many at most. Vectors on which centres and codebooks are fitted (those of
#: least hash): so many a list, and in all so many at least and at most. Every vector is indexed.
MOST_LISTS, LIST_SAMPLE, SAMPLE = 16_384, 16, (16_384, 262_144)
SUBSPACES, CODES, ROUNDS = 8, 64, 8
#: Share of the vectors just inside the radius that an end may miss, and vectors on which that is measured.
MISSED, MEASURED = 0.001, 8192
#: Rows of a list that are read and compared at once; rows whose searches are one task, at most; rows of a file of lists, about.
BLOCK, TASK_ROWS, PART_ROWS = 4096, 8192, 65_536
#: Slack for rounding in single precision when bounds are compared.
SLACK = 1e-4


@dataclass
class Codebook:
    centres: np.ndarray  # (lists, dim) float32
    codes: np.ndarray  # (subspaces, codes, width) float32
    dim: int

    @property
    def width(self) -> int:
        return self.codes.shape[2]

    def padded(self, x: np.ndarray) -> np.ndarray:
        extra = self.codes.shape[0] * self.width - x.shape[1]
        return np.pad(x, ((0, 0), (0, extra))) if extra else x

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to all centres, and the nearest one."""
        d = (x * x).sum(1)[:, None] - 2 * (x @ self.centres.T) + (self.centres**2).sum(1)
        return np.maximum(d, 0), d.argmin(1)

    def beyond(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the planes between the nearest centre and all others (0 for itself), and the nearest one."""
        d, own = self.nearest(x)
        square = (self.centres**2).sum(1)
        between = square[own][:, None] + square - 2 * (self.centres[own] @ self.centres.T)
        return (d - d[np.arange(len(own)), own][:, None]) / (2 * np.sqrt(np.maximum(between, 1e-12))), own

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, coding error) of rows in their lists."""
        r = self.padded(x - self.centres[lists]).reshape(len(x), *self.codes.shape[::2])
        out = np.empty(r.shape[:2], np.uint8)
        for s in range(r.shape[1]):
            book = self.codes[s]
            out[:, s] = ((book**2).sum(1) - 2 * (r[:, s] @ book.T)).argmin(1)
        back = self.codes[np.arange(r.shape[1]), out]
        return out, np.sqrt(((r - back) ** 2).sum((1, 2)))

    def decode(self, codes: np.ndarray, one: int) -> np.ndarray:
        """The vectors that codes of list `one` stand for: a product with them gives the distances of all queries to the codes."""
        return self.centres[one] + self.codes[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)[:, : self.dim]


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of k classes of the rows of x, in blocks of bounded memory; an empty class keeps its centre."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    step = max(1, (1 << 24) // len(centres))
    for _ in range(rounds):
        total, n = np.zeros((len(centres), x.shape[1]), np.float64), np.zeros(len(centres), np.int64)
        for at in range(0, len(x), step):
            part = x[at : at + step]
            near = ((centres**2).sum(1) - 2 * (part @ centres.T)).argmin(1)
            np.add.at(total, near, part)
            n += np.bincount(near, minlength=len(centres))
        centres[n > 0] = (total[n > 0] / n[n > 0, None]).astype(np.float32)
    return centres


def fit(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 5) -> Codebook:
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    centres = kmeans(sample, max(1, min(lists, len(sample) // 8)), ROUNDS, rng)
    book = Codebook(centres, np.zeros((subspaces, 1, -(-dim // subspaces)), np.float32), dim)
    _, near = book.nearest(sample)
    r = book.padded(sample - centres[near]).reshape(len(sample), subspaces, -1)
    books = [kmeans(np.ascontiguousarray(r[:, s]), codes, ROUNDS, rng) for s in range(subspaces)]
    return Codebook(centres, np.stack(books).astype(np.float32), dim)


def measured_margin(book: Codebook, sample: np.ndarray, similarity: float, missed: float = MISSED) -> float:
    """The margin at which of vectors at just this similarity all but `missed` lie in a probed list; 1 at most.

    The vectors lie off the sample's in random directions, and in those of other rows of the sample.
    """
    rng = np.random.default_rng(3)
    x = sample[rng.integers(0, len(sample), MEASURED)].astype(np.float64)
    radius, worst = np.sqrt(2 - 2 * similarity), 0.0
    for way in (rng.standard_normal(x.shape), sample[rng.integers(0, len(sample), MEASURED)] - x):
        way = way - (way * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(way, axis=1, keepdims=True)
        fit_ = size[:, 0] > 1e-9
        y = similarity * x[fit_] + np.sqrt(1 - similarity**2) * way[fit_] / size[fit_]
        need = [np.zeros(1)]
        for at in range(0, len(y), 1024):
            gap, _ = book.beyond(x[fit_][at : at + 1024].astype(np.float32))
            _, home = book.nearest(y[at : at + 1024].astype(np.float32))
            need.append(gap[np.arange(len(home)), home] / radius)
        worst = max(worst, float(np.quantile(np.concatenate(need), 1 - missed)))
    return min(1.0, worst)


def usable(embedding) -> "F.Column":
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; the largest component is scaled to 1 first, so no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(hit: np.ndarray, ids: np.ndarray, base: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that span the same classes as the bipartite matrix `hit` (ids by base): each row to its class's least id."""
    src, dst = spanning(*np.nonzero(hit), ids, base)
    return src.tolist(), dst.tolist()


def spanning(a: np.ndarray, c: np.ndarray, ids: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """forest() of the links from row a of ids to row c of base."""
    q, b = ids.astype(np.int64).copy(), base.astype(np.int64).copy()
    while len(a):
        low = np.minimum(q[a], b[c])
        nq, nb = q.copy(), b.copy()
        np.minimum.at(nq, a, low)
        np.minimum.at(nb, c, low)
        if (nq == q).all() and (nb == b).all():
            break
        q, b = nq, nb
    return np.concatenate([ids[q != ids], base[b != base]]), np.concatenate([q[q != ids], b[b != base]])


def along(centres: np.ndarray) -> np.ndarray:
    """The centres on a greedy path from like to like, so that lists near each other have numbers near each other."""
    left, path = np.ones(len(centres), bool), [0]
    left[0] = False
    square = (centres**2).sum(1)
    while left.any():
        path.append(int(np.where(left, square - 2 * (centres @ centres[path[-1]]), np.inf).argmin()))
        left[path[-1]] = False
    return centres[path]


def _has(bits: np.ndarray, one: int) -> np.ndarray:
    """Whether each row's bit map of probed lists holds list `one`."""
    return (bits[:, one >> 3] >> (7 - (one & 7)) & 1).astype(bool)


class Run:
    """Rows of one list, at most a block of them, as they lie in a file of lists."""

    def __init__(self, batch: pa.RecordBatch, kind: type, dim: int):
        def flat(c: str, of) -> np.ndarray:
            return np.frombuffer(b"".join(batch.column(c).to_pylist()), of).reshape(batch.num_rows, -1)

        self.home = batch.column("home")[0].as_py()
        self.id, self.n, self.error = (batch.column(c).to_numpy() for c in ("id", "n", "error"))
        self.x = _units(flat("vector", kind).astype(np.float64).reshape(-1, dim))
        self.single = self.x.astype(np.float32)
        self.codes, self.bits = flat("codes", np.uint8), flat("probed", np.uint8)
        self.links = np.zeros(len(self.id), np.int64)


def near_duplicates(vectors: DataFrame, similarity: float = 0.95, lists: int | None = None, block: int = BLOCK, margin: float | None = None) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors (vec_id, embedding).

    Links are pairs with cosine >= similarity. Null, zero and non-finite vectors, those of another dimension
    than most, and rows with a null vec_id link with nothing; equal vectors link. Rows that share a vec_id
    count as one vector for classes and as several for links. Other columns aren't read; an empty table
    gives no rows. `lists` follows the rows and `margin` is measured unless given; margin 1.0 is exact.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64  # as given: the shuffle carries no more than that
    emb = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), emb.alias("embedding"))
    good = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    common = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    plain = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if common is None:
        return plain
    dim = common["dim"]
    good = good.filter(F.size("embedding") == dim)
    # Equal vectors are one point; links among them are counted, not listed.
    points = good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    points = settle(points, "points")
    n_points = points.count()
    lists = lists or max(1, min(MOST_LISTS, round(n_points**0.5)))
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE[1], max(SAMPLE[0], LIST_SAMPLE * lists))).select("embedding").toArrow()
    sample = _units(_matrix(drawn.column("embedding").combine_chunks(), dim)).astype(np.float32)
    book = fit(sample, lists)
    book.centres = along(book.centres)
    radius = float(np.sqrt(2 - 2 * similarity))
    reach_ = radius * (measured_margin(book, sample, similarity) if margin is None else margin) + SLACK
    step = max(16, (1 << 21) // len(book.centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                given = _matrix(part.column("embedding"), dim)
                single = _units(given).astype(np.float32)
                beyond, own = book.beyond(single)
                probe = beyond <= reach_
                probe[np.arange(len(own)), own] = True
                codes, error = book.encode(single, own)
                raw, bits = given.astype(kind), np.packbits(probe, axis=1)
                arrays = [part.column("id"), part.column("n"), pa.array(own, pa.int32()), *(pa.array([x.tobytes() for x in y], pa.binary()) for y in (raw, codes, bits)), pa.array(error.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "home", "vector", "codes", "probed", "error"])

    # Every vector is written once, beside the others of its list; searches read the lists that they probe.
    folder, spark = fresh_path(vectors.sparkSession, "lists"), vectors.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-n_points // PART_ROWS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, index = TaskContext.get().partitionId(), []

        def fill(out) -> None:
            writer, held, size = None, [], 0

            def flush() -> None:
                if held:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    index.append((rows.column("home")[0].as_py(), file, len(index), rows.num_rows))
                    writer.write_batch(rows)

            for batch in batches:
                writer = writer or pa.ipc.new_file(out, batch.schema)
                homes = batch.column("home").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(homes)) + 1).tolist(), batch.num_rows]
                for low, high in zip(cuts, cuts[1:]):
                    while low < high:
                        if held and (size >= block or held[0].column("home")[0].as_py() != homes[low]):
                            flush()
                            held, size = [], 0
                        some = batch.slice(low, min(high - low, block - size))
                        held.append(some)
                        low, size = low + some.num_rows, size + some.num_rows
            flush()
            if writer:
                writer.close()

        files.replace(f"{folder}/{file}.arrow", fill)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in index], pa.int32()) for i in range(4)], ["list", "file", "at", "rows"])

    listed = points.mapInArrow(assign, "id long, n long, home int, vector binary, codes binary, probed binary, error double").repartition(parts, "home").sortWithinPartitions("home", "id")
    runs = np.array(sorted(tuple(r) for r in listed.mapInArrow(write, "list int, file int, at int, rows int").collect()), np.int64).reshape(-1, 4)  # a row for a list or a block of it
    where: dict[int, list[tuple[int, int]]] = {}
    for one, file, at, _ in runs.tolist():
        where.setdefault(one, []).append((file, at))
    share = min(TASK_ROWS, -(-n_points // (4 * spark.sparkContext.defaultParallelism)))
    task = (np.cumsum(runs[:, 3]) - runs[:, 3]) // max(1, share)
    tasks = [runs[task == t, 1:3].tolist() for t in np.unique(task)]

    def compare(query: Run, base: Run, codes: tuple[np.ndarray, np.ndarray], found: list) -> None:
        """Links of query's rows with those of base's list. Each pair of vectors is met once: in the list of the greater
        number if the other end reaches that, else from the end that reaches the other."""
        decoded, least = codes
        mine, other = np.flatnonzero(_has(query.bits, base.home)), np.arange(len(base.id))
        if base.home < query.home:
            other = other[~_has(base.bits, query.home)]
        if not len(other):
            return
        if len(other) < len(base.id):
            decoded, least = decoded[other], least[other]
        for at in range(0, len(mine), 1024):
            rows = mine[at : at + 1024]
            q = query.single[rows]
            near = q @ decoded.T >= least
            if np.count_nonzero(near) > near.size >> 5:  # much lies within the bound: single precision narrows it down
                near &= q @ base.single[other].T >= similarity - SLACK
            a, b = np.nonzero(near)
            a, b = rows[a], other[b]
            if base.home == query.home:
                a, b = a[once := query.id[a] < base.id[b]], b[once]
            if not len(a):
                continue
            cosine = np.concatenate([np.einsum("ij,ij->i", query.x[a[k : k + 65536]], base.x[b[k : k + 65536]]) for k in range(0, len(a), 65536)])
            a, b = a[cosine >= similarity], b[cosine >= similarity]
            query.links += np.bincount(a, weights=base.n[b], minlength=len(query.id)).astype(np.int64)
            base.links += np.bincount(b, weights=query.n[a], minlength=len(base.id)).astype(np.int64)
            found.append(spanning(a, b, query.id, base.id))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = files.resolve(folder)

        def read(held: dict, file: int, at: int) -> Run:
            if file not in held:
                held[file] = pa.ipc.open_file(system.open_input_file(f"{path}/{file}.arrow"))
            return Run(held[file].get_batch(at), kind, dim)

        def rows(run: Run) -> pa.RecordBatch:
            some = np.flatnonzero(run.links)
            return pa.RecordBatch.from_pydict({"id": pa.array(run.id[some]), "links": pa.array(run.links[some]), "other": pa.nulls(len(some), pa.int64())})

        for batch in batches:
            for t in batch.column("id").to_pylist():
                held: dict = {}
                queries = [read(held, *run) for run in tasks[t]]
                wanted = [np.bitwise_or.reduce(q.bits, axis=0) for q in queries]
                for one in np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(wanted, axis=0))).tolist():
                    for run in where.get(one, ()):
                        base, found = read(held, *run), []
                        decoded = book.decode(base.codes, one)
                        reach = (base.error + radius + SLACK) ** 2
                        codes = decoded, ((1 + (decoded.astype(np.float64) ** 2).sum(1) - reach) / 2).astype(np.float32)
                        for query, bits in zip(queries, wanted):
                            if _has(bits[None], one)[0]:
                                compare(query, base, codes, found)
                        yield rows(base)
                        if found:
                            src, dst = (np.concatenate([f[i] for f in found]) for i in range(2))
                            yield pa.RecordBatch.from_pydict({"id": pa.array(src), "links": pa.array(np.zeros(len(src), np.int64)), "other": pa.array(dst)})
                yield from map(rows, queries)

    met = settle(spark.range(len(tasks), numPartitions=len(tasks)).mapInArrow(lean(search, pool=False), "id long, links long, other long"), "met")
    remove(spark, folder)
    edges = met.filter("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst"))
    reached = connected_components(edges)
    linked = met.filter("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    info = points.join(linked, "id", "left").join(reached, F.col("id") == F.col("node"), "left")
    info = info.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    mine = good.join(info, "embedding").select("vec_id", "links", "component")
    rest = rows.filter(~F.coalesce(usable(F.col("embedding")), F.lit(False)) | F.col("vec_id").isNull() | (F.size("embedding") != dim))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return mine.union(rest).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
