"""Near copies by SimHash, verified by the exact Jaccard similarity of their sets of shingles, and completed by it.

SimHash fingerprints of the texts' shingles meet through deletion-variant signatures; each pair they find at
most 4 bits apart is verified by the whole sets, and those of similarity 0.8 or more are linked. Texts that
SimHash has brought into one class needn't be compared any more. At a similarity of 0.8 many fingerprints
differ by more bits than that, so pairs across its classes are sought exactly:

Two sets of similarity 0.8 or more share at least 4/9 of their sizes' sum. Put every set in one common order:
then the first fifth (and one) of the larger set and the first ninth (and one) of the smaller have a shingle
in common, so an equality join on these prefixes finds every such pair. Shingles met often in a sample come
last in the order; it changes the number of candidates, never the result. Each candidate pair is then
verified by the whole sets. Equal sets are one node from the start.

Whole sets are shuffled only for pairs that small marks leave open: a bit map of a set's hashes by parity.
Two maps differ in no more bits than the sets in shingles, and sets of similarity 0.8 differ in a ninth of
their sizes' sum at most, so no pair is lost. Rows are chosen by an exact bit map of their numbers (a bit a
row, broadcast), so that texts, prefixes and marks stay where they were written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.llm.simhash import fingerprints_of, links, shingle_hashes_of
from skein.llm.worker import lean, small_batches
from skein.operators.components import connected_components
from skein.plans.storage import drop, settle

#: One document in so many is sampled for frequent shingles; those met so often are ordered last, so many at most.
SAMPLE, FREQUENT, LIMIT = 16, 3, 300_000
#: Bits by which fingerprints of candidates differ at most, and the segments that find all of these.
BITS, SEGMENTS = 4, 3
#: Bits of a set's marks at least and at most; between them as many as the set has hashes, or up to twice that.
LEAST_MARKS, MOST_MARKS = 64, 1 << 20
#: An entry of a prefix is the upper 48 bits of a hash and its place; places beyond the last count as it, which makes candidates.
PLACES = 1 << 16
#: Bits of a row's number in its partition, as monotonically_increasing_id gives it.
ROW_BITS = 33


def shingle_set(blocks: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """The different hashes of a text's shingles, ascending, and its fingerprint; no shingles for a text without words."""
    return (np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)), fingerprints_of(blocks)[0]


def digest(hashes: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8")
    return int(both[0]), int(both[1])


def marks(hashes: np.ndarray) -> bytes:
    """A bit map of the different hashes by parity; its length is a power of two, so that two maps can be folded to one length."""
    bits = min(MOST_MARKS, max(LEAST_MARKS, 1 << max(0, len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(x: bytes, y: bytes, sizes: int) -> bool:
    """False only for sets whose similarity is below 0.8; x and y are their marks, sizes the sum of their sizes."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= sizes


def _set_rows(docs: DataFrame, size: int, columns: str, of, text=None, marked: bool = False) -> DataFrame:
    """Rows of docs with (d0, d1, print, size, `columns`) beside them: the digest of the text's set, the fingerprint, the set's size and an array of its hashes.

    The text is docs' column of that name, or what `text` takes from a batch. `marked` adds the set's marks.
    """
    added = f"d0 long, d1 long, print long, size long, {columns} array<long>" + ", marks binary" * marked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                both = [shingle_set(blocks) for blocks in shingle_hashes_of((text(part) if text else part.column("text")).to_pylist(), size)]
                sets, prints = [s for s, _ in both], [p for _, p in both]
                digests = [digest(s) for s in sets]
                taken = [of(s).view(np.int64) for s in sets]
                ends = np.cumsum([0, *map(len, taken)])
                flat = pa.array(np.concatenate([*taken, np.zeros(0, np.int64)]))
                arrays = [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(prints, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                names = [*part.schema.names, "d0", "d1", "print", "size", columns]
                if marked:
                    arrays, names = [*arrays, pa.array(map(marks, sets), pa.binary())], [*names, "marks"]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names)

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, *StructType.fromDDL(added).fields]))


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ranks) of the sample's frequent shingles, the rarer ones first in rank; hashes ascending."""
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    each = _set_rows(some, size, "hashes", lambda s: s).select(F.explode("hashes").alias("h"))
    met = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    rows = met.orderBy(F.desc("n"), "h").limit(LIMIT).toPandas()
    hashes = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes)))[order]


def prefix(hashes: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first fifth, and one, of a set in the common order: sampled rank, zero for all others, then the hash."""
    if not len(hashes):
        return hashes
    rank = np.zeros(len(hashes), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        rank = np.where(frequent[at] == hashes, ranks[at], 0)
    return hashes[np.argsort(rank, kind="stable")[: len(hashes) // 5 + 1]]  # hashes ascend already


def entries(hashes: np.ndarray) -> np.ndarray:
    """A prefix as one number a shingle: the hash's upper 48 bits, then the place."""
    return hashes & ~np.uint64(PLACES - 1) | np.minimum(np.arange(len(hashes)), PLACES - 1).astype(np.uint64)


def _among(rows: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose id is among ids (or, not to keep them, isn't), without a shuffle of rows.

    An id is a partition and a number in it, so a bit a row says it exactly: 2 MB for 16 million rows.
    """
    low = F.col("id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    part, word, bit = F.shiftright("id", ROW_BITS), F.shiftright(low, 6), F.expr("shiftleft(1L, cast(id & 63 AS int))")
    found = ids.groupBy(part.alias("part"), word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow().sort_by([("part", "ascending"), ("word", "ascending")])
    parts, words, bits = (found.column(c).to_numpy() for c in ("part", "word", "bits"))
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    maps = []
    for a, b in zip(starts, [*starts[1:], len(parts)]):
        maps.append(np.zeros(words[b - 1] + 1, np.int64))
        maps[-1][words[a:b]] = bits[a:b]
    table = pa.table({"_part": pa.array(parts[starts], pa.int64()), "_words": pa.array(maps, pa.list_(pa.int64()))})
    met = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table)), part == F.col("_part"), "left")
    has = F.coalesce(F.expr(f"shiftrightunsigned(get(_words, cast((id & {(1 << ROW_BITS) - 1}L) >> 6 AS int)), cast(id & 63 AS int)) & 1"), F.lit(0)) == 1
    return met.filter(has if keep else ~has).drop("_part", "_words")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("src").alias("id")).union(pairs.select("dst"))


def _beside(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """pairs with those columns of both ends: of src by their names, of dst with a 2 behind."""
    half = pairs.join(rows.select(F.col("id").alias("src"), *columns), "src")
    return half.join(rows.select(F.col("id").alias("dst"), *(F.col(c).alias(f"{c}2") for c in columns)), "dst")


def _left_open(seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (src, dst) whose marks don't rule out a similarity of 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy() + batch.column("size2").to_numpy()
            ok = [may_be_similar(x, y, n) for x, y, n in zip(batch.column("marks").to_pylist(), batch.column("marks2").to_pylist(), sizes.tolist())]
            yield batch.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    small = settle(_among(seen.select("id", "size", "marks"), _ends(pairs)), "marks")  # written, so its size is known to the join
    found = settle(_beside(pairs, small, "size", "marks").mapInArrow(run, "src long, dst long"), "open")
    drop(small)
    return found


def _verified(seen: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """Those of pairs (src, dst) whose whole sets have a similarity of 0.8 or more; pairs is a settled table and goes."""
    left = _left_open(seen, pairs)
    texts = _among(seen.select("id", F.col("row.text").alias("text")), _ends(left))
    sets = settle(_set_rows(texts, shingle, "hashes", lambda s: s).select("id", "hashes"), "sets")
    common = F.size(F.array_intersect("hashes", "hashes2"))
    edges = settle(_beside(left, sets, "hashes").filter(5 * common >= 4 * (F.size("hashes") + F.size("hashes2") - common)).select("src", "dst"), "similar")
    drop(pairs, left, sets)
    return edges


def simhash_pairs(seen: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """Pairs (src, dst) of nodes (id, print) that SimHash finds and the whole sets confirm."""
    return _verified(seen, links(nodes.select("id", "print"), ["print"], BITS, SEGMENTS), shingle)


def similar_pairs(seen: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """Pairs (src, dst) of ids of nodes (id, component, size) in different components with a Jaccard similarity of 0.8 or more: all of them.

    seen (id, row, prefix, ...) has the nodes' prefixes, and their texts as row.text.
    """
    rows = _among(seen.select("id", "prefix"), nodes.select("id")).select("id", F.explode("prefix").alias("entry"))
    h = F.shiftrightunsigned("entry", 16)
    met = rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(h))).filter("n > 1")  # one shuffle of two numbers; a hot shingle's rows spill
    met = settle(met.select("id", h.alias("h"), F.expr(f"entry & {PLACES - 1}L").alias("pos")), "prefixes")
    shared = settle(met.join(nodes.select("id", "component", "size"), "id"), "prefixes")
    # a is the smaller set, or that of less id; what may still follow a shared shingle must suffice for 4/9 of both.
    rule = """a.h = b.h AND a.component != b.component AND (a.size < b.size OR (a.size = b.size AND a.id < b.id)) AND 5 * a.size >= 4 * b.size
        AND 9 * least(a.size - a.pos, b.size - b.pos) >= 4 * (a.size + b.size)"""
    pairs = settle(shared.alias("a").join(shared.alias("b").hint("merge"), F.expr(rule)).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct(), "candidates")
    drop(met, shared)
    return _verified(seen, pairs, shingle)


def _classed(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (row, id, ..) of docs with a number of their own, and (id, least) with the row that stays of its group.

    A group's row of least doc_id stays (null is the greatest), of those that share it the first.
    """
    small_batches(docs.sparkSession)
    frequent, ranks = _frequent(docs, shingle)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("id"))
    place = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    seen = settle(_set_rows(whole, shingle, "prefix", lambda s: entries(prefix(s, frequent, ranks)), lambda batch: batch.column("row").field(place), marked=True), "rows")
    doc_id = F.col("row.doc_id").cast("long")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("id").alias("id"))
    nodes = seen.groupBy("d0", "d1").agg(F.min(order).alias("first"), F.max("size").alias("size"), F.min("print").alias("print"))
    nodes = settle(nodes.select("d0", "d1", "first", F.col("first.id").alias("id"), "size", "print"), "nodes")
    found = simhash_pairs(seen, nodes, shingle)
    classes = connected_components(found).select(F.col("node").alias("id"), "component")
    classed = nodes.select("id", "size").join(classes, "id", "left").withColumn("component", F.coalesce("component", "id"))
    edges = found.union(similar_pairs(seen, classed, shingle))
    reached = connected_components(edges).select(F.col("node").alias("id"), "component")
    met = nodes.select("d0", "d1", "first", "id").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = met.groupBy("component").agg(F.min("first").alias("least"))
    classes = met.join(least, "component").select("d0", "d1", "least")
    return seen, seen.select("id", "d0", "d1").join(classes, ["d0", "d1"]).select("id", "least")


def near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Rows (doc_id, component_id, kept), one for each row of docs (doc_id, text): groups linked by a similarity of 0.8 or more.

    component_id is the least doc_id reached, its own included; one row of each group is kept, one that bears
    it. Texts without words, null ones too, are one group. Null and repeated doc_ids are rows of their own:
    null is the greatest. Other columns aren't read; an empty table gives no rows.
    """
    seen, classes = _classed(docs.select("doc_id", "text"), shingle)
    found = seen.select("id", F.col("row.doc_id").alias("own")).join(classes, "id")
    return found.select(F.col("own").cast("long").alias("doc_id"), F.col("least.doc_id").alias("component_id"), (F.col("id") == F.col("least.id")).alias("kept"))


def drop_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of docs, all columns, that near_copies keeps."""
    seen, classes = _classed(docs, shingle)
    gone = classes.filter(F.col("id") != F.col("least.id")).select("id")
    return _among(seen, gone, keep=False).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
