"""Exact deduplication with a cuckoo-filter index of live digests.

Digests (SHA-256 of the text) are spread over shards by their own bits. A shard holds a cuckoo filter and,
in a bucket of each digest, what is stored of the live contents that bear it: length and a second hash, the
live rows and the one that stays. A digest that the filter doesn't know is new and no bucket is looked at; a
hit is verified against its bucket. When an insertion finds no free slot, the filter is built again at twice
the size from the stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.storage import settle

SLOTS = 4
MAX_KICKS = 256


class CuckooFilter:
    """Four 16-bit fingerprints a bucket, each key in one of two buckets; works on arrays of 64-bit key hashes.

    insert() returns which keys found a place; when it can't place all, the caller resizes.
    """

    def __init__(self, capacity: int):
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)
        self.turn = 0

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        spread = prints.astype(np.uint64) * np.uint64(0x5BD1E995)
        return (bucket ^ ((spread ^ (spread >> np.uint64(13))) & np.uint64(self.buckets - 1)).astype(np.int64)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = self._print(keys)
        first = (keys & np.uint64(self.buckets - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Insert all keys; False when the table overflows (it is then to be built anew)."""
        prints, a, b = self._places(keys)
        prints, at = prints.copy(), a
        wait = np.arange(len(keys))
        for bucket in (a, b):
            wait = self._settle(prints, bucket, wait)
        at = b.copy()
        for _ in range(MAX_KICKS):
            if not len(wait):
                return True
            # One of each bucket's waiting prints takes a slot; what it turns out goes on to its other bucket.
            _, one = np.unique(at[wait], return_index=True)
            moving = wait[one]
            slot = (self.turn + moving) % SLOTS
            self.turn += 1
            out = self.table[at[moving], slot].copy()
            self.table[at[moving], slot] = prints[moving]
            prints[moving] = out
            at[moving] = self._other(at[moving], out)
            wait = self._settle(prints, at, wait)
        return not len(wait)

    def _settle(self, prints: np.ndarray, bucket: np.ndarray, wait: np.ndarray) -> np.ndarray:
        """Put waiting prints into free slots of their buckets, one a bucket and pass; gives back the rest."""
        while len(wait):
            free = self.table[bucket[wait]] == 0
            can = free.any(1)
            _, one = np.unique(np.where(can, bucket[wait], -1 - np.arange(len(wait))), return_index=True)
            go = one[can[one]]
            if not len(go):
                break
            self.table[bucket[wait[go]], free[go].argmax(1)] = prints[wait[go]]
            wait = np.delete(wait, go)
        return wait

    def delete(self, keys: np.ndarray) -> None:
        """Remove one print of each key; only keys that were inserted may be deleted."""
        for p, a, b in zip(*(x.tolist() for x in self._places(keys))):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == p)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break


class LiveDigests:
    """A shard's index: a cuckoo filter over the live digests, and the stored contents in buckets by digest."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.capacity = capacity
        self.stored: dict[bytes, list[list]] = {}  # digest -> contents [length, check, rows, keep, whether keep is gone]
        self.size = self.misses = self.hits = self.false_hits = self.resizes = 0

    @staticmethod
    def _keys(digests: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(d[8:16] for d in digests), "<u8") if digests else np.zeros(0, np.uint64)

    def _verified(self, digest: bytes, length: int, check: int) -> list | None:
        """The stored content that a filter hit stands for."""
        return next((e for e in self.stored.get(digest, ()) if e[0] == length and e[1] == check), None)

    def insert(self, digests: list[bytes], lengths: list[int], checks: list[int], rows: list[int], keep: list) -> None:
        """Add rows of each content; the largest `keep` stays (null counts as the least)."""
        batch: dict[tuple[bytes, int, int], list] = {}
        for digest, length, check, n, k in zip(digests, lengths, checks, rows, keep):
            entry = batch.setdefault((digest, length, check), [0, None])
            entry[0] += n
            entry[1] = _later(entry[1], k)
        fresh: list[bytes] = []
        for (content, (n, k)), maybe in zip(batch.items(), self.filter.contains(self._keys([c[0] for c in batch])).tolist()):
            entry = None
            if maybe:
                entry = self._verified(*content)
                self.hits += 1
                self.false_hits += entry is None
            else:
                self.misses += 1
            if entry is None:
                fresh.append(content[0])
                self.stored.setdefault(content[0], []).append([content[1], content[2], n, k, False])
            else:
                entry[2] += n
                entry[3], entry[4] = _later(entry[3], k), entry[4] and (k is None or (entry[3] is not None and k < entry[3]))
        self.size += len(fresh)
        if self.size > self.capacity or not self.filter.insert(self._keys(fresh)):
            self._resize()

    def _resize(self) -> None:
        keys = self._keys([d for d, bucket in self.stored.items() for _ in bucket])
        while True:
            self.capacity = max(self.capacity * 2, len(keys))
            self.filter = CuckooFilter(self.capacity)
            self.resizes += 1
            if self.filter.insert(keys):
                return

    def delete(self, digests: list[bytes], lengths: list[int], checks: list[int], rows: list[int], last: list) -> int:
        """Take rows of each content out; one without live rows leaves the index. Returns the rows taken.

        `last` is the largest id among a content's deleted rows: if that is the one that stayed, which row
        stays now must be asked of the live rows (entries() tells).
        """
        taken = 0
        for digest, length, check, n, k, maybe in zip(digests, lengths, checks, rows, last, self.filter.contains(self._keys(digests)).tolist()):
            entry = self._verified(digest, length, check) if maybe else None
            if entry is None:
                continue
            taken += min(n, entry[2])
            entry[2] -= n
            entry[4] = entry[4] or k == entry[3]
            if entry[2] <= 0:
                self.stored[digest] = [e for e in self.stored[digest] if e is not entry]
                if not self.stored[digest]:
                    del self.stored[digest]
                self.size -= 1
                self.filter.delete(self._keys([digest]))
        return taken

    def entries(self) -> Iterator[pa.RecordBatch]:
        """The stored contents as rows of ENTRY."""
        flat = [(d, *e) for d, bucket in self.stored.items() for e in bucket]
        for at in range(0, len(flat), 20_000):
            columns = zip(*flat[at : at + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)


def _later(a: int | None, b: int | None) -> int | None:
    return b if a is None or (b is not None and b > a) else a


ENTRY = "digest binary, length long, check long, rows long, keep long, stale boolean"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
CONTENT = ["digest", "length", "check"]
#: Entries that a pass over an input partition holds before it hands them on (a shard merges them again), and rows a shard.
HELD_ENTRIES = SHARD_ROWS = 400_000


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[list]:
    return [batch.column(c).to_pylist() for c in names]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer entries of an input partition, in bounded memory: a content may come out more than once."""
    live = LiveDigests()
    for batch in batches:
        live.insert(*_columns(batch, NAMES[:5]))
        if live.size > HELD_ENTRIES:
            yield from live.entries()
            live = LiveDigests()
    yield from live.entries()


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard after its entries, then its deletions (rows below zero), are applied: one entry a content."""
    live = LiveDigests()
    for batch in batches:
        gone = pc.less(batch.column("rows"), 0)
        live.insert(*_columns(batch.filter(pc.invert(gone)), NAMES[:5]))
        digests, lengths, checks, rows, last = _columns(batch.filter(gone), NAMES[:5])
        live.delete(digests, lengths, checks, [-n for n in rows], last)
    yield from live.entries()


def contents(docs: DataFrame) -> DataFrame:
    """Rows of ENTRY, one for each row of docs (doc_id, text); a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("length"), F.xxhash64(text).alias("check"), F.lit(1).cast("long").alias("rows"), F.col("doc_id").cast("long").alias("keep"), F.lit(False).alias("stale"))


def _shards(docs: DataFrame) -> int:
    """Shards for the rows of docs: their number follows the rows, so a shard's memory doesn't grow with them."""
    rows = docs.count()
    return max(1, -(-rows // SHARD_ROWS), min(docs.sparkSession.sparkContext.defaultParallelism, rows // 10_000))


def build_index(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The index's content (rows of ENTRY) of docs (doc_id, text): rows is how many rows hold the text.

    A shard's filter first runs over each input partition, so a text that fills a third of all rows
    leaves a partition as one entry; entries then meet in the shard of their digest.
    """
    return contents(docs).mapInArrow(_collapse, ENTRY).repartition(shards or _shards(docs), "digest").mapInArrow(_shard, ENTRY)


def insert(index: DataFrame, docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The index after docs are added."""
    new = contents(docs).mapInArrow(_collapse, ENTRY)
    return index.union(new).repartition(shards or _shards(index.select("digest").union(docs.select(F.lit(None).cast("binary")))), "digest").mapInArrow(_shard, ENTRY)


def delete(index: DataFrame, gone: DataFrame, live: DataFrame, shards: int | None = None) -> DataFrame:
    """The index after the rows of gone (doc_id, text) are taken out; texts without live rows leave it.

    live (doc_id, text) are the rows that remain: where the row that stayed was deleted, they tell which
    one stays now. Only the texts so touched are looked up in them.
    """
    out = contents(gone).groupBy(*CONTENT).agg((-F.sum("rows")).alias("rows"), F.max("keep").alias("keep")).withColumn("stale", F.lit(False))
    merged = index.union(out).repartition(shards or _shards(index), "digest").sortWithinPartitions(F.desc("rows")).mapInArrow(_shard, ENTRY)
    merged = settle(merged, "index")
    now = contents(live).join(merged.filter("stale").select(*CONTENT), CONTENT, "left_semi").groupBy(*CONTENT).agg(F.max("keep").alias("now"))
    met = merged.join(now, CONTENT, "left")
    return met.select(*CONTENT, "rows", F.when(F.col("stale"), F.col("now")).otherwise(F.col("keep")).alias("keep"), F.lit(False).alias("stale"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of docs (doc_id, text).

    Texts are equal when identical; a null text is empty. Of equal texts the largest doc_id stays (every
    row that bears it, if doc_ids repeat; null is the least). Other columns aren't read; an empty table
    gives no rows.
    """
    entries = build_index(docs).filter("rows > 1").select(*CONTENT, F.col("rows").alias("group_size"), F.col("keep").alias("keep_id"))
    rows = contents(docs).select(*CONTENT, F.col("keep").alias("doc_id"))
    met = rows.join(entries, CONTENT, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return met.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
