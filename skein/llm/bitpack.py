"""Token-id files with fixed-width bit packing.

A shard is: blocks of `BLOCK` ids, each id in the `width` bits that the vocabulary needs (little-endian,
each block padded to whole bytes), then doc_id of each document (int64, the least int64 for null), the
first id of each document (uint64, one more at the end), block offsets in bytes (uint64, one more at the
end), and a fixed footer. Blocks are unpacked by numpy without a loop over ids, and any range of ids is
read from its own blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm import files, tokens
from skein.llm.worker import lean, small_batches
from skein.plans.storage import fresh_path, settle

BLOCK = 1 << 16
MAGIC = b"SKBP0001"
FOOTER = struct.Struct("<8sIIQQ")  # magic, width, block, ids, documents
NULL_ID = -(1 << 63)


def bit_width(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width as a little-endian bit string."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", count).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: count * width].reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide.reshape(-1), bitorder="little").view("<u4")


class ShardWriter:
    """Appends documents to an open stream; only the current block and the document table are held."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.parts: list[np.ndarray] = []
        self.held = self.ids = self.at = 0
        self.docs: list[int] = []
        self.starts: list[int] = [0]
        self.offsets: list[int] = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.starts.append(self.ids)
        self.extend(ids)

    def extend(self, ids: np.ndarray) -> None:
        """More ids of the last document."""
        self.ids += len(ids)
        self.starts[-1] = self.ids
        while len(ids):
            part = ids[: self.block - self.held]
            self.parts.append(part)
            self.held += len(part)
            ids = ids[len(part) :]
            if self.held == self.block:
                self._flush()

    def _flush(self) -> None:
        raw = pack(np.concatenate(self.parts), self.width)
        self.out.write(raw)
        self.at += len(raw)
        self.offsets.append(self.at)
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        for values, kind in ((self.docs, "<i8"), (self.starts, "<u8"), (self.offsets, "<u8")):
            self.out.write(np.asarray(values, kind).tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.width, self.block, self.ids, len(self.docs)))


class ShardReader:
    """Random access to a shard: ids(start, stop) reads only the blocks of that range."""

    def __init__(self, uri: str):
        system, path = files.resolve(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        magic, self.width, self.block, self.n_ids, n = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a token-id shard")
        blocks = -(-self.n_ids // self.block)
        tail = 8 * (n + n + 1 + blocks + 1)
        self.file.seek(size - FOOTER.size - tail)
        raw = self.file.read(tail)
        self.docs = np.frombuffer(raw, "<i8", n)
        self.starts = np.frombuffer(raw, "<u8", n + 1, 8 * n).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, 8 * (2 * n + 1)).astype(np.int64)
        self.cached: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _block(self, b: int) -> np.ndarray:
        if self.cached[0] != b:
            self.file.seek(int(self.offsets[b]))
            raw = self.file.read(int(self.offsets[b + 1] - self.offsets[b]))
            self.cached = (b, unpack(raw, self.width, min(self.block, self.n_ids - b * self.block)))
        return self.cached[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        out = []
        for b in range(start // self.block, -(-stop // self.block)):
            base = b * self.block
            out.append(self._block(b)[max(0, start - base) : stop - base])
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1, special_as_text: bool = False) -> DataFrame:
    """Write the ids of docs (doc_id, text), each with end_id after it, in ascending doc_id order.

    Returns the manifest (shard, path, n_docs, n_ids, base): one row a shard, base being the ids of all
    shards before it. A null text is empty and gives its end id alone; null doc_ids come first; rows that
    share a doc_id stay separate, ordered by a hash of their text, and may fill several shards (as the rows
    of a null doc_id may). Other columns aren't read. An empty table has no shards. A shard's name is its
    range partition's number, so a task that runs again overwrites its own.
    """
    path = tokenizer or tokens.default_path()
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = tokens.encoder(path, special_as_text)
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        uri, done = f"{folder}/part-{shard:06d}.skbp", {}
        end = np.asarray([end_id], enc.dtype)

        def body(out) -> None:
            shard_file = ShardWriter(out, bit_width(max(enc.vocab_size, end_id + 1)))
            batch = first
            while batch is not None:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all(batch.column("text").to_pylist())):
                    shard_file.add(doc_id, ids)
                    shard_file.extend(end)
                batch = next(batches, None)
            shard_file.close()
            done.update(docs=len(shard_file.docs), ids=shard_file.ids)

        files.replace(uri, body)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "n_docs": [done["docs"]], "n_ids": [done["ids"]]})

    keys = ("doc_id", "mix", "turn")  # turn only parts equal rows, which may stand in any order
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mix"), F.monotonically_increasing_id().alias("turn"))
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    shards = settle(ordered.mapInArrow(lean(write, pool=False), "shard long, path string, n_docs long, n_ids long"), "shards")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                shard = ShardReader(uri)
                crc = [zlib.crc32(shard.ids(a, b).tobytes()) for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([None if d == NULL_ID else d for d in shard.docs.tolist()], pa.int64()),
                        "start": pa.array(shard.starts[:-1] + base),
                        "n_tokens": pa.array(np.diff(shard.starts)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )
                shard.close()

    spread = manifest.select("path", "base").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write docs as token files and give what is read back from them; see the two functions above."""
    return read_documents(write_token_files(docs, folder or fresh_path(docs.sparkSession, "tokens"), tokenizer, end_id))
