"""Near-duplicate documents by SimHash, linked through deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that of two fingerprints at most `max_bits` apart one
segment differs by at most one bit (3 segments for 4 bits). Each segment is indexed once for each of its
bits, that bit being left out; two segments that differ by one bit, or by none, then share a signature. An
equality join on signatures gives candidates, and the whole fingerprints verify them.

Equal fingerprints are one node from the start, so groups of copies cost nothing here. A signature that
many fingerprints share (a dense group, or any signature at a great size) is cut further: the other bits
are cut the same way once more, and the join takes both keys. Where many share both (a ball of fingerprints
that nearly all link), they are compared in blocks of bounded size, and each pair of blocks gives the links
of a spanning forest instead of all of them. That loses no connection.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.pq_dedup import forest
from skein.llm.tokens import spans
from skein.llm.worker import lean, small_batches
from skein.operators.components import connected_components
from skein.plans.storage import drop, settle

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Fingerprints that share a signature before its bucket is cut by a second key.
DENSE = 64
#: Fingerprints of a ball that are compared with as many others at once, about.
BLOCK = 2048
BLOCK_SHINGLES = 1 << 16
#: Characters of texts whose shingles are hashed together, about; the longest strings, and the least number of one length, that numpy hashes.
GROUP_CHARS, LONGEST, LEAST = 1 << 20, 192, 48
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
M1, M2, M3, M4, M5 = map(np.uint64, (P1, P2, P3, P4, P5))


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of `size` words of the whole text, repeats included, in blocks."""
    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return
    joined, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        yield np.array([hash_(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    for at in range(0, len(words) - size + 1, BLOCK_SHINGLES):
        a = starts[at : min(at + BLOCK_SHINGLES, len(words) - size + 1)]
        b = ends[at + size - 1 : at + size - 1 + len(a)]
        yield np.array([hash_(joined[i:j], SEED) for i, j in zip(a.tolist(), b.tolist())], np.uint64)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _xxh64_of_length(eight: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """XXH64 of the strings of `size` bytes at those places; eight[i] is the integer of the 8 bytes from i on."""
    done, whole = 0, (1 << 64) - 1
    if size >= 32:
        lanes = [np.full(len(at), v & whole, np.uint64) for v in (SEED + P1 + P2, SEED + P2, SEED, SEED - P1)]
        for done in range(0, size - 31, 32):
            lanes = [_turned(v + eight[at + (done + 8 * i)] * M2, 31) * M1 for i, v in enumerate(lanes)]
        done += 32
        h = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for v in lanes:
            h = (h ^ _turned(v * M2, 31) * M1) * M1 + M4
        h += np.uint64(size)
    else:
        h = np.full(len(at), SEED + P5 + size & whole, np.uint64)
    for done in range(done, size - 7, 8):
        h = _turned(h ^ _turned(eight[at + done] * M2, 31) * M1, 27) * M1 + M4
    done = size & ~7
    if size & 7:
        last = eight[at + done]
        if size & 4:
            h = _turned(h ^ (last & np.uint64(0xFFFFFFFF)) * M1, 23) * M2 + M3
            last = last >> np.uint64(32)
        for k in range(size & 3):
            h = _turned(h ^ (last >> np.uint64(8 * k) & np.uint64(0xFF)) * M5, 11) * M1
    h = (h ^ h >> np.uint64(33)) * M2
    h = (h ^ h >> np.uint64(29)) * M3
    return h ^ h >> np.uint64(32)


def xxh64_all(raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 of the strings of raw that begin at `at`, `size` bytes long; behind the last one raw has 8 bytes more.

    Strings of one length are hashed together; long ones, and those of a rare length, each by itself.
    """
    out = np.empty(len(at), np.uint64)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    capped = np.minimum(size, LONGEST + 1).astype(np.uint8)
    order = np.argsort(capped, kind="stable")
    counts = np.bincount(capped, minlength=LONGEST + 2)
    ends = np.cumsum(counts)
    for n in np.flatnonzero(counts).tolist():
        own = order[ends[n] - counts[n] : ends[n]]
        if n <= LONGEST and len(own) >= LEAST:
            out[own] = _xxh64_of_length(eight, at[own], n)
        else:
            out[own] = np.array([xxhash.xxh64_intdigest(raw[i : i + k], SEED) for i, k in zip(at[own].tolist(), size[own].tolist())], np.uint64)
    return out


def _hashed_together(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The hashes of each text's shingles, as shingle_hashes gives them."""
    raw = np.frombuffer((b"\n".join(texts) + b"\n").translate(LOWER), np.uint8)
    plain = np.zeros(len(raw) + 1, bool)
    np.logical_not(SPACES[raw], out=plain[1:])
    edges = np.flatnonzero(plain[1:] != plain[:-1])
    starts, ends = edges[::2], edges[1::2]
    plain = plain[1:]
    plain[ends] = True  # of the white space behind a word one byte stays, as a space
    after = np.cumsum(ends - starts + 1)
    joined = raw[plain]
    joined[after - 1] = 32
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.searchsorted(starts, np.cumsum(lengths) - lengths)
    words = np.diff(np.append(first, len(starts)))
    counts = np.where(words > size, words - size + 1, np.minimum(words, 1))
    low = spans(first, counts)
    high = low + np.repeat(np.minimum(words, size), counts) - 1
    at = (after - 1 - (ends - starts))[low]
    hashes = xxh64_all(joined.tobytes() + b"\0" * 8, at, after[high] - 1 - at)
    cuts_ = np.cumsum(counts)
    for a, b in zip((cuts_ - counts).tolist(), cuts_.tolist()):
        yield hashes[a:b]


def shingle_hashes_of(texts: Iterable[str | None], size: int) -> Iterator[list[np.ndarray]]:
    """list(shingle_hashes(text, size)) of each text, in which blocks may be cut elsewhere; short texts are hashed together."""
    held: list[bytes] = []
    chars = 0

    def take() -> Iterator[list[np.ndarray]]:
        for h in _hashed_together(held, size) if held else ():
            yield [h] if len(h) else []

    for text in texts:
        raw = (text or "").encode()
        if held and chars + len(raw) > GROUP_CHARS:
            yield from take()
            held, chars = [], 0
        if len(raw) > GROUP_CHARS:
            yield list(shingle_hashes(text, size))
        else:
            held.append(raw)
            chars += len(raw) + 1
    yield from take()


def remix(h: np.ndarray, turn: int) -> np.ndarray:
    """Another 64-bit hash of the same shingles for each turn; turn 0 is h itself."""
    if not turn:
        return h
    x = h + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(text: str | None, size: int, count: int = 1) -> list[int]:
    """`count` fingerprints, as signed 64-bit integers; a bit is 1 if set in over half the hashes."""
    return fingerprints_of(shingle_hashes(text, size), count)


def fingerprints_of(blocks: Iterable[np.ndarray], count: int = 1) -> list[int]:
    """The fingerprints of shingles' hashes, repeats included, given in blocks."""
    ones, total = np.zeros((count, 64), np.int64), 0
    for h in blocks:
        total += len(h)
        for t in range(count):
            bits = np.unpackbits(remix(h, t).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[t] += bits.sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > total, axis=1, bitorder="little").view("<i8").reshape(-1).tolist()


def fingerprint_table(docs: DataFrame, size: int, count: int = 1) -> DataFrame:
    """Rows (doc_id, f0, f1, ...) of docs (doc_id, text); a null text has no shingles and fingerprint zero."""
    names = [f"f{t}" for t in range(count)]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                prints = [fingerprints_of(blocks, count) for blocks in shingle_hashes_of(part.column("text").to_pylist(), size)]
                columns = {n: pa.array([p[t] for p in prints], pa.int64()) for t, n in enumerate(names)}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{n} long" for n in names))


def cuts(bits: int, parts: int, low: int = 0) -> list[tuple[int, int]]:
    """(shift, width) of `parts` segments that cover `bits` bits from bit `low` on."""
    edges = [low + round(bits * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(f, shift: int, width: int):
    return F.shiftrightunsigned(f, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _variants(f, segments: list[tuple[int, int]]):
    """An array of keys: for each segment and each of its bits, their numbers and the segment without that bit.

    Bits 40 and up hold the segment's lowest bit, bits 32 to 37 the one left out.
    """
    return F.array(
        *(
            F.lit(shift << 40 | j << 32).cast("long").bitwiseOR(_segment(f, shift, width).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << j)).cast("long")))
            for shift, width in segments
            for j in range(width)
        )
    )


def _once(f: str, key: str):
    """Of the signatures that a pair shares in a segment, the one at its differing bit counts, or the first."""
    return F.expr(f"(({key} >> 32) & 63) = 0 OR (shiftrightunsigned(a.{f} ^ b.{f}, cast(({key} >> 40) + (({key} >> 32) & 63) AS int)) & 1) = 1")


def links(prints: DataFrame, names: list[str], max_bits: int, segments: int, dense: int = DENSE) -> DataFrame:
    """Pairs (src, dst) of ids of rows (id, *names) whose fingerprints together differ by at most max_bits bits.

    With one fingerprint and 2 * segments > max_bits no pair is lost; in a ball of many that nearly all link,
    pairs that connect the same rows stand for all of its pairs. With several, a pair is found when in
    one of their segments the two differ by at most one bit. Fingerprint rows should be distinct.
    """
    parts = cuts(64, segments)

    def pairs(rows: DataFrame, f: str, *on: str) -> DataFrame:
        met = rows.alias("a").join(rows.alias("b").hint("merge"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on] + [F.col("a.id") > F.col("b.id")])
        apart = sum((F.bit_count(F.col(f"a.{n}").bitwiseXOR(F.col(f"b.{n}"))) for n in names), F.lit(0))
        return met.filter(_once(f, "a.key") & (apart <= max_bits)).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))

    if len(names) > 1 or 2 * segments <= max_bits:
        # Rows carry all fingerprints, so the join itself decides, over one shuffle of the signatures.
        found = [settle(pairs(prints.select("id", *names, F.explode(_variants(F.col(f), parts)).alias("key")), f, "key"), "links") for f in names]
        edges = found[0]
        for more in found[1:]:
            edges = edges.union(more)
        return edges
    f = names[0]
    rows = prints.select("id", f, F.explode(_variants(F.col(f), parts)).alias("key"))
    shared = settle(_counted(rows, "key"), "signatures")
    found = pairs(shared.filter(F.col("n") <= dense).select("id", f, "key"), f, "key")
    thick = shared.filter(F.col("n") > dense)
    finer = None
    if not thick.isEmpty():
        # The bits outside the segment, side by side, are cut in the same way: they too differ by at
        # most max_bits, so the pair shares a second signature, and the join takes both.
        for shift, w in parts:
            low = f"({f} & {(1 << shift) - 1}L)"
            rest = low if shift + w == 64 else f"({low} | shiftleft(shiftrightunsigned({f}, {shift + w}), {shift}))"
            own = thick.filter(F.expr(f"(key >> 40) = {shift}")).select("id", f, "key", F.explode(_variants(F.expr(rest), cuts(64 - w, segments))).alias("key2"))
            finer = own if finer is None else finer.union(own)
        finer = settle(_counted(finer, "key", "key2"), "signatures")
        found = found.union(pairs(finer.filter(F.col("n") <= dense).select("id", f, "key", "key2"), f, "key", "key2"))
        balls = finer.filter(F.col("n") > dense)
        if not balls.isEmpty():
            found = found.union(_forests(balls.withColumnRenamed(f, "f"), max_bits))
    edges = settle(found.distinct(), "links")
    drop(shared, finer)
    return edges


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """rows of keys that more than one row has, and how many (n); a hot key is only a skewed side of the join.

    The optimizer takes rows that a generator made for as few as it was given: its size threshold would let
    it send all counts, 63 a fingerprint, through the driver. So the join is always a shuffle.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(counts.hint("merge"), list(keys))


def _forests(balls: DataFrame, max_bits: int, block: int = BLOCK) -> DataFrame:
    """Pairs (src, dst) that connect what the links of rows (id, f, key, key2, n) connect, two blocks of a ball at a time."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    placed = balls.select("id", "f", "key", "key2", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("id", "f", "key", "key2", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        first, second = group[group["mine"] == group["i"]], group[group["mine"] == group["j"]]
        a, b = first["f"].to_numpy().view(np.uint64), second["f"].to_numpy().view(np.uint64)
        hit = np.bitwise_count(a[:, None] ^ b[None]) <= max_bits
        src, dst = forest(hit, first["id"].to_numpy(), second["id"].to_numpy())
        return pd.DataFrame({"src": src, "dst": dst}, dtype=np.int64)

    return placed.groupBy("key", "key2", "i", "j").applyInPandas(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, count: int = 1, segments: int | None = None, dense: int = DENSE) -> DataFrame:
    """Rows (doc_id, f0.., component_id), one for each row of docs (doc_id, text).

    component_id is the least doc_id that is reached over links, its own included. Equal fingerprints link,
    those of empty and null texts (zero) as well. Rows with a null doc_id get a null component_id unless
    linked to others; other columns aren't read; an empty table gives no rows.
    """
    segments = segments or max_bits // 2 + 1
    names = [f"f{t}" for t in range(count)]
    prints = settle(fingerprint_table(docs, shingle, count), "prints")
    nodes = prints.groupBy(*names).agg(F.min("doc_id").alias("id"))
    nodes = settle(nodes.filter("id is not null"), "nodes")
    edges = links(nodes, names, max_bits, segments, dense)
    reached = connected_components(edges).select(F.col("node").alias("id"), "component")
    classes = nodes.join(reached, "id", "left").select(*names, F.coalesce("component", "id").alias("component_id"))
    return prints.join(classes, names, "left").select("doc_id", *names, "component_id")
