"""Toxicity by the nearest labelled examples.

Terms are all words of two labelled examples or more, and the beginnings of 3 to 8 letters that tell the labels
apart (labels then carry over to other endings). A term weighs by its inverse document frequency, counted over
all documents, times how far it tells the labels apart, so that words of the subject don't outweigh those of
the tone; none is left out. Examples of both labels lie in an inverted index whose postings are grouped in
blocks with the block's greatest weight: a search takes blocks in order of the bound that these weights give
and stops when no block can enter the nearest ones any more, so the cosines are exact. Neighbours vote with
their cosines; the vote is calibrated on examples that were scored by the other half of the sample.
Tasks build the index and write it to the shared folder, where the tasks that score open it: the driver holds the
vocabulary and a vote an example, never the examples.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import files
from skein.llm.tokens import CLASSES, LETTER, LOOKED_UP, MASKS, LatinWords, WordTable, forget, latin_bytes, spans
from skein.llm.worker import lean, small_batches, trim
from skein.plans.storage import fresh_path, settle

LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Examples of each label that are learned from, at most (those of least hash).
EXAMPLES = 4000
#: Examples that a word needs; and toxic examples, log-likelihood ratio, and share of toxic ones among equally many of both, that a beginning needs.
LEAST_EXAMPLES, LEAST_TOXIC, LEAST_RATIO, LEAST_SHARE = 2, 4, 16.0, 0.9
NEIGHBOURS, BLOCK = 16, 512
#: Terms that are held as dense rows, at most: the commonest, of more than a sixteenth of the examples.
DENSE = 256
THRESHOLD = 0.7
#: Different words that a process remembers; then it starts anew. Characters read at once.
CACHE_WORDS, CHUNK_CHARS = 600_000, 1 << 21
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _keys(a: np.ndarray, b: np.ndarray, turn: int = 0) -> np.ndarray:
    """64-bit keys of terms; `turn` is the length of a beginning, 0 for a whole word."""
    x = (a ^ (b * MIX_B)) * MIX_A + np.uint64(turn)
    x = (x ^ (x >> np.uint64(31))) * MIX_B
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def word_terms(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(words, 7) keys of each word and its beginnings; a beginning as long as the word or longer has the word's own key."""
    out = np.repeat(_keys(a, b)[:, None], 1 + len(BEGINNINGS), axis=1)
    for i, n in enumerate(BEGINNINGS, 1):
        longer = size > n
        out[longer, i] = _keys(a[longer] & MASKS[n], np.zeros(int(longer.sum()), np.uint64), n)
    return out


class WordCounter:
    """Counts of the different words of whole texts: words are runs of letters, lowered, numbered as they are met."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.table, self.turn = WordTable(), getattr(self, "turn", 0) + 1
        self.a, self.b, self.size = (np.zeros(0, np.uint64) for _ in range(3))

    @staticmethod
    def _parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, length, number of its text) of the texts' words; a word outside cp1252, or a long one, is named by two hashes.

        Texts lie behind one another, a line each, and are cut together.
        """
        lines, far, owner = [], [], []
        for i, text in enumerate(texts):
            raw = latin_bytes(text)
            if raw is None:  # words, each by itself
                parts = [(w, latin_bytes(w)) for w in LETTERS.findall(text.lower())]
                raw = b"\n".join(r for _, r in parts if r is not None)
                far += [w.encode() for w, r in parts if r is None]
                owner += [i] * (len(far) - len(owner))
            lines.append(raw)
        raw = b"\n".join(lines) + b"\n" * 17
        flat = np.frombuffer(raw, np.uint8)
        starts, sizes = LatinWords.cut(flat)
        letters = CLASSES[flat[starts]] == LETTER
        starts, sizes = starts[letters], sizes[letters]
        each = np.searchsorted(np.cumsum([len(r) + 1 for r in lines]), starts, "right")
        long = sizes > LOOKED_UP
        far += [raw[i : i + n].decode("cp1252").encode() for i, n in zip(starts[long].tolist(), sizes[long].tolist())]
        a, b = LatinWords.halves(raw, starts[~long], sizes[~long])
        more = np.array([[xxhash.xxh64_intdigest(w), xxhash.xxh64_intdigest(w, 1), 1] for w in far], np.uint64).reshape(-1, 3)
        lead = [w[:8].ljust(8, b"\0") for w in far]  # beginnings of long words are those of their bytes
        first = np.frombuffer(b"".join(lead), "<u8")
        numbers = np.concatenate([each[~long], np.array(owner, np.int64), each[long]])
        return np.append(a, first), np.append(b, more[:, 0]), np.append(sizes[~long], np.array([max(9, len(w)) for w in far], np.int64)), numbers

    def count(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of its different words, how often each occurs) of each text."""
        if self.table.words > CACHE_WORDS:
            self._clear()
        a, b, size, each = self._parts([t or "" for t in texts])
        numbers, new = self.table.find(a, b)
        self.a, self.b, self.size = np.append(self.a, a[new]), np.append(self.b, b[new]), np.append(self.size, size[new].astype(np.uint64))
        both, counts = np.unique(each << 32 | numbers, return_counts=True)
        ends = np.searchsorted(both, (np.arange(len(texts)) + 1) << 32)
        words, before = both & 0xFFFFFFFF, 0
        for end in ends.tolist():
            yield words[before:end], counts[before:end]
            before = end


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    held: list[str | None] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


class TermCounter:
    """Counts the vocabulary's terms in whole texts. The vocabulary is a sorted array of keys."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary, self.words, self.turn = vocabulary, WordCounter(), 0
        self.known = np.zeros((0, 1 + len(BEGINNINGS)), np.int32)

    def _learn(self) -> None:
        """The terms of words that are new since the last call: their places in the vocabulary, -1 for none."""
        if self.turn != self.words.turn:
            self.turn, self.known = self.words.turn, self.known[:0]
        at = len(self.known)
        keys = word_terms(self.words.a[at:], self.words.b[at:], self.words.size[at:])
        place = np.minimum(np.searchsorted(self.vocabulary, keys), max(0, len(self.vocabulary) - 1))
        place = np.where(self.vocabulary[place] == keys, place, -1) if len(self.vocabulary) else np.full(keys.shape, -1)
        place[:, 1:][keys[:, 1:] == keys[:, :1]] = -1
        self.known = np.concatenate([self.known, place.astype(np.int32)])

    def count(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of its terms, how often each occurs) of each text, in the order of places."""
        for group in _groups(texts):
            found = list(self.words.count(group))
            self._learn()
            for words, counts in found:
                terms = self.known[words]
                row, column = np.nonzero(terms >= 0)
                places, back = np.unique(terms[row, column], return_inverse=True)
                yield places, np.bincount(back, weights=counts[row], minlength=len(places))


def fresh_counter(vocabulary: np.ndarray) -> TermCounter:
    """A task's counter, in a worker that needn't hold the tokenizer of another stage beside the model."""
    forget()
    return TermCounter(vocabulary)


@dataclass
class BlockMaxIndex:
    """Unit vectors of examples by term, in blocks of `BLOCK` examples that share their heaviest terms."""

    vectors: list[tuple[np.ndarray, np.ndarray]]  # terms and weights
    labels: np.ndarray
    ids: np.ndarray
    terms: int
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # where a term's postings start; their examples and weights; without the commonest terms, which are dense rows
    bounds: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default_factory=tuple)  # the same, of blocks and greatest weights
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self) -> None:
        held = [i for i, (t, _) in enumerate(self.vectors) if len(t)]
        held.sort(key=lambda i: (-1 if not len(self.vectors[i][0]) else int(self.vectors[i][0][self.vectors[i][1].argmax()]), self.ids[i]))
        self.order = np.asarray(held, np.int64)
        blocks = [[self.vectors[i] for i in held[b : b + BLOCK]] for b in range(0, len(held), BLOCK)]
        counts = np.zeros(self.terms, np.int64)
        for part in blocks:
            counts += np.bincount(np.concatenate([t for t, _ in part]), minlength=self.terms)
        common = np.flatnonzero(counts > len(held) / 16)
        common = np.sort(common[np.argsort(-counts[common], kind="stable")[:DENSE]])
        self.column = np.full(self.terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(held)))
        most: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b, part in enumerate(blocks):
            terms, rows, weights = np.concatenate([t for t, _ in part]), np.repeat(np.arange(len(part)), [len(t) for t, _ in part]), np.concatenate([w for _, w in part])
            rare = self.column[terms] < 0
            self.dense[self.column[terms[~rare]], b * BLOCK + rows[~rare]] = weights[~rare]
            posts = self._postings(terms[rare], rows[rare], weights[rare])
            self.blocks.append(posts)
            some = np.flatnonzero(np.diff(posts[0]))
            most.append((some, np.full(len(some), b), np.maximum.reduceat(posts[2], posts[0][some]) if len(some) else posts[2]))
        if most:
            self.bounds = self._postings(*(np.concatenate([m[i] for m in most]) for i in range(3)))

    def _postings(self, terms: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((rows, terms))
        starts = np.searchsorted(terms[order], np.arange(self.terms + 1)).astype(np.int32)
        return starts, rows[order].astype(np.int32), weights[order]

    @staticmethod
    def _sum(posts: tuple[np.ndarray, np.ndarray, np.ndarray], terms: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
        starts, rows, held = posts
        counts = starts[terms + 1] - starts[terms]
        at = spans(starts[terms], counts)
        return np.bincount(rows[at], weights=held[at] * np.repeat(weights, counts), minlength=size)

    def prepare(self) -> None:
        """The rarer terms' postings over all blocks, filled block by block, as copies of them all don't fit beside."""
        starts = np.sum([posts[0] for posts in self.blocks], axis=0, dtype=np.int64).astype(np.int32)
        rows, weights, at = np.empty(int(starts[-1]), np.int32), np.empty(int(starts[-1])), starts[:-1].copy()
        for b, (own, own_rows, own_weights) in enumerate(self.blocks):
            counts = np.diff(own)
            places = spans(at, counts)
            rows[places], weights[places] = own_rows + np.int32(b * BLOCK), own_weights
            at += counts
        self.rare = starts, rows, weights
        self.starts = np.arange(0, len(self.order), BLOCK)

    def nearest_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each query. The part of the commonest terms is a product of matrices; the others' block bounds decide what else is read."""
        if not self.blocks:
            yield from ((np.zeros(0), np.zeros(0, np.int64)) for _ in queries)
            return
        if not hasattr(self, "rare"):
            self.prepare()
        for at in range(0, len(queries), 128):
            part = queries[at : at + 128]
            lead = np.zeros((len(part), len(self.dense)))
            for i, (terms, weights) in enumerate(part):
                column = self.column[terms]
                lead[i, column[column >= 0]] = weights[column >= 0]
            base = lead @ self.dense
            most = np.maximum.reduceat(base, self.starts, axis=1)
            for i, (terms, weights) in enumerate(part):
                others = self.column[terms] < 0
                yield self._nearest(base[i], most[i], terms[others], weights[others], k)

    def _nearest(self, base: np.ndarray, most: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        upper = most + self._sum(self.bounds, terms, weights, len(self.blocks))
        first = int(upper.argmax())
        low = first * BLOCK
        found = base[low : low + BLOCK].copy()
        found += self._sum(self.blocks[first], terms, weights, len(found))
        least = max(0.0, np.partition(found, len(found) - k)[len(found) - k]) if len(found) > k else 0.0
        open_ = upper * (1 + 1e-9) >= least
        open_[first] = False
        if (open_ & (upper > 0)).any():  # blocks that may enter the nearest: all of them in one pass
            found = base + self._sum(self.rare, terms, weights, len(base))
            low = 0
        hit = np.flatnonzero((found >= least * (1 - 1e-9)) & (found > 1e-15))
        scores, rows = found[hit], self.order[low + hit]
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return scores[order], rows[order]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, examples) of the k nearest with a cosine above zero, nearest first, ties by least id: exact."""
        return next(self.nearest_all([(terms, weights)], k))


@dataclass
class Model:
    vocabulary: np.ndarray
    weight: np.ndarray
    index: str | None  # the file of the examples' BlockMaxIndex in the shared folder; None: there are no examples
    slope: float
    offset: float

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(counts)) * self.weight[terms]
        norm = np.sqrt((v * v).sum())
        return (terms, v / norm) if norm else (terms[:0], v[:0])

    def opened(self) -> BlockMaxIndex | None:
        """A task's index."""
        return files.open_saved(self.index) if self.index else None

    def scores(self, batch: pa.RecordBatch, counter: TermCounter, index: BlockMaxIndex | None) -> list[tuple[float, list[int]]]:
        """(score, evidence) of each row of a batch. index: opened()."""
        if index is None:
            return [(1 / (1 + math.exp(-self.offset)), [])] * batch.num_rows
        vectors = [self.vector(*c) for c in counter.count(batch.column("text").to_pylist())]
        out = []
        for cosines, near in index.nearest_all(vectors):
            total = self.slope * votes(cosines, near, index.labels) + self.offset
            out.append((1 / (1 + math.exp(-max(-60.0, min(60.0, total)))), index.ids[near].tolist()))
        return out


def votes(cosines: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> float:
    """The neighbours' votes, each as heavy as its cosine, as a share of all: from -1 (clean) to 1."""
    total = float(cosines.sum())
    return float((cosines * np.where(labels[rows] == 1, 1.0, -1.0)).sum()) / total if total else 0.0


def calibrate(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method; the labels weigh as `prior` says, with a slight ridge."""
    w = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    a, b = 0.0, math.log(prior / (1 - prior))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        g = np.array([((p - y) * w * x).sum() + 0.1 * a, ((p - y) * w).sum()])
        q = w * p * (1 - p)
        h = np.array([[(q * x * x).sum() + 0.1, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(a)), float(b)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, beginning, term): every different term of each text."""
    words = WordCounter()
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            mine, _ = next(words.count([text]))
            keys = word_terms(words.a[mine], words.b[mine], words.size[mine])
            short = np.unique(keys[:, 1:][keys[:, 1:] != keys[:, :1]])
            terms = np.append(keys[:, 0], short)
            yield pa.RecordBatch.from_pydict({"toxic": pa.array(np.full(len(terms), toxic), pa.int32()), "beginning": pa.array(np.arange(len(terms)) >= len(keys)), "term": pa.array(terms, pa.int64())})


def _learn_index(rows: pa.Table, model: Model, part: int, uri: str) -> pa.Table:
    """Rows (doc_id, toxic, vote). rows: the examples (doc_id, toxic, terms, counts).

    Part 0 or 1: the votes that the examples of that half give those of the other. Part 2: none, but the index of all
    examples is written.
    """
    rows = rows.sort_by("doc_id").combine_chunks()
    ids, toxic = rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy()
    vectors = [model.vector(t.values.to_numpy().astype(np.int64), c.values.to_numpy()) for t, c in zip(rows.column("terms"), rows.column("counts"))]
    mine = np.arange(len(ids)) % 2 == part if part < 2 else np.ones(len(ids), bool)
    rest = np.flatnonzero(~mine)
    index = BlockMaxIndex([v for v, m in zip(vectors, mine) if m], toxic[mine], ids[mine], len(model.vocabulary))
    index.vectors = []  # the postings have them
    if part == 2:
        if index.blocks:
            index.prepare()
        files.save(uri, index)
    given = [votes(*near, index.labels) for near in index.nearest_all([vectors[i] for i in rest])]
    return pa.table({"doc_id": pa.array(ids[rest], pa.int64()), "toxic": pa.array(toxic[rest], pa.int32()), "vote": pa.array(given, pa.float64())})


def select_terms(sample: DataFrame, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ascending, and how far each tells the labels apart) of the terms of a sample (toxic, text)."""
    counts = sample.select("toxic", "text").mapInArrow(lean(_term_rows), "toxic int, beginning boolean, term long").groupBy("term").agg(F.max("beginning").alias("beginning"), F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    n, m = F.lit(float(toxic)), F.lit(float(clean))
    share = (F.col("a") + 0.5) / (n + 1)
    other = (F.col("b") + 0.5) / (m + 1)

    def part(x: Column, of: Column, both: Column) -> Column:
        return F.when(x > 0, x * F.log(x * (n + m) / (of * both))).otherwise(0.0)

    a, b = F.col("a"), F.col("b")
    ratio = 2 * (part(a, n, a + b) + part(b, m, a + b) + part(n - a, n, n + m - a - b) + part(m - b, m, n + m - a - b))
    telling = (a >= LEAST_TOXIC) & (ratio >= LEAST_RATIO) & (share / (share + other) >= LEAST_SHARE)
    kept = counts.filter(a + b >= LEAST_EXAMPLES).withColumn("ratio", ratio).filter(~F.col("beginning") | telling)
    found = kept.select("term", "ratio").toArrow()  # bounded by the sample
    terms, ratios = found.column("term").to_numpy(), found.column("ratio").to_numpy()
    order = np.argsort(terms)
    return terms[order], np.maximum(ratios[order], 0.0)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic); only rows that aren't held out teach it.

    Without a toxic and a clean example every score is the share of toxic labels. Of rows that share a
    doc_id the greatest text is the example.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    by_label = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = (by_label.get(1, 0) + 0.5) / (sum(by_label.values()) + 1)
    none = Model(np.zeros(0, np.int64), np.zeros(0), None, 0.0, math.log(prior / (1 - prior)))
    if not by_label.get(1) or not by_label.get(0):
        return none
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    drawn = known.filter("toxic = 1").orderBy(*order).limit(examples).union(known.filter("toxic = 0").orderBy(*order).limit(examples))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = settle(texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "examples")  # 2 * examples rows at most
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not size.get(1) or not size.get(0):
        return none
    vocabulary, ratios = select_terms(sample, size[1], size[0])

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, total, n = fresh_counter(vocabulary), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for terms, _ in counter.count(batch.column("text").to_pylist()):
                total[terms] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(-1, some), pa.int32()), "n": pa.array(np.append(n, total[some]), pa.int64())})

    # One row a term of the bounded vocabulary, counted over every document.
    counted = docs.select("text").mapInArrow(lean(frequency), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()  # -1 is the last place: all documents
    weight = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * (1 + ratios)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(vocabulary)
        for batch in batches:
            found = list(counter.count(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "terms": pa.array([t for t, _ in found], pa.list_(pa.int32())), "counts": pa.array([c for _, c in found], pa.list_(pa.float64()))})

    rows = sample.select("doc_id", "toxic", "text").mapInArrow(lean(count), "doc_id long, toxic int, terms array<int>, counts array<double>")
    model, uri = Model(vocabulary, weight, None, 0.0, 0.0), f"{fresh_path(docs.sparkSession, 'index')}/index"

    def learn(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = _learn_index(rows, model, key[0].as_py(), uri)
        trim()
        return found

    given = rows.withColumn("part", F.explode(F.array(*map(F.lit, range(3))))).groupBy("part").applyInArrow(learn, "doc_id long, toxic int, vote double").orderBy("doc_id").toArrow()
    slope, offset = calibrate(given.column("vote").to_numpy(), given.column("toxic").to_numpy(), prior)
    return Model(vocabulary, weight, uri, slope, offset)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...) rows (doc_id, held_out, score, predicted, evidence): one for each row of docs.

    evidence lists the doc_ids of the nearest examples. A null text is empty; an empty text, or one without
    a term, has the score of no votes. Null and repeated doc_ids are scored each for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, index = fresh_counter(model.vocabulary), model.opened()
        for batch in batches:
            found = model.scores(batch, counter, index)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array([s for s, _ in found], pa.float64()), "evidence": pa.array([e for _, e in found], pa.list_(pa.int64()))})
            trim()

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, index = fresh_counter(model.vocabulary), model.opened()
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s, _ in model.scores(batch, counter, index)], pa.bool_()))
            trim()

    return docs.mapInArrow(lean(run), docs.schema)
