"""Token ids of whole texts, by a tokenizers vocabulary file.

A large corpus says most of its words again and again. Where the vocabulary is a byte-level BPE whose splits
never pass white space, a group of texts is cut into words, and these are looked up in a hash table of words,
all in numpy; words that weren't met before are merged together. Whatever that form doesn't cover exactly
(other kinds of vocabulary, letters outside cp1252, strings of special tokens) is asked of the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer

#: Words that a process remembers; then it starts anew.
CACHE_WORDS = 1_000_000
CHUNK_CHARS = 1 << 21
#: The only splits that the numpy form knows; the longest word it looks up (characters) and merges (bytes).
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOOKED_UP, LONGEST = 16, 48
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
_loaded: dict[tuple[str, bool], "TextEncoder"] = {}


def _class(byte: int) -> int:
    c = bytes([byte]).decode("cp1252", "replace")
    if c in " \t\n\r":
        return SPACE
    kind = unicodedata.category(c)
    if c == "\ufffd" or kind in ("Cc", "Zs"):
        return ODD
    return {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)


CLASSES = np.array([_class(b) for b in range(256)], np.uint8)
ODD_BYTES = bytes(np.flatnonzero(CLASSES == ODD).tolist())
#: Each letter's lower case lies in cp1252 too.
LOWER = bytes(ord(c) if (c := bytes([b]).decode("cp1252", "replace").lower()) < "\x80" else c.encode("cp1252", "replace")[0] for b in range(256))
#: Bits of the first n characters of eight.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def latin_bytes(text: str) -> bytes | None:
    """The text's lowered cp1252 bytes; None if it has other characters or odd ones."""
    try:
        raw = text.encode("cp1252")
    except UnicodeEncodeError:
        return None
    return raw.translate(LOWER) if len(raw.translate(None, ODD_BYTES)) == len(raw) else None


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, special_as_text: bool = False) -> "TextEncoder":
    """One encoder a process: a reused Python worker keeps its words over tasks."""
    if (path, special_as_text) not in _loaded:
        _loaded[path, special_as_text] = TextEncoder(path, special_as_text)
    return _loaded[path, special_as_text]


def forget() -> None:
    """Free this process's encoders and their words; the next call of encoder() loads them anew."""
    _loaded.clear()


class Merges:
    """Byte-level BPE with a word-end suffix over many words at once: every round merges each word's first pair of least rank."""

    NONE = np.uint32(0xFFFFFFFF)
    FACTORS = tuple(map(np.uint32, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)))

    def __init__(self, model: dict):
        vocab, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(plain, map(chr, plain)))
        for b in range(256):
            if b not in shown:
                shown[b] = chr(256 + len(shown) - len(plain))
        suffix = model["end_of_word_suffix"]
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.uint32)
        self.last = np.array([vocab[shown[b] + suffix] for b in range(256)], np.uint32)
        # The rank of a pair that is listed twice is the later one, as a map filled in order has it.
        ranks = {vocab[a] << 16 | vocab[b]: rank << 16 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.keys = np.array([*ranks, int(self.NONE)], np.uint32)  # no pair has both ids 65,535
        self.value = np.array([*ranks.values(), int(self.NONE)], np.uint32)
        self.none = len(ranks)
        # A pair that finds its slot taken goes to the next, smaller table.
        self.tables: list[tuple[np.ndarray, np.uint32, np.uint32]] = []
        rest = np.arange(len(ranks))
        for factor, bits in zip(self.FACTORS, (19, 16, 14, 12)):
            table, shift = np.full(1 << bits, self.none, np.int32), np.uint32(32 - bits)
            slots = self._slot(self.keys[rest], factor, shift)
            table[slots] = rest
            rest = rest[table[slots] != rest]
            self.tables.append((table, factor, shift))
            if not len(rest):
                return
        raise ValueError("a pair found no slot")

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.uint32, shift: np.uint32) -> np.ndarray:
        return ((keys ^ (keys >> np.uint32(15))) * factor) >> shift

    def _values(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 16 | new id of each pair; NONE if it isn't merged."""
        keys = a << np.uint32(16) | b
        (table, factor, shift), *more = self.tables
        at = table[self._slot(keys, factor, shift)]
        miss = np.flatnonzero((self.keys[at] != keys) & (at != self.none))
        for table, factor, shift in more:
            again = table[self._slot(keys[miss], factor, shift)]
            at[miss] = again
            miss = miss[(self.keys[again] != keys[miss]) & (again != self.none)]
        at[miss] = self.none
        return self.value[at]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has). Words have 1 to LONGEST bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, parts = np.zeros(len(words), np.int64), []
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), 8192):
            rows = order[at : at + 8192]
            ids, counts[rows] = self._block([words[i] for i in rows.tolist()], sizes[rows])
            parts.append(ids)
        back = np.empty(len(words), np.int64)
        starts = np.cumsum(counts[order]) - counts[order]
        back[order] = starts
        flat = np.concatenate([*parts, np.zeros(0, np.uint16)])
        return flat[spans(back, counts)], counts

    def _block(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), int(sizes.max())
        flat = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        ids = self.inner[flat]
        every, column = np.arange(n), np.arange(width)
        ids[every, sizes - 1] = self.last[flat[every, sizes - 1]]
        held, final = sizes.copy(), np.zeros((n, width), np.uint16)
        ranks = np.full((n, width), self.NONE, np.uint32)
        inside = column[1:] < sizes[:, None]
        ranks[:, :-1][inside] = self._values(ids[:, :-1][inside], ids[:, 1:][inside])
        rows = every
        while len(rows):
            j = ranks.argmin(1)
            k = np.arange(len(rows))
            least = ranks[k, j]
            done = least == self.NONE
            if done.any():
                final[rows[done], : ids.shape[1]] = ids[done]
                go = ~done
                rows = rows[go]
                if not len(rows):
                    break
                most = int(held[rows].max())
                ids, ranks, j, least, k = ids[go, :most], ranks[go, :most], j[go], least[go], k[: len(rows)]
            after = column[: ids.shape[1] - 1] > j[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            ids[k, j] = least & np.uint32(0xFFFF)
            held[rows] -= 1
            size = held[rows]
            ranks[k, size - 1] = self.NONE
            right = np.flatnonzero(j + 1 < size)
            ranks[right, j[right]] = self._values(ids[right, j[right]], ids[right, j[right] + 1])
            left = np.flatnonzero(j > 0)
            ranks[left, j[left] - 1] = self._values(ids[left, j[left] - 1], ids[left, j[left]])
        return final[column < held[:, None]], held


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ..., starts[1], ... of runs of `counts` positions."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class WordTable:
    """Words of up to 16 characters as two 64-bit integers -> their number, in open addressing over numpy arrays."""

    BITS = 21

    def __init__(self):
        self.a, self.b = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.uint64)
        self.number = np.full(1 << self.BITS, -1, np.int32)
        self.claim = np.zeros(1 << self.BITS, np.int32)
        self.words = 0

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words, positions of the first ones of words that are new). New words get the next numbers."""
        mixed = (a ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        slot = (mixed >> np.uint64(64 - self.BITS)).astype(np.int64)
        out, new, wait = np.empty(len(a), np.int32), [], np.arange(len(a))
        while len(wait):
            at = slot[wait]
            number = self.number[at]
            same = (number >= 0) & (self.a[at] == a[wait]) & (self.b[at] == b[wait])
            out[wait[same]] = number[same]
            free = np.flatnonzero(number < 0)
            if len(free):  # of the words that find a slot free one takes it; the others look again
                mine = wait[free]
                self.claim[at[free]] = mine
                first = mine[self.claim[at[free]] == mine]
                self.number[slot[first]] = self.words + np.arange(len(first))
                self.a[slot[first]], self.b[slot[first]] = a[first], b[first]
                self.words += len(first)
                new.append(first)
            on = np.flatnonzero(~same & (number >= 0))
            slot[wait[on]] = (slot[wait[on]] + 1) & ((1 << self.BITS) - 1)
            wait = wait[~same]
        return out, np.concatenate([*new, np.zeros(0, np.int64)])


class LatinWords:
    """Ids of texts in cp1252 bytes, lowered, without ODD bytes."""

    def __init__(self, spec: dict, ask):
        self.merges, self.ask = Merges(spec["model"]), ask
        self._clear()

    def _clear(self) -> None:
        self.table, self.long = WordTable(), {}
        self.pool, self.used = np.zeros(1 << 20, np.uint16), 0
        self.starts, self.counts = np.zeros(CACHE_WORDS * 2, np.int64), np.zeros(CACHE_WORDS * 2, np.int32)

    @staticmethod
    def halves(joined: bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of at most 16 characters as two integers; behind the last one `joined` has 16 bytes more."""
        eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
        return eight[at] & MASKS[np.minimum(size, 8)], eight[at + 8] & MASKS[np.maximum(size - 8, 0)]

    @staticmethod
    def cut(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the pieces that SPLITS finds."""
        kind = CLASSES[raw]
        edge = np.empty(len(raw), bool)
        edge[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == NUMBER
        quote = np.flatnonzero(raw[:-1] == 39)
        quote = quote[edge[quote] & (kind[quote + 1] == LETTER)]  # a run of one quote, then letters
        if len(quote):
            padded = np.append(raw, [10, 10])
            one, two = padded[quote + 1], padded[quote + 2]
            single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            taken, quote = (np.where(single, 1, 2))[single | double], quote[single | double]
            edge[quote + 1] = False
            after = quote + 1 + taken
            edge[after[after < len(raw)]] = True
        starts = np.flatnonzero(edge)
        sizes = np.diff(np.append(starts, len(raw)))
        words = kind[starts] != SPACE
        return starts[words], sizes[words]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        joined = b"\n".join(texts) + b"\n" * 17
        raw = np.frombuffer(joined, np.uint8)
        starts, sizes = self.cut(raw)
        if self.table.words + len(self.long) + len(starts) > CACHE_WORDS + (CACHE_WORDS >> 1) or self.table.words + len(self.long) > CACHE_WORDS:
            self._clear()
        short = np.flatnonzero(sizes <= LOOKED_UP)
        at, size = starts[short], sizes[short]
        a, b = self.halves(joined, at, size)
        numbers = np.empty(len(starts), np.int64)
        numbers[short], new = self.table.find(a, b)
        learn = [joined[i : i + n] for i, n in zip(at[new].tolist(), size[new].tolist())]
        self._learn(numbers[short][new], learn)
        far = np.flatnonzero(sizes > LOOKED_UP)
        if len(far):
            words = [joined[i : i + n] for i, n in zip(starts[far].tolist(), sizes[far].tolist())]
            learn = [*dict.fromkeys(w for w in words if w not in self.long)]
            for w in learn:
                self.long[w] = 2 * CACHE_WORDS - 1 - len(self.long)
            self._learn(np.array([self.long[w] for w in learn], np.int64), learn)
            numbers[far] = [self.long[w] for w in words]
        counts = self.counts[numbers].astype(np.int64)
        ids = self.pool[spans(self.starts[numbers], counts)]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        ends = np.append(0, np.cumsum(counts))[np.searchsorted(starts, text_ends)]
        before = 0
        for end in ends.tolist():
            yield ids[before:end]
            before = end

    def _learn(self, numbers: np.ndarray, words: list[bytes]) -> None:
        if not words:
            return
        plain = [w if w.isascii() else w.decode("cp1252").encode() for w in words]
        fit = np.fromiter((len(w) <= LONGEST for w in plain), bool, len(plain))
        ids, counts = self.merges.encode([w for w, f in zip(plain, fit) if f])
        self._store(numbers[fit], ids, counts)
        for number, word in zip(numbers[~fit].tolist(), (w for w, f in zip(plain, fit) if not f)):
            found = self.ask([word.decode()])[0]
            self._store(np.array([number]), found, np.array([len(found)]))

    def _store(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint16))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[numbers], self.counts[numbers] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(ids)


class TextEncoder:
    """encode(text) gives the ids of Tokenizer.encode(text, add_special_tokens=False) as a numpy array.

    With special_as_text the strings of special tokens in a text are ordinary text (the library's
    encode_special_tokens); without it they give their own ids, as that call does by itself.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocab_size <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [] if special_as_text else [t["content"] for t in spec.get("added_tokens") or ()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.latin = LatinWords(spec, self._ask) if self._is_known(spec) else None
        self.cache: dict[str, np.ndarray] = {"": np.zeros(0, self.dtype)}

    @staticmethod
    def _is_known(spec: dict) -> bool:
        """Whether LatinWords says exactly what this vocabulary's steps do to Latin text, and no id spans white space."""
        model, normal = spec["model"], (spec.get("normalizer") or {}).get("normalizers") or []
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if len(steps) != 2 or [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"]:
            return False
        spaced = any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens") or ())
        plain = not spaced and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        byte_level = steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and steps[1].get("use_regex") is False
        split = steps[0] == {"type": "Split", "pattern": {"Regex": SPLITS}, "behavior": "Removed", "invert": True}
        spaces = normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
        return plain and byte_level and split and spaces and bool(model.get("end_of_word_suffix")) and len(model["vocab"]) < 1 << 16

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; a null one is empty. Texts are encoded in groups of CHUNK_CHARS characters, a longer one in parts."""
        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > CHUNK_CHARS and self.latin:
                yield from self._group(held)
                held, size = [], 0
                parts = [self._group([p]) for p in self._parts(text)]
                yield np.concatenate([next(p) for p in parts])
                continue
            held.append(text)
            size += len(text)
            if size >= CHUNK_CHARS:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """A long text in parts of about CHUNK_CHARS that end at a space (or later, if a word is that long)."""
        at = 0
        while at < len(text):
            cut = text.rfind(" ", at + 1, at + CHUNK_CHARS) if at + CHUNK_CHARS < len(text) else len(text)
            if cut < 0:
                cut = text.find(" ", at + CHUNK_CHARS)
            cut = cut if cut > 0 else len(text)
            yield text[at:cut]
            at = cut

    def _raw(self, text: str) -> bytes | None:
        """The text's lowered cp1252 bytes if LatinWords may read them."""
        raw = latin_bytes(text)
        return None if raw and self.added and b"<" in raw and self.added.search(text) else raw

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        if not self.latin:
            yield from self._ask(texts)
            return
        raw = [self._raw(t) for t in texts]
        found = self.latin.encode([r for r in raw if r is not None])
        for text, r in zip(texts, raw):
            yield self._by_word(text) if r is None else next(found)

    def _by_word(self, text: str) -> np.ndarray:
        """Words between white space that every vocabulary of this kind splits at; new ones are learned together."""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        new = [*{w for w in words if w not in self.cache}]
        if len(self.cache) + len(new) > CACHE_WORDS // 4:
            self.cache = {"": np.zeros(0, self.dtype)}
            new = [*set(words)]
        for at in range(0, len(new), 2048):
            part = new[at : at + 2048]
            self.cache.update(zip(part, self._ask(part)))
        return np.concatenate([self.cache[w] for w in words])
