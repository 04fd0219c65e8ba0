"""The pipeline's near-copy stage against brute-force Jaccard similarity of five-word shingles."""

import numpy as np

import corpus_pipeline
from skein.llm import near_copies, simhash
from skein.llm.simhash import fingerprints


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def corpus():
    """Bases with copies of similarity 0.3 to 1, chains of them, tiny texts, and a phrase that is everywhere."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for n in (6, 9, 12, 30, 80, 150, 300, 700):
        for _ in range(6):
            words = rng.choice(vocabulary, n).tolist()
            words[:6] = "a phrase that all documents share".split()
            texts.append(" ".join(words))
            for changes in rng.integers(0, max(2, n // 12), 6):
                other = words.copy()
                for at in rng.integers(0, n, changes):
                    other[at] = f"new{rng.integers(1 << 30)}"
                texts.append(" ".join(other + [f"t{rng.integers(99)}"] * int(rng.integers(0, 1 + n // 8))))
    return texts + ["", None, "one", "One", "two words", " \n "]


def test_pairs_are_those_of_brute_force(spark, tmp_path):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    root, near, far = list(range(len(texts))), 0, 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            near += 5 * both >= 4 * either > 0
            far += 2.5 * either <= 5 * both < 4 * either
            if 5 * both >= 4 * either:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert near > 100 and far > 100
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect() if r["doc_id"] is not None)
    assert kept == [i for i in range(len(texts)) if find(i) == i]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_simhash_finds_pairs_first_and_the_join_completes_them(spark, tmp_path, monkeypatch):
    """Pairs come from fingerprints at most 4 bits apart; the join on prefixes gives only links between their classes."""
    texts = corpus()
    sets = [shingles(t) for t in texts]
    prints = [np.array(fingerprints(t, 5)[0]).view(np.uint64) for t in texts]
    steps = {}
    for name in ("simhash_pairs", "similar_pairs"):
        step = getattr(near_copies, name)

        def kept(*args, step=step, name=name):
            steps[name] = (args, found := step(*args))
            return found

        monkeypatch.setattr(near_copies, name, kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).count()
    (seen, _, _), found = steps["simhash_pairs"]
    place = {r["id"]: r["row"]["doc_id"] for r in seen.select("id", "row").collect()}
    first = {(place[r["src"]], place[r["dst"]]) for r in found.collect()}
    assert len(first) > 10 and all(np.bitwise_count(prints[i] ^ prints[j]) <= 4 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i, j in first)
    heads = [place[r["id"]] for r in steps["simhash_pairs"][0][1].select("id").collect()]
    near = {frozenset((i, j)) for i in heads for j in heads if i < j and np.bitwise_count(prints[i] ^ prints[j]) <= 4 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert near == {frozenset(p) for p in first}
    later = {frozenset((place[r["src"]], place[r["dst"]])) for r in steps["similar_pairs"][1].collect()}
    assert later and not later & near


def test_marks_never_rule_out_similar_sets():
    rng = np.random.default_rng(5)
    ruled_out = 0
    for n in (0, 1, 2, 5, 63, 64, 65, 130, 1000, 5000):
        for part in (0, 0.05, 0.1, 0.2, 0.5, 1):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[: len(x) - int(part * len(x))], rng.integers(0, 1 << 63, int(part * n * rng.random()), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            similar = 5 * both >= 4 * (len(x) + len(y) - both)
            found = near_copies.may_be_similar(near_copies.marks(x), near_copies.marks(y), len(x) + len(y))
            assert found or not similar
            ruled_out += not found
    assert ruled_out > 15


def test_only_what_marks_leave_open_is_shuffled(spark, tmp_path, monkeypatch):
    """Whole sets are made for few texts besides those of links, and rows are dropped where they lie, whatever may be broadcast."""
    texts = corpus()
    sets, rows = [shingles(t) for t in texts], []
    linked = {i for i in range(len(sets)) for j in range(len(sets)) if i != j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    settle = near_copies.settle

    def counted(df, label):
        back = settle(df, label)
        rows.extend([back.count()] if label == "sets" else [])
        return back

    monkeypatch.setattr(near_copies, "settle", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(rows) == 2 and all(n <= 1.1 * len(linked) for n in rows)
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_rows_are_chosen_by_exact_numbers(spark):
    ids = [0, 1, 62, 63, 64, 65, 127, 128, 700, (3 << 33) + 63, (3 << 33) + 64, (9 << 33) + 5]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    for chosen in ([], ids, [63, 64, (3 << 33) + 63], [700], [(9 << 33) + 5, (9 << 33) + 5]):
        some = spark.createDataFrame([(i,) for i in chosen], "id long")
        assert sorted(r["id"] for r in near_copies._among(rows, some).collect()) == sorted(set(chosen))
        assert sorted(r["id"] for r in near_copies._among(rows, some, keep=False).collect()) == sorted(set(ids) - set(chosen))


def test_shingles_of_many_texts_are_hashed_together(monkeypatch):
    """The hashes are XXH64's, text by text, whatever the texts, and only strings that are long or of a rare length are hashed singly."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdeXYZ\u00e9\u4e2d'"), n)) for n in rng.integers(1, 12, 300)]
    spaces = [" ", "\n", "\t ", "\x0b\x0c", " \r\n "]
    plain = [" ".join(rng.choice(words, n)) for n in rng.integers(20, 300, 200)]
    odd = [None, "", " ", "\n\n", "a", " a", "A b ", "a b c d", "a b c d e", "a b c d e f", "\x1c\x85\xa0 b c d e f g", "a\0b " * 9, "x" * 5000 + " y z " * 3, "".join(w + str(rng.choice(spaces)) for w in rng.choice(words, 400)), " ".join(rng.choice(words, 3000))]
    monkeypatch.setattr(simhash, "GROUP_CHARS", 8000)  # the longest texts are hashed in blocks of their own
    texts = [odd[i // 8] if i % 8 == 0 and i // 8 < len(odd) else t for i, t in enumerate(plain)]
    assert any(len(t or "") > 8000 for t in texts)
    for size in (1, 4, 5):
        got = list(simhash.shingle_hashes_of(texts, size))
        assert len(got) == len(texts)
        for text, blocks in zip(texts, got):
            want = [h for block in simhash.shingle_hashes(text, size) for h in block.tolist()]
            assert [h for block in blocks for h in block.tolist()] == want and all(map(len, blocks))
    assert list(simhash.shingle_hashes_of([], 5)) == []
    calls, one = [], simhash.xxhash.xxh64_intdigest
    monkeypatch.undo()
    monkeypatch.setattr(simhash.xxhash, "xxh64_intdigest", lambda *a: calls.append(1) or one(*a))
    hashes = sum(len(b) for blocks in simhash.shingle_hashes_of(plain * 4, 5) for b in blocks)
    assert hashes > 100_000 and len(calls) < hashes / 20
    sizes = rng.integers(0, 300, 9000)
    raw = rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    at = rng.integers(0, 19_000, 9000)
    assert simhash.xxh64_all(raw, at, sizes).tolist() == [one(raw[i : i + n], 42) for i, n in zip(at.tolist(), sizes.tolist())]
