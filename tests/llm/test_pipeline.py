"""The pipeline's stages on a small corpus with planted cases, and the registered queries."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import catalog, simhash
from skein.plans import storage


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    words = [a + b + c for a in ("ba", "ke", "mo", "tu", "si") for b in ("ran", "lo", "fis") for c in ("t", "mel", "o", "ku")]
    make = lambda n: "\n".join(" ".join(rng.choice(words, 12)) for _ in range(n // 12))
    rows, labels = [], []
    for i in range(400):
        t = make(240)
        if i % 8 == 0:
            t = " ".join(w if rng.random() > 0.04 else "vileon" for w in t.split()) + " vileon vileon"
        rows.append((i, t, "en", f"s{i % 4}", len(t), 1))
        labels.append((i, int(i % 8 == 0)))
    base = [r for r in rows if r[0] % 8 == 3]
    for j in range(20):
        rows.append((1000 + j, base[j][1], "en", "s1", 1, 1))
        w = base[j + 20][1].split()
        w[50] = "changed"
        rows.append((2000 + j, " ".join(w), "en", "s2", 1, 1))
    rows.append((3000, None, "en", None, None, 1))
    f = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint int").write.parquet(f"{f}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{f}/labels.parquet")
    return str(f)


def test_stages(spark, folder, tmp_path):
    docs, columns, ids = spark.read.parquet(f"{folder}/documents.parquet"), None, []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            ids.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    toxic = {i for i in range(400) if i % 8 == 0}
    assert len(toxic & set(ids[0])) <= 2 and set(range(400)) - toxic <= set(ids[0])
    assert sorted(ids[1]) == sorted(ids[0])
    lines = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/1").collect()}
    assert all(lines[1000 + j]["text"] == "" and lines[1000 + j]["n_chars"] == 0 for j in range(20))
    kept = set(ids[2])
    assert len(kept) == len(ids[2]) and set(range(400)) - toxic <= kept
    sets = {i: {tuple(r["text"].lower().split()[k : k + 5]) for k in range(max(1, len(r["text"].split()) - 4))} for i, r in lines.items() if r["text"] and r["text"].split()}
    for i in set(sets) - kept:  # what went has a near copy (or a chain of them) of less id
        assert any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in sets if j != i)
    for i in kept & set(sets):
        assert not any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in kept & set(sets) if j < i)
    assert all(2000 + j not in kept for j in range(20))
    mixed = spark.read.parquet(f"{tmp_path}/3")
    assert set(r["doc_id"] for r in mixed.collect()) <= kept
    total = docs.agg({"length": "sum"}).first()[0]
    assert total > 0 and docs.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_a_held_frame_survives(spark, folder):
    """Stages delete their own tables alone, and of rows that share an id only the copy goes."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = simhash.near_duplicates(docs.limit(50))
    corpus_pipeline.drop_lines(spark, docs, folder)
    corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert held.count() == 50
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rows = [(1, " ".join(words)), (2, " ".join(words)), (2, " ".join(reversed(words))), (None, " ".join(words[3:] + words[:3] + ["nu"]))]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "nowhere")
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [rows[0], rows[2], rows[3]]))


def test_collected_tables_are_the_blocks_own(spark):
    before = storage.settle(spark.range(3), "t")
    with storage.collected() as made:
        inside = storage.settle(spark.range(4), "t")
        with storage.collected() as inner:
            storage.settle(spark.range(5), "t")
    assert len(made) == 2 and len(inner) == 1 and set(inner) < set(made)
    storage.remove_all(spark, made)
    assert before.count() == 3 and inside._skein_path not in storage._settled


def test_crc_rule(spark):
    from pyspark.sql import functions as F

    from skein.llm.toxicity import held_out

    for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1)
