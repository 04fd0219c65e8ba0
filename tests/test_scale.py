"""Bounds that hold at any size, on small tables."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from oracle import connect, differences

from skein.functions import text
from skein.functions.distance import METRICS, matrix, of_pairs
from skein.operators import ann_batch, graph, knn
from skein.operators import text_search as ts
from skein.queries import catalog


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(range(len(x)) if ids is None else ids, x)], "id long, embedding array<double>")


def test_range_search_through_coarse_codes_is_whole(spark):
    """Codes of one bit a half vector are far off; no row within the radius may be lost for that, whatever slack is named."""
    x = np.random.default_rng(5).standard_normal((400, 8))
    q, ids = x[::20], list(range(0, 400, 20))
    apart = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    want = {(ids[i], int(j)) for i, j in zip(*np.nonzero(apart <= 2.0))}
    found = ann_batch.within(ann_batch.product(table(spark, x), 2, 2), q, ids, 2.0).collect()
    assert {(r["query_id"], r["id"]) for r in found} == want and len(found) == len(want) > len(q)
    assert all(abs(r["distance"] - apart[ids.index(r["query_id"]), r["id"]]) < 1e-12 for r in found)


def test_range_search_hands_pairs_on_block_by_block(spark, monkeypatch):
    """A task doesn't hold all its pairs until it ends."""
    x = np.random.default_rng(6).standard_normal((3000, 4))
    seen = []

    def blocks(index, q, run, schema):
        each = ((a, np.zeros((min(256, len(q) - a), 1000)), x[at : at + 1000], np.arange(at, at + 1000), np.zeros(1000)) for at in range(0, 3000, 1000) for a in range(0, len(q), 256))
        seen.extend(b.num_rows for b in run(each))
        return spark.range(0)

    monkeypatch.setattr(ann_batch, "_blocks", blocks)
    ann_batch.within(None, x[:512], range(512), 100.0)
    assert sum(seen) == 512 * 3000 and max(seen) <= ann_batch.PAIRS + 256 * 1000


CODED = {
    "pq": lambda d: ann_batch.product(d, 2, 2),
    "sq2": lambda d: ann_batch.scalar(d, 2),
    "rotated": lambda d: ann_batch.rotated(d, 2),
    "ivf_pq": lambda d: ann_batch.inverted(d, 4, 4, lambda x, centres: ann_batch.product(x, 2, 2, centres)),
    "ivf_rotated": lambda d: ann_batch.inverted(d, 4, 4, lambda x, _: ann_batch.rotated(x, 2)),
}


@pytest.mark.parametrize("family", CODED)
def test_search_through_coarse_codes_finds_the_nearest(family, spark):
    """Codes far too coarse for the rows that are kept: what a code leaves open is ranked exactly, a query's own row first."""
    x = np.random.default_rng(7).standard_normal((1500, 8)) * np.random.default_rng(8).uniform(0.5, 2, (1500, 1))
    q, ids = x[::50], list(range(0, 1500, 50))
    near = np.argsort(((q[:, None] - x[None]) ** 2).sum(2), axis=1, kind="stable")[:, :5]
    found = ann_batch.search(CODED[family](table(spark, x)), q, ids, 5, 5).collect()
    assert {(r["query_id"], r["rank"]): r["id"] for r in found} == {(i, n + 1): int(j) for i, row in zip(ids, near) for n, j in enumerate(row)}
    assert all(r["distance"] == 0 for r in found if r["rank"] == 1)


def test_search_by_another_metric_and_equal_rows(spark):
    """Codes bound Euclidean distances only; equal vectors rank by id."""
    x = np.repeat(np.random.default_rng(9).standard_normal((40, 8)), 5, 0)
    near = np.lexsort((np.tile(np.arange(200), (10, 1)), (-x[:50:5] @ x.T).round(9)))[:, :7]
    found = ann_batch.search(ann_batch.product(table(spark, x), 2, 2), x[:50:5], range(10), 7, 7, "dot").collect()
    assert {(r["query_id"], r["rank"]): r["id"] for r in found} == {(i, n + 1): int(j) for i, row in enumerate(near) for n, j in enumerate(row)}


def test_queries_and_rows_meet_in_bounded_blocks(spark):
    """However many queries there are, a scorer gets a block of them."""
    x = np.random.default_rng(10).standard_normal((4000, 4))

    def scorer(q):
        def run(rows, _):
            if len(q) * len(rows) > ann_batch.QUERIES * ann_batch.ROWS:
                raise ValueError(f"{len(q)} queries by {len(rows)} rows at once")
            return np.full((len(q), len(rows)), np.inf)

        return run

    index = ann_batch.Index(table(spark, x), (), scorer)
    assert ann_batch.search(index, x, range(4000), 3).count() == ann_batch.within(index, x, range(4000), 0.1).count() == 0


def test_buckets_of_all_tables_never_meet_at_once(spark):
    x = np.random.default_rng(11).standard_normal((2000, 8))
    index = ann_batch.hashed(table(spark, x[:10]), 64, 6)
    planes = np.random.default_rng(42).standard_normal((64 * 6, 8))
    codes = ((x @ planes.T > 0).reshape(2000, 64, 6) * (1 << np.arange(6))).sum(2)
    score = index.scorer(x[:1000])
    tracemalloc.start()
    got = score(x, {"codes": codes})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * got.nbytes
    assert (np.isfinite(got[:50]) == (codes[:50, None] == codes[None]).any(2)).all()


def test_copies_never_take_ids_of_other_rows(spark, tmp_path):
    """Vectors with ids of 100,000 and more: the copies that dedup_first_wins adds are the rows that go, and no others."""
    x = np.random.default_rng(12).standard_normal((60, 64))
    ids = [*range(30), *range(100_000, 100_030)]
    table(spark, x, ids).selectExpr("id AS vec_id", "embedding", "1 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    run, sql = catalog()["dedup_first_wins"]
    assert differences(run(spark, str(tmp_path)), connect(str(tmp_path)), sql) == ""


def test_nodes_that_share_an_id_are_a_row_each(spark, tmp_path):
    """Parts from 1,000,000 on have ids of suppliers."""
    for name, rows, schema in (
        ("part", [(k,) for k in (1, 11, 1_000_001, 1_000_002)], "p_partkey long"),
        ("supplier", [(k,) for k in (1, 3)], "s_suppkey long"),
        ("lineitem", [(1, 1, 1.0), (11, 1, 1.0), (1_000_001, 3, 1.0), (1_000_002, 1, 2.0)], "l_partkey long, l_suppkey long, l_quantity double"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = connect(str(tmp_path))
    for query in ("remove_nodes", "degrees"):
        run, sql = catalog()[query]
        assert differences(run(spark, str(tmp_path)), con, sql) == ""


@pytest.mark.parametrize("metric", METRICS)
def test_blocks_give_the_nearest_of_all(metric):
    """Rows offered block by block, with equal rows, a zero row and few rows at first."""
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.standard_normal((300, 6)), np.zeros((1, 6)), np.repeat(rng.standard_normal((20, 6)), 4, 0)])
    q, ids = x[::40], rng.permutation(len(x))
    near = knn.Nearest(q, 7, metric)
    for a, b in ((0, 3), (3, 200), (200, len(x))):
        near.offer(x[a:b], ids[a:b])
    for i, v in enumerate(q):
        d = of_pairs(metric, np.repeat(v[None], len(x), 0), x)
        order = np.lexsort((ids, d))[:7]
        assert near.id[i].tolist() == ids[order].tolist() and np.allclose(d, matrix(metric, v[None], x)[0])


def test_all_pairs_in_blocks(spark):
    """More rows than a block, vectors of two lengths, a null one: neighbours are those of brute force, vectors of one length among themselves."""
    rng = np.random.default_rng(14)
    short, long = rng.standard_normal((40, 3)), rng.standard_normal((500, 8))
    rows = [(i, v.tolist()) for i, v in enumerate([*short, *long])] + [(540, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in knn.join_topk(df, df, 4, rows_block=128, query_block=100).collect()}
    want = {}
    for first, x in ((0, short), (40, long)):
        for i, near in enumerate(np.argsort(matrix("cosine", x, x), axis=1, kind="stable")[:, :4]):
            want |= {(first + i, n + 1): first + int(j) for n, j in enumerate(near)}
    assert got == want


DOCS = [(1, "the dogs ran, the dogs"), (1, "a dogs ran of it"), (2, None), (3, ""), (4, "Dog the dog THE dog the"), (5, "cats"), (None, "the dog")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_index_stats_counts_documents_that_share_an_id(spark):
    """Two documents of one id and length hold their terms each."""
    words = [re.findall("[a-z0-9]+", (t or "").lower()) for _, t in DOCS]
    got = ts.index_stats(docs(spark)).first()
    assert (got["documents"], got["terms"], got["postings"]) == (7, len({w for x in words for w in x}), sum(len(set(x)) for x in words))
    assert got["avg_len"] == pytest.approx(sum(map(len, words)) / 7)
    none = ts.index_stats(docs(spark).limit(0)).first()
    assert tuple(none) == (0, 0, 0, None)


def test_postings_are_a_row_a_document_and_term(spark, tmp_path):
    index = ts.Postings.build(docs(spark), f"{tmp_path}/index")
    want = []
    for i, t in DOCS:
        x = re.findall("[a-z0-9]+", (t or "").lower())
        want += [(w, i, len(x), [n for n, v in enumerate(x) if v == w]) for w in set(x)]
    assert sorted(map(repr, map(tuple, index.rows.select("term", "doc_id", "doc_len", "positions").collect()))) == sorted(map(repr, want))
    assert tuple(index.stats.select("n_docs", "avg_len").first()) == (7, pytest.approx(sum(len(p) for *_, p in want) / 7))
    assert {r["doc_id"]: r["positions"] for r in index.phrase("the dog the").collect()} == {4: [1, 3]}
    assert index.phrase("the bird").count() == index.phrase("zebra").count() == 0
    empty = ts.Postings.build(docs(spark).limit(0), f"{tmp_path}/none")
    assert empty.rows.count() == empty.search("dog", 3).count() == 0 and tuple(empty.stats.first()) == (0, None)


def test_postings_come_in_sorted_runs(monkeypatch):
    """A run holds RUN tokens at most, unless a document is longer."""
    rng = np.random.default_rng(15)
    words = [[str(w) for w in rng.integers(0, 30, n)] for n in (5, 0, 40, 7, 8, 3, 0)]
    monkeypatch.setattr(ts, "RUN", 16)
    whole = pa.RecordBatch.from_pydict({"doc_id": pa.array([90, *range(7)]), "t": pa.array([["x"], *words], pa.list_(pa.string()))})
    runs = list(ts._runs([whole.slice(1)]))
    assert [r.column("doc_len")[-1].as_py() for r in runs] == [5, 40, 15, 3]
    rows = []
    for r in runs:
        found = r.slice(0, r.num_rows - 1).to_pylist()
        assert [(x["term"], x["doc_id"]) for x in found] == sorted((x["term"], x["doc_id"]) for x in found)
        rows += [(x["doc_id"], x["term"], x["doc_len"], x["positions"]) for x in found]
    assert sorted(rows) == sorted((i, w, len(x), [n for n, v in enumerate(x) if v == w]) for i, x in enumerate(words) for w in set(x))
    assert sum(r.column("positions")[-1].as_py()[0] for r in runs) == 7


@pytest.mark.parametrize("language", [None, "en"])
def test_phrases_of_documents_that_share_an_id(language, spark):
    """A document is a row, scored by its own counts, whatever other document has its id."""
    found = ts.phrase_search(docs(spark), "the dog" if language else "the dogs", language=language).collect()
    want = {(1, (0, 3)), (4, (1, 3)), (None, (0,))} if language else {(1, (0, 3))}
    assert {(r["doc_id"], tuple(r["positions"])) for r in found} == want and len(found) == len(want)
    flat = [(str(i), " ".join(text.stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower())) if language else t) for i, t in enumerate(t for _, t in DOCS)]
    scores = {r["doc_id"]: r["score"] for r in ts.bm25(spark.createDataFrame(flat, "doc_id string, text string"), ["the", "dog" if language else "dogs"]).collect()}
    assert {round(r["score"], 9) for r in found} == {round(scores[i], 9) for i in (("0", "4", "6") if language else ("0",))}


def test_graph_iterations_send_no_table_of_the_graph_to_all(spark, monkeypatch):
    """Tables that grow with the graph are joined by shuffles, however small their files are; a large frontier too."""
    plans = []
    settle = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, label: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or settle(df, label))
    monkeypatch.setattr(graph, "FRONT", 0, raising=False)
    rng = np.random.default_rng(16)
    pairs = [(int(a), int(b), "x", float(w)) for a, b, w in zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(1, 9, 150))]
    e = settle(spark.createDataFrame(pairs, "src long, dst long, label string, weight double"), "edges")
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(settle(spark.range(41), "nodes"), e, 3).collect()}
    paths = {r["id"]: r["cost"] for r in graph.shortest_paths(e, 0).collect()}
    assert sum("SortMergeJoin" in p for p in plans) >= 6 and not any("BroadcastHashJoin" in p for p in plans)
    rank, out = np.full(41, 1 / 41), np.bincount([a for a, *_ in pairs], minlength=41)
    for _ in range(3):
        given = np.bincount([b for _, b, *_ in pairs], [rank[a] / out[a] for a, *_ in pairs], 41)
        rank = 0.15 / 41 + 0.85 * rank[out == 0].sum() / 41 + 0.85 * given
    cost = {0: 0.0}
    for _ in range(41):
        for a, b, _x, w in pairs:
            if a in cost and cost[a] + w < cost.get(b, np.inf):
                cost[b] = cost[a] + w
    assert ranks == pytest.approx(dict(enumerate(rank))) and paths == pytest.approx(cost)
