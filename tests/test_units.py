"""Small cases by hand and against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.distance import METRICS, distance, distance_to, matrix
from skein.functions.predicate import from_map, parse_filter
from skein.operators import ann, fusion, graph, knn, memory, places, quant
from skein.operators.components import connected_components
from skein.plans import dialect, planner


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_distances(spark):
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((20, 7)), rng.standard_normal(7)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(20, [0.0] * 7), (21, [1.0]), (22, None)], "id long, embedding array<double>")
    for m in METRICS:
        got = {r["id"]: r["d"] for r in df.select("id", distance(m, F.col("embedding"), q.tolist()).alias("d")).collect()}
        both = {r["id"]: r["d"] for r in df.select("id", distance(m, F.col("embedding"), F.array(*map(F.lit, q.tolist()))).alias("d")).collect()}
        want = matrix(m, q[None], np.vstack([x, np.zeros((1, 7))]))[0]
        assert np.allclose([got[i] for i in range(21)], want) and np.allclose([both[i] for i in range(21)], want)
        assert got[21] is None and got[22] is None
        assert {r["id"]: r["d"] for r in df.select("id", distance_to(m, "embedding", q.tolist()).alias("d")).collect()} == pytest.approx(got, nan_ok=True)
    with pytest.raises(ValueError):
        distance("chebyshev", F.col("embedding"), [1.0])


def test_predicates(spark):
    rows = [(1, {"x": "12abc", "c": "red"}), (2, {"c": "blue"}), (3, {"x": "3", "c": "reddish"}), (4, None)]
    df = spark.createDataFrame(rows, "id long, metadata map<string,string>")
    ids = lambda p: sorted(r["id"] for r in df.filter(parse_filter(p, from_map())).collect())
    assert ids("x == 12") == [1]
    assert ids("x != 12") == [3]
    assert ids("NOT x != 12") == [1, 2, 4]
    assert ids("c PREFIX red AND NOT c == red") == [3]
    assert ids('c < "z"') == []
    for bad in ("x ==", "x = 1", "(x == 1", "x == 1 y"):
        with pytest.raises(ValueError):
            parse_filter(bad, from_map())


def test_like_wildcards_only_at_the_ends(spark):
    df = spark.createDataFrame([(1, {"c": "a_b%c"}), (2, {"c": "axbyc"}), (3, {"c": ""})], "id long, metadata map<string,string>").withColumn("embedding", F.array(F.lit(1.0)))
    run = lambda p: [r["index"] for r in dialect.execute({"t": df}, f"SELECT index FROM t WHERE c LIKE '{p}' ORDER BY index").collect()]
    assert run("a_b%c") == [1] and run("a%") == [1, 2] and run("%c") == [1, 2] and run("") == [3] and run("%b%") == [1, 2]


def test_dialect_errors():
    for bad in ("INSERT INTO t", "SELECT * FROM t ANN(k=3)", "SELECT * FROM t ANN(query=[1], k=0)", "DELETE FROM t", "SELECT * FROM t LIMIT 3 LIMIT 4"):
        with pytest.raises(ValueError):
            dialect.parse(bad)
    plan = dialect.explain("SELECT * FROM t ANN(query=[1,2], k=3) WHERE a = 'x' LIMIT 2")
    assert "strategy: ann" in plan and "k: 3" in plan and "limit: 2" in plan


def test_fusion_numbers(spark):
    assert one(spark, fusion.linear(F.lit(0.8), F.lit(0.6), 0.7, 0.3)) == pytest.approx(0.74)
    assert one(spark, fusion.rrf(F.lit(1), F.lit(2))) == pytest.approx(1 / 61 + 1 / 62)
    assert one(spark, fusion.rrf(F.lit(3), F.lit(0))) == pytest.approx(1 / 63)
    assert one(spark, fusion.normalize(F.lit(5.0), F.lit(2.0), F.lit(10.0))) == pytest.approx(0.375)
    for s, want in ((0.3, 0.5), (0.8, 0.8)):
        assert one(spark, fusion.rank_expression("max(_score, 0.5)", F.lit(s), {})) == want
    assert one(spark, fusion.rank_expression("2 + 3 * (4 - 1) / 2", F.lit(0.0), {})) == pytest.approx(6.5)
    for bad in ("max(1)", "nope(1)", "1 +", "(1"):
        with pytest.raises(ValueError):
            fusion.rank_expression(bad, F.lit(0.0), {})


def test_porter():
    for w, s in {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "relational": "relat", "triplicate": "triplic", "adjustable": "adjust", "controll": "control", "happy": "happi", "sky": "sky"}.items():
        assert text.porter(w) == s


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(1, None)]
    parent = {n: n for e in edges for n in e if n is not None}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {n for a, b in edges if b is not None and a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src long, dst long, label string, weight double")
    nodes = spark.range(3)
    assert connected_components(none).count() == 0
    assert {r["component"] for r in graph.components(nodes, none).collect()} == {0, 1, 2}
    assert [r["rank"] for r in graph.pagerank(nodes, none, 3).collect()] == pytest.approx([1 / 3] * 3)


def test_weighted_paths(spark):
    e = spark.createDataFrame([(1, 2, "a", 5.0), (1, 3, "a", 1.0), (3, 2, "a", 1.0), (2, 4, "a", -3.0)], "src long, dst long, label string, weight double")
    paths = graph.shortest_paths(e, 1)
    assert {r["id"]: r["cost"] for r in paths.collect()} == {1: 0.0, 3: 1.0, 2: 2.0, 4: 2.0}
    assert graph.path_to(paths, 4) == [1, 3, 2, 4] and graph.path_to(paths, 9) == []


def test_mmr_prefers_what_differs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.999, 0.01]), (3, [0.7, 0.7])], "id long, embedding array<double>")
    got = [r["id"] for r in knn.mmr(df, [1.0, 0.05], 2, balance=0.0).orderBy("rank").collect()]
    assert got[1] == 3


def test_first_wins_keeps_the_end_of_a_chain(spark):
    df = spark.range(5)
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert sorted(r["id"] for r in ann.first_wins(df, pairs).collect()) == [0, 2, 4]


def test_geo(spark):
    ny_la = places.distance_km(F.lit(40.7128), F.lit(-74.0060), F.lit(34.0522), F.lit(-118.2437))
    assert one(spark, ny_la) == pytest.approx(3935.7, abs=1)
    with pytest.raises(ValueError):
        places.in_box(spark.range(1), 1, 0, 0, 1)


def test_binary_codes(spark):
    v = np.random.default_rng(1).standard_normal(130)
    code = one(spark, quant.binary(F.array(*map(F.lit, v.tolist()))))
    bits = [(code[i // 64] >> (i % 64)) & 1 for i in range(130)]
    assert bits == (v > 0).astype(int).tolist()


def test_decay_and_types(spark):
    assert one(spark, memory.temporal_decay(F.lit(0.0))) == 1.0
    assert one(spark, memory.temporal_decay(F.lit(168 * 3600.0))) == pytest.approx(0.5, abs=1e-6)
    assert one(spark, memory.temporal_decay(F.lit(1e9))) == pytest.approx(0.1)
    assert one(spark, memory.detect_type(F.lit("We had a meeting"))) == "event"
    assert one(spark, memory.content_score(F.lit(""))) == 0.0


def test_planner():
    assert planner.choose(500, 64, 10).strategy == "exact_scan"
    p = planner.choose(50_000, 64, 10, 0.001)
    assert p.strategy == "oversample_filter" and p.oversample == 15_000
    assert planner.choose(50_000, 64, 10).recall == pytest.approx(1 - 1 / 6)
    assert planner.suggest_index(128, 600_000) == "ivfpq" and planner.suggest_index(128, 5_000_000, 1 << 20) == "diskann"
