"""Property graph and knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import graph as g
from skein.operators import knn
from skein.queries.common import EDGES_SQL, ENTITIES_SQL, NODES_SQL, RELATIONS_SQL, entities, graph, relations, table, vectors
from skein.queries.search import Q0, dist, hits, q0

START = 1_000_001


def by_label(spark, d):
    return graph(spark, d)[0].filter("label = 'supplier'").select("id")


def degrees(spark, d):
    return g.degrees(*graph(spark, d))


def neighbors(spark, d):
    return g.neighbors(graph(spark, d)[1], START)


def bfs(spark, d):
    return g.bfs(graph(spark, d)[1], START, 2)



def components(spark, d):
    n, e = graph(spark, d)
    return g.components(n, e)


def pagerank(spark, d):
    return g.pagerank(*graph(spark, d), iterations=10).select("id", F.round("rank", 9).alias("rank"))


def clustering(spark, d):
    """Customers and suppliers of one nation form no triangles with it alone; a ring of nations does."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    e = n.select(F.col("id").alias("src"), ((F.col("id") * 2 + 1) % 25).alias("dst")).union(n.select("id", ((F.col("id") + 1) % 25))).union(n.select("id", ((F.col("id") + 2) % 25)))
    return g.clustering(n, e).select("id", F.round("coefficient", 9).alias("coefficient"))


def shortest(spark, d):
    e = graph(spark, d)[1]
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight"))
    return g.shortest_paths(both, START).select("id", F.round("cost", 6).alias("cost"))


def all_paths(spark, d):
    e = g.as_edges(relations(spark, d))
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight"))
    return g.all_paths(both, 100, 101, 4).select(F.array_join("path", ">").alias("path"), "length")


def without(spark, d):
    n, e = graph(spark, d)
    rest, edges = g.without_nodes(n, e, spark.range(1, 11))
    return g.degrees(rest, edges).select("id", "degree")


def triples(spark, d):
    return g.triples(entities(spark, d), relations(spark, d), p="in_region", o=2)


def centrality(spark, d):
    return g.centrality(entities(spark, d), relations(spark, d)).select("id", F.round("centrality", 9).alias("centrality"))


def by_text(spark, d):
    return g.search_by_text(entities(spark, d), "A", 200)


def traverse(spark, d):
    return g.bfs(g.as_edges(relations(spark, d)), 2, 2)


def spread(spark, d):
    return g.spread(relations(spark, d), [2], 3).select("id", F.round("activation", 9).alias("activation"))


def subgraph(spark, d):
    return g.subgraph(relations(spark, d), 2, 1).select("s", "p", "o")


def kg_stats(spark, d):
    return g.kg_stats(entities(spark, d), relations(spark, d))


def merge(spark, d):
    e, r = g.merge_entities(entities(spark, d), relations(spark, d), 100, 101)
    return r.groupBy("o").agg(F.count(F.lit(1)).alias("n"))


def _vector_kg(spark, d):
    v = vectors(spark, d)
    e = v.select("id", F.concat(F.lit("e"), "id").alias("name"), F.col("label").cast("string").alias("type"), "embedding")
    r = v.select(F.col("id").alias("s"), F.lit("next").alias("p"), ((F.col("id") + 1) % F.lit(v.count())).alias("o"), F.lit(1.0).alias("weight"))
    return e, r


def similar(spark, d):
    e, r = _vector_kg(spark, d)
    return g.hybrid_entities(e, r, q0(spark, d), 10, "3", "next").select("id", F.round("score", 6).alias("score"))


def predict(spark, d):
    e, r = _vector_kg(spark, d)
    return g.predict_links(e, r, 0, q0(spark, d), 10, 0.1).select("id", F.round("score", 6).alias("score"))


def expansion(spark, d):
    """Nearest rows blended with how many relations their entity has: 0.7 of nearness, 0.3 of links."""
    near = knn.topk(vectors(spark, d), q0(spark, d), 20).select("id", "distance")
    e, r = _vector_kg(spark, d)
    deg = g.degrees(e, g.as_edges(r))
    far = near.agg(F.max("distance").alias("m"))
    met = near.join(deg, "id").crossJoin(F.broadcast(far))  # one row
    return met.select("id", F.round(0.7 * (1 - F.col("distance") / F.col("m")) + 0.3 * F.least(F.col("degree") / 10.0, F.lit(1.0)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


def _temporal(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("s"), F.lit("ordered").alias("p"), F.col("o_orderkey").alias("o"), F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("valid_to"))


def state_at(spark, d):
    return g.state_at(_temporal(spark, d), F.lit("1996-06-01").cast("timestamp")).select("s", "o")


def valid_between(spark, d):
    return g.valid_between(_temporal(spark, d), F.lit("1996-06-01").cast("timestamp"), F.lit("1996-07-01").cast("timestamp")).select("s", "o")


def edge_changes(spark, d):
    return g.changes(_temporal(spark, d)).select("s", "o", "previous")


TEMPORAL = "SELECT o_custkey AS s, o_orderkey AS o, o_orderdate AS f, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + INTERVAL 90 DAY END AS t FROM orders"
E_, R_, N_, G_ = f"({ENTITIES_SQL})", f"({RELATIONS_SQL})", f"({NODES_SQL})", f"({EDGES_SQL})"
BOTH = f"(SELECT src, dst FROM {G_} UNION ALL SELECT dst, src FROM {G_})"
KBOTH = f"(SELECT s AS src, o AS dst, weight AS w FROM {R_} UNION ALL SELECT o, s, weight FROM {R_})"
RING = "(SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 2) % 25 FROM nation) WHERE a <> b)"


def _bfs(edges: str, start: int, depth: int) -> str:
    return f"""WITH RECURSIVE w(id, depth) AS (SELECT CAST({start} AS BIGINT), 0 UNION SELECT DISTINCT e.dst, w.depth + 1 FROM w JOIN {edges} e ON e.src = w.id WHERE w.depth < {depth}) SELECT id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY id"""


def _pagerank(rounds: int) -> str:
    """Unrolled rounds."""
    steps = [f"n AS MATERIALIZED (SELECT id, c FROM {N_} x LEFT JOIN (SELECT src, count(*)::DOUBLE AS c FROM {G_} GROUP BY 1) o ON o.src = x.id), k AS MATERIALIZED (SELECT count(*)::DOUBLE AS k FROM n), g AS MATERIALIZED ({EDGES_SQL}), r0 AS MATERIALIZED (SELECT id, c, 1 / k AS rank FROM n, k)"]
    for i in range(rounds):
        steps.append(
            f"""r{i + 1} AS MATERIALIZED (SELECT n.id, n.c, 0.15::DOUBLE / k + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE c IS NULL) / k + 0.85::DOUBLE * coalesce(s, 0) AS rank
            FROM k, n LEFT JOIN (SELECT dst, sum(rank / c) AS s FROM g JOIN r{i} ON g.src = r{i}.id GROUP BY 1) t ON t.dst = n.id)"""
        )
    return f"WITH {', '.join(steps)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


def _components(rounds: int) -> str:
    """Unrolled rounds: each node takes its neighbours' least label."""
    steps = [f"b AS MATERIALIZED (SELECT DISTINCT src, dst FROM {BOTH}), c0 AS MATERIALIZED (SELECT id, id AS c FROM {N_})"]
    for i in range(rounds):
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT x.id, least(x.c, coalesce(m, x.c)) AS c FROM c{i} x LEFT JOIN (SELECT dst, min(c) AS m FROM b JOIN c{i} ON b.src = id GROUP BY 1) ON dst = x.id)")
    return f"WITH {', '.join(steps)} SELECT id, c AS component FROM c{rounds}"


def _shortest(rounds: int) -> str:
    """Unrolled rounds of relaxation; a path of least cost has fewer steps than these on the tables here."""
    steps = [f"b AS MATERIALIZED (SELECT src, dst, min(weight) AS w FROM (SELECT src, dst, weight FROM {G_} UNION ALL SELECT dst, src, weight FROM {G_}) GROUP BY 1, 2), p0 AS MATERIALIZED (SELECT CAST({START} AS BIGINT) AS id, 0.0::DOUBLE AS cost)"]
    for i in range(rounds):
        steps.append(f"p{i + 1} AS MATERIALIZED (SELECT id, min(cost) AS cost FROM (SELECT id, cost FROM p{i} UNION ALL SELECT dst, cost + w FROM b JOIN p{i} ON b.src = id) GROUP BY 1)")
    return f"WITH {', '.join(steps)} SELECT id, round(cost, 6) AS cost FROM p{rounds}"


QUERIES = {
    "nodes_by_label": (by_label, f"SELECT id FROM {N_} WHERE label = 'supplier'"),
    "degrees": (degrees, f"SELECT n.id, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree, CAST(coalesce(i, 0) + coalesce(o, 0) AS BIGINT) AS degree FROM {N_} n LEFT JOIN (SELECT dst, count(*) AS i FROM {G_} GROUP BY 1) ON dst = n.id LEFT JOIN (SELECT src, count(*) AS o FROM {G_} GROUP BY 1) ON src = n.id"),
    "neighbors": (neighbors, f"SELECT DISTINCT dst AS id FROM {BOTH} WHERE src = {START}"),
    "bfs_depth2": (bfs, _bfs(BOTH, START, 2)),
    "connected_components": (components, _components(24)),
    "pagerank": (pagerank, _pagerank(10)),
    "clustering_coefficient": (clustering, f"""SELECT CAST(n.n_nationkey AS BIGINT) AS id, round(CASE WHEN k >= 2 THEN 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 9) AS coefficient FROM nation n
        LEFT JOIN (SELECT x, count(*) AS k FROM (SELECT a AS x FROM {RING} UNION ALL SELECT b FROM {RING}) GROUP BY 1) d ON d.x = n.n_nationkey
        LEFT JOIN (SELECT v, count(*) AS t FROM (SELECT unnest([p.a, p.b, q.b]) AS v FROM {RING} p JOIN {RING} q ON p.b = q.a JOIN {RING} r ON r.a = p.a AND r.b = q.b) GROUP BY 1) z ON z.v = n.n_nationkey"""),
    "shortest_paths": (shortest, _shortest(40)),
    "all_paths": (all_paths, f"""WITH RECURSIVE b AS (SELECT DISTINCT src, dst FROM {KBOTH}), p(path, here, n) AS (SELECT [CAST(100 AS BIGINT)], CAST(100 AS BIGINT), 0 UNION ALL SELECT list_append(path, dst), dst, n + 1 FROM p JOIN b ON b.src = p.here WHERE here <> 101 AND n < 4 AND NOT list_contains(path, dst))
        SELECT array_to_string(path, '>') AS path, n AS length FROM p WHERE here = 101"""),
    "remove_nodes": (without, f"SELECT n.id, CAST(coalesce(k, 0) AS BIGINT) AS degree FROM {N_} n LEFT JOIN (SELECT src, count(*) AS k FROM {BOTH} WHERE src NOT BETWEEN 1 AND 10 AND dst NOT BETWEEN 1 AND 10 GROUP BY 1) ON src = n.id WHERE n.id NOT BETWEEN 1 AND 10"),
    "triple_pattern": (triples, f"SELECT r.s, coalesce(a.name, '?') AS s_name, r.p, r.o, coalesce(b.name, '?') AS o_name, r.weight FROM {R_} r LEFT JOIN {E_} a ON a.id = r.s LEFT JOIN {E_} b ON b.id = r.o WHERE r.p = 'in_region' AND r.o = 2"),
    "centrality": (centrality, f"SELECT e.id, round(coalesce(k, 0)::DOUBLE / ((SELECT count(*) FROM {E_}) - 1), 9) AS centrality FROM {E_} e LEFT JOIN (SELECT src, count(*) AS k FROM {KBOTH} GROUP BY 1) ON src = e.id"),
    "search_by_text": (by_text, f"SELECT id, s AS score FROM (SELECT id, CASE WHEN name = 'A' THEN 1.0::DOUBLE WHEN contains(name, 'A') THEN 0.5::DOUBLE ELSE 0 END AS s FROM {E_}) WHERE s > 0 ORDER BY s DESC, id LIMIT 200"),
    "kg_traverse": (traverse, _bfs(KBOTH, 2, 2)),
    "spreading_activation": (spread, f"""WITH RECURSIVE a(id, x, n) AS (SELECT CAST(2 AS BIGINT), 1.0::DOUBLE, 0 UNION ALL SELECT dst, x * 0.7::DOUBLE * w, n + 1 FROM a JOIN {KBOTH} k ON k.src = a.id WHERE n < 3 AND x * 0.7::DOUBLE * w >= 0.05) SELECT id, round(max(x), 9) AS activation FROM a GROUP BY id"""),
    "subgraph": (subgraph, f"SELECT s, p, o FROM {R_} WHERE s IN (SELECT dst FROM {KBOTH} WHERE src = 2 UNION SELECT 2) AND o IN (SELECT dst FROM {KBOTH} WHERE src = 2 UNION SELECT 2)"),
    "kg_stats": (kg_stats, f"SELECT * FROM (SELECT count(*) AS entities, count(DISTINCT type) AS types FROM {E_}), (SELECT count(*) AS relations, count(DISTINCT p) AS predicates FROM {R_})"),
    "merge_entities": (merge, f"SELECT o, count(*) AS n FROM (SELECT DISTINCT CASE WHEN s = 101 THEN 100 ELSE s END AS s, p, CASE WHEN o = 101 THEN 100 ELSE o END AS o, weight FROM {R_}) GROUP BY o"),
    "similar_entities": (similar, f"SELECT vec_id AS id, round(1 - d, 6) AS score FROM (SELECT vec_id, {dist('cosine')} AS d FROM embeddings WHERE label = 3 AND (vec_id IN (SELECT vec_id FROM embeddings))) ORDER BY d, vec_id LIMIT 10"),
    "predict_links": (predict, f"""WITH r AS (SELECT vec_id AS s, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS o FROM embeddings), b AS (SELECT DISTINCT s AS src, o AS dst FROM r UNION SELECT o, s FROM r), m AS (SELECT dst FROM b WHERE src = 0),
        x AS (SELECT vec_id, 1 - {dist('cosine')} AS c, (SELECT count(*) FROM b WHERE b.src = vec_id AND b.dst IN (SELECT dst FROM m)) AS k FROM embeddings WHERE vec_id <> 0 AND vec_id NOT IN (SELECT dst FROM m))
        SELECT vec_id AS id, round(least(1.0, c + least(0.2, 0.1 * k)), 6) AS score FROM x WHERE c >= 0.1 ORDER BY least(1.0, c + least(0.2, 0.1 * k)) DESC, vec_id LIMIT 10"""),
    "graph_expansion": (expansion, f"""WITH h AS ({hits(Q0, 20)}), r AS (SELECT vec_id AS s, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS o FROM embeddings), k AS (SELECT x, count(*) AS n FROM (SELECT s AS x FROM r UNION ALL SELECT o FROM r) GROUP BY 1),
        m AS (SELECT h.id, 0.7::DOUBLE * (1 - d / (SELECT max(d) FROM h)) + 0.3::DOUBLE * least(coalesce(n, 0) / 10.0::DOUBLE, 1.0) AS s FROM h LEFT JOIN k ON k.x = h.id) SELECT id, round(s, 6) AS score FROM m ORDER BY s DESC, id LIMIT 10"""),
    "edges_at_time": (state_at, f"SELECT s, o FROM ({TEMPORAL}) WHERE f <= TIMESTAMP '1996-06-01' AND (t IS NULL OR t > TIMESTAMP '1996-06-01')"),
    "edges_between": (valid_between, f"SELECT s, o FROM ({TEMPORAL}) WHERE f < TIMESTAMP '1996-07-01' AND (t IS NULL OR t > TIMESTAMP '1996-06-01')"),
    "edge_changes": (edge_changes, f"SELECT s, o, lag(o) OVER (PARTITION BY s ORDER BY f, o) AS previous FROM ({TEMPORAL})"),
}
