"""Property-graph and knowledge-graph operators over nodes (id, label) and edges (src, dst, label, weight).

Iterations write each round to the shared folder. Walks keep only a frontier and the visited set, both
DataFrames; nothing is collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.components import connected_components
from skein.plans.storage import drop, settle


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


#: Rows of a frontier that are sent to all executors, at most (some MB); a larger one is shuffled.
FRONT = 50_000


def shuffled(table: DataFrame) -> DataFrame:
    """A table that grows with the graph, to be joined by a shuffle: its file may be small enough for a broadcast through the driver, what it holds isn't."""
    return table.hint("merge")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree); a self loop counts in both."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    i, o = F.coalesce("in_degree", F.lit(0)), F.coalesce("out_degree", F.lit(0))
    return nodes.select("id").join(sums, "id", "left").select("id", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("degree"))


def neighbors(edges: DataFrame, node: int) -> DataFrame:
    """Distinct other ends of a node's edges, both directions."""
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("id"))
    return out.union(edges.filter(F.col("dst") == node).select(F.col("src").alias("id"))).distinct()


def bfs(edges: DataFrame, start: int, max_depth: int, directed: bool = False) -> DataFrame:
    """(id, depth) of all nodes at most max_depth steps from start, which is included."""
    spark = edges.sparkSession
    steps = edges.select("src", "dst") if directed else both_ways(edges)
    seen = spark.range(start, start + 1).select(F.col("id"), F.lit(0).alias("depth"))
    front, made = seen, []
    for depth in range(1, max_depth + 1):
        fresh = front.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = settle(fresh.withColumn("depth", F.lit(depth)), "front")
        made.append(front)
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def dfs(edges: DataFrame, start: int, max_depth: int) -> DataFrame:
    """(id, position, depth) in preorder: out edges first, then in edges, each by id; one visited set for all.

    Order-sensitive, so the reachable ball (bounded by depth) is walked in one task.
    """
    ball = bfs(edges, start, max_depth).select("id")
    inside = edges.join(ball, F.col("src") == ball["id"], "left_semi").join(ball, F.col("dst") == ball["id"], "left_semi").select("src", "dst")

    def run(rows):
        out, into = {}, {}
        for a, b in sorted(zip(rows["src"].tolist(), rows["dst"].tolist())):
            out.setdefault(a, []).append(b)
            into.setdefault(b, []).append(a)
        seen, order, stack = set(), [], [(start, 0)]
        while stack:
            n, d = stack.pop()
            if n in seen:
                continue
            seen.add(n)
            order.append((n, len(order), d))
            if d < max_depth:
                stack += [(m, d + 1) for m in reversed(out.get(n, []) + into.get(n, [])) if m not in seen]
        return pd.DataFrame(order, columns=["id", "position", "depth"])

    return inside.union(edges.sparkSession.createDataFrame([(start, start)], "src long, dst long")).withColumn("_sk_all", F.lit(1)).groupBy("_sk_all").applyInPandas(run, "id long, position int, depth int")


def shortest_paths(edges: DataFrame, start: int, weighted: bool = True, max_rounds: int = 1000) -> DataFrame:
    """(id, cost, parent) of every node that start reaches over out edges; negative weights count as 0, ties take the least parent."""
    weight = F.greatest(F.col("weight").cast("double"), F.lit(0.0)) if weighted else F.lit(1.0)
    steps = settle(edges.select("src", "dst", weight.alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")), "steps")
    best = settle(edges.sparkSession.range(start, start + 1).select("id", F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("parent")), "costs")
    front, size = best, 1
    for _ in range(max_rounds):
        few = F.broadcast(front) if size <= FRONT else shuffled(front)
        tried = steps.join(few, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.col("src").alias("parent"))
        tried = tried.groupBy("id").agg(F.min(F.struct("cost", "parent")).alias("m")).select("id", "m.cost", "m.parent")
        known = best.select("id", F.col("cost").alias("old"))
        better = settle(tried.join(shuffled(known), "id", "left").filter("old IS NULL OR cost < old").select("id", "cost", "parent"), "front")
        size = better.count()
        if not size:
            break
        fresh = settle(best.join(shuffled(better.select("id")), "id", "left_anti").union(better), "costs")
        drop(best)
        best, front = fresh, better
    return best


def path_to(paths: DataFrame, target: int) -> list[int]:
    """The nodes from start to target, by following parents; empty if not reached. One lookup a step."""
    out, at = [], target
    while at is not None:
        row = paths.filter(F.col("id") == at).select("parent").first()
        if row is None:
            return []
        out.append(at)
        at = row[0]
    return out[::-1]


def all_paths(edges: DataFrame, start: int, target: int, max_depth: int) -> DataFrame:
    """(path, length) of all simple paths of at most max_depth out edges."""
    steps = edges.select("src", "dst").distinct()
    front = edges.sparkSession.range(start, start + 1).select(F.array("id").alias("path"), F.col("id").alias("at"))
    done = front.filter(F.col("at") == target) if start == target else front.limit(0)
    for _ in range(max_depth):
        front = front.filter(F.col("at") != target).join(steps, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        front = settle(front.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")), "paths")
        if front.isEmpty():
            break
        done = done.union(front.filter(F.col("at") == target))
    return done.select("path", (F.size("path") - 1).alias("length"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank) by power iteration, unweighted; parallel edges count each; what nodes without out edges hold is spread over all."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy(F.col("src").alias("from")).agg(F.count(F.lit(1)).alias("out"))
    links = settle(edges.select("src", "dst"), "links")
    points = settle(nodes.select("id").join(shuffled(out), F.col("id") == F.col("from"), "left").select("id", "out"), "points")
    ranks = settle(points.select("id", "out", F.lit(1.0 / n).alias("rank")), "ranks")
    for _ in range(iterations):
        lost = ranks.filter("out IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        share = ranks.filter("out IS NOT NULL").select("id", (F.col("rank") / F.col("out")).alias("share"))
        given = links.join(shuffled(share), F.col("src") == F.col("id")).groupBy("dst").agg(F.sum("share").alias("given"))
        rank = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("given", F.lit(0.0))
        fresh = settle(points.join(shuffled(given), F.col("id") == F.col("dst"), "left").select("id", "out", rank.alias("rank")), "ranks")
        drop(ranks)
        ranks = fresh
    return ranks.select("id", "rank")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that is reached either way."""
    found = connected_components(edges)
    return nodes.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, coefficient): links among a node's distinct neighbours, over the pairs of them; 0 below two neighbours.

    Edges are deduplicated and turned from low to high degree, so that a hub's neighbour pairs are never
    listed; the triangles found count for their three corners.
    """
    plain = edges.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    k = plain.select(F.col("a").alias("id")).union(plain.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    ka, kb = k.select(F.col("id").alias("a"), F.col("k").alias("ka")), k.select(F.col("id").alias("b"), F.col("k").alias("kb"))
    turned = plain.join(ka, "a").join(kb, "b")
    swap = F.struct("ka", "a") > F.struct(F.col("kb").alias("ka"), F.col("b").alias("a"))
    turned = turned.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v"))
    one, two = turned.select("u", F.col("v").alias("x")), turned.select("u", F.col("v").alias("y"))
    wedges = one.join(two, "u").filter("x < y")
    closed = wedges.join(plain, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")), "left_semi")
    corners = closed.select(F.explode(F.array("u", "x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    c = F.when(F.col("k") >= 2, F.coalesce("t", F.lit(0)) * 2.0 / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return nodes.select("id").join(k, "id", "left").join(corners, "id", "left").select("id", c.alias("coefficient"))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the nodes (id) of `gone` are removed with their edges."""
    ids = gone.select("id").distinct()
    return nodes.join(ids, "id", "left_anti"), edges.join(ids, edges["src"] == ids["id"], "left_anti").join(ids, edges["dst"] == ids["id"], "left_anti")


# Knowledge graph: entities (id, name, type, embedding), relations (s, p, o, weight).


def triples(entities: DataFrame, relations: DataFrame, s: int | None = None, p: str | None = None, o: int | None = None) -> DataFrame:
    """(s, s_name, p, o, o_name, weight) by pattern, None being any; the name of a missing entity is '?'."""
    hit = relations
    for name, value in (("s", s), ("p", p), ("o", o)):
        hit = hit.filter(F.col(name) == value) if value is not None else hit
    a, b = entities.select(F.col("id").alias("s"), F.col("name").alias("s_name")), entities.select(F.col("id").alias("o"), F.col("name").alias("o_name"))
    return hit.join(a, "s", "left").join(b, "o", "left").select("s", F.coalesce("s_name", F.lit("?")).alias("s_name"), "p", "o", F.coalesce("o_name", F.lit("?")).alias("o_name"), "weight")


def as_edges(relations: DataFrame) -> DataFrame:
    return relations.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.col("p").alias("label"), "weight")


def centrality(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, centrality): degree over the number of other entities; 0 if there are none."""
    n = entities.agg(F.count(F.lit(1)).alias("n"))
    d = degrees(entities, as_edges(relations)).crossJoin(F.broadcast(n))  # one row
    return d.select("id", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def predict_links(entities: DataFrame, relations: DataFrame, entity: int, query: list[float], k: int, least: float = 0.8) -> DataFrame:
    """(id, score) of entities not yet linked to one: cosine at least `least`, plus 0.1 a shared neighbour up to 0.2, at most 1."""
    from skein.functions.distance import distance

    edges = as_edges(relations)
    mine = neighbors(edges, entity)
    near = entities.filter(F.col("id") != entity).join(mine, "id", "left_anti")
    near = near.select("id", (1 - distance("cosine", F.col("embedding"), query)).alias("cosine")).filter(F.col("cosine") >= least)
    shared = both_ways(edges).distinct().join(mine.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("shared"))
    score = F.least(F.lit(1.0), F.col("cosine") + F.least(F.lit(0.2), 0.1 * F.coalesce("shared", F.lit(0))))
    return near.join(shared, "id", "left").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def search_by_text(entities: DataFrame, text: str, k: int, query: list[float] | None = None) -> DataFrame:
    """(id, score): 1 for the name itself, else 0.5 for a name that contains the text, plus the cosine to a query."""
    from skein.functions.distance import distance

    score = F.when(F.col("name") == text, 1.0).when(F.contains(F.col("name"), F.lit(text)), 0.5).otherwise(0.0)
    if query is not None:
        score = score + F.coalesce(1 - distance("cosine", F.col("embedding"), query), F.lit(0.0))
    return entities.select("id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def hybrid_entities(entities: DataFrame, relations: DataFrame, query: list[float], k: int, entity_type: str | None = None, predicate: str | None = None) -> DataFrame:
    """(id, score): cosine top-k among entities of a type that take part in a predicate."""
    from skein.functions.distance import distance

    hit = entities.filter(F.col("type") == entity_type) if entity_type else entities
    if predicate:
        ends = relations.filter(F.col("p") == predicate).select(F.explode(F.array("s", "o")).alias("id"))
        hit = hit.join(ends, "id", "left_semi")
    return hit.select("id", (1 - distance("cosine", F.col("embedding"), query)).alias("score")).filter("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)


def resolve(entities: DataFrame, name: str, entity_type: str, query: list[float] | None = None, least: float = 0.7) -> int | None:
    """The id of an entity by (name, type), else the nearest of the type with cosine at least `least`, else None."""
    row = entities.filter((F.col("name") == name) & (F.col("type") == entity_type)).orderBy("id").select("id").first()
    if row is None and query is not None:
        row = hybrid_entities(entities, entities.limit(0), query, 1, entity_type).filter(F.col("score") >= least).first()
    return None if row is None else row["id"]


def merge_entities(entities: DataFrame, relations: DataFrame, keep: int, gone: int) -> tuple[DataFrame, DataFrame]:
    """Entities without `gone`, whose relations now name `keep`."""
    turn = lambda c: F.when(F.col(c) == gone, F.lit(keep)).otherwise(F.col(c)).alias(c)
    return entities.filter(F.col("id") != gone), relations.select(turn("s"), "p", turn("o"), "weight").distinct()


def spread(relations: DataFrame, seeds: list[int], depth: int, decay: float = 0.7, floor: float = 0.05, causal: tuple[str, ...] = ("enables", "causes", "prevents", "caused_by"), boost: float = 1.0) -> DataFrame:
    """(id, activation): seeds at 1 pass decay * weight (* boost over causal predicates) on both ways; the most a node gets counts."""
    w = F.col("weight").cast("double") * F.when(F.col("p").isin(*causal), F.lit(boost)).otherwise(1.0)
    steps = relations.select(F.col("s").alias("src"), F.col("o").alias("dst"), w.alias("w"))
    steps = steps.union(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    best = relations.sparkSession.createDataFrame([(s, 1.0) for s in seeds], "id long, activation double")
    for _ in range(depth):
        sent = best.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("activation") * decay * F.col("w")).alias("activation")).filter(F.col("activation") >= floor)
        best = settle(best.union(sent).groupBy("id").agg(F.max("activation").alias("activation")), "activation")
    return best


def subgraph(relations: DataFrame, center: int, radius: int) -> DataFrame:
    """Relations with both ends at most `radius` steps from center."""
    ball = bfs(as_edges(relations), center, radius).select("id")
    a, b = ball.withColumnRenamed("id", "s"), ball.withColumnRenamed("id", "o")
    return relations.join(a, "s", "left_semi").join(b, "o", "left_semi")


def kg_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    a = entities.agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("type").alias("types"))
    return a.crossJoin(relations.agg(F.count(F.lit(1)).alias("relations"), F.countDistinct("p").alias("predicates")))  # one row each


def context_search(entities: DataFrame, relations: DataFrame, query: list[float], least: float = 0.7, **scope: str) -> DataFrame:
    """(id, p, o, score): outgoing relations of the entities of a scope (user, agent, run, ...) with cosine at least `least`."""
    from skein.functions.distance import distance

    hit = entities
    for name, value in scope.items():
        hit = hit.filter(F.col(name) == value)
    hit = hit.select("id", (1 - distance("cosine", F.col("embedding"), query)).alias("score")).filter(F.col("score") >= least)
    return hit.join(relations, hit["id"] == relations["s"], "left").select("id", "p", "o", "score")


def expand(hits: DataFrame, links: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, s, p, o): distinct triples of the entities (entity) that links (id, entity) ties to hits (id)."""
    tied = hits.select("id").join(links, "id").select("id", "entity").distinct()
    ends = relations.select(F.explode(F.array_distinct(F.array("s", "o"))).alias("entity"), "s", "p", "o")
    return tied.join(ends, "entity").select("id", "s", "p", "o").distinct()


# Temporal edges (s, p, o, valid_from, valid_to), valid_to null while they hold.


def state_at(edges: DataFrame, t) -> DataFrame:
    return edges.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def valid_between(edges: DataFrame, start, end) -> DataFrame:
    return edges.filter((F.col("valid_from") < end) & (F.col("valid_to").isNull() | (F.col("valid_to") > start)))


def changes(edges: DataFrame) -> DataFrame:
    """Each edge with the object that held before it for the same subject and predicate."""
    order = W.partitionBy("s", "p").orderBy("valid_from", "o")
    return edges.withColumn("previous", F.lag("o").over(order))
