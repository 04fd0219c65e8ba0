"""Connected components by alternating large-star and small-star rounds.

Each round is two map-side-combined aggregations and two equi-joins over the edge list, so no vertex's
neighbour list is ever held in one task and a hub is only a skewed join key (split by AQE). The number
of rounds grows with the square of the logarithm of the largest component. Every round is written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.storage import drop, settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """Rows (node, component): for every node of an edge, the least node it can reach.

    Self loops and rows with a null end are ignored; repeated and reversed edges count once; an empty
    edge list gives no rows. Nodes without edges don't appear. Any orderable type serves as node.
    """
    known = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    now = settle(known.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        after = settle(_small_star(_large_star(now)), "edges")
        drop(now)
        now, before = after, seen
        seen = mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components didn't converge")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
