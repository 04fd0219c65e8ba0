"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and `limit` copies that is as near to 1 as the targets allow: the
divergence sum of r log r + (limit - r) log((limit - r) / (limit - 1)) is least under one token constraint a
source, sum of rate * size = target. The solution tilts by exp(lambda * size), with one lambda a source, and
the convex dual is solved by Newton steps. Documents enter them as counts by source and size, so a step
is one small aggregation that no hot source can slow down. Rates become whole copies by carrying each
rounding error on to the next document, in salted groups of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.plans.storage import drop, settle

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3.0
#: Documents that are rounded in one group at most, about (salted by a hash of the document).
GROUP = 8192
#: Equal documents that one row is opened into at once.
RUN = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"
STEPS = 60


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """Rows (source, source_size, n_docs, target) from rows (source, size).

    Sources in code-point order, null last, weigh `weights` over and over. A target that would pass
    limit * source_size stops there. With sources ordered by size for their weight those that stop come
    first, so one pass of running sums finds them all. The windows run over one row a source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    by_need = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, everywhere = by_need.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    total, capped = F.sum("source_size").over(everywhere), F.coalesce(F.sum(F.col("source_size") * limit).over(before), F.lit(0.0))
    left = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    each = each.withColumn("level", F.when(left > 1e-9, (total - capped) / left)).withColumn("stops", F.col("weight") * F.col("level") > F.col("source_size") * limit)
    # The level that holds is the first one at which a source doesn't stop.
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(everywhere)["level"]
    target = F.least(F.col("source_size") * limit, F.coalesce(F.col("weight") * level, F.col("source_size") * limit))
    return each.select("source", "source_size", "n_docs", target.alias("target"))


def _rate(tilt: Column, limit: float) -> Column:
    """limit / (1 + (limit - 1) exp(-tilt)): 1 without a tilt, between 0 and limit."""
    return F.lit(limit) / (1 + F.lit(limit - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -tilt))))


def solve(counts: DataFrame, goals: DataFrame, limit: float = LIMIT, steps: int = STEPS, tolerance: float = 1e-9) -> DataFrame:
    """Rows (source, scale, tilt): a document of the source has rate _rate(tilt * size / scale).

    counts: (source, size, n) of sizes above 0; goals: (source, source_size, n_docs, target). Newton steps
    on each source's dual, kept inside a bracket that halves when a step would leave it.
    """
    goals = goals.filter("source_size > 0")
    state = settle(
        goals.select("source", "target", (F.col("source_size") / F.col("n_docs")).alias("scale"), F.lit(0.0).alias("tilt"), F.lit(-4000.0).alias("low"), F.lit(4000.0).alias("high"), (F.col("target") >= F.col("source_size") * limit * (1 - 1e-12)).alias("done")),
        "tilts",
    )
    x = F.col("size") / F.col("scale")
    for _ in range(steps):
        rate = _rate(F.col("tilt") * x, limit)
        slope = F.col("n") * F.col("size") * x * rate * (1 - rate / limit)
        sums = counts.join(state, counts["source"].eqNullSafe(state["source"])).filter(~F.col("done"))
        sums = sums.select(state["source"].alias("s"), (F.col("n") * F.col("size") * rate).alias("g"), slope.alias("h")).groupBy("s").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        met = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        over = F.col("g") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("g") - F.col("target")) / F.greatest(F.col("h"), F.lit(1e-300))
        done = F.col("done") | F.coalesce(F.abs(F.col("g") - F.col("target")) <= F.lit(tolerance) * F.col("target"), F.lit(True))
        met = met.withColumns({"l": low, "u": high, "next": newton, "over_": done})
        stepped = F.when((F.col("next") > F.col("l")) & (F.col("next") < F.col("u")), F.col("next")).otherwise((F.col("l") + F.col("u")) / 2)
        fresh = settle(
            met.select("source", "target", "scale", F.when(F.col("over_"), F.col("tilt")).otherwise(stepped).alias("tilt"), F.when(F.col("over_"), F.col("low")).otherwise(F.col("l")).alias("low"), F.when(F.col("over_"), F.col("high")).otherwise(F.col("u")).alias("high"), F.col("over_").alias("done")),
            "tilts",
        )
        drop(state)
        state = fresh
        if state.filter("NOT done").isEmpty():
            break
    return state.select("source", "scale", "tilt")


def _round(group: pd.DataFrame) -> pd.DataFrame:
    """Whole copies of a group's documents, largest first; each error in words is carried to the next one.

    A row stands for `n` equal documents and gets the copies of all of them together.
    """
    group = group.sort_values(["size", "mix"], ascending=[False, True], kind="stable")
    carry, copies = 0.0, []
    for size, n, rate, limit in zip(group["size"].tolist(), group["n"].tolist(), group["rate"].tolist(), group["most"].tolist()):
        want = rate * size * n + carry
        c = 0 if size == 0 else int(min(limit * n, max(0, np.floor(want / size + 0.5))))
        carry = want - c * size
        copies.append(c)
    return group.assign(copies=copies).drop(columns=["mix", "rate", "most"])


def _each(rows: DataFrame) -> DataFrame:
    """One row for each of a row's `n` equal documents, its copies shared out evenly, the first ones getting the rest."""

    def part(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(low, high)).alias("turn")

    own = [c for c in rows.columns if c not in ("n", "copies")]
    few = rows.filter(F.col("n") <= RUN).select(*own, "n", "copies", part(F.lit(0).cast("long"), F.col("n") - 1))
    runs = rows.filter(F.col("n") > RUN).select(*own, "n", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("low"))
    many = runs.repartition(F.xxhash64("doc_id", "low")).select(*own, "n", "copies", part(F.col("low"), F.least(F.col("low") + (RUN - 1), F.col("n") - 1)))
    share = F.expr("copies div n") + (F.col("turn") < F.expr("copies % n")).cast("long")
    return few.union(many).select(*own, share.alias("copies"))


def rates(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """Rows (doc_id, source, size, mark, source_size, n_docs, target, rate), one for each row of docs; mark is a hash of the text."""
    sizes = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")), "sizes")
    goals = settle(targets(sizes, weights, limit), "targets")
    counts = settle(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    tilts = solve(counts, goals, limit)
    info = goals.join(tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "n_docs", "target", "scale", "tilt")
    rate = F.when(F.col("target") >= F.col("source_size") * limit * (1 - 1e-12), F.lit(float(limit))).otherwise(_rate(F.col("tilt") * F.col("size") / F.col("scale"), limit))
    return sizes.join(info, F.col("source").eqNullSafe(F.col("s")), "left").select("doc_id", "source", "size", "mark", "source_size", "n_docs", "target", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def copies(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, group: int = GROUP) -> DataFrame:
    """Rows (doc_id, source, size, mark, source_size, target, n, copies): one for the n rows of docs that these first four don't tell apart.

    copies is what the mix takes of all n together. Salts follow the row's own hash, so neither a hot
    source nor rows that share a doc_id, or have none, meet in one group, and equal rows are one from the start.
    """
    alike = ["doc_id", "source", "size", "mark", "source_size", "n_docs", "target", "rate"]
    rated = rates(docs, weights, limit).groupBy(*alike).agg(F.count(F.lit(1)).alias("n")).withColumn("mix", F.xxhash64("doc_id", "mark"))
    salted = rated.withColumn("salt", F.pmod(F.col("mix"), F.ceil(F.col("n_docs") / group))).withColumn("most", F.lit(float(limit))).drop("n_docs")
    kind = "doc_id long, source string, size long, mark long, source_size long, target double, n long, salt long, copies long"
    return salted.groupBy("source", "salt").applyInPandas(_round, kind).drop("salt")


def mix(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT, group: int = GROUP) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, taken), one for each row of docs (doc_id, text, source).

    size is the number of words of the text (null: 0); taken = copies * size, copies at most `limit`. A
    document without words has no copies. Rows that share a doc_id but differ are rounded each for itself,
    equal ones share their copies evenly. Reruns agree: the order inside a group is by size and a hash of
    doc_id and text. Other columns aren't read; an empty table gives no rows.
    """
    each = _each(copies(docs, weights, limit, group).drop("mark"))
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, weights=WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them: none to `limit` times.

    Equal rows (doc_id, source and text) share their copies: each is there as often as the others or once
    more, at random, so that all together come as near as rows allow; other rows come exactly as mix says.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    taken = copies(docs, weights, limit).filter("copies > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("s"), F.col("mark").alias("m"), "copies", "n")
    rows = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("mark"))
    met = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("mark") == F.col("m")))
    chance = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("n"))
    times = F.expr("copies div n") + F.when(F.col("n") > 1, (chance < F.expr("copies % n")).cast("long")).otherwise(0)
    met = met.select("row", times.alias("times")).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return met.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
