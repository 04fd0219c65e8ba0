"""Fusion of ranked lists, rank expressions and phased ranking."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def linear(vector_score: Column, text_score: Column, vector_weight: float = 0.5, text_weight: float = 0.5) -> Column:
    return vector_weight * vector_score + text_weight * text_score


def rrf(*ranks: Column, k: float = 60.0) -> Column:
    """Sum of 1 / (k + rank); a missing (null or 0) rank adds nothing."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.when(r > 0, 1.0 / (k + r)).otherwise(0.0)
    return total


def normalize(score: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (score - low) / (high - low)).otherwise(0.5)


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, k: int, mode: str = "linear", vector_weight: float = 0.5, text_weight: float = 0.5, rrf_k: float = 60.0) -> DataFrame:
    """(id, score, vector_score, text_score) from (id, distance) and (id, score): both short lists of candidates.

    Distances become 1 / (1 + d); each side is scaled to [0, 1] over its candidates; ids meet by full outer join.
    """
    v = vector_hits.select("id", (1 / (1 + F.col("distance"))).alias("s"), F.row_number().over(W.orderBy("distance", "id")).alias("r"))
    t = text_hits.select("id", F.col("score").alias("s"), F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("r"))

    def scaled(df: DataFrame, name: str) -> DataFrame:
        bounds = df.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))  # one row
        return df.crossJoin(F.broadcast(bounds)).select("id", normalize(F.col("s"), F.col("lo"), F.col("hi")).alias(f"{name}_score"), F.col("r").alias(f"{name}_rank"))

    both = scaled(v, "vector").join(scaled(t, "text"), "id", "full_outer")
    vs, ts = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("text_score", F.lit(0.0))
    score = linear(vs, ts, vector_weight, text_weight) if mode == "linear" else rrf(F.col("vector_rank"), F.col("text_rank"), k=rrf_k)
    return both.select("id", score.alias("score"), vs.alias("vector_score"), ts.alias("text_score")).orderBy(F.desc("score"), "id").limit(k)


def weighted_rrf(lists: Sequence[tuple[DataFrame, float]], k: int, rrf_k: float = 60.0) -> DataFrame:
    """(id, score) from ranked lists (id, rank), each with a weight."""
    parts = None
    for df, weight in lists:
        part = df.select("id", (F.lit(float(weight)) / (rrf_k + F.col("rank"))).alias("s"))
        parts = part if parts is None else parts.union(part)
    return parts.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def decay_exp(v: Column, origin: Column, scale: Column) -> Column:
    return F.when(scale > 0, F.exp(-F.abs(v - origin) / scale)).otherwise(0.0)


def decay_gauss(v: Column, origin: Column, scale: Column) -> Column:
    return F.when(scale > 0, F.exp(-0.5 * F.pow((v - origin) / scale, F.lit(2.0)))).otherwise(0.0)


def decay_linear(v: Column, origin: Column, scale: Column) -> Column:
    return F.when(scale > 0, F.greatest(F.lit(0.0), 1 - F.abs(v - origin) / scale)).otherwise(0.0)


FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "decay_exp": (3, decay_exp),
    "decay_gauss": (3, decay_gauss),
    "decay_linear": (3, decay_linear),
    "log": (1, lambda v: F.when(v > 0, F.log(v)).otherwise(0.0)),
    "pow": (2, F.pow),
    "clamp": (3, lambda v, lo, hi: F.least(hi, F.greatest(lo, v))),
    "max": (2, F.greatest),
    "min": (2, F.least),
    "linear": (3, lambda x, a, b: a * x + b),
}
_LEX = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|([A-Za-z_]\w*)|([-+*/(),]))")


def rank_expression(text: str, score: Column, signals: Mapping[str, Column]) -> Column:
    """An infix expression (+ - * /, parentheses, FUNCTIONS) over _score and signals; unknown and null signals are 0."""
    parts, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        parts.append(m.group(0).strip())
        at = m.end()
    pos = 0

    def peek() -> str:
        return parts[pos] if pos < len(parts) else ""

    def take(want: str = "") -> str:
        nonlocal pos
        if pos >= len(parts) or (want and parts[pos] != want):
            raise ValueError(f"expected {want or 'more'} in {text!r}")
        pos += 1
        return parts[pos - 1]

    def primary() -> Column:
        t = take()
        if t == "(":
            e = total()
            take(")")
            return e
        if t == "-":
            return -primary()
        if t[0].isdigit() or t[0] == ".":
            return F.lit(float(t))
        if not (t[0].isalpha() or t[0] == "_"):
            raise ValueError(f"unexpected {t!r} in {text!r}")
        if peek() == "(":
            if t not in FUNCTIONS:
                raise ValueError(f"unknown function {t!r}")
            take("(")
            args = [total()]
            while peek() == ",":
                take(",")
                args.append(total())
            take(")")
            n, f = FUNCTIONS[t]
            if len(args) != n:
                raise ValueError(f"{t} takes {n} arguments")
            return f(*args)
        if t == "_score":
            return score
        return F.coalesce(signals[t].cast("double"), F.lit(0.0)) if t in signals else F.lit(0.0)

    def product() -> Column:
        e = primary()
        while peek() in ("*", "/"):
            op, right = take(), None
            right = primary()
            e = e * right if op == "*" else F.try_divide(e, right)
        return e

    def total() -> Column:
        e = product()
        while peek() in ("+", "-"):
            op = take()
            right = product()
            e = e + right if op == "+" else e - right
        return e

    out = total()
    if pos != len(parts):
        raise ValueError(f"trailing {' '.join(parts[pos:])!r}")
    return F.coalesce(out, F.lit(0.0))


def weighted_expression(weights: Mapping[str, float], signals: Mapping[str, Column]) -> Column:
    return sum((w * F.coalesce(signals[n].cast("double"), F.lit(0.0)) for n, w in weights.items() if n in signals), F.lit(0.0))


def rank_search(hits: DataFrame, signals: DataFrame, expression: str, k: int) -> DataFrame:
    """(id, score, distance): candidates (id, distance) rescored with signals joined by id."""
    met = hits.join(signals, "id", "left")
    names = {c: F.col(c) for c in signals.columns if c != "id"}
    return met.select("id", rank_expression(expression, 1 / (1 + F.col("distance")), names).alias("score"), "distance").orderBy(F.desc("score"), "id").limit(k)


def pipeline(candidates: DataFrame, phases: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Phases one after another over candidates, at most 8; the first finds them, each of the rest reranks or filters."""
    if len(phases) > 8:
        raise ValueError("at most 8 phases")
    for phase in phases:
        candidates = phase(candidates)
    return candidates
