"""Distances as columns, all in double precision; smaller is nearer for every metric."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "cosine", "dot", "manhattan", "hamming")
#: Literal queries up to this length become plain arithmetic (compiled); longer ones, and pairs of columns, use array functions.
UNROLL = 256


def _sum(terms: list[Column]) -> Column:
    """A balanced sum: no deep expression tree."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(0.0)


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, z: s + z)


def _parts(a: Column, b: Column | Sequence[float], f) -> Column:
    if isinstance(b, Column):
        return _fold(a, b, f)
    if len(b) > UNROLL:
        return _fold(a, F.array(*(F.lit(float(x)) for x in b)), f)
    return _sum([f(F.get(a, F.lit(i)).cast("double"), F.lit(float(x))) for i, x in enumerate(b)])


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    return _parts(a, b, lambda x, y: x * y)


def norm(a: Column, size: int | None = None) -> Column:
    if size and size <= UNROLL:
        return F.sqrt(_sum([F.get(a, F.lit(i)).cast("double") * F.get(a, F.lit(i)).cast("double") for i in range(size)]))
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, z: s + z))


def distance(metric: str, a: Column, b: Column | Sequence[float]) -> Column:
    """Distance of a column to a query (a list) or another column; null if a is null or of another length."""
    if metric == "euclidean":
        d = F.sqrt(_parts(a, b, lambda x, y: (x - y) * (x - y)))
    elif metric == "cosine":
        size = None if isinstance(b, Column) else len(b)
        norms = norm(a, size) * (norm(b) if isinstance(b, Column) else F.lit(float(np.sqrt(np.sum(np.square(np.asarray(b, float)))))))
        d = F.when(norms == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / norms)
    elif metric == "dot":
        d = -dot(a, b)
    elif metric == "manhattan":
        d = _parts(a, b, lambda x, y: F.abs(x - y))
    elif metric == "hamming":
        d = _parts(a, b, lambda x, y: ((x > 0) != (y > 0)).cast("double"))
    else:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    length = F.size(b) if isinstance(b, Column) else F.lit(len(b))
    return F.when(F.size(a) == length, d)


def distance_to(metric: str, name: str, query: Sequence[float]) -> Column:
    """distance() of the column `name` to a query, as one parsed expression: building it costs one call, not hundreds."""
    q = [float(x) for x in query]
    if len(q) > UNROLL or not all(map(np.isfinite, q)):
        return distance(metric, F.col(name), q)
    at = [f"cast(get(`{name}`, {i}) AS double)" for i in range(len(q))]
    literal = [f"({x!r}D)" for x in q]

    def total(terms: list[str]) -> str:
        while len(terms) > 1:
            terms = [f"({terms[i]} + {terms[i + 1]})" if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return terms[0] if terms else "0D"

    dots = total([f"{a} * {x}" for a, x in zip(at, literal)])
    if metric == "euclidean":
        d = f"sqrt({total([f'({a} - {x}) * ({a} - {x})' for a, x in zip(at, literal)])})"
    elif metric == "cosine":
        norms = f"(sqrt({total([f'{a} * {a}' for a in at])}) * {float(np.sqrt(np.sum(np.square(q))))!r}D)"
        d = f"CASE WHEN {norms} = 0 THEN 1D ELSE 1 - {dots} / nullif({norms}, 0D) END"
    elif metric == "dot":
        d = f"-({dots})"
    elif metric == "manhattan":
        d = total([f"abs({a} - {x})" for a, x in zip(at, literal)])
    elif metric == "hamming":
        d = total([f"cast(({a} > 0) != {str(x > 0).lower()} AS double)" for a, x in zip(at, q)])
    else:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    return F.expr(f"CASE WHEN size(`{name}`) = {len(q)} THEN {d} END")


def matrix(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of all queries to all rows, for blocks of rows in Python workers."""
    if metric == "hamming":
        return ((q > 0)[:, None] != (x > 0)[None]).sum(2).astype(float)
    if metric == "manhattan":
        return np.stack([np.abs(x - v).sum(1) for v in q])
    if metric == "euclidean":
        return np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in q])
    s = q @ x.T
    if metric == "dot":
        return -s
    norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
    return np.where(norms == 0, 1.0, 1 - s / np.where(norms == 0, 1, norms))


def of_pairs(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of a to the same row of b; equal rows give equal distances wherever they lie."""
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(1))
    if metric == "manhattan":
        return np.abs(a - b).sum(1)
    if metric == "hamming":
        return ((a > 0) != (b > 0)).sum(1).astype(float)
    s = (a * b).sum(1)
    if metric == "dot":
        return -s
    norms = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.where(norms == 0, 1.0, 1 - s / np.where(norms == 0, 1, norms))


def rough(metric: str, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """matrix() by one product of matrices where the metric allows, and how far its values may be off (cosine: in single precision)."""
    if metric == "euclidean":
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        d = q @ x.T
        d *= -2
        d += qq[:, None]
        d += xx
        np.maximum(d, 0, out=d)
        return np.sqrt(d, out=d), 1e-6 * float(np.sqrt(qq.max(initial=0)) + np.sqrt(xx.max(initial=0)))
    if metric == "dot":
        return -(q @ x.T), 1e-9 * float(np.sqrt((q * q).sum(1).max(initial=0) * (x * x).sum(1).max(initial=0)))
    if metric == "cosine":
        unit = lambda v: (v / np.where((n := np.sqrt((v * v).sum(1))) == 0, 1, n)[:, None]).astype(np.float32)
        d = unit(q) @ unit(x).T
        return np.subtract(1, d, out=d), 1e-5
    return matrix(metric, q, x), 1e-9
