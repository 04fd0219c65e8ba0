"""Vector codecs: scalar n-bit, binary, ternary and product quantisation, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(dim, lo, hi, mean, std) of every dimension."""
    each = df.select(F.posexplode(vec_col).alias("dim", "x"))
    x = F.col("x").cast("double")
    return each.groupBy("dim").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def _bounds(codebook: DataFrame) -> tuple[list[float], list[float]]:
    rows = sorted(codebook.select("dim", "lo", "hi").collect())  # one row a dimension
    return [r["lo"] for r in rows], [r["hi"] for r in rows]


def _literal(values: list[float]) -> Column:
    return F.array(*map(F.lit, values))


def encode(vector: Column, codebook: DataFrame, bits: int = 8) -> Column:
    """An array of codes 0 .. 2**bits - 1: the nearest step between a dimension's least and greatest value."""
    lo, hi = _bounds(codebook)
    top = float((1 << bits) - 1)
    step = lambda s, b: (s["x"] - s["a"]) / (b - s["a"]) * top
    placed = F.zip_with(vector, _literal(lo), lambda x, a: F.struct(x.cast("double").alias("x"), a.alias("a")))
    return F.zip_with(placed, _literal(hi), lambda s, b: F.when(b > s["a"], F.floor(F.least(F.lit(top), F.greatest(F.lit(0.0), step(s, b))) + 0.5)).otherwise(0).cast("int"))


def decode(codes: Column, codebook: DataFrame, bits: int = 8) -> Column:
    lo, hi = _bounds(codebook)
    top = float((1 << bits) - 1)
    return F.zip_with(F.zip_with(codes, _literal(lo), lambda c, a: F.struct(c.alias("c"), a.alias("a"))), _literal(hi), lambda s, b: s["a"] + (b - s["a"]) * s["c"] / top)


def code_distance(codes: Column, query: list[float], codebook: DataFrame, bits: int = 8) -> Column:
    """Euclidean distance of a query to decoded codes."""
    from skein.functions.distance import distance

    return distance("euclidean", decode(codes, codebook, bits), query)


def code_code_distance(a: Column, b: Column, codebook: DataFrame, bits: int = 8) -> Column:
    from skein.functions.distance import distance

    return distance("euclidean", decode(a, codebook, bits), decode(b, codebook, bits))


def binary(vector: Column) -> Column:
    """Sign bits as an array of longs of 64 bits, the first component in the lowest bit."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(vector) - 1), F.lit(64))
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.transform(starts, lambda at: F.aggregate(F.transform(F.slice(vector, at + 1, 64), bit), F.lit(0).cast("long"), lambda s, z: s.bitwiseOR(z)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, z: s + z)


def ternary(vector: Column, threshold: float) -> Column:
    return F.transform(vector, lambda x: F.when(x > threshold, 1).when(x < -threshold, -1).otherwise(0))
