"""Bloom filters as tables of 64-bit words: built, merged and probed without collecting anything."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shape(n: int, p: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for n values at false-positive rate p."""
    bits = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def _positions(value: Column, bits: int, hashes: int) -> Column:
    a, b = F.xxhash64(value), F.hash(value).cast("long") * 2 + 1  # double hashing
    return F.array(*(F.pmod(a + i * b, F.lit(bits)) for i in range(hashes)))


def _word(position: Column) -> tuple[Column, Column]:
    return F.shiftright(position, 6), F.call_function("shiftleft", F.lit(1).cast("long"), position.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def build(df: DataFrame, column: str, n: int, p: float = 0.01) -> DataFrame:
    """(word, bits): the words with a bit set."""
    m, k = shape(n, p)
    word, bit = _word(F.col("at"))
    at = df.filter(F.col(column).isNotNull()).select(F.explode(_positions(F.col(column).cast("string"), m, k)).alias("at"))
    return at.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def maybe(df: DataFrame, column: str, bloom: DataFrame, n: int, p: float = 0.01) -> DataFrame:
    """Distinct values of df that the filter (of the same n and p) may hold: none that it holds is missing."""
    m, k = shape(n, p)
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    at = values.select("value", F.explode(_positions(F.col("value").cast("string"), m, k)).alias("at"))
    word, bit = _word(F.col("at"))
    met = at.select("value", word.alias("word"), bit.alias("bit")).join(bloom, "word", "left")
    hit = met.groupBy("value").agg(F.min((F.coalesce(F.col("bits").bitwiseAND(F.col("bit")), F.lit(0)) != 0).cast("int")).alias("all"))
    return hit.filter(F.col("all") == 1).select("value")
