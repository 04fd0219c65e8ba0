"""Importance scores of texts, temporal decay, access patterns, retention, and memory search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_LIFE_HOURS, LN2 = 168.0, 0.693147
TYPES = ("preference", "relationship", "event", "fact")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))


def _variance(lengths: Column) -> Column:
    n = F.size(lengths)
    one = F.aggregate(lengths, F.lit(0.0), lambda s, x: s + x)
    two = F.aggregate(lengths, F.lit(0.0), lambda s, x: s + x * x)
    return two / n - (one / n) * (one / n)


def informativeness(text: Column) -> Column:
    """0.4 lexical diversity, 0.3 word length, 0.3 sentence length; 0 without words."""
    w = words(text)
    n = F.size(w)
    distinct = F.size(F.array_distinct(F.transform(w, F.lower)))
    diversity = clamp((distinct / n - 0.2) / 0.6)
    length = clamp(1 - F.abs(_count(text, "[A-Za-z]") / n - 5.5) / 4)
    ends = _count(text, "[.!?]")
    structure = clamp(1 - F.abs(F.when(ends > 0, n / ends).otherwise(n.cast("double")) - 17.5) / 15)
    return F.when(n > 0, 0.4 * diversity + 0.3 * length + 0.3 * structure).otherwise(0.0)


def capitalized(text: Column) -> Column:
    """Words that begin with a capital, but for the first of a sentence; a word ends at white space or a stop."""
    return _count(text, r"(?<=[^.!?\s][\s]{1,8})[^A-Za-z\s.!?]*[A-Z][^\s.!?]*(?=[\s.!?])")


def specificity(text: Column) -> Column:
    w = words(text)
    n = F.size(w)
    alpha = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    lengths = F.transform(alpha, lambda x: F.length(x).cast("double"))
    score = F.lit(0.5) + clamp(_count(text, "[0-9]+") / n * 0.8, 0, 0.2) + clamp(capitalized(text) / n * 0.5, 0, 0.2)
    score = score + F.when(F.size(alpha) > 1, clamp((1 - F.exp(-_variance(lengths) / 10)) * 0.15, 0, 0.15)).otherwise(0.0)
    score = score + F.when(F.rlike(text, F.lit(r"(?s)@.*\.")), 0.1).otherwise(0.0) + F.when(F.contains(text, F.lit("://")) | F.contains(text, F.lit("www.")), 0.1).otherwise(0.0)
    score = score + F.when(F.rlike(text, F.lit("[0-9][/-][0-9]")), 0.1).otherwise(0.0)
    score = score - clamp(F.size(F.filter(alpha, lambda x: F.length(x) <= 3)) / n * 0.2, 0, 0.1)
    return F.when(n > 0, clamp(score)).otherwise(0.0)


def salience(text: Column) -> Column:
    n = F.size(words(text))
    score = clamp(_count(text, "!") * 0.12, 0, 0.2) + clamp(_count(text, r"\?") * 0.1, 0, 0.15) + clamp(_count(text, "[\"']") * 0.03, 0, 0.1) + clamp(_count(text, "[()]") * 0.02, 0, 0.05)
    score = score + clamp(_count(text, "(?<![A-Za-z])[A-Z]{2,}(?![A-Za-z])") / n * 1.5, 0, 0.2)
    score = score + clamp(_count(text, "'[sS]") * 0.1, 0, 0.15) + clamp(_count(text, ":") * 0.08, 0, 0.1)
    per = F.filter(F.transform(F.split(text, "[.!?]"), lambda x: F.regexp_count(x, F.lit("[A-Za-z0-9]+")).cast("double")), lambda x: x > 0)
    score = score + F.when(F.size(per) > 1, clamp((1 - F.exp(-_variance(per) / 50)) * 0.1, 0, 0.1)).otherwise(0.0)
    return F.when(n > 0, clamp(score)).otherwise(0.0)


def entity_density(text: Column) -> Column:
    n = F.size(words(text))
    return F.when(n > 0, 1 / (1 + F.exp(-15.0 * ((capitalized(text) + _count(text, "[0-9]+")) / n - 0.15)))).otherwise(0.0)


def content_score(text: Column) -> Column:
    n = F.size(words(text))
    factor = F.when(n < 5, n / 5.0).when(n <= 100, 1.0).otherwise(clamp(1 - (n - 100) / 200.0, 0.5, 1.0))
    return clamp((0.30 * informativeness(text) + 0.25 * specificity(text) + 0.25 * salience(text) + 0.20 * entity_density(text)) * factor)


def extracted_score(text: Column, floor: float = 0.4) -> Column:
    """For short extracted facts: a floor, and the rest by content without a penalty for length."""
    n = F.size(words(text))
    concrete = F.when(n > 0, clamp((capitalized(text) + _count(text, "[0-9]+")) / n * 0.3, 0, 0.3)).otherwise(0.0)
    base = 0.20 * informativeness(text) + 0.35 * specificity(text) + 0.15 * concrete + 0.30 * entity_density(text)
    return clamp(floor + (1 - floor) * base, floor, 1.0)


def similar_pairs(memories: DataFrame, threshold: float, k: int = 10) -> DataFrame:
    """(a, b, similarity): distinct unordered pairs among each memory's k nearest whose 1 - d / 2 is at least the threshold."""
    from skein.operators.knn import join_topk

    near = join_topk(memories, memories, k + 1).filter("query_id <> id")
    pair = near.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), (1 - F.col("distance") / 2).alias("similarity"))
    return pair.filter(F.col("similarity") >= threshold).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def temporal_decay(age_seconds: Column, half_life: float = HALF_LIFE_HOURS, floor: float = 0.1, boost_hours: float = 24.0, boost: float = 1.3) -> Column:
    """exp(-age / stability), at least `floor`; the first hours are raised, up to 1; no age is 1."""
    hours = age_seconds / 3600.0
    decay = F.greatest(F.exp(-hours / (half_life / LN2)), F.lit(floor))
    raised = F.least(decay * (1 + (boost - 1) * (1 - hours / boost_hours)), F.lit(1.0))
    return F.when(age_seconds <= 0, 1.0).when(hours < boost_hours, raised).otherwise(decay)


def access_scores(accesses: DataFrame, now: Column, optimal_hours: float = 48.0) -> DataFrame:
    """(id, access_score) from a log (id, ts, relevance): count, recency, relevance and spacing of accesses."""
    span = (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))) / 3600.0
    s = accesses.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.avg("relevance").alias("relevance"), span.alias("span"))
    ratio = F.col("span") / (F.col("n") - 1) / optimal_hours
    spacing = F.when(F.col("n") >= 2, F.exp(-F.pow(F.log(ratio + 0.1), F.lit(2.0)) / 2)).otherwise(0.5)
    recency = temporal_decay((F.unix_timestamp(now) - F.unix_timestamp("last")).cast("double"))
    score = 0.3 * clamp(F.log(1.0 + F.col("n")) / F.log(F.lit(101.0))) + 0.3 * recency + 0.2 * F.col("relevance") + 0.2 * spacing
    return s.select("id", clamp(score).alias("access_score"))


def structural_score(incoming: Column, outgoing: Column, relations: Column) -> Column:
    linked = 0.6 * (1 - F.exp(-0.3 * (incoming + outgoing))) + 0.4 * (1 - F.exp(-0.2 * relations))
    return F.when((incoming > 0) | (outgoing > 0) | (relations > 0), linked).otherwise(0.0)


def importance(content: Column, temporal: Column, access: Column, salient: Column, structural: Column, similarity: Column | None = None) -> Column:
    """Weighted mean of the factors that aren't null (.30 .25 .20 .15 .10), half and half with a query's similarity."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for w, x in ((0.30, content), (0.25, temporal), (0.20, access), (0.15, salient), (0.10, structural)):
        total, weight = total + F.coalesce(w * x, F.lit(0.0)), weight + F.when(x.isNotNull(), w).otherwise(0.0)
    score = F.when(weight > 0, total / weight).otherwise(0.5)
    if similarity is not None:
        score = F.when(similarity > 0, 0.5 * score + 0.5 * similarity).otherwise(score)
    return clamp(score)


def retention(strength: Column, elapsed: Column, accesses: Column, decay: float = 0.01, weight: float = 0.1) -> Column:
    """strength * exp(-decay * elapsed) + weight * sum of 1 / (time since each access); accesses is an array of positive times."""
    return strength * F.exp(-decay * elapsed) + weight * F.aggregate(F.filter(F.coalesce(accesses, F.array().cast("array<double>")), lambda t: t > 0), F.lit(0.0), lambda s, t: s + 1 / t)


def detect_type(text: Column) -> Column:
    low = F.lower(text)

    def has(*parts: str) -> Column:
        c = F.lit(False)
        for p in parts:
            c = c | F.contains(low, F.lit(p))
        return c

    return F.when(has("prefer", "like", "favorite"), "preference").when(has("know", "friend", "colleague", "relationship"), "relationship").when(has("happened", "event", "occurred", "meeting"), "event").otherwise("fact")


def candidates(texts: DataFrame, threshold: float, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, content, importance, memory_type): sentences of more than 10 characters that score at least the threshold."""
    parts = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"[.!?\n]")).alias("pos", "s"))
    parts = parts.select("id", "pos", F.regexp_replace("s", r"^[\s\p{Punct}]+", "").alias("content")).filter(F.length("content") > 10)
    return parts.select("id", "pos", "content", content_score(F.col("content")).alias("importance"), detect_type(F.col("content")).alias("memory_type")).filter(F.col("importance") >= threshold)


def memory_search(hits: DataFrame, scores: DataFrame, k: int, weight: float = 0.6) -> DataFrame:
    """(id, score): hits (id, distance) by `weight` relevance, max(0, 1 - d / 2), and the rest importance (id, importance)."""
    relevance = F.greatest(F.lit(0.0), 1 - F.col("distance") / 2)
    met = hits.join(scores, "id", "left")
    return met.select("id", (weight * relevance + (1 - weight) * F.coalesce("importance", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def merge_contents(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, content) of memory pairs, their contents joined by '. '."""
    x, y = memories.select(F.col("id").alias("a"), F.col("content").alias("ca")), memories.select(F.col("id").alias("b"), F.col("content").alias("cb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", F.concat_ws(". ", "ca", "cb").alias("content"))


KINDS = ("similar", "supports", "contradicts", "extends", "causal", "example", "prerequisite", "temporal")


def links_both_ways(links: DataFrame, factor: float = 0.9) -> DataFrame:
    """Links (src, dst, kind, strength) and their mirror images of the same kind, weaker, within [0, 1]; an unknown kind mirrors as similar."""
    back = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("similar")
    mirrored = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), back.alias("kind"), clamp(F.col("strength") * factor).alias("strength"))
    return links.select("src", "dst", "kind", clamp(F.col("strength")).alias("strength")).union(mirrored)
