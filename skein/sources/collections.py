"""Collections: tables (id, embedding, metadata) in Parquet or newline JSON, with snapshots, backups and upserts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.dialect import merged

SCHEMA = "id long, embedding array<float>, metadata map<string,string>"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    """One object a line: index, vector, metadata."""
    df.select(F.col("id").alias("index"), F.col("embedding").alias("vector"), "metadata").write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("index long, vector array<float>, metadata map<string,string>").json(path)
    return rows.select(F.col("index").alias("id"), F.col("vector").alias("embedding"), "metadata")


def scroll(df: DataFrame, offset: int, limit: int) -> DataFrame:
    return df.orderBy("id").offset(offset).limit(limit)


def pages(df: DataFrame, size: int = 200) -> Iterator[list]:
    """Rows in id order, `size` at a time, partition by partition: the driver holds one partition at most."""
    page = []
    for row in df.orderBy("id").toLocalIterator():
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def upsert(df: DataFrame, changes: DataFrame) -> DataFrame:
    """df with the rows of changes in place of, or after, its own; the last of equal ids in changes isn't chosen: give each once."""
    return df.join(changes.select("id"), "id", "left_anti").unionByName(changes)


def delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def update_where(df: DataFrame, where: Column, changes: Mapping[str, str]) -> DataFrame:
    return df.withColumn("metadata", F.when(where, merged(F.col("metadata"), changes)).otherwise(F.col("metadata")))


def set_vector_where(df: DataFrame, where: Column, vector: list[float]) -> DataFrame:
    return df.withColumn("embedding", F.when(where, F.array(*map(F.lit, vector)).cast(df.schema["embedding"].dataType)).otherwise(F.col("embedding")))


def compact(df: DataFrame, tombstones: DataFrame) -> DataFrame:
    return delete(df, tombstones)


def incremental(df: DataFrame, base: DataFrame) -> DataFrame:
    """(id, embedding, metadata, op): rows that are new, changed (upsert) or gone (delete) since base."""
    a, b = base.select("id", F.struct("embedding", F.to_json("metadata")).alias("a")), df.select("id", F.struct("embedding", F.to_json("metadata")).alias("b"))
    met = a.join(b, "id", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    op = met.select("id", F.when(F.col("b").isNull(), "delete").otherwise("upsert").alias("op"))
    return op.join(df, "id", "left").select("id", "embedding", "metadata", "op")


def restore(base: DataFrame, increments: list[DataFrame]) -> DataFrame:
    for inc in increments:
        kept = base.join(inc.select("id"), "id", "left_anti")
        base = kept.unionByName(inc.filter("op = 'upsert'").select("id", "embedding", "metadata"))
    return base


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, length, content, path): each different content once, under its least path."""
    files = spark.read.format("binaryFile").load(path)
    first = files.groupBy(F.sha2("content", 256).alias("sha256")).agg(F.min("path").alias("path"))
    return files.join(first, "path").select("sha256", "length", "content", "path")


def shard(key: Column, shards: int) -> Column:
    """The shard of a key by hash: where a repartition by the key would put it."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def ring_shard(key: Column, shards: int, points: int = 64) -> Column:
    """The shard by consistent hashing: adding one moves about 1 / shards of the keys."""
    import xxhash

    ring = sorted((xxhash.xxh64_intdigest(f"{s}:{p}") >> 1, s) for s in range(shards) for p in range(points))
    at = F.pmod(F.xxhash64(key), F.lit((1 << 63) - 1))
    after = F.filter(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(s).alias("s")) for h, s in ring)), lambda x: x["h"] >= at)
    return F.coalesce(F.get(after, F.lit(0))["s"], F.lit(ring[0][1]))


class Aliases:
    """Names of tables that can be moved and swapped."""

    def __init__(self) -> None:
        self.names: dict[str, str] = {}

    def set(self, alias: str, table: str) -> None:
        self.names[alias] = table

    def resolve(self, name: str) -> str:
        return self.names.get(name, name)

    def swap(self, a: str, b: str) -> None:
        self.names[a], self.names[b] = self.names[b], self.names[a]

    def remove(self, alias: str) -> bool:
        return self.names.pop(alias, None) is not None


def validate(df: DataFrame, required: list[str], types: Mapping[str, str], column: str = "metadata") -> DataFrame:
    """(id, key, problem) of required keys that lack and values that don't read as their type."""
    checks = [F.when(F.col(column)[k].isNull(), F.struct(F.lit(k).alias("key"), F.lit("missing").alias("problem"))) for k in required]
    checks += [F.when(F.col(column)[k].isNotNull() & F.col(column)[k].try_cast(t).isNull(), F.struct(F.lit(k).alias("key"), F.lit(f"not {t}").alias("problem"))) for k, t in types.items()]
    found = df.select("id", F.explode(F.array_compact(F.array(*checks))).alias("p"))
    return found.select("id", "p.key", "p.problem")


def schema_diff(old: Mapping[str, str], new: Mapping[str, str]) -> dict[str, str]:
    return {k: "added" if k not in old else "removed" if k not in new else "changed" for k in sorted(old.keys() | new.keys()) if old.get(k) != new.get(k)}
