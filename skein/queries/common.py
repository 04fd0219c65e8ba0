"""Tables of a folder in the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different lengths: each times one more than its label."""
    return vectors(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))))


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, metadata{label, code, size?}): a text code per row, and a size in two of three rows."""
    v = vectors(spark, sf_dir)
    pairs = F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("code"), F.concat(F.col("id").cast("string"), F.lit("abc")))
    sized = F.map_concat(pairs, F.create_map(F.lit("size"), (F.col("id") % 17).cast("string")))
    return v.select("id", "embedding", F.when(F.col("id") % 3 == 0, pairs).otherwise(sized).alias("metadata"))


#: The same collection for DuckDB, its metadata as columns (size null when absent).
COLLECTION_SQL = "SELECT vec_id AS id, embedding, CAST(label AS VARCHAR) AS label, CAST(vec_id AS VARCHAR) || 'abc' AS code, CASE WHEN vec_id % 3 <> 0 THEN CAST(vec_id % 17 AS VARCHAR) END AS size FROM embeddings"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, type): regions from 0, nations from 100, suppliers from 1000."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("type"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("nation").alias("type"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).cast("long").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"))
    return r.union(n).union(s)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o, weight): nation in region, supplier based in nation."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("s"), F.lit("in_region").alias("p"), F.col("n_regionkey").cast("long").alias("o"), F.lit(1.0).alias("weight"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).cast("long").alias("s"), F.lit("based_in").alias("p"), (F.col("s_nationkey") + 100).cast("long").alias("o"), F.lit(0.9).alias("weight"))
    return n.union(s)


ENTITIES_SQL = """SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, 'region' AS type FROM region UNION ALL
    SELECT CAST(n_nationkey + 100 AS BIGINT), n_name, 'nation' FROM nation UNION ALL SELECT CAST(s_suppkey + 1000 AS BIGINT), s_name, 'supplier' FROM supplier"""
RELATIONS_SQL = """SELECT CAST(n_nationkey + 100 AS BIGINT) AS s, 'in_region' AS p, CAST(n_regionkey AS BIGINT) AS o, 1.0::DOUBLE AS weight FROM nation UNION ALL
    SELECT CAST(s_suppkey + 1000 AS BIGINT), 'based_in', CAST(s_nationkey + 100 AS BIGINT), 0.9::DOUBLE FROM supplier"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts' and suppliers' property graph: nodes (id, label) and edges (src, dst, label, weight), supplier 1000000 + key."""
    li = table(spark, sf_dir, "lineitem")
    e = li.select((F.col("l_suppkey") + 1_000_000).alias("src"), F.col("l_partkey").alias("dst"), F.lit("ships").alias("label"), F.col("l_quantity").alias("weight"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("label"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.lit("supplier").alias("label"))
    return p.union(s), e


EDGES_SQL = "SELECT l_suppkey + 1000000 AS src, l_partkey AS dst, l_quantity AS weight FROM lineitem"
NODES_SQL = "SELECT p_partkey AS id, 'part' AS label FROM part UNION ALL SELECT s_suppkey + 1000000, 'supplier' FROM supplier"


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, type, id, data, ts) out of events: three rows an event user, by its id's remainder."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 7 == 0, "delete").when(F.col("event_id") % 3 == 0, "insert").otherwise("update")
    return e.select(F.col("event_id").alias("version"), kind.alias("type"), F.col("user_id").alias("id"), F.col("value").alias("data"), "ts")


LOG_SQL = "SELECT event_id AS version, CASE WHEN event_id % 7 = 0 THEN 'delete' WHEN event_id % 3 = 0 THEN 'insert' ELSE 'update' END AS type, user_id AS id, value AS data, ts FROM events"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lat, lng): customers spread over the globe by their key."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919) % 16001 / 100.0 - 80.0).alias("lat"), ((k * 104729) % 35801 / 100.0 - 179.0).alias("lng"))


POINTS_SQL = "SELECT c_custkey AS id, (c_custkey * 7919) % 16001 / 100.0 - 80.0 AS lat, (c_custkey * 104729) % 35801 / 100.0 - 179.0 AS lng FROM customer"
