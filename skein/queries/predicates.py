"""Predicate languages, the SQL dialect, payload and JSON predicates, geo."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.predicate import Where, from_map, parse_filter
from skein.operators import places
from skein.plans import dialect
from skein.queries.common import COLLECTION_SQL, POINTS_SQL, collection, points, table
from skein.queries.search import Q0, dist, q0

C = f"({COLLECTION_SQL})"
NUM = "TRY_CAST(nullif(regexp_extract({c}, '^\\s*([-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?)', 1), '') AS DOUBLE)"


def num(c: str) -> str:
    return NUM.format(c=c)


def yes(p: str) -> str:
    return f"coalesce({p}, false)"


def _filter(text: str, sql: str):
    return (lambda spark, d: collection(spark, d).filter(parse_filter(text, from_map())).select("id")), f"SELECT id FROM {C} WHERE {sql}"


def _sql(text: str, oracle: str, mode: str = "exact"):
    return (lambda spark, d: dialect.execute({"vectors": collection(spark, d)}, text, mode)), oracle


def _ann(text: str, oracle: str, mode: str = "exact"):
    def run(spark, d):
        query = ",".join(repr(x) for x in q0(spark, d))
        return dialect.execute({"vectors": collection(spark, d)}, text.replace("?", f"[{query}]"), mode)

    return run, oracle


def filter_builder(spark, d):
    w = (Where("label").is_in([1, 2]) & (Where("size") >= 5)) | ~Where("code").prefix("1")
    return collection(spark, d).filter(w.on(from_map())).select("id")


def count_by_filter(spark, d):
    return collection(spark, d).filter(parse_filter("label == 3 AND size > 4", from_map())).agg(F.count(F.lit(1)).alias("n"))


def update_by_filter(spark, d):
    from skein.sources.collections import update_where

    rows = update_where(collection(spark, d), parse_filter("label == 4", from_map()), {"code": "new", "seen": "1"})
    return rows.select("id", F.col("metadata")["code"].alias("code"), F.col("metadata")["seen"].alias("seen"))


def delete_by_filter(spark, d):
    return collection(spark, d).filter(~parse_filter("size < 9", from_map())).select("id")


def sql_update(spark, d):
    return dialect.updated(collection(spark, d), "UPDATE vectors SET code = 'x' WHERE label = '5'").select("id", F.col("metadata")["code"].alias("code"))


def metadata_counts(spark, d):
    return collection(spark, d).select(F.explode("metadata").alias("key", "value")).filter("key <> 'code'").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def payload_multi(spark, d):
    return places.payload(table(spark, d, "part"), [("p_size", "ge", 10), ("p_size", "lt", 30), ("p_brand", "prefix", "Brand#1"), ("p_retailprice", "gt", 1000.0)]).select("p_partkey", "p_size", "p_brand")


def payload_contains(spark, d):
    return places.payload(table(spark, d, "part"), [("p_type", "contains", "A"), ("p_size", "ne", 5)]).select("p_partkey")


def json_string(spark, d):
    return places.json_equals(table(spark, d, "events"), "props", "k", "7").select("event_id")


def json_int_range(spark, d):
    return places.json_between(table(spark, d, "events"), "props", "k", 10, 20, whole=True).select("event_id")


def json_float_range(spark, d):
    return places.json_between(table(spark, d, "events"), "props", "k", 2.5, 6.5).select("event_id")


def geo_radius(spark, d):
    return places.within_km(points(spark, d), 48.0, 2.0, 1500.0).select("id", F.round("distance_km", 4).alias("distance_km"))


def geo_bbox(spark, d):
    return places.in_box(points(spark, d), 10.0, -20.0, 40.0, 60.0).select("id", F.round("distance_km", 4).alias("distance_km"))


def schema_violations(spark, d):
    from skein.sources.collections import validate

    return validate(collection(spark, d), ["size"], {"code": "int"})


KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - {a}) / 2), 2) + cos(radians({a})) * cos(radians(lat)) * pow(sin(radians(lng - {b}) / 2), 2))))"
J = "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)"
ANN = f"SELECT *, {dist('cosine')} AS d FROM {C}"
QUERIES = {
    "filter_equal": _filter("label == 3", "label = '3'"),
    "filter_numeric_prefix": _filter("code >= 40 AND code < 60", f"{yes(num('code') + ' >= 40')} AND {yes(num('code') + ' < 60')}"),
    "filter_missing_key": _filter("size != 3", yes(num("size") + " <> 3")),
    "filter_not": _filter("NOT size == 3", f"NOT {yes(num('size') + ' = 3')}"),
    "filter_contains": _filter('code CONTAINS "9a" OR code PREFIX "2"', "contains(code, '9a') OR starts_with(code, '2')"),
    "filter_string_order": _filter('code < "zzz" OR label == 1', "label = '1'"),
    "filter_in": _filter("label IN (1, 2) AND (size <= 4 OR NOT size > 2)", f"label IN ('1', '2') AND ({yes(num('size') + ' <= 4')} OR NOT {yes(num('size') + ' > 2')})"),
    "filter_builder": (filter_builder, f"SELECT id FROM {C} WHERE (label IN ('1', '2') AND {yes(num('size') + ' >= 5')}) OR NOT starts_with(code, '1')"),
    "count_by_filter": (count_by_filter, f"SELECT count(*) AS n FROM {C} WHERE label = '3' AND {yes(num('size') + ' > 4')}"),
    "update_by_filter": (update_by_filter, f"SELECT id, CASE WHEN label = '4' THEN 'new' ELSE code END AS code, CASE WHEN label = '4' THEN '1' END AS seen FROM {C}"),
    "delete_by_filter": (delete_by_filter, f"SELECT id FROM {C} WHERE NOT {yes(num('size') + ' < 9')}"),
    "metadata_counts": (metadata_counts, f"SELECT 'label' AS key, label AS value, count(*) AS n FROM {C} GROUP BY label UNION ALL SELECT 'size', size, count(*) FROM {C} WHERE size IS NOT NULL GROUP BY size"),
    "like_prefix": _sql("SELECT index FROM vectors WHERE code LIKE '12%'", f"SELECT id AS index FROM {C} WHERE starts_with(code, '12')"),
    "like_suffix": _sql("SELECT index FROM vectors WHERE code LIKE '%7abc'", f"SELECT id AS index FROM {C} WHERE ends_with(code, '7abc')"),
    "like_contains": _sql("SELECT index FROM vectors WHERE code LIKE '%5a%'", f"SELECT id AS index FROM {C} WHERE contains(code, '5a')"),
    "sql_select_where": _sql("SELECT index, label, size FROM vectors WHERE label = '2' OR size > 14", f"SELECT id AS index, label, coalesce(size, '') AS size FROM {C} WHERE label = '2' OR {yes(num('size') + ' > 14')}"),
    "sql_string_order": _sql("SELECT index FROM vectors WHERE code >= '300' AND NOT code <> '310abc'", f"SELECT id AS index FROM {C} WHERE code >= '300' AND code = '310abc'"),
    "sql_order_by": _sql("SELECT index, size FROM vectors WHERE label != '0' ORDER BY size DESC LIMIT 25", f"SELECT id AS index, coalesce(size, '') AS size FROM {C} WHERE label <> '0' ORDER BY {num('size')} DESC NULLS LAST, coalesce(size, '') DESC, id LIMIT 25"),
    "sql_count": _sql("SELECT COUNT(*) FROM vectors WHERE size < 5", f"SELECT count(*) AS count FROM {C} WHERE {yes(num('size') + ' < 5')}"),
    "sql_ann": _ann("SELECT index, label FROM vectors ANN(query=?, k=7)", f"SELECT id AS index, label FROM ({ANN}) ORDER BY d, id LIMIT 7"),
    "sql_ann_where_exact": _ann("SELECT index, size FROM vectors ANN(query=?, k=7, metric=cosine) WHERE size > 8", f"SELECT id AS index, coalesce(size, '') AS size FROM ({ANN}) WHERE {yes(num('size') + ' > 8')} ORDER BY d, id LIMIT 7"),
    "sql_ann_where_postfilter": _ann("SELECT index FROM vectors ANN(query=?, k=7) WHERE size > 8", f"SELECT id AS index FROM (SELECT * FROM ({ANN}) ORDER BY d, id LIMIT 28) WHERE {yes(num('size') + ' > 8')} ORDER BY d, id LIMIT 7", "postfilter"),
    "sql_delete_count": _sql("DELETE FROM vectors WHERE label = '1'", f"SELECT count(*) AS deleted_count FROM {C} WHERE label = '1'"),
    "sql_update_count": _sql("UPDATE vectors SET code = 'x' WHERE size >= 10", f"SELECT count(*) AS updated_count FROM {C} WHERE {yes(num('size') + ' >= 10')}"),
    "sql_update": (sql_update, f"SELECT id, CASE WHEN label = '5' THEN 'x' ELSE code END AS code FROM {C}"),
    "payload_multi": (payload_multi, "SELECT p_partkey, p_size, p_brand FROM part WHERE p_size >= 10 AND p_size < 30 AND starts_with(p_brand, 'Brand#1') AND p_retailprice > 1000"),
    "payload_contains": (payload_contains, "SELECT p_partkey FROM part WHERE contains(p_type, 'A') AND p_size <> 5"),
    "json_path_string": (json_string, "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'"),
    "json_path_int_range": (json_int_range, f"SELECT event_id FROM events WHERE trunc({J}) BETWEEN 10 AND 20"),
    "json_path_float_range": (json_float_range, f"SELECT event_id FROM events WHERE {J} BETWEEN 2.5 AND 6.5"),
    "geo_radius": (geo_radius, f"SELECT id, round({KM.format(a='48.0', b='2.0')}, 4) AS distance_km FROM ({POINTS_SQL}) WHERE {KM.format(a='48.0', b='2.0')} <= 1500"),
    "geo_bbox": (geo_bbox, f"SELECT id, round({KM.format(a='25.0', b='20.0')}, 4) AS distance_km FROM ({POINTS_SQL}) WHERE lat BETWEEN 10 AND 40 AND lng BETWEEN -20 AND 60"),
    "schema_violations": (schema_violations, f"SELECT id, 'size' AS key, 'missing' AS problem FROM {C} WHERE size IS NULL UNION ALL SELECT id, 'code', 'not int' FROM {C}"),
}
