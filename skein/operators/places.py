"""Geo, JSON-path and typed payload predicates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def within_km(points: DataFrame, lat: float, lng: float, radius: float) -> DataFrame:
    """Rows with distance_km at most radius; a latitude and (away from the poles) longitude band goes to the scan first."""
    dlat = math.degrees(radius / EARTH_KM)
    band = F.col("lat").between(lat - dlat, lat + dlat)
    if abs(lat) + dlat < 89:
        dlng = math.degrees(math.asin(min(1.0, math.sin(min(math.pi / 2, radius / EARTH_KM)) / math.cos(math.radians(lat)))))
        if -180 <= lng - dlng and lng + dlng <= 180:
            band = band & F.col("lng").between(lng - dlng, lng + dlng)
    d = distance_km(F.lit(float(lat)), F.lit(float(lng)), F.col("lat"), F.col("lng"))
    return points.filter(band).withColumn("distance_km", d).filter(F.col("distance_km") <= radius)


def in_box(points: DataFrame, lat_min: float, lng_min: float, lat_max: float, lng_max: float) -> DataFrame:
    """Rows inside a box, edges included, with their distance from its centre."""
    if lat_min > lat_max or lng_min > lng_max:
        raise ValueError("the box is empty")
    d = distance_km(F.lit((lat_min + lat_max) / 2), F.lit((lng_min + lng_max) / 2), F.col("lat"), F.col("lng"))
    return points.filter(F.col("lat").between(lat_min, lat_max) & F.col("lng").between(lng_min, lng_max)).withColumn("distance_km", d)


def json_path(column: Column, path: str) -> Column:
    """The value at a dotted path as text; a number steps into an array."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.get_json_object(column, "$" + steps)


def json_equals(df: DataFrame, column: str, path: str, value: str) -> DataFrame:
    return df.filter(json_path(F.col(column), path) == value)


def json_between(df: DataFrame, column: str, path: str, low: float, high: float, whole: bool = False) -> DataFrame:
    """Rows whose number at the path is in [low, high]; whole cuts it to an integer first."""
    v = json_path(F.col(column), path).try_cast("double")
    return df.filter((F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)) if whole else v).between(low, high))


OPERATORS = ("eq", "ne", "gt", "ge", "lt", "le", "contains", "prefix")


def payload(df: DataFrame, conditions: Sequence[tuple[str, str, object]], limit: int | None = None) -> DataFrame:
    """Rows that meet all typed conditions (column, operator, value); contains and prefix take strings only."""
    for name, op, value in conditions:
        c = F.col(name)
        if op in ("contains", "prefix"):
            if dict(df.dtypes)[name] != "string":
                raise TypeError(f"{op} needs a string column")
            df = df.filter(F.contains(c, F.lit(value)) if op == "contains" else c.startswith(value))
        else:
            df = df.filter({"eq": c == value, "ne": c != value, "gt": c > value, "ge": c >= value, "lt": c < value, "le": c <= value}[op])
    return df.limit(limit) if limit else df


def typed_equal(a: Column, b: Column, epsilon: float = 1e-10) -> Column:
    return F.abs(a.cast("double") - b.cast("double")) < epsilon
