"""The SQL dialect: SELECT with an ANN clause, DELETE and UPDATE over a table (id, embedding, metadata).

SELECT (COUNT(*) | * | col, ...) FROM t [ANN(query=[...][, k=N][, metric=cosine|euclidean|dot])]
  [WHERE condition] [ORDER BY field [ASC|DESC]] [LIMIT n] [;]
DELETE FROM t WHERE condition;  UPDATE t SET f = v, ... WHERE condition
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.predicate import Reader, condition, from_map, lex, number, reader_end
from skein.operators.knn import with_distance

OVERSAMPLE = 4


@dataclass
class Statement:
    kind: str
    table: str = ""
    columns: list[str] = field(default_factory=list)
    count: bool = False
    query: list[float] | None = None
    k: int = 10
    metric: str = "cosine"
    where: Column | None = None
    where_text: str = ""
    order: str = ""
    descending: bool = False
    limit: int | None = None
    changes: dict[str, str] = field(default_factory=dict)


def _ann(r: Reader, s: Statement) -> None:
    r.take("mark", "(")
    s.query = []
    while True:
        name = r.take("word").lower()
        r.take("op", "=")
        if name == "query":
            r.take("mark", "[")
            while not r.accept("]"):
                s.query.append(float(r.take("number")))
                r.accept(",")
        elif name == "k":
            s.k = int(r.take("number"))
        elif name == "metric":
            s.metric = r.take().lower()
        else:
            raise ValueError(f"unknown ANN parameter {name!r}")
        if not r.accept(","):
            break
    r.take("mark", ")")
    if not s.query or s.k <= 0 or s.metric not in ("cosine", "euclidean", "dot"):
        raise ValueError("ANN needs a query, k above 0 and a metric: cosine, euclidean or dot")


def parse(text: str) -> Statement:
    r = Reader(lex(text))
    verb = r.word()
    if verb not in ("SELECT", "DELETE", "UPDATE"):
        raise ValueError("expected SELECT, DELETE or UPDATE")
    r.take()
    s = Statement(verb.lower())
    if verb == "SELECT":
        if r.word() == "COUNT":
            r.take()
            for mark in "(*)":
                r.take("mark", mark)
            s.count = True
        elif r.accept("*"):
            s.columns = ["*"]
        else:
            s.columns = [r.take("word")]
            while r.accept(","):
                s.columns.append(r.take("word"))
        r.take("word", "FROM")
        s.table = r.take("word")
        if r.accept("ANN"):
            _ann(r, s)
    elif verb == "DELETE":
        r.take("word", "FROM")
        s.table = r.take("word")
    else:
        s.table = r.take("word")
        r.take("word", "SET")
        while True:
            name = r.take("word")
            r.take("op", "=")
            s.changes[name] = r.take()
            if not r.accept(","):
                break
    if r.accept("WHERE"):
        start = r.at
        s.where = condition(r, from_map(), "sql")
        s.where_text = " ".join(v for _, v in r.items[start : r.at])
    elif verb != "SELECT":
        raise ValueError(f"{verb} needs a WHERE")
    if verb == "SELECT" and r.accept("ORDER"):
        r.take("word", "BY")
        s.order = r.take("word")
        if r.accept("("):
            while not r.accept(")"):
                r.take()
        s.descending = r.accept("DESC")
        if not s.descending:
            r.accept("ASC")
    if verb == "SELECT" and r.accept("LIMIT"):
        s.limit = int(r.take("number"))
    r.accept(";")
    reader_end(r)
    return s


def execute(tables: Mapping[str, DataFrame], text: str, mode: str = "exact") -> DataFrame:
    """Rows of a SELECT; for DELETE and UPDATE one row with the count (see deleted and updated for the new table).

    mode exact filters before it ranks; postfilter ranks k * 4 rows first. A column that a row lacks is ''.
    """
    s = parse(text)
    df = tables[s.table]
    if s.kind != "select":
        return df.filter(s.where).agg(F.count(F.lit(1)).alias("deleted_count" if s.kind == "delete" else "updated_count"))
    if s.count:  # counts all matching rows, whatever ANN says
        return (df.filter(s.where) if s.where is not None else df).agg(F.count(F.lit(1)).alias("count"))
    keep, distances = df, s.query is not None
    if distances:
        if s.where is not None and mode == "exact":
            keep = keep.filter(s.where)
        keep = with_distance(keep, s.query, s.metric).orderBy("distance", "id").limit(s.k * OVERSAMPLE if s.where is not None and mode != "exact" else s.k)
        if s.where is not None and mode != "exact":
            keep = keep.filter(s.where).orderBy("distance", "id").limit(s.k)
    elif s.where is not None:
        keep = keep.filter(s.where)
    if s.order:
        if s.order.lower() in ("distance", "vector_distance") and distances:
            keys = [F.col("distance")]
        elif s.order == "index":
            keys = [F.col("id")]
        else:
            value = F.coalesce(F.col("metadata")[s.order], F.lit(""))
            keys = [number(value), value]
        keep = keep.orderBy(*((c.desc() if s.descending else c.asc()) for c in keys), "id")
    elif s.limit is not None and not distances:
        keep = keep.orderBy("id")
    if s.limit is not None:
        keep = keep.limit(s.limit)
    names = s.columns if s.columns != ["*"] else ["index", *(["distance"] if distances else []), "metadata"]
    special = {"index": F.col("id"), "metadata": F.to_json("metadata"), "distance": F.col("distance") if distances else F.lit("")}
    return keep.select(*((special[n] if n in special else F.coalesce(F.col("metadata")[n], F.lit(""))).alias(n) for n in names))


def deleted(table: DataFrame, text: str) -> DataFrame:
    return table.filter(~parse(text).where)


def updated(table: DataFrame, text: str) -> DataFrame:
    s = parse(text)
    return table.withColumn("metadata", F.when(s.where, merged(F.col("metadata"), s.changes)).otherwise(F.col("metadata")))


def merged(metadata: Column, changes: Mapping[str, str]) -> Column:
    """A map with keys set; other keys stay."""
    old = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*changes))
    return F.map_concat(old, F.create_map(*(F.lit(x) for kv in changes.items() for x in kv)))


def explain(text: str) -> str:
    s = parse(text)
    strategy = "ann" if s.query is not None and not s.count else "scan"
    lines = [f"statement: {s.kind}", f"table: {s.table}", f"strategy: {strategy}"]
    if strategy == "ann":
        lines += [f"metric: {s.metric}", f"k: {s.k}"]
    if s.where is not None:
        lines.append(f"filter: {s.where_text}" + (f" (before ranking; postfilter mode oversamples {OVERSAMPLE}x)" if strategy == "ann" else ""))
    if s.order:
        lines.append(f"order: {s.order} {'desc' if s.descending else 'asc'}")
    if s.limit is not None:
        lines.append(f"limit: {s.limit}")
    return "\n".join(lines)
