"""The registered queries: each module has QUERIES, name -> (function of (spark, sf_dir), SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def catalog() -> dict[str, Query]:
    from skein.queries import graphs, more, predicates, ranking, search, stores, tables, text, vectors

    found: dict[str, Query] = {}
    for module in (search, predicates, ranking, text, graphs, tables, vectors, more, stores):
        found |= module.QUERIES
    return found
