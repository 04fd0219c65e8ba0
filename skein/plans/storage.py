"""Intermediate tables that every executor can read again after a loss."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_folder: dict[str, str] = {}
_settled: list[str] = []
_collecting: ContextVar[tuple[list[str], ...]] = ContextVar("collecting", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a single machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        path = spark._jvm.org.apache.hadoop.fs.Path(named.rstrip("/"))
        whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return re.sub(r"^file:/(?!/)", "file:///", whole)  # a scheme, so that Spark and Python workers mean the same folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _local_folder:
        _local_folder["dir"] = "file://" + tempfile.mkdtemp(prefix="skein-")
    return _local_folder["dir"]


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/skein/{label}-{uuid.uuid4().hex}"
    _settled.append(path)
    for made in _collecting.get():
        made.append(path)
    return path


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that are settled inside the block, and of no others: its owner may remove_all() them."""
    made: list[str] = []
    token = _collecting.set((*_collecting.get(), made))
    try:
        yield made
    finally:
        _collecting.reset(token)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._skein_path = path  # type: ignore[attr-defined]
    return back


def drop(*tables: DataFrame | None) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_skein_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _settled:
        _settled.remove(path)


def remove_all(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables, as collected() lists them, once nothing reads them any more."""
    for path in list(paths):
        if path in _settled:
            remove(spark, path)


@atexit.register
def _at_exit() -> None:
    """Delete what is left when the process ends: a result's own tables live as long as it may be read."""
    spark = SparkSession.getActiveSession()
    for path in list(_settled):
        if path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        elif spark is not None:
            try:
                remove(spark, path)
            except Exception:  # noqa: BLE001 - the session may be gone already
                return
