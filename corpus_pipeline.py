"""From raw documents to packed training sequences, as stages that each read the last one's written rows.

STAGES holds (name, function of (spark, docs, sf_dir)). A stage deletes the intermediate tables of the one
before it over the same folder, whose output is written by then; no other table is touched. All but the last
stage return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import line_dedup, mixing, near_copies, packing, toxicity
from skein.plans.storage import collected, remove, remove_all, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: (stage, folder) -> the intermediate tables behind the frame that the stage last gave for the folder.
_made: dict[tuple[int, str], list[str]] = {}


def _stage(number: int) -> Callable[[Stage], Stage]:
    def decorate(build: Stage) -> Stage:
        @functools.wraps(build)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            remove_all(spark, _made.pop((number - 1, sf_dir), ()))
            with collected() as made:
                result = build(spark, docs, sf_dir)
            _made[number, sf_dir] = made
            return result

        return stage

    return decorate


@_stage(0)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the model learns from the labels table."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_stage(1)
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines; n_chars follows the text. A document left empty keeps its row."""
    counts = ("_sk_lines", "_sk_dropped")
    while {c.lower() for c in docs.columns} & set(counts):
        counts = tuple(f"{c}_" for c in counts)
    found = line_dedup.drop_recurring_lines(docs, *counts)
    size = F.when(F.col(counts[1]) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return found.select(*(size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


@_stage(2)
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of least doc_id, of each group of near copies: found by SimHash, verified by the Jaccard similarity of five-word shingles (0.8), completed by it."""
    return near_copies.drop_copies(docs, shingle=5)


@_stage(3)
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated, or left out, as the mix of sources takes them."""
    return mixing.repeat(docs)


@_stage(4)
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; see packing.pack_documents."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_related", pack),
]

#: SQL has no way to say the scores, fingerprints and token ids; tests/llm compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs, folder, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    with collected() as made:
        for k, (_, stage) in enumerate(STAGES):
            path = f"{folder}/{k}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    remove_all(spark, made)
    return docs
