"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Rejected by the quality rules: documents go. Jaccard join: the smallest doc_id of each linked group
stays. Decontamination: documents with a benchmark passage go. Mixing: documents stay as often as the
mix takes them (0, 1 or 2 times). Sharding, the last stage, returns each row's shard and slot.

Defined results, of all stages together: null and empty texts fail the quality rules and go; a null id, language
or source is kept as it is (a null source is a source of its own, a null id the last to stay of linked rows);
rows of one id with different texts are judged each by its own text; of equal rows one stays; very long texts are judged, joined, searched and counted whole; ties go to the
smallest id; an empty corpus stays empty; extra columns, whatever their names, pass through until the
last stage, which returns its own.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import _common, decontam, jaccard, mixing, quality, sharding

SHARDS = 8
#: Tables that the operators of the last stage staged.
_left: list[str] = []


def _stage(f: Callable[..., DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage's result is written before the next stage is called, so what its operators staged goes then."""

    @functools.wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _common.release(spark, _left)
        before = len(_common.made)
        out = f(spark, docs, sf_dir)
        _left[:] = _common.made[before:]
        return out

    return call


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@_stage
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies here are word shingles of five with a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs, n=5, percent=80)


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, _common.table(spark, sf_dir, "benchmark"))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


@_stage
def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Fingerprints, sampling keys and shards of SQL and Spark would have to agree; tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = _common.Staged(stage(spark, docs, sf_dir), name)
        if before:
            before.drop()
        docs, before = out.df, out
    return docs
