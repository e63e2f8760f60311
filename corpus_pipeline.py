"""Cleaning a corpus in stages, each written as Parquet and read again as the next one's documents.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; the last returns what the mix takes of every document. Each stage works on
everything its predecessor kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from cityloom.llm import jaccard_join, line_rules, mixture, secret_scan, winnowing
from cityloom.operators import scale
from cityloom.operators.scale import materialise

#: Intermediate folders of the stages that ran, by application.
LEFT: dict[str, list[str]] = {}


def stage(run):
    """A stage's intermediate folders are deleted when the next one begins on its written output."""

    @functools.wraps(run)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = LEFT.setdefault(spark.sparkContext.applicationId, [])
        read = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in docs.inputFiles()}
        done = [p for p in left if p.split(":", 1)[-1].lstrip("/") not in read]
        scale.discard(spark, done)
        before = set(scale.WRITTEN)
        out = run(spark, docs, sf_dir)
        left[:] = [p for p in left if p not in done] + [p for p in scale.WRITTEN if p not in before]
        return out

    return wrapped


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents; lines above the limits leave the others."""
    return line_rules.kept_documents(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group stays, the one with the smallest id."""
    return jaccard_join.one_of_each_group(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return winnowing.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return secret_scan.redacted(docs)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixture.taken_words(docs)


STAGES = [("quality_rules", quality_rules), ("near_copies", near_copies), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: Hashed, looped and tested stages: SQL does not express them; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
