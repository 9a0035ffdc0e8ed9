"""A training corpus from ``documents``: five stages, each over all that its predecessor kept.

1. toxicity         documents that the ordinal model rejects go
2. line dedup       repeated lines go; a document may be left with an empty text
3. Jaccard join     of each group of near copies (five-word shingles, 0.8) the least id stays
4. decontamination  documents that hold a passage like a benchmark item go
5. packing          the pieces of what is left, placed in sequences

Every stage but the last returns the columns of its input; null texts count as
empty, repeated rows are rows of their own, and empty tables give empty tables.

Python workers outlive their stage and keep what memory its largest batch took,
so a stage bounds the rows of an Arrow batch by ``BATCH``.  Stages are lazy and
Spark reads that setting when the caller writes, so it stays set in the session
(unless it was lower); ``run`` writes all stages itself and puts it back.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, arrow_rows, held
from isoweave.llm.decontaminate import decontaminate
from isoweave.llm.jaccard_join import keep_first
from isoweave.llm.line_dedup import dedup_lines
from isoweave.llm.packing import pack
from isoweave.llm.toxicity import fit_toxicity, score_toxicity

#: Texts in an Arrow batch (Spark's default: 10,000).
BATCH = 1000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage, over batches of ``BATCH`` rows at most."""

    @functools.wraps(stage)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, rows in arrow_rows(BATCH).items():
            if not 0 < int(spark.conf.get(key)) <= BATCH:  # 0 or less: no bound
                spark.conf.set(key, rows)
        return stage(spark, docs, sf_dir)

    return run_bounded


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@bounded
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct("*").alias("__row"), "text")
    return score_toxicity(whole, model).filter("not rejected").select("__row.*")


@bounded
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


@bounded
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs, width=5, percent=80)


@bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


@bounded
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't fit the toxicity model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    with held(spark, {k: spark.conf.get(k) for k in arrow_rows(BATCH)}):  # stages lower it
        for k, (name, stage) in enumerate(STAGES):
            docs = work.save(stage(spark, docs, sf_dir), name)
            if k:
                work.drop(STAGES[k - 1][0])
    return docs
