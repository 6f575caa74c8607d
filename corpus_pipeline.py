"""The corpus pipeline: five stages, each a call of one training-data operator.

Each stage takes all its predecessor kept and returns the columns of
``documents``; the last returns packed sequences. ``run`` writes every
stage's result as Parquet into a run folder and reads it back for the next.

Stages that filter decide per row, so repeated rows, null ids and clashing
column names pass through, except that the near-duplicate stage keeps one row
of each group (rows with a null doc_id have no group and stay). An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import decontaminate, language_id, near_dups, packing, queries, secret_scan
from fleetscope.llm.common import free_name, prepare, read
from fleetscope.workspace import Workspace

# A confident or plausible language stays; under this score no language is
# much likelier than the others.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language: no letters, or no
    language with a score of ``MIN_LANGUAGE_SCORE``. Learns from the labelled
    documents outside the held-out fold; without any, only null texts and
    texts without a letter go."""
    prepare(spark)
    model = language_id.train(docs.where(language_id.fold(F.col("doc_id"), 4) != 2))
    if not model.languages:  # nothing to tell languages by
        return docs.where(language_id.letters(F.col("text")))
    name = free_name(docs, "_language")
    found = docs.withColumn(name, language_id.predict(F.col("text"), model, spark))
    kept = (F.col(name)["lang"] != language_id.UNKNOWN) & (F.col(name)["score"] >= MIN_LANGUAGE_SCORE)
    return found.where(kept).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of every SimHash component
    (4-word shingles, 4 bits). A repeated doc_id is a row of the component of
    each of its texts, so each text that is no near-duplicate stays."""
    prepare(spark)
    kept = near_dups.keepers(docs, Workspace(spark, "pipeline-near-dups"))
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget."""
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"), Workspace(spark, "pipeline-decontamination"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets found by the ledger scan; the document stays."""
    prepare(spark)
    run = Workspace(spark, "pipeline-secrets")
    ledger = run.table(secret_scan.scan(docs), "ledger")
    return secret_scan.masked(docs, secret_scan.findings(ledger))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the kept documents in sequences of 2048."""
    prepare(spark)
    return packing.pack(docs, Workspace(spark, "pipeline-packing"), queries.word_tokens)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dups", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_documents),
]

# Language ID, near-duplicates and packing have no SQL; the tests hold the
# pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents`` after all stages."""
    docs = read(spark, sf_dir, "documents")
    folder = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = folder.table(stage(spark, docs, sf_dir), name)
    return docs
