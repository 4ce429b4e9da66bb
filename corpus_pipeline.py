"""A training corpus out of raw documents: quality, near copies, benchmark passages, personal data, pieces.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows it gets and returns a DataFrame; all but the
last return the columns of documents.  ``run`` writes each stage's rows to the shared folder and reads them again for
the next one, so a lost executor costs a task and not the stages before it.

No SQL expresses these stages; tests compare them with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import decontaminate, near_copies, pieces, pii, quality
from cutline.llm.common import stored, table

ORACLE_SQL = None
#: Bytes of the Arrow batches that Python tasks get.
BATCH_BYTES = 8 << 20


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the additive quality model scores at least 0.5."""
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the one with the smallest id."""
    return near_copies.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth of the words are benchmark passages, without these passages."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` counts the new text."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_best`` of every document."""
    return pieces.encoded(docs)


STAGES = [
    ("quality", good_documents),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", BATCH_BYTES)
    return docs
