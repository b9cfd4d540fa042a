"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept; between stages the documents are a
Parquet table in the shared folder. Toxic documents go, one of each class of near-duplicates
stays, documents with a benchmark item go, secrets are replaced by a mark, and the rest is packed
into the sequences of token ids that a model is trained on.

Documents with a null or empty text are clean: they are alone in their class, hold no item and no secret, and are
packed as the end token. A null doc_id stays null, texts of any length are read whole, repeated rows are near-duplicates
of each other, further columns (whatever their names) go with their rows up to the last stage, and an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alphaloom.llm.common import discard, table, written
from alphaloom.llm.decontaminate import without_leaks
from alphaloom.llm.near_duplicates import one_of_each
from alphaloom.llm.packing import pack
from alphaloom.llm.secrets import fit_net, without_secrets
from alphaloom.llm.toxicity import fit_chain, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain, fitted on the labelled ones, finds toxic."""
    return without_toxic(docs, fit_chain(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return without_secrets(docs, fit_net(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document: its token ids and their place in a sequence of 2048 tokens."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", packing),
]
#: Fitted models, sketches and token ids have no SQL: tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to all documents; one row a piece of what is kept."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            # nothing reads it again
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
