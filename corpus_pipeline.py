"""Training-corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. language ID: documents whose language is ambiguous or unknown go
2. line dedup: later copies of repeated line runs are deleted from the texts
3. n-gram Jaccard join: one document of each group of near duplicates stays, the one of the least doc_id
4. benchmark decontamination: documents that hold a benchmark item go
5. source mixing: the rest is packed into blocks and drawn to target weights

All stages but the last return the columns of documents. SQL cannot express the stages (trained
classifier, SimHash, Feistel permutations), so ORACLE_SQL is None; tests run the stages on planted cases, and hold the operators of stages 3, 4 and 5
against brute-force versions.

Defined cases: documents with null, empty or letterless text go at stage 1; a null doc_id or source passes all filters (mixing calls such a source '(none)'); rows that
repeat a doc_id stay or go together at stages 3 and 4; very long texts are read whole; of equal texts the one of the least doc_id stays; an empty table gives no
blocks; extra columns, whatever their names, pass stages 1 to 4 unchanged and end there.

Every stage bounds the bytes of an Arrow batch by a setting of the session, which stays after it; a limit that the session has already is kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import load, small_batches, stage
from palimpsest.llm.decontaminate import decontaminated
from palimpsest.llm.jaccard import one_of_each_group
from palimpsest.llm.langid import identified_only, train
from palimpsest.llm.lines import line_dedup
from palimpsest.llm.mixing import mix_sources

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(apply: Stage) -> Stage:
    """The stage, with small Arrow batches: one executor serves all stages, and what each leaves outside the heap adds up."""

    @wraps(apply)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return apply(spark, docs, sf_dir)

    return run


@bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified_only(docs, train(docs))


@bounded
def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs)


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


@bounded
def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, load(spark, sf_dir, "benchmark"))


@bounded
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", repeated_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_items),
    ("source_mixing", source_mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
