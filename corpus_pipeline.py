"""A corpus pipeline: language, quality, near-duplicates, personal data, packing.

Defined results of all stages: an empty table gives an empty one; columns beyond those of ``documents`` stay, also
where their names clash with the operators' own; repeated rows and rows without an id are rows like others.

* language: null and empty texts, unfamiliar ones and those in other languages than ``LANGUAGES`` go;
* quality rules: a row goes that any rule rejects;
* near-duplicates: of texts that are equal, within two bits of each other's fingerprints, or similar at 0.8 on
  five-word shingles, also by way of others, the row of the smallest id stays (rows without an id last, ties by
  the rows' hash);
* personal data: texts change where they hold spans, null texts stay null;
* packing: one row per piece, with its ids; a null text is the end id alone.

A stage deletes what earlier ones have left in the shared folder, so its input must have been written.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomfield.llm import langid, packing, pii, quality, simhash
from loomfield.llm.common import keep, owner, release

LANGUAGES = ("de", "en", "es", "fr")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidy(stage: Stage) -> Stage:
    """``stage``, before which the tables of earlier ones are deleted."""

    @functools.wraps(stage)
    def run_alone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, __name__, docs)
        with owner(__name__):
            return stage(spark, docs, sf_dir)

    return run_alone


@tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.filter_documents(docs, wanted=LANGUAGES)


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, similar=True)


@tidy
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", pack),
]

#: The text model, the disclosure thresholds and the packing aren't SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        with owner(__name__):
            docs = keep(docs, name.replace(" ", "-"))
    return docs
