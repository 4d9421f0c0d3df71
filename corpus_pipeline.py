"""A corpus pipeline over ``documents``: five stages, each one operator on all that its predecessor kept.

Stages are written as Parquet to the session's shared folder and read again, so a lost executor costs a
stage's tasks only. All but the last stage return the columns of ``documents``, and of any others that its
input has, whatever their names.

Defined cases, by stage: null and blank texts go at the first; repeated rows are judged alike by the first two, and
one of them is left by the third; rows without a doc_id count as later than all others; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jsonweave.llm.common import release, stash, table
from jsonweave.llm.langid import language_filter
from jsonweave.llm.ngram_join import drop_near_duplicates
from jsonweave.llm.packing import pack
from jsonweave.llm.quality import quality_filter
from jsonweave.llm.substring import remove_repeats


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return language_filter(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules stay."""
    return quality_filter(docs)


def near_duplicates_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least doc_id stays (nulls last; of equal ids the one read
    first). Rows are judged as rows: different texts under one doc_id stay both."""
    return drop_near_duplicates(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document go; documents of which nothing is left go."""
    return remove_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining texts as token pieces packed into sequences of 1024."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2, plain=False)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard_join", near_duplicates_once),
    ("substring_dedup", remove_repeated_passages),
    ("best_fit_packing", pack_sequences),
]

#: Language scores are sums of learned logarithms over words and n-grams: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
