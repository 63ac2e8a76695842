"""From raw documents to packed token sequences: five stages, each one of the operators, each on all that the one before kept.

quality rules: documents that fail the base rules or a certified cutoff go. line dedup: boilerplate lines of many sites go. near copies: of each
group one document stays. personal data: entities are replaced by surrogates. packing: documents become token pieces in sequences.

Null and empty texts have no words and go in the first stage; so do very short ones. Very long texts are treated like others. Rows that repeat an id and a text
are exact copies, of which one stays; rows that share an id but not a text are documents of their own; a null id is kept as it is and counts as no one's smallest.
Of a group of near copies the smallest id stays (ties: the smallest hash of the text), and a row without an id only if none of the group has one. An empty table gives an empty result, and no labels certify no
cutoff. Further columns, whatever their names, are carried up to packing, which returns its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.llm.line_dedup import without_shared_lines
from ampliq.llm.packing import VOCABULARY, packed
from ampliq.llm.pii import pseudonymised
from ampliq.llm.quality import accepted
from ampliq.llm.shared import scratch, set_aside, shared_folder, table, tokenizer_path
from ampliq.llm.simhash import one_of_each


def _with_chars(changed: DataFrame, docs: DataFrame, called: dict[str, str]) -> DataFrame:
    """The columns of ``docs``, some of which are called otherwise in ``changed``, with n_chars as the text now is."""
    chars = F.coalesce(F.length("text"), F.lit(0))
    return changed.select(*[chars.cast(t).alias(c) if c == "n_chars" else F.col(called.get(c, c)).alias(c) for c, t in docs.dtypes])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apart, called = set_aside(docs, "n_lines", "n_removed")
    return _with_chars(without_shared_lines(apart), docs, called)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apart, called = set_aside(docs, "n_entities")
    return _with_chars(pseudonymised(apart), docs, called)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, tokenizer_path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: No SQL: binomial tests, SimHash and the packing program are beyond it. tests/llm/test_pipeline.py holds run() against plain loops over the documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/ampliq-stages/{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
