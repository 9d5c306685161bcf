"""Training-corpus pipeline: quality, line dedup, near-dedup, decontamination, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``, so a lost executor costs
a re-read of one stage.  All stages but the last return the columns of
``documents``.

* quality_rules: drops the documents that fail the base rules or are depleted,
  and takes the frequent lines out of the others;
* line_dedup: drops lines that at least ten documents hold; documents stay, also
  when nothing is left of them;
* near_dedup: of each group of SimHash near-duplicates the smallest doc_id stays
  (three-word shingles, at most two differing bits); rows of one id and texts of
  different groups are told apart;
* decontamination: drops documents that hold a test item;
* token_ids: doc_id, n_tokens, ids, decoded.

Nulls, empty and very long texts, repeated rows, ties, empty tables and extra
columns are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailfold.llm import bpe, decontaminate, line_dedup, quality, simhash
from mailfold.llm.common import materialise
from mailfold.llm.registry import tokenizer_spec
from mailfold.sources.tables import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(docs, min_docs=10, min_length=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_representatives(docs, shingle=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_spec())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: Token ids cannot be made in SQL; tests/llm compares the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
