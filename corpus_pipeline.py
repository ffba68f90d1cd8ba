"""From raw documents to packed training sequences: five stages on the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast.llm.decontaminate import LEAST_WORDS, decontaminate
from wearcast.llm.jaccard_join import one_per_group
from wearcast.llm.line_dedup import dedup_lines
from wearcast.llm.packing import pack_documents
from wearcast.llm.quality_rules import keep_good
from wearcast.llm.store import written
from wearcast.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that another document keeps; ``n_chars`` follows where the text changed."""
    cut = dedup_lines(docs)
    columns = []
    for c in docs.columns:
        column = F.col("row").getField(c)
        if c == "text":
            column = F.col("kept")
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            column = F.when(F.col("n_dropped") == 0, column).otherwise(F.length("kept").cast(kind))
        columns.append(column.alias(c))
    return cut.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; an item of one or two words removes none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_words=LEAST_WORDS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark),
    ("best_fit_packing", pack),
]

#: No SQL expresses suffix arrays or tokenizers; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
