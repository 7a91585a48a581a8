"""A corpus pipeline of five stages: toxicity, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of
`documents`, and works on all that the stage before kept. All stages but the
last return the columns of `documents`. Between stages the rows are written as
Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import best_fit_packing, budget_mix, crf_toxicity, dart_minhash, suffix_dedup
from weft.session import materialise


def _settings(spark: SparkSession) -> None:
    """What this application asks of its session: Python workers get at most 4 MB at once, however long the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger doesn't reject: a score below 0.3. Rows with a null text stay."""
    _settings(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return crf_toxicity.drop_toxic(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    _settings(spark)
    return dart_minhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of 100-byte strings that start earlier; n_chars is counted again."""
    _settings(spark)
    return suffix_dedup.apply_removal(docs, slice_bytes=2 << 20, hot=20_000, together=8_000).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the 3:1:2 mix of 150 % of all words takes it."""
    _settings(spark)
    return budget_mix.apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 ids."""
    _settings(spark)
    return best_fit_packing.pack_documents(docs, with_ids=False).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: No SQL: a trained field, hashed candidates and a packing plan aren't expressible. Tests of the operators hold each against brute force or definitions, those of the pipeline its columns, counts and subsets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
