"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents.
Rows with a null doc_id pass the near-dup stage, and rows that share a doc_id
are documents of their own there if their texts differ, else copies. Empty
tables, null and empty texts, very long ones and ties are fine anywhere: texts
without enough words fail the quality rules, of equal documents the one of the
least id stays, and equal rows are mixed alike. Columns beside those of documents
aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import dropped, scratch, table, written
from corpusmill.llm.decontamination import contamination
from corpusmill.llm.lines import line_dedup
from corpusmill.llm.mixing import mix
from corpusmill.llm.repetition import repetition_filter
from corpusmill.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the suffix-array rules keep."""
    return repetition_filter(docs.select(*COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the boilerplate lines of others."""
    return line_dedup(docs.select(*COLUMNS)).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates (five-word shingles, a similarity of 0.8 or more)."""
    first = near_duplicates(docs).where("stays").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("hash"))
    order = W.partitionBy("doc_id", "hash").orderBy(*COLUMNS[1:])
    kept = hashed.join(first, (F.col("doc_id") == F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi").withColumn("copy", F.row_number().over(order)).where("copy = 1")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of benchmark words."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    leaks = found.select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.xxhash64("text") == F.col("leak_hash"))
    return docs.select(*COLUMNS).join(leaks, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: (doc_id, source, size, source_size, target, taken)."""
    return mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]

#: Min-hash blocks and wide fingerprints have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written on its way goes when its result is there, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{k}", stays=True)
        if before is not None:
            dropped(before)
        before = docs
    return docs
