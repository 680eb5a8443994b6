"""The queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.chunks import repeated_spans
from corpusmill.llm.common import table
from corpusmill.llm.decontamination import contamination
from corpusmill.llm.divergence import source_divergence
from corpusmill.llm.licenses import license_scan
from corpusmill.llm.lines import line_dedup
from corpusmill.llm.mixing import mix
from corpusmill.llm.packing import pack
from corpusmill.llm.periodic import periodic_runs
from corpusmill.llm.perplexity import quality
from corpusmill.llm.pii import replace_pii
from corpusmill.llm.repetition import repetition_rules
from corpusmill.llm.simhash import fingerprint_hex, simhash_components
from corpusmill.llm.urls import judge_urls, path_of


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted: documents labelled as of good quality and not toxic."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality(table(spark, sf_dir, "documents"), trusted)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is that of the synthetic tables; real ones come from a secret store."""
    return replace_pii(table(spark, sf_dir, "documents"), key="synthetic")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; theirs are source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    return license_scan(docs.select("doc_id", F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "text"))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by the document that the number in their path names: bad if of low quality or toxic."""
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]+)", 1).try_cast("long")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", number.alias("number"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.join(labels, F.col("number") == F.col("doc_id"), "left").select("page_id", "url", "bad")
    return judge_urls(labelled).drop("bad_share")


def op5_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its chunks, those that are repeats or shared, bytes of passages to remove, whether it shares a passage, and with which first documents."""
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_chunks", "n_bytes", "n_repeats", "n_shared", removed.alias("removed_bytes"), (F.size("shared_spans") > 0).alias("has_passage"), "repeats_of")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, and the SHA-256 of the text that is left."""
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def op10_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def planted_period(doc_id: Column, text: Column) -> Column:
    """The text, in a tenth of the documents with their words from some place on replaced by a stretch of them over and over."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    spaced = F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")

    def periodic(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # a lambda's argument is evaluated once
    planted = F.get(F.transform(F.array(spaced), lambda words: F.when(F.size(words) > 0, periodic(words))), F.lit(0))
    return F.when(h % 10 == 0, planted).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted_period(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_license_scan": op3_license_scan,
    "op4_url_templates": op4_url_templates,
    "op5_benchmark_index": op5_benchmark_index,
    "op6_chunk_dedup": op6_chunk_dedup,
    "op7_simhash": op7_simhash,
    "op8_line_spread": op8_line_spread,
    "op9_repetition_rules": op9_repetition_rules,
    "op10_source_schedule": op10_source_schedule,
    "op11_source_divergence": op11_source_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_bounded_packing": op13_bounded_packing,
}
