"""Expectations over corpora and records: all violations at once, not the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import question_marks, strings
from corpusmill.operators.compare import underrepresented
from corpusmill.operators.dedup import crossing_keys
from corpusmill.plans.catalog import REQUIRED, SLOTS
from corpusmill.plans.corpus import CATEGORIES, PATTERNS


def expectations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, violations): how many rows fail each check, in one pass; null fails."""
    failing = [F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]
    return rows.agg(*failing).unpivot([], list(checks), "name", "violations")


def counted(df: DataFrame, name: str, n: int) -> DataFrame:
    """One row: how far the number of rows is from n."""
    return df.agg(F.lit(name).alias("name"), F.abs(F.count("*") - n).alias("violations"))


def none_of(df: DataFrame, name: str) -> DataFrame:
    """One row: the number of rows, none expected."""
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("violations"))


def miscounted(df: DataFrame, column: str, wanted: dict[str, int]) -> DataFrame:
    """One row: by how many rows the counts of a column's values miss those wanted, values that aren't wanted included."""
    expected = df.sparkSession.createDataFrame(list(wanted.items()), "value string, wanted long")
    counts = df.groupBy(F.col(column).alias("found")).agg(F.count("*").alias("n"))
    both = expected.join(counts, F.col("value") == F.col("found"), "full")
    off = F.abs(F.coalesce("wanted", F.lit(0)) - F.coalesce("n", F.lit(0)))
    return both.agg(F.lit(f"{column} counts").alias("name"), F.coalesce(F.sum(off), F.lit(0)).cast("long").alias("violations"))


def validate_corpus(corpus: DataFrame, size: int, counts: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(name, violations) for a scenario corpus: 0 everywhere in a valid one. counts: wanted numbers of rows by column and value, such as category and split."""
    known = strings([s[0] for s in SLOTS])
    inside = lambda xs: F.size(F.array_except(xs, known)) == 0
    asks = F.col("ideal_question")
    grounded = F.forall("turns", lambda t: F.forall(t["gold_extraction"]["updates"], lambda u: F.contains(t["message"], u["evidence_text"])))
    rows = expectations(
        corpus,
        {
            "known gold slots": inside(F.map_keys("gold_final_slots")),
            "known forbidden slots": inside(F.col("must_not_infer")),
            "known question slot": F.col("expected_question_slot").isNull() | F.array_contains(known, F.col("expected_question_slot")),
            "one question mark": asks.isNull() | (question_marks(asks) == 1),
            "grounded evidence": grounded,
        },
    )
    unique = none_of(corpus.groupBy("scenario_id").count().where("count > 1"), "unique ids")
    by = [miscounted(corpus, column, wanted) for column, wanted in (counts or {}).items()]
    return reduce(DataFrame.unionByName, [rows, counted(corpus, "size", size), unique, none_of(crossing_keys(corpus, "domain"), "disjoint domains"), *by])


def validate_conversational(corpus: DataFrame, domains: int = 20, splits: dict[str, int] | None = None) -> DataFrame:
    """As validate_corpus for the corpus with conversational scenarios: each category of each domain once, each pattern of each domain as well, and splits by domain; and the expectations that only conversational scenarios have."""
    by_split = splits or {"train": 14, "validation": 3, "test": 3}
    each = len(CATEGORIES) + len(PATTERNS)
    categories = dict.fromkeys(CATEGORIES, domains) | {"conversational_intent": domains * len(PATTERNS)}
    base = validate_corpus(corpus, domains * each, {"category": categories, "split": {s: n * each for s, n in by_split.items()}})
    talks = F.col("category") == "conversational_intent"
    stated = F.transform(F.element_at("turns", -1)["gold_extraction"]["updates"], lambda u: u["slot_id"])
    return base.unionByName(
        expectations(
            corpus,
            {
                "conversational tag": ~talks | F.array_contains("behavior_tags", "conversational_intent"),
                "final slots are stated": ~talks | (F.size(F.array_except(F.map_keys("gold_final_slots"), stated)) == 0),
                "asks what is missing": ~talks | F.col("expected_question_slot").isNull() | ~F.array_contains(stated, F.col("expected_question_slot")),
            },
        )
    )


def validate_records(records: DataFrame) -> DataFrame:
    """(name, violations) for prompt/completion records."""
    user, answer = F.col("prompt")[1]["content"], F.col("completion")[0]["content"]
    updates = F.from_json(answer, "updates array<struct<evidence_text:string>>")["updates"]
    message = F.get_json_object(user, "$.current_message")
    wanted = F.col("metadata.selected_slot")
    rows = expectations(
        records,
        {
            "no test split": F.col("metadata.split") != "test",
            "extraction only": F.col("metadata.task") == "extract",
            "prompt roles": F.transform("prompt", lambda m: m["role"]) == strings(["system", "user"]),
            "completion roles": F.transform("completion", lambda m: m["role"]) == strings(["assistant"]),
            "grounded evidence": F.forall(updates, lambda u: F.contains(message, u["evidence_text"])),
            "selected slot": wanted.isNull() | (F.get_json_object(user, "$.selected_slot") == wanted),
        },
    )
    repeated = none_of(records.groupBy(F.sha2(F.to_json(F.struct("prompt", "completion")), 256)).count().where("count > 1"), "no exact duplicates")
    short = records.where("metadata.variant = 'selected_short'").select(F.col("metadata.selected_slot").alias("slot")).distinct()
    required = records.sparkSession.createDataFrame([(s,) for s in REQUIRED], "slot string")
    covered = none_of(required.join(short, "slot", "left_anti").unionByName(short.join(required, "slot", "left_anti")), "required slots covered")
    return reduce(DataFrame.unionByName, [rows, repeated, covered])


def positives(records: DataFrame) -> DataFrame:
    """(slot_id): a row for each update in the records' completions."""
    updates = F.from_json(F.col("completion")[0]["content"], "updates array<struct<slot_id:string>>")["updates"]
    return records.select(F.explode(updates).alias("u")).select("u.slot_id")


def validate_extended(corpus: DataFrame, records: DataFrame, size: int = 420, least: int = 100, variants: tuple[str, ...] = ("selected_short", "selected_sentence", "selected_roman_urdu", "selected_multi_slot", "selected_non_answer", "cluster_answer", "reviewed_base")) -> DataFrame:
    """(name, violations) for the extended corpus and its records: as validate_records, with the corpus' size, positives of each required slot, and variants."""
    spark = records.sparkSession
    required = spark.createDataFrame([(s,) for s in REQUIRED], "slot_id string")
    counts = positives(records).groupBy("slot_id").agg(F.count("*").alias("n"))
    few = none_of(underrepresented(counts, required, least), f"at least {least} positives a slot")
    wanted = spark.createDataFrame([(v,) for v in variants], "variant string")
    lacking = none_of(wanted.join(records.select("metadata.variant").distinct(), "variant", "left_anti"), "all variants")
    return reduce(DataFrame.unionByName, [counted(corpus, "size", size), validate_records(records), few, lacking])
