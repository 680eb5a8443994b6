"""Scores of structured extraction: updates, questions, latencies; overall and by category in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import f1_of, rate, round4
from corpusmill.operators.quantiles import spread
from corpusmill.operators.tables import settled

COUNTS = ("tp", "fp", "fn", "id_tp", "id_fp", "id_fn", "matched", "matched_correct")


def update_counts(expected: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: true and false positives and false negatives of (slot, value, status), of slots, and matched values.

    Both sides have keys, slot_id, value, status, pos. Equal triples count once; of
    several updates of a slot the last by pos counts for its value. One full join
    on (keys, slot) gives all three.
    """

    def by_slot(df: DataFrame, side: str) -> DataFrame:
        triple = F.struct("value", "status")
        return df.groupBy(*keys, "slot_id").agg(F.collect_set(triple).alias(f"{side}_set"), F.max_by(triple, "pos").alias(f"{side}_last"))

    both = by_slot(expected, "e").join(by_slot(predicted, "p"), [*keys, "slot_id"], "full")
    e, p = F.col("e_last").isNotNull(), F.col("p_last").isNotNull()
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    none = F.array().cast(both.schema["e_set"].dataType)
    shared = F.size(F.array_intersect(F.coalesce("e_set", none), F.coalesce("p_set", none)))
    return both.groupBy(*keys).agg(
        F.sum(shared).alias("tp"),
        F.sum(F.when(p, size("p_set")).otherwise(0) - shared).alias("fp"),
        F.sum(F.when(e, size("e_set")).otherwise(0) - shared).alias("fn"),
        F.count_if(e & p).alias("id_tp"),
        F.count_if(p & ~e).alias("id_fp"),
        F.count_if(e & ~p).alias("id_fn"),
        F.count_if(e & p).alias("matched"),
        F.count_if(e & p & (F.col("e_last") == F.col("p_last"))).alias("matched_correct"),
    )


def prf(tp: Column, fp: Column, fn: Column, prefix: str) -> list[Column]:
    """Precision and recall to four digits and the F1 of those."""
    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    return [precision.alias(f"{prefix}_precision"), recall.alias(f"{prefix}_recall"), f1_of(precision, recall).alias(f"{prefix}_f1")]


def component_metrics(records: DataFrame, category: str = "category") -> DataFrame:
    """One row overall (category null) and one for each category: a grouping-sets aggregate, and latencies by histograms.

    records, a row a call: task (extract or ask), predicted_ok, the COUNTS, n_expected,
    n_predicted, latency_ms and the checks intent, joint_extraction, correction,
    has_forbidden_contract, avoids_forbidden_slots, question_contract, one_question,
    slot_relevance, question_exact_match, question_content_match (null counts as
    false) and question_content_token_f1. A failed call keeps its false negatives
    and counts in the totals only.
    """
    extract, ask, ok = F.col("task") == "extract", F.col("task") == "ask", F.col("predicted_ok")
    good = extract & ok
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.count_if(c)
    filled = extract & (F.col("n_expected") > 0)
    sums = {c: F.coalesce(F.sum(F.when(extract if c in ("fn", "id_fn") else good, F.col(c))), F.lit(0)) for c in COUNTS}
    collapsed = n(filled & (~ok | (F.col("n_predicted") == 0)))
    questions = ["question_contract", "one_question", "slot_relevance", "question_exact_match", "question_content_match"]
    names = ["question_contract_accuracy", "one_question_compliance", "question_slot_relevance", "question_exact_match_accuracy", "question_content_accuracy"]
    out = [
        rate(n(ok), F.count("*")).alias("provider_success_rate"),
        rate(n(good & yes("intent")), n(extract)).alias("intent_accuracy"),
        *prf(sums["tp"], sums["fp"], sums["fn"], "slot_micro"),
        *prf(sums["id_tp"], sums["id_fp"], sums["id_fn"], "slot_id_micro"),
        rate(sums["matched_correct"], sums["matched"]).alias("matched_slot_value_accuracy"),
        rate(n(filled) - collapsed, n(filled)).alias("nonempty_update_accuracy"),
        rate(collapsed, n(filled)).alias("empty_update_collapse_rate"),
        rate(n(good & yes("joint_extraction")), n(extract)).alias("joint_extraction_accuracy"),
        rate(n(good & yes("correction")), n(extract)).alias("correction_detection_accuracy"),
        rate(n(good & ~F.coalesce(F.col("avoids_forbidden_slots"), F.lit(True))), n(good & yes("has_forbidden_contract"))).alias("forbidden_slot_inference_rate"),
        *[rate(n(ask & yes(c)), n(ask)).alias(name) for c, name in zip(questions, names, strict=True)],
        F.coalesce(round4(F.avg(F.when(ask, F.coalesce("question_content_token_f1", F.lit(0.0))))), F.lit(0.0)).alias("question_content_token_f1"),
        F.count("*").alias("calls"),
        n(extract).alias("extract_calls"),
        n(ask).alias("ask_calls"),
    ]
    own = settled(records, "records")
    scores = own.groupingSets([[category], []], category).agg(F.grouping_id().alias("_g"), *out)
    times = _latencies(own, "latency_ms", [category]).select(F.col(category).alias("_category"), "_all", *[F.coalesce(c, F.lit(0.0)).alias(f"latency_{c}") for c in ("mean", "p50", "p95")])
    same = (F.least("_g", F.lit(1)) == F.col("_all")) & F.col(category).eqNullSafe(F.col("_category"))
    places = [c for c in scores.columns if c != "_g"]
    at = places.index("calls")
    return scores.join(times, same, "left").select(*places[:at], "latency_mean", "latency_p50", "latency_p95", *places[at:])


def extraction_checks(expected: Column, predicted: Column, forbidden: Column) -> Column:
    """Checks of one extraction: structs with intent, correction_detected, updates (slot_id, value, status)."""
    triples = lambda r: F.array_distinct(F.transform(r["updates"], lambda u: F.struct(u["slot_id"], u["value"], u["status"])))
    a, b = triples(expected), triples(predicted)
    intent = expected["intent"].eqNullSafe(predicted["intent"])
    return F.struct(
        intent.alias("intent"),
        (intent & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)).alias("joint_extraction"),
        expected["correction_detected"].eqNullSafe(predicted["correction_detected"]).alias("correction"),
        (F.size(forbidden) > 0).alias("has_forbidden_contract"),
        (F.size(F.array_intersect(F.transform(predicted["updates"], lambda u: u["slot_id"]), forbidden)) == 0).alias("avoids_forbidden_slots"),
    )


def latency_summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, interpolated median and nearest-rank 95th percentile, overall and by group."""
    return _latencies(df, value, by).drop("_all")


def _latencies(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """With _all, 1 for the row of all groups; from exact order statistics by histograms."""
    places = {"low": F.floor((F.col("n") - 1) / 2), "high": F.ceil((F.col("n") - 1) / 2), "p95": F.ceil(0.95 * F.col("n")) - 1}
    found = spread(df, value, by, places)
    return found.select("_all", *by, "n", F.bround("mean", 1).alias("mean"), F.bround((F.col("low") + F.col("high")) / 2, 1).alias("p50"), F.bround("p95", 1).alias("p95"))
