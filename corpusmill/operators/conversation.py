"""Scores of conversations: turns in order, final states, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import guardrails
from corpusmill.functions.text import round4
from corpusmill.operators.scans import parts


def annotated_turns(turns: DataFrame, key: str = "case_id", order: str = "turn") -> DataFrame:
    """turns (key, order, assistant, mentioned, intent) with repeated_previous_question and state_progressed.

    A question repeats if it equals, trimmed and not empty, the one just before;
    state progresses if more slots are mentioned than before or the intent changes.
    The state before the first turn has none and a null intent. One scan; a key with
    most of the turns is cut.
    """
    before = F.struct(F.trim("assistant").alias("own"), "mentioned", "intent")
    found = parts(turns, [key], [order]).last_before({"_before": before}).rows
    own = F.trim("assistant")
    return found.select(
        *turns.columns,
        F.coalesce((own == F.col("_before.own")) & (own != ""), F.lit(False)).alias("repeated_previous_question"),
        ((F.col("mentioned") > F.coalesce("_before.mentioned", F.lit(0))) | ~F.col("intent").eqNullSafe(F.col("_before.intent"))).alias("state_progressed"),
    )


def last_question(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """turns with last_question: the latest non-empty text before each row; a key with most of the turns is cut."""
    found = parts(turns, [key], [order]).last_before({"last_question": F.when(F.col(text) != "", F.col(text))})
    return found.rows.select(*turns.columns, "last_question")


def repeats(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """rows with repeats: whether a row's value equals that of the row just before it of the same key."""
    found = parts(rows, keys, order).last_before({"_before": F.struct(value)})
    return found.rows.select(*rows.columns, F.coalesce(F.col(value) == F.col(f"_before.{value}"), F.lit(False)).alias("repeats"))


def repeats_prevented(turns: DataFrame, key: str = "case_id", order: str = "turn") -> DataFrame:
    """turns (key, order, assistant, slot_id, description, allowed) with the assistant's text, replaced where it repeats the one just before, and event.

    slot_id, description and allowed are of the slot that is asked for next. event: a
    struct (event, turn_number, replacement) of a turn whose text was replaced, else
    null. A text is compared, trimmed and if not empty, with what was shown before: a
    replacement isn't the question that it stands for, so of equal questions in a row
    every second is replaced, unless the replacement itself comes next.
    """
    before = parts(turns, [key], [order]).last_before({"_before": F.struct(F.trim("assistant").alias("own"))})
    again = F.coalesce((F.trim("assistant") == F.col("_before.own")) & (F.trim("assistant") != ""), F.lit(False))
    # a run of equal texts begins where a text isn't the one before; its second, fourth and so on are replaced
    begun = before.with_columns({"_again": again}).last_before({"_n": F.when(~F.col("_again"), F.col(order))})
    at = F.coalesce(F.when(~F.col("_again"), F.col(order)), F.col("_n"))
    runs = begun.rows.withColumn("_run", at)
    placed = runs.withColumn("_place", F.row_number().over(W.partitionBy(key, "_run").orderBy(order)))
    text = guardrails.replacement_question(F.col("slot_id"), F.col("description"), F.col("allowed"))
    prevented = F.col("_again") & (F.col("_place") % 2 == 0)
    event = F.when(prevented, F.struct(F.lit("repeated_question_prevented").alias("event"), F.col(order).alias("turn_number"), text.alias("replacement")))
    return placed.withColumns({"assistant": F.when(prevented, text).otherwise(F.col("assistant")), "event": event}).select(*turns.columns, "event")


def _share(part, whole, digits=4):
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))


def turn_metrics(turns: DataFrame, key: str = "case_id") -> DataFrame:
    """One row: state_progression_rate, stalled_turn_rate, consecutive_question_repeat_rate, average_turns, cases, turns."""
    cases = turns.groupBy(key).agg(F.count("*").alias("n"), F.count_if("state_progressed").alias("moved"), F.count_if("repeated_previous_question").alias("repeats"))
    n = F.sum("n")
    return cases.agg(
        _share(F.sum("moved"), n).alias("state_progression_rate"),
        _share(n - F.sum("moved"), n).alias("stalled_turn_rate"),
        _share(F.sum("repeats"), F.sum(F.greatest(F.lit(0), F.col("n") - 1))).alias("consecutive_question_repeat_rate"),
        _share(n, F.count("*"), 2).alias("average_turns"),
        F.count("*").alias("cases"),
        F.coalesce(n, F.lit(0)).alias("turns"),
    )


def state_metrics(expected: DataFrame, final: DataFrame, record: str = "record") -> DataFrame:
    """One row of slot scores over records, which are told apart by position.

    Both sides: (record, slot_id, value), value canonical JSON. F1 is of the unrounded
    precision and recall.
    """
    e = expected.select(record, "slot_id", F.col("value").alias("e_value"), F.lit(True).alias("e"))
    p = final.select(record, "slot_id", F.col("value").alias("p_value"), F.lit(True).alias("p"))
    both = e.join(p, [record, "slot_id"], "full").select(F.coalesce("e", F.lit(False)).alias("e"), F.coalesce("p", F.lit(False)).alias("p"), F.col("e_value").eqNullSafe(F.col("p_value")).alias("same"))
    n = both.agg(F.count_if("e").alias("n_e"), F.count_if("p").alias("n_p"), F.count_if(F.col("e") & F.col("p")).alias("ids"), F.count_if(F.col("e") & F.col("p") & F.col("same")).alias("pairs"), F.count_if(F.col("p") & ~F.col("e")).alias("extra"))
    out = []
    for prefix, tp in (("slot_micro", "pairs"), ("slot_id_micro", "ids")):
        precision, recall = F.try_divide(F.col(tp).cast("double"), F.col("n_p")), F.try_divide(F.col(tp).cast("double"), F.col("n_e"))
        f1 = F.try_divide(2 * precision * recall, precision + recall)
        out += [F.coalesce(round4(x), F.lit(0.0)).alias(f"{prefix}_{name}") for name, x in (("precision", precision), ("recall", recall), ("f1", f1))]
    return n.select(*out, _share(F.col("extra"), F.col("n_p")).alias("unexpected_slot_inference_rate"))


def record_metrics(records: DataFrame) -> DataFrame:
    """One row of rates over records (success, intent_correct, slots_exact, assistant_safe); missing ones count as false, false, false and true."""
    n = F.count("*")
    flag = lambda c, default: F.count_if(F.coalesce(F.col(c), F.lit(default)))
    return records.agg(
        _share(flag("success", False), n).alias("case_success_rate"),
        _share(flag("intent_correct", False), n).alias("intent_accuracy"),
        _share(flag("slots_exact", False), n).alias("exact_final_state_accuracy"),
        _share(flag("assistant_safe", True), n).alias("assistant_safety_rate"),
    )


def trace_metrics(turns: DataFrame) -> DataFrame:
    """One row from turns with traces array<struct<operation, parsed>>: structured_output_validity_rate (null without calls), structured_model_calls, deterministic_turn_rate."""
    calls = F.filter("traces", lambda t: t["operation"].isin("extract", "ask"))
    fixed = F.exists("traces", lambda t: t["operation"].isin("deterministic_intent", "deterministic_slot"))
    some = turns.select(F.size(calls).alias("calls"), F.size(F.filter(calls, lambda t: F.coalesce(t["parsed"], F.lit(False)))).alias("parsed"), F.coalesce(fixed, F.lit(False)).alias("fixed"))
    n = F.coalesce(F.sum(F.greatest("calls", F.lit(0))), F.lit(0))
    return some.agg(F.bround(F.try_divide(F.sum(F.greatest("parsed", F.lit(0))).cast("double"), n), 4).alias("structured_output_validity_rate"), n.alias("structured_model_calls"), _share(F.count_if("fixed"), F.count("*")).alias("deterministic_turn_rate"))


def stated_slots(states: Column) -> Column:
    """{slot: value} of a final state's slots (structs slot_id, value, status) that have a value and were mentioned."""
    kept = F.filter(states, lambda x: x["value"].isNotNull() & (F.coalesce(x["status"], F.lit("")) != "unmentioned"))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["slot_id"], x["value"])))
