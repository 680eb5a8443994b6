"""Deterministic guardrails around a structured model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.canonical import durations, let
from corpusmill.functions.text import spaced, strings

#: Replies, words and patterns that decide without a model.
YES = ("yes", "yeah", "yep", "y", "haan", "han", "jee", "ji", "bilkul")
NO = ("no", "nope", "n", "nahi", "nahin", "na", "do not", "dont", "not forecasting")
NON_ANSWERS = ("", "idk", "i dont know", "i don t know", "i do not know", "not sure", "skip", "unknown")
SAFE_TYPES = ("boolean", "datetime", "duration", "enum", "string", "timezone")
LEAKS = ("confirmed_slots", "unsupported_claims", "candidate_value", "slot_id", "evidence_text", "system:", "user:", "assistant:", "json")
LOW_INFORMATION = {
    "problem_statement": ("data", "forecast", "forecasting", "predict", "prediction", "time series"),
    "target_description": ("data", "forecast", "forecasting", "target", "time series", "value"),
    "business_goal": ("business", "forecasting", "planning", "unknown"),
    "success_criteria": ("accuracy", "accurate", "good", "unknown"),
}
#: Patterns over messages without case and punctuation. Fixed values.
REFUSAL = r"\b(?:do not|dont|don t|not) (?:want )?(?:a )?forecast\b"
REQUEST = r"\b(?:forecast|forecasting|predict|prediction)\b"
INSTRUCTION = r"\b(?:ignore|instruction|prompt|system|assistant)\b"
#: Words with which a short message isn't taken as a plain answer, so that the model sees it. Fixed values.
MODEL_WORDS = r"\b(?:actually|correction|forecast|instead|predict)\b"
SENTENCE = r"\b(?:i|we|you|my|our|will|want|need|have|is|are|the|that|this|from)\b"


def recovered_intent(message: Column, selected: Column) -> Column:
    """The intent that a reply to the intent question states, else null."""
    own = spaced(message)
    no = own.isin(*NO) | own.rlike(REFUSAL)
    yes = own.isin(*YES) | own.rlike(REQUEST)
    return F.when(selected == "intent", F.when(no, "not_forecasting").when(yes, "create_forecast"))


def low_information(slot_id: Column, value: Column) -> Column:
    """Whether a value says nothing about its slot."""
    own, out = spaced(value), F.lit(False)
    for slot, words in LOW_INFORMATION.items():
        out = F.when(slot_id == slot, own.isin(*words)).otherwise(out)
    return out


def short_slot_answer(message: Column, slot_id: Column, intent: Column, value_type: Column, allowed: Column | None = None) -> Column:
    """The trimmed message if it is a plain short answer to the selected slot's question, else null.

    At most four words and 120 characters, no question, refusal, instruction or
    sentence, some information, a safe type, and one of the allowed values, if any.
    """
    own, plain = F.trim(message), spaced(message)
    n = F.when(own == "", 0).otherwise(F.size(F.split(own, "\\s+")))
    ok = (intent == "create_forecast") & (own != "") & (F.length(own) <= 120) & (n <= 4) & ~F.contains(own, F.lit("?"))
    ok &= ~plain.isin(*NON_ANSWERS) & ~plain.rlike(INSTRUCTION) & ~((F.size(F.split(plain, " ")) > 1) & plain.rlike(SENTENCE))
    ok &= ~slot_id.isin("intent", "authentication_reference") & ~low_information(slot_id, message) & value_type.isin(*SAFE_TYPES)
    if allowed is not None:
        ok &= (value_type != "enum") | F.array_contains(allowed, F.lower(own))
    return F.when(ok, own)


def kept_updates(updates: Column) -> Column:
    """Updates (structs with slot_id, candidate_value) that say something."""
    return F.filter(updates, lambda u: ~low_information(u["slot_id"], u["candidate_value"]))


def leaks_prompt(evidence: Column) -> Column:
    return F.exists(strings(LEAKS), lambda t: F.contains(F.lower(evidence), t))


def _object(value: Column) -> Column:
    """A value that is a JSON object, with sorted keys; else null."""
    own = F.trim(value)
    return F.when(own.rlike(r"(?s)^\{.*\}$"), F.to_json(F.try_parse_json(own)))


def duration_text(span: Column) -> Column:
    """A {periods, unit} struct as JSON, whole numbers without a point; null without a unit."""

    def shown(own: Column) -> Column:
        amount = F.when(own["periods"] == F.floor(own["periods"]), F.floor(own["periods"]).cast("string")).otherwise(own["periods"].cast("string"))
        return F.when(own["unit"].isNotNull(), F.concat(F.lit('{"periods": '), amount, F.lit(', "unit": "'), own["unit"], F.lit('"}')))

    return let(span, shown)


def grounded_updates(updates: Column, message: Column, types: Column | None = None) -> Column:
    """Updates with evidence from the message.

    Evidence that leaks the prompt, or isn't in the message, becomes the message;
    where that is at most three letters and not in the value, the update goes. Of
    equal (slot, value) the first stays. With types, a map of known slots to their
    value types, updates of other slots go, values that are JSON objects have sorted
    keys, and durations are {"periods": n, "unit": u}, from the value, the evidence
    or the message; a duration that none of them says goes.
    """
    text = F.trim(F.lower(message))

    def bad(u: Column) -> Column:
        own = F.trim(F.coalesce(u["evidence_text"], F.lit("")))
        return leaks_prompt(own) | ((F.length(own) > 2) & ~F.contains(text, F.lower(own)))

    def goes(u: Column) -> Column:
        ungrounded = bad(u) & (F.length(text) <= 3) & ~F.contains(F.lower(u["candidate_value"]), text)
        return ungrounded if types is None else ungrounded | F.try_element_at(types, u["slot_id"]).isNull()

    stays = F.filter(updates, lambda u: ~goes(u))
    repaired = F.transform(stays, lambda u: u.withField("evidence_text", F.when(bad(u), F.trim(message)).otherwise(F.trim(F.coalesce(u["evidence_text"], F.lit(""))))))
    if types is not None:

        def value(u: Column) -> Column:
            own = u["candidate_value"]
            said = duration_text(durations(own, u["evidence_text"], message))
            return F.when(F.try_element_at(types, u["slot_id"]) == "duration", said).otherwise(F.coalesce(_object(own), own))

        repaired = F.filter(F.transform(repaired, lambda u: u.withField("candidate_value", value(u))), lambda u: u["candidate_value"].isNotNull())
    keys = lambda all_: F.transform(all_, lambda u: F.struct(u["slot_id"], u["candidate_value"]))
    # the list is worked out once, as a lambda's argument
    first = lambda all_: F.filter(all_, lambda u, i: F.array_position(keys(all_), F.struct(u["slot_id"], u["candidate_value"])) == i + 1)
    return let(repaired, first)


#: Words for true and false, beside those of replies.
_TRUE, _FALSE = ("true", "1"), ("false", "0")


def normalized_value(value: Column, value_type: Column, allowed: Column | None = None) -> Column:
    """A said value as its type's JSON text, or null if it isn't one of the type.

    Booleans by the words of replies; dates and times that can be read; durations
    that name a unit; time zones as UTC, an offset or Area/City; of enumerations the
    allowed values, without case; other text trimmed.
    """
    own, plain = F.trim(value), spaced(value)
    span = durations(own, F.lit(""), F.lit(""))
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    zone = own.rlike(r"^(?:UTC|GMT|Z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Z][A-Za-z_]+(?:/[A-Z][A-Za-z_+-]+){1,2})$")
    listed = F.lit(True) if allowed is None else F.coalesce(F.array_contains(allowed, F.lower(own)), F.lit(False))
    return (
        F.when(own == "", None)
        .when(value_type == "boolean", F.when(plain.isin(*YES, *_TRUE), "true").when(plain.isin(*NO, *_FALSE), "false"))
        .when(value_type == "datetime", F.when(F.try_to_timestamp(own).isNotNull(), quote(own)))
        .when(value_type == "duration", duration_text(span))
        .when(value_type == "timezone", F.when(zone, quote(own)))
        .when(value_type == "enum", F.when(listed, quote(F.lower(own))))
        .otherwise(quote(own))
    )


def recovered_answer(message: Column, slot_id: Column, intent: Column, value_type: Column, updates: Column, allowed: Column | None = None) -> Column:
    """Updates after a short answer to the selected slot's question, or null where it isn't one.

    Updates are structs of slot_id, candidate_value, status, confidence and
    evidence_text. The answer is normalised and must be of its type; the slot must
    have no update yet. Only an update of the intent stays beside it.
    """
    taken = F.exists(updates, lambda u: u["slot_id"] == slot_id)

    def recovered(value: Column) -> Column:
        own = F.struct(slot_id.alias("slot_id"), value.alias("candidate_value"), F.lit("provided").alias("status"), F.lit(1.0).alias("confidence"), F.trim(message).alias("evidence_text"))
        return F.when(value.isNotNull() & ~F.coalesce(taken, F.lit(False)), F.concat(F.filter(updates, lambda u: u["slot_id"] == "intent"), F.array(own)))

    short = short_slot_answer(message, slot_id, intent, value_type, allowed)
    return let(let(short, lambda own: normalized_value(own, value_type, allowed)), recovered)


UPDATES = "array<struct<slot_id:string,candidate_value:string,status:string,confidence:double,evidence_text:string>>"


def intent_updates(message: Column, intent: Column) -> Column:
    """The update that a reply to the intent question makes: one if a forecast is wanted, else none."""
    own = F.struct(F.lit("intent").alias("slot_id"), F.lit('"create_forecast"').alias("candidate_value"), F.lit("provided").alias("status"), F.lit(1.0).alias("confidence"), message.alias("evidence_text"))
    return F.when(intent == "create_forecast", F.array(own)).otherwise(F.array().cast(UPDATES))


def routed_extraction(turns: DataFrame, model, allowed: Column | None = None, types: Column | None = None) -> DataFrame:
    """turns (.., message, selected_slot, value_type, intent) -> with intent, updates and route.

    Rows part in four. A bare yes or no to the intent question decides it (route
    intent), and a short message without words that ask for the model is an answer to
    the selected slot's question if it can be one (short answer); neither reaches the
    model. Of the others, model(DataFrame) gives intent, updates and, where it fails,
    an error that isn't null; if the message states the intent asked for, that stands
    in for a failed answer (recovery), else the row is an error (error, no updates).
    Answers lose what says nothing, then are grounded (with types as in
    grounded_updates); where the message states another intent than the answer, it is
    put right (intent put right); and a short answer to the selected slot recovers
    what the model missed (recovered answer). The rest are the model's (model).
    """
    message, slot, kind, state = F.col("message"), F.col("selected_slot"), F.col("value_type"), F.col("_state")
    none, plain = F.array().cast(UPDATES), spaced(F.col("message"))
    own = F.trim(message)
    few = F.when(own == "", 0).otherwise(F.size(F.split(own, "\\s+"))) <= 4
    marked = turns.withColumns({"_state": F.col("intent"), "_said": recovered_intent(message, slot)})
    bare = F.col("_said").isNotNull() & plain.isin(*YES, *NO)
    short = F.when(~bare & few & ~plain.rlike(MODEL_WORDS), recovered_answer(message, slot, state, kind, none, allowed))
    parted = marked.withColumns({"_bare": F.coalesce(bare, F.lit(False)), "_short": short})
    told = intent_updates(message, F.col("_said"))
    columns = [*turns.columns, "updates", "route"]

    replies = parted.where("_bare").withColumns({"updates": told, "route": F.lit("intent"), "intent": F.col("_said")})
    answers = parted.where("not _bare and _short is not null").withColumns({"updates": F.col("_short"), "route": F.lit("short answer"), "intent": F.lit("create_forecast")})
    asked = model(parted.where("not _bare and _short is null").drop("_bare", "_short"))
    if "error" not in asked.columns:
        asked = asked.withColumn("error", F.lit(None).cast("string"))
    failed = asked.where("error is not null")
    saved = F.col("_said").isNotNull()
    failures = failed.withColumns({"updates": F.when(saved, told).otherwise(none), "route": F.when(saved, "recovery").otherwise("error"), "intent": F.coalesce("_said", "_state")})

    clean = F.coalesce(grounded_updates(kept_updates(F.col("updates")), message, types), none)
    wrong = F.col("_said").isNotNull() & ~F.col("intent").eqNullSafe(F.col("_said"))
    right = F.when(F.col("_wrong"), F.concat(told, F.filter("_clean", lambda u: u["slot_id"] != "intent"))).otherwise(F.col("_clean"))
    again = recovered_answer(message, slot, state, kind, F.col("_right"), allowed)
    found = asked.where("error is null").withColumns({"_clean": clean, "_wrong": wrong}).withColumn("_right", right).withColumn("_again", again)
    recovered = F.col("_again").isNotNull()
    modelled = found.withColumns(
        {
            "updates": F.coalesce("_again", "_right"),
            "route": F.when(recovered, "recovered answer").when(F.col("_wrong"), "intent put right").otherwise("model"),
            "intent": F.when(recovered, "create_forecast").when(F.col("_wrong"), F.col("_said")).otherwise(F.col("intent")),
        }
    )
    out = replies.select(columns)
    for part in (answers, failures, modelled):
        out = out.unionByName(part.select(columns))
    return out


def without_repeat(question: Column, previous: Column, replacement: Column) -> Column:
    """A question that repeats the previous one is replaced."""
    same = (F.trim(question) != "") & (F.trim(question) == F.trim(previous))
    return F.when(same, replacement).otherwise(question)


#: What is asked instead of a question that repeats. Fixed values.
RESTATE = "I could not reliably record that answer. Please restate it in one short sentence."
RESTATE_INTENT = "I could not reliably record your forecasting intent. Please reply 'yes, create a forecast' or 'no'."
RESTATE_CHOICE = "I could not record {label}. Please choose one of: {choices}."
RESTATE_SLOT = "I could not reliably record {label}. Please answer in one short phrase."


def replacement_question(slot_id: Column, description: Column, allowed: Column) -> Column:
    """What is asked instead of a question that repeats, by the slot asked for (null: none is left), its description and its allowed values, if any."""
    label = F.rtrim(description, F.lit("."))
    filled = lambda template: F.replace(F.lit(template), F.lit("{label}"), label)
    choices = F.replace(filled(RESTATE_CHOICE), F.lit("{choices}"), F.array_join(allowed, ", "))
    return F.when(slot_id.isNull(), RESTATE).when(slot_id == "intent", RESTATE_INTENT).when(F.coalesce(F.size(allowed), F.lit(0)) > 0, choices).otherwise(filled(RESTATE_SLOT))
