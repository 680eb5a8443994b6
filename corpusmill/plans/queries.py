"""Registered queries of the library's operators over the driver's tables.

Domains are documents' sources (domain_index is the number in the name),
categories their languages, slot updates the labels, predictions a fixed rule
over documents, latencies the values of events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import canonical, guardrails, text
from corpusmill.operators import compare, conversation, dedup, scoring
from corpusmill.plans import catalog, corpus, sft, validation
from corpusmill.plans.more import MORE, _domains
from corpusmill.sources import readers, sinks
from corpusmill.streaming import incremental


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").withColumn("domain_index", F.substring("source", 4, 10).cast("int"))


def _split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("split", dedup.split_of(F.col("domain_index")))


def split_counts(spark, sf_dir):
    return _split_docs(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


def extended_split_counts(spark, sf_dir):
    number = (F.col("doc_id") % 33).cast("int")
    return _docs(spark, sf_dir).groupBy(number.alias("domain_index"), dedup.extended_split_of(number).alias("split")).agg(F.count("*").alias("n"))


def dedup_first_seen(spark, sf_dir):
    return dedup.first_seen(_docs(spark, sf_dir), F.col("text"), ["doc_id"]).select("doc_id", "source")


def sft_manifest(spark, sf_dir):
    """First-seen documents per split, without the test split."""
    kept = dedup.first_seen(_split_docs(spark, sf_dir), F.col("text"), ["doc_id"]).where("split <> 'test'")
    return kept.groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def cross_split_duplicates(spark, sf_dir):
    keyed = _split_docs(spark, sf_dir).select(F.sha2("text", 256).alias("sha256"), "split")
    return dedup.crossing_keys(keyed, "sha256")


def domain_disjointness(spark, sf_dir):
    return dedup.crossing_keys(_split_docs(spark, sf_dir), "source")


def normalized_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.normalized(F.col("text")), 256).alias("normalized_sha256"), F.sha2(text.spaced(F.col("text")), 256).alias("spaced_sha256"))


def content_token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"), F.size(text.content_tokens(F.col("text"))).alias("n_content"))


def token_f1_pairs(spark, sf_dir):
    """User turns against the assistant turns that follow."""
    turns = _read(spark, sf_dir, "conversations")
    pairs = turns.where("role = 'user'").alias("u").join(turns.where("role = 'assistant'").alias("a"), (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("u.turn") + 1 == F.col("a.turn")))
    a, b = text.content_tokens(F.col("u.text")), text.content_tokens(F.col("a.text"))
    return pairs.select("u.conv_id", "u.turn", F.size(a).alias("n_user"), F.size(b).alias("n_assistant"), F.size(F.array_intersect(a, b)).alias("shared"), text.token_f1(F.col("u.text"), F.col("a.text")).alias("f1"))


def answer_checks(spark, sf_dir):
    some = lambda *xs: F.array(*map(F.lit, xs))
    checks = text.answer_checks(F.col("text"), some("the"), some("license", "token"), some("@", "all rights"), F.lit(0), F.lit(0))
    return _docs(spark, sf_dir).select("doc_id", checks.alias("c"), text.question_marks(F.col("text")).alias("question_marks"), text.numbered_items(F.col("text")).alias("numbered_items")).select("doc_id", "c.*", "question_marks", "numbered_items")


def automated_pass(spark, sf_dir):
    checks = answer_checks(spark, sf_dir)
    ok = F.col("contains_required_text") & F.col("contains_any_text") & F.col("avoids_forbidden_text") & F.col("question_limit") & F.col("numbered_item_limit")
    return checks.agg(F.count("*").alias("n"), F.count_if(ok).alias("passes"))


def _updates(spark, sf_dir):
    """Expected updates from labels, predicted ones by a rule over documents."""
    labels = _read(spark, sf_dir, "labels")
    docs = _docs(spark, sf_dir)
    expected = labels.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("slot_id"), F.col("quality").cast("string").alias("value")), F.struct(F.lit("toxic").alias("slot_id"), F.col("toxic").cast("string").alias("value")))).alias("u"))
    rule = F.array(
        F.struct(F.lit("quality").alias("slot_id"), (F.col("n_chars") >= 200).cast("int").cast("string").alias("value")),
        F.when(F.col("n_chars") % 3 != 0, F.struct(F.lit("toxic").alias("slot_id"), F.lit("0").alias("value"))),
        F.when(F.col("n_chars") % 7 == 0, F.struct(F.lit("length").alias("slot_id"), F.lit("x").alias("value"))),
    )
    predicted = docs.join(labels.select("doc_id"), "doc_id").select("doc_id", F.explode(F.filter(rule, lambda u: u.isNotNull())).alias("u"))
    shaped = [d.select("doc_id", "u.slot_id", "u.value", F.lit("provided").alias("status"), F.lit(0).alias("pos")) for d in (expected, predicted)]
    return shaped


def slot_update_counts(spark, sf_dir):
    counts = scoring.update_counts(*_updates(spark, sf_dir), ["doc_id"])
    return counts.agg(*[F.sum(c).alias(c) for c in scoring.COUNTS])


def slot_micro_prf(spark, sf_dir):
    n = slot_update_counts(spark, sf_dir)
    return n.select(*scoring.prf(F.col("tp"), F.col("fp"), F.col("fn"), "slot_micro"), *scoring.prf(F.col("id_tp"), F.col("id_fp"), F.col("id_fn"), "slot_id_micro"), text.rate(F.col("matched_correct"), F.col("matched")).alias("matched_slot_value_accuracy"))


def component_category_metrics(spark, sf_dir):
    """All component metrics, overall and by category, from one aggregate."""
    expected, predicted = _updates(spark, sf_dir)
    counts = scoring.update_counts(expected, predicted, ["doc_id"])
    n_expected, n_predicted = (d.groupBy("doc_id").agg(F.count("*").alias(name)) for d, name in ((expected, "n_expected"), (predicted, "n_predicted")))
    docs = _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("category"), "n_chars", "text")
    calls = docs.join(counts, "doc_id").join(n_expected, "doc_id", "left").join(n_predicted, "doc_id", "left")
    flag = lambda k: F.col("n_chars") % k != 0
    records = calls.select(
        "category", F.when(F.col("doc_id") % 4 == 0, "ask").otherwise("extract").alias("task"), (F.col("doc_id") % 11 != 0).alias("predicted_ok"), *scoring.COUNTS, "n_expected", F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"),
        F.col("n_chars").cast("double").alias("latency_ms"), flag(2).alias("intent"), flag(3).alias("joint_extraction"), flag(5).alias("correction"), flag(7).alias("has_forbidden_contract"), flag(13).alias("avoids_forbidden_slots"),
        flag(2).alias("question_contract"), text.one_question(F.col("text")).alias("one_question"), flag(3).alias("slot_relevance"), flag(6).alias("question_exact_match"), F.when(F.col("n_chars") % 5 > 1, flag(4)).alias("question_content_match"),
        ((F.col("n_chars") % 8) / 8).alias("question_content_token_f1"),
    )
    return scoring.component_metrics(records)


def latency_summary(spark, sf_dir):
    return scoring.latency_summary(_read(spark, sf_dir, "events"), "value", ["event_type"])


def prev_assistant_repeat(spark, sf_dir):
    """Repeats among events of a user: the same type as the one before."""
    events = _read(spark, sf_dir, "events")
    marked = conversation.repeats(events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    per_user = marked.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("repeats").alias("repeats"))
    return per_user.agg(F.sum("repeats").alias("repeats"), F.sum(F.greatest(F.lit(0), F.col("n") - 1)).alias("chances"))


def turn_progress(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), "turn", F.when(F.col("role") == "assistant", F.col("text")).alias("assistant"), (F.length("text") % 5 + F.col("turn")).alias("mentioned"), F.col("role").alias("intent"))
    return conversation.annotated_turns(turns).select("case_id", "turn", "repeated_previous_question", "state_progressed")


def conversation_turn_metrics(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), "turn", F.lit("same?").alias("assistant"), (F.length("text") % 3).alias("mentioned"), F.lit("x").alias("intent"))
    return conversation.turn_metrics(conversation.annotated_turns(turns))


def conversation_state_metrics(spark, sf_dir):
    expected, predicted = _updates(spark, sf_dir)
    shaped = [d.select(F.col("doc_id").alias("record"), "slot_id", "value") for d in (expected, predicted)]
    return conversation.state_metrics(*shaped)


def conversation_record_metrics(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels")
    return conversation.record_metrics(labels.select((F.col("quality") == 1).alias("success"), (F.col("toxic") == 0).alias("intent_correct"), F.when(F.col("doc_id") % 2 == 0, F.col("quality") == 0).alias("slots_exact"), F.when(F.col("doc_id") % 3 == 0, F.col("toxic") == 1).alias("assistant_safe")))


def trace_metrics(spark, sf_dir):
    ops = F.array(*map(F.lit, ("extract", "ask", "deterministic_intent", "deterministic_slot", "other")))
    turns = _read(spark, sf_dir, "conversations").select(F.transform(F.sequence(F.lit(0), (F.length("text") % 3).cast("int")), lambda i: F.struct(F.element_at(ops, ((F.length("text") + i) % 5 + 1).cast("int")).alias("operation"), ((F.length("text") + i) % 4 != 0).alias("parsed"))).alias("traces"))
    return conversation.trace_metrics(turns)


def last_assistant_question(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").withColumn("question", F.when(F.col("role") == "assistant", F.col("text")).otherwise(F.lit("")))
    return conversation.last_question(turns, "conv_id", "turn", "question").select("conv_id", "turn", F.sha2("last_question", 256).alias("last_question_sha256"))


def turn_enumeration(spark, sf_dir):
    lists = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return lists.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", (F.col("pos") + 1).alias("turn_index"), "t.role")


def conversation_lengths(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("cases"), F.sum("n").alias("turns"), F.max("n").alias("longest"))


def chat_to_prompt_completion(spark, sf_dir):
    message = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    chats = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(message)), lambda x: x["m"]).alias("messages"))
    both = readers.prompt_completion(chats, "conv_id")
    return both.select("conv_id", F.size("prompt").alias("n_prompt"), F.col("completion")[0]["role"].alias("role"), F.sha2(F.col("completion")[0]["content"], 256).alias("completion_sha256"))


def benchmark_contamination(spark, sf_dir):
    return dedup.containing(_docs(spark, sf_dir), _read(spark, sf_dir, "benchmark").withColumnRenamed("text", "phrase"), "doc_id", "text", "item_id", "phrase")


def evidence_containment(spark, sf_dir):
    """Per document how many of its lines are grounded in the previous document's text."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("other"))
    return docs.join(before, "doc_id").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.contains(F.col("other"), x))).alias("grounded"))


def unknown_slot_anti_join(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels").select("doc_id")
    return _docs(spark, sf_dir).select("doc_id").join(labels, "doc_id", "left_anti")


def resume_pending(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id")
    left = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    right = _read(spark, sf_dir, "labels").where("toxic = 0").select("doc_id")
    return compare.pending(docs, [left, right], "doc_id")


def forbidden_slot_overlap(spark, sf_dir):
    """Documents whose words meet a list of forbidden ones."""
    bad = text.strings(["idiot", "scum", "pathetic", "disgusting", "loser"])
    return _docs(spark, sf_dir).where(F.arrays_overlap(text.tokens(F.col("text")), bad)).select("doc_id")


def ring_successor(spark, sf_dir):
    sources = _docs(spark, sf_dir).select("domain_index", "source").distinct()
    return compare.successor(sources, "domain_index", 20, ["source"]).select("domain_index", "source", "next_source")


def _profile(df):
    return compare.long_metrics(df.agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest")))


def report_winner(spark, sf_dir):
    """Two pairs of languages compared."""
    docs, out = _docs(spark, sf_dir), []
    for left, right in (("en", "fr"), ("de", "es")):
        found = compare.compared(_profile(docs.where(F.col("lang") == left)).where("metric <> 'longest'"), _profile(docs.where(F.col("lang") == right)), left, right, lower=("shortest",), higher=("documents", "chars"))
        out.append(found.withColumn("pair", F.lit(f"{left}-{right}")))
    return out[0].unionByName(out[1])


def sampling_offset_limit(spark, sf_dir):
    return compare.sampled(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", 50, 25)


def sampling_indices(spark, sf_dir):
    return compare.sampled(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", indices=[0, 3, 17, 150, 9_999_999])


def preview_overlength(spark, sf_dir):
    """The first ten documents over 2,000 words."""
    long = _docs(spark, sf_dir).select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens")).where("n_tokens > 2000")
    return long.orderBy("doc_id").limit(10)


def length_profile(spark, sf_dir):
    words = F.size(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""))
    return compare.length_profile(_split_docs(spark, sf_dir), words, 1000)


def scenario_matrix_v1(spark, sf_dir):
    made = corpus.corpus(_domains(spark, sf_dir, 20), "v1")
    return made.groupBy("category", "split").agg(F.count("*").alias("n"), F.sum(F.size("turns")).alias("turns"))


def conversational_matrix(spark, sf_dir):
    made = corpus.corpus(_domains(spark, sf_dir, 20), "v2")
    return made.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("category") == "conversational_intent").alias("conversational"), F.count("expected_question_slot").alias("asking"))


def sft_variants(spark, sf_dir):
    domains = _domains(spark, sf_dir, 20)
    records = sft.prompt_completion(corpus.corpus(domains, "v3"), domains)
    return records.groupBy("metadata.split", "metadata.variant").agg(F.count("*").alias("n"))


def corpus_expectations(spark, sf_dir):
    return validation.validate_corpus(corpus.corpus(_domains(spark, sf_dir, 20), "v1"), 200)


def table_expectations(spark, sf_dir):
    """Violations of expectations over documents, in one pass."""
    checks = {"has text": F.col("text") != "", "counts characters": F.col("n_chars") == F.char_length("text"), "short": F.col("n_chars") <= 2000, "english": F.col("lang") == "en"}
    return validation.expectations(_docs(spark, sf_dir), checks)


def slot_coverage(spark, sf_dir):
    """Positive examples of each source, also those without."""
    toxic = _docs(spark, sf_dir).join(_read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("source")
    return compare.positive_counts(toxic, _docs(spark, sf_dir).select("source"), "source")


def multiset_equality(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("lang", "source")
    return dedup.multiset_difference(docs, docs.where("lang <> 'es'"))


def set_operations(spark, sf_dir):
    docs, labels = _docs(spark, sf_dir).select("doc_id"), _read(spark, sf_dir, "labels").select("doc_id")
    sizes = [(name, df.agg(F.count("*").alias("n"))) for name, df in (("intersect", docs.intersect(labels)), ("except", docs.exceptAll(labels)), ("union", docs.unionByName(labels)))]
    out = [df.select(F.lit(name).alias("operation"), "n") for name, df in sizes]
    return out[0].unionByName(out[1]).unionByName(out[2])


def render_values(spark, sf_dir):
    value = F.when(F.col("o_orderkey") % 4 == 0, "boolean").when(F.col("o_orderkey") % 4 == 1, "duration").when(F.col("o_orderkey") % 4 == 2, "list").otherwise("string")
    unit = F.element_at(F.array(*map(F.lit, ("day", "week", "month"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    out = text.rendered(value, F.col("o_orderpriority"), F.col("o_custkey") % 2 == 0, (F.col("o_orderkey") % 5 + 1).cast("double"), unit, F.array("o_orderstatus", "o_orderpriority"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", out.alias("rendered"))


def filled_templates(spark, sf_dir):
    value = F.concat(F.col("n_name"), F.lit(" data"))
    pick = F.when(F.col("n_nationkey") % 2 == 0, text.filled(F.lit(catalog.SENTENCES["business_goal"]), value)).otherwise(text.filled(F.lit(catalog.ROMAN_URDU["business_goal"]), value))
    return _read(spark, sf_dir, "nation").select("n_nationkey", pick.alias("message"), text.short_answer(F.when(F.col("n_nationkey") == 0, "intent").otherwise("source_mode"), F.when(F.col("n_nationkey") < 5, "upload").otherwise(F.col("n_name"))).alias("short"))


def pad_to_n(spark, sf_dir):
    names = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return names.select("n_regionkey", F.array_join(text.padded(F.col("names"), F.lit("none"), 7), "|").alias("padded"))


def rotating_pick(spark, sf_dir):
    pick = F.element_at(text.strings(catalog.NON_ANSWERS), ((F.col("n_nationkey") + F.col("n_regionkey")) % 3 + 1).cast("int"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", pick.alias("non_answer"))


def last_write_wins(spark, sf_dir):
    return dedup.last_write(_read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", ["value"])


def evidence_carry_forward(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    return dedup.carried_forward(events, ["user_id"], "event_id", "event_type", "props").select("event_id", "original_evidence")


def checksum_manifest(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))


def file_fingerprints(spark, sf_dir):
    return readers.fingerprints(spark, sf_dir, "*.parquet").select("name", "bytes", "sha256")


def corpus_manifest(spark, sf_dir):
    return sinks.manifest(_split_docs(spark, sf_dir), "tables", ["split", "lang"])


def content_digest(spark, sf_dir):
    return sinks.content_digest(_docs(spark, sf_dir).drop("domain_index"))


def low_information_values(spark, sf_dir):
    slot = F.when(F.col("conv_id") % 2 == 0, "target_description").otherwise("business_goal")
    value = F.element_at(F.array(*map(F.lit, (" Forecast!", "planning", "sales", "Time-series", "unknown"))), (F.length("text") % 5 + 1).cast("int"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", guardrails.low_information(slot, value).alias("drops"))


def recovered_intents(spark, sf_dir):
    message = F.element_at(F.array(*map(F.lit, ("Yes!", "no", "I do not want a forecast", "please predict sales", "hello", "Haan"))), (F.length("text") % 6 + 1).cast("int"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", guardrails.recovered_intent(message, F.lit("intent")).alias("intent"))


def short_slot_answers(spark, sf_dir):
    """Each part of each turn, between stops, commas and lines, as an answer."""
    parts = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "[.,\n]")).alias("part", "said"))
    return parts.select("conv_id", "turn", "part", guardrails.short_slot_answer(F.col("said"), F.lit("target_column"), F.lit("create_forecast"), F.lit("string")).alias("answer"))


def grounded_evidence(spark, sf_dir):
    u = lambda s, v, e: F.struct(F.lit(s).alias("slot_id"), v.alias("candidate_value"), e.alias("evidence_text"))
    updates = F.array(u("a", F.lit("1"), F.substring("text", 1, 10)), u("a", F.lit("1"), F.lit("system: x")), u("b", F.lit("2"), F.lit("not there at all")))
    own = guardrails.grounded_updates(updates, F.col("text"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(own).alias("n"), F.sha2(F.array_join(F.transform(own, lambda x: x["evidence_text"]), "|"), 256).alias("evidence_sha256"))


def repeat_guard(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").withColumn("question", F.concat(F.lit("What next "), F.length("text") % 2, F.lit("?")))
    before = F.lag("question").over(W.partitionBy("conv_id").orderBy("turn"))
    return turns.select("conv_id", "turn", guardrails.without_repeat(F.col("question"), before, F.lit("Please answer the question above.")).alias("question"))


def safe_labels(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", text.safe_label(F.concat_ws("/", "p_name", "p_brand")).alias("label"), text.redacted_error(F.col("p_brand"), F.col("p_size"), F.col("p_type")).alias("error"))


def latest_checkpoint(spark, sf_dir):
    names = _docs(spark, sf_dir).select(F.concat(F.when(F.col("doc_id") % 2 == 0, "out/checkpoint-").otherwise("out/checkpoint-x"), F.col("n_chars")).alias("path"))
    return compare.latest_checkpoint(names)


def canonical_json(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", canonical.canonical_value("props").alias("loose"), canonical.compact_value("props").alias("compact"))


def json_salvage(spark, sf_dir):
    answer = F.concat(F.when(F.col("event_id") % 3 == 0, "```json\n").when(F.col("event_id") % 3 == 1, "result: ").otherwise(""), F.col("props"), F.when(F.col("event_id") % 3 == 0, "\n```").otherwise(" done"))
    return _read(spark, sf_dir, "events").select("event_id", canonical.salvaged(answer).alias("object"))


def duration_parse(spark, sf_dir):
    unit = F.element_at(text.strings(sorted(canonical.UNITS)), (F.col("event_id") % len(canonical.UNITS) + 1).cast("int"))
    raw = F.concat((F.col("event_id") % 9 + 1).cast("string"), F.lit(" "), unit)
    return _read(spark, sf_dir, "events").select("event_id", canonical.durations(raw, F.lit(""), F.lit("")).alias("d")).select("event_id", "d.periods", "d.unit")


def excluded_cases(spark, sf_dir):
    return compare.excluding(_docs(spark, sf_dir), "source", ["src0", "src5", "src11"]).select("doc_id", "source")


def guided_cases(spark, sf_dir):
    return sft.guided_cases(_domains(spark, sf_dir, 4)).select("case_id", F.size("messages").alias("turns"), F.element_at("messages", 2).alias("second"))


def event_windows(spark, sf_dir):
    return incremental.latency_windows(_read(spark, sf_dir, "events"), "ts", "event_type", "value", "1 day").select("start", "event_type", "n", F.bround("mean", 9).alias("mean"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        split_counts, extended_split_counts, dedup_first_seen, sft_manifest, cross_split_duplicates, domain_disjointness, normalized_text, content_token_counts, token_f1_pairs, answer_checks,
        automated_pass, slot_update_counts, slot_micro_prf, component_category_metrics, latency_summary, prev_assistant_repeat, turn_progress, conversation_turn_metrics, conversation_state_metrics,
        conversation_record_metrics, trace_metrics, last_assistant_question, turn_enumeration, conversation_lengths, chat_to_prompt_completion, benchmark_contamination, evidence_containment,
        unknown_slot_anti_join, resume_pending, forbidden_slot_overlap, ring_successor, report_winner, sampling_offset_limit, sampling_indices, preview_overlength, length_profile, scenario_matrix_v1,
        conversational_matrix, sft_variants, corpus_expectations, table_expectations, slot_coverage, multiset_equality, set_operations, render_values, filled_templates, pad_to_n, rotating_pick,
        last_write_wins, evidence_carry_forward, checksum_manifest, file_fingerprints, corpus_manifest, content_digest, low_information_values, recovered_intents, short_slot_answers, grounded_evidence,
        repeat_guard, safe_labels, latest_checkpoint, canonical_json, json_salvage, duration_parse, event_windows, excluded_cases, guided_cases,
    )
}
QUERIES |= MORE
