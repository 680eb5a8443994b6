"""Further registered queries, over files that they write and over generated corpora, each with its DuckDB SQL where there is one.

Files go to the shared folder. Corpora are generated over 33 domains; what is
compared are messages, slots and values, not counts. MORE and MORE_SQL are merged
into the registered queries.
"""

from __future__ import annotations

import string
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import canonical, guardrails, text
from corpusmill.operators import compare, conversation, dedup
from corpusmill.operators.tables import work_dir
from corpusmill.plans import catalog, corpus, sft, validation
from corpusmill.sources import readers, sinks
from corpusmill.streaming import incremental

DOMAINS = 33


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("domain_index", F.substring("source", 4, 10).cast("int"))
    return docs.withColumn("split", dedup.split_of(F.col("domain_index")))


def _domains(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The first n of the domains that documents make, by their ids."""
    return catalog.domains_of(_read(spark, sf_dir, "documents"), "doc_id", "n_chars", DOMAINS).where(F.col("domain_index") < n)


# Files


def jsonl_roundtrip(spark, sf_dir):
    """Documents with nulls and maps, written and read; the lines' digests tell bytes, with nulls and sorted keys."""
    path = _folder(spark, "jsonl")
    counts = F.map_from_arrays(F.array(F.lit("n_chars"), F.lit("doc_id")), F.array("n_chars", "doc_id"))
    sinks.write_jsonl(_read(spark, sf_dir, "documents").select("doc_id", "text", F.nullif("lang", F.lit("es")).alias("lang"), counts.alias("counts")), path)
    got = readers.jsonl(spark, path, "doc_id long, text string, lang string, counts map<string,long>")
    lines = spark.read.text(path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("of"), F.regexp_extract("value", r'^(\{"counts":\{[^}]*\},"doc_id":\d+,"lang":(?:null|"[a-z]*")),"text":', 1).alias("head"))
    return got.join(lines, F.col("doc_id") == F.col("of")).select("doc_id", "lang", F.sha2("text", 256).alias("sha256"), F.col("counts")["n_chars"].alias("n_chars"), "head", F.col("_corrupt_record").isNotNull().alias("corrupt"))


def jsonl_tree(spark, sf_dir):
    """The tree of digests of documents' lines as they were written."""
    path = _folder(spark, "tree")
    sinks.write_tree(_read(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("es")).alias("lang"), "n_chars"), path, "doc_id")
    return sinks.digest_tree(sinks.leaf_digests(sinks.read_tree(spark, path)))


def text_fingerprints(spark, sf_dir):
    """Size and SHA-256 of a written file for each source, of its documents' digests in order."""
    path = _folder(spark, "sources")
    lines = _read(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("value"))
    lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    return readers.fingerprints(spark, path, "part-*").select(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"), "bytes", "sha256")


def streamed_evaluation(spark, sf_dir):
    """Events scored by a stream of several batches that is started again, with events that come twice."""
    folder = _folder(spark, "stream")
    events = _read(spark, sf_dir, "events").select("event_id", "event_type", "value", F.to_date("ts").cast("string").alias("day"))
    score = lambda df: df.select("event_id", "event_type", F.bround(F.col("value") * 2, 1).alias("score"))
    parts = (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1 or event_id % 10 = 0"))
    for part in parts:
        part.repartition(2).write.mode("append").json(f"{folder}/in")
        incremental.evaluated_stream(spark, f"{folder}/in", "event_id long, event_type string, value double, day string", score, f"{folder}/out", f"{folder}/state", "event_id", F.substring("day", 1, 7), files=1).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id", "event_type", "score")


def named_splits_scan(spark, sf_dir):
    path = _folder(spark, "splits")
    sinks.write_splits(_split_docs(spark, sf_dir).select("doc_id", "n_chars", "split"), path)
    there = [r["name"].partition("=")[2] for r in readers.listing(spark, path).where("is_dir").collect()]  # a row a split
    got = readers.named_splits(spark, {s: f"{path}/split={s}" for s in sorted(there)}, "doc_id long, n_chars long")
    return got.groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count("_corrupt_record").alias("corrupt"))


def json_array_scan(spark, sf_dir):
    path = _folder(spark, "array")
    nations = _read(spark, sf_dir, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    nations.write.text(path)
    return readers.json_array(spark, path, "n_nationkey long, n_name string")


def key_value_scan(spark, sf_dir):
    path = _folder(spark, "pairs")
    lines = _read(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lit(" "), "n_name", F.lit(" = 'a="), F.col("n_nationkey").cast("string"), F.lit("' ")), F.concat(F.lit("# "), "n_name", F.lit("=x")), F.lit(""), F.lit("nothing"))).alias("value"))
    lines.write.text(path)
    return readers.key_values(spark, path)


def config_scan(spark, sf_dir):
    path = _folder(spark, "config")
    spark.createDataFrame([('{"lang": "de", "least": 500}',)], "value string").coalesce(1).write.text(path)
    settings = readers.config(spark, path, {"lang": str, "least": int, "strict": bool})
    return _read(spark, sf_dir, "documents").where((F.col("lang") == settings["lang"]) & (F.col("n_chars") >= settings["least"])).select("doc_id", "n_chars")


def prior_reports(spark, sf_dir):
    """Documents that a prior report lacks; reports that are missing or no list have no records."""
    folder = _folder(spark, "reports")
    sinks.write_lists(_read(spark, sf_dir, "labels").where("quality = 1").select("doc_id", "toxic"), f"{folder}/list")
    spark.createDataFrame([('{"doc_id": 1}',)], "value string").write.text(f"{folder}/object")
    found = readers.reports(spark, [f"{folder}/{name}" for name in ("list", "object", "missing")], "doc_id long")
    return compare.pending(_read(spark, sf_dir, "documents").select("doc_id"), [found], "doc_id")


def model_answers(spark, sf_dir):
    """A model that fails on every seventh document: its rows say so, the others have answers."""

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        if (frame["doc_id"] % 7 == 0).any():
            raise ValueError("secret")
        return frame.assign(answer=frame["n_chars"] * 2)

    return readers.answers(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), model, "doc_id long, answer long")


def csv_review(spark, sf_dir):
    path = _folder(spark, "csv")
    sinks.write_csv(_read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), path, ["grade", "notes"])
    return spark.read.schema("doc_id long, source string, n_chars long, grade string, notes string").option("header", True).csv(path)


def report_roundtrip(spark, sf_dir):
    path = _folder(spark, "report")
    docs = _read(spark, sf_dir, "documents")
    sinks.write_report(spark, docs.agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")), docs.select("doc_id", "lang"), path)
    records = spark.read.parquet(f"{path}/records").groupBy("lang").agg(F.count("*").alias("n"))
    return records.join(F.broadcast(spark.read.schema("documents long, chars long").json(f"{path}/metrics")))  # one row


def checkpoint_listing(spark, sf_dir):
    """The latest of the checkpoints that a folder holds, one for each region, beside a file and another folder."""
    folder = _folder(spark, "run")
    keys = [r[0] for r in _read(spark, sf_dir, "region").select("r_regionkey").collect()]  # five regions
    for k in keys:
        spark.range(1).coalesce(1).write.parquet(f"{folder}/checkpoint-{10 * k + 5}")
    spark.range(1).coalesce(1).write.parquet(f"{folder}/checkpoint-last")
    return compare.latest_checkpoint(readers.checkpoints(spark, folder)).select("step")


def artifact_chain(spark, sf_dir):
    """Problems of the documents as an artifact: a file that is gone, long documents, texts in several splits."""
    path = _folder(spark, "artifact")
    docs = _split_docs(spark, sf_dir)
    sinks.write_jsonl(docs.select("doc_id", "split"), path)
    found = readers.fingerprints(spark, path, "part-*")
    named = found.select("name", "sha256").unionByName(spark.createDataFrame([("gone.jsonl", "0")], "name string, sha256 string"))
    violations = validation.expectations(docs, {"short": F.col("n_chars") <= 2000, "has text": F.col("text") != ""})
    return sinks.artifact_problems(named, found, violations, docs.select(F.sha2("text", 256).alias("scenario_id"), "split"))


def run_manifest_lengths(spark, sf_dir):
    """Token lengths by split from a run's manifest, by an injected tokenizer that splits at spaces."""
    docs = _split_docs(spark, sf_dir).withColumn("tokens", text.token_lengths(lambda: lambda t: t.split(" "))(F.col("text")))
    made = sinks.run_manifest(readers.fingerprints(spark, sf_dir, "region.parquet"), compare.length_profile(docs, F.col("tokens"), 500), {"limit": 500})
    kind = "token_lengths map<string,struct<longest:long,n:long,over_limit:long,shortest:long,total:long>>"
    return made.select(F.explode(F.from_json("json", kind)["token_lengths"]).alias("split", "x")).select("split", "x.*")


# Corpora


def _said_json(records: DataFrame) -> DataFrame:
    answer = F.from_json(F.col("completion")[0]["content"], "intent string, updates array<struct<slot_id:string,candidate_value:string,evidence_text:string>>")
    user = F.col("prompt")[1]["content"]
    return records.withColumns({"answer": answer, "message": F.get_json_object(user, "$.current_message"), "selected": F.get_json_object(user, "$.selected_slot")})


def _pairs(updates: str) -> Column:
    return F.array_join(F.transform(updates, lambda u: F.concat(u["slot_id"], F.lit("="), u["candidate_value"])), "|")


def cluster_messages(spark, sf_dir):
    """The v4 records whose messages fill several slots: message and updates."""
    records = _said_json(sft.cluster_records(_domains(spark, sf_dir, DOMAINS)))
    return records.select("metadata.scenario_id", "metadata.split", "message", _pairs("answer.updates").alias("updates"), F.forall("answer.updates", lambda u: F.contains(F.col("message"), u["evidence_text"])).alias("grounded"))


def targeted_messages(spark, sf_dir):
    """The v4 records of answers to one slot, in all variants: message, intent and updates."""
    records = _said_json(sft.targeted_records(_domains(spark, sf_dir, DOMAINS), True))
    payload = F.from_json(F.col("prompt")[1]["content"], "confirmed_slots array<struct<slot_id:string>>, slot_definitions array<struct<slot_id:string>>")
    confirmed = F.array_join(F.transform(payload["confirmed_slots"], lambda c: c["slot_id"]), "|")
    shown = F.array_join(F.transform(payload["slot_definitions"], lambda d: d["slot_id"]), "|")
    return records.select("metadata.scenario_id", "metadata.split", "metadata.variant", "selected", "message", "answer.intent", _pairs("answer.updates").alias("updates"), confirmed.alias("confirmed"), shown.alias("definitions"))


def length_gate(spark, sf_dir):
    """The length profile of the documents, past the gate that lets long ones be truncated."""
    profile = compare.length_profile(_split_docs(spark, sf_dir), F.char_length("text"), 2000)
    return compare.within_limit(profile, allow_truncation=True)


def scenario_messages(spark, sf_dir):
    """The v4 corpus: last message, intent, slots of its updates, and the next question of each scenario."""
    made = corpus.corpus(_domains(spark, sf_dir, DOMAINS), "v4").withColumn("last", F.element_at("turns", -1))
    slots = F.array_join(F.transform("last.gold_extraction.updates", lambda u: u["slot_id"]), "|")
    return made.select("scenario_id", "split", "category", F.col("last.message").alias("message"), "gold_intent", "corpus_version", F.array_join("behavior_tags", "|").alias("tags"), slots.alias("slots"), "ideal_question", F.size("turns").alias("turns"))


def chat_questions(spark, sf_dir):
    """The questions of the chat records, from the v2 corpus."""
    asked = sft.chat(corpus.corpus(_domains(spark, sf_dir, 20), "v2")).where("metadata.task = 'ask'")
    return asked.select("metadata.scenario_id", "metadata.split", "metadata.slot_id", F.get_json_object(F.col("messages")[2]["content"], "$.question").alias("question"))


def paraphrased_records(spark, sf_dir):
    """Records of the v4 corpus' paraphrased turns: the cache has two wordings for some messages, and what it lacks is made and appended."""
    made = corpus.corpus(_domains(spark, sf_dir, DOMAINS), "v4").where("category = 'missing_required'")
    messages = sft.turns_of(made).select(F.col("t.message").alias("message")).distinct()
    path = _folder(spark, "paraphrases")
    worded = lambda df: df.select("message", F.array(F.concat(F.lit("Please: "), "message"), F.concat("message", F.lit(" Thanks."))).alias("paraphrases"))
    worded(messages.where(F.contains("message", F.lit("region 0")))).write.parquet(path)
    known = sft.longest(spark.read.schema("message string, paraphrases array<string>").parquet(path))
    sft.append_to_cache(path, known, worded(messages))
    cache = sft.longest(spark.read.schema("message string, paraphrases array<string>").parquet(path))
    records = _said_json(sft.base_records(made, 2, sft.with_paraphrase_cache(messages, cache, 2)))
    same = F.forall("answer.updates", lambda u: u["evidence_text"] == F.col("message"))
    return records.select("metadata.scenario_id", "metadata.variant", "message", F.size("answer.updates").alias("n"), same.alias("grounded"))


def extended_validation(spark, sf_dir):
    """Violations of the v4 corpus and records; and of records that lack a variant, repeat one, and are of the test split."""
    domains, path = _domains(spark, sf_dir, 30), _folder(spark, "extended")
    corpus.corpus(domains, "v4").write.parquet(f"{path}/corpus")
    made = spark.read.parquet(f"{path}/corpus")
    sft.prompt_completion(made, domains, "v4").write.parquet(f"{path}/records")
    records = spark.read.parquet(f"{path}/records")
    split = records.withColumn("metadata", F.when(F.col("metadata.variant") == "cluster_answer", F.col("metadata").withField("split", F.lit("test"))).otherwise(F.col("metadata")))
    spoiled = split.where("metadata.variant <> 'selected_short'").unionByName(split.where("metadata.scenario_id = 'cluster-source-series_00'"))
    sound, bad = validation.validate_extended(made, records), validation.validate_extended(made.limit(400), spoiled)
    return sound.select("name", F.lit("sound").alias("which"), "violations").unionByName(bad.select("name", F.lit("spoiled").alias("which"), "violations"))


def conversational_expectations(spark, sf_dir):
    """Violations of the v2 corpus, and of one without a category and a split."""
    made = corpus.corpus(_domains(spark, sf_dir, 20), "v2")
    sound, bad = validation.validate_conversational(made), validation.validate_conversational(made.where("category <> 'ambiguous' and split <> 'validation'"))
    return sound.select("name", F.lit("sound").alias("which"), "violations").unionByName(bad.select("name", F.lit("spoiled").alias("which"), "violations"))


# Guardrails


def normalized_values(spark, sf_dir):
    """Order fields as values of each type."""
    kinds = ("boolean", "datetime", "duration", "timezone", "enum", "string")
    kind = F.element_at(text.strings(kinds), (F.col("o_orderkey") % 6 + 1).cast("int"))
    n = F.col("o_custkey") % 9
    value = (
        F.when(kind == "boolean", F.element_at(text.strings(["Yes!", "no", "maybe"]), (n % 3 + 1).cast("int")))
        .when(kind == "datetime", F.when(n > 2, F.col("o_orderdate").cast("date").cast("string")).otherwise("soon"))
        .when(kind == "duration", F.when(n > 1, F.concat(n.cast("string"), F.lit(" weeks"))).otherwise("a while"))
        .when(kind == "timezone", F.when(n > 3, "Asia/Karachi").otherwise("nowhere special"))
        .when(kind == "enum", F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit(" ")))
        .otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(' "q" ')))
    )
    return _read(spark, sf_dir, "orders").select("o_orderkey", guardrails.normalized_value(value, kind, text.strings(["o", "f"])).alias("value"))


_TYPES = {"intent": "enum", "target_column": "string", "business_goal": "string", "frequency": "duration", "forecast_horizon": "duration"}


def _types() -> Column:
    return F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])


def _update(slot: str, value: Column | str, evidence: Column | str) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(slot).alias("slot_id"), column(value).alias("candidate_value"), F.lit("provided").alias("status"), F.lit(1.0).alias("confidence"), column(evidence).alias("evidence_text"))


def routed_extractions(spark, sf_dir):
    """Turns of all kinds, routed to rules or to a model that fails on some: intent, updates and route of each."""
    k, told = F.col("turn") % 8, F.concat(F.lit("please predict "), F.col("text"))
    said = F.when(k == 0, "Yes!").when(k == 1, "no").when(k == 2, " btc_usd ").when(k == 3, "correction weekly").when(k == 4, told).when(k == 5, told).otherwise(F.concat("text", F.lit(" is what I need from you")))
    slot = F.when(k.isin(0, 1, 4, 5), "intent").otherwise("target_column")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("message"), slot.alias("selected_slot"), F.lit("string").alias("value_type"), F.when(k.isin(0, 1, 4, 5), "unclear").otherwise("create_forecast").alias("intent"))

    def model(asked: DataFrame) -> DataFrame:
        updates = F.array(_update("business_goal", "planning", ""), _update("business_goal", F.sha2("message", 256), "system: x"), _update("frequency", "daily", ""), _update("nowhere", "x", ""))
        return asked.withColumns({"updates": updates, "error": F.when(k.isin(5, 6), "TimeoutError")})

    got = guardrails.routed_extraction(turns, model, types=_types())
    return got.select("conv_id", "turn", "intent", "route", _pairs("updates").alias("updates"))


def duration_forms(spark, sf_dir):
    """Durations in all forms: numbers and units, phrases, objects, digits with evidence, and what is none."""
    k, n = F.col("event_id") % 9, (F.col("event_id") % 7 + 1).cast("string")
    unit = F.element_at(text.strings(sorted(canonical.UNITS)), (F.floor(F.col("event_id") / 9) % len(canonical.UNITS) + 1).cast("int"))
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    raw = F.when(k == 0, said(n, " ", unit)).when(k == 1, said("for the next ", n, ".5 ", unit)).when(k == 2, said("A ", F.upper(unit))).when(k == 3, said('{"periods": ', n, ', "unit": "', unit, '"}')).when(k == 4, n).when(k == 5, "soon").when(k == 6, said(n, " ", unit, " please")).when(k == 7, said("{", n, "}")).otherwise('{"unit": "fortnight"}')
    evidence = F.when(k == 4, "next 6 months").when(k == 7, "3 days").otherwise("")
    message = F.when(k == 5, said("over the following ", unit)).otherwise("")
    return _read(spark, sf_dir, "events").select("event_id", canonical.durations(raw, evidence, message).alias("d")).select("event_id", "d.periods", "d.unit")


def stated_intents(spark, sf_dir):
    """Each part of each turn as a reply to the intent question: as it is, and as a request, a refusal and a bare word."""
    parts = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "[.,\\n]")).alias("part", "said"))
    k = (F.col("part") + F.col("turn")) % 6
    message = F.when(k == 0, F.col("said")).when(k == 1, F.concat(F.lit("Please predict "), "said")).when(k == 2, F.concat("said", F.lit(", but I do not want a forecast"))).when(k == 3, F.concat(F.lit("  YEP!"), F.lit("? "))).when(k == 4, F.lit("do not")).otherwise(F.concat("said", F.lit(" (no forecasting)")))
    return parts.select("conv_id", "turn", "part", guardrails.recovered_intent(message, F.lit("intent")).alias("intent"), guardrails.low_information(F.lit("problem_statement"), F.when(k < 3, F.element_at(F.array(F.lit("Time-series!"), F.lit("predictions"), F.lit(" DATA ")), (k + 1).cast("int"))).otherwise(F.col("said"))).alias("drops"))


def cleaned_updates(spark, sf_dir):
    """Updates of known and unknown slots, objects in two spellings, and durations that the value or the message says."""
    message = F.concat(F.when(F.col("turn") % 2 == 0, "next 6 months about ").otherwise("about "), F.col("text"))
    updates = F.array(
        _update("frequency", '{"unit": "Weekly"}', "confirmed_slots: x"), _update("frequency", '{"periods": 1.0, "unit": "week"}', F.substring("text", 1, 10)), _update("frequency", "soon", ""), _update("nowhere", "x", ""),
        _update("target_column", '{"b": 1, "a": 2}', "not there at all"), _update("target_column", '{"a":2,"b":1}', ""), _update("forecast_horizon", (F.length("text") % 9 + 1).cast("string"), ""),
    )
    own = guardrails.grounded_updates(updates, message, _types())
    shown = F.array_join(F.transform(own, lambda u: F.concat(u["slot_id"], F.lit("="), u["candidate_value"], F.lit("@"), u["evidence_text"])), "|")
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(own).alias("n"), F.sha2(shown, 256).alias("updates_sha256"))


def prevented_repeats(spark, sf_dir):
    """Questions that repeat, replaced by what fits the slot asked for, with the events of it."""
    k = F.col("turn") % 4
    slot = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "intent").when(k == 2, "source_mode").otherwise("target_column")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("What next "), F.floor(F.col("turn") / 3), F.lit("?")).alias("assistant"), slot.alias("slot_id"), F.concat(F.col("role"), F.lit("'s choice.")).alias("description"), F.when(k == 2, F.array(F.lit("upload"), F.lit("link"))).alias("allowed"))
    got = conversation.repeats_prevented(turns, "conv_id", "turn")
    return got.select("conv_id", "turn", "assistant", "event.event", "event.turn_number", "event.replacement")


def question_payloads(spark, sf_dir):
    """What an interviewer model is told about a slot: all fields, with sorted keys."""
    context = F.create_map(F.lit("target_column"), "p_brand", F.lit("frequency"), F.lit("week"))
    payload = sft.question_payload(F.col("p_type"), F.lit("missing"), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")), context, F.when(F.col("p_size") % 3 == 0, F.array(F.lit("a"), F.lit("b"))), F.concat(F.lit("What of "), "p_brand", F.lit("?")))
    return _read(spark, sf_dir, "part").select("p_partkey", payload.alias("payload"))


def cached_answers(spark, sf_dir):
    """A model asked once for each language and source, again by a second run that finds all but failures in the store."""
    store, docs = _folder(spark, "answers"), _read(spark, sf_dir, "documents").select("doc_id", "lang", "source")

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        if (frame["source"] == "src3").any():
            raise ValueError("secret")
        return pd.DataFrame({"answer": frame["lang"] + ":" + frame["source"]})

    def gone(frame: pd.DataFrame) -> pd.DataFrame:
        raise TimeoutError("secret")

    for one in (model, gone):
        found = readers.answered(docs, ["lang", "source"], one, "answer string", store, tries=2, wait=0.001)
    return found.select("doc_id", "answer", "error")


def chat_token_lengths(spark, sf_dir):
    """Tokens of each conversation in a chat template, by a public byte-level tokenizer: tokens, with the template's, and those of the longest turn."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def make():
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # its batches would make a task of a thread pool, some 2 KB, for each piece
        return lambda pieces: [len(encoding.encode_ordinary(p)) for p in pieces]

    own = text.piece_lengths(make, pattern)(F.col("text"))
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "role", own.alias("n"))
    sized = turns.withColumn("total", text.message_length(F.col("role"), F.col("n"), {"system": 3, "user": 4, "assistant": 5}))
    return sized.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("n").alias("tokens"), F.sum("total").alias("template_tokens"), F.max("n").alias("longest"))


def final_slots(spark, sf_dir):
    """Slots of a final state that have a value and were mentioned."""
    slot = lambda name, value, status: F.struct(F.lit(name).alias("slot_id"), value.cast("string").alias("value"), status.alias("status"))
    states = F.array(slot("quality", F.col("quality"), F.lit("provided")), slot("toxic", F.when(F.col("toxic") == 1, F.col("toxic")), F.lit("provided")), slot("id", F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, "unmentioned").otherwise("confirmed")))
    got = conversation.stated_slots(states)
    return _read(spark, sf_dir, "labels").select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(got), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("slots"))


def underrepresented_sources(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    toxic = docs.join(_read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("source")
    counts = toxic.groupBy("source").agg(F.count("*").alias("n"))
    return compare.underrepresented(counts, docs.select("source"), 5, "source")


def relevant_questions(spark, sf_dir):
    """Whether a line about a part concerns its type."""
    return _read(spark, sf_dir, "part").select("p_partkey", text.slot_relevance(F.concat(F.lit("Is it "), "p_name", F.lit("?")), F.lit("part_color"), F.lit("the name of a plant"), F.lower("p_type")).alias("relevant"))


def stamped_names(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", text.stamped_name(F.concat_ws("/", "event_type", "user_id"), F.col("ts"), ".json").alias("name"))


MORE = {
    f.__name__: f
    for f in (
        jsonl_roundtrip, jsonl_tree, text_fingerprints, streamed_evaluation, named_splits_scan, json_array_scan, key_value_scan, config_scan, prior_reports, model_answers, csv_review, report_roundtrip, checkpoint_listing, artifact_chain, run_manifest_lengths,
        cluster_messages, targeted_messages, scenario_messages, chat_questions, paraphrased_records, extended_validation, conversational_expectations, length_gate, normalized_values, routed_extractions, duration_forms, stated_intents, cleaned_updates, prevented_repeats, question_payloads, cached_answers, chat_token_lengths, final_slots, underrepresented_sources,
        relevant_questions, stamped_names,
    )
}


# SQL


_CLEAR = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def _text(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _formatted(template: str, known: dict[str, str]) -> str:
    """SQL for a template whose fields are SQL expressions or columns of the domains."""
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        parts += [_text(literal)] * bool(literal) + [f"({known.get(field, field)})"] * bool(field)
    return " || ".join(parts) or "''"


_DOMAIN = f"""grouped as (select (doc_id % {DOMAINS})::int as i, count(*) as c, coalesce(sum(n_chars), 0)::bigint as t from documents where doc_id is not null group by 1),
dom as (select a.i as domain_index, 'series_' || lpad(a.i::varchar, 2, '0') as slug, 'value_' || lpad(a.i::varchar, 2, '0') || '_' || a.c as target_column, 'demand of region ' || lpad(a.i::varchar, 2, '0') || '-' || a.c as target_description,
  'unit ' || a.t % 5 as unit, u || '_start' as time_column, f as frequency, u as frequency_unit, p || ' ' || u || 's' as horizon, p as horizon_periods, 'series_' || lpad(a.i::varchar, 2, '0') || '.csv' as source,
  'planning of depot ' || a.t % 9 as business_goal, 'MAE below ' || 5 + a.c % 40 || ' percent' as success_criteria, case when a.t % 8 = 7 then 'smape' else 'mae' end as primary_metric,
  'demand of region ' || lpad(b.i::varchar, 2, '0') || '-' || b.c as next_target_description,
  case when a.i < 14 or a.i between 20 and 26 then 'train' when a.i < 17 or a.i between 27 and 29 then 'validation' else 'test' end as split
  from (select *, ['daily', 'weekly', 'monthly', 'quarterly'][i % 4 + 1] as f, ['day', 'week', 'month', 'quarter'][i % 4 + 1] as u, 4 + 3 * (t % 7) as p from grouped) a left join grouped b on (a.i + 1) % 20 = b.i)"""
_EACH, _HORIZON = "'1 ' || frequency_unit", "horizon_periods || ' ' || frequency_unit || case when horizon_periods <> 1 then 's' else '' end"
_SAID = {
    "intent": "'create_forecast'", "problem_statement": "'forecast ' || target_description", "business_goal": "business_goal", "success_criteria": "success_criteria", "target_column": "target_column",
    "target_description": "target_description", "target_unit": "unit", "time_column": "time_column", "frequency": _EACH, "forecast_horizon": _HORIZON, "dataset_type": "'single_series'", "source_mode": "'upload'",
    "source_reference": "source", "file_format": "'csv'", "forecast_type": "'point'", "output_granularity": _EACH, "primary_metric": "primary_metric", "contains_sensitive_data": "'no'",
}
_SPAN = "'{\"periods\": ' || %s || ', \"unit\": \"' || frequency_unit || '\"}'"
_VALUE = {s: f"'\"' || {x} || '\"'" for s, x in _SAID.items()} | {"frequency": _SPAN % "1", "output_granularity": _SPAN % "1", "forecast_horizon": _SPAN % "horizon_periods", "contains_sensitive_data": "'false'"}


def _clusters() -> str:
    rows = []
    for name, slots, template in catalog.CLUSTERS:
        updates = " || '|' || ".join(f"'{s}=' || {_VALUE[s]}" for s in slots)
        rows.append(f"select 'cluster-{name}-' || slug as scenario_id, split, {_formatted(template, {s: _SAID[s] for s in slots})} as message, {updates} as updates, true as grounded from dom where split <> 'test'")
    return f"with {_DOMAIN} " + " union all ".join(rows)


def _targeted() -> str:
    rows = []
    for k, slot in enumerate(catalog.REQUIRED):
        said, value = _SAID[slot], _VALUE[slot]
        short = "'yes'" if slot == "intent" else "'uploaded'" if slot == "source_mode" else said
        answers = [("short", short, None), ("sentence", _formatted(catalog.SENTENCES.get(slot, catalog.SENTENCE), {"value": said}), None), ("roman_urdu", _formatted(catalog.ROMAN_URDU.get(slot, catalog.ROMAN_URDU_ANY), {"value": said}), None)]
        if slot in catalog.MULTI:
            answers.append(("multi_slot", _formatted(catalog.MULTI[slot][0], {"value": said}), catalog.MULTI[slot][1]))
        answers.append(("non_answer", f"[{', '.join(map(_text, catalog.NON_ANSWERS))}][(domain_index + {k}) % {len(catalog.NON_ANSWERS)} + 1]", None))
        for name, message, other in answers:
            updates = "''" if name == "non_answer" else f"'{slot}=' || {value}"
            if other:
                updates += f" || case when contains(lower({message}), lower({_SAID[other]})) then '|{other}=' || {_VALUE[other]} else '' end"
            intent = "ambiguous" if name == "non_answer" and slot == "intent" else "create_forecast"
            rows.append(f"select 'targeted-{slot}-' || slug as scenario_id, split, 'selected_{name}' as variant, '{slot}' as selected, {message} as message, '{intent}' as intent, {updates} as updates, '{'|'.join(sorted(s for s in catalog.REQUIRED if s != slot))}' as confirmed, '{'|'.join(catalog.REQUIRED)}' as definitions from dom where split <> 'test'")
    return f"with {_DOMAIN} " + " union all ".join(rows)


def _question(slot: str | None) -> str:
    if slot is None:
        return "null::varchar"
    return _formatted(corpus._PERSONAL.get(slot, next((s[4] for s in catalog.SLOTS if s[0] == slot), "")), {})


def _scenarios(names: list[str], patterns: bool, columns: str, asking: bool = False) -> str:
    rows = []
    for name in names:
        spec = corpus.CATEGORIES[name]
        message = _formatted(spec["message"], {"METRIC": "upper(primary_metric)"})
        intent = "'create_forecast'"
        if name == "intent_boundary":
            message, intent = f"case when domain_index % 2 = 1 then {message} else {_text(spec['even'])} end", "case when domain_index % 2 = 1 then 'not_forecasting' else 'unsupported' end"
        states = list(_SAID) if name == "complete" else [*spec.get("states", corpus._STATED), *([spec["unclear"][0]] if "unclear" in spec else [])]
        asks = spec.get("asks")
        tags = sorted({*corpus.TAGS, *spec.get("tags", ())})
        rows.append((f"'{name}-' || slug", name, message, intent, states, asks, _question(asks), 2 if name == "correction" else 1, f"domain_index < {DOMAINS}", tags))
    for name, (template, intent, states, answers) in corpus.PATTERNS.items() if patterns else ():
        after = next((s for s in catalog.REQUIRED if s not in states), None) if intent == "create_forecast" else None
        question = _text(next(s[4] for s in catalog.SLOTS if s[0] == after)) if after else "null::varchar"
        rows.append((f"'conversation-{name}-' || slug", "conversational_intent", _formatted(template, {}), f"'{intent}'", list(states), after, question, 1, "domain_index < 20", sorted(["conversational_intent", "multi_turn_context" if answers else "short_request", "no_invention", "state_progression"])))
    out = []
    for id_, name, message, intent, states, asks, question, turns, where, tags in rows:
        if asks or not asking:
            out.append(f"select {id_} as scenario_id, split, '{name}' as category, {message} as message, {intent} as gold_intent, '{'|'.join(states)}' as slots, {question} as ideal_question, {turns}::int as turns, {_text(asks) if asks else 'null'} as slot_id, domain_index, '{corpus.VERSION.format('v4')}' as corpus_version, '{'|'.join(tags)}' as tags from dom where {where}")
    return f"with {_DOMAIN}, s as ({' union all '.join(out)}) select {columns} from s"


_SPLITS = "sd as (select *, case when cast(substr(source, 4) as int) < 14 then 'train' when cast(substr(source, 4) as int) < 17 then 'validation' else 'test' end as split from documents)"
_WORDS = "list_filter(list_transform(regexp_split_to_array({0}, '\\s+'), lambda w: trim(lower(w), '?.,')), lambda w: length(w) >= 4)"
_EXPECTED = ["size", "no test split", "extraction only", "prompt roles", "completion roles", "grounded evidence", "selected slot", "no exact duplicates", "required slots covered", "at least 100 positives a slot", "all variants"]

MORE_SQL = {
    "jsonl_roundtrip": """select doc_id, nullif(lang, 'es') as lang, sha256(text) as sha256, n_chars, '{"counts":{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '},"doc_id":' || doc_id || ',"lang":' || coalesce('"' || nullif(lang, 'es') || '"', 'null') as head, false as corrupt from documents""",
    "jsonl_tree": """with l as (select ('0x' || sha256(doc_id::varchar)[1:8])::bigint % 256 as leaf, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || nullif(lang, 'es') || '"', 'null') || ',"n_chars":' || n_chars || '}') as h from documents),
t0 as (select 0 as level, leaf as node, count(*) as n, sha256(count(*) || ':' || sum(('0x' || h[1:15])::hugeint)::varchar || ':' || sum(('0x' || h[17:31])::hugeint)::varchar || ':' || sum(('0x' || h[33:47])::hugeint)::varchar || ':' || sum(('0x' || h[49:63])::hugeint)::varchar) as digest from l group by leaf),
t1 as (select 1 as level, node // 16 as node, sum(n) as n, sha256(string_agg(node || '=' || digest, ',' order by node)) as digest from t0 group by node // 16),
t2 as (select 2 as level, 0 as node, sum(n) as n, sha256(string_agg(node || '=' || digest, ',' order by node)) as digest from t1)
select level, node::int as node, n::bigint as n, digest from (select * from t0 union all select * from t1 union all select * from t2)""",
    "text_fingerprints": "select source, (65 * count(*))::bigint as bytes, sha256(string_agg(sha256(text) || chr(10), '' order by doc_id)) as sha256 from documents group by source",
    "streamed_evaluation": "select event_id, event_type, round_even(value * 2, 1) as score from events",
    "named_splits_scan": f"with {_SPLITS} select split, count(*) as n, sum(n_chars)::bigint as chars, 0::bigint as corrupt from sd group by 1",
    "json_array_scan": "select n_nationkey::bigint as n_nationkey, n_name from nation",
    "key_value_scan": "select lower(n_name) as key, 'a=' || n_nationkey as value from nation",
    "config_scan": "select doc_id, n_chars from documents where lang = 'de' and n_chars >= 500",
    "prior_reports": "select doc_id from documents where doc_id not in (select doc_id from labels where quality = 1)",
    "model_answers": "select doc_id, case when doc_id % 7 <> 0 then n_chars * 2 end::bigint as answer, case when doc_id % 7 = 0 then 'ValueError' end as error from documents",
    "csv_review": "select doc_id, source, n_chars, null::varchar as grade, null::varchar as notes from documents",
    "report_roundtrip": "select lang, count(*) as n, (select count(*) from documents) as documents, (select sum(n_chars)::bigint from documents) as chars from documents group by 1",
    "checkpoint_listing": "select (10 * max(r_regionkey) + 5)::bigint as step from region",
    "artifact_chain": f"with {_SPLITS}, c as (select sha256(text) as name, list_sort(list_distinct(list(split))) as s from sd group by 1) select 'gone.jsonl' as name, 'missing' as problem union all select 'short', 'violations: ' || count(*) from documents where not coalesce(n_chars <= 2000, false) having count(*) > 0 union all select 'has text', 'violations: ' || count(*) from documents where not coalesce(text <> '', false) having count(*) > 0 union all select name, 'splits: ' || array_to_string(s, ', ') from c where len(s) > 1",
    "run_manifest_lengths": f"with {_SPLITS}, t as (select split, case when text is null then 0 else len(string_split(text, ' ')) end as n from sd) select split, max(n)::bigint as longest, count(*) as n, count(*) filter (n > 500) as over_limit, min(n)::bigint as shortest, sum(n)::bigint as total from t group by 1",
    "cluster_messages": _clusters(),
    "targeted_messages": _targeted(),
    "scenario_messages": _scenarios(list(corpus.CATEGORIES), True, "scenario_id, split, category, message, gold_intent, corpus_version, tags, slots, ideal_question, turns"),
    "chat_questions": _scenarios(list(corpus.CATEGORIES), True, "scenario_id, split, slot_id, ideal_question as question", True) + " where split <> 'test' and domain_index < 20",
    "paraphrased_records": f"with {_DOMAIN}, s as (select slug, {_formatted(corpus.CATEGORIES['missing_required']['message'], {})} as m from dom where split <> 'test') select 'missing_required-' || slug as scenario_id, 'paraphrase_' || k as variant, case when k = 1 then 'Please: ' || m else m || ' Thanks.' end as message, {len(corpus.CATEGORIES['missing_required']['states'])}::int as n, true as grounded from s, (select unnest([1, 2]) as k)",
    "conversational_expectations": f"""with g as (select distinct doc_id % {DOMAINS} as i from documents where doc_id % {DOMAINS} < 20), k as (select count(*) as domains, count(*) filter (i < 14 or i > 16) as left_ from g),
n as (select unnest(['known gold slots', 'known forbidden slots', 'known question slot', 'one question mark', 'grounded evidence', 'size', 'unique ids', 'disjoint domains', 'category counts', 'split counts', 'conversational tag', 'final slots are stated', 'asks what is missing']) as name)
select name, 'sound' as which, case when name in ('size', 'category counts', 'split counts') then 16 * (20 - domains) else 0 end::bigint as violations from n, k
union all select name, 'spoiled', case name when 'size' then 320 - 15 * left_ when 'category counts' then 320 - 15 * left_ when 'split counts' then 320 - 15 * left_ else 0 end::bigint from n, k""",
    "extended_validation": f"with n as (select unnest({_EXPECTED}) as name), d as (select count(*) as train from (select distinct doc_id % {DOMAINS} as i from documents) where i < 17 or i between 20 and 29) select name, 'sound' as which, 0::bigint as violations from n union all select name, 'spoiled', case name when 'size' then 20 when 'no test split' then {len(catalog.CLUSTERS)} * train + 1 when 'no exact duplicates' then 1 when 'required slots covered' then {len(catalog.REQUIRED)} when 'all variants' then 1 else 0 end::bigint from n, d",
    "length_gate": f"with {_SPLITS} select split, count(*) as n, min(length(text))::int as shortest, max(length(text))::int as longest, sum(length(text))::bigint as total, count(*) filter (length(text) > 2000) as over_limit from sd group by 1",
    "normalized_values": f"with v as (select o_orderkey, o_orderkey % 6 as k, o_custkey % 9 as n, strftime(o_orderdate::date, '%Y-%m-%d') as d, o_orderstatus, o_orderpriority from orders) select o_orderkey, case k when 0 then case n % 3 when 0 then 'true' when 1 then 'false' end when 1 then case when n > 2 then '\"' || d || '\"' end when 2 then case when n > 1 then '{{\"periods\": ' || n || ', \"unit\": \"week\"}}' end when 3 then case when n > 3 then '\"Asia/Karachi\"' end when 4 then case when lower(o_orderstatus) in ('o', 'f') then '\"' || lower(o_orderstatus) || '\"' end else '\"' || trim(o_orderpriority || ' \\\"q\\\"') || '\"' end as value from v",
    "routed_extractions": """with v as (select *, turn % 8 as k from conversations), m as (select *, case when k in (4, 5) then 'please predict ' || text else text || ' is what I need from you' end as m from v),
c as (select *, 'business_goal=' || sha256(m) || '|frequency={"periods": 1, "unit": "day"}' as clean from m)
select conv_id, turn, case when k = 1 then 'not_forecasting' else 'create_forecast' end as intent,
case k when 0 then 'intent' when 1 then 'intent' when 2 then 'short answer' when 3 then 'recovered answer' when 4 then 'intent put right' when 5 then 'recovery' when 6 then 'error' else 'model' end as route,
case k when 0 then 'intent="create_forecast"' when 1 then '' when 2 then 'target_column="btc_usd"' when 3 then 'target_column="correction weekly"' when 4 then 'intent="create_forecast"|' || clean when 5 then 'intent="create_forecast"' when 6 then '' else clean end as updates from c""",
    "duration_forms": f"""with v as (select event_id, event_id % 9 as k, event_id % 7 + 1 as n, [{', '.join(_text(canonical.UNITS[u]) for u in sorted(canonical.UNITS))}][event_id // 9 % {len(canonical.UNITS)} + 1] as u from events)
select event_id, case k when 0 then n when 1 then n + 0.5 when 2 then 1 when 3 then n when 4 then n when 5 then 1 when 7 then 3 when 8 then 1 end::double as periods, case k when 4 then 'month' when 6 then null when 7 then 'day' when 8 then 'fortnight' else u end as unit from v""",
    "stated_intents": f"""with v as (select *, unnest(regexp_split_to_array(text, '[.,\\n]')) as m, generate_subscripts(regexp_split_to_array(text, '[.,\\n]'), 1) - 1 as part from conversations), k as (select *, (part + turn) % 6 as k, {_CLEAR.format('m')} as plain from v),
c as (select *, plain in ({', '.join(map(_text, guardrails.NO))}) or regexp_matches(plain, '\\b(?:do not|dont|don t|not) (?:want )?(?:a )?forecast\\b') as refuses, plain in ({', '.join(map(_text, guardrails.YES))}) or regexp_matches(plain, '\\b(?:forecast|forecasting|predict|prediction)\\b') as asks from k)
select conv_id, turn, part::int as part, case when k = 4 or k = 2 or (k in (0, 1, 5) and regexp_matches(plain, '\\b(?:do not|dont|don t|not) (?:want )?(?:a )?forecast\\b')) or (k = 0 and refuses) then 'not_forecasting' when k in (1, 3, 5) or asks then 'create_forecast' end as intent,
case k when 0 then true when 1 then false when 2 then true else plain in ({', '.join(map(_text, guardrails.LOW_INFORMATION['problem_statement']))}) end as drops from c""",
    "cleaned_updates": """with v as (select *, case when turn % 2 = 0 then 'next 6 months about ' else 'about ' end || text as m from conversations),
u as (select *, ['frequency={"periods": 1, "unit": "week"}@' || trim(m), case when turn % 2 = 0 then 'frequency={"periods": 6, "unit": "month"}@' end, 'target_column={"a":2,"b":1}@' || trim(m), case when turn % 2 = 0 then 'forecast_horizon={"periods": ' || (length(text) % 9 + 1) || ', "unit": "month"}@' end] as own from v)
select conv_id, turn, case when turn % 2 = 0 then 4 else 2 end::int as n, sha256(array_to_string(list_filter(own, lambda x: x is not null), '|')) as updates_sha256 from u""",
    "prevented_repeats": f"""with v as (select *, 'What next ' || (turn // 3) || '?' as q, turn % 4 as k, role || chr(39) || 's choice' as label from conversations),
r as (select *, q is not distinct from lag(q) over (partition by conv_id order by turn) as again from v), i as (select *, sum(case when again then 0 else 1 end) over (partition by conv_id order by turn) as run from r),
p as (select *, again and row_number() over (partition by conv_id, run order by turn) % 2 = 0 as prevented from i),
t as (select *, case k when 0 then {_text(guardrails.RESTATE)} when 1 then {_text(guardrails.RESTATE_INTENT)} when 2 then 'I could not record ' || label || '. Please choose one of: upload, link.' else 'I could not reliably record ' || label || '. Please answer in one short phrase.' end as text_ from p)
select conv_id, turn, case when prevented then text_ else q end as assistant, case when prevented then 'repeated_question_prevented' end as event, case when prevented then turn end as turn_number, case when prevented then text_ end as replacement from t""",
    "question_payloads": """select p_partkey, '{"allowed_values": ' || case when p_size % 3 = 0 then '["a", "b"]' else '[]' end || ', "confirmed_context": {"frequency": "week", "target_column": "' || p_brand || '"}, "current_value": ' || case when p_size % 2 = 0 then '"' || p_size || '"' else 'null' end
|| ', "fallback_wording": "What of ' || p_brand || '?", "reason": "missing", "selected_slot": "' || p_type || '", "slot_description": "' || p_name || '"}' as payload from part""",
    "cached_answers": "select doc_id, case when source <> 'src3' then lang || ':' || source end as answer, case when source = 'src3' then 'TimeoutError' end as error from documents",
    "final_slots": "select doc_id, array_to_string(list_filter([case when doc_id % 2 <> 0 then 'id=' || doc_id end, 'quality=' || quality, case when toxic = 1 then 'toxic=1' end], lambda x: x is not null), '|') as slots from labels",
    "underrepresented_sources": "select d.source, count(l.doc_id) as n from documents d left join labels l on l.doc_id = d.doc_id and l.toxic = 1 group by 1 having count(l.doc_id) < 5",
    "relevant_questions": f"select p_partkey, len(list_intersect(list_transform(regexp_split_to_array('Is it ' || p_name || '?', '\\s+'), lambda w: trim(lower(w), '?.,')), list_concat(['part', 'color', 'name', 'plant'], {_WORDS.format('lower(p_type)')}))) > 0 as relevant from part",
    "stamped_names": "select event_id, regexp_replace(event_type || '/' || user_id, '[^A-Za-z0-9._-]', '-', 'g') || '-' || strftime(ts, '%Y%m%d-%H%M%S') || '.json' as name from events",
}
