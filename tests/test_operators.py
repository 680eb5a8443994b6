import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import guardrails, text
from corpusmill.operators import compare, conversation, dedup, scoring
from corpusmill.sources import readers, sinks
from corpusmill.streaming import incremental

UPDATE = "call int, slot_id string, value string, status string, pos int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_update_counts(spark):
    expected = spark.createDataFrame([(1, "a", "1", "p", 0), (1, "a", "1", "p", 1), (1, "b", "2", "p", 0), (2, "c", "3", "p", 0), (3, "d", "1", "p", 0), (3, "d", "2", "p", 1)], UPDATE)
    predicted = spark.createDataFrame([(1, "a", "1", "p", 0), (1, "x", "9", "p", 0), (2, "c", "4", "p", 0), (3, "d", "2", "p", 0)], UPDATE)
    got = scoring.update_counts(expected, predicted, ["call"])
    assert rows(got.select("call", *scoring.COUNTS)) == [(1, 1, 1, 1, 1, 1, 1, 1, 1), (2, 0, 1, 1, 1, 0, 0, 1, 0), (3, 1, 0, 1, 1, 0, 0, 1, 1)]


def record(spark, **changes):
    base = {"category": "c", "task": "extract", "predicted_ok": True, "tp": 1, "fp": 0, "fn": 0, "id_tp": 1, "id_fp": 0, "id_fn": 0, "matched": 1, "matched_correct": 1, "n_expected": 1, "n_predicted": 1, "latency_ms": 5.0, "intent": True, "joint_extraction": True, "correction": True, "has_forbidden_contract": False, "avoids_forbidden_slots": True}
    questions = {"question_contract": True, "one_question": True, "slot_relevance": True, "question_exact_match": True, "question_content_match": True, "question_content_token_f1": 1.0}
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in (base | questions).items())
    return spark.createDataFrame([tuple((base | dict.fromkeys(questions) | changes).values())], kinds)


def test_component_metrics(spark):
    ask = record(spark, task="ask", question_contract=True, one_question=True, slot_relevance=True, question_exact_match=True, question_content_match=True, question_content_token_f1=1.0, n_expected=0)
    perfect = record(spark).unionByName(ask)
    got = {r["category"]: r for r in scoring.component_metrics(perfect).collect()}
    assert set(got) == {None, "c"}
    for name in ("intent_accuracy", "slot_micro_f1", "slot_id_micro_f1", "nonempty_update_accuracy", "question_content_token_f1", "provider_success_rate"):
        assert got[None][name] == 1.0
    assert got[None]["empty_update_collapse_rate"] == 0.0
    empty = scoring.component_metrics(record(spark, tp=0, fn=1, id_tp=0, id_fn=1, matched=0, matched_correct=0, n_predicted=0)).first()
    assert (empty["nonempty_update_accuracy"], empty["empty_update_collapse_rate"], empty["slot_id_micro_recall"]) == (0.0, 1.0, 0.0)
    failed = scoring.component_metrics(record(spark, predicted_ok=False, n_predicted=0, fn=1)).first()
    assert failed["provider_success_rate"] == 0.0 and failed["forbidden_slot_inference_rate"] == 0.0


def test_latency_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "k string, v double")
    assert rows(scoring.latency_summary(df, "v", ["k"])) == [("a", 4, 2.5, 2.5, 4.0), (None, 4, 2.5, 2.5, 4.0)]


def test_extraction_checks(spark):
    kind = "struct<intent:string,correction_detected:boolean,updates:array<struct<slot_id:string,value:string,status:string>>>"
    some = [("a", "1", "p"), ("b", "2", "p")]
    df = spark.createDataFrame([(("x", False, some), ("x", False, some[::-1] + some[:1]), ["z"]), (("x", False, some), ("y", True, some[:1]), ["a"])], f"e {kind}, p {kind}, f array<string>")
    assert [tuple(r[0]) for r in df.select(scoring.extraction_checks(F.col("e"), F.col("p"), F.col("f"))).collect()] == [(True, True, True, True, True), (False, False, False, True, False)]


def test_conversations(spark):
    turns = spark.createDataFrame([("c", 1, "What? ", 1, "x"), ("c", 2, "What?", 1, "x"), ("c", 3, "", 2, "x"), ("c", 4, "", 2, "y"), ("d", 1, None, 0, None)], "case_id string, turn int, assistant string, mentioned int, intent string")
    marked = conversation.annotated_turns(turns)
    assert rows(marked.select("case_id", "turn", "repeated_previous_question", "state_progressed")) == [("c", 1, False, True), ("c", 2, True, False), ("c", 3, False, True), ("c", 4, False, True), ("d", 1, False, False)]
    assert tuple(conversation.turn_metrics(marked).first()) == (0.6, 0.4, 0.3333, 2.5, 2, 5)
    asked = conversation.last_question(turns, "case_id", "turn", "assistant")
    assert [r[0] for r in asked.where("case_id = 'c'").orderBy("turn").select("last_question").collect()] == [None, "What? ", "What?", "What?"]


def test_state_metrics(spark):
    expected = spark.createDataFrame([(0, "intent", '"x"')], "record int, slot_id string, value string")
    final = spark.createDataFrame([(0, "intent", '"x"'), (0, "target_column", '"invented"')], "record int, slot_id string, value string")
    assert tuple(conversation.state_metrics(expected, final).first()) == (0.5, 1.0, 0.6667, 0.5, 1.0, 0.6667, 0.5)
    assert set(conversation.state_metrics(expected.limit(0), final.limit(0)).first()) == {0.0}


def test_traces(spark):
    kind = "traces array<struct<operation:string,parsed:boolean>>"
    df = spark.createDataFrame([([("extract", True), ("ask", False)],), ([("deterministic_slot", True)],), ([],)], kind)
    assert tuple(conversation.trace_metrics(df).first()) == (0.5, 2, 0.3333)
    assert tuple(conversation.trace_metrics(df.limit(0)).first()) == (None, 0, 0.0)


def test_comparison(spark):
    a = spark.createDataFrame([("intent_accuracy", 0.9), ("stalled_turn_rate", 0.2), ("same", 0.5), ("gone", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("intent_accuracy", 0.8), ("stalled_turn_rate", 0.1), ("same", 0.5)], "metric string, value double")
    assert rows(compare.compared(a, b, "x", "y")) == [("gone", 1.0, None, None, "unavailable"), ("intent_accuracy", 0.9, 0.8, 0.1, "x"), ("same", 0.5, 0.5, 0.0, "tie"), ("stalled_turn_rate", 0.2, 0.1, 0.1, "y")]
    assert rows(compare.compared(a, b, "x", "y", metrics=["none"])) == [("none", None, None, None, "unavailable")]


def test_resume_and_sampling(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "case_id int")
    assert rows(compare.pending(ids(1, 2, 3), [ids(1, 2), ids(2, 3)])) == [(1,), (3,)]
    assert rows(compare.sampled(ids(*range(9)), "case_id", 2, 3)) == [(2,), (3,), (4,)]
    assert rows(compare.sampled(ids(*range(9)), "case_id", 5, 1, [7, 1])) == [(1,)]
    paths = spark.createDataFrame([("o/checkpoint-9",), ("o/checkpoint-68",), ("o/checkpoint-x",), ("o/other-99",)], "path string")
    assert tuple(compare.latest_checkpoint(paths).first()) == ("o/checkpoint-68", 68)
    assert compare.latest_checkpoint(paths.limit(0)).collect() == []


def test_dedup(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), (None, 2, "b"), (None, 5, "d")], "key string, ord int, v string")
    assert rows(dedup.first_seen(df, F.coalesce("key", F.lit("")), ["ord"])) == [("k", 1, "a"), (None, 2, "b")]
    runs = spark.createDataFrame([(1, i, v, f"e{i}") for i, v in enumerate(["x", "x", None, None, "x"])], "d int, t int, v string, e string")
    assert [r["original_evidence"] for r in dedup.carried_forward(runs, ["d"], "t", "v", "e").orderBy("t").collect()] == ["e0", "e0", "e2", "e2", "e4"]
    two = df.select("key")
    assert rows(dedup.multiset_difference(two, two.limit(3).unionByName(two.limit(0)))) != [] and dedup.multiset_difference(two, two).collect() == []


def test_containing(spark):
    texts = [(1, "bathe cats sit here."), (2, "the cat sits"), (3, "x (a) y"), (4, None), (5, "")]
    phrases = [(1, "the cat"), (2, "the cats sit her"), (3, "(a)"), (4, None), (5, ""), (6, "cat sits"), (7, "the  cat sits"), (8, "y"), (9, ") "), (10, "ts"), (11, "x (a) y z")]
    got = dedup.containing(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(phrases, "i int, p string"), "k", "t", "i", "p")
    assert rows(got) == sorted(((k, i) for k, t in texts for i, p in phrases if t is not None and p is not None and p in t), key=str)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "prompt": "é"}\n\nnot json\n{"id": "2", "must_contain": ["x"], "other": 1}\n', encoding="utf-8")
    got = readers.jsonl(spark, str(tmp_path / "a.jsonl"), readers.CASE).collect()
    assert [(r["id"], r["_corrupt_record"]) for r in got] == [("1", None), (None, "not json"), ("2", None)]
    (tmp_path / "b.json").write_text('[{"case_id": "x", "messages": ["a"]}]')
    assert readers.json_array(spark, str(tmp_path / "b.json"), readers.CONVERSATION_CASE).first()["messages"] == ["a"]
    assert readers.reports(spark, str(tmp_path / "none.json"), "case_id string").collect() == []
    (tmp_path / "env").write_text("# no\nKey = \"a=b\"\nnothing\n\nTWO='x'\n")
    assert rows(readers.key_values(spark, str(tmp_path / "env"))) == [("key", "a=b"), ("two", "x")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", (2, "é"), "train"), ("a", (1, "x"), "test")], "id string, s struct<z:int,a:string>, split string")
    for name in ("one", "two"):
        sinks.write_jsonl(df, str(tmp_path / name), ["id"], files=1)
    one, two = (next((tmp_path / n).glob("part-*")).read_text(encoding="utf-8") for n in ("one", "two"))
    assert one == two and [json.loads(x) for x in one.splitlines()] == [{"id": "a", "s": {"a": "x", "z": 1}, "split": "test"}, {"id": "b", "s": {"a": "é", "z": 2}, "split": "train"}]
    assert one.startswith('{"id":"a","s":{"a":"x","z":1}')
    sinks.write_splits(df, str(tmp_path / "splits"))
    assert sorted(p.name for p in (tmp_path / "splits").glob("split=*")) == ["split=test", "split=train"]
    files = readers.fingerprints(spark, str(tmp_path / "one"), "part-*")
    made = {r["what"]: json.loads(r["json"]) for r in sinks.manifest(df, "v", ["split"], files).collect()}
    assert made["count"] == 2 and made["split_counts"] == {"test": 1, "train": 1} and len(made["files"]) == 1
    assert sinks.verified(files.select("name", "sha256"), files).collect() == []
    wrong = files.select("name", F.lit("0").alias("sha256")).unionByName(spark.createDataFrame([("gone", "1")], "name string, sha256 string"))
    assert sorted(r["problem"] for r in sinks.verified(wrong, files).collect()) == ["checksum", "missing"]
    assert sinks.content_digest(df).first() == sinks.content_digest(df.repartition(3)).first()
    sinks.write_csv(df.select("id"), str(tmp_path / "csv"), ["grade"])
    assert next((tmp_path / "csv").glob("part-*")).read_text().splitlines()[0] == "id,grade"


def test_stream_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    score = lambda df: df.select("case_id", F.length("prompt").alias("n"))
    for k, lines in enumerate((["a", "b", "a"], ["b", "c"])):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"case_id": x, "prompt": x * 3}) + "\n" for x in lines))
        query = incremental.evaluated_stream(spark, source, "case_id string, prompt string", score, out, state)
        query.awaitTermination()
    assert rows(spark.read.parquet(out).select("case_id", "n")) == [("a", 3), ("b", 3), ("c", 3)]


def test_dialogue_state(spark):
    log = spark.createDataFrame([("d", "x", "1", "provided", 1), ("d", "x", "2", "confirmed", 3), ("d", "y", "5", "provided", 2)], "dialogue_id string, slot_id string, value string, status string, turn int")
    assert rows(incremental.dialogue_state(log)) == [("d", "x", "2", "confirmed", 3), ("d", "y", "5", "provided", 2)]


@pytest.mark.parametrize("n", [20])
def test_ring(spark, n):
    df = spark.range(25).select(F.col("id").cast("int").alias("i"), F.col("id").cast("string").alias("s"))
    got = {r["i"]: r["next_s"] for r in compare.successor(df, "i", n, ["s"]).collect()}
    assert got[0] == "1" and got[19] == "0" and got[22] == "3"


def test_settings_and_forms(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"url": "x", "n": 1}')
    path = str(tmp_path / "c.json")
    assert readers.config(spark, path, {"url": str, "n": int}) == {"url": "x", "n": 1}
    for known in ({"url": str}, {"url": str, "n": str}):
        with pytest.raises(ValueError):
            readers.config(spark, path, known)
    m = [("system", "s"), ("user", "u"), ("assistant", "a")]
    df = spark.createDataFrame([(None, None, m, None), (m[:2], m[2:], None, None)], readers.RECORD)
    assert len({str(r) for r in readers.prompt_completion(df).collect()}) == 1


def test_limits(spark):
    df = spark.createDataFrame([("a", 3), ("b", 9)], "split string, n int")
    profile = compare.length_profile(df, F.col("n"), 5)
    with pytest.raises(ValueError, match="b: 1"):
        compare.within_limit(profile)
    assert compare.within_limit(profile, True).count() == 2 and compare.within_limit(profile.where("split = 'a'")).count() == 1
    keys = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    assert rows(compare.excluding(keys, "k", ["x"])) == [("y",), (None,)]


def test_reports_and_listings(spark, tmp_path):
    (tmp_path / "list.json").write_text('\n [{"case_id": "x"}, {"case_id": "y"}]')
    (tmp_path / "object.json").write_text('{"case_id": "x"}')
    (tmp_path / "empty.json").write_text("")
    got = {n: rows(readers.reports(spark, str(tmp_path / f"{n}.json"), "case_id string")) for n in ("list", "object", "empty", "gone")}
    assert got == {"list": [("x",), ("y",)], "object": [], "empty": [], "gone": []}
    for name in ("checkpoint-5", "checkpoint-40", "checkpoint-x", "checkpoint-7b", "other-90"):
        (tmp_path / "run" / name).mkdir(parents=True)
    (tmp_path / "run" / "checkpoint-99").write_text("a file")
    found = readers.checkpoints(spark, str(tmp_path / "run"))
    assert sorted(r["step"] for r in found.collect()) == [5, 40]
    assert compare.latest_checkpoint(found).first()["step"] == 40
    assert readers.checkpoints(spark, str(tmp_path / "none")).collect() == []


def test_model_errors_are_rows(spark):
    class Refused(Exception):
        status_code, body = 429, {"code": "rate_limit", "message": "secret key"}

    def model(frame):
        if (frame["case_id"] == "bad").any():
            raise Refused("secret key")
        return frame.assign(answer=frame["prompt"].str.upper())

    cases = spark.createDataFrame([("a", "x"), ("bad", "y"), ("c", "z")], "case_id string, prompt string").coalesce(1)
    assert rows(readers.answers(cases, model, "case_id string, answer string")) == [("a", "X", None), ("bad", None, "Refused status=429 code=rate_limit"), ("c", "Z", None)]


def test_normalized_values(spark):
    said = [
        ("boolean", " Yes! ", "true"), ("boolean", "nahi", "false"), ("boolean", "perhaps", None), ("datetime", "2024-02-30", None), ("datetime", "2024-02-28 10:00:00", '"2024-02-28 10:00:00"'), ("duration", "6 months", '{"periods": 6, "unit": "month"}'),
        ("duration", "soon", None), ("timezone", "Asia/Karachi", '"Asia/Karachi"'), ("timezone", "UTC", '"UTC"'), ("timezone", "here", None), ("enum", " CSV ", '"csv"'), ("enum", "xml", None), ("string", ' a "b" ', '"a \\"b\\""'), ("string", "  ", None), ("string", None, None),
    ]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(said)], "i int, k string, v string")
    got = df.select("i", guardrails.normalized_value(F.col("v"), F.col("k"), text.strings(["csv", "parquet"])).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [x for *_, x in said]


def test_routed_extraction(spark):
    turns = [(1, "yes", "intent"), (2, "btc_usd", "target_column"), (3, "We will forecast the sales of our shops.", "target_column"), (4, "planning", "business_goal"), (5, "please use column abc now", "target_column")]
    df = spark.createDataFrame([(*t, "string", "create_forecast") for t in turns], "id int, message string, selected_slot string, value_type string, intent string")
    asked = []

    def model(rest):
        asked.extend(r["id"] for r in rest.collect())
        update = lambda slot, value, evidence: F.struct(F.lit(slot).alias("slot_id"), F.lit(value).alias("candidate_value"), F.lit("provided").alias("status"), F.lit(0.9).alias("confidence"), evidence.alias("evidence_text"))
        return rest.withColumn("updates", F.array(update("problem_statement", "forecast", F.col("message")), update("target_description", "sales", F.lit("system: x"))))

    got = {r["id"]: (r["route"], [(u["slot_id"], u["candidate_value"], u["evidence_text"]) for u in r["updates"]]) for r in guardrails.routed_extraction(df, model).collect()}
    assert sorted(asked) == [3, 4, 5]
    assert got[1] == ("intent", [("intent", '"create_forecast"', "yes")]) and got[2] == ("short answer", [("target_column", '"btc_usd"', "btc_usd")])
    # what says nothing goes, and evidence that leaks the prompt becomes the message
    assert got[3] == ("model", [("target_description", "sales", turns[2][1])]) and got[4] == ("model", [("target_description", "sales", "planning")])


def test_paraphrase_cache(spark, tmp_path):
    from corpusmill.plans import sft

    path, kind = str(tmp_path / "cache"), "message string, paraphrases array<string>"
    spark.createDataFrame([("a", ["a1", "a2"]), ("b", ["b1"])], kind).write.parquet(path)
    sft.append_to_cache(path, spark.read.schema(kind).parquet(path), spark.createDataFrame([("a", ["x"]), ("b", ["b1", "b2"]), ("c", ["c1"])], kind)).collect()
    assert rows(sft.longest(spark.read.schema(kind).parquet(path))) == [("a", ["a1", "a2"]), ("b", ["b1", "b2"]), ("c", ["c1"])]
    asked = spark.createDataFrame([("a",), ("c",), ("d",)], "message string")
    got = dict(rows(sft.with_paraphrase_cache(asked, sft.longest(spark.read.schema(kind).parquet(path)), 2)))
    assert got == {"a": ["a1", "a2"], "c": ["c", "c"], "d": ["d", "d"]}


def test_manifests_and_gates(spark, tmp_path):
    df = spark.createDataFrame([("1", "train", "a b c"), ("2", "train", None), ("2", "test", "a b")], "scenario_id string, split string, text string")
    sized = df.withColumn("n", text.token_lengths(lambda: str.split)(F.col("text")))
    assert [r["n"] for r in sized.orderBy("scenario_id", "split").collect()] == [3, 2, 0]
    df.coalesce(1).write.json(str(tmp_path / "out"))
    files = readers.fingerprints(spark, str(tmp_path / "out"), "part-*")
    made = json.loads(sinks.run_manifest(files, compare.length_profile(sized, F.col("n"), 2), {"limit": 2}).first()["json"])
    assert made["token_lengths"]["train"] == {"longest": 3, "n": 2, "over_limit": 1, "shortest": 0, "total": 3} and len(made["files"]) == 1 and json.loads(made["settings"]) == {"limit": 2} and made["versions"]["spark"]
    with pytest.raises(ValueError, match="train: 1"):
        compare.within_limit(compare.length_profile(sized, F.col("n"), 2))
    violations = spark.createDataFrame([("fine", 0), ("bad", 2)], "name string, violations long")
    assert rows(sinks.artifact_problems(files.select("name", "sha256"), files, violations, df)) == [("2", "splits: test, train"), ("bad", "violations: 2")]
    counts, required = spark.createDataFrame([("a", 120), ("b", 99)], "slot_id string, n long"), spark.createDataFrame([("a",), ("b",), ("c",)], "slot_id string")
    assert rows(compare.underrepresented(counts, required)) == [("b", 99), ("c", 0)]


def test_placed_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert rows(compare.placed(df.repartition(7), "k")) == sorted(((i, i) for i in range(1000)), key=str)
