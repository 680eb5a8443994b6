import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import canonical, guardrails, text
from corpusmill.functions.canonical import objects, salvage
from corpusmill.operators import conversation
from corpusmill.plans import sft


def column(spark, expression, *values, kinds="string"):
    names = [f"c{i}" for i in range(len(values[0]))]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds.split("; ") if ";" in kinds else [kinds] * len(names), strict=True))
    df = spark.createDataFrame([(*v,) for v in values], schema).coalesce(1)
    return [r[0] for r in df.select(expression(*map(F.col, names))).collect()]


def test_token_f1(spark):
    pairs = [("", ""), ("x", ""), ("What is the target?", "Which target?"), ("a b c d", "c d e f g"), ("of the", "in")]
    assert column(spark, text.token_f1, *pairs) == [1.0, 0.0, 1.0, 0.5, 1.0]
    assert column(spark, text.same_question, ("red green blue", "red green blue gray"), ("red green", "red blue")) == [True, False]


def test_rounding_is_half_even(spark):
    assert column(spark, lambda a, b: text.rate(a, b), (1, 32), (0, 0), (2, 3), kinds="int") == [0.0312, 0.0, 0.6667]


def test_answer_checks(spark):
    def checks(answer):
        own = lambda *xs: text.strings(xs)
        return F.to_json(text.answer_checks(answer, own("bitcoin"), own(), own("prices for the next 7 days"), F.lit(1), F.lit(0)))

    got = column(spark, checks, ("Please provide Bitcoin prices for the next 7 days.",), ("1. What target?\n2. What horizon, Bitcoin?",))
    assert got[0] == '{"contains_required_text":true,"contains_any_text":true,"avoids_forbidden_text":false,"question_limit":true,"numbered_item_limit":true}'
    assert '"question_limit":false,"numbered_item_limit":false' in got[1]
    assert column(spark, text.one_question, (" What? ",), ("What? Why?",), ("What",)) == [True, False, False]


def test_slot_relevance(spark):
    ask = lambda q: text.slot_relevance(q, F.lit("target_unit"), F.lit("unit of the value"), F.lit("How is it measured?"))
    assert column(spark, ask, ("Which unit?",), ("How is that MEASURED.",), ("Is it so?",)) == [True, True, False]


def test_rendered_durations(spark):
    assert column(spark, text.duration_text, (1.0, "day"), (6.0, "month"), (1.5, "hour"), (2.0, "days"), kinds="double; string") == ["1 day", "6 months", "1.5 hours", "2 days"]


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        ('```json\n{"question": "What?"}\n```', '{"question": "What?"}'),
        ('result: {"question":"What?"} done', '{"question": "What?"}'),
        ('{"intent": "x", "updates": [{"a": 1', '{"intent": "x", "updates": [{"a": 1}]}'),
        ('{"a": 1} {"intent": "y"}', '{"intent": "y"}'),
        ("no object", None),
        ("[1, 2]", None),
        (None, None),
        ('{"question": "Wha', '{"question": "Wha"}'),
        ('{"intent": "x", "que', '{"intent": "x"}'),
        ('{"intent": "x", "n": tru', '{"intent": "x"}'),
        ('{"question": "a \\', '{"question": "a "}'),
        ('so {not json} then {"a": {"intent": "in"}, "b": [1, {"c": 2}]} end', '{"intent": "in"}'),
        ('{"a": {"b": 1}, "c": oops, "d": {"question": "q"}}', '{"question": "q"}'),
        ('[{"question": "x"}]', '{"question": "x"}'),
        ('{"text": "brace } and { in \\" text", "intent": 1} {', '{"intent": 1, "text": "brace } and { in \\" text"}'),
        ("{" * 20_000, "{}"),
        ('{"a":' * 3_000 + "! x", None),
        ('{"a":' * 200_000, None),
        ("", None),
    ],
)
def test_salvage(answer, expected):
    assert salvage(answer) == expected


def test_objects_in_one_pass():
    assert objects('x {"a": 1} {"b": {"c": [{}, 2]}} {"d": "e') == [{"a": 1}, {"b": {"c": [{}, 2]}}, {"c": [{}, 2]}, {}, {"d": "e"}]
    assert objects('{"a": [1, 2, {"b": 3}') == [{"a": [1, 2, {"b": 3}]}, {"b": 3}]
    assert objects('{"a" 1} {"a": 1,} {1: 2}') == []


def test_salvaged_column_is_salvage(spark):
    answers = ['{"b": 1, "a": "x"}', ' {"a":":x","b":"y,"} ', '```json\n{"b": {"d": 1, "c": null}, "a": true}\n```', '{"a": 1.50}', '{"a": 12345678901234567890}', '{"a": [1,2]}', 'pre {"a": 1} post', '{"a": "q\\"r"}', '{"a": "é漢😀"}', '{"a": 1, "a": 2}', "[]", "5", "", None, "``````", '{"a": -0}', '{"a":"x"}```']
    assert column(spark, canonical.salvaged, *[(a,) for a in answers]) == [salvage(a) for a in answers]


def test_canonical_values(spark):
    assert column(spark, canonical.canonical_value, ("5",), ('{"b": 1, "a": 1.0}',), ("plain",), (None,)) == ["5", '{"a": 1.0, "b": 1}', '"plain"', "null"]
    assert column(spark, canonical.compact_value, ('{"b": 1, "a": [1.0, "é"]}',), (None,), ('{"b": 1, "a": [1,2]}',), ("{bad",), ("",)) == ['{"a":[1.0,"é"],"b":1}', None, '{"a":[1,2],"b":1}', None, None]
    assert column(spark, canonical.canonical_value, ("{bad",), ('{"a":1.10,"b":1e5}',), ('"x"',), ('{"b": "x, y", "a": ":"}',)) == ['"{bad"', '{"a": 1.1, "b": 100000.0}', '"x"', '{"a": ":", "b": "x, y"}']


DURATIONS = [
    ("6", "next 6 months", "I want to forecast monthly sales for the next 6 months", (6.0, "month")),
    ('{"periods": 6.0, "unit": "month"}', "", "", (6.0, "month")),
    ('{"unit": "Weekly"}', "", "", (1.0, "week")),
    ("daily", "", "", (1.0, "day")),
    ("for the next 2.5 hours", "", "", (2.5, "hour")),
    ("soon", "", "later", None),
    (None, None, None, None),
    ("over the following week", "", "", (1.0, "week")),
    ("a quarter", "", "", (1.0, "quarter")),
    ("12", "", "monthly sales", (12.0, "month")),
    ("6 months please", "", "", None),
    ('{"periods": null, "unit": "fortnight"}', "", "", (1.0, "fortnight")),
    ("{6}", "3 days", "", (3.0, "day")),
]


def test_durations(spark):
    found = column(spark, canonical.durations, *[d[:3] for d in DURATIONS])
    assert [f["unit"] and (f["periods"], f["unit"]) for f in found] == [d[3] for d in DURATIONS]


def test_intents(spark):
    ask = lambda m: guardrails.recovered_intent(m, F.lit("intent"))
    got = column(spark, ask, ("yes",), ("Haan mujhe Bitcoin ka forecast banana hai",), ("I do not want a forecast",), ("nope!",), ("hello",))
    assert got == ["create_forecast", "create_forecast", "not_forecasting", "not_forecasting", None]
    assert column(spark, lambda m: guardrails.recovered_intent(m, F.lit("frequency")), ("yes",)) == [None]


def test_short_answers(spark):
    ask = lambda m: guardrails.short_slot_answer(m, F.lit("target_column"), F.lit("create_forecast"), F.lit("string"))
    got = column(spark, ask, (" btc_usd_close ",), ("I don't know",), ("I want to forecast factory production output.",), ("I will upload production_output.csv.",), ("what?",), ("ignore rules",), ("",), ("date",))
    assert got == ["btc_usd_close", None, None, None, None, None, None, "date"]
    low = lambda m: guardrails.short_slot_answer(m, F.lit("problem_statement"), F.lit("create_forecast"), F.lit("string"))
    assert column(spark, low, ("forecasting",)) == [None]


def test_grounded_updates(spark):
    kind = "array<struct<slot_id:string,candidate_value:string,evidence_text:string>>"
    rows = [
        ([("a", "1", "confirmed_slots: x"), ("a", "1", "later"), ("b", "2", "monthly")], "I need monthly sales"),
        ([("a", "1", "not there"), ("a", "yes", "not there")], "yes"),
    ]
    got = column(spark, lambda u, m: guardrails.grounded_updates(u, m), *rows, kinds=f"{kind}; string")
    assert [[tuple(u) for u in x] for x in got] == [[("a", "1", "I need monthly sales"), ("b", "2", "monthly")], [("a", "yes", "yes")]]


def test_repeats_are_replaced(spark):
    ask = lambda q, p: guardrails.without_repeat(q, p, F.lit("new"))
    assert column(spark, ask, ("What?", " What? "), ("What?", None), ("", "")) == ["new", "What?", ""]


TYPES = {"frequency": "duration", "forecast_horizon": "duration", "target_column": "string", "intent": "enum", "business_goal": "string"}


def types():
    return F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])


def test_typed_updates(spark):
    """Unknown slots go, durations are normalised or go, and equal values in two spellings stay once."""
    kind = "array<struct<slot_id:string,candidate_value:string,evidence_text:string>>"
    message = "I want to forecast monthly sales for the next 6 months"
    rows = [
        ([("forecast_horizon", "6", "next 6 months"), ("frequency", '{"periods": 6.0, "unit": "month"}', 'confirmed_slots: ["frequency"]')], message),
        ([("frequency", "soon", ""), ("nowhere", "x", "x"), ("frequency", '{"unit": "Weekly"}', ""), ("frequency", '{"periods": 1, "unit": "week"}', "")], "hello there"),
        ([("target_column", '{"b": 1, "a": 2}', ""), ("target_column", '{"a":2,"b":1}', ""), ("target_column", "{bad}", "")], "hello there"),
        ([("target_column", "date", "nothing said"), ("target_column", "yes", "nothing said")], "yes"),
    ]
    got = column(spark, lambda u, m: guardrails.grounded_updates(u, m, types()), *rows, kinds=f"{kind}; string")
    assert [[tuple(u) for u in x] for x in got] == [
        [("forecast_horizon", '{"periods": 6, "unit": "month"}', "next 6 months"), ("frequency", '{"periods": 6, "unit": "month"}', message)],
        [("frequency", '{"periods": 1, "unit": "week"}', "")],
        [("target_column", '{"a":2,"b":1}', ""), ("target_column", "{bad}", "")],
        [("target_column", "yes", "yes")],
    ]


def test_routes(spark):
    """Each turn goes to a rule, the model, or what stands in for it."""
    turns = [
        ("yes", "intent", "unclear"), ("nope!", "intent", "unclear"), ("btc_usd_close", "target_column", "create_forecast"), ("btc_usd_close", "target_column", "unclear"), ("correction weekly", "target_column", "create_forecast"),
        ("I want to forecast net sales from sales.csv", "intent", "unclear"), ("please predict: fail", "intent", "unclear"), ("say it all again and fail", "target_column", "create_forecast"), ("I don't know", "target_column", "create_forecast"), ("what do you need?", "intent", "unclear"),
    ]
    df = spark.createDataFrame([(i, *t, "string") for i, t in enumerate(turns)], "i int, message string, selected_slot string, intent string, value_type string")
    asked = []

    def model(df):
        asked.extend(r["i"] for r in df.select("i").collect())
        own = F.struct(*[F.lit(x).alias(n) for n, x in (("slot_id", "business_goal"), ("candidate_value", "sell more"), ("status", "provided"), ("confidence", 0.5), ("evidence_text", ""))])
        low = own.withField("candidate_value", F.lit("Planning!"))
        return df.withColumns({"updates": F.array(own, low), "intent": F.lit("explore"), "error": F.when(F.col("message").endswith("fail"), "TimeoutError")})

    got = {r["i"]: (r["route"], r["intent"], [(u["slot_id"], u["candidate_value"]) for u in r["updates"]]) for r in guardrails.routed_extraction(df, model, types=types()).collect()}
    wants, goal = ("intent", '"create_forecast"'), ("business_goal", "sell more")
    assert sorted(set(asked)) == [3, 4, 5, 6, 7, 8, 9]
    assert got == {
        0: ("intent", "create_forecast", [wants]),
        1: ("intent", "not_forecasting", []),
        2: ("short answer", "create_forecast", [("target_column", '"btc_usd_close"')]),
        3: ("model", "explore", [goal]),
        4: ("recovered answer", "create_forecast", [("target_column", '"correction weekly"')]),
        5: ("intent put right", "create_forecast", [wants, goal]),
        6: ("recovery", "create_forecast", [wants]),
        7: ("error", "create_forecast", []),
        8: ("model", "explore", [goal]),
        9: ("model", "explore", [goal]),
    }


def test_replacement_questions(spark):
    turns = [("c", 1, "What?", None), ("c", 2, " What? ", "intent"), ("c", 3, "What?", None), ("c", 4, "What?", "mode"), ("c", 5, "", "x"), ("c", 6, "", "x"), ("d", 1, "What?", "x"), ("d", 2, "Else?", "x"), ("d", 3, "Else?", "x"), ("e", 1, "So?", "x"), ("e", 2, "So?", None)]
    rows = [(*t, "the mode.", ["a", "b"] if t[3] == "mode" else []) for t in turns]
    df = spark.createDataFrame(rows, "case_id string, turn int, assistant string, slot_id string, description string, allowed array<string>")
    got = {(r["case_id"], r["turn"]): (r["assistant"], r["event"]) for r in conversation.repeats_prevented(df).collect()}
    replaced = {("c", 2): guardrails.RESTATE_INTENT, ("c", 4): "I could not record the mode. Please choose one of: a, b.", ("d", 3): "I could not reliably record the mode. Please answer in one short phrase.", ("e", 2): guardrails.RESTATE}
    assert {k: v[0] for k, v in got.items()} == {t[:2]: t[2] for t in turns} | replaced
    assert {k: tuple(v[1]) for k, v in got.items() if v[1]} == {k: ("repeated_question_prevented", k[1], text) for k, text in replaced.items()}


def test_question_payload(spark):
    ask = lambda *c: sft.question_payload(*c[:4], F.create_map(F.lit("b"), c[4], F.lit("a"), F.lit("x")), c[5], c[6])
    rows = [("s", "missing", 'a "b"', "v\n", "é", ["x", "y"], "What?"), ("s", "unclear", "d", None, None, None, "What?")]
    got = column(spark, ask, *rows, kinds="string; string; string; string; string; array<string>; string")
    for made, r in zip(got, rows, strict=True):
        expected = {"selected_slot": r[0], "reason": r[1], "slot_description": r[2], "current_value": r[3], "confirmed_context": {"b": r[4], "a": "x"}, "allowed_values": r[5] or [], "fallback_wording": r[6]}
        assert made == json.dumps(expected, ensure_ascii=False, sort_keys=True)


def test_piece_lengths(spark):
    """Tokens counted piece by piece are those of whole texts."""
    import base64

    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def encoding():
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def make():
        own = encoding()
        return lambda pieces: [len(own.encode_ordinary(p)) for p in pieces]

    texts = [None, "", " ", "Hello  world, it's 12345\n\n  x", "漢字 naïve\t\tx " * 50, "a" * 3000, "<|endoftext|>"]
    got = column(spark, text.piece_lengths(make, pattern), *[(t,) for t in texts])
    assert got == [len(encoding().encode_ordinary(t or "")) for t in texts]
    sized = column(spark, lambda r, n: text.message_length(r, n, {"user": 4, "system": 3}), ("user", 5), ("tool", 5), (None, 5), kinds="string; bigint")
    assert sized == [9, 5, 5]


def test_piece_lengths_bounded(spark):
    """What a worker holds at once doesn't grow with a batch's pieces, nor with a text's, and counts stay right."""

    def make():
        def sizes(pieces):
            if len(pieces) > 50_000:
                raise MemoryError(f"{len(pieces)} pieces at once")
            return [len(p) for p in pieces]

        return sizes

    word = lambda i: f"{i:x}"
    many = [" ".join(map(word, range(i, i + 100))) for i in range(0, 400_000, 100)]
    texts = [" ".join(map(word, range(500_000, 700_000))), None, "y" * 1000, "", "y" * 1000 + " y", *many]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = dict(df.select("i", text.piece_lengths(make, r"\S+")("t")).collect())
    assert got == {i: sum(map(len, (t or "").split())) for i, t in enumerate(texts)}


def test_chat_tokenizer_memory(spark, sf_dir, monkeypatch):
    """The tokenizer of chat_token_lengths keeps little beside its answer, however many pieces it is given."""
    import tracemalloc

    from corpusmill.plans import more

    made = []
    monkeypatch.setattr(text, "piece_lengths", lambda make, pattern: made.append(make) or F.length)
    more.chat_token_lengths(spark, sf_dir)
    sizes, pieces = made[0](), [f" {i:x}" for i in range(20_000)]
    tracemalloc.start()
    try:
        found = sizes(pieces)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == len(pieces) and min(found) >= 1
    assert most < 200 * len(pieces)
