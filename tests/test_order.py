"""Order statistics and order-dependent state, with groups and keys that hold most of the rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import compare, conversation, dedup, quantiles, scans, scoring


def brute_summary(values):
    own = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    if not own:
        return (0, None, None, None)
    n = len(own)
    return n, own[(n - 1) // 2], own[n // 2], own[-(-95 * n // 100) - 1]


def groups(rng):
    wide = [rng.choice([1, -1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)]
    return {
        "wide": wide, "one": [3.5] * 300, "two": [1.0, 2.0] * 77, "close": [1 + i * 2.0**-52 for i in range(500)], "tiny": [i * 5e-324 for i in range(200)], "signs": [-0.0, 0.0, -1e-9, 1e-9, -3.0],
        "odd": [float("inf"), float("-inf"), float("nan"), 1.0, float("nan"), None], "none": [None, None], "distinct": [rng.random() for _ in range(3000)], None: [1.0, 9.0, 5.0],
    }


@pytest.mark.parametrize(("few", "cuts"), [(1 << 16, 4096), (100, 64), (3, 8)])
def test_exact_quantiles(spark, monkeypatch, few, cuts):
    monkeypatch.setattr(quantiles, "SORTED", few)
    monkeypatch.setattr(quantiles, "CUTS", cuts)
    some = groups(random.Random(4)) if few > 3 else {"close": [1 + i * 2.0**-52 for i in range(30)], "two": [1.0, 2.0, 2.0], "distinct": [random.Random(4).random() for _ in range(40)]}
    df = spark.createDataFrame([(k, v, "x") for k, own in some.items() for v in own], "k string, v double, bucket string").repartition(5)
    places = {"low": F.floor((F.col("n") - 1) / 2), "high": F.ceil((F.col("n") - 1) / 2), "p95": F.ceil(0.95 * F.col("n")) - 1}
    got = {(r["_all"], r["k"]): tuple(map(repr, (r["n"], r["low"], r["high"], r["p95"]))) for r in quantiles.spread(df, "v", ["k"], places).collect()}
    expected = {(0, k): brute_summary(own) for k, own in some.items()} | {(1, None): brute_summary([v for own in some.values() for v in own])}
    assert {k: tuple(x.replace("-0.0", "0.0") for x in v) for k, v in got.items()} == {k: tuple(repr(x).replace("-0.0", "0.0") for x in v) for k, v in expected.items()}


def test_no_window_takes_a_group(spark, monkeypatch):
    """All values distinct in one group: what is sorted are the rows of a bucket."""
    monkeypatch.setattr(quantiles, "SORTED", 500)
    rng = random.Random(1)
    values = [rng.lognormvariate(3, 1) for _ in range(20_000)]
    df = spark.createDataFrame([("g", v) for v in values], "k string, v double")
    sizes = []
    held = quantiles.values_at
    monkeypatch.setattr(quantiles, "values_at", lambda rows, keys, h: (sizes.append(h.agg(F.max("c")).first()[0]), held(rows, keys, h))[1])
    got = scoring.latency_summary(df, "v", ["k"]).where("k = 'g'").first()
    assert (got["p50"], got["p95"]) == (round(statistics.median(values), 1), round(sorted(values)[18_999], 1))
    assert sizes[0] < 2000


def test_empty_quantiles(spark):
    assert scoring.latency_summary(spark.createDataFrame([], "k string, v double"), "v", ["k"]).collect() == []


def hot_rows(n=4000):
    """90 % of the rows in one key, in runs; nulls among values and keys."""
    rng = random.Random(2)
    out, last = [], "a"
    for i in range(n):
        if rng.random() < 0.2:
            last = rng.choice(["a", "b", None])
        out.append(("hot" if rng.random() < 0.9 else rng.choice(["k1", "k2", "k3", None]), i, last, rng.choice([None, "", "q", "r ", f"e{i}"]), "x"))
    return out


def folded(rows):
    """Per row: the last non-empty text before it, whether its value repeats, and the evidence of its run's first row."""
    asked, value, first, out = {}, {}, {}, {}
    for k, t, v, e, _ in rows:
        if k not in value or value[k] != v:
            first[k] = e
        out[t] = (asked.get(k), k in value and v is not None and value[k] == v, first[k])
        asked[k], value[k] = e or asked.get(k), v
    return out


@pytest.mark.parametrize("whole", [1 << 20, 100])
def test_state_of_hot_keys(spark, monkeypatch, whole):
    monkeypatch.setattr(scans, "WHOLE", whole)
    some = hot_rows()
    df = spark.createDataFrame(some, "k string, t int, v string, e string, _part string").drop("_part").repartition(6)
    expected = folded(some)
    questions = {r["t"]: r["last_question"] for r in conversation.last_question(df, "k", "t", "e").collect()}
    repeats = {r["t"]: r["repeats"] for r in conversation.repeats(df, ["k"], ["t"], "v").collect()}
    evidence = {r["t"]: r["original_evidence"] for r in dedup.carried_forward(df, ["k"], "t", "v", "e").collect()}
    assert {t: (questions[t], repeats[t], evidence[t]) for t in questions} == expected


def test_a_hot_key_is_cut(spark, monkeypatch):
    monkeypatch.setattr(scans, "WHOLE", 100)
    df = spark.createDataFrame([(k, t) for k, t, *_ in hot_rows()], "k string, t int")
    found = scans.parts(df, ["k"], ["t"])
    sizes = [r["count"] for r in found.rows.where("k = 'hot'").groupBy("_part").count().collect()]
    assert found.cut and len(sizes) == 4 and max(sizes) < 0.4 * 4000
    assert not scans.parts(df, ["k"], ["t"], whole=5000).cut


KINDS = {"id": "long", "name": "string", "day": "date", "value": "double"}


@pytest.mark.parametrize("column", KINDS)
@pytest.mark.parametrize(("few", "cuts"), [(1 << 16, 4096), (20, 8)])
def test_rows_by_place(spark, monkeypatch, column, few, cuts):
    """Stretches and indices of the order, ties and nulls first among them."""
    import datetime

    monkeypatch.setattr(quantiles, "SORTED", few)
    monkeypatch.setattr(quantiles, "CUTS", cuts)
    rng = random.Random(5)
    make = {"id": lambda i: i * i - 500, "name": lambda i: f"n{i % 97:03d}-{i}é", "day": lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i // 2), "value": lambda i: rng.choice([-1, 1]) * 1.5 ** rng.uniform(-40, 40)}[column]
    values = [make(i) for i in range(400)] + [None] * 7
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], f"k {KINDS[column]}, n int").repartition(5)
    ordered = sorted(values, key=lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0 if not isinstance(v, datetime.date) else v) if v is not None else (False,))
    own = lambda got: sorted([r["k"] for r in got.collect()], key=lambda v: (v is not None, v) if v is not None else (False,))
    for offset, limit in ((0, 3), (5, 40), (100, 1), (390, 50), (50, None), (1000, None), (0, 0)):
        assert own(compare.sampled(df, "k", offset, limit)) == own_(ordered[offset : None if limit is None else offset + limit])
    assert own(compare.sampled(df, "k", indices=[0, 6, 7, 200, 406, 407, 10**12, 200])) == own_([ordered[i] for i in (0, 6, 7, 200, 406)])
    assert own(compare.sampled(df, "k", limit=2, indices=[300, 1, 77])) == own_([ordered[i] for i in (1, 77)])
    assert compare.sampled(df.limit(0), "k", 0, 5).collect() == []


def own_(values):
    return sorted(values, key=lambda v: (v is not None, v) if v is not None else (False,))
