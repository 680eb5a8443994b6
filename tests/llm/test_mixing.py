import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing as M

SCHEMA = "u long, doc_id long, source string, text string, size string, start int, target array<int>"


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, Fraction(sum(sizes.values())), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = Fraction(3 * sizes[s])
            left -= out[s]
            open_.discard(s)


def rows():
    rng = random.Random(6)
    out = []
    for i in range(600):
        source = rng.choice(["hot"] * 6 + ["b", "B", "é", "\U0001f600", "￿", None, "z1", "z2", "z3"])
        out.append((1, i, source, " \t".join(["w"] * rng.choice([0, 1, 3, 50, 400])), "s", 2, [1]))
    out += [(1, 1000, "one", "x", "s", 2, []), (1, 1001, "none", None, "s", 2, []), (1, 1002, "none", "  ", "s", 2, []), (1, 1003, "long", "w " * 50_000, "s", 2, [])]
    return out + [out[3], out[3], (1, None, "b", "a b", "s", 2, [])]


def scheduled(got, slots, step):
    """(doc_id, source, size) -> (taken, slots that take it): every slot's words one after another, from the rows' targets."""
    names = sorted({r["source"] for r in got if r["source"] is not None}, key=lambda s: s.encode()) + [None]
    facts = {r["source"]: (r["source_size"], round(r["target"])) for r in got}
    total, words = sum(g for _, g in facts.values()), sum(n for n, _ in facts.values())
    block, upto, bounds = max(1, words // slots), 0, []
    for name in names:
        if name in facts:
            upto += facts[name][1]
            bounds.append((math.floor(upto / total * 2**31), name))
    order = lambda r: (int(hashlib.md5(f"mix{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:15], 16), (r["doc_id"] is not None, r["doc_id"] or 0), r["size"])
    streams = {s: [i for i in sorted((i for i, r in enumerate(got) if r["source"] == s), key=lambda i: order(got[i])) for _ in range(got[i]["size"])] for s in facts}
    ranks, taken = defaultdict(int), defaultdict(list)
    for slot in range(-(-total // block)):
        point = (slot + 1) * step % 2**31
        source = next(name for hi, name in bounds if point < hi)
        rank, ranks[source] = ranks[source], ranks[source] + 1
        size = facts[source][0]
        for w in range(rank * block, min((rank + 1) * block, 3 * size)):
            taken[streams[source][w % size]].append(slot)
    return {i: (len(x), min(x, default=None), max(x, default=None)) for i, x in ((i, taken[i]) for i in range(len(got)))}


@pytest.mark.parametrize(("slots", "step"), [(16384, M.PHI), (40, M.PHI), (16384, 12345)])
def test_targets_and_taken(spark, monkeypatch, slots, step):
    monkeypatch.setattr(M, "SLOTS", slots)
    some = rows()
    df = spark.createDataFrame(some, SCHEMA).repartition(3)
    got = M.mix(df, step=step).collect()
    assert sorted(map(tuple, M.mix(df.repartition(5), step=step).collect()), key=str) == sorted(map(tuple, got), key=str)
    size = lambda t: len((t or "").encode().split())
    assert sorted(((r["doc_id"], r["source"], r["size"]) for r in got), key=str) == sorted(((d, s, size(t)) for _, d, s, t, *_ in some), key=str)
    sizes = defaultdict(int)
    for _, _, s, t, *_ in some:
        sizes[s] += size(t)
    expected, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(expected[r["source"]]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    block = max(1, sum(sizes.values()) // slots)
    if step == M.PHI:
        assert {s: round(expected[s]) for s in sizes} == pytest.approx(taken, abs=4 * block)
    # equal rows may change places
    exactly = scheduled(got, slots, step)
    assert sorted((str(r["doc_id"]), r["size"], r["taken"], r["first_slot"], r["last_slot"]) for r in got if r["size"]) == sorted((str(r["doc_id"]), r["size"], *exactly[i]) for i, r in enumerate(got) if r["size"])


def test_other_points_give_other_slots(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    first = {(r["doc_id"], r["size"]): r["first_slot"] for r in M.mix(df).collect()}
    other = {(r["doc_id"], r["size"]): r["first_slot"] for r in M.mix(df, step=12345).collect()}
    assert sum(first[k] != other[k] for k in first if k[1]) > len(first) / 2


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([("a", 60_000, 50_000.0, 0), ("b", 20_000, 50_000.0, 1), ("c", 20_000, 0.0, 1)], "source string, source_size long, target double, part int")
    slots = M.schedule(sources, 100_000, 100).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(1000))
    for k in (10, 100, 500, len(slots)):
        assert abs(sum(r["source"] == "a" for r in slots[:k]) - k / 2) <= 3
    for name in "ab":
        assert [r["rank"] for r in slots if r["source"] == name] == list(range(sum(r["source"] == name for r in slots)))


def test_sums_before(spark):
    rng = random.Random(2)
    values = [(rng.randrange(10**6), rng.randrange(9)) for _ in range(3000)]
    dealt = M.ranged(spark.createDataFrame(values, "k long, v long"), [F.col("k"), F.col("v")], "test")
    got = sorted(M.sums_before(dealt, [F.col("k"), F.col("v")], {"s": F.col("v")}).select("k", "v", "s").collect())
    assert [r["s"] for r in got] == [sum(v for _, v in sorted(values)[:i]) for i in range(len(values))]


def test_empty_table_and_no_words(spark):
    assert M.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = M.mix(spark.createDataFrame([(1, 5, None, "", "", 1, []), (1, 6, "a", None, "", 1, [])], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == [(5, 0, 0, 0.0, 0), (6, 0, 0, 0.0, 0)]


def test_word_count(spark):
    some = ["", None, " a b\x0bc\r\n", "\x1fx y", "é é"]
    got = spark.createDataFrame([(t,) for t in some], "t string").select(M.word_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [len((t or "").encode().split()) for t in some]
