import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import periodic as P
from corpusmill.llm.suffixes import Suffixes

SCHEMA = "runs string, doc_id long, text string, id string, start int, words array<string>"


def brute(words, least, times):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)  # the least period comes first
            i = max(i + 1, j)
    return sorted((i, n, q) for (i, n), q in found.items())


def collapsed(words, runs):
    gone = {k for i, n, q in runs for k in range(i + q, i + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def by_document(docs, least, times):
    out = [[] for _ in docs]
    for d, *own in zip(*[x.tolist() for x in P.document_runs(docs, least, times)], strict=True):
        out[d].append(tuple(own))
    return out


periodic = st.builds(lambda head, body, k, cut: head + (body * k)[: len(body) * k - cut], st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abcd"), min_size=1, max_size=5), st.integers(1, 8), st.integers(0, 4))
plain = st.lists(st.sampled_from("ab"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(plain, periodic, st.builds(list.__add__, periodic, periodic)), max_size=4), st.sampled_from([(6, 4), (2, 2), (5, 3), (4, 2)]))
def test_runs_match_brute_force(docs, limits):
    docs = [[w.encode() for w in d] for d in docs]
    assert by_document(docs, *limits) == [sorted(brute(d, *limits), key=lambda r: (r[0], r[2])) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=40))
def test_squares_of_all_kinds_are_found(text):
    """The vocabulary has every square with a primitive root, and its loci all their occurrences."""
    string = Suffixes(np.array([*map(ord, text), 0]))
    lo, hi, q = P.vocabulary(string, *P.covering_squares(string))
    got = {(int(i), int(k)) for a, b, k in zip(lo, hi, q, strict=True) for i in string.order[a : b + 1]}
    primitive = lambda x: (x + x).find(x, 1) == len(x)
    assert got == {(i, k) for k in range(1, len(text)) for i in range(len(text) - 2 * k + 1) if text[i : i + k] == text[i + k : i + 2 * k] and primitive(text[i : i + k])}


def test_extensions_match_brute_force():
    rng = random.Random(3)
    text = [rng.choice("ab") for _ in range(60)] + ["$"]
    string = Suffixes(np.array([ord(c) for c in text]))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    a, b = a[a != b], b[a != b]
    ahead, behind = string.after(a, b), string.before(a, b)
    for i, j, x, y in zip(a, b, ahead, behind, strict=True):
        assert text[i : i + x] == text[j : j + x] and text[i + x] != text[j + x]
        assert y == next(k for k in range(61) if min(i, j) - k < 0 or text[i - k] != text[j - k])


def test_rows(spark):
    rng = random.Random(1)
    words = lambda n: rng.choices([f"w{i}é" for i in range(300)], k=n)
    texts = [None, "", " \t\n", "a b", "x " * 6, "x " * 5, " ".join(words(50) + words(7) * 4), " ".join(["p", "q"] * 4), "a b\ta\x0bb\na b a b c", " ".join(words(40_000) + words(900) * 5)]
    texts += [" ".join(["a", "a", "b"] * 5 + ["c"] + ["d"] * 6 + ["e", "f"] * 5), "é " * 9]  # two with one exponent
    rows = [("r", i, t, "id", 1, []) for i, t in enumerate(texts)] + [("r", 4, texts[4], None, None, None), (None, None, texts[6], None, None, None)]
    got = P.periodic_runs(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    expected = {}
    for _, i, t, *_ in rows:
        own = [x.decode() for x in (t or "").encode().split()]
        runs = brute(own, 6, 4)
        top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        expected[i] = (len(own), len(runs), *top, 1000 * top[1] // top[2] if runs else None, runs, collapsed(own, runs))
    for r in got:
        assert (r["n_words"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], [tuple(x) for x in r["runs"]], r["collapsed"]) == expected[r["doc_id"]]
    assert expected[9][1] == 1 and expected[10][1] == 3 and expected[4][2:5] == (0, 6, 1)


def test_empty_table_and_limits(spark):
    assert P.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        P.periodic_runs(spark.createDataFrame([], SCHEMA), times=1)


def test_one_word_over_and_over():
    n = 100_000
    assert by_document([[b"a"] * n, [b"a"] * 5], 6, 4) == [[(0, n, 1)], []]


def test_planted_periods(spark):
    import zlib

    from corpusmill.llm.queries import planted_period

    rows = [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(1000)] + [(-5, "a b c d"), (None, "a b"), (7, None)]
    got = spark.createDataFrame(rows, "i long, t string").select("i", "t", planted_period(F.col("i"), F.col("t")).alias("p")).collect()
    n_planted = 0
    for r in got:
        want = r["t"]
        if r["i"] is not None and (h := zlib.crc32(str(r["i"]).encode())) % 10 == 0 and (own := (want or "").split()):
            g = h // 10
            a = g % len(own)
            p = 1 + (len(own) - a) // (3 + g % 8)
            want = " ".join(own[i] if i < a else own[a + (i - a) % p] for i in range(len(own)))
            n_planted += 1
        assert (r["p"] or "") == (want or "")
    assert n_planted > 50
