import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import repetition as R

SCHEMA = "doc_id long, text string, id string, kept string, n_words array<string>"


def in_repeats(units, k):
    seen = Counter(tuple(units[i : i + k]) for i in range(len(units) - k + 1))
    inside = set()
    for i in range(len(units) - k + 1):
        if seen[tuple(units[i : i + k])] > 1:
            inside.update(range(i, i + k))
    return len(inside)


def longest_repeat(units):
    k = 0
    while in_repeats(units, k + 1):
        k += 1
    return k


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=6))
def test_suffix_array_matches_brute_force(docs):
    units = [np.array([ord(c) for c in d], np.int64) for d in docs]
    windows, spans, longest = R._repeats(units, 2, 3, 1000)
    assert windows.tolist() == [in_repeats(d, 2) for d in docs]
    assert spans.tolist() == [in_repeats(d, 3) for d in docs]
    assert [x.tolist() for x in R._repeats(units, 2, 3, 4)] == [windows.tolist(), spans.tolist(), np.minimum(longest, 4).tolist()]
    assert [x for x in longest.tolist() if x >= 2] == [x for x in map(longest_repeat, docs) if x >= 2]


def maximal_repeats(units, least):
    """Distinct repeats of at least so many units that neither a unit before nor one after extends at all places."""
    places = {}
    for i in range(len(units)):
        for j in range(i + least, len(units) + 1):
            places.setdefault(tuple(units[i:j]), []).append(i)
    sides = lambda at, n: ({units[i - 1] if i else ("start", i) for i in at}, {units[i + n] if i + n < len(units) else ("end", i) for i in at})
    return sum(len(at) > 1 and all(len(x) > 1 for x in sides(at, len(r))) for r, at in places.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), max_size=4))
def test_maximal_repeats_match_brute_force(docs):
    units = [np.array([ord(c) for c in d], np.int64) for d in docs]
    _, _, longest, maximal = R.measured_repeats(units, 2, 3)
    assert maximal.tolist() == [maximal_repeats(d, 3) for d in docs]
    assert longest.tolist() == [x if (x := longest_repeat(d)) >= 2 else 0 for d in docs]


def test_long_repeats_are_told_in_full(spark):
    passage = " ".join(f"w{i}" for i in range(3000))
    got = R.repetition_rules(spark.createDataFrame([(1, f"{passage} x {passage}", "", "", [])], SCHEMA)).first()
    assert (got["longest_repeat"], got["n_covered"], got["n_maximal"], got["kept"]) == (3000, 6000, 1, False)


def brute(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    n = len(words)
    repeats = in_repeats(words, 5)
    failed = n < 10 or 100 * repeats > 20 * n
    chars = sum(len(w.decode()) for w in words)
    bad = 100 * in_repeats(words, 20) > 10 * n or in_repeats(words, 51) > 0
    return n, chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeats, failed, not failed and not bad


def test_counts_and_verdicts(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choices([f"w{i}" for i in range(400)], k=n))
    passage, long = words(12), words(51)
    some = [None, "", " \t\x0b\n", "a b", words(300), f"{passage} " * 3 + words(10), f"{words(1500)} {long} {words(400)} {long}", words(40_000)]
    some += ["x\ny\nx\n\n \nx " + words(20), "#*$ <é>    " + words(9), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(700)), "漢字" * 400 + " " + "語" * 100]
    some += ["from " * 200, "l\n" * 50]
    paragraph, block = words(65), words(50)  # within what the base rule keeps: covered too far, too long, and just not
    some += [f"{words(60)} {words(13)} {words(40)}", f"{(line := words(13))} {words(110)} {line}"]  # a line of 13 words twice is left to line dedup
    some += [f"{words(500)} {paragraph} {words(200)} {paragraph}", f"{words(1000)} {words(51)}", f"{words(1500)} {block} {words(400)} {block}", f"{words(700)} {block} {words(85)} {block}"]
    rows = [(i, t, "id", "kept", []) for i, t in enumerate(some)] + [(3, some[3], None, None, None), (None, some[4], None, None, None)]
    got = R.repetition_rules(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert {True, False} == {r["kept"] for r in got if not r["base_failed"]}
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got}
    assert kept[len(some) - 5] == (False, True)
    assert [kept[i] for i in (6, *range(len(some) - 4, len(some)))] == [(False, False), (False, False), (False, True), (False, True), (False, False)]


def test_empty_table(spark):
    assert R.repetition_rules(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_one_word_over_and_over(least):
    longest = R.repeat_lengths(np.zeros(3000, np.int64), np.zeros(3000, np.int64), least, 3000)
    assert longest.max() == 2999
    assert R.covered(longest, least).all()
