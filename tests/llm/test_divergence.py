import random
import re
from collections import Counter, defaultdict

import pytest

from corpusmill.llm import divergence as D

SCHEMA = "rank int, lang string, source string, text string, term string, value array<int>"


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least, ranks, smoothing=5):
    docs = [(lang or "", source or "", terms_of(text)) for _, lang, source, text, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        counts = defaultdict(Counter)
        for own, source, terms in docs:
            if own == lang:
                counts[source].update(t for t in terms if t in kept)
        every = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + smoothing) // (c.total() + smoothing * len(kept)) for t in kept}
        of = {s: p(c) for s, c in counts.items()}
        q = p(every)
        key = lambda x: (-x[1], x[0].encode())
        for s in of:
            pairs = sorted(((o, sum(abs(of[s][t] - of[o][t]) for t in kept)) for o in of if o != s), key=key)
            terms = sorted(((t, of[s][t] - q[t]) for t in kept if counts[s][t] and of[s][t] > q[t]), key=key)[:ranks]
            out += [(lang, s, part, item, value, k) for part, found in (("pair", pairs), ("term", terms)) for k, (item, value) in enumerate(found, 1)]
    return sorted(out)


def rows():
    rng = random.Random(5)
    terms = [f"{c}{w}" for c in "abcdé" for w in ("one", "ÜBER", "İx", "漢", "zz", "Q", "\U0001f600")]
    out = []
    for i in range(500):
        source = rng.choice(["hot"] * 5 + [f"s{k}" for k in range(8)] + ["é", "￿", "\U0001f600", "S1", None])
        lang = rng.choice(["en"] * 4 + ["de", None])
        text = rng.choice([" ", ", 1", "\n"]).join(rng.choices(terms, [1 / (k + 1) for k in range(len(terms))], k=rng.randrange(0, 60)))
        out.append((1, lang, source, text, "t", [1]))
    out += [(1, "fr", s, t, "t", []) for s, t in (("a", "rare words"), ("b", None), ("c", ""), ("b", "12 34"))]  # no kept term
    out += [(1, "es", "lonely", "uno " * 3, "t", [])] * 40 + [(1, "en", "long", "aone " * 40_000, "t", []), (1, "en", "none", None, "t", []), (None, None, None, None, None, None)]
    return out


@pytest.mark.parametrize(("held", "piece"), [(1 << 20, 512), (100, 3)])
def test_matches_brute_force(spark, monkeypatch, held, piece):
    monkeypatch.setattr(D, "HELD", held)
    monkeypatch.setattr(D, "PIECE", piece)
    some = rows()
    got = D.source_divergence(spark.createDataFrame(some, SCHEMA).repartition(5), ranks=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    expected = brute(some, 30, 7)
    assert sorted(map(tuple, got.collect())) == expected
    assert {x[2] for x in expected} == {"pair", "term"} and any(x[0] == "fr" and x[4] == 0 for x in expected)


def test_no_overflow(spark):
    """Counts times a thousand million leave 64 bits."""
    from pyspark.sql import functions as F

    n, total, v = 4 * 10**12, 9 * 10**12, 3 * 10**6
    got = spark.range(1).select(D.probability(F.lit(n), F.lit(total), F.lit(v), 5).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_empty_table(spark):
    assert D.source_divergence(spark.createDataFrame([], SCHEMA)).collect() == []
