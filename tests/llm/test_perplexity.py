import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import perplexity as C

SCHEMA = "text string, doc_id long, lang string, kept int"


def symbols(text):
    out = []
    for c in text or "":
        s = int(C.alphabet()[ord(c)])
        if s != C.SPACE or (out and out[-1] != C.SPACE):
            out.append(s)
    return out


class Brute:
    """Interpolated modified Kneser-Ney by its textbook recursion."""

    def __init__(self, texts):
        counts = Counter()
        for s in texts:
            s = [C.SPACE] * (C.ORDER - 1) + s
            counts.update(tuple(s[i - C.ORDER + 1 : i + 1]) for i in range(C.ORDER - 1, len(s)))
        self.a = {C.ORDER: counts}
        for k in range(C.ORDER - 1, 0, -1):
            self.a[k] = Counter(g[1:] for g in self.a[k + 1])
        self.d, self.after = {}, {}
        for k, a in self.a.items():
            n = [sum(v == i for v in a.values()) for i in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            self.d[k] = [0] + [max(0.01, min(i - 0.01, i - (i + 1) * y * n[i + 1] / n[i])) if i < 4 and n[i] and n[1] and n[i + 1] else i / 2 for i in (1, 2, 3)]
            self.after[k] = defaultdict(list)
            for g, v in a.items():
                self.after[k][g[:-1]].append(v)

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / C.SYMBOLS
        after = self.after[k].get(g[:-1])
        if not after:
            return self.p(g[1:])
        d, n = self.d[k], self.a[k].get(g, 0)
        return (n - d[min(n, 3)]) / sum(after) + sum(d[min(v, 3)] for v in after) / sum(after) * self.p(g[1:])

    def perplexity(self, s):
        padded = [C.SPACE] * (C.ORDER - 1) + s
        return math.exp(-sum(math.log(self.p(tuple(padded[i - C.ORDER + 1 : i + 1]))) for i in range(C.ORDER - 1, len(padded))) / len(s))


def rows():
    rng = random.Random(4)
    russian = "мой дядя самых честных правил когда не в шутку занемог он уважать себя заставил и лучше выдумать не мог".split()
    out = [(" ".join(rng.choices(russian, k=rng.randint(5, 40))), i, "ru", 0) for i in range(80)]
    out += [(" ".join(rng.choices(["the", "of", "ﬁn", "漢字", "😀", "12"], k=rng.randint(1, 20))), 100 + i, "en", 0) for i in range(40)]
    letters = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    out += [(" ".join("".join(rng.choices(letters, k=len(w))) for w in rng.choices(russian, k=30)), 200 + i, "ru", 0) for i in range(20)]
    out += [("of the " * 20_000, 303, "en-GB", 0), ("the of", 304, "ENGLISH", 0), ("漢字", 305, "en", 0)]
    return [*out, (None, 300, "ru", 0), ("", 301, "en", 0), (" \n ", 302, "xx", 0), ("мой of", None, None, 0), out[3]]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 26), (50, 500)])
def test_textbook_and_random_letters(spark, monkeypatch, sizes):
    if sizes[0] < 1 << 20:
        monkeypatch.setattr(C, "WINDOW", sizes[0])
        monkeypatch.setattr(C, "BUCKET", sizes[1])
        monkeypatch.setattr(C, "TRAIN", sizes[1])
    some = rows()
    ids = set(range(0, 140, 2))
    trusted = spark.createDataFrame([(i,) for i in [*ids, 9999]], "doc_id long")
    got = C.quality(spark.createDataFrame(some, SCHEMA).repartition(3), trusted).collect()
    assert len(got) == len(some)
    train = [(lang, symbols(t)) for t, i, lang, _ in some if i in ids]
    models = {lang: Brute([s for x, s in train if lang in (x, "*")]) for lang in ("ru", "en", "*")}
    text = {r[1]: r[0] for r in some}
    for r in got:
        s = symbols(text[r["doc_id"]])
        assert r["n_symbols"] == len(s)
        if len(s) > 5000:
            assert r["lang"] == "en" and r["perplexity"] > 1
        elif s:
            assert r["perplexity"] == pytest.approx(models[r["lang"]].perplexity(s), rel=1e-6)
        else:
            assert r["perplexity"] is None and r["kept"] is None
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[i] for i in ids if i < 80) and not any(kept[i] for i in range(200, 220))  # random Russian letters


def test_empty_tables(spark):
    none, ids = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long")
    assert C.quality(none, ids).collect() == []
    got = C.quality(spark.createDataFrame(rows()[:3], SCHEMA), ids).collect()
    assert [(r["lang"], r["perplexity"], r["kept"]) for r in got] == [("*", None, None)] * 3


def test_tags(spark):
    some = ["en", "EN-us", "zh-Hans", "eng", "english", "", None, "e", "pt_BR"]
    got = spark.createDataFrame([(x,) for x in some], "t string").select(C.tag(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in got] == ["en", "en", "zh", "eng", "*", "*", "*", "*", "pt"]


def test_distinct_counts_all(monkeypatch):
    monkeypatch.setattr(C, "WINDOW", 40)
    text = "the cat  sat\n on the mat; the 漢字 😀 " * 9
    seen, expected = C.Distinct(), Counter()
    for h1, h2, s, _ in C.windows([text, None, "", " x"]):
        seen.add(h1, h2, s)
    for own in (symbols(text), symbols(" x")):
        padded = [C.SPACE] * (C.ORDER - 1) + own
        expected.update(tuple(padded[i : i + C.ORDER]) for i in range(len(own)))
    unpack = lambda h1, h2, s: tuple([h1 & C.SYMBOLS * 2 - 1, h2 >> 42, h2 >> 21 & (1 << 21) - 1, h2 & (1 << 21) - 1, s])
    assert {unpack(*map(int, g)): int(n) for *g, n in zip(*seen.all(), strict=True)} == expected
