import hashlib
import random
import re

import numpy as np
import pytest

from corpusmill.llm import decontamination as D

DOCS = "doc_id long, text string, row string, item string, n_words int"
ITEMS = "text string, item_id long, doc_id long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = [(item, tuple(w[i : i + size])) for text, item, *_ in items if (w := words(text)) for i in range(max(1, len(w) - size + 1))]
    out = []
    for doc, text, *_ in docs:
        own, hit, found = words(text), set(), set()
        for item, w in windows:
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(4)
    some = lambda n: [rng.choice(["a", "b", "c1", "é", "Straße", "x9"]) for _ in range(n)]
    items = [(" ".join(some(n)), 100 - n, 1) for n in (1, 2, 9, 10, 11, 30)] + [(None, 7, 1), ("", 8, 1), ("?! \x00", 9, 1), ("é", None, 1), ("a b c1", 300, 1), ("a b c1", 1000, 1)]
    docs = [(i, ", ".join(some(rng.randrange(0, 120))), "r", "i", 0) for i in range(30)]
    docs += [(50 + i, f"{' '.join(some(20))}  {items[i][0].upper() if i != 4 else items[i][0]}!{' '.join(some(5))}", "r", "i", 0) for i in range(6)]
    docs += [(90, None, "r", "i", 0), (91, "", "r", "i", 0), (None, items[5][0], "r", "i", 0), docs[31], (docs[31][0], "b b", "r", "i", 0)]
    docs += [(95, " ".join(some(30_000)) + " " + items[5][0], "r", "i", 0)]
    return docs, items


@pytest.mark.parametrize(("segment", "chunk"), [(1 << 21, 1 << 16), (2000, 3)])
def test_matches_brute_force(spark, monkeypatch, segment, chunk):
    monkeypatch.setattr(D, "SEGMENT", segment)
    monkeypatch.setattr(D, "CHUNK", chunk)
    docs, items = rows()
    got = D.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)).drop("text_hash")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_items_without_ids_count(spark):
    leak = "one two three four five six seven eight nine ten eleven"
    docs, items = [(1, f"x {leak} y", "r", "i", 0), (2, "clean", "r", "i", 0)], [(leak, None, 1), (leak[:-7], 5, 1)]
    got = sorted(D.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).drop("text_hash").collect())
    assert [tuple(r) for r in got] == brute(docs, items) and (got[0]["n_hit"], got[0]["n_items"], got[1]["contaminated"]) == (11, 2, False)


def test_empty_tables(spark):
    docs, items = rows()
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame(docs[:3], DOCS)
    assert D.contamination(none, spark.createDataFrame(items, ITEMS)).collect() == []
    got = D.contamination(some, spark.createDataFrame([], ITEMS)).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs[:3], [])


def test_proximity():
    at = lambda *x: np.array(x, np.int32)
    postings = {0: at(3, 40), 1: at(5, 41, 80), 2: at(6, 90)}
    order, terms = np.array([0, 2, 1]), np.array([0, 1, 2])
    assert D.match(postings.get, terms, order).tolist() == []
    assert D.match(postings.get, terms, order, slop=1).tolist() == [3]
    assert D.match(postings.get, terms, order, slop=60).tolist() == [3, 40]


def test_proximity_over_documents(spark):
    docs = spark.createDataFrame([(1, "x one two y three z", 1, 1), (2, "three one two", 2, 1), (3, "one a b c d two three", 3, 1)], "doc_id long, text string, row long, row2 long")
    items = spark.createDataFrame([("one two three", 9, 1)], ITEMS)
    found = lambda slop: sorted({r["row"] for r in D.phrase_matches(docs, items, slop=slop)[1].collect()})
    assert found(0) == [] and found(1) == [1] and found(9) == [1, 2, 3]


def test_packed_numbers():
    for x in (np.arange(-5, 300_000, dtype=np.int64), np.zeros(0, np.int32), np.array([7, -1], np.int32)):
        assert np.array_equal(D._unpack(D._pack(x), x.dtype.type), x)


def test_phrases_do_not_cross_documents(spark):
    docs = spark.createDataFrame([(1, "a b c", "", "", 0), (2, "d e f", "", "", 0)], DOCS).coalesce(1)
    assert not any(r["contaminated"] for r in D.contamination(docs, spark.createDataFrame([("b c d e", 1, 1)], ITEMS)).collect())
