import random
from collections import defaultdict

import numpy as np

from corpusmill.llm import chunks as C

SCHEMA = "text string, doc_id long, id string, a long, sizes string, of string, _of int, spans string"


def gear_brute(data):
    out = []
    for i in range(len(data)):
        h = 0
        for x in data[max(0, i - C.WINDOW + 1) : i + 1]:
            h = ((h << 1) + int(C._GEAR[x])) & 0xFFFFFFFF
        if h & C.MASK == 0 and (i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80):
            out.append(i + 1)
    return out


def brute_chunks(text):
    """The chunks of one text, byte by byte."""
    data, ends = (text or "").encode(), set(gear_brute((text or "").encode()))
    out, last = [], 0
    for i in range(1, len(data) + 1):
        whole = i == len(data) or data[i] & 0xC0 != 0x80
        if i == len(data) or (whole and (i - last >= C.MOST or (i - last >= C.LEAST and i in ends))):
            out.append(data[last:i])
            last = i
    return out


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijé語", k=rng.randint(1, 9))) for _ in range(n))


def corpus():
    rng = random.Random(8)
    passage, other = prose(rng, 60), prose(rng, 80)
    clean = [prose(rng, rng.randint(1, 300)) for _ in range(30)]
    shared = [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(5)]
    copies = [other, other, f"x {other}"]
    odd = [None, "", "é", "a" * 3000, "語" * 500, prose(rng, 20_000), "short", "short"]
    return clean, shared, copies, odd


def test_boundaries_and_chunks_match_brute_force():
    clean, shared, copies, odd = corpus()
    some = clean + shared + copies + odd[:5]
    for text in some[:20]:
        data = (text or "").encode()
        assert [x for x in C.boundaries(np.frombuffer(data, np.uint8)).tolist()] == gear_brute(data)
    for text, (sizes, digests) in zip(some, C.chunk_texts([t if t is None else t.encode() for t in some]), strict=True):
        expected = brute_chunks(text)
        assert sizes == [len(c) for c in expected]
        assert len(digests) == 16 * len(sizes)
        assert all(c.decode() for c in expected)


def test_insertions_move_few_chunks():
    rng = random.Random(3)
    text = prose(rng, 3000)
    moved = text[:9000] + " inserted " + text[9000:]
    assert len(set(brute_chunks(text)) - set(brute_chunks(moved))) <= 4


def brute_spans(rows):
    first, owners, where = {}, defaultdict(set), {}
    for doc, text in sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: r[0]):
        for k, c in enumerate(brute_chunks(text)):
            first.setdefault(c, (doc, k))
            owners[c].add(doc)
            where[doc, k] = c
    out = {}
    for doc, text in rows:
        chunks = brute_chunks(text)
        ends = np.cumsum([0, *map(len, chunks)])
        runs = []
        for wanted in (lambda k: first.get(chunks[k]) != (doc, k), lambda k: len(owners[chunks[k]]) > 1):
            spans, k = [], 0
            while k < len(chunks):
                j = k
                while j < len(chunks) and doc is not None and wanted(j):
                    j += 1
                if j > k and (ends[j] - ends[k] >= C.RUN or (k, j) == (0, len(chunks))):
                    spans.append((int(ends[k]), int(ends[j])))
                k = max(j, k + 1)
            runs.append(spans)
        out[doc] = (len(chunks), int(ends[-1]), runs)
    return out


def test_spans_and_texts(spark):
    clean, shared, copies, odd = corpus()
    texts = clean + shared + copies + odd
    rest = ("x", 1, "y", "of", 2, "z")
    rows = [(t, i, *rest) for i, t in enumerate(texts)] + [(texts[3], None, *rest), (texts[31], 31, *rest)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    expected = brute_spans([(r[1], r[0]) for r in rows])
    got = C.repeated_spans(df).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [[(s["start"], s["stop"]) for s in r[x]] for x in ("spans", "shared_spans")]
        assert (r["n_chunks"], r["n_bytes"], spans) == expected[r["doc_id"]]
    by_id = {r["doc_id"]: r for r in got}
    assert not any(by_id[i]["shared_spans"] for i in range(30))
    assert all(by_id[i]["shared_spans"] for i in range(30, 38))
    assert all(by_id[i]["repeats_of"] == [30] for i in range(31, 35))
    after = {r["doc_id"]: r["text"] for r in C.chunk_dedup(df).collect()}
    assert [after[i] for i in range(31)] == texts[:31]
    assert after[36] == "" and after[35] == texts[35]
    assert after[len(texts) - 1] == "" and after[len(texts) - 2] == "short"
    assert all(len(after[i]) < len(texts[i]) - 150 for i in range(31, 35))


def test_rows_of_one_id_lose_their_own_passages(spark):
    """Two texts of one id and of equal length: one repeats a passage, the other, of two-byte letters, nothing."""
    rng = random.Random(8)
    shared, own = prose(rng, 200), prose(rng, 200)
    repeats = f"{own[:500]} {shared[:600]}"
    other = "".join(rng.choice("äöüßéèñ") for _ in range(len(repeats.encode()) // 2))
    other += "x" * (len(repeats.encode()) - len(other.encode()))
    assert len(other.encode()) == len(repeats.encode())
    rows = [(t, i, "x", 1, "y", "of", 2, "z") for i, t in ((1, shared), (2, repeats), (2, other), (2, repeats), (2, None), (None, shared))]
    got = [(r["doc_id"], r["text"]) for r in C.chunk_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    lost = [t for i, t in got if i == 2 and t not in (None, other)]
    assert got.count((2, other)) == 1 and got.count((1, shared)) == 1 and got.count((2, None)) == 1 and got.count((None, shared)) == 1
    assert len(lost) == 2 and lost[0] == lost[1] and own[:400] in lost[0] and len(lost[0]) < len(repeats) - 400


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repeated_spans(empty).collect() == [] and C.chunk_dedup(empty).collect() == []
