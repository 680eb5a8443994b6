import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import packing as K

SCHEMA = "ids string, doc_id long, text string, length string, part int, left boolean"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


ENCODER = K.Encoder(PATH, K.END)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("aAéÉΣσ' \t\n\x0b\x85\xa0́‍.,1x<|>", max_size=60), st.sampled_from(["<|endoftext|> a", "it's I'LL 'sa", "x <|startoftext|><|endoftext|>y"])), max_size=6))
def test_words_give_the_ids_of_the_text(tokenizer, texts):
    assert [x.tolist() for x in ENCODER.encode(pa.array(texts, pa.string()))] == [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def check(rows, docs, size, tokenizer):
    """Every id lies in one piece, offsets have no gaps, and no sequence is too long; the padding and the tokens."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, text in docs:
        want[i].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        found = sorted((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]) for r in pieces)
        assert all(len(r["ids"]) == 4 * r["length"] for r in pieces)
        if len(want[i]) == 1:
            at = 0
            for start, ids, tokens in found:
                assert (start, tokens) == (at, len(want[i][0]))
                at += len(ids)
            assert sum((ids for _, ids, _ in found), []) == want[i][0]
        else:
            assert sorted(sum((ids for _, ids, _ in found), [])) == sorted(sum(want[i], []))
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= size
        padding, total = padding + (size - at if at & (at - 1) else 0), total + at
    return padding, total


def corpus(n):
    rng = random.Random(7)
    words = ["alpha", "Beta", "γάμμα", "naïve", "don't", "x1y2", "漢字", "—", "end."]
    docs = [(i, " ".join(rng.choices(words, k=int(rng.expovariate(1 / 150)) + 1))) for i in range(n)]
    return docs + [(-1, None), (-2, ""), (-3, " \n"), (None, "null id"), (-4, " ".join(rng.choices(words, k=40_000))), docs[3], docs[3], (4, "other text of an id")]


@pytest.mark.parametrize(("parts", "windows", "size"), [(1, 4, 1024), (40, 3, 1024), (40, 128, 4096)])
def test_round_trip(spark, tokenizer, parts, windows, size):
    docs = corpus(400)
    df = spark.createDataFrame([("i", i, t, "l", 1, None) for i, t in docs], SCHEMA).repartition(parts)
    pieces = K.pack(df, PATH, size=size, windows=windows)
    rows = pieces.collect()
    padding, total = check(rows, docs, size, tokenizer)
    assert padding < (0.02 if windows > 100 else 0.05) * total
    whole = K.sequences(pieces, size, pad=9).collect()
    ids = {r["sequence_id"]: b"" for r in rows}
    for r in sorted(rows, key=lambda r: r["offset"]):
        ids[r["sequence_id"]] += r["ids"]
    for r in whole:
        own = ids[r["sequence_id"]]
        n = len(own) // 4
        assert r["n_tokens"] == n and r["ids"] == own + (9).to_bytes(4, "little") * (0 if n & (n - 1) == 0 else size - n)
    assert len(whole) == len(ids)


def test_best_fit_and_bounded_space():
    w = K.Windows(10, most=2)
    assert [w.put(n) for n in (6, 7, 3, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert w.emitted() == [1]
    assert w.put(5) == (2, 0) and w.emitted() == []
    assert w.put(9) == (3, 0) and w.emitted() == [0]  # the fullest goes
    w.finished(1)
    assert w.emitted() == [3] and [s for s, _ in w.spaces] == [5]


def test_empty_table_and_size(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert K.pack(none, PATH).collect() == []
    with pytest.raises(ValueError):
        K.pack(none, PATH, size=1000)
