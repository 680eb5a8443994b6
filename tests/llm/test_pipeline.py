"""The stages against brute-force versions on a small corpus with planted cases."""

import os
import random

import pytest

import corpus_pipeline as P

SCHEMA = "lang string, doc_id long, text string, source string, n_chars long, extra string"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "en", "ing", "or", "um", "ist", "est", "ov")]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [prose(25) for _ in range(4)]
    rows, kinds = [], {}

    def add(text, kind, source=None):
        kinds[len(rows)] = kind
        rows.append(("en", len(rows), text, source or f"s{rng.randrange(20)}", len(text or ""), "x"))

    for _ in range(60):
        add("\n".join(prose(rng.randint(20, 60)) for _ in range(3)), "clean")
    for i in range(15):
        add(prose(80) + "\nsubscribe to our newsletter today\n" + prose(40), "line", f"s{i}")
    for _ in range(5):
        base = prose(300)
        add(base, "first")
        for _ in range(3):
            words = base.split()
            words[rng.randrange(300)] = "changed"
            add(" ".join(words), "copy")
        add(base, "copy")
    for item in items:
        add(f"{prose(60)} {item} {prose(60)}", "leak")
    add("buy now " * 100, "junk")
    add("short", "junk")
    add(None, "junk")
    add("", "junk")
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, kinds


def test_stages(spark, tables):
    folder, rows, kinds = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = {"quality rules": {"junk"}, "line dedup": set(), "SimHash near-dedup": {"copy"}, "benchmark decontamination": {"leak"}}
    text = {r[1]: r[2] for r in rows}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if name not in gone:
            break
        assert out.columns == P.COLUMNS
        before = {r["doc_id"] for r in docs.collect()}
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) == {i for i in before if kinds[i] not in gone[name]}
        assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "line dedup":
            first = min(i for i in before if kinds[i] == "line")
            for i, r in after.items():
                lost = kinds[i] == "line" and i != first
                assert r["text"] == (text[i].replace("subscribe to our newsletter today\n", "") if lost else text[i])
    sizes = {i: len(r["text"].split()) for i, r in after.items()}
    mixed = out.collect()
    assert {r["doc_id"]: r["size"] for r in mixed} == sizes
    assert sum(r["taken"] for r in mixed) == pytest.approx(sum(sizes.values()), abs=20)
    assert sorted(map(tuple, P.run(spark, folder).collect())) == sorted(map(tuple, mixed))


def test_near_dedup_matches_brute_force(spark, tables):
    """All pairs of five-word shingle sets at a similarity of 0.8, by union-find."""
    folder, rows, _ = tables
    some = [r for r in rows if r[2]]
    sets = [shingles(r[2]) for r in some]
    root = list(range(len(some)))
    for i in range(len(some)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    kept = P.near_dedup(spark, spark.createDataFrame(some, SCHEMA), folder)
    assert {r["doc_id"] for r in kept.collect()} == {some[r][1] for r in set(root)}


ODD = SCHEMA + ", kept_id long, copy int, hash long, leak_id long, text_hash string, of string, node long"


def test_odd_rows(spark, tables):
    """Nulls, repeated rows, a text of a megabyte, ids with two texts, and columns named as the stages name their own."""
    folder, rng = tables[0], random.Random(4)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    more = (7, 7, 7, 7, "x", "y", 7)
    odd = [(None, None, None, None, None, None), ("en", 1, "", "s", 0, ""), ("en", 1, "", "s", 0, ""), ("en", None, "a b " * 30, None, 5, ""), ("en", 2, None, "s", None, "")]
    odd += [("en", 3, long, "s", len(long), ""), ("en", 3, "other " + long, "s", 0, ""), ("en", 4, long, "t", len(long), "")]
    for name, stage in P.STAGES:
        got = stage(spark, spark.createDataFrame([(*r, *more) for r in odd], ODD), folder)
        assert stage(spark, spark.createDataFrame([], ODD), folder).collect() == []
        rows = got.collect()
        assert len(rows) == {"quality rules": 3, "SimHash near-dedup": 4}.get(name, 8), name
        if "text" in got.columns:
            assert sum(r["doc_id"] in (3, 4) for r in rows) == (1 if name == "SimHash near-dedup" else 3)


def test_run_leaves_only_its_result(spark, tables, tmp_path):
    from corpusmill.llm import common

    folder = tables[0]
    before = set(os.listdir(common.shared_dir(spark).removeprefix("file:")))
    n = P.run(spark, folder).count()
    after = set(os.listdir(common.shared_dir(spark).removeprefix("file:"))) - before
    assert n and [x.rpartition("-")[0] for x in after if not x.startswith(".")] == ["stage-4"]
