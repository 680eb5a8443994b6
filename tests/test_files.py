"""Files: fingerprints of large ones, JSON Lines with a tree of digests, streams that resume, phrases in texts."""

import hashlib
import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.operators import dedup
from corpusmill.sources import folders, readers, sinks
from corpusmill.streaming import incremental


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fingerprints_of_large_files(spark, tmp_path):
    """A sparse file over 2 GB, beside small ones and one whose name has a space."""
    size = (1 << 31) + 5
    with open(tmp_path / "large.bin", "wb") as f:
        os.truncate(f.fileno(), size)
    (tmp_path / "small x.bin").write_bytes(b"abc")
    (tmp_path / "none.bin").write_bytes(b"")
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        digest.update(zeros)
    digest.update(zeros[: size & ((1 << 24) - 1)])
    got = rows(readers.fingerprints(spark, str(tmp_path), "*.bin").select("name", "bytes", "sha256"))
    assert got == sorted([("large.bin", size, digest.hexdigest()), ("small x.bin", 3, hashlib.sha256(b"abc").hexdigest()), ("none.bin", 0, hashlib.sha256(b"").hexdigest())], key=str)


def test_listings(spark, tmp_path):
    for name in ("a/b/c", "a/d", "e"):
        (tmp_path / name).mkdir(parents=True)
    for name in ("x.txt", "a/y", "a/b/c/z"):
        (tmp_path / name).write_text("12")
    flat = rows(readers.listing(spark, str(tmp_path)).select("name", "is_dir", "bytes"))
    assert flat == sorted([("a", True, None), ("e", True, None), ("x.txt", False, 2)], key=str)
    deep = rows(readers.listing(spark, str(tmp_path), deep=True).select("name", "is_dir"))
    assert deep == sorted([("a", True), ("e", True), ("x.txt", False), ("b", True), ("c", True), ("d", True), ("y", False), ("z", False)], key=str)
    assert readers.listing(spark, str(tmp_path / "missing"), deep=True).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=6)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=3), x, max_size=3)), max_leaves=6), max_size=5), st.integers(1, 9), st.sampled_from([None, 0, 1]))
def test_lists_are_read_in_blocks(values, size, indent):
    text = json.dumps(values, indent=indent)
    blocks = [text[i : i + size] for i in range(0, len(text), size)]
    assert [json.loads(x) for x in folders.elements(iter(blocks))] == values


def test_lists_that_are_none(spark, tmp_path):
    assert [list(folders.elements(iter([x]))) for x in ("", " {}", '{"a": [1]}', "[]", "[", "x", "[1, {", "[1 ,2]")] == [[], [], [], [], [], [], ["1"], ["1", "2"]]
    sinks.write_lists(spark.range(25).selectExpr("id", "nullif(id, 3) as n").repartition(4), str(tmp_path / "l"))
    for f in (tmp_path / "l").glob("part-*"):
        assert isinstance(json.loads(f.read_text()), list)
    (tmp_path / "o.json").write_text('{"id": 99}')
    (tmp_path / "m.json").write_text('[{"id": 50, "other": [1]},\n {"id": null}, {"id": 51}]')
    got = readers.reports(spark, [str(tmp_path / x) for x in ("l", "o.json", "none", "m.json")], "id long")
    assert sorted(r[0] for r in got.collect()) == [*range(25), 50, 51]


def records(spark, n=700):
    some = [(i, None if i % 3 == 0 else f"é {i % 40}", {"z": i, "a": None, "m": 1} if i % 2 else None, (None, "x")) for i in range(n)]
    return spark.createDataFrame([*some, some[5], (None, "no key", None, None)], "id long, text string, counts map<string,int>, s struct<b:string,a:string>")


def test_json_lines_keep_nulls_and_sort_keys(spark, tmp_path):
    sinks.write_jsonl(records(spark, 8), str(tmp_path / "out"), ["id"], files=1)
    lines = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert '{"counts":{"a":null,"m":1,"z":1},"id":1,"s":{"a":"x","b":null},"text":"é 1"}' in lines
    assert '{"counts":null,"id":0,"s":{"a":"x","b":null},"text":null}' in lines
    for line in lines:
        assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def tree(spark, path):
    return sinks.digest_tree(sinks.leaf_digests(sinks.read_tree(spark, path)))


def lines_of(path):
    """Each leaf's lines, its files in order of name."""
    return {leaf.name: "".join(f.read_text() for f in sorted(leaf.glob("part-*"))) for leaf in path.glob("leaf=*")}


def test_one_root_for_any_partitions(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name, n in (("a", 2), ("b", 9)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            sinks.write_tree(records(spark).repartition(n + 1), str(tmp_path / name), "id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    a, b = (tree(spark, str(tmp_path / x)) for x in "ab")
    assert rows(a) == rows(b) and lines_of(tmp_path / "a") == lines_of(tmp_path / "b")
    root = a.where("level = 2").first()
    assert root["n"] == 702 and sinks.changed_leaves(a, b) == []


def test_only_leaves_that_differ_are_read(spark, tmp_path):
    path = tmp_path / "t"
    sinks.write_tree(records(spark), str(path), "id")
    known = spark.createDataFrame(tree(spark, str(path)).collect())
    changed = records(spark).withColumn("text", F.when(F.col("id") == 77, "changed").otherwise(F.col("text")))
    sinks.write_tree(changed, str(tmp_path / "u"), "id")
    leaf = records(spark).where("id = 77").select(sinks.leaf_of("id")).first()[0]
    assert sinks.changed_leaves(known, tree(spark, str(tmp_path / "u"))) == [leaf]
    assert rows(sinks.recheck(spark, str(tmp_path / "u"), known)) == [(leaf, "checksum")]
    found = sinks.recheck(spark, str(tmp_path / "u"), known, [leaf, leaf + 1])
    assert rows(found) == [(leaf, "checksum")]
    assert "PartitionFilters: [isnotnull(leaf" in sinks.read_tree(spark, str(path), [leaf])._jdf.queryExecution().toString()
    for f in (path / f"leaf={leaf}").iterdir():
        f.unlink()
    (path / f"leaf={leaf}").rmdir()
    assert rows(sinks.recheck(spark, str(path), known)) == [(leaf, "missing")]
    assert rows(tree(spark, str(path))) != rows(known)


@pytest.mark.parametrize("sliced", [False, True])
def test_streams_keep_no_state(spark, tmp_path, sliced):
    """Cases that come again in a batch, in later batches and after a restart are scored once; a batch tried again repeats nothing."""
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    calls = []

    def score(df):
        calls.append(df.count())
        return df.select("case_id", F.length("prompt").alias("n"))

    def run():
        day = F.col("day") if sliced else None
        query = incremental.evaluated_stream(spark, str(source), "case_id string, prompt string, day string", score, out, state, slices=day, files=1)
        query.awaitTermination()
        return query

    for k, cases in enumerate([["a", "b", "a"], ["b", "c"], [], ["d", "a", "e"]]):
        (source / f"{k}.json").write_text("".join(json.dumps({"case_id": x, "prompt": x * 3, "day": "d" + str(ord(x) % 2)}) + "\n" for x in cases))
        query = run()
    assert rows(spark.read.parquet(out).select("case_id", "n")) == [(x, 3) for x in "abcde"]
    assert sum(calls) == 5 and not query.lastProgress or not query.lastProgress["stateOperators"]
    done = [f for f in os.listdir(f"{state}/commits") if f.isdigit()]
    for name in (max(done, key=int), f".{max(done, key=int)}.crc"):  # as if it had died at the end of the last batch
        os.remove(f"{state}/commits/{name}")
    run()
    assert rows(spark.read.parquet(out).select("case_id", "n")) == [(x, 3) for x in "abcde"]


TEXTS = [(1, "the of the a the"), (2, "of the a"), (3, "the\nof é the"), (4, None), (5, ""), (6, "x" * 70_000 + " the of the "), (7, "the of thE")]
PHRASES = [(10, "the of the"), (11, "of the a"), (12, "é"), (13, ""), (14, None), (15, "the of the"), (None, "the\n"), (16, "ab")]


@pytest.mark.parametrize("limit", [None, 0])
def test_phrases_of_frequent_words(spark, limit):
    texts, phrases = spark.createDataFrame(TEXTS, "k int, t string"), spark.createDataFrame(PHRASES, "i int, p string")
    got = rows(dedup.containing(texts, phrases, "k", "t", "i", "p", limit))
    assert got == sorted({(k, i) for k, t in TEXTS for i, p in PHRASES if t is not None and p is not None and p in t}, key=str)


def test_no_phrases(spark):
    texts, none = spark.createDataFrame(TEXTS, "k int, t string"), spark.createDataFrame([], "i int, p string")
    assert dedup.containing(texts, none, "k", "t", "i", "p").collect() == []
    assert dedup.containing(texts.limit(0), spark.createDataFrame(PHRASES, "i int, p string"), "k", "t", "i", "p").collect() == []


def test_equal_requests_are_asked_once(spark, tmp_path):
    """A stub counts what it is asked, over two runs; failures are asked again by the next run, answers aren't."""
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    folder = str(calls)

    def model(frame):
        import uuid

        for q in frame["q"]:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("null" if q is None else q)
        if (frame["q"] == "bad").any():
            raise ConnectionError("secret")
        return frame.assign(a=["none" if q is None else q.upper() for q in frame["q"]], cost=1)

    rows_ = [(i, ["x", "y", None, "bad"][i % 4], "other") for i in range(40)]
    df = spark.createDataFrame(rows_, "id int, q string, o string").repartition(4)
    asked = lambda: sorted(f.read_text() for f in calls.iterdir())
    expected = sorted((i, q, o, None if q == "bad" else q.upper() if q else "none", None if q == "bad" else 1, "ConnectionError" if q == "bad" else None) for i, q, o in rows_)
    for run in (1, 2):
        got = readers.answered(df, ["q"], model, "a string, cost long", store, tries=2, wait=0.001)
        assert sorted(map(tuple, got.select("id", "q", "o", "a", "cost", "error").collect())) == expected
        before = asked()
        if run == 1:
            assert {q: before.count(q) for q in ("x", "y", "null")} == {"x": 1, "y": 1, "null": 1} or before.count("bad") >= 2  # beside a failing request in one batch, others are tried again
            for f in calls.iterdir():
                f.unlink()
    assert set(asked()) == {"bad"}
