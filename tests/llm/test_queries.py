"""The operators' queries against their DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from corpusmill.llm.oracles import ORACLES
from corpusmill.llm.queries import QUERIES


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, sf_dir, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(found.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op13_bounded_packing"}))
def test_one_row_a_document(spark, sf_dir, name):
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    got = QUERIES[name](spark, sf_dir).select("doc_id")
    assert got.exceptAll(ids).count() == ids.exceptAll(got).count() == 0


def test_packing_query(spark, sf_dir):
    """Each document's ids, in one piece each, by their CRC-32."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(QUERIES["op13_bounded_packing"](spark, sf_dir).collect(), key=lambda r: (r["doc_id"], r["start"]))
    expected, places = [], {(r["doc_id"], r["start"]): r["length"] for r in rows}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        while at < len(ids):
            n = places[d["doc_id"], at]
            expected.append((d["doc_id"], at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
        assert at == len(ids)
    assert [tuple(r)[:5] for r in rows] == sorted(expected)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
