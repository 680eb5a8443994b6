import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import lines as L

SCHEMA = "doc_id long, source string, text string, n_lines string, site int, id string, _of int, of string, Gone string"
SPACE = " \t\n\x0b\f\r"


def brute(rows, least):
    sites, first = defaultdict(set), {}
    for doc, site, text, *_ in rows:
        for line in (text or "").split("\n"):
            if (key := line.strip(SPACE)):
                sites[key] |= {site} - {None}
                if doc is not None:
                    first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, site, text, *_ in rows:
        lines = text.split("\n") if text is not None else []
        stay = [x for x in lines if not (k := x.strip(SPACE)) or len(sites[k]) < least or (doc is not None and first.get(k) == doc)]
        out.append((doc, site, text if text is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(1)
    common = {n: f"line on {n} sités" for n in (1, 5, 8, 9, 10, 11, 12, 40)}
    out = []
    for site in range(60):
        for _ in range(3):
            lines = [f"{rng.choice(['', '  '])}{x}{rng.choice(['', chr(9)])}" for n, x in common.items() if site < n] + [f"own {rng.random()}" for _ in range(3)] + rng.choice([[], ["", " \t"]])
            rng.shuffle(lines)
            out.append((len(out), f"s{site}", "\n".join(lines), "n", 1, "i", 2, "of", "g"))
    out += [(1000, "s1", None, "n", 1, "i", 2, "of", "g"), (1001, "s1", "", "n", 1, "i", 2, "of", "g"), (1002, None, common[9], "n", 1, "i", 2, "of", "g"), (None, "s3", common[40], "n", 1, "i", 2, "of", "g")]
    return out + [out[2], out[2], (0, "s5", common[40], "n", 1, "i", 2, "of", "g"), (1003, "s2", "\n".join(["w", common[12]] * 5000), "n", 1, "i", 2, "of", "g")]


@pytest.mark.parametrize("least", [10, 1])
def test_matches_brute_force(spark, least):
    some = rows()
    got = L.line_dedup(spark.createDataFrame(some, SCHEMA).repartition(3), min_sites=least)
    assert got.columns == ["doc_id", "source", "text", "site", "id", "_of", "of", "Gone", "n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["source"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=str) == brute(some, least)


def test_spread_is_exact_near_the_threshold(spark):
    found = L.line_spread(spark.createDataFrame(rows(), SCHEMA), "doc_id", "text", "source", 10)
    assert sorted(r["sites"] or 0 for r in found.collect()) == [0, 0, 10, 11]  # those on 12 and 40 sites are sure


def test_empty_table_and_numeric_sites(spark):
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(i, float(i), "same") for i in range(12)], "doc_id long, source double, text string")
    assert L.line_dedup(df).agg(F.sum("n_removed")).first()[0] == 11
