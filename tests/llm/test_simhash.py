import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import simhash as S

SCHEMA = "text string, doc_id long, fp string, root string, node long, extra array<int>"


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius):
    """values: list of (id, fingerprint) -> least id reachable, by plain union-find over all pairs."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i][1] ^ values[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(values):
        r = find(i)
        least[r] = min(least.get(r, x), x, key=lambda v: (v is None, v))
    return [least[find(i)] for i in range(len(values))]


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 400))) for _ in range(40)]
    out = [*base, *base[:5], None, "", "  \t\n", "one", "Two Words", "two  words"]
    for text in base[:10]:
        for _ in range(4):
            words = text.split()
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    out.append(" ".join(rng.choices(vocabulary, k=60_000)))
    return out


def test_fingerprints_match_brute_force(monkeypatch):
    some = texts()
    raw = [t if t is None else t.encode() for t in some]
    expected = [brute_print(t) for t in some]
    assert [int(x) for x in S.fingerprints(raw, 3)] == expected
    pieces = S.pieces
    monkeypatch.setattr(S, "pieces", lambda t, k: pieces(t, k, 50))
    assert [int(x) for x in S.fingerprints(raw, 3)] == expected


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 9])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    x = rng.integers(0, 2**63, size=(190, 2), dtype=np.uint64)
    x[100:150] = x[:50] ^ (np.uint64(1) << rng.integers(0, 64, size=(50, 2), dtype=np.uint64))
    x[150:] = x[:40]
    planes = S.planes_of(x)
    q, w = np.divmod(np.arange(190 * 3), 3)
    close = np.unpackbits(S.close_lanes(x[q], w, planes, radius, np.zeros(570, np.uint64)).view(np.uint8).reshape(190, -1), axis=1, bitorder="little")
    expected = [[sum(int(p).bit_count() for p in (a ^ b)) <= radius for b in x] for a in x]
    assert (close[:, :190] == np.array(expected)).all()
    parent = list(range(190))
    for i in range(190):  # least index reachable
        for j in np.flatnonzero(expected[i]):
            a, b = sorted((parent[i], parent[j]))
            parent = [a if p == b else p for p in parent]
    assert S.block_components(x, np.array([190]), radius).tolist() == parent


def components(x, sizes, radius):
    """The first of each fingerprint's block that it reaches, by all pairs."""
    out = []
    for start, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        root = list(range(n))
        near = np.bitwise_count(x[start : start + n, None] ^ x[None, start : start + n]).sum(axis=2) <= radius
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = sorted((root[i], root[j]))
            if a != b:
                root = [a if r == b else r for r in root]
        out += [int(start) + r for r in root]
    return out


@pytest.mark.parametrize("tile", [1 << 14, 50])
def test_blocks_of_all_sizes(monkeypatch, tile):
    """Links come from bit planes only: no distance is a popcount."""
    monkeypatch.setattr(S, "TILE", tile)
    rng = np.random.default_rng(tile)
    sizes = np.array([1, 2, 64, 65, 300, 3, 700, 128])
    x = rng.integers(0, 2**64, size=(sizes.sum(), 2), dtype=np.uint64)
    for i in range(len(x)):  # chains, and in one block mostly near-copies
        if rng.random() < (0.95 if 435 <= i < 1100 else 0.3):
            x[i] = x[max(0, i - int(rng.integers(1, 90)))] ^ np.uint64(1 << int(rng.integers(64)))
    expected = components(x, sizes, 3)
    monkeypatch.setattr(S.np, "bitwise_count", None)
    assert S.block_components(x, sizes, 3).tolist() == expected


@pytest.mark.parametrize("block", [4096, 3])
def test_components_match_brute_force(spark, block):
    """block=3 sends most blocks the way of those beyond the size."""
    rows = [(t, None if i == 7 else 1000 - i, "x", "y", 1, [1]) for i, t in enumerate(texts())]
    rows += [rows[0], rows[12]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = S.simhash_components(df, block=block).withColumn("fingerprint", S.fingerprint_hex(F.col("fingerprint"))).collect()
    prints = [(r[1], brute_print(r[0])) for r in rows]
    expected = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints, 2), strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == expected


def test_many_near_values_in_one_block(spark):
    rng = random.Random(1)
    values = {0}
    while len(values) < 400:
        values.add(rng.choice(sorted(values)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    for block in (4096, 16, 1):
        links = S.exact_links(spark.createDataFrame([(v,) for v in signed], "node long"), 2, block)
        roots = {r["root"] for r in S.connected_components(links).collect()}
        assert len(roots) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.simhash_components(empty).collect() == []
    assert S.near_duplicates(empty).collect() == []


def test_near_duplicates_at_a_similarity(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows, groups = [], []
    for g in range(30):
        words = rng.choices(vocabulary, k=300)
        for copy in range(4):
            own = list(words)
            for _ in range(copy):  # each changed word spoils 5 of 296 shingles
                own[rng.randrange(300)] = "new"
            rows.append((" ".join(own), len(rows), "a", "b", 2, []))
            groups.append(g)
    half = rng.choices(vocabulary, k=150)
    for _ in range(2):  # half in common: a similarity of a third
        rows.append((" ".join(half + rng.choices(vocabulary, k=150)), len(rows), "a", "b", 2, []))
        groups.append(len(groups))
    rows += [("", 900, "", "", 1, []), (None, 901, "", "", 1, []), ("x", None, "", "", 1, []), rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (4096, 4):
        found = S.near_duplicates(df, block=block).collect()
        got = {r["doc_id"]: r["component_id"] for r in found}
        assert all(r["stays"] == (r["doc_id"] == r["component_id"]) for r in found)
        assert len(got) == len(found) == 124
        assert [got[i] for i in range(122)] == [groups.index(g) for g in groups]
        assert got[901] == 900


@pytest.mark.parametrize("block", [4096, 5])
def test_similarities_about_the_limit(spark, block):
    """Pairs of 0.70 to 0.85 link just if their shingle sets have 0.8, and template-like texts don't chain."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows = []

    def sets(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    for n in (30, 60, 300, 800):
        for i in range(40):
            words = rng.choices(vocabulary, k=n + 4)
            common = round(n * 2 * (s := 0.70 + 0.15 * i / 39) / (1 + s)) + 4  # shingles of the two in common
            for text in (words, words[:common] + rng.choices(vocabulary, k=n + 4 - common)):
                rows.append((" ".join(text), len(rows), "a", "b", 1, []))
    template = rng.choices(vocabulary, k=250)
    for _ in range(60):  # about 0.7 to each other
        rows.append((" ".join(template + rng.choices(vocabulary, k=50)), len(rows), "a", "b", 1, []))
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    linked = [len((a := sets(rows[i][0])) & (b := sets(rows[i + 1][0]))) >= 0.8 * len(a | b) for i in range(0, 320, 2)]
    assert {True, False} == set(linked)
    assert [got[i + 1] == i for i in range(0, 320, 2)] == linked
    assert all(got[i] == i for i in range(320, 380))


def test_ids_with_several_texts(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(rng.choices([f"v{i}" for i in range(900)], k=50)) for _ in range(3))
    rows = [(a, 1, "", "", 1, []), (b, 1, "", "", 1, []), (b, 2, "", "", 1, []), (c, 3, "", "", 1, []), (a, 1, "", "", 1, [])]
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4
    assert sum(r["stays"] for r in got) == 3  # a, c, and one of the two b
    assert sorted(r["doc_id"] for r in got if not r["stays"]) in ([1], [2])


def test_large_groups_of_near_copies(spark):
    """Beyond the block size, what is near the first member needn't meet again, and chains to it aren't lost."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    words, rows = rng.choices(vocabulary, k=200), []
    for i in range(60):
        own = list(words)
        for at in rng.sample(range(200), 2):
            own[at] = f"new{i}"
        rows.append((" ".join(own), i, "a", "b", 1, []))
    for i in range(12):  # each a step further from the first, linked to the one before
        for at in range(6 * i, 6 * i + 4):
            words[at] = f"far{i}"
        rows.append((" ".join(words), 100 + i, "a", "b", 1, []))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(196)} for t, *_ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    for block in (4096, 20, 4):
        got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
        assert [got[r[1]] for r in rows] == [rows[x][1] for x in root]


def test_components_of_sets():
    rng = random.Random(3)
    sets = [np.unique(np.array(rng.choices(range(14), k=12), np.uint64)) for _ in range(150)]
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) >= 0.8 * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert S.similar_components(sets, 0.8).tolist() == root
    assert len(set(root)) > 3
