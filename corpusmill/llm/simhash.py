"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that agree on a key share a block. In a block the fingerprints are
stored as bit planes (plane p holds bit p of 64 fingerprints a word); distances
of a tile of queries to the 64 lanes of many words are counted at once by
carry-save bitwise counters, and a word is abandoned for a query once all its
lanes exceed the radius. All links are found that way. Components of each block
leave as stars, never as all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, parts, utf8, written
from corpusmill.llm.graph import connected_components

#: Bytes of text hashed at once within one document.
PIECE = 1 << 22
#: Members of a block compared in one task; larger blocks are split, exactly.
BLOCK = 4096
#: Pairs of a query and a word of 64 lanes compared at once.
TILE = 1 << 14
#: Planes after which words are abandoned.
STEP = 16
#: Bytes of shingle sets compared in one task.
SET_BYTES = 1 << 25
#: Standard deviations of the fingerprints' distance within which a pair is a candidate.
MARGIN = 4.0
_SHIFTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of the A-Z lower-cased text, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def pieces(text: bytes | None, k: int, size: int = PIECE) -> Iterator[bytes]:
    """A text cut at spaces so that the pieces' k-word shingles are the text's; at most about size bytes each."""
    if not text or len(text) <= size:
        yield text or b""
        return
    tail: list[bytes] = []
    start = 0
    while start < len(text):
        stop = start + size
        while stop < len(text) and text[stop] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            stop += 1
        words = text[start:stop].split()
        start = stop
        words = tail + words
        if len(words) >= k or start >= len(text):
            yield b" ".join(words)
            tail = words[len(words) - k + 1 :] if k > 1 and len(words) >= k else ([] if k == 1 else words)
        else:
            tail = words


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each segment of hashes (from starts on, none empty) how many have each of the 64 bits set."""
    n = len(hashes)
    out = np.zeros((len(starts), 64), np.int64)
    cuts = np.concatenate([np.arange(s, e, 255) for s, e in zip(starts, [*starts[1:], n], strict=True)]) if n else starts
    owner = np.searchsorted(starts, cuts, "right") - 1
    step = 1024  # cuts at once: at most 255 * 1024 hashes
    for i in range(0, len(cuts), step):
        stop = cuts[i + step] if i + step < len(cuts) else n
        bits = np.unpackbits(hashes[cuts[i] : stop].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        lanes = np.add.reduceat(bits, cuts[i : i + step] - cuts[i], axis=0).view(np.uint8)
        if len(starts) == 1:
            out[0] += lanes.sum(axis=0, dtype=np.int64)
        else:
            np.add.at(out, owner[i : i + step], lanes)
    return out


def fingerprints(texts: list[bytes | None], k: int) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if set in over half the shingle hashes; 0 without words."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for first in range(0, len(texts), 512):
        counts, total = np.zeros((min(512, len(texts) - first), 64), np.int64), np.zeros(min(512, len(texts) - first), np.int64)
        parts, owners = [], []
        for i, text in enumerate(texts[first : first + 512]):
            for piece in pieces(text, k):
                if len(h := shingle_hashes(piece, k)):
                    total[i] += len(h)
                    if len(h) > 100_000:  # long texts are counted piece by piece
                        counts[i] += bit_counts(h, np.array([0]))[0]
                    else:
                        parts.append(h)
                        owners.append(i)
        if parts:
            sizes = np.array([len(p) for p in parts])
            np.add.at(counts, owners, bit_counts(np.concatenate(parts), np.cumsum(sizes) - sizes))
        out[first : first + 512] = ((2 * counts > total[:, None]).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return out


def planes_of(fps: np.ndarray) -> np.ndarray:
    """fps (m, words of 64 bits) -> bit planes (64 * words, ceil(m / 64)): lane j of plane p is bit p of fingerprint j."""
    m = len(fps)
    padded = np.zeros((-(-m // 64) * 64, fps.shape[1] * 64), np.uint8)
    padded[:m] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(m, -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64)


def close_lanes(queries: np.ndarray, words: np.ndarray, planes: np.ndarray, radius: int, skip: np.ndarray) -> np.ndarray:
    """For each pair of a query and a word of the planes, the lanes (bits) within radius, but for those of skip."""
    full, one = ~np.uint64(0), np.uint64(1)
    out = np.zeros(len(queries), np.uint64)
    rows, over = np.flatnonzero(skip != full), skip[skip != full]
    queries, words = queries[rows], words[rows]
    counters = [np.zeros(len(rows), np.uint64) for _ in range(max(1, radius.bit_length()))]
    for p in range(len(planes)):
        if not len(rows):
            return out
        asked = np.negative(queries[:, p >> 6] >> np.uint64(p & 63) & one)  # all lanes or none
        carry = planes[p][words] ^ asked
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if p % STEP == STEP - 1:
            over |= _exceeds(counters, radius)
            alive = np.flatnonzero(over != full)
            if 4 * len(alive) < 3 * len(rows):  # words all of whose lanes are beyond the radius
                rows, over, queries, words, counters = rows[alive], over[alive], queries[alive], words[alive], [c[alive] for c in counters]
    out[rows] = ~(over | _exceeds(counters, radius))
    return out


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over radius, by a bitwise comparison from the top bit."""
    more = np.zeros_like(counters[0])
    equal = ~more
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more |= equal & counters[k]
            equal = equal & ~counters[k]
    return more


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root, each member's least known relative, after the links a - b."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


class _Lanes:
    """Blocks of fingerprints as bit planes: each block has words of its own."""

    def __init__(self, fps: np.ndarray, order: np.ndarray, sizes: np.ndarray) -> None:
        """order: the members, block after block, of the given sizes."""
        self.fps, self.words = fps, -(-sizes // 64)
        self.first = np.cumsum(self.words) - self.words
        at = np.repeat(self.first * 64 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(order))
        self.member = np.full(int(self.words.sum()) * 64, -1)
        self.member[at] = order
        padded = np.zeros((len(self.member), fps.shape[1]), np.uint64)
        padded[at] = fps[order]
        self.planes = planes_of(padded)
        self.padding = np.packbits(self.member < 0, bitorder="little").view(np.uint64)

    def compare(self, root: np.ndarray, lanes: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
        """root after the links of queries (by their lanes) to the members in these words before them."""
        for i in range(0, len(lanes), TILE):
            q, w = lanes[i : i + TILE], words[i : i + TILE]
            later = np.where(q >> 6 == w, ~np.uint64(0) << (q & 63).astype(np.uint64), np.uint64(0))
            near = close_lanes(self.fps[self.member[q]], w, self.planes, radius, later | self.padding[w])
            if len(hit := np.flatnonzero(near)):
                pair, lane = np.nonzero(np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                root = joined(root, self.member[q[hit[pair]]], self.member[w[hit[pair]] * 64 + lane])
        return root


def block_components(fps: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """fps of blocks one after another, and the blocks' sizes -> for each fingerprint the first of its block reachable by links within radius.

    Each query meets the words of members before it. In a block of several words
    the first 64 are compared with all; what is in the largest component then
    needn't meet again, so the members outside it come last, and only they are
    queries: a block of near-copies costs one tile.
    """
    root, starts = np.arange(len(fps)), np.cumsum(sizes) - sizes
    small = np.repeat(sizes <= 64, sizes)
    if small.any():
        members = np.flatnonzero(small)
        lanes = _Lanes(fps, members, sizes[sizes <= 64])
        at = np.flatnonzero(lanes.member >= 0)
        root = lanes.compare(root, at, at >> 6, radius)
    for start, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        own = np.arange(start, start + n)
        # the first 64 as queries come last, after all others
        order = np.concatenate([own[64:], own[:64]])
        for first in (n - 64, None):
            if first is None:
                kinds, counts = np.unique(root[own], return_counts=True)
                main = root[own] == kinds[counts.argmax()]
                order, first = np.concatenate([own[main], own[~main]]), int(main.sum())
                if counts.max() == 1:
                    order, first = own, 64  # the first 64 have met all
            lanes = _Lanes(fps, order, np.array([n]))
            queries = np.arange(first, n)
            if not len(queries):
                break
            met = (queries >> 6) + 1
            words = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met)
            root = lanes.compare(root, np.repeat(queries, met), words, radius)
    return root


def block_links(blocks: DataFrame, radius: int) -> DataFrame:
    """blocks (nodes array<long>, fps array<binary>) -> (a, b): each node with its block component's first node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(0)).to_numpy().astype(np.int64)
            if sizes.sum():
                nodes, fps = batch.column(0).flatten().to_numpy(), b"".join(batch.column(1).flatten().to_pylist())
                found = block_components(np.frombuffer(fps, np.uint64).reshape(len(nodes), -1), sizes, radius)
                moved = found != np.arange(len(found))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[found[moved]])], ["a", "b"])

    return arrow_map(blocks.select("nodes", "fps"), run, "a long, b long").where("a <> b")


def sized(keys: DataFrame) -> DataFrame:
    """keys (key, ..) -> those that share a key, with the number n of its members."""
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "of")
    return keys.join(counts, F.col("key") == F.col("of")).drop("of")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocked(members: DataFrame, value: str, *by: str) -> DataFrame:
    """Blocks (nodes, and their values) by key, dealt to as many tasks as shuffles have: they're small in bytes but long to compare, and must not be coalesced."""
    gathered = members.repartition(_tasks(members), *by).groupBy(*by).agg(F.sort_array(F.collect_set(F.struct("node", value))).alias("m"))
    return gathered.select(F.col("m.node").alias("nodes"), F.col(f"m.{value}").alias(f"{value}s"))


def meetings(large: DataFrame, value: str, near: Column, chunks: Column) -> DataFrame:
    """Blocks of large keys (key, node, value, ..): what is near the key's first member, and so in one component, needn't meet again.

    The rest is dealt into chunks, and all members into others; every chunk of the
    rest meets every chunk of all. So a key of near-copies costs nothing more, and
    others the product of the rest and all.
    """
    marked = written(large.select("key", "node", value, near.alias("near"), chunks.alias("q")), "marked")
    rest = marked.where("not near").groupBy(F.col("key").alias("of")).agg(F.count("*").alias("rest"))
    facts = marked.groupBy("key").agg(F.count("*").alias("n"), F.max("q").alias("q")).join(rest, F.col("key") == F.col("of")).select("of", "q", F.ceil(F.col("q") * F.col("rest") / F.col("n")).cast("int").alias("r"))
    dealt = marked.drop("q").join(facts, F.col("key") == F.col("of")).withColumns({"i": F.pmod(F.xxhash64("node"), F.col("q")).cast("int"), "j": F.pmod(F.xxhash64(F.lit(1), "node"), F.col("r")).cast("int")})
    every = dealt.select("key", "node", value, "i", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("j"))
    others = dealt.where("not near").select("key", "node", value, F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("i"), "j")
    return blocked(every.unionByName(others), value, "key", "i", "j")


def first_of(large: DataFrame, value: str) -> DataFrame:
    """large (key, node, value, ..) with first_node and first: the least node of its key, and that one's value."""
    # written, so that the join shuffles both sides and a large key's rows can be split
    firsts = written(large.groupBy(F.col("key").alias("of")).agg(F.min(F.struct("node", value)).alias("f")), "firsts")
    return large.join(firsts.select("of", F.col("f.node").alias("first_node"), F.col(f"f.{value}").alias("first")), F.col("key") == F.col("of")).drop("of")


def large_links(large: DataFrame, radius: int, block: int) -> DataFrame:
    """large (key, node, fp, n), n beyond the block size -> links whose components are those of all pairs within radius of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1)  # noqa: B023, E731
            fps, firsts = read(2), read(5)
            near = np.zeros(batch.num_rows, bool)
            for first in np.unique(firsts, axis=0):
                own = np.flatnonzero((firsts == first).all(axis=1))
                planes = planes_of(fps[own])
                lanes = close_lanes(np.repeat(first[None], planes.shape[1], 0), np.arange(planes.shape[1]), planes, radius, np.zeros(planes.shape[1], np.uint64))
                near[own] = np.unpackbits(lanes.view(np.uint8), bitorder="little")[: len(own)].astype(bool)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(near)], ["key", "node", "fp", "n", "first_node", "near"])

    schema = "key long, node long, fp binary, n long, first_node long, near boolean"
    marked = written(arrow_map(first_of(large, "fp").select("key", "node", "fp", "n", "first_node", "first"), run, schema), "near-first")
    stars = marked.where("near and node <> first_node").select(F.col("node").alias("a"), F.col("first_node").alias("b"))
    return stars.unionByName(block_links(meetings(marked, "fp", F.col("near"), F.ceil(2 * F.col("n") / block).cast("int")), radius))


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _binary(fp: Column) -> Column:
    return F.unhex(F.lpad(F.hex(fp), 16, "0"))


def exact_links(nodes: DataFrame, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """nodes (node long: a distinct 64-bit fingerprint) -> links (a, b) whose components are those of all pairs within radius bits.

    Of four equal parts of the bits two agree at least, so every two parts make a
    key. A block beyond the size is split likewise by the bits that its key doesn't
    hold, half of the bits before: 64, 32, 16. With 8 left it has 256 members at most.
    """
    if radius > 2:
        raise ValueError("exact links are made for up to 2 bits")
    spark, found, width = nodes.sparkSession, [], 64
    rows = nodes.select("node", F.lit(0).cast("long").alias("key"), F.col("node").alias("rest"))
    while width > 8:
        quarter = width // 4
        part = [F.call_function("shiftrightunsigned", "rest", F.lit(i * quarter)).bitwiseAND((1 << quarter) - 1) for i in range(4)]
        halves = [(i, j, *(x for x in range(4) if x not in (i, j))) for i in range(4) for j in range(i + 1, 4)]
        keys = [F.struct(F.xxhash64("key", F.lit(x), part[i], part[j]).alias("key"), part[k].bitwiseOR(F.call_function("shiftleft", part[m], F.lit(quarter))).alias("rest")) for x, (i, j, k, m) in enumerate(halves)]
        members = written(sized(rows.select("node", F.explode(F.array(*keys)).alias("k")).select("node", "k.key", "k.rest")), "members")
        width //= 2
        last = width == 8
        found.append(block_links(blocked((members if last else members.where(F.col("n") <= block)).withColumn("fp", _binary(F.col("node"))), "fp", "key"), radius))
        rows = members.where(F.col("n") > block).select("node", "key", "rest")
        if last or not rows.limit(1).count():
            break
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], "a long, b long"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, block: int = BLOCK) -> DataFrame:
    """(id, fingerprint long, component_id) for each row of docs.

    component_id is the least id reachable by links of at most radius bits. Equal
    fingerprints are one node, so copies of any number cost one comparison. Null
    and empty texts have fingerprint 0 and link like any other; a null id gets a
    row and never is a component_id unless its component has no other. Repeated
    rows and ids each get a row. An empty table gives an empty result; other
    columns aren't read. A long text is hashed in pieces.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(utf8(batch.column(1)), shingle).view(np.int64))], ["id", "fp"])

    rows = written(arrow_map(source, run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long"), "fingerprints")
    values = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected_components(exact_links(values.select(F.col("fp").alias("node")), radius, block))
    rooted = values.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "of")
    named = rooted.join(least, F.col("root") == F.col("of")).select(F.col("fp").alias("value"), "component_id")
    return rows.join(named, F.col("fp") == F.col("value"), "left").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return _hex(fp)


# Near-duplicates at a shingle similarity


def radius_for(similarity: float, bits: int, margin: float = 2.0) -> int:
    """Differing bits that two equally long shingle sets of this Jaccard similarity stay within (margin: standard deviations)."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + margin * math.sqrt(bits * p * (1 - p)))


def mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n odd factors and offsets of min-hash functions, independent of each other."""
    rng = np.random.default_rng(11)
    return rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def wide_signature(texts: list[bytes | None], k: int, words: int, bands: int, rows: int) -> tuple[list[bytes], list[bytes], list[np.ndarray]]:
    """Per text: a digest of its words, a fingerprint of 64 * words bits over its distinct shingles, and min-hash band keys."""
    factors, offsets = mixers(bands * rows)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    digests, prints, keys = [], [], []
    for text in texts:
        digest = xxhash.xxh3_128()
        parts = []
        for piece in pieces(text, k):
            digest.update(b" ".join(piece.lower().split()) + b"\n")
            parts.append(np.unique(shingle_hashes(piece, k)))
        h = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        digests.append(digest.digest())
        least = np.full(bands * rows, ~np.uint64(0))
        counts = np.zeros((words, 64), np.int64)
        for i in range(0, len(h), 1024):
            some = h[i : i + 1024]
            np.minimum(least, (some[:, None] * factors[None, :] + offsets[None, :]).min(axis=0), out=least)
            mixed = some ^ (some >> np.uint64(29))
            for w in range(words):
                x = mixed * _SHIFTS[w]
                x ^= x >> np.uint64(32)
                x *= _SHIFTS[(w + 3) % len(_SHIFTS)]
                counts[w] += bit_counts(x, np.array([0]))[0]
        prints.append(((2 * counts > len(h)).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64).tobytes())
        band = least.reshape(bands, rows) * _SHIFTS[:rows][None, :]
        band ^= band >> np.uint64(31)
        mixed = (band * _SHIFTS[1]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _SHIFTS[2]
        keys.append(mixed.view(np.int64))
    return digests, prints, keys


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    found = [np.unique(shingle_hashes(piece, k)) for piece in pieces(text, k)]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def similar_components(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of a group, the index of the first one reachable by links of at least this Jaccard similarity, all pairs by exact counts.

    A query's intersections with all that is left are counted along the postings of
    its members; members of one component meet once.
    """
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    terms = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(terms, kind="stable")
    held, holders = terms[order], owner[order]
    root = np.full(m, -1)
    left = packed = m
    for first in range(m):
        if root[first] >= 0:
            continue
        root[first] = first
        left -= 1
        waiting = [first]
        while waiting and left:
            x = waiting.pop()
            if 2 * left <= packed:
                live = root[holders] < 0
                held, holders, packed = held[live], holders[live], left
            own = terms[starts[x] : starts[x] + sizes[x]]
            lo, hi = np.searchsorted(held, own), np.searchsorted(held, own, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(holders[at], minlength=m)
            joined = np.flatnonzero((root < 0) & (both > 0) & (both >= similarity * (sizes + sizes[x] - both)))
            root[joined] = first
            left -= joined.size
            waiting.extend(joined.tolist())
    return root


def similar_links(texts: DataFrame, candidates: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """texts (node, text), candidates (node, root: its group) -> (a, b): links of at least the similarity in each group, verified on shingle sets.

    In groups beyond the block size, in members or bytes, what is similar to the
    first member needn't meet again.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 2)):
            sets = [shingle_set(t, shingle).tobytes() for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["key", "node", "set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                nodes = batch.column(0)[i].values.to_numpy()
                found = similar_components([np.frombuffer(x, np.uint64) for x in batch.column(1)[i].as_py()], similarity)
                moved = found != np.arange(len(found))
                if moved.any():
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[found[moved]])], ["a", "b"])

    def near_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for own, first in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
                own, first = np.frombuffer(own, np.uint64), np.frombuffer(first, np.uint64)
                both = len(np.intersect1d(own, first, assume_unique=True))
                near.append(both > 0 and both >= similarity * (len(own) + len(first) - both))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(near, pa.bool_())], ["key", "node", "set", "q", "first_node", "near"])

    sets = written(arrow_map(candidates.join(texts.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).select(F.col("root").alias("key"), "node", "text"), hashed, "key long, node long, set binary").dropDuplicates(["node"]), "shingles")
    counts = sets.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("n"), F.sum(F.octet_length("set")).alias("size"))
    most = F.greatest(F.col("n") / block, F.col("size") / SET_BYTES)
    groups = written(counts.where("n > 1").select("of", F.when(most <= 1, 1).otherwise(F.ceil(2 * most)).cast("int").alias("q")), "groups")
    dealt = sets.join(groups, F.col("key") == F.col("of")).drop("of")
    found = arrow_map(blocked(dealt.where("q = 1"), "set", "key"), run, "a long, b long")
    large = dealt.where("q > 1")
    if not groups.where("q > 1").limit(1).count():
        return found
    marked = written(arrow_map(first_of(large, "set").select("key", "node", "set", "q", "first_node", "first"), near_first, "key long, node long, set binary, q int, first_node long, near boolean"), "near-first")
    stars = marked.where("near and node <> first_node").select(F.col("node").alias("a"), F.col("first_node").alias("b"))
    rest = arrow_map(meetings(marked, "set", F.col("near"), F.col("q")), run, "a long, b long")
    return found.unionByName(stars).unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 8, bands: int = 32, rows: int = 6, block: int = BLOCK) -> DataFrame:
    """(id, text_hash, component_id, stays) for each distinct non-null id and text: groups of documents alike in their shingle sets.

    Sketches only name candidates: blocks come from min-hash bands (at a similarity
    of 0.8 a pair shares one with probability 0.9999), and in a block fingerprints of
    64 * words bits within the radius for the similarity plus MARGIN deviations link.
    In each group of candidates, links are pairs whose shingle sets have the
    similarity, by exact counts; a tie at the similarity links. Exact copies (equal
    words) are one node. text_hash is xxhash64 of the text. An id with several texts
    is several documents, of which the one of the least hash has the id as its name
    in component_id, the others a hash of both. stays: of each group, the document
    of the least name. Null ids aren't compared and have no row. Texts without words
    are copies of each other. A long text is hashed in pieces. An empty table gives
    an empty result; other columns aren't read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 2)):
            digests, prints, keys = wide_signature(utf8(batch.column(2)), shingle, words, bands, rows)
            flat = pa.array(np.concatenate(keys))
            lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * bands, flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(prints, pa.binary()), lists], ["id", "text_hash", "digest", "fp", "keys"])

    signed = written(arrow_map(source, run, "id long, text_hash long, digest binary, fp binary, keys array<long>"), "signatures")
    several = written(signed.groupBy(F.col("id").alias("of")).agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least <> most").select("of", "least"), "several")
    name = F.when(F.col("least").isNull() | (F.col("least") == F.col("text_hash")), F.col("id")).otherwise(F.xxhash64("id", "text_hash"))
    named = lambda df: df.join(several, F.col("id") == F.col("of"), "left").withColumn("node", name).drop("of", "least")
    nodes = written(named(signed.select("id", "text_hash", "digest")).distinct(), "nodes")
    # written, so that the joins shuffle both sides and the rows of many copies can be split
    copies = written(nodes.groupBy("digest").agg(F.min("node").alias("first")), "copies")
    chosen = nodes.join(copies, "digest").where("node = first").select(F.col("id").alias("rep"), F.col("text_hash").alias("rep_hash"), "node")
    reps = signed.join(chosen, (F.col("id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).dropDuplicates(["node"])
    members = written(sized(reps.select("node", "fp", F.explode("keys").alias("key"))), "members")
    radius = radius_for(similarity, 64 * words, MARGIN)
    links = block_links(blocked(members.where(F.col("n") <= block), "fp", "key"), radius)
    large = members.where(F.col("n") > block)
    if large.limit(1).count():
        links = links.unionByName(large_links(large, radius, block))
    same = nodes.join(copies, "digest").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    candidates = connected_components(links)
    wanted = written(candidates.join(chosen.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).select("node", "root", "rep", "rep_hash"), "wanted")
    texts = source.join(wanted, (F.col("id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("node", "text")
    verified = similar_links(texts, wanted.select("node", "root"), shingle, similarity, block)
    roots = connected_components(verified.unionByName(same)).withColumnRenamed("node", "of")
    component = F.coalesce("root", "node")
    return nodes.join(roots, F.col("node") == F.col("of"), "left").select(F.col("id").alias(id_col), "text_hash", component.alias("component_id"), (F.col("node") == component).alias("stays"))
