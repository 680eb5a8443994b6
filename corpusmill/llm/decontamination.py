"""Benchmark decontamination with a distributed positional inverted index.

The index posts every word of the training texts, once. It is dealt by documents:
each segment holds whole documents, numbered one position after another with a gap
between documents, and for each term its sorted positions (its postings). Segments
are rows of a written table.

A query is a window of test words. Its terms get their numbers of postings over the
whole corpus by a join, and the windows go, by their rarest term, to the segments
that post it. There the other terms' positions, adjusted by their offsets, are
intersected, rarest first, until none is left or all agree: an exact phrase. With
slop, each term must occur within so many positions of its place instead: a
proximity match. No list of windows or terms is on the driver or in a closure.

Terms and windows are named by hashes, of 64 and 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, parts, utf8, written

#: A-Z lower-cased; all ASCII but letters and digits separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of text of a segment; a longer document is a segment of its own.
SEGMENT = 1 << 21
#: Windows that one task looks for in one segment at once.
CHUNK = 1 << 16


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def windows_of(words: list[bytes], size: int) -> list[list[bytes]]:
    """Windows of size words; a shorter text, if it has words, is one window."""
    return [words[i : i + size] for i in range(max(1, len(words) - size + 1))] if words else []


def term(word: bytes) -> int:
    """A word's name in the index."""
    n = xxhash.xxh64_intdigest(word)
    return n - 2**64 if n >= 2**63 else n


def _pack(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones, and so on, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b"")


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


SEGMENTS = "segment long, rows binary, n_words binary, starts binary, terms binary, sizes binary, postings binary"


def build_index(docs: DataFrame, text_col: str) -> DataFrame:
    """Segments with the postings of all words, terms in ascending order.

    docs' longs row and row2 together tell the rows apart. Null texts are documents without words.
    """

    def segment(number: int, part: pa.RecordBatch) -> pa.RecordBatch:
        words, counts = [], []
        for text in utf8(part.column(2)):
            own = words_of(text)
            counts.append(len(own))
            words += own
        counts = np.array(counts, np.int64)
        starts = np.cumsum(counts + 1) - counts - 1
        found = pa.array(words, pa.binary()).dictionary_encode()
        names = np.array([term(w) for w in found.dictionary.to_pylist()], np.int64)
        by_name = np.argsort(names)
        place = np.empty(len(names), np.int32)
        place[by_name] = np.arange(len(names), dtype=np.int32)
        codes = place[found.indices.to_numpy()]
        # positions count a gap after each document
        positions = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        order = np.argsort(codes, kind="stable")
        rows = np.stack([part.column(i).to_numpy() for i in range(2)], axis=1).ravel()
        fields = [rows, counts, starts, names[by_name], np.bincount(codes, minlength=len(names)).astype(np.int32), np.diff(positions[order], prepend=np.int32(0))]
        return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([_pack(x)], pa.binary()) for x in fields]], ["segment", "rows", "n_words", "starts", "terms", "sizes", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for part in (part for whole in batches for part in parts(whole, 2, SEGMENT)):
            yield segment(number, part)
            number += 1

    return arrow_map(docs.select("row", "row2", F.col(text_col).alias("text")), run, SEGMENTS)


def _postings(terms: bytes, sizes: bytes, postings: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, where the positions of each end, and the positions."""
    return _unpack(terms, np.int64), np.cumsum(_unpack(sizes, np.int32)), np.cumsum(_unpack(postings, np.int32), dtype=np.int32)


def posted(index: DataFrame) -> DataFrame:
    """(segment, term, n): how often each segment posts each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, terms, sizes in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                names = _unpack(terms, np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(segment, pa.int64()), len(names)), pa.array(names), pa.array(_unpack(sizes, np.int32).astype(np.int64))], ["segment", "term", "n"])

    return arrow_map(index.select("segment", "terms", "sizes"), run, "segment long, term long, n long")


def windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, w binary, terms array<long>): each item's windows, named by a 128-bit hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 1)):
            at, names, terms = [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                own = words_of(text)
                numbers = [term(x) for x in own]
                for k, w in enumerate(windows_of(own, size)):
                    at.append(i)
                    names.append(xxhash.xxh3_128_digest(b" ".join(w)))
                    terms.append(numbers[k : k + size])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.binary()), pa.array(terms, pa.list_(pa.int64()))], ["item", "w", "terms"])

    kind = benchmark.schema[item_col].dataType.simpleString()
    return arrow_map(benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")), run, f"item {kind}, w binary, terms array<long>")


def match(find, terms: np.ndarray, order: np.ndarray, slop: int = 0) -> np.ndarray:
    """Start positions of a window of terms; find: a term's positions; order: its offsets, rarest term first.

    With slop, positions where the rarest term stands if every other term is within slop positions of its place.
    """
    starts = find(terms[order[0]]) - np.int32(order[0])
    for k in order[1:].astype(np.int32):
        if not starts.size:
            break
        other = find(terms[k])
        if not other.size:
            return other
        near = np.searchsorted(other, starts + (k - np.int32(slop)))
        inside = near < other.size
        near[~inside] = 0
        starts = starts[inside & (other[near] <= starts + (k + np.int32(slop)))]
    return starts


FOUND = "row long, row2 long, w binary, start long, stop long"


def search(index: DataFrame, candidates: DataFrame, slop: int = 0) -> DataFrame:
    """candidates (segment, wanted array of (w, terms, ns)) -> (row, row2, w, start, stop): where the windows occur in their segments."""
    asked = candidates.select(F.col("segment").alias("of"), F.col("wanted.w").alias("w"), F.col("wanted.terms").alias("own"), F.col("wanted.ns").alias("ns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, n_words, begins, terms, sizes, lists = (batch.column(c)[i].as_py() for c in range(6))
                keys, n_words, begins = _unpack(rows, np.int64).reshape(-1, 2), _unpack(n_words, np.int64), _unpack(begins, np.int64)
                names, ends, positions = _postings(terms, sizes, lists)

                def find(x: int) -> np.ndarray:
                    at = int(np.searchsorted(names, x))  # noqa: B023
                    if at == len(names) or names[at] != x:  # noqa: B023
                        return np.zeros(0, np.int32)
                    return positions[ends[at - 1] if at else 0 : ends[at]]  # noqa: B023

                hits, starts, stops, docs = [], [], [], []
                for w, own, ns in zip(batch.column(6)[i].as_py(), batch.column(7)[i].as_py(), batch.column(8)[i].as_py(), strict=True):
                    order = np.argsort(ns, kind="stable")
                    if len(at := match(find, np.array(own, np.int64), order, slop)):
                        doc = np.searchsorted(begins, at + order[0], "right") - 1
                        lo = at - begins[doc]
                        hi = lo + len(own)
                        if slop:
                            lo, hi = np.maximum(0, lo - slop), np.minimum(n_words[doc], hi + slop)
                        hits += [w] * len(at)
                        starts.append(lo)
                        stops.append(hi)
                        docs.append(doc)
                if hits:
                    doc = np.concatenate(docs)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[doc, 0]), pa.array(keys[doc, 1]), pa.array(hits, pa.binary()), pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(stops).astype(np.int64))], ["row", "row2", "w", "start", "stop"])

    joined = index.join(asked, F.col("segment") == F.col("of"))
    return arrow_map(joined.select("rows", "n_words", "starts", "terms", "sizes", "postings", "w", "own", "ns"), run, FOUND)


def directory(index: DataFrame) -> DataFrame:
    """(row long, row2 long, n_words long) of every document in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, n_words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = _unpack(rows, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(_unpack(n_words, np.int64))], ["row", "row2", "n_words"])

    return arrow_map(index.select("rows", "n_words"), run, "row long, row2 long, n_words long")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """The directory of docs (row, row2, text), and the (row, row2, item, start, stop) spans of words where benchmark windows occur."""
    index = written(build_index(docs, text_col), "index")
    asked = written(windows(benchmark, item_col, text_col, window), "windows")
    distinct = asked.groupBy("w").agg(F.first("terms").alias("terms"))
    numbered = written(distinct.select("w", F.posexplode("terms").alias("k", "term")), "window-terms")
    vocabulary = numbered.select(F.col("term").alias("known")).distinct()
    places = written(posted(index).join(vocabulary, F.col("term") == F.col("known"), "left_semi"), "places")
    # written, so that the join can split the windows of a frequent term
    counts = written(places.groupBy(F.col("term").alias("known")).agg(F.sum("n").alias("n")), "term-counts")
    # a window with a term that is nowhere posted can't occur
    ranked = numbered.join(counts, F.col("term") == F.col("known"), "left").groupBy("w").agg(
        F.count_if(F.col("n").isNull()).alias("lacking"), F.sort_array(F.collect_list(F.struct("k", "term", "n"))).alias("t"), F.min(F.struct("n", "k", "term"))["term"].alias("rarest")
    )
    able = written(ranked.where("lacking = 0").select("w", F.col("t.term").alias("terms"), F.col("t.n").alias("ns"), "rarest"), "able")
    chunks = able.count() // CHUNK + 1
    candidates = places.join(able, F.col("term") == F.col("rarest")).groupBy("segment", F.pmod(F.xxhash64("w"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("w", "terms", "ns")).alias("wanted"))
    found = written(search(index, written(candidates, "candidates"), slop), "hits")
    items = asked.select(F.col("w").alias("of"), "item").distinct()
    return directory(index), found.join(items, F.col("w") == F.col("of")).select("row", "row2", "item", "start", "stop")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """One row for each row of docs: (id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash).

    n_hit: words inside any occurrence of a benchmark window; n_items: distinct
    items with one; text_hash: xxhash64 of the text, which tells rows that share an
    id apart. Equal rows give equal results, also where ids repeat: rows are joined
    on a 128-bit digest of id and text. Null and empty texts have no words; items
    without words match nothing; items of equal texts are all found. Items with null
    ids are one item, which isn't in the list of ids. Either table may be empty; other columns aren't read, whatever their
    names. A long text is a segment of its own.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = source.withColumns({"row": F.xxhash64("id", "text"), "row2": F.xxhash64(F.lit(1), "id", "text"), "text_hash": F.xxhash64("text")})
    found_dir, found = phrase_matches(keyed, benchmark, item_col, text_col, window, 0)
    spans = found.groupBy("row", "row2").agg(
        F.array_join(F.array_sort(F.collect_set(F.col("item").cast("string"))), ",").alias("items"),
        (F.size(F.collect_set("item")) + F.max(F.col("item").isNull().cast("int"))).cast("long").alias("n_items"),
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"),
    )
    end = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["end"], s["start"]))).alias("hit"), F.greatest(a["end"], s["stop"]).alias("end")),
    )
    hits = spans.select("row", "row2", "items", "n_items", end["hit"].alias("n_hit"))
    zero = F.lit(0).cast("long")
    sizes = found_dir.groupBy("row", "row2").agg(F.first("n_words").alias("n_words"))
    return (
        keyed.select("id", "row", "row2", "text_hash")
        .join(sizes, ["row", "row2"])
        .join(hits, ["row", "row2"], "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.coalesce("n_items", zero).alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
            (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
            "text_hash",
        )
    )
