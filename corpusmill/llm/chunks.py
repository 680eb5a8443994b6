"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of each text; a chunk ends where its chosen
bits are zero, so boundaries depend on the last WINDOW bytes only and resist
insertions and deletions elsewhere. Chunks are deduplicated by a 128-bit digest
over the whole corpus: the first occurrence, by id and place, keeps its bytes;
other occurrences are repeats, and runs of them long enough are passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import arrow_map, free, parts, utf8, written

WINDOW = 16
#: Bits of the gear hash that must be zero: a boundary every 32 bytes, beside the least size.
MASK = 0b11111 << 20
LEAST, MOST = 16, 256
#: Bytes of consecutive repeated chunks from which a run is a passage; a run that is a whole text is one at any length.
RUN = 100
#: Bytes hashed at once.
BLOCK = 1 << 18

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def _hash(data: np.ndarray) -> np.ndarray:
    """The gear hash of the last WINDOW bytes at each byte."""
    h, longer = _GEAR[data], np.empty(len(data), np.uint32)
    span = 1
    while span < WINDOW:  # hash of 2 * span bytes from two of span bytes
        longer[:span] = h[:span]
        np.left_shift(h[:-span], np.uint32(span), out=longer[span:])
        longer[span:] += h[span:]
        h, longer, span = longer, h, span * 2
    return h


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places after which the gear hash of the last WINDOW bytes asks for a cut, never inside a UTF-8 character."""
    found = []
    for start in range(0, len(data), BLOCK):
        before = min(start, WINDOW - 1)
        h = _hash(data[start - before : start + BLOCK])[before:]
        cut = (h & np.uint32(MASK)) == 0
        after = data[start + 1 : start + len(h) + 1]
        cut[: len(after)] &= (after & 0xC0) != 0x80
        found.append(np.flatnonzero(cut) + (start + 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(data: bytes, start: int, stop: int, ends: list[int]) -> list[int]:
    """Ends of the chunks of data[start:stop], of LEAST to MOST bytes (the last may be shorter; a character isn't split)."""
    out, last = [], start
    for end in [*ends, stop]:
        while end - last > MOST:
            last += MOST
            while last < end and data[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)
        if end - last >= LEAST and end < stop:
            out.append(end)
            last = end
    if last < stop:
        out.append(stop)
    return out


def chunk_texts(texts: list[bytes | None]) -> list[tuple[list[int], bytes]]:
    """Per text, the sizes of its chunks and their 16-byte digests one after another."""
    data = b"".join(t or b"" for t in texts)
    found = boundaries(np.frombuffer(data, np.uint8))
    out, start, digest = [], 0, xxhash.xxh3_128_digest
    for text in texts:
        end = start + len(text or b"")
        # within LEAST >= WINDOW bytes of a text's start the hash sees the text before it, but no cut is made there
        inside = found[np.searchsorted(found, start, "right") : np.searchsorted(found, end, "left")].tolist()
        places = cuts(data, start, end, inside)
        begins = [start, *places[:-1]]
        out.append(([b - a for a, b in zip(begins, places, strict=False)], b"".join([digest(data[a:b]) for a, b in zip(begins, places, strict=False)])))
        start = end
    return out


CHUNKS = "sizes array<int>, a array<long>, b array<long>, same array<int>"


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row long, sizes, a, b, same): the chunks of each row's text, the halves of their digests, and the first chunk of the text that equals each.

    row: a hash of the text, which tells rows that share an id apart.
    """
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 2)):
            found = chunk_texts(utf8(batch.column(2)))
            offsets = np.cumsum([0, *[len(s) for s, _ in found]]).astype(np.int32)
            sizes = np.concatenate([np.array(s, np.int32) for s, _ in found])
            halves = np.frombuffer(b"".join(d for _, d in found), np.int64).reshape(-1, 2)
            same = np.concatenate([_first_equal(halves[lo:hi]) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (sizes, halves[:, 0].copy(), halves[:, 1].copy(), same)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "row", "sizes", "a", "b", "same"])

    return arrow_map(source, run, f"id {docs.schema[id_col].dataType.simpleString()}, row long, {CHUNKS}")


def _first_equal(halves: np.ndarray) -> np.ndarray:
    """For each digest of a text, the place of the first one that equals it."""
    if not len(halves):
        return np.zeros(0, np.int32)
    _, first, which = np.unique(halves, axis=0, return_index=True, return_inverse=True)
    return first[which.ravel()].astype(np.int32)


def passages(wanted: np.ndarray, ends: np.ndarray, run: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of wanted chunks that are passages."""
    edges = np.flatnonzero(np.diff(wanted, prepend=False, append=False))
    runs = zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
    return [(lo, hi) for lo, hi in runs if ends[hi] - ends[lo] >= run or hi - lo == len(wanted)]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """One row for each row of docs: (id, text_hash, n_chunks, n_bytes, n_repeats, n_shared, spans, shared_spans, repeats_of).

    text_hash: xxhash64 of the text, which tells rows that share an id apart.
    n_repeats: chunks that a lesser id has, or that stand earlier in the text;
    n_shared: chunks that another id has too. spans: byte ranges (start, stop) of
    passages to remove, runs of repeats of at least ``run`` bytes or of a whole
    text; shared_spans: likewise of shared chunks, in the first document as well.
    repeats_of: the least ids that have the passages in spans, in order.
    Rows that share an id are one document, so none repeats the other; null ids
    aren't compared. Null and empty texts have no chunks. An empty table gives an
    empty result; other columns aren't read. A long text is hashed in blocks. The
    rows of a frequent chunk meet only in aggregates that combine before the
    shuffle and in a join whose large partitions are split.
    """
    table = written(chunked(docs, id_col, text_col), "chunks")
    places = table.where("id is not null").select("id", "row", F.posexplode(F.arrays_zip("a", "b", "same")).alias("k", "c")).where("k = c.same").select("id", "row", "k", "c.a", "c.b")
    spread = places.groupBy("a", "b").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id <> last_id")
    known = written(spread.select("a", "b", "first_id"), "shared-chunks")
    found = places.join(known, ["a", "b"])
    lists = found.groupBy(F.col("id").alias("of"), F.col("row").alias("of_row")).agg(F.collect_set(F.struct("k", "first_id")).alias("m"))
    joined = table.select("id", "row", "sizes", "same").join(lists, (F.col("id") == F.col("of")) & (F.col("row") == F.col("of_row")), "left").select("id", "row", "sizes", "same", F.col("m.k").alias("k"), F.col("m.first_id").alias("first_id"))
    pair = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("text_hash", "n_chunks", "n_bytes", "n_repeats", "n_shared")], T.StructField("spans", pair), T.StructField("shared_spans", pair), T.StructField("repeats_of", T.ArrayType(docs.schema[id_col].dataType))]
    )

    def row(own: object, sizes: np.ndarray, same: np.ndarray, k: list | None, first: list | None) -> tuple:
        n, ends = len(sizes), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        moved = (same != np.arange(n)) & (own is not None)
        if not k and not moved.any():
            return n, int(ends[-1]), 0, 0, [], [], []
        k, first = k or [], first or []
        shared, elsewhere = np.zeros(n, bool), np.zeros(n, bool)
        shared[k] = True
        elsewhere[k] = [x != own for x in first]
        shared, moved = shared[same], moved | elsewhere[same]
        owner = dict(zip(k, first, strict=True))
        gone, both = passages(moved, ends, run), passages(shared, ends, run)
        spans = [[{"start": int(ends[lo]), "stop": int(ends[hi])} for lo, hi in x] for x in (gone, both)]
        return n, int(ends[-1]), int(moved.sum()), int(shared.sum()), *spans, sorted({owner.get(c, own) for lo, hi in gone for c in same[lo:hi].tolist()})

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["id", "text_hash", "n_chunks", "n_bytes", "n_repeats", "n_shared", "spans", "shared_spans", "repeats_of"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, own in enumerate(ids):
                rows.append(row(own, *[batch.column(c)[i].values.to_numpy() for c in (2, 3)], *[batch.column(c)[i].as_py() for c in (4, 5)]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, span) for c in columns[4:6]] + [pa.array(columns[6], pa.list_(batch.column(0).type))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], fields)

    return arrow_map(joined, summarise, schema).withColumnRenamed("id", id_col)


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """docs with text_col less its repeated passages; the other columns are carried, whatever their names.

    Rows that share an id each lose the passages of their own text; rows with null
    ids keep their texts whole.
    """
    spans = repeated_spans(docs, id_col, text_col, run)
    of, row, own = (free(x, *docs.columns) for x in ("of", "row", "spans"))
    known = spans.where(F.col(id_col).isNotNull() & (F.size("spans") > 0)).groupBy(F.col(id_col).alias(of), F.col("text_hash").alias(row)).agg(F.first("spans").alias(own))
    at, n = docs.columns.index(text_col), len(docs.columns)
    joined = docs.join(known, (F.col(id_col) == F.col(of)) & (F.xxhash64(text_col) == F.col(row)), "left").select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col(f"{own}.start").alias("starts"), F.col(f"{own}.stop").alias("stops"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, at)):
            texts = []
            for text, starts, stops in zip(utf8(batch.column(at)), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                if text is not None and starts:
                    text = b"".join(text[a:b] for a, b in zip([0, *stops], [*starts, len(text)], strict=True))
                texts.append(text)
            columns = [batch.column(i) for i in range(n)]
            columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, list(batch.schema.names[:n]))

    kinds = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    return arrow_map(joined, cut, kinds).toDF(*docs.columns)
