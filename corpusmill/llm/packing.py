"""Bounded-space online packing of tokenised documents into sequences.

Each task packs the documents of its partition as they come: a document's full
sequences are cut off, and the rest goes to the open window with the least space
that holds it; if none does, another window opens, and beyond ``windows`` open ones
the fullest is emitted first. At a partition's end, windows that are all but full
are emitted, and the pieces of the others are left over. Leftovers of FAN partitions
at a time meet, the largest first, and what is left over there meets again, until
one group is left; there, a window that is far from full is cut at powers of two,
whose sequences need no padding. Only lengths travel in these rounds; the ids of a
piece move once.

Distinct words are tokenised once a worker: no token spans ASCII white space, or stands
on both sides of a letter's end before a mark.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import BATCH_BYTES, arrow_map, parts, utf8, written
from corpusmill.llm.suffixes import ragged

#: Tokens of a sequence, and the id that ends a document.
SIZE, END = 4096, 2
#: Windows that a task keeps open, and partitions whose leftovers meet.
WINDOWS, FAN = 128, 16
#: A window whose space is at most one in so many of its size is emitted at a partition's end.
SPARE = 64
#: Distinct words whose ids a worker holds, some 150 MB; what a batch adds goes beyond, and then all are forgotten.
KNOWN = 1 << 20
#: A letter or digit and a mark after it, between which no token stands: letters that tokenizers agree on.
MARKS = "([A-Za-z0-9À-ÖØ-öø-ÿ])([.,!?;:])"
WORD = re.compile(b"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # UTF-8 of ASCII letters and those of Latin-1
#: Words of letters that are tokenised at once.
JOINED = 1 << 12
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Encoder:
    """Ids of texts by a tokenizer file, word by word: each distinct word is tokenised once."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        rules = json.loads(self.tokenizer.to_str())
        self.lowers = '"Lowercase"' in json.dumps(rules["normalizer"])
        # where a token at a word's end has a name of its own, ids alone tell words apart
        suffix, names = rules["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for t, i in names.items() if suffix and t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: list[bytes]) -> None:
        alone, others, found, sizes, letters = [], [], [], [], WORD.fullmatch
        for w in words:
            if w not in self.known:
                (alone if letters(w) else others).append(w)
        fresh = alone + others
        for i in range(0, len(alone), JOINED):  # a word of letters is one of the tokenizer's words, also among others
            some = alone[i : i + JOINED]
            if self.ends.any():
                found.append(np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32))
                sizes.append(np.diff(np.flatnonzero(self.ends[found[-1]]), prepend=-1))
            else:
                one = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
                found.append(np.array(one.ids, np.uint32))
                sizes.append(np.bincount(np.array(one.word_ids, np.int64), minlength=len(some)))
        for one in self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False) if others else ():
            found.append(np.array(one.ids, np.uint32))
            sizes.append(np.array([len(found[-1])]))
        if fresh:
            if sum(map(len, sizes)) != len(fresh):
                raise RuntimeError("the tokenizer joins words of letters")
            self.known |= zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True)
            new = np.concatenate(sizes).astype(np.int64)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(new) - new])
            self.sizes, self.ids = np.concatenate([self.sizes, new]), np.concatenate([self.ids, *found])

    def words(self, texts: pa.Array) -> pa.ListArray:
        """Words of each text, with marks after letters and digits apart and, if the tokenizer has no case, in lower case.

        Texts with combining marks, or what may be a special token, are only cut at white space.
        """
        raw = [t or b"" for t in utf8(texts)]
        plain = pa.array([b"<|" in t or b"\xcc" in t or b"\xcd" in t for t in raw])
        own = pa.array(raw, pa.binary()).cast(pa.string())
        folded = pa.array([t.translate(LOWER) for t in raw], pa.binary()).cast(pa.string()) if self.lowers else own
        return pc.ascii_split_whitespace(pc.if_else(plain, own, pc.replace_substring_regex(folded, MARKS, r"\1 \2")))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, then the end id."""
        words = self.words(texts)
        found = words.flatten().dictionary_encode()
        if len(self.known) > KNOWN:
            self.forget()
        names = utf8(found.dictionary)
        self.learn(names)
        code = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[found.indices.to_numpy()]
        at, _ = ragged(self.starts[code], self.sizes[code])
        upto = np.concatenate([[0], np.cumsum(self.sizes[code])])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        flat = self.ids[at]
        return [np.append(flat[a:b], np.uint32(self.end)) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


#: A worker's encoders, which stay beyond a task: tasks share most of their words.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end: int) -> Encoder:
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]


class Windows:
    """Open windows; put() gives a piece its window and place there, and emitted() what closed since."""

    def __init__(self, size: int, most: int | None = None):
        self.size, self.most = size, most
        self.spaces: list[tuple[int, int]] = []  # (space, window), least space first
        self.made = 0
        self.closed: list[int] = []

    def put(self, length: int) -> tuple[int, int]:
        at = bisect_left(self.spaces, (length, 0))
        if at < len(self.spaces):
            space, window = self.spaces.pop(at)
        else:
            if self.most is not None and len(self.spaces) >= self.most:
                self.closed.append(self.spaces.pop(0)[1])
            space, window = self.size, self.made
            self.made += 1
        if space > length:
            insort(self.spaces, (space - length, window))
        else:
            self.closed.append(window)
        return window, self.size - space

    def emitted(self) -> list[int]:
        out, self.closed = self.closed, []
        return out

    def finished(self, spare: int) -> None:
        """Closes windows with at most so much space."""
        self.closed += [w for space, w in self.spaces if space <= spare]
        self.spaces = [x for x in self.spaces if x[0] > spare]


def _named(round_: int, group: int) -> int:
    """The first sequence id of a group of a round."""
    return (round_ << 56) + (group << 24)


def packed_partitions(docs: DataFrame, id_col: str, text_col: str, path: str, size: int, windows: int, end: int) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset, part, left): the pieces; left: its window was open at the partition's end."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType
    fields = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "part", "left"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        first, encoder, open_, held, ready = _named(0, part_id), encoder_of(path, end), Windows(size, windows), {}, []

        def batch(type_: pa.DataType, last: bool) -> pa.RecordBatch:
            for w in open_.emitted():
                ready.extend((*x, w, False) for x in held.pop(w))
            if last:
                ready.extend((*x, w, True) for w, own in held.items() for x in own)
            columns = list(zip(*ready, strict=True)) if ready else [[]] * 8
            ready.clear()
            doc, start, length, ids, tokens, offset, window, left = columns
            arrays = [pa.array(doc, type_), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(tokens, pa.int64()), pa.array([first + w for w in window], pa.int64()), pa.array(offset, pa.int64()), pa.array([part_id] * len(doc), pa.int64()), pa.array(left, pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, fields)

        type_ = None
        for part in (part for whole in batches for part in parts(whole, 1, BATCH_BYTES)):
            type_ = part.schema.field(0).type
            for own, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    w, offset = open_.put(len(piece))
                    held.setdefault(w, []).append((own, start, len(piece), piece, len(ids), offset))
            yield batch(type_, False)
        if type_ is not None:
            open_.finished(size // SPARE)
            yield batch(type_, True)

    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.BinaryType() if c == "ids" else T.BooleanType() if c == "left" else T.LongType()) for c in fields[1:]]])
    return arrow_map(source, run, schema)


MOVES = "was long, was_at long, skip long, length long, sequence_id long, offset long, part long, left boolean"


def merged(leftovers: DataFrame, round_: int, size: int, windows: int, last: bool) -> DataFrame:
    """Pieces (was, was_at, skip, length, part) of FAN partitions packed anew, the largest first, each into a window that it fills best.

    All but the emptiest ``windows`` windows are closed; in the last round all are,
    and one far from full is cut at powers of two, with skip the tokens cut before.
    """

    def run(table: pa.Table) -> pa.Table:
        group = table.column("of")[0].as_py()
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("length", "was", "was_at")], strict=True), key=lambda x: (-x[0], x[1], x[2]))
        open_, first = Windows(size), _named(round_, group)
        placed = [(was, at, 0, n, *open_.put(n)) for n, was, at in rows]
        spaces = dict((w, space) for space, w in open_.spaces if space > size // SPARE)
        left = set() if last else set(sorted(spaces, key=lambda w: (-spaces[w], w))[:windows])
        out = []
        for was, at, skip, n, w, offset in placed:
            if last and spaces.get(w, 0) > size // 16:
                stop, filled = 0, size - spaces[w]  # the window's powers of two, the largest first
                for bit in range(filled.bit_length() - 1, -1, -1):
                    if filled >> bit & 1:
                        begin, stop = stop, stop + (1 << bit)
                        lo, hi = max(begin, offset), min(stop, offset + n)
                        if lo < hi:
                            out.append((was, at, lo - offset, hi - lo, first + open_.made + w * size.bit_length() + bit, lo - begin, group, False))
            else:
                out.append((was, at, skip, n, first + w, offset, group, w in left))
        columns = list(zip(*out, strict=True))
        return pa.table({name: pa.array(c, pa.bool_() if name == "left" else pa.int64()) for name, c in zip([x.split()[0] for x in MOVES.split(", ")], columns, strict=True)})

    grouped = leftovers.select("was", "was_at", "length", F.expr(f"part div {FAN}").alias("of"))
    return grouped.groupBy("of").applyInArrow(run, MOVES)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, windows: int = WINDOWS, end: int = END) -> DataFrame:
    """One row for each piece: (id, start, length, ids, doc_tokens, sequence_id, offset).

    tokenizer: the path of a tokenizer file. ids: the piece's token ids, unsigned
    32-bit little-endian; start: the ids of its document before it; doc_tokens: all
    ids of its document, with the end id. Pieces of a sequence follow on one another
    from offset 0. Documents of up to ``size`` ids are one piece, but for those of
    the last round's emptiest windows. Null and empty texts are the end id alone.
    Rows that repeat, ties and null ids are documents of their own. An empty table
    gives an empty result; other columns aren't read. A long text fills sequences of
    its own, but for its rest.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    pieces = written(packed_partitions(docs, id_col, text_col, tokenizer, size, windows, end), "pieces")
    last = pieces.where("left").agg(F.max("part")).first()[0]
    own = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    whole = pieces.where("not left").select(own)
    if last is None:
        return whole.withColumnRenamed("id", id_col)
    moves, left, round_ = [], pieces.where("left").select(F.col("sequence_id").alias("was"), F.col("offset").alias("was_at"), "length", "part"), 0
    while not moves or last:
        last, round_ = last // FAN, round_ + 1
        moves.append(written(merged(left, round_, size, windows, last == 0), f"round-{round_}"))
        left = moves[-1].where("left")
    settled = moves[0].where("not left")
    for move in moves[1:]:
        settled = settled.unionByName(move.where("not left"))
    settled = settled.select("was", "was_at", "skip", F.col("length").alias("n"), F.col("sequence_id").alias("to"), F.col("offset").alias("to_at"))
    moved = pieces.where("left").join(settled, (F.col("sequence_id") == F.col("was")) & (F.col("offset") == F.col("was_at")))
    cut = moved.select("id", (F.col("start") + F.col("skip")).alias("start"), F.col("n").alias("length"), F.expr("substring(ids, int(4 * skip + 1), int(4 * n))").alias("ids"), "doc_tokens", F.col("to").alias("sequence_id"), F.col("to_at").alias("offset"))
    return whole.unionByName(cut).withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, size: int = SIZE, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pack()'s pieces: a sequence's ids, padded to size unless their number is a power of two."""
    ordered = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    padding = F.lit(int(pad).to_bytes(4, "little"))
    full = F.when(F.bit_count("n_tokens") == 1, F.col("ids")).otherwise(F.rpad("ids", F.lit(4 * size), padding))
    return ordered.select("sequence_id", "n_tokens", joined.alias("ids")).withColumn("ids", full)
