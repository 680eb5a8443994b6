"""Quality rules from a suffix array: how much of a text repeats, and how far.

The texts of a batch are one string of words, told apart by text. Words in no window
that occurs twice in their text are in no repeat of that many words, and are left
out. Of what is left a suffix array is built by prefix doubling. Its longest common
prefixes give the longest repeat at each place; their intervals are the repeats that
no following word extends, and those that words before don't extend either are the
maximal repeated substrings. Spans of repeats are united, and the covered fraction
and the longest repeat are limited. Repeats of any length are told in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import WHITESPACE, arrow_map, parts, utf8
from corpusmill.llm.suffixes import Suffixes, joined_stretches, repeated_stretches

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """min_words: fewer fail. window, max_window_percent: words in windows seen twice.

    min_repeat, max_covered_percent, max_longest: maximal repeats of at least so
    many words, the share of words they may cover, and the longest one allowed.
    """

    min_words: int = 10
    window: int = 5
    max_window_percent: int = 20
    min_repeat: int = 20
    max_covered_percent: int = 10
    max_longest: int = 50


def repeat_lengths(symbols: np.ndarray, doc: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """For each position, the longest prefix of its suffix found elsewhere in its document, if of ``least`` symbols, else 0; most: longer ones are given as that.

    symbols: small non-negative codes; doc: the document of each position, non-decreasing.
    """
    return _repeated(symbols, doc, least, least)[0] if most is None else np.minimum(_repeated(symbols, doc, least, least)[0], most)


def _repeated(symbols: np.ndarray, doc: np.ndarray, least: int, maximal: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest repeat of ``least`` symbols or more at each position, and the first position of each maximal repeat of ``maximal`` symbols or more."""
    longest, none = np.zeros(len(symbols), np.int64), np.zeros(0, np.int64)
    key = doc.astype(np.int64) * (int(symbols.max(initial=0)) + 1) + symbols
    inside = np.flatnonzero(repeated_stretches(key, doc, least))
    if not inside.size:
        return longest, none
    string, origin = joined_stretches(key, doc, inside)
    text = Suffixes(string)
    common = text.lcp
    own = np.zeros(text.n, np.int64)
    own[text.order] = np.maximum(common, np.r_[common[1:], 0])
    held = origin >= 0
    longest[origin[held]] = np.where(own[held] >= least, own[held], 0)
    # an interval of common prefixes is named by its ranks; what stands before a stretch differs from all else, as it repeats nowhere
    rank = np.flatnonzero(common >= max(1, maximal))
    lo, hi = text.interval(text.order[rank], common[rank])
    _, once = np.unique(lo * np.int64(text.n + 1) + hi, return_index=True)
    lo, hi = lo[once], hi[once]
    before = np.where(text.order > 0, string[text.order - 1], -1)
    differs = np.cumsum(np.r_[0, before[1:] != before[:-1]])
    return longest, origin[text.order[lo[differs[hi] > differs[lo]]]]


def covered(longest: np.ndarray, least: int, span: int | None = None) -> np.ndarray:
    """Whether each position lies in the union of the repeats of at least ``least`` (of their first ``span``) units."""
    at = np.arange(len(longest))
    ends = np.where(longest >= least, at + (longest if span is None else span), 0)
    return np.maximum.accumulate(ends) > at if len(at) else ends.astype(bool)


def _per_doc(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, how=np.add) -> np.ndarray:
    out = np.zeros(len(sizes), np.int64)
    if len(values):
        filled = sizes > 0
        out[filled] = how.reduceat(values.astype(np.int64), starts[filled])
    return out


def _repeats(units: list[np.ndarray], window: int, least: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: units in repeated windows, units covered by repeats, longest repeat (up to most, if given)."""
    in_windows, spans, longest, _ = measured_repeats(units, window, least)
    return in_windows, spans, longest if most is None else np.minimum(longest, most)


def measured_repeats(units: list[np.ndarray], window: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document: units in repeated windows, units covered by repeats, the longest repeat of a window or more, and maximal repeats."""
    sizes = np.array([len(u) for u in units], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(units) if units else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(units)), sizes)
    symbols = np.unique(flat, return_inverse=True)[1].astype(np.int64)
    longest, maximal = _repeated(symbols, doc, min(window, least), least)
    return (
        _per_doc(covered(longest, window, window), starts, sizes),
        _per_doc(covered(longest, least), starts, sizes),
        _per_doc(longest, starts, sizes, np.maximum),
        np.bincount(doc[maximal], minlength=len(units)) if len(units) else sizes,
    )


def _measure(texts: list[bytes | None], limits: Limits) -> dict[str, np.ndarray]:
    """The counts of a few documents."""
    words = [t.split() if t else [] for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    solid = [t.translate(None, WHITESPACE) if t else b"" for t in texts]
    chars = np.array([len(s.decode("utf-8", "replace")) for s in solid], np.int64)
    symbols = np.array([len(s) - len(s.translate(None, SYMBOLS)) for s in solid], np.int64)
    dup_lines = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t and b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip()]
            dup_lines[i] = len(lines) - len(set(lines))
    units = [np.fromiter(map(hash, w), np.int64, len(w)) for w in words]
    in_windows, spans, longest, maximal = measured_repeats(units, limits.window, limits.min_repeat)
    base = (n_words < limits.min_words) | (100 * in_windows > limits.max_window_percent * n_words)
    repeats = (100 * spans > limits.max_covered_percent * n_words) | (longest > limits.max_longest)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": in_windows,
        "n_covered": spans, "longest_repeat": longest, "n_maximal": maximal, "base_failed": base, "kept": ~base & ~repeats,
    }


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, n_maximal long, base_failed boolean, kept boolean"


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row for each row of docs: its id, the counts and the verdict.

    Rows are judged alone, so repeated rows, ties and ids that repeat or are null
    need no care: each row gets its own result. A null or empty text has no words
    and fails; shares and lengths that just reach a limit are kept. n_covered: words
    in repeats of min_repeat words or more; longest_repeat: words of the longest
    repeat, of a window at least, else 0; n_maximal: maximal repeated substrings of
    min_repeat words or more. An empty table gives an empty result. Other columns
    aren't read, whatever their names. A long text is taken alone; memory is bounded by the
    longest text, never by a group.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in parts(whole, 1)):
            found = _measure(utf8(part.column(1)), limits)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found.values())], ["id", *found])

    return arrow_map(source, run, f"id {docs.schema[id_col].dataType.simpleString()}, {COUNTS}").withColumnRenamed("id", id_col)


def repetition_filter(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are; a text goes to Python and back once."""
    at, names = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in parts(whole, at)):
            kept = part.filter(pa.array(_measure(utf8(part.column(at)), limits)["kept"]))
            yield pa.RecordBatch.from_arrays(kept.columns, names)

    kinds = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)])
    return arrow_map(docs.toDF(*names), run, kinds).toDF(*docs.columns)
