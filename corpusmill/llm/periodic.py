"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with a smallest period q that no neighbouring word
extends. All texts of a batch are one string, their words told apart by text. Its
Lempel-Ziv blocks give squares (two copies of q words side by side) of which one
stands at, or a few places before in the same run, the leftmost occurrence of every
square: common extensions over each border between blocks find them. From these the
vocabulary of squares is completed by suffix links: the square a step to the right
begins at the next place, whose rank is the suffix link's target in the suffix tree,
here the suffix array with its longest common prefixes. Squares that share a locus
are one. The subtree below each locus gives all occurrences, and occurrences of one
period at successive places merge into runs.

Words in no window that occurs twice in their text can't be in a run, and are left
out before. All steps work on numbers, for many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, parts, utf8
from corpusmill.llm.suffixes import Suffixes, joined_stretches, ragged, repeated_stretches

#: Pairs of a border and a period compared at once.
PAIRS = 1 << 19


def _smallest_factors(most: int) -> np.ndarray:
    """The smallest prime factor of each number up to most."""
    factor = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            own = factor[p * p :: p]
            own[own == np.arange(p * p, most + 1, p)] = p
    return factor


def primitive(text: Suffixes, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q symbols at each place are no power of fewer."""
    factor = _smallest_factors(int(q.max(initial=1)))
    out, left = np.ones(len(at), bool), q.copy()
    while (some := np.flatnonzero((left > 1) & out)).size:
        p = factor[left[some]]
        d = q[some] // p
        out[some] = text.after(at[some], at[some] + d) < q[some] - d
        left[some] //= p
    return out


def covering_squares(text: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the runs of squares that have, between them, the leftmost occurrence of every square with a primitive root."""
    previous, blocks, at = text.previous().tolist(), [], 0
    while at < text.n:
        blocks.append(at)
        at += max(1, previous[at])
    begin = np.array([*blocks, text.n, text.n], np.int64)
    h, h1, h2 = begin[:-2], begin[1:-1], begin[2:]
    # squares over the border at h1 with a centre left of it, and over the border at h with one right of it
    borders, signs, most = np.concatenate([h1, h]), np.repeat([-1, 1], len(h)), np.concatenate([h1 - h, h2 - h])
    starts, periods = [], []
    cuts = np.searchsorted(np.cumsum(most), np.arange(PAIRS, int(most.sum()) + PAIRS, PAIRS), "right")
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(most)], strict=True):
        k, owner = ragged(np.ones(hi - lo, np.int64), most[lo:hi])
        border, other = borders[lo:hi][owner], borders[lo:hi][owner] + signs[lo:hi][owner] * k
        fine = (other >= 0) & (other < text.n) & (border < text.n)
        k, border, other = k[fine], border[fine], other[fine]
        ahead, behind = text.after(border, other), text.before(border - 1, other - 1)
        fine = ahead + behind >= k
        k, first = k[fine], np.minimum(border, other)[fine] - behind[fine]
        keep = np.unique(first * (text.n + 1) + k)
        starts.append(keep // (text.n + 1))
        periods.append(keep % (text.n + 1))
    both = np.unique(np.concatenate(starts) * (text.n + 1) + np.concatenate(periods))
    start, q = both // (text.n + 1), both % (text.n + 1)
    keep = primitive(text, start, q)
    return start[keep], q[keep]


def vocabulary(text: Suffixes, start: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, last rank, period) of the locus of each square: suffix-link walks from covering squares, as far as their runs go or a full turn."""
    ahead = text.after(start, start + q)  # the run from start has q + ahead symbols
    at, owner = ragged(start, np.minimum(ahead - q + 1, q))
    q = q[owner]
    lo, hi = text.interval(at, 2 * q)
    _, once = np.unique(lo * (text.n + 1) + q, return_index=True)
    return lo[once], hi[once], q[once]


def runs_of(symbols: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of at least least symbols and times periods in a string whose last symbol is unique; times >= 2."""
    text = Suffixes(symbols)
    lo, hi, q = vocabulary(text, *covering_squares(text))
    ranks, owner = ragged(lo, hi - lo + 1)
    key = np.sort(q[owner] * (text.n + 1) + text.order[ranks])
    joined = np.diff(key) == 1  # periods never touch: no square begins at the last place
    first, last = key[~np.r_[False, joined][: len(key)]], key[~np.r_[joined, False][: len(key)]]
    q, start = first // (text.n + 1), first % (text.n + 1)
    length = last - first + 2 * q
    keep = length >= np.maximum(least, times * q)
    order = np.lexsort((q[keep], start[keep]))
    return start[keep][order], length[keep][order], q[keep][order]


def document_runs(words: list[list[bytes]], least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period."""
    sizes = np.array([len(w) for w in words], np.int64)
    doc, begin = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes) - sizes
    found = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    symbols = doc * max(1, len(found.dictionary)) + found.indices.to_numpy()
    # a run and itself a period later share so many symbols at least
    window = min(max(least, times * q) - q for q in range(1, least + 1))
    inside = np.flatnonzero(repeated_stretches(symbols, doc, window))
    none = np.zeros(0, np.int64)
    if not inside.size:
        return none, none, none, none
    string, origin = joined_stretches(symbols, doc, inside)
    start, length, q = runs_of(string, least, times)
    start = origin[start]
    return doc[start], start - begin[doc[start]], length, q


RUNS = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row for each row of docs: (id, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed).

    runs: (start, length, period) of the runs of at least ``least`` words and
    ``times`` periods, by start, then period; start, length, period and
    exponent_milli (thousandths of length / period, rounded down) are those of the
    one with the greatest exact exponent, ties by start, then period, or null.
    collapsed: the words, joined by one space, less those that a run holds after its
    first period. Rows are judged alone, so repeated rows, ties and null or repeated
    ids need no care. A null or empty text has no words and no runs, its collapsed
    text is empty. An empty table gives an empty result; other columns aren't read.
    A long text is taken alone; memory is bounded by the longest text.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two words and two periods at least")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def best(own: list[tuple[int, int, int]]) -> tuple:
        if not own:
            return None, None, None, None
        top = own[0]
        for x in own[1:]:  # in the order of ties
            if x[1] * top[2] > top[1] * x[2]:
                top = x
        return *top, 1000 * top[1] // top[2]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for whole in batches for part in parts(whole, 1)):
            words = [(t or b"").split() for t in utf8(part.column(1))]
            doc, start, length, q = document_runs(words, least, times)
            lists: list[list[tuple[int, int, int]]] = [[] for _ in words]
            for d, *own in zip(doc.tolist(), start.tolist(), length.tolist(), q.tolist(), strict=True):
                lists[d].append(tuple(own))
            texts = []
            for own, runs in zip(words, lists, strict=True):
                if runs:
                    kept = np.ones(len(own), bool)
                    for s, n, p in runs:
                        kept[s + p : s + n] = False
                    own = [own[i] for i in np.flatnonzero(kept).tolist()]
                texts.append(b" ".join(own))
            top = list(zip(*map(best, lists), strict=True))
            columns = [pa.array(x, pa.int64()) for x in ([len(w) for w in words], [len(x) for x in lists], *top)]
            shown = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in own] for own in lists], pa.list_(run))
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, shown, pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    return arrow_map(source, found, f"id {docs.schema[id_col].dataType.simpleString()}, {RUNS}").withColumnRenamed("id", id_col)
