"""Source divergence audit by a baseline-correction inverted index.

Every term that enough documents of a language hold has a smoothed probability in
each (language, source) group, counted there or not. A pair of groups starts at the
baseline: V terms times the difference of its two zero-count probabilities. The
inverted index lists, for each term, the groups that post it; only where a group
posts a term can a pair's difference leave its baseline, and only corrections other
than zero are emitted. Corrections by a term that only one of the pair posts depend
on nothing but its probability there, so terms of one probability emit them once;
terms that both post add what both together change.

Texts are counted in Arrow batches, and counts meet by (language, term). The list of a
term, and the groups of a language, are met with themselves in pieces, so that no
task takes all pairs of a long list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, parts, utf8, written

#: A-Z lower-cased; all ASCII but letters separates terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
#: (group, term) counts that a task holds before it emits them.
HELD = 1 << 20
#: Groups of a list that meet all others of it in one task.
PIECE = 512
#: Probabilities are in units of one in a thousand million.
SCALE = 1_000_000_000

COUNTS = "lang string, source string, term string, n long, docs long"


class _Counts:
    """Counts of (group, term) of several parts; each part's terms have codes of their own until they are merged."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: list[pa.Array] = []
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, part: pa.RecordBatch) -> None:
        words, sizes = [], []
        for text in utf8(part.column(2)):
            own = (text or b"").translate(FOLD).split()
            words += own
            sizes.append(len(own))
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], np.int64)
        found = pa.array(words, pa.binary()).dictionary_encode()
        width = max(1, len(found.dictionary))
        pair, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + found.indices.to_numpy(), return_counts=True)
        key, n, docs = _summed(group[pair // width] * width + pair % width, n, np.ones(len(pair), np.int64))
        self.terms.append(found.dictionary)
        self.rows.append((key // width, key % width, n, docs))
        self.size += len(key)

    def taken(self) -> pa.RecordBatch:
        merged = pa.concat_arrays([pa.array([], pa.binary()), *self.terms]).dictionary_encode()
        code, offsets = merged.indices.to_numpy().astype(np.int64), np.cumsum([0, *map(len, self.terms)])
        width = max(1, len(merged.dictionary))
        keys = [g * width + code[at + c] for (g, c, _, _), at in zip(self.rows, offsets[:-1], strict=True)]
        none = np.zeros(0, np.int64)
        key, n, docs = _summed(*[np.concatenate([none, *x]) for x in (keys, [r[2] for r in self.rows], [r[3] for r in self.rows])])
        langs, sources = zip(*self.groups, strict=True) if self.groups else ((), ())
        group = pa.array(key // width)
        columns = [pa.array(langs, pa.string()).take(group), pa.array(sources, pa.string()).take(group), merged.dictionary.take(pa.array(key % width)).cast(pa.string()), pa.array(n), pa.array(docs)]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _summed(key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of n and docs of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1) != 0)
    return (key[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)) if len(key) else (key, n, docs)


def posting_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, text) -> (lang, source, term, n, docs): occurrences and documents, several rows for one term and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()
        for part in (part for whole in batches for part in parts(whole, 2)):
            held.add(part)
            if held.size >= HELD:
                yield held.taken()
        yield held.taken()

    return arrow_map(docs.select("lang", "source", "text"), run, COUNTS)


def probability(n: Column, total: Column, v: Column, smoothing: int) -> Column:
    """1 + floor(SCALE * (n + smoothing) / (total + smoothing * v)), exact; null without terms."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n + smoothing).cast("decimal(19,0)")
    return F.call_function("div", scaled, F.nullif(total + smoothing * v, F.lit(0)).cast("decimal(19,0)")) + 1


def met(df: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Each two rows a, b of df with the same keys and a.source < b.source: keys, and structs a and b of the other columns.

    size: the column that counts the rows with a row's keys. A list longer than
    PIECE is cut by a hash of source, and each piece meets the whole list.
    """
    n = F.ceil(F.col(size) / PIECE).cast("int")
    rest = [c for c in df.columns if c not in keys]
    left = df.select(*keys, F.pmod(F.xxhash64("source"), n).cast("int").alias("piece"), F.struct(*rest).alias("a"))
    right = df.select(*[F.col(c).alias(f"of_{c}") for c in keys], F.explode(F.sequence(F.lit(0), n - 1)).alias("of_piece"), F.struct(*rest).alias("b"))
    same = [F.col(c) == F.col(f"of_{c}") for c in keys] + [F.col("piece") == F.col("of_piece"), F.col("a.source") < F.col("b.source")]
    return left.join(right, same).select(*keys, "a", "b")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, smoothing: int = 5, ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of each (lang, source) group.

    part pair: every other source of the language (item) by the sum of the
    differences of all its kept terms' probabilities; part term: the ``ranks`` terms
    (item) of which the group has most above its language. rank: from 1, value
    descending, then item by its bytes. Null texts, languages and sources read as
    ''. A group or language without kept terms has pairs of value 0 and no terms.
    Rows that repeat count each; an empty table gives an empty result; other columns
    aren't read. A long text is counted alone.
    """
    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    # dealt by (lang, term) at once: sums by group and those over the language need no other shuffle
    counted = posting_counts(filled).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    listed = counted.select("lang", "term", "source", "n", F.sum("docs").over(term).alias("df"), F.sum("n").over(term).alias("of_lang"), F.count("*").over(term).alias("k"), (F.min("source").over(term) == F.col("source")).alias("head"))
    kept = written(listed.where(F.col("df") >= least_docs).drop("df"), "kept-terms")
    zero = F.lit(0).cast("long")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("head").alias("v"))
    named = filled.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    every = named.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(named.groupBy("lang").agg(F.count("*").alias("groups")), "lang")
    facts = every.select("lang", "source", "groups", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "v")])
    facts = written(facts.withColumn("p0", probability(zero, F.col("total"), F.col("v"), smoothing)), "groups")
    of = facts.select(F.col("lang").alias("of_lang_name"), F.col("source").alias("of_source"), "total", "lang_total", "v", "p0")
    joined = kept.join(of, (F.col("lang") == F.col("of_lang_name")) & (F.col("source") == F.col("of_source")))
    p, q = probability(F.col("n"), F.col("total"), F.col("v"), smoothing), probability(F.col("of_lang"), F.col("lang_total"), F.col("v"), smoothing)
    posted = written(joined.select("lang", "term", "source", "k", p.alias("p"), q.alias("q"), "p0"), "postings")

    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = posted.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= ranks)

    pairs = written(met(facts.select("lang", "source", "groups", "v", "p0"), ["lang"], "groups"), "pairs")
    names = ["lang", F.col("a.source").alias("a"), F.col("b.source").alias("b")]
    baseline = pairs.select(*names, F.coalesce(F.col("a.v") * F.abs(F.col("a.p0") - F.col("b.p0")), zero).alias("value"))
    # terms that one of a pair posts, as if the other didn't
    alike = posted.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    alike = alike.select(F.col("lang").alias("of"), F.col("source").alias("one"), "p", "m")
    changes = []
    for own, other in (("a", "b"), ("b", "a")):
        ours = pairs.join(alike, (F.col("lang") == F.col("of")) & (F.col(f"{own}.source") == F.col("one")))
        change = F.col("m") * (F.abs(F.col("p") - F.col(f"{other}.p0")) - F.abs(F.col(f"{own}.p0") - F.col(f"{other}.p0")))
        changes.append(ours.select(*names, change.alias("value")))
    # what both posting it changes beyond that
    both = met(posted.select("lang", "term", "source", "k", "p", "p0"), ["lang", "term"], "k")
    gap = lambda x, y: F.abs(F.col(f"a.{x}") - F.col(f"b.{y}"))
    changes.append(both.select(*names, (gap("p", "p") - gap("p", "p0") - gap("p0", "p") + gap("p0", "p0")).alias("value")))
    summed = baseline
    for change in changes:
        summed = summed.unionByName(change.where("value <> 0"))
    summed = written(summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergences")
    part = F.lit("pair").alias("part")
    directed = summed.select("lang", F.col("a").alias("source"), part, F.col("b").alias("item"), "value").unionByName(summed.select("lang", F.col("b").alias("source"), part, F.col("a").alias("item"), "value"))
    return directed.withColumn("rank", F.row_number().over(by)).unionByName(terms)
