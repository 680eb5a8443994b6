"""Quality by perplexity under an interpolated modified Kneser-Ney model over code points.

n-grams of ORDER code points of every script (only case, digits and runs of space
are made one), one model for each language and one for all text, trained on all
trusted documents. Its tables grow with the trusted text and stay dealt: none is
broadcast or collected. Texts are dealt into buckets of a language; the distinct
n-grams of the buckets are looked up by joins with the count tables' levels, and
each bucket's answers meet its texts, packed, in one task, where they are summed
by document. A document's threshold is a quantile of the trusted perplexities of
its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, dropped, parts, trimmed, written

#: At most 7: the symbols before the last are packed into two longs, 3 in h2 and the ones before in h1.
ORDER = 5
BITS = 21
SYMBOLS = 0x110000
SPACE = 0
#: Symbols handled at once.
WINDOW = 1 << 20
#: Bytes of text in a bucket: the larger, the fewer n-grams are asked for more than once. Only the packed texts are held whole.
BUCKET = 1 << 26
#: Bytes of trusted text counted at once.
TRAIN = 1 << 24
#: Trusted perplexities up to this quantile of their language pass.
QUANTILE = 0.998
#: Log-perplexities are counted in steps of this size for the quantile.
STEP = 0.001
#: The model of languages without trusted text.
ANY = "*"
#: Language tags have two or three letters: so many at most, with ANY.
LANGUAGES = 26**2 + 26**3 + 1
KEY = ["lang", "h1", "h2", "s"]
GRAMS = "h1 long, h2 long, s long"


def tag(lang: Column) -> Column:
    """The language of a tag (zh of zh-Hans, eng of eng); what has none is '*'."""
    found = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(found != "", found).otherwise(F.lit(ANY))


@cache
def alphabet() -> np.ndarray:
    """The symbol of every code point: itself, without case; digits as one, space and control as SPACE."""
    table = np.arange(SYMBOLS, dtype=np.int32)
    for p in range(0x20000):  # none beyond has a case or is a space
        c = chr(p)
        if p < 32 or c.isspace():
            table[p] = SPACE
        elif c.isdigit():
            table[p] = ord("0")
        elif len(low := c.lower()) == 1:
            table[p] = ord(low)
    return table


def windows(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(h1, h2, s, owner): the n-grams ending at each symbol of the texts, about WINDOW at once, and the number of each one's text.

    Runs of space are one symbol; before its first symbol a text has spaces.
    """
    held, owners, size = [], [], 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in held])
        flat = np.concatenate(held).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        at = np.arange(len(flat))
        real = at - np.repeat(starts, lengths) >= ORDER - 1
        at = at[real]
        h1, h2 = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for k in range(1, ORDER):
            if k <= 3:
                h2 |= flat[at - k] << (BITS * (k - 1))
            else:
                h1 |= flat[at - k] << (BITS * (k - 4))
        return h1, h2, flat[at], np.repeat(owners, lengths - (ORDER - 1))

    for i, text in enumerate(texts):
        tail = np.zeros(ORDER - 1, np.int32)
        for start in range(0, len(text or ""), WINDOW):
            s = alphabet()[np.frombuffer(text[start : start + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)]
            keep = s != SPACE
            keep[1:] |= s[:-1] != SPACE
            keep[0] |= tail[-1] != SPACE
            s = s[keep]
            if len(s):
                held.append(np.concatenate([tail, s]))
                owners.append(i)
                tail, size = held[-1][1 - ORDER :], size + len(s)
                if size >= WINDOW:
                    yield flush()
                    held, owners, size = [], [], 0
    if held:
        yield flush()


def mixed(h1: np.ndarray, h2: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each n-gram; those of a bucket, some million at most, are told apart by it."""
    k = h2.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k ^= k >> np.uint64(29)
    k += h1.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    k ^= k >> np.uint64(32)
    k *= np.uint64(0x165667B19E3779F9)
    k += s.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    k ^= k >> np.uint64(31)
    return (k * np.uint64(0x27D4EB2F165667C5)).view(np.int64)


class Distinct:
    """The distinct n-grams of windows, with their counts."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = self.least = 0

    def add(self, h1: np.ndarray, h2: np.ndarray, s: np.ndarray, n: np.ndarray | None = None) -> None:
        found = pa.array(mixed(h1, h2, s)).dictionary_encode()
        which = found.indices.to_numpy()
        first = np.empty(len(found.dictionary), np.int64)
        first[which[::-1]] = np.arange(len(s) - 1, -1, -1)
        counts = np.bincount(which, n, len(first)).astype(np.int64)
        self.held.append((h1[first], h2[first], s[first], counts))
        self.size += len(first)
        if self.size > max(1 << 20, 2 * self.least):
            self.all()

    def all(self) -> tuple[np.ndarray, ...]:
        """(h1, h2, s, n)"""
        if len(self.held) > 1:
            whole = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            self.held, self.size, self.least = [], 0, 1 << 62
            self.add(*whole)
            self.least = self.size
        return self.held[0] if self.held else (np.zeros(0, np.int64),) * 4


def count_grams(trusted: DataFrame) -> DataFrame:
    """trusted (lang, text) -> (lang, h1, h2, s, n) per language and, as '*', over all."""

    def counted(texts: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
        for lang, own in sorted(texts.items()):
            seen = Distinct()
            for h1, h2, s, _ in windows(own):
                seen.add(h1, h2, s)
            h1, h2, s, n = seen.all()
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(s)), *map(pa.array, (h1, h2, s, n))], [*KEY, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in (part for whole in batches for part in parts(whole, 1)):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
            if size >= TRAIN:
                yield from counted(held)
                held, size = {}, 0
        yield from counted(held)

    each = written(arrow_map(trusted.select("lang", "text"), run, f"lang string, {GRAMS}, n long").groupBy(*KEY).agg(F.sum("n").alias("n")), "grams")
    every = each.groupBy("h1", "h2", "s").agg(F.sum("n").alias("n")).select(F.lit(ANY).alias("lang"), "h1", "h2", "s", "n")
    return each.where(F.col("lang") != ANY).unionByName(every)


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) by the counts of counts, above zero and below the count; half the count where a needed one is zero."""
    n = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0) & (F.col(f"n{i + 1}") > 0), F.greatest(F.lit(0.01), F.least(F.lit(i - 0.01), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)]
    return counts.groupBy("lang").agg(*n).select("lang", *d)


def last(k: int) -> list[Column]:
    """The last k symbols before the last one, as h1 and h2."""
    return [F.col("h1").bitwiseAND((1 << BITS * max(0, k - 3)) - 1).alias("h1"), F.col("h2").bitwiseAND((1 << BITS * min(3, k)) - 1).alias("h2")]


def _shorter(rows: DataFrame, k: int, value: str) -> DataFrame:
    """Rows of k-grams -> (r1, r2, s, lang, value), to join them to the grams of k + 1 symbols."""
    return rows.select(F.col("lang"), F.col("h1").alias("r1"), F.col("h2").alias("r2"), "s", F.col(value).alias("q"))


def _suffixed(rows: DataFrame, k: int) -> DataFrame:
    """Rows of k-grams with their last k - 1 symbols, in r1, r2 and s."""
    r1, r2 = last(k - 2)
    return rows.withColumns({"r1": r1, "r2": r2})


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 on: (lang, h1, h2, s, p) of its seen n-grams, interpolated, and (lang, h1, h2, gamma) of their contexts."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # distinct left extensions
        levels[k] = written(levels[k + 1].groupBy("lang", *last(k - 1), "s").agg(F.count("*").alias("n")), f"level-{k}")
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, ORDER + 1):
        # discounts: a row for each language tag, of which there are LANGUAGES at most
        own = levels[k].join(F.broadcast(discounts(levels[k])), "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).select(*KEY, "n", "d")
        contexts = written(own.groupBy("lang", "h1", "h2").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma")), f"contexts-{k}")
        joined = own.join(contexts, ["lang", "h1", "h2"])
        if k == 1:
            joined = joined.withColumn("q", F.lit(1.0 / SYMBOLS))
        else:
            joined = _suffixed(joined, k).join(_shorter(out[-1][0], k - 1, "p"), ["lang", "r1", "r2", "s"])
        p = written(joined.select(*KEY, ((F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("q")).alias("p")), f"order-{k}")
        out.append((p, contexts.select("lang", "h1", "h2", "gamma")))
    return out


def probabilities(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """asked (lang, h1, h2, s), distinct -> with p = P(s | the symbols before), unseen n-grams by back-off."""
    levels = {ORDER: asked}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = written(levels[k + 1].select("lang", *last(k - 1), "s").distinct(), f"asked-{k}")
    now = None
    for k, (seen, contexts) in enumerate(model, 1):
        joined = levels[k].join(seen, KEY, "left").join(contexts, ["lang", "h1", "h2"], "left")
        joined = joined.withColumn("q", F.lit(1.0 / SYMBOLS)) if now is None else _suffixed(joined, k).join(_shorter(now, k - 1, "p"), ["lang", "r1", "r2", "s"])
        before, now = now, written(joined.select(*KEY, F.coalesce("p", F.coalesce("gamma", F.lit(1.0)) * F.col("q")).alias("p")), f"answers-{k}")
        dropped(*[x for x in (before, levels[k]) if x is not None and x is not asked])
    return now


def packed(docs: DataFrame, kind: str) -> DataFrame:
    """docs (id, lang, buckets, text) -> (lang, bucket, ids, sizes, blob): texts compressed together, as they come; the size of a null is -1."""
    dealt = docs.select("id", "lang", F.pmod(F.xxhash64("id", "text"), F.col("buckets")).alias("bucket"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            by = pa.table({"lang": batch.column(1), "bucket": batch.column(2), "at": np.arange(batch.num_rows)}).group_by(["lang", "bucket"]).aggregate([("at", "list")])
            ids, texts, rows = batch.column(0), batch.column(3).cast(pa.binary()), by["at_list"].to_pylist()
            own = [[texts[i].as_py() for i in some] for some in rows]
            columns = [
                pa.array([ids.take(pa.array(some)).to_pylist() for some in rows], pa.list_(ids.type)),
                pa.array([[-1 if t is None else len(t) for t in some] for some in own], pa.list_(pa.int64())),
                pa.array([pack(b"".join(t or b"" for t in some)) for some in own], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([by["lang"].combine_chunks(), by["bucket"].combine_chunks(), *columns], ["lang", "bucket", "ids", "sizes", "blob"])

    return arrow_map(dealt, run, f"lang string, bucket long, ids array<{kind}>, sizes array<long>, blob binary")


def unpacked(sizes: list[int], blob: bytes) -> list[str | None]:
    data, out, start = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for n in sizes:
        out.append(None if n < 0 else data[start : start + n].decode("utf-8", "replace"))
        start += max(0, n)
    return out


def perplexities(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """docs (id, lang, text) -> (id, lang, n_symbols, perplexity): perplexity is null without symbols."""
    # a row for each language: at most LANGUAGES
    sizes = F.broadcast(written(docs.groupBy(F.col("lang").alias("of")).agg((F.floor(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / BUCKET) + 1).cast("long").alias("buckets")), "buckets"))
    kind = docs.schema["id"].dataType.simpleString()
    texts = packed(docs.join(sizes, F.col("lang") == F.col("of")), kind)

    def ask(key: tuple, blobs: pa.Table) -> pa.Table:
        seen = Distinct()
        for sizes, blob in zip(blobs["sizes"].to_pylist(), blobs["blob"], strict=True):
            for h1, h2, s, _ in windows(unpacked(sizes, blob.as_py())):
                seen.add(h1, h2, s)
        h1, h2, s, _ = seen.all()
        trimmed()
        return pa.table({"lang": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(s)), "bucket": pa.repeat(pa.scalar(key[1].as_py(), pa.int64()), len(s)), "h1": h1, "h2": h2, "s": s})

    asked = written(texts.groupBy("lang", "bucket").applyInArrow(ask, f"lang string, bucket long, {GRAMS}"), "asked")
    distinct = written(asked.select(*KEY).distinct(), "distinct")
    answers = asked.join(probabilities(distinct, model), KEY)

    def score(key: tuple, blobs: pa.Table, found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        known = pa.array(mixed(*(found[c].to_numpy() for c in KEY[1:])))
        logs = np.log(found["p"].to_numpy())
        ids, counts, values = [], [], []
        for own, sizes, blob in zip(blobs["ids"].to_pylist(), blobs["sizes"].to_pylist(), blobs["blob"], strict=True):
            n, sums = np.zeros(len(own), np.int64), np.zeros(len(own))
            for h1, h2, s, owner in windows(unpacked(sizes, blob.as_py())):
                at = pc.index_in(pa.array(mixed(h1, h2, s)), value_set=known)
                if at.null_count:
                    raise RuntimeError("the documents changed between two readings: an n-gram has no answer")
                n += np.bincount(owner, minlength=len(own))
                sums += np.bincount(owner, logs[at.to_numpy()], len(own))
            ids += own
            counts.append(n)
            values.append(sums)
        n, sums = np.concatenate(counts), np.concatenate(values)
        with np.errstate(all="ignore"):
            value = np.exp(-sums / n)
        trimmed()
        return pa.table({"id": pa.array(ids, blobs.schema.field("ids").type.value_type), "lang": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(n)), "n_symbols": n, "perplexity": pa.array(value, mask=n == 0)})

    return texts.groupBy("lang", "bucket").cogroup(answers.groupBy("lang", "bucket")).applyInArrow(score, f"id {kind}, lang string, n_symbols long, perplexity double")


def language_quantiles(scores: DataFrame, q: float = QUANTILE) -> DataFrame:
    """(lang, threshold): the upper edge of the step that holds the q-quantile of trusted log-perplexities.

    Counts per step merge exactly in any order; of a language there are some thousand at most.
    """
    steps = scores.where("trusted and perplexity is not null").groupBy("lang", F.floor(F.log("perplexity") / STEP).alias("step")).agg(F.count("*").alias("n"))
    by = W.partitionBy("lang")
    ranked = steps.select("lang", "step", F.sum("n").over(by.orderBy("step")).alias("upto"), F.sum("n").over(by).alias("all"))
    return ranked.where(F.col("upto") >= q * F.col("all")).groupBy("lang").agg(F.exp((F.min("step") + 1) * STEP).alias("threshold"))


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", q: float = QUANTILE) -> DataFrame:
    """One row for each row of docs: (id, lang, n_symbols, perplexity, threshold, kept).

    trusted holds the ids of the trusted documents. lang: the language whose model
    judges it, '*' (the model of all trusted text) where none is trusted or the tag
    is null or odd. A perplexity on the threshold is kept. Null, empty and blank
    texts have no symbols, and a null perplexity and verdict; so have all without
    any trusted text. Rows that repeat are each judged; rows of a trusted id are all
    trusted, a null id never. A long text is read in windows. docs or trusted may be
    empty; other columns aren't read, whatever their names.
    """
    ids = trusted.select(F.col(id_col).alias("tid")).where("tid is not null").distinct()
    source = docs.select(F.col(id_col).alias("id"), tag(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"))
    counts = written(count_grams(source.join(ids, F.col("id") == F.col("tid"), "left_semi").select("lang", "text")), "counts")
    model = kneser_ney(counts)
    known = sorted(r["lang"] for r in model[0][0].select("lang").distinct().collect())  # at most LANGUAGES
    judged = source.select("id", F.when(F.col("lang").isin(known), F.col("lang")).otherwise(F.lit(ANY)).alias("lang"), "text")
    scored = written(perplexities(judged, model), "scored")
    scores = written(scored.join(ids, F.col("id") == F.col("tid"), "left").select("id", "lang", F.col("tid").isNotNull().alias("trusted"), "n_symbols", "perplexity"), "scores")
    if not known:
        scores = scores.withColumn("perplexity", F.lit(None).cast("double"))
    own = language_quantiles(scores, q)
    every = language_quantiles(scores.withColumn("lang", F.lit(ANY)), q)
    limits = own.where(F.col("lang") != ANY).unionByName(every).select(F.col("lang").alias("of"), "threshold")
    # a row for each language: at most LANGUAGES
    joined = scores.join(F.broadcast(limits), F.col("lang") == F.col("of"), "left")
    return joined.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_symbols", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))
