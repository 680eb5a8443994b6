"""Order-sensitive dedup, last-write-wins, runs, and splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.operators.scans import parts


def first_seen(df: DataFrame, key: Column, order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by order.

    Rows are ranked within a 256-bit digest of the key; a rank filter of 1 keeps one
    row a task and key before the shuffle, so frequent keys don't pile up.
    """
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(F.sha2(key, 256)).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def last_write(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """The values of the last row of each key."""
    last = F.max_by(F.struct(*values), order).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*")


def carried_forward(df: DataFrame, keys: Sequence[str], order: str, value: str, evidence: str) -> DataFrame:
    """df with original_evidence: that of the first row of the run of equal values which the row is in.

    keys and order tell rows apart. Two scans: the value before tells where runs
    begin, and the last beginning has the evidence; a key with most of the rows is cut.
    """
    before = parts(df, keys, [order]).last_before({"_before": F.struct(value)})
    begins = F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col(f"_before.{value}"))
    runs = before.with_columns({"_begun": F.when(begins, F.struct(evidence))}).last_before({"_earlier": F.col("_begun")})
    return runs.rows.select(*df.columns, F.coalesce("_begun", "_earlier")[evidence].alias("original_evidence"))


def split_of(index: Column) -> Column:
    """Domains 0-13 train, 14-16 validation, the rest test."""
    return F.when(index < 14, "train").when(index < 17, "validation").otherwise("test")


def extended_split_of(index: Column) -> Column:
    """As split_of up to 19; 20-26 train, 27-29 validation, the rest test."""
    return F.when(index < 20, split_of(index)).when(index < 27, "train").when(index < 30, "validation").otherwise("test")


def crossing_keys(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, n_splits, n) of the keys that more than one split has: none in disjoint splits."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n")).where("n_splits > 1")


#: Bytes of phrases that one automaton takes; some hundred times as much is its memory in a task.
PHRASES = 1 << 20


def containing(texts: DataFrame, phrases: DataFrame, key: str, text: str, item: str, phrase: str, limit: int | None = None) -> DataFrame:
    """(key, item) pairs where a phrase stands in a text; an empty phrase stands in every text, null ones in none.

    Phrases of up to ``limit`` bytes together (PHRASES) go to every task as one
    Aho-Corasick automaton, which reads each text once, whatever words are frequent.
    More are joined to texts by an anchor word.
    """
    own = phrases.where(F.col(phrase).isNotNull()).select(F.col(item).alias("i"), F.col(phrase).alias("p"))
    if (own.agg(F.sum(F.octet_length("p") + 16)).first()[0] or 0) > (PHRASES if limit is None else limit):
        return joined_by_anchor(texts, phrases, key, text, item, phrase)
    known = own.collect()  # of the size just checked
    items: dict[str, list] = {}
    for r in known:
        items.setdefault(r["p"], []).append(r["i"])
    table = phrases.sparkSession.sparkContext.broadcast(list(items.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, everywhere = ahocorasick.Automaton(), []
        for k, (p, _) in enumerate(table.value):
            if p:
                automaton.add_word(p, k)
            else:
                everywhere.append(k)
        if len(automaton):
            automaton.make_automaton()
        found = [own for _, own in table.value]
        for batch in batches:
            keys, met = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                here = {n for _, n in automaton.iter(t)} if len(automaton) else set()
                for n in (*here, *everywhere):
                    met += found[n]
                    keys += [k] * len(found[n])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(met, item_type)], ["k", "i"])

    item_type = to_arrow_type(own.schema["i"].dataType)
    some = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kinds = T.StructType([T.StructField("k", some.schema["k"].dataType), T.StructField("i", own.schema["i"].dataType)])
    return some.mapInArrow(run, kinds).distinct().toDF(key, item)


def joined_by_anchor(texts: DataFrame, phrases: DataFrame, key: str, text: str, item: str, phrase: str) -> DataFrame:
    """containing() for more phrases than one automaton takes.

    A word of a phrase that isn't its first or last stands whole in any text with the
    phrase, so the longest one is its anchor; a phrase without such a word has its
    first three characters (or all of fewer) as one. Anchors join the words, and the
    runs of three characters, of texts to phrases, ids only; then the pairs that
    share one fetch their texts and are compared. An empty phrase is in every text.
    """
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    inside = F.slice(words(F.col("_phrase")), 2, F.greatest(F.lit(0), F.size(words(F.col("_phrase"))) - 2))
    anchor = F.aggregate(inside, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    own = phrases.where(F.col(phrase).isNotNull()).select(F.col(item).alias("_item"), F.col(phrase).alias("_phrase")).withColumn("_word", anchor)
    named = own.select("_item", "_phrase", F.when(F.col("_word") != "", F.concat(F.lit("w"), "_word")).otherwise(F.concat(F.lit("c"), F.substring("_phrase", 1, 3))).alias("_anchor"))
    some = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    by_word = some.select("_key", F.explode(F.array_distinct(words(F.col("_text")))).alias("_w")).select("_key", F.concat(F.lit("w"), "_w").alias("_has"))
    chars = F.split("_text", "")
    run = lambda n: F.transform(chars, lambda c, i: F.concat(F.lit("c"), F.array_join(F.slice(chars, i + 1, F.lit(n)), "")))
    lengths = named.where(F.startswith("_anchor", F.lit("c"))).select((F.length("_anchor") - 1).alias("n")).distinct()
    needed = sorted(r["n"] for r in lengths.collect())  # at most 0 to 3
    pairs = by_word.join(named, F.col("_has") == F.col("_anchor")).select("_key", "_item", "_phrase")
    for n in needed:
        has = some.select("_key", F.explode(F.array_distinct(run(n)) if n else F.array(F.lit("c"))).alias("_has"))
        pairs = pairs.unionByName(has.join(named, F.col("_has") == F.col("_anchor")).select("_key", "_item", "_phrase"))
    met = pairs.distinct().withColumnRenamed("_key", "_of").join(some, F.col("_of") == F.col("_key")).where(F.contains("_text", "_phrase"))
    return met.select(F.col("_key").alias(key), F.col("_item").alias(item))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with the number of times each side has more of them; empty for equal multisets. One shuffle."""
    cols = left.columns
    both = left.select(*cols, F.lit(1).alias("_n")).unionByName(right.select(*cols, F.lit(-1).alias("_n")))
    return both.groupBy(*cols).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")
