"""Mixing sources to target weights with a low-discrepancy source schedule.

Each source's documents are shuffled by a keyed hash and laid end to end; that
stream of words, repeated without end, is cut into blocks of equally many words.
Slot n of the schedule gets the golden-ratio point frac((n + 1) * phi), which
falls into one source's share of the cumulative targets, so every stretch of the
schedule holds each source near its share. The slots of a source are ranked, and
the slot of rank r takes block r of the source's stream, up to the limit of
epochs. What a source gives is what its slots take: near its target by the low
discrepancy of the points (a few blocks), not made equal to it.

DataFrame operations only. No group is ever in one task: running totals within a
source are those of its hash buckets (at most BUCKETS rows a source) plus those
within a bucket, and running totals over sources those of ranges of their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.llm.common import written

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
EPOCHS = 3
#: Hash buckets that a source's documents are dealt into.
BUCKETS = 4096
#: Slots of the schedule: blocks have so many words that there are about SLOTS, from 1 to BLOCK_WORDS of them.
#: A larger corpus has larger blocks, up to BLOCK_WORDS, and from there more slots; a source is off its target by a few blocks.
SLOTS = 1 << 18
BLOCK_WORDS = 1 << 20
#: Fractional part of the golden ratio in units of 2**-31.
PHI = 1327217885


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    spaced = F.translate(text, "\t\n\x0b\f\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def ranged(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df as a table dealt by ranges of the order, numbered in that order in the column part."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()), name)


def sums_before(dealt: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """dealt (as by ranged) with the sum of each value over all rows before a row; only the totals of the ranges meet in one task."""
    totals = dealt.groupBy("part").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    parts_before, before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = totals.select(F.col("part").alias("of_part"), *[F.coalesce(F.sum(n).over(parts_before), zero).alias(f"off_{n}") for n in values])
    within = dealt.select("*", *[F.coalesce(F.sum(v).over(before), zero).alias(f"in_{n}") for n, v in values.items()])
    joined = within.join(offsets, F.col("part") == F.col("of_part"))
    return joined.select(*dealt.columns, *[(F.col(f"off_{n}") + F.col(f"in_{n}")).alias(n) for n in values])


def by_name() -> list[Column]:
    return [F.col("source").isNull(), F.col("source").cast("binary")]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target, part) for (source, size) totals: shares of all words by weight, none above epochs times its source.

    With sources in the order of epochs * size / weight, those that stop at the limit
    come first; after them the rest is shared by weight. The k-th stops if its
    limit is below its share of what the first k - 1 leave. Sums are exact; a source
    without words has target 0. part numbers ranges of the sources by name.
    """
    named = ranged(sizes.select("source", F.col("size").alias("source_size")), by_name(), "sources")
    ranked = sums_before(named, by_name(), {"k": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("long")
    weighed = ranked.select("source", "source_size", F.col("part").alias("name_part"), weight.alias("w"), (epochs * F.col("source_size")).alias("stop"))
    order = [F.col("stop") / F.col("w"), *by_name()]
    ordered = written(sums_before(ranged(weighed, order, "weighed"), order, {"stop_before": F.col("stop"), "w_before": F.col("w")}), "limits")
    size, w = ordered.agg(F.sum("source_size"), F.sum("w")).first()
    left = ordered.select("*", (F.lit(size or 0) - F.col("stop_before")).cast("double").alias("rest"), (F.lit(w or 0) - F.col("w_before")).cast("double").alias("rest_w"))
    stops = F.col("stop") * F.col("rest_w") < F.col("w") * F.col("rest")
    # the first that doesn't stop has the largest share a weight of those that don't
    first = left.where(~stops).agg(F.max(F.struct((F.col("rest") / F.col("rest_w")).alias("each"), "rest", "rest_w"))).first()
    rest, rest_w = (first[0]["rest"], first[0]["rest_w"]) if first and first[0] else (0.0, 1.0)
    target = F.when(stops, F.col("stop").cast("double")).otherwise(F.col("w") * F.lit(rest) / F.lit(rest_w))
    return left.select("source", "source_size", target.alias("target"), F.col("name_part").alias("part"))


def _running(df: DataFrame, bucket: str, order: list[str], value: Column) -> DataFrame:
    """df with before: the sum of value over the rows of the same source that come earlier by (bucket, order).

    The running total of the buckets joins the one within a bucket.
    """
    valued = df.withColumn("_v", value)
    totals = valued.groupBy("source", bucket).agg(F.sum("_v").alias("t"))
    earlier = F.sum("t").over(W.partitionBy("source").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select(F.col("source").alias("of_source"), F.col(bucket).alias("of_bucket"), F.coalesce(earlier, F.lit(0)).cast("long").alias("offset"))
    within = F.sum("_v").over(W.partitionBy("source", bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    summed = valued.select("*", F.coalesce(within, F.lit(0)).cast("long").alias("w_before"))
    joined = summed.join(offsets, F.col("source").eqNullSafe(F.col("of_source")) & (F.col(bucket) == F.col("of_bucket")))
    return joined.withColumn("before", F.col("offset") + F.col("w_before")).drop("_v", "w_before", "of_source", "of_bucket", "offset")


def schedule(sources: DataFrame, total: int, block: int, step: int = PHI) -> DataFrame:
    """(slot, source, rank): the source that each slot's point falls into, and the slot's number among that source's.

    sources (source, source_size, target, part); total: the sum of the rounded
    targets. Shares are cut at multiples of 2**-31.
    """
    goals = sums_before(sources.withColumn("goal", F.round("target").cast("long")), by_name(), {"before": F.col("goal")})
    place = lambda c: F.floor(c.cast("double") / F.lit(float(total)) * F.lit(2.0**31)).cast("long")
    shares = goals.select("source", place(F.col("before")).alias("lo"), place(F.col("before") + F.col("goal")).alias("hi")).where("hi > lo")
    # points and shares meet in cells, of which there are some for each source
    cells = 31 - min(31, max(14, (4 * sources.count()).bit_length()))
    pieces = shares.select("*", F.explode(F.sequence(F.expr(f"shiftright(lo, {cells})"), F.expr(f"shiftright(hi - 1, {cells})"))).alias("cell"))
    points = sources.sparkSession.range(-(-total // block)).select(F.col("id").alias("slot"), ((F.col("id") + 1) * step).bitwiseAND((1 << 31) - 1).alias("x")).withColumn("cell", F.expr(f"shiftright(x, {cells})"))
    placed = points.join(pieces, "cell").where("x >= lo and x < hi").select("slot", "source", F.floor(F.col("slot") / 4096).alias("chunk"))
    return _running(placed, "chunk", ["slot"], F.lit(1).cast("long")).select("slot", "source", F.col("before").alias("rank"))


def laid(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(id, source, size, start): each document's place in its source's stream, in the order of a keyed hash."""
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("u", key), "sizes")
    bucketed = rows.withColumn("bucket", F.expr(f"shiftright(u, {60 - BUCKETS.bit_length() + 1})"))
    return _running(bucketed, "bucket", ["u", "id", "size"], F.col("size")).select("id", "source", "size", F.col("before").alias("start"))


def placements(stream: DataFrame, sources: DataFrame, epochs: int, step: int = PHI) -> DataFrame:
    """(id, source, size, start, rank, words, slot) for each document of stream with words and each slot that takes some of it.

    rank, words and slot are null, 0 and null for a document that no slot takes.
    """
    total, size = sources.agg(F.sum(F.round("target").cast("long")), F.sum("source_size")).first()
    block = max(1, min(BLOCK_WORDS, (size or 0) // SLOTS))
    slots = written(schedule(sources, max(1, total or 0), block, step), "slots")
    made = slots.groupBy(F.col("source").alias("m")).agg(F.count("*").alias("made"))
    stop = F.least(F.coalesce("made", F.lit(0)) * block, epochs * F.col("source_size")).cast("long")
    limits = sources.join(made, F.col("source").eqNullSafe(F.col("m")) & F.col("made").isNotNull(), "left").select(F.col("source").alias("s"), "source_size", stop.alias("stop"))
    limits = written(limits, "stops")  # so that the join needn't deal documents by source, or can split a large one
    in_epochs = f"filter(transform(sequence(0, {epochs - 1}), e -> struct(e * source_size + start as lo, least(e * source_size + start + size, stop) as hi)), p -> p.hi > p.lo)"
    cut = f"flatten(transform({in_epochs}, p -> transform(sequence(p.lo div {block}, (p.hi - 1) div {block}), r -> struct(r as rank, least(p.hi, (r + 1) * {block}) - greatest(p.lo, r * {block}) as words))))"
    spread = stream.where("size > 0").join(limits, F.col("source").eqNullSafe(F.col("s"))).select("id", "source", "size", "start", F.explode_outer(F.expr(cut)).alias("p"))
    ranked = slots.select(F.col("source").alias("of_source"), F.col("rank").alias("of_rank"), "slot")
    pieces = spread.select("id", "source", "size", "start", "p.rank", F.coalesce("p.words", F.lit(0)).cast("long").alias("words"))
    return pieces.join(ranked, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("rank") == F.col("of_rank")), "left").drop("of_source", "of_rank")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, step: int = PHI) -> DataFrame:
    """One row for each row of docs: (id, source, size, source_size, target, taken, n_slots, first_slot, last_slot).

    taken: words that the schedule's slots take from it, repeats counted; a source's
    sum is that of its slots, a few blocks from its target, and no document exceeds
    epochs times its size. n_slots, first_slot, last_slot: the slots that take it,
    once for each epoch (null, and 0, where none does). Documents without words
    (null and empty texts) have size and taken 0; a null source is one, the last in
    order. Rows that repeat, and ids that tie in the shuffle, are each taken (equal
    rows are exchangeable). A long text lies in several blocks. An empty table gives
    an empty result; other columns aren't read. step: the points' step in units of
    2**-31.
    """
    stream = written(laid(docs, id_col, text_col, source_col, seed), "stream")
    sources = written(source_targets(stream.groupBy("source").agg(F.sum("size").alias("size")), weights, epochs), "targets")
    zero = F.lit(0).cast("long")
    taken = placements(stream, sources, epochs, step).groupBy("source", "start", "size", "id").agg(F.sum("words").alias("taken"), F.count("slot").alias("n_slots"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    none = stream.where("size = 0").select("id", "source", "size", zero.alias("taken"), zero.alias("n_slots"), F.lit(None).cast("long").alias("first_slot"), F.lit(None).cast("long").alias("last_slot"))
    facts = sources.select(F.col("source").alias("s"), "source_size", "target")
    every = taken.select(none.columns).unionByName(none).join(facts, F.col("source").eqNullSafe(F.col("s")))
    return every.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "n_slots", "first_slot", "last_slot")
