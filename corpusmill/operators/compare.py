"""Comparing reports, resuming runs, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import quantiles
from corpusmill.operators.tables import settled

#: Metrics of which more is better, and less is better. Fixed values.
HIGHER = ("case_success_rate", "intent_accuracy", "exact_final_state_accuracy", "slot_micro_precision", "slot_micro_recall", "slot_micro_f1", "slot_id_micro_f1", "assistant_safety_rate", "state_progression_rate")
LOWER = ("unexpected_slot_inference_rate", "stalled_turn_rate", "consecutive_question_repeat_rate")


def long_metrics(wide: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """(ids, metric, value) of a table with a column for each metric."""
    names = [c for c in wide.columns if c not in ids]
    return wide.unpivot(list(ids), [F.col(c).cast("double").alias(c) for c in names], "metric", "value")


def compared(left: DataFrame, right: DataFrame, left_name: str, right_name: str, lower: Sequence[str] = LOWER, metrics: Sequence[str] | None = None, higher: Sequence[str] = HIGHER) -> DataFrame:
    """(metric, left_value, right_value, delta, winner) of two long metric tables.

    winner: tie, the better side's name, or unavailable where a value is missing, or
    values differ and the metric is neither one of which more is better nor one of which less is.
    Without metrics, those of either side.
    """
    a = left.select("metric", F.col("value").alias("left_value"))
    b = right.select("metric", F.col("value").alias("right_value"))
    both = a.join(b, "metric", "full")
    if metrics is not None:
        wanted = left.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
        both = wanted.join(both, "metric", "left")
    x, y = F.col("left_value"), F.col("right_value")
    less, more = F.col("metric").isin(*lower), F.col("metric").isin(*higher)
    better = F.when(less, x < y).when(more, x > y)
    winner = F.when(x.isNull() | y.isNull(), "unavailable").when(x == y, "tie").when(better.isNull(), "unavailable").when(better, left_name).otherwise(right_name)
    return both.select("metric", "left_value", "right_value", F.bround(x - y, 4).alias("delta"), winner.alias("winner"))


def pending(cases: DataFrame, reports: Sequence[DataFrame], key: str = "case_id") -> DataFrame:
    """Cases that aren't complete in every report."""
    return cases.join(completed(reports, key), key, "left_anti")


def completed(reports: Sequence[DataFrame], key: str = "case_id") -> DataFrame:
    """Keys that every report has."""
    keys = [r.select(key).distinct() for r in reports]
    out = keys[0]
    for k in keys[1:]:
        out = out.join(k, key, "left_semi")
    return out


def placed(df: DataFrame, order: str) -> DataFrame:
    """df with _at, each row's place in the order from 0 on: a whole sort, by ranges of which only the sizes meet in one task."""
    ranges = settled(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("_part").alias("_of"), F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = ranges.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1)
    return inside.join(before, F.col("_part") == F.col("_of")).select(*df.columns, (F.col("_before") + F.col("_in")).cast("long").alias("_at"))


def order_number(df: DataFrame, order: str) -> Column:
    """A number that never falls in the column's order, nulls first: of text its first six bytes."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        own = F.conv(F.rpad(F.hex(F.substring(F.col(order).cast("binary"), 1, 6)), F.lit(12), F.lit("0")), 16, 10).cast("double")
    elif isinstance(kind, T.DateType):
        own = F.unix_date(order).cast("double")
    else:
        own = F.col(order).cast("double")
    return F.coalesce(own, F.lit(float("-inf")))


def sampled(df: DataFrame, order: str, offset: int = 0, limit: int | None = None, indices: Sequence[int] | None = None) -> DataFrame:
    """Rows by their place in order: the given indices if any, else from offset on; then at most limit of them.

    Rows are counted in buckets of the order, and a large bucket that a wanted place
    lies in is counted again in narrower ones. Buckets without a wanted place are
    never sorted or read again, buckets of wanted places only are kept as they are,
    and only rows of the few others get their place by a sort. Ties are in any order.
    """
    if indices is not None:
        places = sorted({i for i in indices if i >= 0})
        if limit is not None:  # of those that are there
            n = df.count()
            places = [i for i in places if i < n][:limit]
        wanted = [(i, i + 1) for i in places]
    else:
        wanted = [(max(0, offset), (1 << 62) if limit is None else max(0, offset) + max(0, limit))]
    wanted = [w for w in wanted if w[0] < w[1]]
    rows = df.withColumn("_v", order_number(df, order))
    whole, sorted_ = [], []  # (lo, hi) and (lo, hi, rows before)
    open_: list[tuple | None] = [None] if wanted else []
    while open_:
        found = []
        for span in open_:  # at most two for a stretch, and one for each index
            inside, before = (rows, 0) if span is None else (rows.where(F.col("_v").between(span[0], span[1])), span[2])
            bucket = quantiles.first_bucket(F.col("_v")) if span is None else F.least(F.lit(quantiles.CUTS - 1), F.floor((F.col("_v") - F.lit(span[0])) / F.lit(span[1] - span[0]) * quantiles.CUTS)).cast("int")
            counts = inside.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
            start = F.lit(before) + F.sum("c").over(W.orderBy("bucket")) - F.col("c")
            there = counts.select("c", "lo", "hi", start.alias("start"))
            meets = F.exists(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in wanted]), lambda w: (F.col("start") < w["b"]) & (F.col("start") + F.col("c") > w["a"]))
            inner = F.lit(False) if indices is not None else (F.col("start") >= wanted[0][0]) & (F.col("start") + F.col("c") <= wanted[0][1])
            span_of = there.where(meets & inner).agg(F.min("lo"), F.max("hi")).first()
            if span_of[0] is not None:
                whole.append(tuple(span_of))
            found += [tuple(r) for r in there.where(meets & ~inner).collect()]  # borders of the stretch, or a bucket for each index at most
        sorted_ += [(lo, hi, start) for c, lo, hi, start in found if c <= quantiles.SORTED or _same(lo, hi)]
        open_ = [(lo, hi, start) for c, lo, hi, start in found if c > quantiles.SORTED and not _same(lo, hi)]
    out = df.limit(0)
    for lo, hi in whole:
        out = out.unionByName(rows.where((F.col("_v") >= F.lit(lo)) & (F.col("_v") <= F.lit(hi))).drop("_v"))
    if sorted_:
        which = F.lit(None).cast("long")
        for lo, hi, start in sorted_:
            which = F.when((F.col("_v") >= F.lit(lo)) & (F.col("_v") <= F.lit(hi)), F.lit(start)).otherwise(which)
        own = rows.withColumn("_start", which).where("_start is not null")
        at = own.withColumn("_at", F.col("_start") + F.row_number().over(W.partitionBy("_start").orderBy(F.asc_nulls_first(order))) - 1)
        chosen = F.col("_at").isin([a for a, _ in wanted]) if indices is not None else (F.col("_at") >= wanted[0][0]) & (F.col("_at") < wanted[0][1])
        out = out.unionByName(at.where(chosen).select(df.columns))
    return out


def _same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


def successor(df: DataFrame, index: str, n: int, columns: Sequence[str]) -> DataFrame:
    """df with next_<column>: those of the row with index (index + 1) mod n, round a ring of the first n rows."""
    after = df.where(F.col(index) < n).select(F.col(index).alias("_next"), *[F.col(c).alias(f"next_{c}") for c in columns])
    return df.join(after, (F.col(index) + 1) % n == F.col("_next"), "left").drop("_next")


def latest_checkpoint(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, step) of the highest numbered checkpoint; names without a whole number don't count."""
    step = F.regexp_extract(path, r"checkpoint-(\d+)/?$", 1).try_cast("long")
    return paths.select(F.col(path).alias("path"), step.alias("step")).where("step is not null").agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step")).where("step is not null")


def positive_counts(updates: DataFrame, slots: DataFrame, slot: str = "slot_id") -> DataFrame:
    """(slot, n) for all slots, 0 where there is no update."""
    n = updates.groupBy(slot).agg(F.count("*").alias("n"))
    return slots.select(slot).distinct().join(n, slot, "left").select(slot, F.coalesce("n", F.lit(0)).alias("n"))


def underrepresented(counts: DataFrame, required: DataFrame, least: int = 100, slot: str = "slot_id") -> DataFrame:
    """(slot, n) of the required slots with fewer than least positive examples; one without a count has 0."""
    both = required.select(slot).distinct().join(counts, slot, "left").select(slot, F.coalesce("n", F.lit(0)).alias("n"))
    return both.where(F.col("n") < least)


def length_profile(df: DataFrame, length: Column, limit: int, by: str = "split") -> DataFrame:
    """Shortest, longest, total and number over the limit, for each split."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.sum(length).alias("total"), F.count_if(length > limit).alias("over_limit"))


def excluding(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Rows whose key isn't one of the values; a null key stays."""
    return df.where(F.col(key).isNull() | ~F.col(key).isin(*values))


def within_limit(profile: DataFrame, allow_truncation: bool = False) -> DataFrame:
    """A length profile, if nothing is over the limit or truncation is allowed; else an error that names the splits."""
    over = [f"{r[0]}: {r['over_limit']}" for r in profile.where("over_limit > 0").collect()]  # a row for each split
    if over and not allow_truncation:
        raise ValueError(f"records over the limit: {', '.join(over)}")
    return profile
