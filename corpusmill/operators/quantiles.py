"""Exact order statistics by histogram refinement: no group is ever sorted whole.

Values are counted in buckets by group, with a bucket's least and greatest value.
Running sums over a group's buckets, of which there are a bounded number, say which
bucket holds a wanted place. A bucket of one value is that value; a bucket of few
rows is sorted, and only it; a larger one is cut into narrower buckets between its
least and greatest value, and counted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators.tables import settled

#: Rows of a bucket that are sorted in one task.
SORTED = 1 << 16
#: First buckets for each e-fold of a value's size (at most some 90,000 a group), and buckets that a large one is cut into.
FINE, CUTS = 64, 4096


def first_bucket(v: Column) -> Column:
    """A bucket number that never falls as the value grows; infinite values and NaN, which is the greatest, have their own."""
    near = F.signum(v) * F.floor(F.log1p(F.abs(v)) * FINE)
    return F.when(F.isnan(v), 1 << 30).when(v == float("inf"), 1 << 29).when(v == float("-inf"), -(1 << 29)).otherwise(near.cast("int"))


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "bucket").agg(F.count("v").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def _meet(a: DataFrame, b: DataFrame, keys: list[str], on: Column | None = None, how: str = "inner") -> DataFrame:
    """a joined to b on keys, nulls alike; b's columns are named b_<name>, and on may name both."""
    named = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    same = F.lit(True) if on is None else on
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return a.join(named, same, how)


def _running(counted: DataFrame, keys: list[str]) -> DataFrame:
    """counted with upto, the rows up to and with a bucket, and n, those of its group."""
    group = W.partitionBy(*keys)
    return counted.withColumns({"upto": F.sum("c").over(group.orderBy("bucket")), "n": F.sum("c").over(group)})


def _holding(placed: DataFrame, keys: list[str], start: Column) -> DataFrame:
    """(keys, place, before, c, lo, hi): of a bucket's rows, which begin at start, those that hold the place wanted."""
    found = placed.withColumn("start", start).where((F.col("start") <= F.col("place")) & (F.col("place") < F.col("start") + F.col("c")))
    return found.select(*keys, "place", F.col("start").alias("before"), "c", "lo", "hi")


def values_at(rows: DataFrame, keys: list[str], held: DataFrame) -> DataFrame:
    """(keys, place, value) of the wanted places, from the buckets that hold them.

    rows: (keys, v), v a double that isn't null; held: (keys, place, before, c, lo, hi).
    """
    done, held = [], settled(held, "held")
    inside = (F.col("v") >= F.col("b_lo")) & (F.col("v") <= F.col("b_hi"))
    while True:
        done.append(held.where(F.col("lo").eqNullSafe(F.col("hi"))).select(*keys, "place", F.col("lo").alias("value")))
        open_ = held.where(~F.col("lo").eqNullSafe(F.col("hi")))
        few, large = open_.where(F.col("c") <= SORTED), open_.where(F.col("c") > SORTED)
        own = _meet(rows, few.select(*keys, "before", "lo", "hi").distinct(), keys, inside).select(*keys, "v", F.col("b_before").alias("before"))
        at = own.withColumn("at", F.col("before") + F.row_number().over(W.partitionBy(*keys, "before").orderBy("v")) - 1)
        done.append(_meet(at, few.select(*keys, "place"), keys, F.col("at") == F.col("b_place")).select(*keys, F.col("at").alias("place"), F.col("v").alias("value")))
        if large.isEmpty():
            break
        # rows of a large bucket, counted in CUTS narrower ones; a bucket is named by the rows before it
        within = _meet(rows, large.select(*keys, "before", "lo", "hi").distinct(), keys, inside)
        share = (F.col("v") - F.col("b_lo")) / (F.col("b_hi") - F.col("b_lo"))
        cut = within.select(*keys, F.col("b_before").alias("before"), "v", F.least(F.lit(CUTS - 1), F.floor(share * CUTS)).cast("int").alias("bucket"))
        upto = _running(_counted(cut, [*keys, "before"]), [*keys, "before"])
        wanted = _meet(upto, large.select(*keys, "before", "place"), [*keys, "before"]).withColumn("place", F.col("b_place"))
        held = settled(_holding(wanted, keys, F.col("before") + F.col("upto") - F.col("c")), "held")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def spread(df: DataFrame, value: str, by: list[str], places: dict[str, Column]) -> DataFrame:
    """(_all, by, n, mean, each name of places) for each group (_all 0) and for all rows (_all 1, by null).

    places: 0-based places in the order of a group's values, as columns of n, the
    number of values that aren't null. Groups without values have nulls. One pass
    counts; another fetches the rows of the buckets that hold the places; more are
    made only for buckets of more than SORTED rows with values that differ.
    """
    keys = ["_all", *by]
    both = df.select(*by, F.col(value).cast("double").alias("v"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_all"))
    rows = both.select("_all", *[F.when(F.col("_all") == 0, F.col(c)).alias(c) for c in by], "v")
    counts = settled(rows.withColumn("bucket", first_bucket(F.col("v"))).groupBy(*keys, "bucket").agg(F.count("v").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("s")), "buckets")
    known = counts.where("bucket is not null").drop("s")
    valued = rows.where("v is not null")
    placed = _running(known, keys).withColumn("place", F.explode(F.array_distinct(F.array(*places.values()))))
    found = values_at(valued, keys, _holding(placed, keys, F.col("upto") - F.col("c")))
    groups = counts.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("mean"))
    at = _meet(groups, found, keys, how="left")
    picked = [F.max(F.when(F.col("b_place") == place, F.col("b_value"))).alias(name) for name, place in places.items()]
    return at.groupBy(*keys, "n", "mean").agg(*picked)
