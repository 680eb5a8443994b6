"""Order-dependent state of keys, also of those with most of the rows.

Where a key may be large, rows are dealt by ranges of (key, order), so that one key
lies in as many parts as it needs. Within a part a window gives the state. Over the
borders goes only what a part's rows of each key leave behind: the last value that
isn't null is a monoid, so a key's parts are folded in order, one row for each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators.tables import settled

#: Rows of a key that a window takes in one task; with more in any, keys are cut.
WHOLE = 1 << 20


@dataclass(frozen=True)
class Parts:
    """Rows, by keys and order, which together tell rows apart; cut: dealt by ranges numbered in _part, else keys are whole."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    cut: bool

    def last_before(self, values: dict[str, Column]) -> Parts:
        """With, for each name, the last value that isn't null of the rows of the same key before a row, else null."""
        window = W.partitionBy(*["_part"] * self.cut, *self.keys).orderBy(*self.order).rowsBetween(W.unboundedPreceding, -1)
        own = self.rows.withColumns({f"_v_{n}": v for n, v in values.items()})
        near = own.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(window) for n in values})
        if not self.cut:
            return Parts(near.drop(*[f"_v_{n}" for n in values]), self.keys, self.order, False)
        place = F.struct(*self.order)
        left = own.groupBy(*self.keys, "_part").agg(*[F.max_by(F.struct(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(n) for n in values])
        earlier = W.partitionBy(*self.keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        carried = left.select(*[F.col(k).alias(f"_of_{k}") for k in self.keys], F.col("_part").alias("_of"), *[F.last(n, ignorenulls=True).over(earlier)[f"_v_{n}"].alias(f"_c_{n}") for n in values])
        some, same = F.lit(False), F.col("_part") == F.col("_of")
        for n in values:
            some |= F.col(f"_c_{n}").isNotNull()
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        over = settled(carried.where(some), "borders")  # only keys that cross a border: at most a row for each range and key in two
        joined = near.join(over, same, "left").select(*self.rows.columns, *[F.coalesce(n, f"_c_{n}").alias(n) for n in values])
        return Parts(joined, self.keys, self.order, True)

    def with_columns(self, columns: dict[str, Column]) -> Parts:
        return Parts(self.rows.withColumns(columns), self.keys, self.order, self.cut)


def parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], whole: int | None = None) -> Parts:
    """df's rows, cut by ranges of (keys, order) if any key has more than ``whole`` of them."""
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= (WHOLE if whole is None else whole):
        return Parts(df, tuple(keys), tuple(order), False)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(tasks, *keys, *order).withColumn("_part", F.spark_partition_id())
    return Parts(settled(ranges, "ranges"), tuple(keys), tuple(order), True)
