"""Incremental evaluation: streams of cases, resumed by checkpoint; dialogue state by turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.tables import settled

#: Hashes that the keys of an evaluation are cut into, if nothing else cuts them.
SLICES = 64


def evaluated_stream(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "case_id", slices: Column | None = None, files: int | None = None) -> StreamingQuery:
    """Scores new JSON Lines files once, each case the first time it comes. Ends when all there is is done.

    The stream holds no state. The keys done are a table in out/_done, cut by
    ``slices``, a value of the case such as its day (else SLICES hashes of its key): a
    batch reads the keys of its own slices only, and those of earlier batches, so what
    a task holds is bounded by a slice. A batch's results (out/batch=N) and keys
    replace those of an earlier try at the same batch, so a restart repeats nothing.
    files: files of a batch.
    """
    sliced = F.pmod(F.xxhash64(key), F.lit(SLICES)) if slices is None else slices
    kind = T.StructType.fromDDL(schema)[key].dataType.simpleString()

    def step(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("slice", sliced.cast("string"))
        first = own.dropDuplicates([key])
        if number:
            done = spark.read.schema(f"`{key}` {kind}, batch long, slice string").parquet(f"{out}/_done")
            touched = own.select("slice").distinct()  # so that only these folders are read
            earlier = done.where(F.col("batch") < number).join(F.broadcast(touched) if slices is None else touched, "slice", "left_semi")
            first = first.join(earlier.select(key), key, "left_anti")
        fresh = settled(first, "batch")
        score(fresh.drop("slice")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        fresh.select(key, "slice").repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(f"{out}/_done/batch={number}")

    reader = spark.readStream.schema(schema)
    cases = (reader if files is None else reader.option("maxFilesPerTrigger", files)).json(source)
    return cases.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Number and mean of a value by kind and window of event time, for streams (with a watermark for late rows) and tables alike."""
    seen = events.withWatermark(time, late) if events.isStreaming else events
    return seen.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), kind, "n", "mean")


def dialogue_state(updates: DataFrame, dialogue: str = "dialogue_id", slot: str = "slot_id", order: str = "turn") -> DataFrame:
    """The current value of each slot of each dialogue, from an append-only log of updates."""
    last = F.max_by(F.struct("value", "status"), order)
    return updates.groupBy(dialogue, slot).agg(last.alias("s"), F.max(order).alias("source_turn")).select(dialogue, slot, "s.value", "s.status", "source_turn")
