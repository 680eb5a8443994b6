"""Sinks: JSON Lines, splits, manifests, reports, CSV, resumable output."""

from __future__ import annotations

import json
import platform
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def alphabetical(kind: T.DataType) -> T.DataType:
    """A type with the fields of all its structs in order of name."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, alphabetical(f.dataType), f.nullable) for f in sorted(kind, key=lambda f: f.name)])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(alphabetical(kind.elementType), kind.containsNull)
    return kind


def _ordered(column, kind: T.DataType):
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[_ordered(column[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("key"), _ordered(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.NumericType, T.BooleanType)):
        return F.transform(column, lambda x: _ordered(x, kind.elementType))
    return column


def sorted_fields(df: DataFrame) -> DataFrame:
    """df with columns, the fields of nested structs and the keys of maps in order of name: JSON with sorted keys."""
    return df.select(*[_ordered(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(df.columns)])


def write_jsonl(df: DataFrame, path: str, order: Sequence[str] = (), files: int | None = None) -> None:
    """JSON Lines with sorted keys, nulls as null, and raw UTF-8.

    With files=1 and an order the bytes are the same each time; use that for small
    results only, and write_tree for others.
    """
    placed = df.repartition(files) if files else df
    placed = placed.sortWithinPartitions(*order) if order else placed
    sorted_fields(placed).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lists(df: DataFrame, path: str) -> None:
    """The rows of each task as one file that is a JSON list."""
    lines = sorted_fields(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([(mark if k == 0 else ",") + v for k, v in enumerate(values)], pa.string())], ["value"])
            mark = "," if values else mark
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], ["value"])

    lines.mapInArrow(run, "value string").write.mode("overwrite").text(path)


#: Leaves of a tree of digests, and children of a node.
LEAVES, CHILDREN = 256, 16


def leaf_of(key: str, leaves: int = LEAVES) -> Column:
    """The leaf that a row belongs to, by its key alone."""
    return (F.conv(F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, 8), 16, 10).cast("long") % leaves).cast("int")


def json_lines(df: DataFrame, key: str, leaves: int = LEAVES) -> DataFrame:
    """(leaf, key, value): each row as JSON with sorted keys and nulls."""
    fields = sorted_fields(df)
    value = F.to_json(F.struct(*fields.columns), {"ignoreNullFields": "false"})
    return fields.select(leaf_of(key, leaves).alias("leaf"), F.col(key).cast("string").alias("key"), value.alias("value"))


def write_tree(df: DataFrame, path: str, key: str, leaves: int = LEAVES) -> None:
    """JSON Lines in a folder for each leaf (leaf=N), in the order of (leaf, key, line): the lines of a leaf are the same however many tasks write."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = json_lines(df, key, leaves).repartitionByRange(tasks, "leaf", "key", "value")
    dealt.sortWithinPartitions("leaf", "key", "value").select("leaf", "value").write.mode("overwrite").partitionBy("leaf").text(path)


def read_tree(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """(leaf, value) of what write_tree wrote; only: of these leaves, without reading others."""
    lines = spark.read.schema("value string, leaf int").text(path).select("leaf", "value")
    return lines if only is None else lines.where(F.col("leaf").isin(*only))


def leaf_digests(lines: DataFrame) -> DataFrame:
    """(level, node, n, digest) of the leaves of (leaf, value) lines, level 0.

    A leaf's digest is that of its number of lines and of the sums of the four
    quarters of their SHA-256, so it depends on no order and no leaf is gathered.
    """
    sha = F.sha2("value", 256)
    quarters = [F.sum(F.conv(F.substring(sha, 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return lines.groupBy(F.col("leaf").alias("node")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *quarters), 256).alias("digest")).select(F.lit(0).alias("level"), "node", "n", "digest")


def digest_tree(leaves: DataFrame, n_leaves: int = LEAVES) -> DataFrame:
    """(level, node, n, digest) of the leaves and the nodes above them; the last level is the root. A node's digest is that of its children in order."""
    out = level = leaves
    depth = 0
    while n_leaves > 1:
        n_leaves, depth = -(-n_leaves // CHILDREN), depth + 1
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat(c["node"].cast("string"), F.lit("="), c["digest"]))  # CHILDREN at most
        level = level.groupBy(F.floor(F.col("node") / CHILDREN).cast("int").alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(children, ","), 256).alias("digest")).select(F.lit(depth).alias("level"), "node", "n", "digest")
        out = out.unionByName(level)
    return out


def changed_leaves(before: DataFrame, after: DataFrame) -> list[int]:
    """The leaves that two trees don't share, found from the root down; there are no more than a tree has."""
    top = max(r[0] for t in (before, after) for r in t.agg(F.coalesce(F.max("level"), F.lit(0))).collect())
    parents = None
    for level in range(top, -1, -1):
        sides = [t.where(F.col("level") == level).select("node", F.col("digest").alias(name)) for t, name in ((before, "a"), (after, "b"))]
        both = sides[0].join(sides[1], "node", "full").where(~F.col("a").eqNullSafe(F.col("b")))
        inside = both if parents is None else both.where(F.floor(F.col("node") / CHILDREN).isin(*parents))
        parents = sorted(r[0] for r in inside.select("node").collect())
        if not parents:
            return []
    return parents


def recheck(spark: SparkSession, path: str, tree: DataFrame, only: Sequence[int] | None = None) -> DataFrame:
    """(node, problem) of the leaves of files whose lines differ from those of a tree; only these leaves are read, if given."""
    found = leaf_digests(read_tree(spark, path, only)).select("node", F.col("digest").alias("own"))
    named = tree.where("level = 0").select("node", "digest")
    both = (named if only is None else named.where(F.col("node").isin(*only))).join(found, "node", "full")
    problem = F.when(F.col("own").isNull(), "missing").when(F.col("digest").isNull(), "unknown").when(F.col("own") != F.col("digest"), "checksum")
    return both.select("node", problem.alias("problem")).where("problem is not null")


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def write_csv(df: DataFrame, path: str, review: Sequence[str] = ()) -> None:
    """CSV with a header and empty columns for human review."""
    df.select("*", *[F.lit(None).cast("string").alias(c) for c in review]).write.mode("overwrite").option("header", True).csv(path)


def manifest(df: DataFrame, version: str, by: Sequence[str], files: DataFrame | None = None) -> DataFrame:
    """One row: version, count, counts by each column (maps with sorted keys), and files {name: (sha256, bytes)}."""
    parts = []
    for c in by:
        counts = df.groupBy(F.col(c).cast("string").alias("k")).agg(F.count("*").alias("n"))
        parts.append(counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m")).select(F.lit(f"{c}_counts").alias("what"), F.to_json("m").alias("json")))
    out = df.agg(F.lit("count").alias("what"), F.count("*").cast("string").alias("json"))
    for p in parts:
        out = out.unionByName(p)
    if files is not None:
        own = files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("sha256", "bytes"))))).alias("m"))
        out = out.unionByName(own.select(F.lit("files").alias("what"), F.to_json("m").alias("json")))
    return out.unionByName(df.sparkSession.createDataFrame([("version", json.dumps(version))], "what string, json string"))


def content_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): independent of order and files, from the rows' canonical content."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    digits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(digits).cast("string").alias("digest"))


def verified(manifest_files: DataFrame, found: DataFrame) -> DataFrame:
    """(name, problem) of files that the manifest names and are missing or differ."""
    both = manifest_files.join(found.select("name", F.col("sha256").alias("own")), "name", "left")
    problem = F.when(F.col("own").isNull(), "missing").when(F.col("own") != F.col("sha256"), "checksum")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def artifact_problems(manifest_files: DataFrame, found: DataFrame, violations: DataFrame, ids: DataFrame, key: str = "scenario_id", split: str = "split") -> DataFrame:
    """(name, problem) of a written corpus, all at once; none in a sound one.

    Files that the manifest names and are missing or differ, expectations (name,
    violations) that fail, and ids that more than one split has.
    """
    failed = violations.where("violations <> 0").select("name", F.concat(F.lit("violations: "), F.col("violations").cast("string")).alias("problem"))
    crossing = ids.groupBy(F.col(key).cast("string").alias("name")).agg(F.sort_array(F.collect_set(split)).alias("s")).where("size(s) > 1")
    return verified(manifest_files, found).unionByName(failed).unionByName(crossing.select("name", F.concat(F.lit("splits: "), F.array_join("s", ", ")).alias("problem")))


def run_manifest(files: DataFrame, lengths: DataFrame, settings: dict | None = None) -> DataFrame:
    """One row of JSON about a run: versions, settings, the input files' hashes, and the records' token lengths by split.

    lengths is a length profile: split, n, shortest, longest, total, over_limit.
    """
    spark = files.sparkSession
    known = {"python": platform.python_version(), "spark": spark.version}
    own = files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("bytes", "sha256"))))).alias("files"))
    spread = lengths.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", F.struct("longest", "n", "over_limit", "shortest", "total"))))).alias("token_lengths"))
    both = own.crossJoin(spread)  # a row each
    whole = F.struct("files", F.lit(json.dumps(settings or {}, sort_keys=True)).alias("settings"), "token_lengths", F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair]).alias("versions"))
    return both.select(F.to_json(whole).alias("json"))


def write_report(spark: SparkSession, metrics: DataFrame, records: DataFrame, path: str) -> None:
    """A small metrics table as one JSON file, and the records as Parquet."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    records.write.mode("overwrite").parquet(f"{path}/records")
