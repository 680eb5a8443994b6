"""Scans with explicit schemas. Spark's readers only, so inputs may be in any store."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import time
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.tables import settled
from corpusmill.sources import folders

TURN = "struct<message:string,context_slots:map<string,string>,last_assistant_question:string,gold_extraction:struct<intent:string,intent_confidence:double,updates:array<struct<slot_id:string,candidate_value:string,status:string,confidence:double,evidence_text:string>>,correction_detected:boolean,unsupported_claims:array<string>>>"
SCENARIO = f"scenario_id string, corpus_version string, schema_version string, split string, category string, domain string, behavior_tags array<string>, turns array<{TURN}>, gold_intent string, gold_final_slots map<string,string>, expected_question_slot string, ideal_question string, must_not_infer array<string>"
RECORD = "prompt array<struct<role:string,content:string>>, completion array<struct<role:string,content:string>>, messages array<struct<role:string,content:string>>, metadata map<string,string>"
CASE = "id string, prompt string, category string, expected_behavior string, must_contain array<string>, must_contain_any array<string>, must_not_contain array<string>, max_question_marks int, max_numbered_items int"
CONVERSATION_CASE = "case_id string, messages array<string>, expected_intent string, expected_final_slots map<string,string>, forbidden_assistant_terms array<string>"


def jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON Lines; blank lines are skipped, and lines that aren't JSON are kept in _corrupt_record."""
    kinds = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    return spark.read.schema(kinds).option("mode", "PERMISSIVE").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def named_splits(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """JSON Lines files as one table with their split's name; lines that aren't JSON are kept in _corrupt_record."""
    out = None
    for split, path in paths.items():
        part = jsonl(spark, path, schema).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) lines key=value: without blanks, comments and lines without =; keys in lower case, quotes stripped."""
    line = F.trim("value")
    parts = F.split(line, "=", 2)
    kept = spark.read.text(path).where((line != "") & ~line.startswith("#") & F.contains(line, F.lit("=")))
    return kept.select(F.lower(F.trim(parts[0])).alias("key"), F.btrim(F.trim(parts[1]), F.lit("\"'")).alias("value"))


#: Bytes of a file in memory at once.
BLOCK = 1 << 23


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store, as Spark reads it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString()


def _read_by_tasks(path: str) -> bool:
    return path.partition(":")[0] in folders.STORES


def listing(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """(path, name, is_dir, bytes) of what a folder holds, with deep of all below it too; none if there is no such folder.

    Tasks list, a folder just below the root each; only in stores that pyarrow
    doesn't read Spark's file system does, on the driver.
    """
    path = qualified(spark, path)
    if _read_by_tasks(path):
        spark.dataSource.register(folders.Folder)
        return spark.read.format("folder").options(paths=json.dumps([path]), deep=str(deep).lower()).load()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found, left = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), [], [where]
    while left:
        here = left.pop()
        for f in files.listStatus(here) if files.exists(here) else []:
            found.append((f.getPath().toString(), f.getPath().getName(), f.isDirectory(), None if f.isDirectory() else f.getLen()))
            if deep and f.isDirectory():
                left.append(f.getPath())
    return spark.createDataFrame(found, "path string, name string, is_dir boolean, bytes long")


def streamed_sha256(path: str, block: int = BLOCK) -> str:
    """A file's SHA-256, block by block."""
    files, name = folders.opened(path)
    digest = hashlib.sha256()
    with files.open_input_stream(name, compression=None) as stream:
        while part := stream.read(block):
            digest.update(part)
    return digest.hexdigest()


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, bytes, sha256) of the files whose names fit the pattern, in a folder and below it; hidden ones (._) don't count.

    Files are dealt by size, and a task streams its own, so no file is a row,
    whatever its size. Only in stores that pyarrow doesn't read a file is a row of
    its content, of 2 GB at most, and empty ones aren't seen.
    """
    if not _read_by_tasks(qualified(spark, path)):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
        return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    named = listing(spark, path, deep=True).where(~F.col("is_dir") & F.col("name").rlike("^" + fnmatch.translate(pattern)) & ~F.col("name").rlike("^[._]")).select("path", "name", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("sha256", pa.array([streamed_sha256(x) for x in batch.column(0).to_pylist()], pa.string()))

    dealt = named.repartitionByRange(spark.sparkContext.defaultParallelism * 4, F.desc("bytes"), "path")
    return dealt.mapInArrow(run, "path string, name string, bytes long, sha256 string")


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """(path, step) of the folders checkpoint-<whole number>; files and other names don't count."""
    step = F.regexp_extract("name", r"^checkpoint-(\d+)$", 1).try_cast("long")
    return listing(spark, path).where("is_dir").select("path", step.alias("step")).where("step is not null")


def reports(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Prior reports' records: files, or folders of files, that are a JSON list each; none of those that are missing or no list.

    A task streams each file, record by record. Only in stores that pyarrow doesn't
    read a file is a row.
    """
    paths = [qualified(spark, p) for p in ([path] if isinstance(path, str) else path)]
    if all(map(_read_by_tasks, paths)):
        spark.dataSource.register(folders.JsonLists)
        values = spark.read.format("json_lists").option("paths", json.dumps(paths)).load()
        return values.select(F.from_json("value", schema).alias("r")).select("r.*").dropna(how="all")
    out = spark.createDataFrame([], schema)
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            start = spark.read.text(p).where(F.trim("value") != "").select(F.ltrim("value")).first()
            if start and start[0].startswith("["):
                out = out.unionByName(json_array(spark, p, schema).dropna(how="all"))
    return out


def _told(error: Exception) -> str:
    """An error's type, status and code, and nothing of what it says."""
    body = getattr(error, "body", None)
    parts = {"status": getattr(error, "status_code", None), "code": body.get("code") if isinstance(body, dict) else None}
    return " ".join([type(error).__name__, *[f"{k}={v}" for k, v in parts.items() if v]])


def answers(cases: DataFrame, model, schema: str) -> DataFrame:
    """Rows from a model: model(pandas frame) -> pandas frame of the schema, in batches; column error is null.

    If a batch fails, its cases are asked one by one; one that fails again is a row of
    its own columns that the schema has, nulls, and the error's type, status and code.
    """
    kinds = T.StructType.fromDDL(schema).add("error", T.StringType())
    names = [f.name for f in kinds.fields[:-1]]

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return model(frame)[names].assign(error=None)
        except Exception as error:  # noqa: BLE001  whatever an endpoint raises is a row
            if len(frame) > 1:
                return pd.concat([ask(frame.iloc[i : i + 1]) for i in range(len(frame))], ignore_index=True)
            return pd.DataFrame({n: frame[n].tolist() if n in frame else [None] for n in names}).assign(error=_told(error))

    return cases.mapInPandas(lambda frames: map(ask, frames), kinds)


def answered(cases: DataFrame, request: Sequence[str], model, schema: str, store: str, tries: int = 3, wait: float = 0.5) -> DataFrame:
    """cases with a model's answer to each: columns of the schema, and error.

    A request is its columns' content: equal ones are asked once, by their digest.
    model(pandas frame of request columns) -> pandas frame of the schema, a row for
    each row. A batch that fails is asked again after ``wait`` seconds, twice as long
    each time, then its rows one by one likewise; a row that still fails has the
    error's type, status and code. Answers are appended to the store (a Parquet
    folder), and those there aren't asked for again; failures are, by the next run.
    """
    spark = cases.sparkSession
    kinds = T.StructType.fromDDL(schema)
    names = [f.name for f in kinds.fields]
    keyed = cases.withColumn("_digest", F.sha2(F.to_json(F.struct(*request), {"ignoreNullFields": "false"}), 256))
    asked = keyed.dropDuplicates(["_digest"]).select("_digest", *request)
    kept = T.StructType([T.StructField("_digest", T.StringType()), *kinds.fields, T.StructField("error", T.StringType())])
    where = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
    known = (spark.read.schema(kept).parquet(store) if there else spark.createDataFrame([], kept)).dropDuplicates(["_digest"])

    def attempt(frame: pd.DataFrame) -> tuple[pd.DataFrame | None, Exception | None]:
        for k in range(tries):
            try:
                return model(frame[list(request)])[names].reset_index(drop=True), None
            except Exception as error:  # noqa: BLE001  whatever an endpoint raises
                last = error
                if k < tries - 1:
                    time.sleep(wait * 2**k)
        return None, last

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        found, error = attempt(frame)
        if found is not None:
            return found.assign(_digest=frame["_digest"].tolist(), error=None)
        if len(frame) > 1:
            return pd.concat([ask(frame.iloc[i : i + 1]) for i in range(len(frame))], ignore_index=True)
        return pd.DataFrame({n: [None] for n in names}).assign(_digest=frame["_digest"].tolist(), error=_told(error))

    columns = [f.name for f in kept.fields]
    fresh = settled(asked.join(known.select("_digest"), "_digest", "left_anti").mapInPandas(lambda frames: (ask(f)[columns] for f in frames if len(f)), kept), "answers")
    told = settled(known.join(asked.select("_digest"), "_digest", "left_semi"), "known")  # before the store grows
    fresh.where("error is null").write.mode("append").parquet(store)
    return keyed.join(told.unionByName(fresh), "_digest").drop("_digest")


def config(spark: SparkSession, path: str, known: dict[str, type]) -> dict:
    """A JSON object of settings; unknown keys and values of other types are errors. One small file, read on the driver."""
    found = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    if strange := sorted(set(found) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(strange)}")
    if wrong := sorted(k for k, v in found.items() if not isinstance(v, known[k])):
        raise ValueError(f"settings of another type: {', '.join(wrong)}")
    return found


def prompt_completion(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, prompt, completion) of records in either form: as they are, or all messages but the last and the last. A table may have one form only."""
    said = (F.slice("messages", 1, F.greatest(F.lit(0), F.size("messages") - 1)), F.slice("messages", -1, 1)) if "messages" in df.columns else (F.lit(None), F.lit(None))
    made = [F.coalesce(name, cut) if name in df.columns else cut for name, cut in zip(("prompt", "completion"), said, strict=True)]
    return df.select(*keep, made[0].alias("prompt"), made[1].alias("completion"))
