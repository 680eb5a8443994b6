"""Line dedup by distinct-site spread.

Each line hash gets a HyperLogLog sketch of the sites it stands on; sketches
merge by aggregation. Lines whose estimate is near the threshold get an exact
distinct count. Lines on enough sites are boilerplate: they go from every
document but the first that has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import WHITESPACE, arrow_map, free, parts, utf8, written

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: HyperLogLog registers (log2): a standard error of 3.3%.
LOG2_REGISTERS = 10
#: Estimates within this fraction of the threshold are counted exactly: 4.5 standard errors.
NEAR = 0.15

_SPACE = WHITESPACE.decode()


def line_hashes(text: Column) -> Column:
    """Arrays of (a, b), a 128-bit hash of each line with a word, without the spaces around it."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACE))), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))


def _int_seed() -> int:
    """The seed that xxhash64(lit(1), x) hashes x with: the hash of the int 1."""
    seed = xxhash.xxh64_intdigest
    return seed((1).to_bytes(4, "little"), 42)


def line_spread(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, first, sites) of the lines on at least min_sites sites; first: the least id that has the line; sites: null if only estimated."""
    lines = docs.select(F.col(id_col).alias("id"), F.col(site_col).alias("site"), F.explode(line_hashes(F.col(text_col))).alias("h")).select("id", "site", "h.a", "h.b")
    sketches = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", LOG2_REGISTERS).alias("sketch"), F.min("id").alias("first"))
    estimates = sketches.select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites * (1 - NEAR))
    spread = written(estimates, "spread")
    near = spread.where(F.col("estimate") <= min_sites * (1 + NEAR)).select("a", "b")
    exact = lines.join(near, ["a", "b"]).groupBy("a", "b").agg(F.count_distinct("site").alias("sites"))
    return spread.join(exact, ["a", "b"], "left").where(F.coalesce("sites", F.lit(min_sites)) >= min_sites).select("a", "b", "first", "sites")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with text_col less its boilerplate lines, and n_lines and n_removed (long).

    A line is compared without the spaces around it; lines without words stay.
    The document with the least id keeps a boilerplate line, so no line is lost
    from the corpus, and so do all rows of that id if it repeats; a null id is
    never the first. Null sites aren't sites. A null text stays null with no lines;
    a text may become empty. Repeated rows give equal results. docs may be empty;
    its other columns are carried, whatever their names, but n_lines and n_removed
    are replaced. A line on exactly min_sites sites goes; a long text is one row of
    its own in Python, and its lines are hashed in the JVM.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    site = F.col(site_col) if isinstance(docs.schema[site_col].dataType, (T.StringType, T.LongType, T.IntegerType)) else F.col(site_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), site.alias("site"), F.xxhash64(text_col).alias("row"))
    boilerplate = written(line_spread(source, "id", "text", "site", min_sites), "boilerplate")
    # rows that share an id, or have none, are told apart by their texts' hashes, so that no group gathers more than a text's lines
    lines = source.select("id", "row", F.explode(F.array_distinct(line_hashes(F.col("text")))).alias("h")).select("id", "row", "h.a", "h.b")
    hits = lines.join(boilerplate, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("first")))
    of, row, gone = free("of", *kept), free("row", *kept), free("gone", *kept)
    removals = hits.groupBy(F.col("id").alias(of), F.col("row").alias(row)).agg(F.collect_set(F.struct("a", "b")).alias(gone))
    names = [f"c{i}" for i in range(len(kept))]
    joined = docs.select(*kept).join(removals, F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text_col) == F.col(row)), "left").select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], F.col(f"{gone}.a").alias("a"), F.col(f"{gone}.b").alias("b"))
    at, seed = kept.index(text_col), _int_seed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = (lambda x: xxhash.xxh64_intdigest(x, 42)), (lambda x: xxhash.xxh64_intdigest(x, seed))
        for batch in (part for whole in batches for part in parts(whole, at)):
            texts, n_lines, n_removed = [], [], []
            for text, a, b in zip(utf8(batch.column(at)), batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True):
                lines = text.split(b"\n") if text is not None else []
                n_lines.append(len(lines))
                if a:
                    gone = {(x % 2**64, y % 2**64) for x, y in zip(a, b, strict=True)}
                    stay = [x for x in lines if not (s := x.strip(WHITESPACE)) or (first(s), second(s)) not in gone]
                    texts.append(b"\n".join(stay))
                    n_removed.append(len(lines) - len(stay))
                else:
                    texts.append(text)
                    n_removed.append(0)
            columns = [batch.column(i) for i in range(len(kept))]
            columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "n_lines", "n_removed"])

    kinds = [T.StructField(n, docs.schema[c].dataType) for c, n in zip(kept, names, strict=True)]
    schema = T.StructType([*kinds, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return arrow_map(joined, run, schema).toDF(*kept, "n_lines", "n_removed")
