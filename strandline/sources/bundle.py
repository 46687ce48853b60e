"""Reading and writing index bundles, and text and integer path files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dictionary
from ..operators.metadata import Metadata
from ..operators.variants import VariantPaths
from ..plans.index import VISIT_COLUMNS, PathIndex
from ..plans.shared import GROUP_COLUMNS, SharedIndex

VERSION = 1
TAG = "strandline"
CODECS = {"plain": "none", "compressed": "zstd"}


def save(index: PathIndex, path: str, form: str = "compressed", metadata: Metadata | None = None) -> None:
    """Write a bundle: visits clustered by (node, off), so that row groups can be skipped by node; header and metadata beside them.

    Of a shared index the groups are written, by (node, begin), and its members, in place of the visits.
    """
    spark, codec, shared = index.spark, CODECS[form], isinstance(index, SharedIndex)
    rows, order, name = (index.groups, ("node", "begin"), "groups") if shared else (index.visits, ("node", "off"), "visits")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.mode("overwrite").option("compression", codec).parquet(f"{path}/{name}")
    if shared:
        index.members.write.mode("overwrite").option("compression", codec).parquet(f"{path}/members")
    info = {"tag": TAG, "version": VERSION, "shared": shared, "bidirectional": index.bidirectional, "tags": index.tags, "metadata": None if metadata is None else list(metadata.counts())}
    parts = {} if metadata is None else {"path_names": metadata.path_names, "samples": metadata.samples, "contigs": metadata.contigs}
    info["parts"] = [name for name, df in parts.items() if df is not None]
    for name in info["parts"]:
        parts[name].write.mode("overwrite").option("compression", codec).parquet(f"{path}/{name}")
    head = spark.createDataFrame([(json.dumps(info),)], "info string")
    head.coalesce(1).write.mode("overwrite").parquet(f"{path}/header")


def load(spark: SparkSession, path: str) -> tuple[PathIndex, Metadata | None]:
    """Read a bundle; a foreign tag or version, or missing columns, is an error."""
    info = json.loads(spark.read.parquet(f"{path}/header").first()["info"])
    if info.get("tag") != TAG or not 1 <= info.get("version", 0) <= VERSION:
        raise ValueError("not a bundle of a known version")
    shared = info.get("shared", False)
    visits = spark.read.parquet(f"{path}/groups" if shared else f"{path}/visits")
    if set(visits.columns) != set(GROUP_COLUMNS if shared else VISIT_COLUMNS):
        raise ValueError("the visits have other columns")
    meta = None
    if info["metadata"] is not None:
        part = lambda name: spark.read.parquet(f"{path}/{name}") if name in info["parts"] else None
        meta = Metadata(*info["metadata"], part("path_names"), part("samples"), part("contigs"))
    if shared:
        return SharedIndex(visits, spark.read.parquet(f"{path}/members"), info["tags"], meta), meta
    return PathIndex(visits, info["bidirectional"], info["tags"], meta), meta


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(part, bytes) of a written bundle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    part = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(part.alias("part")).agg(F.sum("length").alias("bytes"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line, value) -> (path_id, path): comma-separated node ids; a trailing comma is ignored, a blank line is an empty path.

    An empty token within a line is an error, as is one that is no number.
    """
    text = F.regexp_replace(F.trim("value"), ",$", "")
    path = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(text, ","), lambda x: F.trim(x).cast("long")))
    return lines.select(F.col("line").alias("path_id"), path.alias("path"))


def read_text_paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a text file, one a line, numbered in its order; of a folder, file after file by name.

    Spark deals splits out by size, so a line's number is its place in its split plus the lines of the splits before it.
    """
    split = ["file_path", "file_block_start"]
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"), *[F.col(f"_metadata.{c}") for c in split])
    parts = lines.groupBy(*split).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*split, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))  # a row for each split
    numbered = lines.join(F.broadcast(starts), split)
    return parse_lines(numbered.select((F.col("at") + F.col("shift")).alias("line"), "value"))


def read_rows(spark: SparkSession, path: str, skip_empty: bool = False) -> DataFrame:
    rows = spark.read.text(path)
    return rows.filter(F.length("value") > 0) if skip_empty else rows


def split_integers(values: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(i, node) -> (path_id, path): a flat sequence cut at its zeros; a tail without one is a path too.

    Zeros are counted by blocks of positions, so that no window spans the input.
    """
    marked = values.withColumn("blk", F.floor(F.col("i") / block)).withColumn("zero", (F.col("node") == 0).cast("long"))
    per_block = marked.groupBy("blk").agg(F.sum("zero").alias("n"))
    before = per_block.select("blk", F.coalesce(F.sum("n").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each block
    inside = F.coalesce(F.sum("zero").over(Window.partitionBy("blk").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = marked.withColumn("inside", inside).join(F.broadcast(before), "blk").withColumn("path_id", F.col("base") + F.col("inside"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("node") != 0, F.struct("i", "node"))))
    return numbered.groupBy("path_id").agg(F.transform(ordered, lambda x: x["node"]).alias("path"))


def start_offsets(values: DataFrame) -> DataFrame:
    """(i): where sequences begin in a flat sequence: at 0 and after each zero but the last position."""
    last = values.agg(F.max("i").alias("last"))
    after = values.filter("node = 0").crossJoin(F.broadcast(last)).filter("i < last").select((F.col("i") + 1).alias("i"))  # one row
    return values.filter("i = 0").select("i").unionByName(after)


def write_strings(strings: DataFrame, path: str, even_only: bool = False, form: str = "compressed") -> None:
    out = dictionary.even_only(strings) if even_only else strings
    out.write.mode("overwrite").option("compression", CODECS[form]).parquet(path)


def read_strings(spark: SparkSession, path: str, duplicate=None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if duplicate is None else dictionary.duplicated(out, duplicate)


def save_variants(v: VariantPaths, path: str, phasings: DataFrame | None = None, form: str = "compressed") -> None:
    """Write the tables of a contig, and phasings as a table partitioned by file."""
    for name in ("reference", "sites", "alleles"):
        getattr(v, name).write.mode("overwrite").option("compression", CODECS[form]).parquet(f"{path}/{name}")
    if phasings is not None:
        append_phasings(phasings, f"{path}/phasings")


def load_variants(spark: SparkSession, path: str) -> VariantPaths:
    """Read the tables of a contig; sites that are out of order or beyond the reference, and alleles of no site, are an error."""
    v = VariantPaths(*(spark.read.parquet(f"{path}/{name}") for name in ("reference", "sites", "alleles")))
    size = v.reference.count()
    late = v.sites.select((F.col("site") + 1).alias("site"), F.col("ref_start").alias("before"))
    wrong = v.sites.join(late, "site", "left").filter((F.col("ref_start") > F.col("ref_end")) | (F.col("ref_end") > size) | (F.col("before") > F.col("ref_start")))
    if wrong.limit(1).count() or v.alleles.join(v.sites, "site", "left_anti").limit(1).count():
        raise ValueError("the variants contradict their reference")
    return v


def append_phasings(phasings: DataFrame, path: str) -> None:
    """Append to a table partitioned by file, so that reading a subset of files prunes."""
    phasings.write.mode("append").partitionBy("file").parquet(path)


def read_phasings(spark: SparkSession, path: str, files: list | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if files is None else out.filter(F.col("file").isin(files))
