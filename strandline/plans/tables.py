"""Cutting lineage, and numbering and counting rows without a task that holds a whole group."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Positions per block of a group's order.
BLOCK = 1 << 16
#: Groups up to which a number for each is sent to all tasks, so that rows aren't shuffled to meet it.
FEW_GROUPS = 1 << 20
#: Setting by which Spark removes a query's shuffle files when the query is done, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCOPES = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` or the context's; a local master may do with a temporary one."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="strandline-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder by whatever file system it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, *cluster: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later reads survive lost executors, don't recompute, and
    keep column pruning, filter pushdown and statistics, which a checkpointed RDD would lose.

    ``cluster`` sorts it globally, so that row groups can be skipped by those columns. ``forget`` deletes the table. As later reads take the
    table, the shuffle files that made it are removed at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    laid = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster) if cluster else df
    with released(spark):
        laid.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    if scopes := getattr(_SCOPES, "open", None):
        scopes[-1].append(out)
    return out


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


@contextmanager
def passing() -> Iterator[None]:
    """Tables that this thread cuts in here are deleted at the end, but for those that are ``kept``."""
    _SCOPES.open = [*getattr(_SCOPES, "open", []), []]
    try:
        yield
    finally:
        forget(*_SCOPES.open.pop())


def kept(df: DataFrame) -> DataFrame:
    """A table that ``cut`` wrote, which is read after the ``passing`` scope that it was made in."""
    for scope in getattr(_SCOPES, "open", []):
        scope[:] = [other for other in scope if other is not df]
    return df


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing reads any more."""
    for df in tables:
        kept(df)
        delete_path(df.sparkSession, df.cut_path)


def placed(df: DataFrame, keys: list[str], name: str, keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with each row's place in the order of ``keys``, without sorting the rows in one task; ties in any order.

    Rows are range-partitioned and sorted within each range; a row's number is its place there plus the
    sizes of the ranges before it, of which there are as many as partitions.
    """
    cols = keep or df.columns
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut(rows.select(*cols, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))  # one row a partition
    return rows.join(F.broadcast(starts), "_part").select(*cols, (F.col("_start") + F.col("_at")).alias(name))


def dense_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the distinct ``keys`` from 0 in their order."""
    return placed(df.select(*keys).distinct(), keys, name)


def places_within(df: DataFrame, group: str, order: list[str], name: str, keep: list[str] | None = None, leads: bool = False) -> DataFrame:
    """``df``, or its columns ``keep``, with each row's place within its group; a group of any size is spread over the ranges of the order.

    ``leads`` says that the order has the groups one after the other by itself, so that the group isn't compared.
    """
    cols = keep or df.columns
    rows = placed(df, order if leads else [group, *order], "_place", cols)
    first = cut(rows.groupBy(group).agg(F.min("_place").alias("_first")))
    first = F.broadcast(first) if first.count() <= FEW_GROUPS else first
    return rows.join(first, group).select(*cols, (F.col("_place") - F.col("_first")).alias(name))


def sums_within(df: DataFrame, group: list[str], at: str, ties: list, value: Column, name: str, last: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over its group's rows up to and including each, by ``at`` (a whole number) and ``ties``.

    Sums run within blocks of ``at``; a window over the blocks, not the rows, of a group adds the blocks before. Where ``last``, a bound of
    ``at`` from 0 on, is within the first block, there is nothing to add.
    """
    if last is not None and last < BLOCK:
        upto = Window.partitionBy(*group).orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.sum(value.cast("long")).over(upto))
    block = F.floor(F.col(at) / BLOCK)
    rows = df.withColumn("_block", block).withColumn("_value", value.cast("long"))
    totals = rows.groupBy(*group, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_block").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_inside", F.sum("_value").over(inside)).join(bases, [*group, "_block"]).select(*df.columns, (F.col("_base") + F.col("_inside")).alias(name))


def as_of(points: DataFrame, samples: DataFrame, group: list[str], at: str, values: list[str], name: str = "met", last: int | None = None) -> DataFrame:
    """``points`` with the struct ``name`` (at, *values) of their group's last sample at or before them; null without one.

    One sweep in blocks of ``at`` (a whole number), and a window over the blocks, not the rows, of a group for what lies further back; none
    of it where ``last``, a bound of ``at`` from 0 on, is within the first block.
    """
    value = F.struct(F.col(at).alias("at"), *values)
    block = F.floor(F.col(at) / BLOCK).alias("_block")
    told = samples.select(*group, at, block, value.alias("_value"), F.lit(0).alias("_asks"))
    asks = points.select("*", block, F.lit(1).alias("_asks"))
    rows = asks.unionByName(told, allowMissingColumns=True)
    if last is not None and last < BLOCK:
        upto = Window.partitionBy(*group).orderBy(at, "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn(name, F.last("_value", ignorenulls=True).over(upto)).filter("_asks = 1").select(*points.columns, name)
    lasts = told.groupBy(*group, "_block").agg(F.max_by("_value", at).alias("_last"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.select(*group, "_block").distinct().join(lasts, [*group, "_block"], "left").select(*group, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_base"))
    bases = bases.filter("_base is not null")
    inside = Window.partitionBy(*group, "_block").orderBy(at, "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumn("_near", F.last("_value", ignorenulls=True).over(inside)).filter("_asks = 1")
    return swept.join(bases, [*group, "_block"], "left").select(*points.columns, F.coalesce("_near", "_base").alias(name))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (compared, differing): the rows of ``a``, and the distinct rows that one of two tables has more often."""
    rows = a.withColumn("_one", F.lit(1)).unionAll(b.select(*a.columns).withColumn("_one", F.lit(-1)))
    sums = rows.groupBy(*a.columns).agg(F.count_if(F.col("_one") == 1).alias("n"), F.sum("_one").alias("more"))
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"), F.count_if(F.col("more") != 0).alias("differing"))
