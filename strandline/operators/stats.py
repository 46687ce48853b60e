"""Statistics and projections of an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.index import PathIndex
from ..plans.tables import BLOCK, agreement, sums_within


def to_comp(node: Column, offset: Column | int) -> Column:
    """Node to record number: 0 stays, others are shifted down by the alphabet offset."""
    return F.when(node == 0, F.lit(0).cast("long")).otherwise(node - offset)


def to_node(comp: Column, offset: Column | int) -> Column:
    return F.when(comp == 0, F.lit(0).cast("long")).otherwise(comp + offset)


def run_counts(index: PathIndex) -> DataFrame:
    """One row: (concrete, logical)."""
    return index.runs.agg(F.count(F.lit(1)).alias("concrete")).crossJoin(index.logical_runs.agg(F.count(F.lit(1)).alias("logical")))  # one row each


def contains_node(index: PathIndex, nodes: DataFrame) -> DataFrame:
    """(node, contained): 0, or within the alphabet; a range test, so empty nodes in range count."""
    head = index.header.select("offset", "alphabet_size")
    inside = (F.col("node") == 0) & (F.col("alphabet_size") > 0) | (F.col("node") > F.col("offset")) & (F.col("node") < F.col("alphabet_size"))
    return nodes.crossJoin(F.broadcast(head)).select("node", inside.alias("contained"))  # one header row


def contains_position(index: PathIndex, positions: DataFrame) -> DataFrame:
    """The positions (node, off) that exist."""
    return positions.join(index.visits.select("node", "off"), ["node", "off"], "left_semi")


def has_edge(index: PathIndex, pairs: DataFrame) -> DataFrame:
    """(src, dst, has_edge)."""
    marked = index.edges.select("src", "dst", F.lit(True).alias("has_edge"))
    return pairs.join(marked, ["src", "dst"], "left").withColumn("has_edge", F.coalesce("has_edge", F.lit(False)))


def node_sizes(index: PathIndex) -> DataFrame:
    return index.node_sizes


def degrees(index: PathIndex) -> DataFrame:
    """(node, outdegree, indegree): distinct successors and, except at the endmarker, predecessors."""
    out = index.edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outdegree"))
    incoming = index.edges.filter("dst <> 0").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("indegree"))
    return out.join(incoming, "node", "left").select("node", "outdegree", F.coalesce("indegree", F.lit(0).cast("long")).alias("indegree"))


def incoming_counts(index: PathIndex) -> DataFrame:
    """(node, src, before, until): visits of ``node`` that come from sources before, and up to, each source."""
    order = Window.partitionBy("dst").orderBy("src")
    incoming = index.edges.filter("dst <> 0")
    until = F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return incoming.select(F.col("dst").alias("node"), "src", (until - F.col("cnt")).alias("before"), until.alias("until"))


def edge_ranks(index: PathIndex) -> DataFrame:
    """(src, dst, outrank): the place of each edge among its source's."""
    return index.edges.select("src", "dst", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("long").alias("outrank"))


def bwt_at(index: PathIndex, positions: DataFrame) -> DataFrame:
    """(node, off, symbol): the successor at each position; 0 where there is none."""
    return positions.join(index.visits.select("node", "off", "next"), ["node", "off"], "left").select("node", "off", F.coalesce("next", F.lit(0).cast("long")).alias("symbol"))


def records(index: PathIndex) -> DataFrame:
    """(node, visits, runs, outdegree): one row a record."""
    runs = index.runs.groupBy("node").agg(F.sum("len").alias("visits"), F.count(F.lit(1)).alias("runs"), F.countDistinct("successor").alias("outdegree"))
    return runs


def for_each_record(index: PathIndex, visit: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``visit(node, batches)`` gives for every record, as rows of ``schema``; ``batches`` are its visits (off, next, next_off) by offset.

    A record streams by in Arrow batches of the session's size (``spark.sql.execution.arrow.maxRecordsPerBatch``), cut at the record's ends, and
    is never in memory whole. What ``visit`` leaves unread is skipped.
    """
    rows = index.visits.select("node", "off", "next", "next_off").repartition("node").sortWithinPartitions("node", "off")
    return rows.mapInArrow(lambda batches: _each_record(batches, visit), schema)


def _each_record(batches: Iterator[pa.RecordBatch], visit) -> Iterator[pa.RecordBatch]:
    slices = (part for batch in batches for part in _by_node(batch))
    for node, parts in groupby(slices, key=lambda part: part[0]):
        yield from visit(node, (batch for _, batch in parts))


def _by_node(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    node = batch.column(0).to_numpy()
    edges = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
    for begin, end in pairwise(edges):
        if end > begin:
            yield int(node[begin]), batch.slice(begin, end - begin).select([1, 2, 3])


def summary(index: PathIndex, interval: int = 1024) -> DataFrame:
    """The numbers that describe an index, in one row."""
    samples = sampled(index, interval).agg(F.count(F.lit(1)).alias("samples"))
    return index.header.drop("bidirectional").crossJoin(run_counts(index)).crossJoin(samples)  # one row each


def sampled(index: PathIndex, interval: int) -> DataFrame:
    """(node, off, seq_id): visits at every ``interval`` steps from the start row, and the last of each path."""
    due = F.col("next") == 0
    if interval:
        due = due | ((F.col("pos") + 1) % interval == 0)
    return index.visits.filter(due).select("node", "off", "seq_id")


def unfolded(index: PathIndex) -> DataFrame:
    """(node, off, next, next_off): every record unfolded from its runs; offsets at the successor follow from the edge's start and the rank among equals."""
    start = index.edges.select(F.col("src").alias("node"), F.col("dst").alias("successor"), "rank_off")
    runs = sums_within(index.runs, ["node", "successor"], "start_off", [], F.col("len"), "upto").join(start, ["node", "successor"])
    last = F.col("len") - 1  # a long run block by block, so that no row holds all of it
    blocks = runs.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCK)))).withColumn("low", F.col("low") * BLOCK)
    each = blocks.withColumn("i", F.explode(F.sequence("low", F.least(last, F.col("low") + (BLOCK - 1)))))
    at = F.when(F.col("successor") != 0, F.col("rank_off") + F.col("upto") - F.col("len") + F.col("i"))
    return each.select("node", (F.col("start_off") + F.col("i")).alias("off"), F.col("successor").alias("next"), at.alias("next_off"))


def sample_ranges(index: PathIndex, interval: int) -> DataFrame:
    """(node, samples, first_off, last_off): where the samples of each sampled node lie."""
    own = sampled(index, interval)
    return own.groupBy("node").agg(F.count(F.lit(1)).alias("samples"), F.min("off").alias("first_off"), F.max("off").alias("last_off"))


def printed_header(index: PathIndex) -> DataFrame:
    """One row (text): the header as a line."""
    kind = F.when(F.col("bidirectional"), "bidirectional").otherwise("forward")
    return index.header.select(F.format_string("%s index: %d sequences, %d visits, nodes above %d and below %d", kind, "sequences", "size", "offset", "alphabet_size").alias("text"))


def distribution(index: PathIndex, quantiles: tuple[float, ...] = (0.9, 0.99, 0.999)) -> DataFrame:
    """(statistic, total, average, q0.., largest) of runs and outdegrees over the records, empty ones included, without the endmarker's."""
    per_node = records(index).filter("node <> 0")
    n = index.header.select((F.col("effective") - 1).alias("n"))
    values = per_node.select(F.inline(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in ("runs", "outdegree")])))
    counts = values.groupBy("statistic", "value").agg(F.count(F.lit(1)).alias("count"))
    kept = counts.groupBy("statistic").agg(F.sum("count").alias("have"))
    zeros = kept.crossJoin(F.broadcast(n)).filter("n > have").select("statistic", F.lit(0).cast("long").alias("value"), (F.col("n") - F.col("have")).alias("count"))
    every = counts.unionByName(zeros).crossJoin(F.broadcast(n))
    upto = F.sum("count").over(Window.partitionBy("statistic").orderBy("value"))
    ranked = every.withColumn("upto", upto)
    picks = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("n")), F.col("value"))).alias(f"q{i}") for i, q in enumerate(quantiles)]
    return ranked.groupBy("statistic").agg(F.sum(F.col("value") * F.col("count")).alias("total"), (F.sum(F.col("value") * F.col("count")) / F.first("n")).alias("average"), *picks, F.max("value").alias("largest"))


def differences(one: PathIndex, other: PathIndex) -> DataFrame:
    """(part, compared, differing): the rows of each table, and those that only one of two indexes has."""
    parts = {"visits": (one.visits, other.visits), "edges": (one.edges, other.edges), "header": (one.header, other.header)}
    rows = [agreement(a, b).select(F.lit(name).alias("part"), "compared", "differing") for name, (a, b) in parts.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])
