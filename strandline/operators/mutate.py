"""Construction, insertion, removal, merging and splitting of indexes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.index import PREFIX_LIMIT, PathIndex, both_orientations, build_visits, link_visits, offsets_by_prefix
from ..plans.tables import cut, dense_ids, places_within, sums_within
from .search import WORD, before_source, full_lf, named


def insert(index: PathIndex, paths: DataFrame, both: bool | None = None) -> PathIndex:
    """Append (path_id, path), whose ids are dense from 0; forward-only paths make the index one-directional for good.

    The new paths are indexed by themselves and merged.
    """
    both = index.bidirectional if both is None else both
    return merge(index, PathIndex(cut(PathIndex.from_paths(paths, both).visits), index.bidirectional and both))


#: How many times as large as the rest together the largest index may be for the visits of all to be sorted at once.
COMPARABLE = 8


def sorted_at_once(indexes: list[PathIndex]) -> bool:
    """Whether one sort of the prefixes of all is cheaper than sweeps over the largest: paths are short and no index is much larger than the rest."""
    sizes = [i.extent[1] for i in indexes]
    return max(i.longest for i in indexes) <= PREFIX_LIMIT and max(sizes) <= COMPARABLE * (sum(sizes) - max(sizes))


def appended(indexes: list[PathIndex]) -> DataFrame:
    """(seq_id, path) of all indexes, one after the other."""
    out, shift = [], 0
    for one in indexes:
        out.append(one.paths.select((F.col("seq_id") + shift).alias("seq_id"), "path"))
        shift += one.extent[0]
    return reduce(DataFrame.unionAll, out)


def rank_array(index: PathIndex, other: PathIndex) -> DataFrame:
    """(seq_id, pos, node, off, at) of the visits of ``other``: how many visits that ``index`` has of the node come before each.

    Where one sort is cheaper (``sorted_at_once``), it is a visit's place among those of both less its place among its own.
    Otherwise the ranks come from sweeps (``swept_ranks``).
    """
    if not sorted_at_once([index, other]):
        return swept_ranks(index, other)
    n = index.extent[0]
    places = offsets_by_prefix(cut(appended([index, other]))).filter(F.col("seq_id") >= n)
    places = places.select((F.col("seq_id") - n).alias("seq_id"), "pos", F.col("off").alias("place"))
    return other.visits.select("seq_id", "pos", "node", "off").join(places, ["seq_id", "pos"]).select("seq_id", "pos", "node", "off", (F.col("place") - F.col("off")).alias("at"))


def swept_ranks(index: PathIndex, other: PathIndex) -> DataFrame:
    """``rank_array`` by sweeps.

    Where a visit of node u stands at i, its successor v stands behind all visits of v from smaller nodes than u and those from u below i.
    So along a word that follows u the place is c + (visits of u below i that are followed by the word), where c is the place that
    i = 0 leads to; without the word in ``index``, c alone. Words are doubled: c of a double word is the place that the first
    half's c leads to along the second half, and places known for the first 2^k positions give those of the next 2^k. That is
    one sweep a doubling over the visits of ``index`` that are followed by a word which ``other`` has; nothing is ranked again.
    """
    n = index.extent[0]
    own = other.visits.select("seq_id", "pos", "node", "off", "next")
    longest = other.longest
    ranks = cut(own.filter("pos = 0").select("seq_id", "pos", F.lit(n).cast("long").alias("at")))
    if longest:
        word = named(F.col("next"))
        steps = own.filter("next <> 0")
        bases = before_source(index, steps.select(F.col("node").alias("src"), F.col("next").alias("dst")).distinct())
        words = cut(steps.join(bases.withColumnsRenamed({"src": "node", "dst": "next"}), ["node", "next"]).select("seq_id", "pos", "node", *word, F.col("less").alias("c")))
        met = index.visits.filter("next <> 0").select("seq_id", "pos", "node", "off", *word)
        met = cut(met.join(words.select("node", *WORD).distinct(), ["node", *WORD], "left_semi"))
    step = 1
    while step <= longest:
        onward = ranks.join(words, ["seq_id", "pos"]).select("seq_id", F.lit(0).alias("level"), (F.col("pos") + step).alias("pos"), "node", *WORD, F.lit(None).cast("long").alias("v1"), F.lit(None).cast("long").alias("v2"), "at", F.col("c"), F.lit(None).cast("long").alias("u"))
        second = words.select("seq_id", (F.col("pos") - step).alias("pos"), F.col("node").alias("m"), F.col("w1").alias("m1"), F.col("w2").alias("m2"), F.col("c").alias("mc"))
        double = words.join(second, ["seq_id", "pos"]).select("seq_id", F.lit(1).alias("level"), "pos", F.col("m").alias("node"), F.col("m1").alias("w1"), F.col("m2").alias("w2"), *_renamed(named(F.col("w1"), F.col("w2"), F.col("m1"), F.col("m2"))), F.col("c").alias("at"), F.col("mc").alias("c"), F.col("node").alias("u"))
        points = onward.unionByName(double)
        seen = met.select("node", *WORD, F.col("off").alias("at"), F.lit(1).alias("seen"))
        swept = sums_within(points.withColumn("seen", F.lit(0)).unionByName(seen, allowMissingColumns=True), ["node", *WORD], "at", ["seen"], F.col("seen"), "below", max(n, index.largest)).filter("seen = 0")
        swept = cut(swept.select("seq_id", "pos", "level", F.col("u").alias("node"), F.col("v1").alias("w1"), F.col("v2").alias("w2"), (F.col("c") + F.col("below")).alias("to")))
        known = swept.filter("level = 0").select("seq_id", "pos", F.col("to").alias("at"))
        ranks = ranks.unionAll(known)
        words = swept.filter("level = 1").select("seq_id", "pos", "node", *WORD, F.col("to").alias("c"))
        step *= 2
        if step <= longest:
            half = step // 2
            behind = met.select("seq_id", (F.col("pos") - half).alias("pos"), F.col("w1").alias("m1"), F.col("w2").alias("m2"))
            doubled = met.join(behind, ["seq_id", "pos"]).select("seq_id", "pos", "node", "off", *named(F.col("w1"), F.col("w2"), F.col("m1"), F.col("m2")))
            met = cut(doubled.join(words.select("node", *WORD).distinct(), ["node", *WORD], "left_semi"))
    return own.join(ranks, ["seq_id", "pos"]).select("seq_id", "pos", "node", "off", "at")


def _renamed(names: list[Column]) -> list[Column]:
    return [c.alias(f"v{i + 1}") for i, c in enumerate(names)]


def _interleaved(index: PathIndex, points: DataFrame, n: int) -> DataFrame:
    """(seq_id, pos, node, off) of both indexes, by the rank array ``points`` of the second one, whose sequences follow the ``n`` of the first.

    A visit of the first one moves up by the new ones before it, one of the second stands behind its own predecessors and the old ones.
    """
    late = points.select((F.col("seq_id") + n).alias("seq_id"), "pos", "node", F.when(F.col("node") == 0, F.col("off") + n).otherwise(F.col("at") + F.col("off")).alias("off"))
    old = index.visits.select("seq_id", "pos", "node", F.col("off").alias("at"), F.lit(1).alias("_old"))
    rows = old.unionByName(points.filter("node <> 0").select("seq_id", "pos", "node", "at", F.lit(0).alias("_old")))
    moved = sums_within(rows, ["node"], "at", ["_old"], 1 - F.col("_old"), "before", max(n, index.largest)).filter("_old = 1")
    return moved.select("seq_id", "pos", "node", (F.col("at") + F.col("before")).alias("off")).unionByName(late)


def merge(index: PathIndex, other: PathIndex) -> PathIndex:
    """Append all sequences of another index: by one sort of the prefixes of both where that is cheaper, else by the rank array, where the visits of
    both keep their order and are interleaved once."""
    if sorted_at_once([index, other]):
        visits = build_visits(appended([index, other]), "prefix")
    else:
        points = cut(swept_ranks(index, other))
        visits = link_visits(cut(_interleaved(index, points, index.extent[0])), max(index.longest, other.longest))
    return PathIndex(visits, index.bidirectional and other.bidirectional, index.tags, index.metadata)


def merge_all(indexes: list[PathIndex]) -> PathIndex:
    """Append the sequences of all indexes in their order: by one sort of all where that is cheaper, else pair by pair, so that each visit is moved as
    often as the list can be halved."""
    if len(indexes) > 2 and sorted_at_once(indexes):
        return PathIndex(build_visits(appended(indexes), "prefix"), all(i.bidirectional for i in indexes), indexes[0].tags, indexes[0].metadata)
    while len(indexes) > 1:
        pairs = [indexes[i : i + 2] for i in range(0, len(indexes), 2)]
        indexes = [PathIndex(cut((joined := merge(*p)).visits), joined.bidirectional, joined.tags, joined.metadata) if len(p) == 2 else p[0] for p in pairs]
    return indexes[0]


def insertion_points(index: PathIndex, new: DataFrame) -> DataFrame:
    """(seq_id, pos, node, at) of new sequences (seq_id, path): how many visits of the node that the index has come before each new one.

    All sequences step along their paths together: from the place among a node's visits follows the place among its successor's
    (``full_lf``), so there are as many steps as the longest path has nodes. Nothing that the index has is ranked again.
    """
    n = index.visits.filter("pos = 0").count()
    new = cut(new.select("seq_id", "path"))
    now = cut(new.select("seq_id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("node"), F.lit(n).cast("long").alias("at")))
    out, pos = now, 0
    while True:
        step = now.join(new, "seq_id").filter(F.size("path") > pos).select("seq_id", "node", F.col("at").alias("off"), F.get("path", F.lit(pos)).alias("to"))
        moved = full_lf(index, step.select("node", "off", "to").distinct())
        now = cut(step.join(moved, ["node", "off", "to"]).select("seq_id", F.lit(pos + 1).cast("long").alias("pos"), F.col("to").alias("node"), F.col("target").alias("at")))
        if not now.limit(1).count():
            return out
        out, pos = out.unionByName(now), pos + 1


def insert_by_steps(index: PathIndex, paths: DataFrame, both: bool | None = None) -> PathIndex:
    """As ``insert``, for few and short paths: old visits keep their order and only move up by the new ones before them.

    The new sequences are ranked among themselves; a new visit stands behind the old ones at its insertion point and the new
    ones that are smaller, an old one behind the new ones inserted no later.
    """
    both = index.bidirectional if both is None else both
    new = both_orientations(paths) if both else paths.select(F.col("path_id").alias("seq_id"), "path")
    first = index.visits.filter("pos = 0").count()
    points = cut(insertion_points(index, new.select((F.col("seq_id") + first).alias("seq_id"), "path")).withColumn("seq_id", F.col("seq_id") - first))
    own = build_visits(new).select("seq_id", "pos", "node", "off")
    points = cut(points.join(own, ["seq_id", "pos", "node"]).select("seq_id", "pos", "node", "off", "at"))
    return PathIndex(link_visits(cut(_interleaved(index, points, first))), index.bidirectional and both, index.tags, index.metadata)


def shared_nodes(one: PathIndex, other: PathIndex) -> DataFrame:
    """Real nodes that both indexes visit."""
    nodes = lambda i: i.node_sizes.filter("node <> 0").select("node")
    return nodes(one).join(nodes(other), "node", "left_semi")


def merge_disjoint(indexes: list[PathIndex]) -> PathIndex:
    """Merge indexes without common nodes, which is counted once over all of them: ranks stay, only sequence ids and start rows move. Tags are dropped."""
    nodes = reduce(DataFrame.unionAll, [one.node_sizes.filter("node <> 0").select("node") for one in indexes])
    if nodes.groupBy("node").count().filter("count > 1").limit(1).count():
        raise ValueError("the indexes share nodes")
    out, shift = None, 0
    for one in indexes:
        moved = one.visits.select(
            "node", F.when(F.col("node") == 0, F.col("off") + shift).otherwise(F.col("off")).alias("off"), (F.col("seq_id") + shift).alias("seq_id"), "pos",
            "next", "next_off", "prev", F.when(F.col("prev") == 0, F.col("prev_off") + shift).otherwise(F.col("prev_off")).alias("prev_off"),
        )
        out = moved if out is None else out.unionByName(moved)
        shift += one.visits.filter("pos = 0").count()
    return PathIndex(out, all(i.bidirectional for i in indexes))


def _renumbered(visits: DataFrame, ids: DataFrame) -> DataFrame:
    """Survivors (seq_id -> new_id) with their new ids and offsets; they keep their order, so nothing is re-ranked by prefix."""
    kept = visits.join(ids, "seq_id")
    order = F.when(F.col("node") == 0, F.col("new_id")).otherwise(F.col("off"))
    kept = places_within(kept.select(F.col("new_id").alias("seq_id"), "pos", "node", "next", "prev", order.alias("_order")), "node", ["_order"], "_off")
    ranked = kept.select("seq_id", "pos", "node", F.when(F.col("node") == 0, F.col("seq_id")).otherwise(F.col("_off")).alias("off"), "next", "prev")
    along = Window.partitionBy("seq_id").orderBy("pos")
    return ranked.select("node", "off", "seq_id", "pos", "next", F.lead("off").over(along).alias("next_off"), "prev", F.lag("off").over(along).alias("prev_off"))


def remove(index: PathIndex, ids: DataFrame) -> tuple[PathIndex, DataFrame]:
    """Remove (id): path ids, in both orientations, if the index is bidirectional, else sequence ids.

    Returns the new index and one row (removed): the removed visits with their endmarkers. An invalid id means that nothing is removed.
    """
    seqs = index.visits.filter("pos = 0").select("seq_id")
    wanted = ids.select("id").distinct()
    if index.bidirectional:
        wanted = wanted.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("seq_id"))
    else:
        wanted = wanted.select(F.col("id").alias("seq_id"))
    if wanted.join(seqs, "seq_id", "left_anti").limit(1).count():
        return index, index.spark.range(1).select(F.lit(0).cast("long").alias("removed"))
    left = dense_ids(seqs.join(wanted, "seq_id", "left_anti"), ["seq_id"], "new_id")
    removed = index.visits.join(wanted, "seq_id", "left_semi").agg(F.count(F.lit(1)).alias("removed"))
    return PathIndex(_renumbered(index.visits, left), index.bidirectional, index.tags, index.metadata), removed


def split(index: PathIndex, mapping: DataFrame) -> DataFrame:
    """(subgraph, *visits): each sequence goes to the subgraph that ``mapping`` (node_id, subgraph) gives its first node.

    Order is kept, ids are dense in each subgraph, empty and unmapped sequences are dropped. The mapping
    must keep connected nodes together; then the offsets of real nodes stay as they are.
    """
    first = index.visits.filter("pos = 0 and next <> 0").select("seq_id", F.shiftright("next", 1).alias("node_id")).join(mapping, "node_id").select("seq_id", "subgraph")
    ids = places_within(first, "subgraph", ["seq_id"], "new_id")
    kept = index.visits.join(ids, "seq_id")
    start = lambda node, off: F.when(F.col(node) == 0, F.col("new_id")).otherwise(F.col(off)).alias(off)
    return kept.select("subgraph", "node", start("node", "off"), F.col("new_id").alias("seq_id"), "pos", "next", "next_off", "prev", start("prev", "prev_off"))


def split_indexes(index: PathIndex, mapping: DataFrame, subgraphs: list) -> list[PathIndex]:
    parts = split(index, mapping)
    return [PathIndex(parts.filter(F.col("subgraph") == s).drop("subgraph"), index.bidirectional) for s in subgraphs]


def partition_range(first: int, last: int, blocks: int) -> list[tuple[int, int]]:
    """Near-even split of a closed range; at most as many blocks as values."""
    length = max(0, last - first + 1)
    blocks = max(1, min(blocks, length))
    bounds = [first + length * i // blocks for i in range(blocks + 1)]
    return [(a, b - 1) for a, b in zip(bounds, bounds[1:])] if length else []


def partition_ranges(ranges: DataFrame, blocks: int) -> DataFrame:
    """Ranges (..., first, last) each split near-evenly (``partition_range``): a row for each ``block``."""
    size = F.col("last") - F.col("first") + 1
    n = F.least(F.lit(blocks).cast("long"), size)
    each = ranges.withColumn("_n", n).withColumn("_size", size).withColumn("block", F.explode(F.when(F.col("_size") > 0, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))))
    at = lambda i: F.col("first") + F.floor(F.col("_size") * i / F.col("_n"))
    return each.select(*[c for c in ranges.columns if c not in ("first", "last")], "block", at(F.col("block")).alias("first"), (at(F.col("block") + 1) - 1).alias("last"))


@dataclass
class MergeParameters:
    """Settings that the callers of merges pass along. Spark sizes its own buffers, so they are only kept within bounds."""

    jobs: int = 4
    buffer_mb: int = 64

    def __post_init__(self):
        self.jobs = min(max(self.jobs, 1), 64)
        self.buffer_mb = min(max(self.buffer_mb, 1), 4096)
