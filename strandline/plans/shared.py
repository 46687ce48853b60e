"""The path index of paths of which many are alike: equal paths are ranked once, with the number of their copies.

Copies have the same reversed prefixes, so at each node their visits follow each other within one group, in the order of their sequences. A
group's begin is all that has to be known of it; ``visits``, one row a visit, are made from that when they are first asked for.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import PREFIX_LIMIT, PathIndex, both_orientations, doubled_ranks, link_visits, node_id, prefix_keys, symbols
from .tables import cut, kept, placed, places_within, sums_within

GROUP_COLUMNS = ("word", "pos", "node", "begin", "copies")


def _begins(rows: DataFrame) -> DataFrame:
    """(node, key, begin): how many visits of a node come before those of each key."""
    ordered = placed(rows.groupBy("node", "key").agg(F.sum("copies").alias("n")), ["node", "key"], "_at")
    return sums_within(ordered, ["node"], "_at", [], F.col("n"), "_upto").select("node", "key", (F.col("_upto") - F.col("n")).alias("begin"))


def group_visits(words: DataFrame, method: str | None = None) -> DataFrame:
    """``groups`` of (word, path, copies); the method follows the longest path unless it is given."""
    own = cut(words.select(F.col("word").alias("seq_id"), "path", "copies"))
    longest = max(0, own.agg(F.max(F.size("path"))).first()[0] or 0)
    if (method or ("prefix" if longest <= PREFIX_LIMIT else "doubling")) == "prefix":
        keyed = prefix_keys(own)
    else:
        keyed = cut(symbols(own)).withColumn("key", F.lit(0))
        for _, ranked in doubled_ranks(keyed.drop("key"), longest, tied=True):
            keyed = ranked.withColumnRenamed("r", "key")
    rows = cut(keyed.join(own.select("seq_id", "copies"), "seq_id"))
    return rows.join(_begins(rows), ["node", "key"]).select(F.col("seq_id").alias("word"), "pos", "node", "begin", "copies")


class SharedIndex(PathIndex):
    """An index of ``members`` (path_id, part), of which those of one part have the same path, in both orientations: the sequences 2i and 2i + 1 of
    path i are copies of the words 2p and 2p + 1 of its part p. ``groups`` (word, pos, node, begin, copies) has a row for each visit of a word."""

    def __init__(self, groups: DataFrame, members: DataFrame, tags: dict[str, str] | None = None, metadata: object | None = None):
        self.groups, self.members = groups, members
        self.bidirectional, self.metadata, self.stored_paths = True, metadata, None
        self.tags = {"source": "strandline"} if tags is None else tags

    @classmethod
    def from_parts(cls, members: DataFrame, parts: DataFrame, method: str | None = None) -> SharedIndex:
        """From (path_id, part) and (part, path)."""
        words = both_orientations(parts, "part").select(F.col("seq_id").alias("word"), "path")
        copies = members.groupBy("part").agg(F.count(F.lit(1)).alias("copies"))
        return cls(cut(group_visits(words.withColumn("part", node_id(F.col("word"))).join(copies, "part"), method)), members)

    @property
    def spark(self) -> SparkSession:
        return self.groups.sparkSession

    @cached_property
    def visits(self) -> DataFrame:
        both = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
        sequences = self.members.select("path_id", "part", both.alias("_o")).select((F.col("path_id") * 2 + F.col("_o")).alias("seq_id"), (F.col("part") * 2 + F.col("_o")).alias("word"))
        rows = self.groups.join(sequences, "word")
        longest = self.groups.agg(F.max("pos")).first()[0] or 0
        return kept(cut(link_visits(places_within(rows, "node", ["begin", "seq_id"], "off", ["seq_id", "pos", "node"]), longest), "node", "off"))

    @cached_property
    def extent(self) -> tuple[int, int, int]:
        copies = F.col("copies")
        return tuple(self.groups.agg(F.coalesce(F.sum(F.when(F.col("pos") == 0, copies)), F.lit(0)), F.coalesce(F.sum(copies), F.lit(0)), F.coalesce(F.max("pos"), F.lit(0))).first())

    @cached_property
    def header(self) -> DataFrame:
        copies, node = F.col("copies"), F.col("node")
        stats = self.groups.agg(
            F.coalesce(F.sum(F.when(F.col("pos") == 0, copies)), F.lit(0)).alias("sequences"), F.coalesce(F.sum(copies), F.lit(0)).alias("size"), F.coalesce(F.min(F.when(node > 0, node)) - 1, F.lit(0)).alias("offset"), (F.coalesce(F.max(node), F.lit(-1)) + 1).alias("alphabet_size")
        )
        return stats.withColumn("effective", F.col("alphabet_size") - F.col("offset")).withColumn("bidirectional", F.lit(True))
