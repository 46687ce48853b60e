"""Invariants of an index, each as one row (compared, differing): how much was looked at, and what broke the rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.index import PathIndex
from ..plans.tables import agreement, sums_within
from . import locate, search, stats


def _broken(rows: DataFrame, rule: Column) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.coalesce(~rule, F.lit(True))).alias("differing"))


def find_agrees(index: PathIndex, patterns: DataFrame, longest: int) -> DataFrame:
    """The direct search and the search by extension."""
    return agreement(search.find(index, patterns), search.find_by_extension(index, patterns, longest))


def bidirectional_agrees(index: PathIndex, patterns: DataFrame, longest: int) -> DataFrame:
    """The search in both directions and two direct searches."""
    return agreement(search.bd_search(index, patterns, longest), search.find_both(index, patterns))


def locate_agrees(index: PathIndex, states: DataFrame) -> DataFrame:
    """The sequences of the states by ranges of visits and position by position."""
    return locate.locate_agreement(index, states)


def extract_agrees(index: PathIndex, sequences: DataFrame) -> DataFrame:
    return agreement(index.rebuilt_paths.select("seq_id", "path"), sequences.select("seq_id", "path"))


def inverse_agrees(index: PathIndex) -> DataFrame:
    """Whether a step forward and one back lead home."""
    ahead = index.visits.filter("next <> 0").select("node", "off", F.col("next").alias("n"), F.col("next_off").alias("o"))
    back = search.inverse_lf(index, ahead.select(F.col("n").alias("node"), F.col("o").alias("off")).distinct())
    joined = ahead.join(back.select(F.col("node").alias("n"), F.col("off").alias("o"), "prev", "prev_off"), ["n", "o"], "left")
    return _broken(joined, (F.col("prev") == F.col("node")) & (F.col("prev_off") == F.col("off")))


def samples_agree(index: PathIndex, interval: int) -> DataFrame:
    """The samples, and the visits that should be sampled."""
    samples = stats.sampled(index, interval)
    due = index.visits.filter((F.col("next") == 0) | ((F.col("pos") + 1) % interval == 0)).select("node", "off", "seq_id")
    return agreement(samples, due)


def run_head_agrees(index: PathIndex) -> DataFrame:
    """The successor function of the packed values, and the values at the following offsets."""
    sa = locate.suffix_array(index).select("node", "off", "packed", "max_length")
    joined = sa.join(locate.locate_next(index, sa.select("packed", "max_length")), "packed", "left")
    after = sa.select("node", (F.col("off") - 1).alias("off"), F.col("packed").alias("expected"))
    return _broken(joined.join(after, ["node", "off"], "left"), F.col("next_packed").eqNullSafe(F.col("expected")))


def lf_equation(index: PathIndex) -> DataFrame:
    """Whether each visit's successor stands at its edge's start plus the equal successors before it."""
    own = index.visits.filter("next <> 0").select("node", "next", "off", "next_off")
    ranked = sums_within(own, ["node", "next"], "off", [], F.lit(1), "rank").join(index.edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "rank_off"), ["node", "next"])
    return _broken(ranked, F.col("next_off") == F.col("rank_off") + F.col("rank") - 1)


def well_formed(index: PathIndex) -> DataFrame:
    """(check, compared, differing): offsets dense in each node, one start row a sequence, positions dense in each sequence."""
    v = index.visits
    nodes = v.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("last"), F.countDistinct("off").alias("d"))
    seqs = v.groupBy("seq_id").agg(F.count_if(F.col("pos") == 0).alias("starts"), F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"), F.countDistinct("pos").alias("d"))
    dense = (F.col("n") == F.col("last") + 1) & (F.col("n") == F.col("d"))
    checks = {"offsets": _broken(nodes, dense), "starts": _broken(seqs, F.col("starts") == 1), "positions": _broken(seqs, dense)}
    rows = [df.select(F.lit(name).alias("check"), "compared", "differing") for name, df in checks.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])
