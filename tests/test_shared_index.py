"""Indexes of paths that repeat: equal paths are ranked once."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import variants as V
from strandline.plans.index import VISIT_COLUMNS, PathIndex
from strandline.plans.shared import SharedIndex
from strandline.sources import bundle
from strandline.tools import build_from_variants

from test_variants import OVERLAP, inputs

PARTS = [(0, [2, 4, 6]), (1, [4, 6]), (2, [2, 4, 6, 4]), (3, []), (4, [2, 4, 6]), (5, [8, 8, 8])]


def rows(index):
    return sorted(map(tuple, index.visits.select(*VISIT_COLUMNS).collect()), key=str)


@pytest.mark.parametrize("method", ["prefix", "doubling"])
def test_groups_give_the_visits_back(spark, tmp_path, method):
    parts = spark.createDataFrame(PARTS, "part long, path array<bigint>")
    members = spark.range(40).select(F.col("id").alias("path_id"), (F.col("id") * 7 % 11 % 6).alias("part")).localCheckpoint()
    want = PathIndex.from_paths(members.join(parts, "part").select("path_id", "path"))
    made = SharedIndex.from_parts(members, parts, method)
    bundle.save(made, f"{tmp_path}/b")
    got = bundle.load(spark, f"{tmp_path}/b")[0]
    assert got.header.first() == want.header.first() and got.extent == want.extent
    assert got.groups.count() == sum(2 * (len(p) + 1) for _, p in PARTS)  # no row for a copy
    assert rows(got) == rows(want)


def test_copies_of_haplotypes_are_not_ranked_again(spark, tmp_path):
    """The rows that are indexed don't grow with samples of equal genotypes, and the visits are those of the haplotypes one by one."""
    v, phasings = inputs(spark, OVERLAP)
    more = phasings.withColumn("sample", F.explode(F.sequence(F.col("sample") * 5, F.col("sample") * 5 + 4)))
    one, many = build_from_variants(spark, f"{tmp_path}/one", v, phasings), build_from_variants(spark, f"{tmp_path}/many", v, more)
    assert many.groups.count() == one.groups.count() and many.extent[1] == 5 * one.extent[1]
    made = V.generate_haplotypes(v, more).select(F.col("seq_id").alias("path_id"), F.transform("path", lambda x: x * 2).alias("path"))
    assert rows(many) == rows(PathIndex.from_paths(made))
