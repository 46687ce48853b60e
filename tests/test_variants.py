"""Haplotype generation against the golden lists, and genotypes."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import variants as V

# The inputs and expected haplotypes of FIXTURES.md, F4a (BASIC), F4b (OVERLAP) and F4c (SKIP). The order of `want` counts.
BASIC = dict(
    sites=[(2, 4), (6, 7), (8, 9)], alleles=[[[11, 12]], [[13], [14, 15]], [[16], []]],
    genotypes=[["1|0", "1|1", "0"], ["0", "1/2", "2|0"], ["2|1", "1|0", "0|1"]], skip=False, first=10,
    want=[[1, 2, 11, 12, 5, 6], [1, 2, 3, 4, 5, 6], [1, 2, 11, 12, 5, 6], [5, 6, 13, 8], [1, 2, 11, 12, 5, 6], [5, 6, 14, 15, 8], [1, 2, 3, 4, 5, 6], [5, 6, 7, 8], [8, 10], [8, 16, 10], [8, 16, 10], [8, 9, 10], [5, 6, 14, 15, 8, 9, 10], [5, 6, 7, 8, 16, 10]],
)
OVERLAP = dict(
    sites=[(2, 4), (3, 6), (4, 7)], alleles=[[[3, 11], [12, 4]], [[4, 13, 6], [14, 5, 15], [14, 5, 6]], [[5, 16, 7], [17, 6, 7], [5, 6, 18]]],
    genotypes=[["2", "1", "0", "0", "0", "0", "0"], ["2", "1", "1", "2", "1", "3", "2"], ["0", "0", "2", "1", "1", "2", "3"]], skip=False, first=0,
    want=[[1, 2, 3, 4, 13, 6], [1, 2, 3, 14, 5, 15], [1, 2, 12, 14, 5, 15, 7, 8, 9, 10], [1, 2, 3, 11, 13, 6, 7, 8, 9, 10], [17, 6, 7, 8, 9, 10], [5, 16, 7, 8, 9, 10], [1, 2, 3, 4, 13, 16, 7, 8, 9, 10], [1, 2, 3, 14, 17, 6, 7, 8, 9, 10], [1, 2, 3, 14, 5, 15, 18, 8, 9, 10]],
)
SKIP = OVERLAP | dict(
    skip=True,
    want=[[1, 2, 12, 14, 5, 15, 7, 8, 9, 10], [1, 2, 3, 11, 13, 6, 7, 8, 9, 10], [1, 2, 3, 4, 13, 6, 7, 8, 9, 10], [1, 2, 3, 14, 5, 15, 7, 8, 9, 10], [1, 2, 3, 4, 13, 16, 7, 8, 9, 10], [1, 2, 3, 14, 17, 6, 7, 8, 9, 10], [1, 2, 3, 14, 5, 15, 18, 8, 9, 10]],
)


def inputs(spark, case):
    reference = spark.range(10).select(F.col("id").alias("pos"), (F.col("id") + 1).alias("node"))
    sites = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(case["sites"])], "site long, ref_start long, ref_end long")
    alleles = spark.createDataFrame([(i, k + 1, p) for i, x in enumerate(case["alleles"]) for k, p in enumerate(x)], "site long, allele long, path array<bigint>")
    texts = spark.createDataFrame([(site, case["first"] + k, g) for site, row in enumerate(case["genotypes"]) for k, g in enumerate(row)], "site long, sample long, text string")
    g = V.parse_genotype(F.col("text"), F.lit(True), F.lit(False))
    return V.VariantPaths(reference, sites, alleles), texts.select(F.lit(0).alias("file"), "site", "sample", g.alias("g")).select("file", "site", "sample", "g.*")


@pytest.mark.parametrize("size", [1, 2, 7])
@pytest.mark.parametrize("case", [BASIC, OVERLAP, SKIP], ids=["basic", "overlap", "skip"])
def test_golden_haplotypes(spark, case, size):
    v, phasings = inputs(spark, case)
    made = V.generate_haplotypes(v, phasings, case["skip"], piece_sites=size).orderBy("seq_id").collect()
    assert [r["path"] for r in made] == case["want"]
    assert [r["seq_id"] for r in made] == list(range(len(made)))


def test_genotypes(spark):
    cases = {"1|0": (1, 0, True, True), "1/2": (1, 2, True, False), "0": (0, 0, False, True), "1/1": (1, 1, True, True), "": (0, 0, True, True), ".|.": (0, 0, True, True)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", V.parse_genotype(F.col("t"), F.lit(True), F.lit(True)).alias("g")).collect()
    assert {r["t"]: tuple(r["g"]) for r in got} == cases
    two = F.lit(2).cast("long")
    back = df.select(V.parse_genotype(F.col("t"), F.lit(True), F.lit(True)).alias("g")).select("g", V.decode_genotype(V.encode_genotype(F.col("g"), two), two).alias("b"))
    assert all(r["g"] == r["b"] for r in back.collect())
    swapped = df.filter("t = '1/2'").select(V.force_phased(V.parse_genotype(F.col("t"), F.lit(True), F.lit(True)), F.lit(True)).alias("g")).first()["g"]
    assert tuple(swapped) == (2, 1, True, True)


def test_overlaps_of_adjacent_sites(spark):
    v, _ = inputs(spark, OVERLAP)
    rows = V.overlaps(v).orderBy("site").collect()
    assert [(r["site"], r["overlap"], r["resolved"] + r["unresolved"]) for r in rows] == [(1, 1, 12), (2, 2, 16)]


def test_all_customers_are_indexed(spark):
    from strandline import catalog

    sf, queries = "/root/testdata/sf0.001", catalog.queries()
    assert queries["h14_indexed_haplotypes"](spark, sf).first()["sequences"] == 2 * queries["h13_generate_haplotypes"](spark, sf).count()
