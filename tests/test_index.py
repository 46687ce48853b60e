"""The small collections of FIXTURES.md against the definition and the golden values."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import locate, mutate, search, stats, verify
from strandline.plans.index import PathIndex

SHORT, ALT, EMPTY = [1, 4, 5, 6, 7, 9], [1, 2, 4, 5, 6, 8, 9], []
GOLDEN = """
0 : (0 0 0 2) (1 1 0 19) (2 2 0 2) (3 3 0 19) (4 4 0 0) (5 5 0 0) (6 6 0 2) (7 7 0 19)
2 : (0 0 1 8) (1 2 1 4) (2 6 1 8)
3 : (0 3 7 0) (1 1 6 0) (2 7 6 0)
4 : (0 2 2 8)
5 : (0 3 6 3)
8 : (0 0 2 10) (1 6 2 10) (2 2 3 10)
9 : (0 1 5 3) (1 7 5 3) (2 3 5 5)
10: (0 0 3 12) (1 6 3 12) (2 2 4 12)
11: (0 1 4 9) (1 7 4 9) (2 3 4 9)
12: (0 0 4 14) (1 6 4 14) (2 2 5 16)
13: (0 1 3 11) (1 7 3 11) (2 3 3 11)
14: (0 0 5 18) (1 6 5 18)
15: (0 1 2 13) (1 7 2 13)
16: (0 2 6 18)
17: (0 3 2 13)
18: (0 0 6 0) (1 6 6 0) (2 2 7 0)
19: (0 1 1 15) (1 3 1 17) (2 7 1 15)
"""


def table(spark, paths):
    rows = [(i, [2 * n for n in p]) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "path_id long, path array<bigint>")


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def f1b(spark):
    return PathIndex.from_paths(table(spark, [SHORT, ALT, EMPTY, SHORT]))


def brute_visits(seqs):
    rows = []
    for s, path in enumerate(seqs):
        full = [0, *path]
        for pos, node in enumerate(full):
            back = (*reversed(full[:pos]),) if pos else ()
            rows.append((node, back, s, pos, full[pos + 1] if pos + 1 < len(full) else 0))
    out, off = [], {}
    for node, _, s, pos, nxt in sorted(rows, key=lambda r: (r[0], r[1] if r[0] else (), r[2])):
        k = off.get(node, 0)
        off[node] = k + 1
        out.append((node, k, s, pos, nxt))
    return out


@pytest.mark.parametrize("method", ["prefix", "doubling"])
def test_golden_visits(spark, method):
    index = PathIndex.from_paths(table(spark, [SHORT, ALT, EMPTY, SHORT]), method=method)
    want = []
    for line in GOLDEN.strip().splitlines():
        node, rest = line.split(":")
        want += [(int(node), *map(int, x.split())) for x in rest.replace("(", "").split(")")[:-1]]
    assert tuples(index.visits.select("node", "off", "seq_id", "pos", "next")) == sorted(want)


def test_random_collections_agree_with_the_definition(spark):
    rng = random.Random(7)
    for _ in range(2):
        paths = [[rng.randint(1, 4) for _ in range(rng.randint(0, 9))] for _ in range(8)]
        seqs = [[2 * n + rng.randint(0, 1) for n in p] for p in paths]
        df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, path array<bigint>")
        for method in ("prefix", "doubling"):
            assert tuples(PathIndex.build(df, method=method).visits.select("node", "off", "seq_id", "pos", "next")) == sorted(brute_visits(seqs))


def test_header_and_runs(spark, f1b):
    assert tuples(f1b.header) == [(8, 46, 1, 20, 19, True)]
    assert tuples(stats.run_counts(f1b)) == [(29, 34)]
    assert f1b.edges.count() == 23


def test_find_and_locate(spark, f1b):
    patterns = {0: [2, 4], 1: [2, 8], 2: [8, 10, 12], 3: [8, 10, 12, 16], 4: [10, 12, 14], 5: [12, 8], 6: []}
    df = spark.createDataFrame(list(patterns.items()), "query_id long, pattern array<bigint>")
    found = search.find(f1b, df)
    assert tuples(found.select("query_id", "node", "sp", "ep")) == [(0, 4, 0, 0), (1, 8, 0, 1), (2, 12, 0, 2), (3, 16, 0, 0), (4, 14, 0, 1)]
    assert tuples(found) == tuples(search.find_by_extension(f1b, df, 4))
    assert tuples(locate.locate_states(f1b, found)) == [(0, 2), (1, 0), (1, 6), (2, 0), (2, 2), (2, 6), (3, 2), (4, 0), (4, 6)]
    both = search.bd_search(f1b, df, 4)
    assert tuples(both) == tuples(search.find_both(f1b, df).select(*both.columns))
    assert (3, 16, 0, 0, 9, 2, 2) in tuples(both)
    prefixes = tuples(search.prefix(f1b, df).select("query_id", "node", "sp", "ep"))
    assert prefixes == [(0, 4, 0, 0), (1, 8, 0, 1), (6, 0, 0, 7)]
    assert tuples(locate.locate_positions(f1b, spark.createDataFrame([(19, 0), (19, 1), (19, 2)], "node long, off long"))) == [(19, 0, 1), (19, 1, 3), (19, 2, 7)]


def test_only_empty_paths(spark):
    index = PathIndex.from_paths(table(spark, [EMPTY] * 3))
    assert tuples(index.visits.select("node", "off", "seq_id")) == [(0, i, i) for i in range(6)]
    assert tuples(stats.contains_node(index, spark.createDataFrame([(19,)], "node long"))) == [(19, False)]
    assert tuples(locate.extract(index, spark.createDataFrame([(2,), (9,)], "seq_id long"))) == [(2, []), (9, [])]


def test_invariants(spark, f1b):
    for query in (verify.lf_equation(f1b), verify.inverse_agrees(f1b), verify.samples_agree(f1b, 3), verify.run_head_agrees(f1b), verify.well_formed(f1b)):
        assert all(r["compared"] > 0 and r["differing"] == 0 for r in query.collect())


def test_broken_links_are_found(f1b):
    """Two exchanged offsets break the rules that name them."""
    from pyspark.sql import functions as F

    here = (F.col("node") == 18) & F.col("off").isin(0, 1)
    swapped = PathIndex(f1b.visits.withColumn("off", F.when(here, 1 - F.col("off")).otherwise(F.col("off"))), True)
    assert verify.inverse_agrees(swapped).first()["differing"] > 0 and verify.extract_agrees(swapped, f1b.paths).first()["differing"] == 0
    doubled = PathIndex(f1b.visits.withColumn("off", F.when(here, 0).otherwise(F.col("off"))), True)
    assert {r["check"]: r["differing"] for r in verify.well_formed(doubled).collect()} == {"offsets": 1, "starts": 0, "positions": 0}


A = [[11, 13, 14, 15, 17], [11, 12, 14, 15, 17], [11, 13, 14, 16, 17]]
B = [[42, 46, 51, 45, 43], [42, 44, 50, 47, 43], [42, 44, 50, 52]]


@pytest.mark.parametrize(("both", "numbers"), [(False, [(35, 23, 26, 18)]), (True, [(70, 42, 50, 36)])])
def test_components_merge_and_split(spark, both, numbers):
    a = PathIndex.from_paths(table(spark, A), both)
    b = PathIndex.from_paths(spark.createDataFrame(list(enumerate(B)), "path_id long, path array<bigint>"), both)
    every = PathIndex.from_paths(spark.createDataFrame(list(enumerate([[2 * n for n in p] for p in A] + B)), "path_id long, path array<bigint>"), both)
    merged = mutate.merge_disjoint([a, b])
    assert tuples(merged.visits.fillna(-1)) == tuples(every.visits.fillna(-1))
    assert tuples(mutate.merge(a, b).visits.fillna(-1)) == tuples(every.visits.fillna(-1))
    row = stats.summary(every, 2).first()
    assert [(row["size"], row["concrete"], row["logical"], row["samples"])] == numbers
    mapping = spark.createDataFrame([(n, 0) for n in range(11, 18)] + [(n, 1) for n in (21, 22, 23, 25, 26)], "node_id long, subgraph int")
    parts = mutate.split_indexes(every, mapping, [0, 1])
    for part, own in zip(parts, (a, b), strict=True):
        assert tuples(part.visits.fillna(-1)) == tuples(own.visits.fillna(-1))
    with pytest.raises(ValueError):
        mutate.merge_disjoint([a, a])


def test_remove_equals_rebuild(spark, f1b):
    left, removed = mutate.remove(f1b, spark.createDataFrame([(0,), (0,)], "id long"))
    assert removed.first()[0] == 14
    assert tuples(left.visits.fillna(-1)) == tuples(PathIndex.from_paths(table(spark, [ALT, EMPTY, SHORT])).visits.fillna(-1))
    same, none = mutate.remove(f1b, spark.createDataFrame([(0,), (99,)], "id long"))
    assert none.first()[0] == 0 and same is f1b


def test_insert_equals_rebuild(spark):
    first = PathIndex.from_paths(table(spark, [SHORT]))
    grown = mutate.insert(first, table(spark, [ALT, SHORT]))
    assert tuples(grown.visits.fillna(-1)) == tuples(PathIndex.from_paths(table(spark, [SHORT, ALT, SHORT])).visits.fillna(-1))
    assert grown.bidirectional and not mutate.insert(first, table(spark, [ALT]), both=False).bidirectional


@pytest.mark.parametrize("seed", range(3))
def test_merge_by_ranks_equals_rebuild(spark, seed):
    """Few labels and long common stretches, words that only one index has, empty and repeated paths; both orientations and one."""
    rng = random.Random(seed)
    draw = lambda n, labels, longest: [[2 * rng.randint(1, labels) for _ in range(rng.randint(0, longest))] for _ in range(n)]
    own, new = draw(14, 3, 20) + [[2, 4] * 17, []], draw(9, 4, 24) + [[2, 4] * 19, [], [90, 2, 4]]
    own += new[:2]
    df = lambda paths: spark.createDataFrame(list(enumerate(paths)), "path_id long, path array<bigint>")
    for both in (True, False):
        built = PathIndex.from_paths(df(own + new), both)
        merged = mutate.merge(PathIndex.from_paths(df(own), both), PathIndex.from_paths(df(new), both))
        assert tuples(merged.visits.fillna(-1)) == tuples(built.visits.fillna(-1))
    assert tuples(mutate.merge(PathIndex.from_paths(df([])), PathIndex.from_paths(df(new))).visits.fillna(-1)) == tuples(PathIndex.from_paths(df(new)).visits.fillna(-1))


def test_each_record_streams_by(spark):
    """A function over records sees batches that are smaller than a large record, and gives its runs all the same."""
    from strandline.queries.navigate import _runs_of

    paths = spark.createDataFrame([(i, [2, 4 + 2 * (i // 7 % 3)] * (i % 3)) for i in range(60)], "path_id long, path array<bigint>")
    index = PathIndex.from_paths(paths)
    want = tuples(index.runs.select("node", "run_id", "start_off", "len", "successor"))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "5")
    try:
        assert index.largest > 5 and tuples(stats.for_each_record(index, _runs_of, "node long, run_id long, start_off long, len long, successor long")) == want
        sizes = stats.for_each_record(index, lambda node, batches: (b.select([0]) for b in batches), "off long")
        assert sizes.count() == index.visits.count()
    finally:
        spark.conf.set(setting, before)


def test_partition_range():
    assert mutate.partition_range(0, 9, 3) == [(0, 2), (3, 5), (6, 9)]
    assert mutate.partition_range(5, 6, 9) == [(5, 5), (6, 6)]
    assert mutate.partition_range(3, 2, 4) == []


def test_find_touches_only_what_it_needs(spark, f1b):
    """The search reads the bundle's columns it joins on, and no pattern pairs with all visits."""
    df = spark.createDataFrame([(0, [2, 4])], "query_id long, pattern array<bigint>")
    plan = search.find(f1b, df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    assert F is not None
