"""What a review found: ranges that queries share, and queries over all nodes."""

from pyspark.sql import functions as F

from strandline.operators import locate
from strandline.plans.index import PathIndex

DATA = "/root/testdata/sf0.001"
PATHS = [[2, 4, 6, 8], [2, 4, 6], [4, 6, 4, 6, 8], [6, 8], [2, 4]]


def built(spark, paths=PATHS, both=True):
    rows = spark.createDataFrame(list(enumerate(paths)), "path_id long, path array<bigint>")
    index = PathIndex.from_paths(rows, both)
    index.visits.cache()
    return index


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def shared_states(spark, index, queries=40):
    """Every node's whole range and its first visit alone, each for many queries."""
    sizes = sorted((r["node"], r["size"]) for r in index.node_sizes.collect())
    ranges = [x for node, size in sizes for x in ((node, 0, size - 1), (node, 0, 0))]
    return spark.createDataFrame([(i, *ranges[i % len(ranges)]) for i in range(queries)], "query_id long, node long, sp long, ep long")


def expected(index, states):
    visits = index.visits.collect()
    return sorted({(s["query_id"], v["seq_id"]) for s in states.collect() for v in visits if v["node"] == s["node"] and s["sp"] <= v["off"] <= s["ep"]})


def test_shared_ranges_are_located_once(spark, monkeypatch):
    monkeypatch.setattr(locate, "PAIRED_QUERIES", 2)
    monkeypatch.setattr(locate, "PAIRED_SEQUENCES", 3)
    index = built(spark)
    states = shared_states(spark, index)
    want = expected(index, states)
    for found in (locate.locate_states(index, states), locate.locate_offsets(index, states), locate.locate_by_successors(index, locate.find_with_first(index, states))):
        assert tuples(found) == want
        top = found._jdf.queryExecution().executedPlan().toString().split("Join")[0]
        assert "Aggregate" not in top and "Exchange" not in top  # pairs are neither sorted nor shuffled
    assert tuple(locate.locate_agreement(index, states).first()) == (len(want), 0)


def test_a_query_with_several_ranges(spark):
    index = built(spark)
    states = shared_states(spark, index).withColumn("query_id", F.col("query_id") % 5)
    want = expected(index, states)
    assert tuples(locate.locate_states(index, states)) == tuples(locate.locate_offsets(index, states)) == want
    assert tuple(locate.locate_agreement(index, states).first()) == (len(want), 0)


def query(spark, name):
    from strandline import catalog

    return catalog.queries()[name](spark, DATA)


def test_lf_asks_every_position_for_every_node(spark):
    from strandline.sources.corpus import index

    idx = index(spark, DATA)
    want = idx.visits.filter("node <> 0").count() * (idx.node_sizes.count() + 1)
    for name in ("q06_lf_to", "q10_full_lf"):
        assert query(spark, name).count() == want


def test_reverse_offsets_of_every_node(spark):
    from strandline.sources.corpus import index

    idx = index(spark, DATA)
    assert query(spark, "q16_reverse_offset").count() == query(spark, "q02_find_pattern").count() * idx.node_sizes.count()  # the endmarker is left out, the absent node is in


def test_following_values_come_with_their_node(spark):
    assert query(spark, "l15_locate_next").columns == ["node", "packed", "next_packed"]


def test_one_sort_merges_as_the_sweeps_do(spark, monkeypatch):
    from strandline.operators import mutate

    parts = [built(spark, PATHS), built(spark, [[4, 6, 8], [2, 4, 6, 300], []]), built(spark, [[300, 2], [6, 8]])]
    assert mutate.sorted_at_once(parts)
    assert tuples(mutate.rank_array(*parts[:2])) == tuples(mutate.swept_ranks(*parts[:2]))
    at_once = tuples(mutate.merge_all(parts).visits)
    monkeypatch.setattr(mutate, "COMPARABLE", 0)
    assert not mutate.sorted_at_once(parts)
    assert tuples(mutate.merge_all(parts).visits) == at_once


def test_long_records_are_coded_in_pieces(spark, monkeypatch):
    from strandline.functions import codecs

    monkeypatch.setattr(codecs, "PIECE_RUNS", 2)
    index = built(spark)
    records = codecs.encode_records(index)
    assert records.groupBy("node").count().filter("count > 1").count() > 0
    assert tuples(codecs.decode_records(records)) == tuples(index.runs.select("node", "run_id", "successor", "len"))
