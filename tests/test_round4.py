"""What the fourth review found: disk and time of large builds."""

import os
import random

import pytest

from strandline.plans import index as I
from strandline.plans import tables
from strandline.streaming.builder import StreamingBuilder


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def corpus(spark, n, longest=30):
    rng = random.Random(n)
    return spark.createDataFrame([(i, [2 * rng.randrange(1, 400) for _ in range(rng.randrange(longest))]) for i in range(n)], "path_id long, path array<bigint>")


def shuffled_bytes(spark):
    where = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(f"{at}/{name}") for d in where for at, _, names in os.walk(d) for name in names if name.startswith("shuffle_"))


def test_a_path_is_spelled_once(spark):
    """Below the explode, not once for each of its visits."""
    plan = I.prefix_keys(I.both_orientations(corpus(spark, 20)))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda word: [i for i, line in enumerate(plan) if word in line]
    assert at("array_join") and min(at("array_join")) > max(at("posexplode"))


def test_paths_of_one_file_are_spread(spark, monkeypatch):
    """A file of many visits is one task to read, but not one task to spell out."""
    own = tables.cut(I.both_orientations(corpus(spark, 300)).coalesce(1))
    assert I.spread(own).rdd.getNumPartitions() == 1
    monkeypatch.setattr(I, "TASK_VISITS", 500)
    assert I.spread(own).rdd.getNumPartitions() > 10
    assert rows(I.build_visits(own, "prefix")) == rows(I.build_visits(own, "doubling"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffled_bytes(spark)
    tables.cut(spark.range(1000).repartition(3).groupBy("id").count(), "id")
    assert shuffled_bytes(spark) <= before


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    """A batch and its merge leave their runs only; what is kept outlives the scope, also when it is cut in an inner one."""
    where = lambda: {f for f in os.listdir(tables.shared_dir(spark).removeprefix("file:")) if f.startswith("table-")}
    parts = [corpus(spark, n).withColumnRenamed("path_id", "key") for n in (9, 7)]
    before, builder = where(), StreamingBuilder(spark, str(tmp_path / "runs"))
    for k, part in enumerate(parts):
        builder.add(part, k)
    assert where() == before and [r[2] for r in builder._runs()] == [1]
    with pytest.raises(RuntimeError), tables.passing():
        one = tables.cut(spark.range(3))
        with tables.passing():
            two, three = tables.kept(tables.cut(spark.range(4))), tables.cut(spark.range(5))
        assert one.count() == 3
        raise RuntimeError
    assert [os.path.exists(t.cut_path.removeprefix("file:")) for t in (one, two, three)] == [False, True, False]


@pytest.mark.parametrize("logical", [False, True])
def test_runs_across_blocks(spark, monkeypatch, logical):
    """A run that fills blocks, ends with one or goes over the border of several is one run."""
    monkeypatch.setattr(I, "BLOCK", 4)
    paths = [[2, 4]] * 9 + [[2, 6]] * 3 + [[2]] * 5 + [[6, 2, 4]] * 2 + [[2, 8, 2]] * 4 + [[], [8]]
    index = I.PathIndex.from_paths(spark.createDataFrame(list(enumerate(paths)), "path_id long, path array<bigint>"))
    want = []
    for node, off, to in sorted(index.visits.select("node", "off", "next").collect()):
        if off and not (logical and to == 0) and want[-1][4] == to:
            want[-1][3] += 1
        else:
            want.append([node, want[-1][1] + 1 if off else 0, off, 1, to])
    got = I.runs_of(I.run_pieces(index.visits, logical))
    assert got.columns == ["node", "run_id", "start_off", "len", "successor"]
    assert sorted(map(list, got.collect())) == want and any(r[3] > 8 for r in want)


def test_saving_leaves_no_tables_or_shuffle_files(spark, tmp_path):
    """Of a save only the file stays, and the edges that the index keeps."""
    from strandline.sources import pathfile

    where = lambda: {f for f in os.listdir(tables.shared_dir(spark).removeprefix("file:")) if f.startswith("table-")}
    index = I.PathIndex(tables.cut(I.PathIndex.from_paths(corpus(spark, 1500)).visits))
    before, files = where(), shuffled_bytes(spark)
    pathfile.save(index, str(tmp_path / "file"))
    assert len(where() - before) == 1 and "edges" in index.__dict__
    assert shuffled_bytes(spark) - files < os.path.getsize(tmp_path / "file")  # counts by partition only
    got = pathfile.read_table(spark, str(tmp_path / "file"))
    assert rows(got) == rows(index.runs.select("node", "run_id", "start_off", "len", "successor"))


def test_followers_are_found_where_they_are_asked_for(spark, monkeypatch):
    """Jumps are kept for the sequences of the states' nodes only, each round's tables go with it, and queries that share a range share its pairs."""
    from strandline.operators import locate, search

    paths = [[2, 4, 6, 4]] * 37 + [[8, 4, 6]] * 20 + [[10, 12, 14]] * 30 + [[6, 4], [4], []]
    index = I.PathIndex.from_paths(spark.createDataFrame(list(enumerate(paths)), "path_id long, path array<bigint>"))
    wanted = [(1, [4, 6]), (2, [4, 6]), (3, [2, 4]), (4, [6, 4]), (5, [2, 6])]
    found = locate.find_with_first(index, search.find(index, spark.createDataFrame(wanted, "query_id long, pattern array<bigint>")))
    index.edges, index.logical_runs, index.longest  # noqa: B018  what the index keeps
    where = lambda: {f for f in os.listdir(tables.shared_dir(spark).removeprefix("file:")) if f.startswith("table-")}
    asked, before = [], where()
    monkeypatch.setattr(locate, "doubled_jumps", lambda jumps, longest, real=locate.doubled_jumps: asked.append(jumps.filter("seq between 114 and 173").count()) or real(jumps, longest))
    got = rows(locate.locate_by_successors(index, found))
    want = {(q, 2 * i) for q, p in wanted for i, path in enumerate(paths) if any(path[k : k + 2] == p for k in range(len(path)))}
    assert got == sorted(want, key=str) and len(asked) >= 4 and not any(asked)
    assert len(where() - before) <= 2 + 2  # ranges of the queries, their sequences; tables that finding left behind
