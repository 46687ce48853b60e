"""The grouped prefix join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_table_ops import brute_components, near_rows

from strandline.llm import near_dedup, prefix_join
from strandline.llm.common import Scratch


def result(df, **more):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in prefix_join.jaccard_components(df, **more).collect())


@pytest.mark.parametrize("least", [2, prefix_join.RARE])
def test_join_matches_brute_force(make, least):
    rows = near_rows()
    assert result(make([(i, t, None) for i, t in rows]), least_marked=least) == brute_components(rows, 5, 80)


def test_join_in_small_blocks(make, monkeypatch):
    """Blocks of three members and shards flushed all the time: the same components."""
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(prefix_join, "FLUSH", 50)
    monkeypatch.setattr(prefix_join, "CELL_ROWS", 7)
    monkeypatch.setattr(prefix_join, "SEEN", 2)
    rows = near_rows()
    assert result(make([(i, t, None) for i, t in rows]), most_marked=20, least_marked=2) == brute_components(rows, 5, 80)


def chain_rows():
    """Windows of one long text, so that each is like its neighbours only, and variants of one size and prefix."""
    rng = random.Random(3)
    words = [f"v{k}" for k in range(500)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(40)]
    base = [f"c{k}" for k in range(60)]
    for _ in range(12):
        own = list(base)
        own[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((len(rows), " ".join(own)))
    return rows + [(len(rows) + k, " ".join(f"c{j}" for j in range(k, k + 9))) for k in range(20)]


@pytest.mark.parametrize("percent", [60, 80, 95, 100])
def test_chains_and_thresholds(make, percent):
    rows = chain_rows()
    assert result(make([(i, t, None) for i, t in rows]), percent=percent) == brute_components(rows, 5, percent)


def test_members_of_one_group(make, monkeypatch):
    """Groups by size alone: the classes of a group are compared with each other as well."""
    monkeypatch.setattr(prefix_join.xxhash, "xxh3_128_intdigest", near_dedup.xxhash.xxh3_128_intdigest)
    rows = chain_rows()
    df = make([(i, t, None) for i, t in rows])
    scratch = Scratch(df.sparkSession)
    bits, keys, grades = prefix_join.marked_shingles(df.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")), scratch, 5, least=2)
    assert bits == 6 and (np.diff(keys.astype(np.int64)) > 0).all() and (grades >= prefix_join.GRADES).all()
    rows = [(i, "one two three four five " + " ".join(["six"] * 40) + " " * (i % 3) + f" seven{i % 2}") for i in range(9)] + rows
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert result(make([(i, t, None) for i, t in rows]), least_marked=2) == brute_components(rows, 5, 80)


def test_filters_never_exclude_a_match():
    rng = np.random.default_rng(5)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 80).astype(np.uint64)
        x, y = (np.unique(pool[rng.random(80) < 0.9]) for _ in range(2))
        both, total = len(np.intersect1d(x, y)), len(x) + len(y)
        a, b = prefix_join.bitmap(x), prefix_join.bitmap(y)
        size = min(len(a), len(b))
        differ = int(np.bitwise_count(prefix_join.folded(a, size) ^ prefix_join.folded(b, size)).sum())
        assert (total - differ) // 2 >= both
        if near_dedup.same(x, y, 80):
            px, py = (prefix_join.prefix(s, 80, 6, np.zeros(0, np.uint64), np.zeros(0, np.int64)) for s in (x, y))
            first = min(set(px.tolist()) & set(py.tolist()))
            most = min(len(x) - px.tolist().index(first), len(y) - py.tolist().index(first))
            assert prefix_join.reaches(most, total, 80) and most >= both


def test_no_documents_and_ids_of_other_types(spark, make):
    assert prefix_join.jaccard_components(make([(1, "x", None)]).limit(0)).count() == 0
    df = spark.createDataFrame([("d-2", "one and the same few words"), ("d-1", "one and the same few words"), ("e", None)], "doc_id string, text string")
    assert result(df) == [("d-1", 2, "d-1"), ("d-2", 2, "d-1"), ("e", 0, "e")]
