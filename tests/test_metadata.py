import pytest

from strandline.operators import dictionary as D
from strandline.operators import metadata as M

PATHS = [(0, 0, 0, 0), (0, 0, 1, 0), (1, 0, 0, 0), (1, 0, 1, 0), (1, 1, 0, 0), (1, 1, 1, 0), (2, 0, 0, 0), (2, 0, 0, 1), (2, 0, 1, 0), (2, 0, 1, 1)]


def names(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "path_id long, sample_id long, contig_id long, phase long, count long")


def strings(spark, xs):
    return spark.createDataFrame(list(enumerate(xs)), "id long, string string")


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts_and_removal(spark):
    meta = M.Metadata(3, 6, 2, names(spark, PATHS), strings(spark, ["a", "b", "c"]), strings(spark, ["x", "y"]))
    assert tuple(M.counts(meta.path_names).first()) == (10, 3, 6, 2)
    left, gone = M.remove_sample(meta, 1)
    assert sorted(r[0] for r in gone.collect()) == [2, 3, 4, 5]
    assert left.counts() == (2, 4, 2)
    assert tuples(left.path_names) == [(0, 0, 0, 0, 0), (1, 0, 0, 1, 0), (2, 1, 0, 0, 0), (3, 1, 0, 0, 1), (4, 1, 0, 1, 0), (5, 1, 0, 1, 1)]
    assert tuples(left.samples) == [(0, "a"), (1, "c")]
    left, gone = M.remove_contig(meta, 0)
    assert left.counts() == (3, 6, 1) and left.path_names.count() == 2


@pytest.mark.parametrize(("counts", "query", "want"), [([1000, 501, 500], 800, 1), ([1000, 501, 500], 499, None), ([1000, 501, 500], 500, 2), ([5, 5], 9, 0)])
def test_fragments(spark, counts, query, want):
    df = names(spark, [(0, 0, 0, c) for c in counts])
    asked = spark.createDataFrame([(0, 0, 0, 0, query)], "query_id long, sample_id long, contig_id long, phase long, count long")
    assert M.find_fragment(df, asked).first()["path_id"] == want


def test_chains(spark):
    df = names(spark, [(0, 0, 0, 20), (1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 10)])
    assert tuples(M.fragment_map(df).fillna(-1)) == [(0, 0, 3, -1), (1, 1, -1, -1), (2, 0, -1, 3), (3, 0, 2, 0)]
    asked = spark.createDataFrame([(6,), (7,), (98,)], "oriented long")
    assert tuples(M.oriented_next(M.fragment_map(df), asked).fillna(-1)) == [(6, 0, 4), (7, 5, 1), (98, -1, -1)]


@pytest.mark.parametrize("named", [True, False])
@pytest.mark.parametrize("same", [True, False])
def test_merge_matrix(spark, named, same):
    own = M.Metadata(3, 6, 2, names(spark, PATHS), strings(spark, ["a", "b", "c"]) if named else None, strings(spark, ["x", "y"]) if named else None)
    new = M.Metadata(3, 6, 2, names(spark, PATHS), strings(spark, ["c", "d", "e"]) if named else None, strings(spark, ["y", "z"]) if named else None)
    out = M.merge(own, new, same, same)
    if named:
        assert (out.n_samples, out.n_contigs) == (5, 3)
        assert tuples(out.samples) == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
        assert (10, 2, 1, 0, 0) in tuples(out.path_names)
        assert out.n_haplotypes == out.path_names.select("sample_id", "phase").distinct().count()
    else:
        assert (out.n_samples, out.n_contigs, out.n_haplotypes) == ((3, 2, 6) if same else (6, 4, 12))
        assert (10, 0 if same else 3, 0 if same else 2, 0, 0) in tuples(out.path_names)
    assert out.path_names.count() == 20
    with pytest.raises(ValueError):
        M.merge(M.Metadata(1, 1, 1), M.Metadata(2, 1, 1), True, True)


def test_policy(spark):
    one = M.Metadata(1, 1, 1)
    assert M.merge_policy("insert", None, True, one) is one
    assert M.merge_policy("insert", one, False, None) is None
    assert M.merge_policy("insert", None, False, one) is None
    assert M.merge_policy("disjoint", one, False, one).counts() == (1, 1, 2)
    assert M.merge_policy("insert", one, False, one).counts() == (2, 2, 1)


def test_dictionary_union_and_lookup(spark):
    own, new = strings(spark, ["first", "second", "third"]), strings(spark, ["first", "fourth", "fifth"])
    assert tuples(D.union(own, new)) == [(0, "first"), (1, "second"), (2, "third"), (3, "fourth"), (4, "fifth")]
    asked = spark.createDataFrame([("third",), ("?",)], "string string")
    assert tuples(D.find_strings(own, asked)) == [("?", 3), ("third", 2)]
    assert tuples(D.remove_id(own, 1)) == [(0, "first"), (1, "third")]
    empty = strings(spark, ["a"]).limit(0)
    assert D.union(empty, own).count() == 3 and D.union(own, empty).count() == 3


def test_tags():
    tags = D.Tags({"Key": "a"})
    tags.set("KEY", "b")
    assert len(tags) == 1 and tags.get("key") == "b" and tags.contains("kEy") and tags.get("x") == ""
    tags.unset("Key")
    assert not len(tags)
    with pytest.raises(ValueError):
        D.Tags.from_pairs(["a"])
    with pytest.raises(ValueError):
        D.Tags.from_pairs(["a", "1", "A", "2"])
