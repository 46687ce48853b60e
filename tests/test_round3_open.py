"""What the third review left open: haplotypes of equal samples, common suffixes, and path files."""

import pytest
from pyspark.sql import functions as F
from test_variants import BASIC, OVERLAP, inputs

from strandline.operators import variants as V


def haplotypes(df):
    return sorted(tuple(r) for r in df.select("seq_id", "file", "sample", "phase", "count", "path").collect())


@pytest.mark.parametrize("size", [1, 7])
def test_equal_samples_are_folded_once(spark, monkeypatch, size):
    v, phasings = inputs(spark, OVERLAP)
    many = phasings.withColumn("sample", F.explode(F.sequence(F.col("sample"), F.col("sample") + 900, F.lit(100).cast("long"))))
    tables = []
    monkeypatch.setattr(V, "cut", lambda df, *cluster, real=V.cut: tables.append(real(df, *cluster)) or tables[-1])
    made = haplotypes(V.generate_haplotypes(v, many, piece_sites=size))
    outcomes = [t for t in tables if "entry" in t.columns]
    assert [t.select("class").distinct().count() for t in outcomes] == [7]  # samples of one piece, as all sites overlap
    alone = haplotypes(V.generate_haplotypes(v, phasings, piece_sites=size))
    paths = {(sample, phase, count): path for _, _, sample, phase, count, path in alone}
    assert {r[2:5]: r[5] for r in made} == {(s + 100 * k, p, c): path for (s, p, c), path in paths.items() for k in range(10)}
    assert [r[0] for r in made] == list(range(10 * len(alone)))
    monkeypatch.setattr(V, "FEW_ROWS", 0)  # nothing is broadcast
    assert haplotypes(V.generate_haplotypes(v, many, piece_sites=size)) == made


@pytest.mark.parametrize("size", [1, 7])
def test_null_alleles_keep_samples_apart(spark, size):
    v, phasings = inputs(spark, BASIC)
    hit = lambda c, k: F.when(F.col("sample") != k, F.col(c)).alias(c)
    one = phasings.filter("sample = 12").withColumn("first", F.lit(1).cast("long")).withColumn("second", F.lit(1).cast("long")).withColumn("sample", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")))
    nulls = one.select("file", "site", "sample", hit("first", 1), hit("second", 2), "diploid", "phased")
    zeros = nulls.fillna(0, ["first", "second"])
    assert haplotypes(V.generate_haplotypes(v, nulls, piece_sites=size)) == haplotypes(V.generate_haplotypes(v, zeros, piece_sites=size))


def test_varints_in_a_row():
    import numpy as np

    from strandline.functions import codecs

    values = [0, 1, 127, 128, 300, 1 << 14, (1 << 62) + 5, -1, 200]
    want = bytearray()
    for x in values[:-1]:
        codecs.write_varint(want, x % (1 << 64))
    want.append(200)  # as it is
    raw = np.arange(len(values)) == len(values) - 1
    data, lengths = codecs.varint_bytes(np.array(values), raw)
    assert data == bytes(want) and lengths.sum() == len(want)
    assert codecs.varint_bytes(np.zeros(0, np.int64))[0] == b""


def test_records_are_coded_once_and_in_batches(spark, tmp_path, monkeypatch):
    from strandline.plans.index import PathIndex
    from strandline.sources import pathfile

    paths = [[2 * (i % 7 + 1), 2 * (i % 300 + 1), 2 * (i % 5 + 1)] for i in range(900)]
    index = PathIndex.from_paths(spark.createDataFrame(list(enumerate(paths)), "path_id long, path array<bigint>"))
    tables = []
    monkeypatch.setattr(pathfile, "cut", lambda df, *c, real=pathfile.cut: tables.append((df.columns, real(df, *c))) or tables[-1][1])
    monkeypatch.setattr(pathfile, "forget", lambda *tables: None)
    at = str(tmp_path / "file")
    pathfile.save(index, at)
    n_units = index.runs.count() + index.edges.count()
    [coded] = [t for columns, t in tables if "bytes" in columns]
    assert coded.filter("bytes is not null").count() < n_units / 10  # pieces, not a row for each edge and run
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(pathfile.read_table(spark, at)) == rows(index.runs.select("node", "run_id", "start_off", "len", "successor"))
    assert rows(pathfile.read_table(spark, at, "edges")) == rows(index.edges.drop("cnt"))


@pytest.mark.parametrize("near", [1, 3, 16])
def test_common_suffixes_of_copies(spark, monkeypatch, near):
    from strandline.operators import search
    from strandline.plans.index import PathIndex

    monkeypatch.setattr(search, "NEAR", near)
    monkeypatch.setattr(search, "BLOCK", 4)
    own = [[2 + 2 * (i * i // 3 % 2) for i in range(40)], [4] * 25, [2, 4] * 9 + [6], [6, 2, 4, 2], [6], []]
    paths = [*own * 3, own[0][7:], own[0][:30] + [6], [2, 2] + own[0]]
    index = PathIndex.from_paths(spark.createDataFrame(list(enumerate(paths)), "path_id long, path array<bigint>"))
    compared = []
    monkeypatch.setattr(search, "_lcs_by_words", lambda index, pairs, real=search._lcs_by_words: compared.append(pairs.count()) or real(index, pairs))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    found = rows(search.longest_common_suffix(index, "doubling"))
    assert found == rows(search.longest_common_suffix(index, "prefix"))
    assert near == 1 or sum(compared) < len(found) / 2  # copies are filled in from their neighbours
