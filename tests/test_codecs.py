import random

from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.functions import codecs
from strandline.plans.index import PathIndex
from strandline.sources import bundle


@given(st.lists(st.integers(0, 2**62), max_size=20))
def test_varints(values):
    out = bytearray()
    for v in values:
        codecs.write_varint(out, v)
    at, back = 0, []
    while at < len(out):
        v, at = codecs.read_varint(bytes(out), at)
        back.append(v)
    assert back == values


@settings(max_examples=200)
@given(st.integers(1, 400), st.lists(st.tuples(st.integers(0, 10**6), st.integers(1, 10**6)), max_size=10))
def test_runs(sigma, runs):
    runs, code, out = [(v % sigma, n) for v, n in runs], codecs.RunCode(sigma), bytearray()
    for v, n in runs:
        code.write(out, v, n)
    at, back = 0, []
    while at < len(out):
        v, n, at = code.read(bytes(out), at)
        back.append((v, n))
    assert back == runs
    assert codecs.RunCode(4).most == 64 and codecs.RunCode(255).most == 0


def test_zstd():
    data = bytes(random.Random(1).randbytes(5000)) + b"aaaa" * 1000
    assert codecs.unzstd(codecs.zstd(data)) == data and codecs.unzstd(codecs.zstd(b"")) == b""


def test_bundle_and_text(spark, tmp_path):
    (tmp_path / "paths.txt").write_text("2,8,10,\n\n4,6\n")
    paths = bundle.read_text_paths(spark, str(tmp_path / "paths.txt"))
    assert sorted((r[0], r[1]) for r in paths.collect()) == [(0, [2, 8, 10]), (1, []), (2, [4, 6])]
    index = PathIndex.from_paths(paths)
    for form in bundle.CODECS:
        bundle.save(index, str(tmp_path / form), form)
        back, meta = bundle.load(spark, str(tmp_path / form))
        assert meta is None and back.bidirectional
        assert sorted(map(str, back.visits.collect())) == sorted(map(str, index.visits.collect()))
        plan = back.visits.filter("node = 8").select("off")._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(node), EqualTo(node,8)]" in plan and "seq_id" not in plan.split("ReadSchema")[1]
