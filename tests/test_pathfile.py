import random
import struct

import numpy as np
import pytest
import zstandard

from strandline.functions import codecs
from strandline.plans.index import PathIndex
from strandline.sources import pathfile

PATHS = [[2, 8, 10], [], [4, 6, 4, 6, 4, 6], [2, 8, 12], [2, 8, 10]]


def elements(*numbers):
    return struct.pack(f"<{len(numbers)}Q", *numbers)


def bit_vector(bits):
    words = [sum(b << i for i, b in enumerate(bits[at : at + 64])) for at in range(0, len(bits), 64)]
    return elements(len(bits), len(words), *words)


def integers(values, width):
    bits = [v >> i & 1 for v in values for i in range(width)]
    return elements(len(values), width) + bit_vector(bits)


def sparse(values, universe, width):
    """An Elias-Fano vector, bit by bit, with a support structure that a reader has to pass over."""
    high = []
    for bucket in range((universe >> width) + 1):
        high += [1] * sum(v >> width == bucket for v in values) + [0]
    return elements(universe, len(values)) + bit_vector(high) + elements(2, 7, 7, 0, 0) + integers([v % 2**width for v in values], width)


def padded(data):
    return elements(len(data)) + data + bytes(-len(data) % 8)


def strings(values):
    text = "".join(values).encode()
    alphabet = bytes(sorted(set(text)))
    return sparse([len("".join(values[:i])) for i in range(len(values))], len(text), 2) + padded(alphabet) + integers([alphabet.index(b) for b in text], 5)


def record_bytes(visits, node):
    """A node's record from its visits (next node by offset), and how often each target was reached from smaller nodes."""
    own = [to for n, to in visits if n == node]
    out, targets = bytearray(), sorted(set(own))
    codecs.write_varint(out, len(targets))
    for before, to in zip([0, *targets], targets, strict=False):
        codecs.write_varint(out, to - before)
        codecs.write_varint(out, 0 if to == 0 else sum(n < node and t == to for n, t in visits))
    for to in own:
        codecs.RunCode(len(targets)).write(out, targets.index(to), 1)  # runs of one, as a writer may cut them
    return bytes(out)


def plain_file(paths, version=5, flags=4, tag=pathfile.TAG):
    """A file of forward paths by definition: visits sorted by the path read backwards."""
    rows = [(0, [], i, p[0] if p else 0) for i, p in enumerate(paths)]
    rows += [(n, [*p[:k][::-1], 0], i, [*p, 0][k + 1]) for i, p in enumerate(paths) for k, n in enumerate(p)]
    visits = [(r[0], r[3]) for r in sorted(rows)]
    nodes = [n for n, _ in visits if n]
    offset, alphabet = min(nodes, default=1) - 1, max(nodes, default=0) + 1
    records = [record_bytes(visits, 0)] + [record_bytes(visits, n) for n in range(offset + 1, alphabet)]
    starts, data = [sum(map(len, records[:i])) for i in range(len(records))], b"".join(records)
    body = data if version < 6 else zstandard.ZstdCompressor().compress(data)
    head = struct.pack("<IIQQQQQ", tag, version, len(paths), len(visits), offset, alphabet, flags)
    samples, metadata = elements(1, 99), elements(1, 5) if flags & 2 else elements(0)
    return head + strings(["source", "by hand", "kind", ""]) + sparse(starts, len(data), 3) + padded(body) + samples + metadata


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def built(spark):
    return PathIndex.from_paths(spark.createDataFrame(list(enumerate(PATHS)), "path_id long, path array<long>"), both=False)


@pytest.mark.parametrize(("version", "flags", "partitions"), [(5, 4, None), (5, 6, 50), (6, 4, 2)])
def test_load(spark, tmp_path, built, version, flags, partitions):
    path = tmp_path / "own"
    path.write_bytes(plain_file(PATHS, version, flags))
    layout = pathfile.read_layout(str(path))
    assert layout.tags == {"source": "by hand", "kind": ""} and not layout.bidirectional and layout.sequences == 5
    index = pathfile.load(spark, f"file://{path}", partitions)
    assert rows(index.visits) == rows(built.visits.select(*index.visits.columns)) and index.tags == layout.tags
    assert rows(pathfile.read_table(spark, str(path), "edges", partitions)) == rows(built.edges.drop("cnt"))


def test_partitions(spark, tmp_path):
    """A range of words each, no record twice, whatever the number of tasks; the file need not be short."""
    rng = random.Random(5)
    paths = [[rng.randrange(1, 500) for _ in range(rng.randrange(30))] for _ in range(80)]
    path = tmp_path / "own"
    path.write_bytes(plain_file(paths))
    layout, whole = pathfile.read_layout(str(path)), None
    for n in (1, 2, 7, 1000):
        parts = pathfile.word_ranges(str(path), layout, n)
        assert 1 <= len(parts) <= n and (n == 1 or len(parts) > 1)
        runs = [tuple(r) for p in parts for c in pathfile._rows(str(path), layout, p, "runs") for r in zip(*map(np.ndarray.tolist, c), strict=True)]
        whole = whole or runs
        assert runs == whole and sum(r[3] for r in runs) == layout.size
    assert pathfile.read_table(spark, str(path), partitions=7).rdd.getNumPartitions() > 1


def test_save(spark, tmp_path, built):
    """What is written reads back, has the header that the layout asks for, and is written by pieces in any number of tasks."""
    both = PathIndex.from_paths(spark.createDataFrame([(i, p) for i, p in enumerate(PATHS * 40)], "path_id long, path array<long>"), tags={"source": "a", "B": "c d"})
    for index in (built, both):
        path = str(tmp_path / f"saved-{index.bidirectional}")
        pathfile.save(index, path)
        back = pathfile.load(spark, path, 3)
        assert rows(back.visits) == rows(index.visits.select(*back.visits.columns)) and back.bidirectional == index.bidirectional
        assert rows(pathfile.read_table(spark, path).orderBy("node")) == rows(index.runs.select("node", "run_id", "start_off", "len", "successor"))
    assert back.tags == {"source": "a", "b": "c d"}
    pathfile.save(built, path)  # takes the place of the other file
    assert not pathfile.read_layout(path).bidirectional
    assert sorted(p.name for p in tmp_path.iterdir()) == ["saved-False", "saved-True"]  # no drafts
    with pytest.raises(Exception, match="in place"):
        pathfile.save(built, "s3://bucket/file")


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "path_id long, path array<long>")
    pathfile.save(PathIndex.from_paths(none), str(tmp_path / "none"))
    back = pathfile.load(spark, str(tmp_path / "none"))
    assert back.visits.count() == 0 and back.bidirectional
    blank = PathIndex.from_paths(spark.createDataFrame([(0, []), (1, [])], "path_id long, path array<long>"), both=False)
    pathfile.save(blank, str(tmp_path / "blank"))
    assert rows(pathfile.load(spark, str(tmp_path / "blank")).visits) == rows(blank.visits)


def test_errors(spark, tmp_path):
    good, path = plain_file(PATHS), tmp_path / "bad"

    def read(data):
        path.write_bytes(data)
        return pathfile.read_table(spark, str(path))

    for data, message in (
        (plain_file(PATHS, tag=1), "not a path index"), (plain_file(PATHS, version=7), "version 7"), (plain_file(PATHS, version=4), "version 4"), (plain_file(PATHS, flags=12), "flags"), (plain_file(PATHS, flags=0), "flags"),
        (good[:-8], "ends early"), (good[:40], "ends early"), (b"", "ends early"), (good[:32] + elements(99) + good[40:], "contradict"),
        (good[:40] + elements(6) + good[48:], "contradicts the metadata"),
    ):
        with pytest.raises(ValueError, match=message):
            read(data)
    path.write_bytes(good[:16] + elements(99) + good[24:])  # another size than the records have
    with pytest.raises(ValueError, match="contradict the header"):
        pathfile.load(spark, str(path))


@pytest.mark.parametrize("sigma", [1, 2, 3, 100, 254, 255, 400])
def test_long_records(sigma, monkeypatch):
    """A record that comes in pieces of a few bytes, cut anywhere, is what byte by byte decoding gives."""
    monkeypatch.setattr(pathfile, "PIECE", 7)
    rng, out = random.Random(sigma), bytearray()
    codecs.write_varint(out, sigma)
    for _ in range(sigma):
        codecs.write_varint(out, rng.randrange(1, 10**6))
        codecs.write_varint(out, rng.randrange(10**12))
    for _ in range(400):
        codecs.RunCode(sigma).write(out, rng.randrange(sigma), rng.choice([1, 2, 127, 128, 256, 10**9]))
    whole = {"edges": [], "runs": []}
    import io

    for kind, targets, numbers in pathfile._record(io.BytesIO(bytes(out)), len(out)):
        whole[kind] += zip(targets.tolist(), numbers.tolist(), strict=True)
    assert (whole["edges"], whole["runs"]) == codecs.decode_record(bytes(out))
    with pytest.raises(ValueError, match="ends early"):
        list(pathfile._record(io.BytesIO(bytes(out[:300]) + b"\xff" * 5), 305))
