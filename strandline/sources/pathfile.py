"""Path index files of the portable layout, as a Spark data source.

Such a file is a row of 64-bit little-endian elements: a header, tags, the starts of the records as an Elias-Fano vector, the records
(from version 6 on as zstd), optional samples and optional metadata. Format ``pathfile`` reads its records as ``runs`` (node, run_id, start_off, len,
successor) or ``edges`` (src, dst, rank_off); ``load`` makes a ``PathIndex`` of them and ``save`` writes one as version 5.

Reading: a task takes a range of words of the vector's upper half, which holds a one for each record and a zero for each bucket of bytes, so that
equal ranges hold about equally many records and bytes. Planning counts the ones before each range in a stream. A record is decoded piece by
piece: a task holds the edges of one node and a piece of its runs. The records of version 6 are one compressed stream without entry points: a task
reads through what is before its own range, and keeps none of it.

Writing: a file is a table (at, bytes) of the pieces of it. Edges and runs are sorted as numbers and coded in batches, so that pieces and record starts
are all that is shuffled again; places come from the pieces' sizes, packed integers from a bitwise aggregate by word, and each task writes its pieces in place, so a task that is run again writes the same bytes, and the finished file takes its name at the
end. That needs a folder that all executors can open for writing in place; reading takes any store that Arrow opens.

Errors: a foreign tag, a version or a flag that is not known, parts that contradict each other and a file that ends early raise ``ValueError``.
An empty index is a file without records. Runs are as the file has them; a writer may have cut one.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import codecs
from ..operators import stats
from ..plans.index import VISIT_COLUMNS, PathIndex, run_pieces, runs_of
from ..plans.tables import cut, forget, kept, passing, released

# Fixed values of the layout.
TAG = 0x6B376B37
VERSIONS = (5, 6)
COMPRESSED_FROM = 6
BIDIRECTIONAL, HAS_METADATA, PORTABLE = 1, 2, 4

SCHEMAS = {"runs": "node bigint, run_id bigint, start_off bigint, len bigint, successor bigint", "edges": "src bigint, dst bigint, rank_off bigint"}
PIECES = "at bigint, bytes binary"
#: Words of the vector, and bytes of the records, that are held at a time.
WORDS, PIECE = 1 << 13, 1 << 20
#: Records up to this size are decoded byte by byte, longer ones with numpy.
SHORT = 256
#: Bytes of records for a task, unless option ``partitions`` says how many tasks.
TASK_BYTES = 32 << 20
ROWS = 1 << 16


@dataclass(frozen=True)
class Bits:
    at: int
    bits: int


@dataclass(frozen=True)
class Packed:
    n: int
    width: int
    bits: Bits


@dataclass(frozen=True)
class Sparse:
    universe: int
    ones: int
    high: Bits
    low: Packed


@dataclass(frozen=True)
class Layout:
    version: int
    sequences: int
    size: int
    offset: int
    alphabet_size: int
    flags: int
    tags: dict
    starts: Sparse
    data_at: int
    data_bytes: int

    @property
    def bidirectional(self) -> bool:
        return bool(self.flags & BIDIRECTIONAL)


def open_file(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError("the file ends early")
    return data


def _number(f) -> int:
    return int.from_bytes(_exactly(f, 8), "little")


def _skip(f, n_bytes: int) -> int:
    """Pass over bytes that fill whole elements; where they begin."""
    at = f.tell()
    end = at + -(-n_bytes // 8) * 8
    if end > f.size():
        raise ValueError("the file ends early")
    f.seek(end)
    return at


def _bits(f) -> Bits:
    bits, words = _number(f), _number(f)
    if words != -(-bits // 64):
        raise ValueError("a bit vector contradicts its length")
    return Bits(_skip(f, 8 * words), bits)


def _packed(f) -> Packed:
    n, width = _number(f), _number(f)
    out = Packed(n, width, _bits(f))
    if out.bits.bits != n * width:
        raise ValueError("an integer vector contradicts its length")
    return out


def _sparse(f) -> Sparse:
    universe, ones = _number(f), _number(f)
    high = _bits(f)
    for _ in range(3):  # optional support structures
        _skip(f, 8 * _number(f))
    low = _packed(f)
    if low.n != ones:
        raise ValueError("a sparse vector contradicts its length")
    return Sparse(universe, ones, high, low)


def _words(f, bits: Bits, first: int, n: int) -> np.ndarray:
    f.seek(bits.at + 8 * first)
    return np.frombuffer(_exactly(f, 8 * n), "<u8")


def _integers(f, packed: Packed, first: int, n: int) -> np.ndarray:
    if not n or not packed.width:
        return np.zeros(n, np.int64)
    begin, end = first * packed.width, (first + n) * packed.width
    words = np.append(_words(f, packed.bits, begin // 64, -(-end // 64) - begin // 64), np.uint64(0))
    place = np.arange(begin, end, packed.width) - begin // 64 * 64
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    over = np.where(shift > 0, words[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    mask = np.uint64((1 << packed.width) - 1)
    return ((words[word] >> shift | over) & mask).astype(np.int64)


def _values(f, sparse: Sparse, first: int, word: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first, values) of the ones in a range of words, some at a time; ``first`` ones are before it."""
    for at in range(word, end, WORDS):
        words = _words(f, sparse.high, at, min(WORDS, end - at))
        places = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")) + 64 * at
        if len(places):
            low = _integers(f, sparse.low, first, len(places))
            yield first, (places - first - np.arange(len(places)) << sparse.low.width) | low
            first += len(places)


def _n_words(bits: Bits) -> int:
    return -(-bits.bits // 64)


def _tags(f) -> dict[str, str]:
    index = _sparse(f)
    n = _number(f)
    alphabet = _exactly(f, n)
    f.seek(f.tell() + -n % 8)
    text = _packed(f)
    after = f.tell()
    starts = [int(v) for _, part in _values(f, index, 0, 0, _n_words(index.high)) for v in part]
    raw = bytes(alphabet[i] for i in _integers(f, text, 0, text.n))
    f.seek(after)
    strings = [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
    return dict(zip((k.lower() for k in strings[::2]), strings[1::2], strict=True))


def read_layout(path: str) -> Layout:
    """Where a file's parts are, found by jumping from length to length."""
    with open_file(path) as f:
        tag, version, *counts = struct.unpack("<IIQQQQQ", _exactly(f, 48))
        flags = counts[-1]
        if tag != TAG:
            raise ValueError("not a path index file")
        if version not in VERSIONS:
            raise ValueError(f"version {version} is not known")
        if flags & ~(BIDIRECTIONAL | HAS_METADATA | PORTABLE) or not flags & PORTABLE:
            raise ValueError("flags that are not known, or not the portable layout")
        tags, starts, data_bytes = _tags(f), _sparse(f), _number(f)
        out = Layout(version, *counts, tags, starts, _skip(f, data_bytes), data_bytes)
        if starts.ones != out.alphabet_size - out.offset:
            raise ValueError("records and alphabet contradict each other")
        if version < COMPRESSED_FROM and starts.universe != data_bytes:
            raise ValueError("record starts and records contradict each other")
        _skip(f, 8 * _number(f))  # samples
        if bool(_skip_option(f)) != bool(flags & HAS_METADATA):
            raise ValueError("the header contradicts the metadata")
        return out


def _skip_option(f) -> int:
    n = _number(f)
    _skip(f, 8 * n)
    return n


@dataclass
class WordRange(InputPartition):
    word: int
    end: int
    first: int


def word_ranges(path: str, layout: Layout, n: int) -> list[WordRange]:
    """At most ``n`` ranges of words, and the records before each; the words are counted in a stream."""
    total, out, ones = _n_words(layout.starts.high), [], 0
    step = max(1, -(-total // n))
    with open_file(path) as f:
        for word in range(0, total, step):
            end, before = min(total, word + step), ones
            for at in range(word, end, WORDS):
                ones += int(np.bitwise_count(_words(f, layout.starts.high, at, min(WORDS, end - at))).sum())
            if ones > before:
                out.append(WordRange(word, end, before))
    if ones != layout.starts.ones:
        raise ValueError("a sparse vector contradicts its length")
    return out


def _bounds(f, layout: Layout, part: WordRange) -> Iterator[tuple[int, int, int]]:
    """(record, start, end) of a range; the last one ends where the next record begins."""
    held = None
    for first, values in _values(f, layout.starts, part.first, part.word, part.end):
        for i, start in enumerate(values.tolist(), first):
            if held is not None:
                yield (*held, start)
            held = i, start
    if held is not None:
        later = _values(f, layout.starts, held[0] + 1, part.end, _n_words(layout.starts.high))
        yield (*held, next((int(v[0]) for _, v in later), layout.starts.universe))


class _Limited:
    """The next ``n`` bytes of a file, as a file."""

    def __init__(self, f, n: int):
        self.f, self.left = f, n

    def read(self, n: int) -> bytes:
        data = self.f.read(min(n, self.left))
        self.left -= len(data)
        return data


def _feed(f, layout: Layout, start: int):
    """A reader of the records' bytes from a place on."""
    if layout.version < COMPRESSED_FROM:
        f.seek(layout.data_at + start)
        return _Limited(f, layout.data_bytes - start)
    import zstandard

    f.seek(layout.data_at)
    out = zstandard.ZstdDecompressor().stream_reader(_Limited(f, layout.data_bytes), read_across_frames=True)
    while start:
        start -= len(_exactly(out, min(start, PIECE)))
    return out


def _varints(data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Up to ``n`` whole varints and the bytes they take."""
    ends = np.flatnonzero(data < 128)[:n]
    if not len(ends):
        return np.zeros(0, np.int64), 0
    starts = np.append(0, ends[:-1] + 1)
    used = int(ends[-1]) + 1
    shift = 7 * (np.arange(used) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((data[:used].astype(np.int64) & 127) << shift, starts), used


def _runs(data: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The whole runs at the beginning of ``data``: edges, lengths and the bytes they take.

    Most runs are one byte; only those that go on in a varint are visited one by one.
    """
    if sigma >= 255:
        found, _ = _varints(data, len(data))
        found = found[: len(found) // 2 * 2]
        used = _varints(data, len(found))[1] if len(found) else 0
        return found[::2], found[1::2] + 1, used
    most, used = 256 // sigma, len(data)
    own, more, at, raw = np.ones(len(data), bool), np.zeros(len(data), np.int64), 0, data.tobytes()
    for place in np.flatnonzero(data >= sigma * (most - 1)).tolist():
        if place < at:
            continue
        try:
            more[place], at = codecs.read_varint(raw, place + 1)
        except IndexError:  # goes on in the next piece
            used = place
            break
        own[place + 1 : at] = False
    places = np.flatnonzero(own[:used])
    codes = data[places].astype(np.int64)
    return codes % sigma, codes // sigma + 1 + more[places], used


def _record(feed, size: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """("edges", targets, rank_offs) of a record, then ("runs", targets, lengths) piece by piece."""
    if size <= SHORT:
        edges, runs = codecs.decode_record(_exactly(feed, size))
        yield "edges", *np.array(edges, np.int64).reshape(-1, 2).T
        yield "runs", *np.array(runs, np.int64).reshape(-1, 2).T
        return
    held, left, wanted = np.zeros(0, np.uint8), size, 1
    while True:
        found, used = _varints(held, wanted)
        if len(found) == wanted == 1 + 2 * int(found[0]):
            break
        if len(found) == wanted:
            wanted = 1 + 2 * int(found[0])
            continue
        if not left:
            raise ValueError("a record ends early")
        take = min(left, PIECE)
        held, left = np.append(held, np.frombuffer(_exactly(feed, take), np.uint8)), left - take
    targets, sigma, held = np.cumsum(found[1::2]), int(found[0]), held[used:]
    yield "edges", targets, found[2::2]
    while len(held) or left:
        take = min(left, PIECE)
        held, left = np.append(held, np.frombuffer(_exactly(feed, take), np.uint8)), left - take
        edge, length, used = _runs(held, sigma)
        if not used and not left:
            raise ValueError("a record ends early")
        yield "runs", targets[edge], length
        held = held[used:]


def _rows(path: str, layout: Layout, part: WordRange, table: str) -> Iterator[list[np.ndarray]]:
    """The columns of a table, record by record and piece by piece."""
    with open_file(path) as f, open_file(path) as g:
        feed = None
        for record, start, end in _bounds(f, layout, part):
            feed = feed or _feed(g, layout, start)
            node, run_id, off = record + layout.offset if record else 0, 0, 0
            for kind, targets, numbers in _record(feed, end - start):
                n = len(targets)
                if kind == table == "edges" and n:
                    yield [np.full(n, node), targets, numbers]
                elif kind == table == "runs" and n:
                    upto = np.cumsum(numbers)
                    yield [np.full(n, node), run_id + np.arange(n), off + upto - numbers, numbers, targets]
                    run_id, off = run_id + n, off + int(upto[-1])


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, n: int | None):
        self.path, self.table, self.n, self.layout = path, table, n, read_layout(path)

    def partitions(self) -> list[WordRange]:
        return word_ranges(self.path, self.layout, self.n or max(1, -(-self.layout.starts.universe // TASK_BYTES)))

    def read(self, partition: WordRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a file without records
            return
        names = [c.split()[0] for c in SCHEMAS[self.table].split(", ")]
        held, n = [], 0
        for columns in _rows(self.path, self.layout, partition, self.table):
            held.append(columns)
            n += len(columns[0])
            if n >= ROWS:
                yield _batch(held, names)
                held, n = [], 0
        if held:
            yield _batch(held, names)


def _batch(held: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held, strict=True)], names=names)


def _in_place(draft: str):
    """Writes rows (at, bytes) into a file; neighbours go together."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = os.open(draft, os.O_WRONLY)
        try:
            begin, held, n, total = 0, [], 0, 0
            for batch in batches:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if held and (at != begin + n or n >= PIECE):
                        _write_all(f, begin, b"".join(held))
                        held, n = [], 0
                    if not held:
                        begin = at
                    held.append(data)
                    n, total = n + len(data), total + len(data)
            _write_all(f, begin, b"".join(held))
            os.fsync(f)
        finally:
            os.close(f)
        yield pa.RecordBatch.from_pydict({"n": [total]})

    return write


def write_pieces(pieces: DataFrame, path: str, size: int) -> None:
    """Write (at, bytes) as a file of ``size`` bytes, which takes its name, or another file's place, when all of it is there."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError("a file is written in place: its folder has to be one that executors can open")
    path = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    draft = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(draft), exist_ok=True)
    with open(draft, "wb") as f:
        f.truncate(size)
    try:
        with released(pieces.sparkSession):
            pieces.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(_in_place(draft), "n long").agg(F.sum("n")).collect()
        os.replace(draft, path)
    except BaseException:
        os.unlink(draft)
        raise


def _write_all(f: int, at: int, data: bytes) -> None:
    while data:
        n = os.pwrite(f, data, at)
        at, data = at + n, data[n:]


class PathFile(DataSource):
    """Options: ``table`` (runs or edges) and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "pathfile"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "runs")]

    def reader(self, schema) -> DataSourceReader:
        n = self.options.get("partitions")
        return _Reader(self.options["path"], self.options.get("table", "runs"), int(n) if n else None)


def read_table(spark: SparkSession, path: str, table: str = "runs", partitions: int | None = None) -> DataFrame:
    """``runs`` or ``edges`` of a file."""
    read_layout(path)  # so that a bad file is an error here, not in a job
    spark.dataSource.register(PathFile)
    reader = spark.read.format("pathfile").option("table", table)
    return (reader.option("partitions", partitions) if partitions else reader).load(path)


def load(spark: SparkSession, path: str, partitions: int | None = None) -> PathIndex:
    """The index of a file. Sequences and positions are not in it: each visit follows its predecessors to its sequence's start, in doubled jumps."""
    layout = read_layout(path)
    found = PathIndex(None, layout.bidirectional, layout.tags)
    found.__dict__ |= {table: cut(read_table(spark, path, table, partitions)) for table in SCHEMAS}
    links = cut(stats.unfolded(found))
    back = links.filter("next <> 0").select(F.col("next").alias("node"), F.col("next_off").alias("off"), F.col("node").alias("prev"), F.col("off").alias("prev_off"))
    state = cut(back.select("*", F.col("prev").alias("at"), F.col("prev_off").alias("at_off"), F.lit(1).cast("long").alias("pos")))
    step = 1
    while state.filter("at <> 0").limit(1).count():
        if step > layout.size:
            raise ValueError("visits that no sequence reaches")
        jumps = state.select(F.col("node").alias("at"), F.col("off").alias("at_off"), F.col("at").alias("to"), F.col("at_off").alias("to_off"), F.col("pos").alias("more"))
        moved = state.filter("at <> 0").join(jumps, ["at", "at_off"])
        moved = moved.select("node", "off", "prev", "prev_off", F.col("to").alias("at"), F.col("to_off").alias("at_off"), (F.col("pos") + F.col("more")).alias("pos"))
        farther = cut(state.filter("at = 0").unionByName(moved))
        forget(state)
        state, step = farther, 2 * step
    starts = links.filter("node = 0").select("node", "off", F.lit(None).cast("long").alias("prev"), F.lit(None).cast("long").alias("prev_off"), F.lit(0).cast("long").alias("at"), F.col("off").alias("at_off"), F.lit(0).cast("long").alias("pos"))
    visits = cut(links.join(state.unionByName(starts), ["node", "off"]).withColumn("seq_id", F.col("at_off")).select(*VISIT_COLUMNS))
    n = visits.agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("node") == 0).alias("sequences")).first()
    if tuple(n) != (layout.size, layout.sequences):
        raise ValueError("the records contradict the header")
    forget(links, state, found.runs, found.edges)
    return PathIndex(visits, layout.bidirectional, layout.tags)


def _element(*numbers: int) -> bytes:
    return struct.pack(f"<{len(numbers)}Q", *numbers)


def _small_packed(values: list[int]) -> bytes:
    width = max(1, max(values, default=0).bit_length())
    bits = len(values) * width
    whole = sum(v << i * width for i, v in enumerate(values))
    return _element(len(values), width, bits, -(-bits // 64)) + whole.to_bytes(-(-bits // 64) * 8, "little")


def _low_width(universe: int, ones: int) -> int:
    return max(1, universe.bit_length() - ones.bit_length()) if ones else 1


def _small_sparse(values: list[int], universe: int) -> bytes:
    width = _low_width(universe, len(values))
    bits = len(values) + (universe >> width) + 1
    high = sum(1 << (v >> width) + i for i, v in enumerate(values))
    low = [v & (1 << width) - 1 for v in values]
    packed = sum(v << i * width for i, v in enumerate(low))
    n = -(-len(low) * width // 64)
    return _element(universe, len(values), bits, -(-bits // 64)) + high.to_bytes(-(-bits // 64) * 8, "little") + _element(0, 0, 0, len(low), width, len(low) * width, n) + packed.to_bytes(8 * n, "little")


def _string_array(strings: list[str]) -> bytes:
    raw = [s.encode() for s in strings]
    text = b"".join(raw)
    alphabet = bytes(sorted(set(text)))
    starts = [sum(map(len, raw[:i])) for i in range(len(raw))]
    padded = alphabet + bytes(-len(alphabet) % 8)
    return _small_sparse(starts, len(text)) + _element(len(alphabet)) + padded + _small_packed([alphabet.index(b) for b in text])


@F.pandas_udf(T.BinaryType())
def _word(values: pd.Series) -> pd.Series:
    flat = values.to_numpy(np.int64).astype("<i8").tobytes()
    return pd.Series([flat[i : i + 8] for i in range(0, len(flat), 8)], dtype=object)


def _units(index: PathIndex, offset: int, effective: int) -> DataFrame:
    """(record, part, k, sigma, x, y): the edges (part 0: steps and rank_offs) and runs (part 1: edges and lengths) of each record in their
    order, so that a record of any size is spread. A record without edges has one row without numbers."""
    record = lambda node: F.when(node == 0, 0).otherwise(node - offset).cast("long").alias("record")
    group = Window.partitionBy("src")
    along, none = group.orderBy("dst"), F.lit(None).cast("long")
    edges = cut(index.edges.select("src", "dst", "rank_off", (F.row_number().over(along) - 1).cast("long").alias("k"), (F.col("dst") - F.coalesce(F.lag("dst").over(along), F.lit(0))).alias("step"), F.count(F.lit(1)).over(group).alias("sigma")))
    heads = edges.select(record(F.col("src")), F.lit(0).alias("part"), "k", "sigma", F.col("step").alias("x"), F.col("rank_off").alias("y"))
    runs = index.runs if "runs" in index.__dict__ else runs_of(run_pieces(index.visits))
    runs = runs.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("successor"), F.col("k").alias("edge"), "sigma"), ["node", "successor"])
    bodies = runs.select(record(F.col("node")), F.lit(1).alias("part"), F.col("run_id").alias("k"), "sigma", F.col("edge").alias("x"), F.col("len").alias("y"))
    unused = index.spark.range(effective).withColumnRenamed("id", "record").join(heads.filter("k = 0").select("record"), "record", "left_anti")
    zero = F.lit(0).cast("long")
    return heads.unionByName(bodies).unionByName(unused.select("record", F.lit(0).alias("part"), zero.alias("k"), zero.alias("sigma"), none.alias("x"), none.alias("y")))


CODED = "_part int, inside long, record long, bytes binary"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of a partition's units, in pieces, and where its records begin; ``inside`` counts from the partition's first byte."""
    inside = 0
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        number = lambda c: pa.compute.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
        run, k, sigma, x, y = number("part") == 1, number("k"), number("sigma"), number("x"), number("y")
        most = np.where(sigma < 255, 256 // np.maximum(sigma, 1), 0)
        byte = run & (most > 0)
        values = np.stack([sigma, np.where(byte, x + sigma * (np.minimum(y, most) - 1), x), np.where(run, np.where(byte, y - most, y - 1), y)], axis=1)
        first = ~run & (k == 0)
        there = np.stack([first, sigma > 0, (sigma > 0) & ~(byte & (y < most))], axis=1)
        raw = np.stack([np.zeros(n, bool), byte, np.zeros(n, bool)], axis=1)
        data, lengths = codecs.varint_bytes(values[there], raw[there])
        sizes = np.zeros(there.shape, np.int64)
        sizes[there] = lengths
        sizes = sizes.sum(axis=1)
        starts = inside + np.cumsum(sizes) - sizes
        begins, m = np.flatnonzero(first), int(first.sum())
        record = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(number("record")[begins], pa.int64())])
        part = pa.array(np.full(m + 1, number("_part")[0], np.int32))
        yield pa.RecordBatch.from_arrays([part, pa.array(np.append(inside, starts[begins]), pa.int64()), record, pa.array([data, *[None] * m], pa.binary())], names=["_part", "inside", "record", "bytes"])
        inside += len(data)


def save(index: PathIndex, path: str) -> None:
    """Write an index as a file of version 5, without samples and metadata."""
    spark, head = index.spark, index.header.first()
    offset, effective = head["offset"], head["effective"]
    order = ["record", "part", "k"]
    with passing():
        units = kept(cut(_units(index, offset, effective)))
    coded = cut(units.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).mapInArrow(_coded, CODED))
    forget(units)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = coded.groupBy("_part").agg(F.sum(F.length("bytes")).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row a partition
    laid = coded.join(F.broadcast(sizes), "_part").select("record", (F.col("base") + F.col("inside")).alias("at"), "bytes")
    total = laid.agg(F.sum(F.length("bytes"))).first()[0] or 0

    flags = PORTABLE | (BIDIRECTIONAL if index.bidirectional else 0)
    front = struct.pack("<IIQQQQQ", TAG, VERSIONS[0], head["sequences"], head["size"], offset, head["alphabet_size"], flags)
    front += _string_array([s for pair in index.tags.items() for s in pair])
    width = _low_width(total, effective)
    high_bits = effective + (total >> width) + 1
    high_words, low_words = -(-high_bits // 64), -(-effective * width // 64)
    front += _element(total, effective, high_bits, high_words)
    high_at = len(front)
    middle = _element(0, 0, 0, effective, width, effective * width, low_words)
    low_at = high_at + 8 * high_words + len(middle)
    data_at = low_at + 8 * low_words + 8
    size = data_at + -(-total // 8) * 8 + 16  # neither samples nor metadata

    starts = laid.filter("record is not null").select("record", "at")
    one = lambda place, base: (F.shiftright(place, 6) * 8 + base, place.bitwiseAND(F.lit(63)).cast("int"))
    at, bit = one(F.shiftright("at", width) + F.col("record"), high_at)
    high = starts.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word"))
    at, bit = one(F.col("record") * width, low_at)
    low = starts.select(at.alias("to"), bit.alias("bit"), F.col("at").bitwiseAND(F.lit((1 << width) - 1)).alias("v"))
    own, over = "named_struct('at', to, 'part', shiftleft(v, bit))", "named_struct('at', to + 8, 'part', shiftrightunsigned(v, 64 - bit))"
    halves = F.expr(f"if(bit + {width} > 64, array({own}, {over}), array({own}))")
    low = low.select(F.inline(halves)).groupBy("at").agg(F.bit_or("part").alias("word"))
    small = spark.createDataFrame([(0, front), (high_at + 8 * high_words, middle), (data_at - 8, _element(total))], PIECES)
    pieces = small.unionByName(laid.filter("bytes is not null").select((F.col("at") + data_at).alias("at"), "bytes")).unionByName(high.unionByName(low).select("at", _word("word").alias("bytes")))
    write_pieces(pieces, path, size)
    forget(coded)
