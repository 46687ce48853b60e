"""Scalar codecs and hashes. Built-in expressions where they suffice, numpy over Arrow batches elsewhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.index import PathIndex
from ..plans.tables import places_within


def write_varint(out: bytearray, value: int) -> None:
    """Little-endian groups of 7 bits; the high bit says that more follow."""
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """The value and the place after it."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


class RunCode:
    """Runs (value, length) over an alphabet of ``sigma`` values: one byte while both fit, else a byte and the rest as a varint."""

    def __init__(self, sigma: int):
        self.sigma = sigma
        self.most = 256 // sigma if sigma < 255 else 0  # the first length that needs more bytes

    def write(self, out: bytearray, value: int, length: int) -> None:
        if not self.most:
            write_varint(out, value)
            write_varint(out, length - 1)
            return
        short = min(length, self.most)
        out.append(value + self.sigma * (short - 1))
        if short == self.most:
            write_varint(out, length - short)

    def read(self, data: bytes, at: int) -> tuple[int, int, int]:
        if not self.most:
            value, at = read_varint(data, at)
            length, at = read_varint(data, at)
            return value, length + 1, at
        length, value = divmod(data[at], self.sigma)
        length, at = length + 1, at + 1
        if length == self.most:
            more, at = read_varint(data, at)
            length += more
        return value, length, at


#: Shifts of the groups of a varint; a 64-bit number has at most ten of them.
_GROUPS = np.arange(0, 70, 7, dtype=np.uint64)


def varint_bytes(values: np.ndarray, raw: np.ndarray | bool = False) -> tuple[bytes, np.ndarray]:
    """Varints one after another and the bytes that each takes, group by group for all values at once; where ``raw``, a value is one byte as it is."""
    own = values.astype(np.int64).view(np.uint64)
    place = np.arange(max(1, -(-int(own.max(initial=0)).bit_length() // 7)))  # as many groups as the largest value takes
    rest = own[:, None] >> np.minimum(_GROUPS[: len(place)], np.uint64(63))
    raw = np.broadcast_to(raw, len(own))
    length = np.where(raw, 1, np.maximum((rest > 0).sum(axis=1), 1))
    groups = (rest & np.where(raw, 255, 127).astype(np.uint64)[:, None]).astype(np.uint8) | np.where(place < length[:, None] - 1, 128, 0).astype(np.uint8)
    return groups[place < length[:, None]].tobytes(), length


@F.pandas_udf(T.BinaryType())
def varint(values: pd.Series) -> pd.Series:
    """A bigint as a varint; negative numbers as their unsigned view."""
    flat, length = varint_bytes(values.to_numpy(np.int64))
    ends = np.cumsum(length).tolist()
    return pd.Series([flat[a:b] for a, b in zip([0, *ends], ends)], dtype=object)


@F.pandas_udf(T.LongType())
def from_varint(data: pd.Series) -> pd.Series:
    lengths = data.map(len).to_numpy(np.int64)
    if not len(lengths):
        return pd.Series([], dtype="int64")
    starts = np.cumsum(lengths) - lengths
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64) & np.uint64(127)
    place = np.arange(len(flat)) - np.repeat(starts, lengths)
    return pd.Series(np.add.reduceat(flat << _GROUPS[place], starts).view(np.int64))


@F.pandas_udf(T.LongType())
def wang_hash(values: pd.Series) -> pd.Series:
    """Thomas Wang's 64-bit integer hash; unsigned arithmetic wraps, so the result is the signed view. Its shifts are fixed values."""
    u = np.uint64
    x = values.to_numpy(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        x = ~x + (x << u(21))
        x = x ^ (x >> u(24))
        x = x + (x << u(3)) + (x << u(8))
        x = x ^ (x >> u(14))
        x = x + (x << u(2)) + (x << u(4))
        x = x ^ (x >> u(28))
        x = x + (x << u(31))
    return pd.Series(x.view(np.int64))


#: Runs of a record that are coded together.
PIECE_RUNS = 1 << 12


def encode_records(index: PathIndex) -> DataFrame:
    """(node, first, record): each record as bytes, the outgoing edges first and then the runs.

    A record of many runs comes in pieces of ``PIECE_RUNS`` from run ``first`` on, each with the edges that its own runs take, so that neither a row nor a
    task holds all of it.
    """
    edges = index.edges.select(F.col("src").alias("node"), F.col("dst").alias("successor"), "rank_off")
    first = F.floor(F.col("run_id") / PIECE_RUNS) * PIECE_RUNS
    pieces = index.runs.join(edges, ["node", "successor"]).groupBy("node", first.cast("long").alias("first")).agg(F.array_sort(F.collect_list(F.struct("run_id", "successor", "rank_off", "len"))).alias("runs"))
    return pieces.mapInArrow(_encoded, "node long, first long, record binary")


def _encoded(batches):
    """Pieces are taken one by one, so that only one is in Python at a time."""
    for batch in batches:
        records = [encode_record(batch.column(2)[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(records, pa.binary())], names=["node", "first", "record"])


def encode_record(runs: list[dict]) -> bytes:
    """Runs (successor, rank_off, len) in their order as a record."""
    out_edges = sorted({(r["successor"], r["rank_off"]) for r in runs})
    rank = {dst: i for i, (dst, _) in enumerate(out_edges)}
    data, before = bytearray(), 0
    write_varint(data, len(out_edges))
    for dst, rank_off in out_edges:
        write_varint(data, dst - before)
        before = dst
        write_varint(data, rank_off)
    code = RunCode(len(out_edges))
    for r in runs:
        code.write(data, rank[r["successor"]], r["len"])
    return bytes(data)


def decode_record(data: bytes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The edges (dst, rank_off) and the runs (successor, length)."""
    n, at = read_varint(data, 0)
    edges, dst = [], 0
    for _ in range(n):
        step, at = read_varint(data, at)
        offset, at = read_varint(data, at)
        dst += step
        edges.append((dst, offset))
    runs, code = [], RunCode(n) if n else None
    while at < len(data):
        value, length, at = code.read(data, at)
        runs.append((edges[value][0], length))
    return edges, runs


def decode_records(records: DataFrame) -> DataFrame:
    """(node, run_id, successor, len) of encoded records, one piece after the other."""
    return records.select("node", "first", "record").mapInArrow(_decoded, "node long, run_id long, successor long, len long")


def _decoded(batches):
    names = ["node", "run_id", "successor", "len"]
    for batch in batches:
        for node, first, record in zip(*(batch.column(i) for i in range(3)), strict=True):
            successor, length = np.array(decode_record(record.as_py())[1], np.int64).reshape(-1, 2).T
            columns = [np.full(len(length), node.as_py()), first.as_py() + np.arange(len(length)), successor, length]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def bit_length(value: Column) -> Column:
    """Bits of a non-negative number; 1 for 0."""
    return F.length(F.bin(value)).cast("long")


def megabytes(size: Column) -> Column:
    return size / 1048576.0


def bits_per_char(size: Column, chars: Column) -> Column:
    return size * 8.0 / chars


def range_length(sp: Column, ep: Column) -> Column:
    """Of a closed range; an empty one has ep + 1 = sp at most."""
    return F.greatest(ep + 1 - sp, F.lit(0))


def bound(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(value, high))


def zstd(data: bytes, level: int = 7) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def gaps(values: DataFrame) -> DataFrame:
    """(node, i, gap): sorted offsets of each node as differences to the one before; a node of any size is spread."""
    own = places_within(values.select("node", "off"), "node", ["off"], "i")
    before = own.select("node", (F.col("i") + 1).alias("i"), F.col("off").alias("before"))
    return own.join(before, ["node", "i"], "left").select("node", "i", (F.col("off") - F.coalesce("before", F.lit(0))).alias("gap"))


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))
