"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

``LineIndex`` holds a written table that says, for every line key, in how many documents it stands and the largest id among them, and signed
changes by key and id, so that deleting a document is the exact inverse of inserting it; both follow a change without reading earlier documents. The keys that reach ``MIN_DOCS`` are held by cuckoo
filters, one a shard of the key space, which follow the counts by insertions and deletions and are rebuilt from them where they
overflow. A scan probes the filters shard by shard and sends only lines they hold on to the exact join that decides; a filter's false
positive costs a row, never a line.

Lines are dealt to their shard, and the lines of a shard in groups of about ``GROUP_LINES``, each of which meets a copy of the shard's
filter; so a key in a third of all documents is spread, filters are never collected, and a task holds one filter and one group.
Keys are counted with partial sums, and the join with the one row of the table can be split by AQE.

Edge cases: a null or empty text is one empty line; every row counts as a document, also if ids
repeat, and rows of the largest id all keep the line; ids may be of any type that has an order; a null id sorts below every other and a
key that only stands under null ids stays; deleting what an index does not hold, or holds fewer times, takes away what it holds; an
empty table gives no rows. Other columns are carried along by name; ``n_lines``, ``n_dropped`` and names beginning with ``_ld_`` are
reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

MIN_DOCS, MIN_CHARS = 3, 20
#: Keys of a shard, and lines that are probed together.
SHARD_KEYS, GROUP_LINES = 8192, 10_000
SLOTS, MAX_KICKS = 4, 500
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line stripped and A-Z lower-cased; None if it is too short to count."""
    key = line.strip(SPACE)
    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
        return None
    return key.lower()


def key_hash(key: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    hi, lo = divmod(xxhash.xxh3_128_intdigest(key), 1 << 64)
    return hi - (hi >> 63 << 64), lo - (lo >> 63 << 64)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports insertion, deletion and membership."""

    def __init__(self, n_buckets: int, slots: np.ndarray | None = None):
        assert n_buckets & (n_buckets - 1) == 0
        self.slots = np.zeros((n_buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def for_keys(cls, n_keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(n_keys, 1) / SLOTS / 0.8)))))

    @staticmethod
    def places(h2: np.ndarray, n_buckets: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys, given their low hashes."""
        h = h2.astype(np.uint64)
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint64)
        mask = np.asarray(n_buckets, np.uint64) - np.uint64(1)
        first = h & mask
        return mark.astype(np.uint16), first, first ^ (CuckooFilter.jump(mark) & mask)

    @staticmethod
    def jump(mark: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)

    def insert(self, h2: int) -> bool:
        """False if no place is found; the filter then lacks one key and must be rebuilt larger."""
        n = len(self.slots)
        mark, a, b = (x[0] for x in self.places(np.array([h2], np.int64).view(np.uint64), n))
        for at in (a, b):
            free = np.flatnonzero(self.slots[at] == 0)
            if free.size:
                self.slots[at, free[0]] = mark
                return True
        at = int(b)
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            mark, self.slots[at, slot] = self.slots[at, slot], mark
            at ^= int(self.jump(np.array([mark]))[0]) & (n - 1)
            free = np.flatnonzero(self.slots[at] == 0)
            if free.size:
                self.slots[at, free[0]] = mark
                return True
        return False

    def delete(self, h2: int) -> bool:
        mark, a, b = (x[0] for x in self.places(np.array([h2], np.int64).view(np.uint64), len(self.slots)))
        for at in (a, b):
            held = np.flatnonzero(self.slots[at] == mark)
            if held.size:
                self.slots[at, held[0]] = 0
                return True
        return False

    def holds(self, h2: np.ndarray) -> np.ndarray:
        """Whether each key may be in the filter."""
        mark, a, b = self.places(h2.view(np.uint64), len(self.slots))
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(axis=1)

    @classmethod
    def read(cls, slots: bytes) -> CuckooFilter:
        held = np.frombuffer(slots, np.uint16).reshape(-1, SLOTS)
        return cls(len(held), held)

    @classmethod
    def build(cls, h2s: np.ndarray) -> CuckooFilter:
        out = cls.for_keys(len(h2s))
        while not all(out.insert(int(h)) for h in h2s):
            out = cls(2 * len(out.slots))
        return out


def _hashed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hash of the text, text as bytes) -> each distinct counting line of each text."""
    for batch in batches:
        sizes, hashes = [], []
        for text in batch.column(2).to_pylist():
            keys = {k for k in map(line_key, text.split(b"\n")) if k is not None}
            sizes.append(len(keys))
            hashes += map(key_hash, keys)
        of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        h1, h2 = zip(*hashes, strict=True) if hashes else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["_ld_id", "_ld_text", "h1", "h2"])


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash of the text, h1, h2) for the distinct counting lines of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_ld_id"), F.xxhash64(text).alias("_ld_text"), text.cast("binary").alias("_ld_bytes"))
    return rows.mapInArrow(_hashed_lines, f"_ld_id {docs.schema[id_col].dataType.simpleString()}, _ld_text long, h1 long, h2 long")


def reference_counts(lines: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, last): exact counts and the largest id of each key."""
    return lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("_ld_id").alias("last"))


def build_filters(keys: DataFrame, n_shards: int) -> DataFrame:
    """(shard, slots): a cuckoo filter for each shard of the keys (h1, h2); a shard has about ``SHARD_KEYS`` keys."""
    build = lambda pdf: pdf.iloc[:1][["shard"]].assign(slots=CuckooFilter.build(pdf["h2"].to_numpy()).slots.tobytes())
    return keys.select(F.pmod("h1", F.lit(n_shards)).alias("shard"), "h2").groupBy("shard").applyInPandas(build, "shard long, slots binary")


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame, n_shards: int, keys: DataFrame | None = None) -> DataFrame:
    """Follow a change of the table: insert the keys that reached the threshold and delete those that fell below it.

    ``keys`` (h1, h2) are all keys that reach it after the change; a shard that its additions overflow is rebuilt from them.
    Without them such a shard is an error, unless it had no filter: then its additions are all it holds.
    """

    strict = keys is None

    def follow(old, change):
        import pandas as pd

        if not len(old):
            new = change["h2"][change["sign"] > 0].to_numpy()
            return pd.DataFrame({"shard": [change["shard"].iloc[0]], "slots": [CuckooFilter.build(new).slots.tobytes()]})
        slots = np.frombuffer(old["slots"].iloc[0], np.uint16).reshape(-1, SLOTS).copy()
        out, fits = CuckooFilter(len(slots), slots), True
        for h2 in change["h2"][change["sign"] < 0]:
            out.delete(int(h2))
        for h2 in change["h2"][change["sign"] > 0]:
            fits = fits and out.insert(int(h2))
        if not fits and strict:
            raise ValueError("a filter overflows; give the keys to rebuild it from")
        return pd.DataFrame({"shard": [old["shard"].iloc[0]], "slots": [out.slots.tobytes() if fits else None]})

    sign = lambda df, s: df.select(F.pmod("h1", F.lit(n_shards)).alias("shard"), "h2", F.lit(s).alias("sign"))
    changes = sign(added, 1).union(sign(removed, -1))
    moved = filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(follow, "shard long, slots binary")
    if keys is None:
        return moved
    moved = Scratch(filters.sparkSession).keep(moved)
    full = moved.filter("slots is null").select("shard")
    theirs = keys.withColumn("shard", F.pmod("h1", F.lit(n_shards))).join(full, "shard", "left_semi").select("h1", "h2")
    return moved.filter("slots is not null").unionByName(build_filters(theirs, n_shards))


#: Written changes that an index may pile up before it puts them together.
MAX_PARTS = 8


def _by_id(lines: DataFrame) -> DataFrame:
    """(h1, h2, _ld_id, n): how often each id holds each key."""
    return lines.groupBy("h1", "h2", "_ld_id").agg(F.count(F.lit(1)).alias("n"))


def _counted(held: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, last) of (h1, h2, _ld_id, n)."""
    return held.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("_ld_id").alias("last"))


class LineIndex:
    """An incremental index: a written table of exact counts by key, and written signed changes by key and id behind it.

    An insertion adds its own counts to the table's rows by key; the lines of earlier documents are not looked at. A deletion takes away what
    the index holds: only the keys of the deleted lines are looked up in the changes, for the largest id that is left to each. Neither
    reads an earlier document again, and no plan grows with the number of changes, which are put together once there are ``MAX_PARTS``.
    """

    def __init__(self, scratch: Scratch, parts: list[DataFrame], table: DataFrame):
        self.scratch, self.table = scratch, table
        self.parts = parts if len(parts) <= MAX_PARTS else [scratch.keep(self._sums(parts))]

    @classmethod
    def of(cls, docs: DataFrame, *cols: str) -> LineIndex:
        scratch = Scratch(docs.sparkSession)
        part = scratch.keep(_by_id(hashed_lines(docs, *cols)))
        return cls(scratch, [part], scratch.keep(_counted(part)))

    @staticmethod
    def _sums(parts: list[DataFrame], keys: DataFrame | None = None) -> DataFrame:
        """(h1, h2, _ld_id, n) after all changes, of some keys (h1, h2) only if they are given."""
        found = None
        for part in parts:
            own = part if keys is None else part.join(keys, ["h1", "h2"], "left_semi")
            found = own if found is None else found.unionByName(own)
        return found.groupBy("h1", "h2", "_ld_id").agg(F.sum("n").alias("n")).filter("n > 0")

    def insert(self, docs: DataFrame, *cols: str) -> LineIndex:
        part = self.scratch.keep(_by_id(hashed_lines(docs, *cols)))
        both = self.table.unionByName(_counted(part)).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"))
        return LineIndex(self.scratch, [*self.parts, part], self.scratch.keep(both))

    def delete(self, docs: DataFrame, *cols: str) -> LineIndex:
        """Take away what the index holds of ``docs``; a row that was not inserted changes nothing."""
        gone = self.scratch.keep(_by_id(hashed_lines(docs, *cols)))
        keys = self.scratch.keep(gone.select("h1", "h2").distinct())
        held = self._sums(self.parts, keys).withColumn("gone", F.lit(0).cast("long")).unionByName(gone.select("h1", "h2", "_ld_id", F.lit(0).cast("long").alias("n"), F.col("n").alias("gone")))
        held = self.scratch.keep(held.groupBy("h1", "h2", "_ld_id").agg(F.sum("n").alias("n"), F.sum("gone").alias("gone")).filter("n > 0"))
        minus = self.scratch.keep(held.filter("gone > 0").select("h1", "h2", "_ld_id", (-F.least("n", "gone")).alias("n")))
        left = _counted(held.withColumn("n", F.col("n") - F.least("n", "gone")).filter("n > 0"))
        table = self.table.join(keys, ["h1", "h2"], "left_anti").unionByName(left)
        return LineIndex(self.scratch, [*self.parts, minus], self.scratch.keep(table))

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs, last), as written."""
        return self.table


def _probe(lines: pa.Table, filters: pa.Table) -> pa.Table:
    """The lines of a group that the filter of their shard holds."""
    own = lines.select(["_ld_id", "_ld_text", "h1", "h2"])
    if not filters.num_rows or not own.num_rows:
        return own.slice(0, 0)
    return own.filter(pa.array(CuckooFilter.read(filters.column("slots")[0].as_py()).holds(own.column("h2").to_numpy())))


def held_lines(lines: DataFrame, counts: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """The rows of ``lines`` whose key a filter (shard, slots) holds; ``counts`` say how many lines a shard has to deal out."""
    shard = F.pmod("h1", F.lit(n_shards)).alias("_ld_shard")
    sizes = counts.groupBy(shard).agg(F.ceil(F.sum("n_docs") / GROUP_LINES).cast("int").alias("_ld_groups"))
    dealt = lines.withColumn("_ld_shard", shard).join(sizes, "_ld_shard")
    dealt = dealt.withColumn("_ld_group", F.pmod(F.xxhash64("_ld_id", "_ld_text", "h2"), F.col("_ld_groups"))).drop("_ld_groups")
    copies = filters.select(F.col("shard").alias("_ld_shard"), "slots").join(sizes, "_ld_shard")
    copies = copies.select("_ld_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ld_groups").cast("long") - 1)).alias("_ld_group"), "slots")
    key = ["_ld_shard", "_ld_group"]
    return dealt.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(_probe, lines.schema)


def _without_lines(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *own, drops = batch.columns
        texts, n_lines, n_dropped = [], [], []
        for text, drop in zip(own[text_at].to_pylist(), drops.to_pylist(), strict=True):
            lines = (text or "").split("\n")
            kept = lines
            if drop:
                drop = {(d["h1"], d["h2"]) for d in drop}
                keys = (line_key(x.encode()) for x in lines)
                kept = [x for x, k in zip(lines, keys, strict=True) if k is None or key_hash(k) not in drop]
            texts.append("\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        own[text_at] = pa.array(texts, pa.string())
        names = [*batch.schema.names[:-1], "n_lines", "n_dropped"]
        yield pa.RecordBatch.from_arrays([*own, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=names)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, index: LineIndex | None = None, filters: tuple[DataFrame, int] | None = None
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and ``n_lines`` (before) and ``n_dropped``.

    ``index`` holds ``docs`` and maybe more, so that inserted documents are judged against all of it without a recount; without it
    the lines of ``docs`` are counted. ``filters``, with their number of shards, hold at least the index's keys that reach ``min_docs``.
    """
    if filters is not None and index is None:
        raise ValueError("filters need the index that they follow")
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(reference_counts(hashed_lines(docs, id_col, text_col))) if index is None else index.counts()
    repeated = counts.filter(F.col("n_docs") >= min_docs)
    if filters is None:
        n_shards = max(1, -(-repeated.count() // SHARD_KEYS))
        filters = build_filters(repeated, n_shards), n_shards
    found = held_lines(hashed_lines(docs, id_col, text_col), counts, *filters).join(repeated, ["h1", "h2"])
    drops = found.filter("last is not null and (_ld_id is null or _ld_id < last)").groupBy("_ld_id", "_ld_text").agg(F.collect_set(F.struct("h1", "h2")).alias("_ld_drop"))
    own = docs.withColumn("_ld_mark", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = own.join(drops, own[id_col].eqNullSafe(drops["_ld_id"]) & (own["_ld_mark"] == drops["_ld_text"]), "left").select(*docs.columns, "_ld_drop")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = docs.columns.index(text_col)
    return joined.mapInArrow(lambda it: _without_lines(it, at), schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), hot AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT rid) >= 3
), judged AS (
  SELECT k.*, last IS NOT NULL AND (doc_id IS NULL OR doc_id < last) AS dropped FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY rid
"""
