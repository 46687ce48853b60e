"""N-gram Jaccard join by grouped prefixes: documents whose sets of word shingles reach a similarity, exactly.

1. One pass counts every shingle of every document. Tasks send sorted arrays of 32-bit keys to shards of the hash space, as many as the
   text needs, so that a shingle costs some four bytes. The most frequent ones, at most ``MARKED``, get a grade by their count. Any
   order of the shingles gives right results; this one, unmarked shingles by hash, then marked ones by grade and hash, puts common
   passages last. Keys that collide can only make it a little worse.
2. A second pass sorts each set by that order. Two sets that reach the similarity share one of the first
   ``n - ceil(similarity * n) + 1`` shingles, the prefix. Documents with identical prefix and size are one group; equal sets are one
   class within it. A group posts its prefix once a task; a document's copies post nothing.
3. Postings of a shingle in several groups make a bucket. Buckets of the same groups are one from there on, with each group's first position.
4. Group pairs are filtered by size and by position: the bucket's leader of each size class against the others, and the leaders
   of neighbouring size classes. What is left is expanded to member classes, filtered by bitmaps of the whole sets, whose differing bits bound
   the overlap from above, and verified on full sets. Links merge components, and a class verifies its likeliest links first.
5. Where a bucket still holds several components, the members of all size classes that can match are compared across components
   block by block, with the same filters, so that no link is lost to the choice of leaders. Members of a bucket's main component
   never meet each other; a task hands on members with a pair left, never the pairs, and a second one verifies them on full sets.

All filters are bounds that hold for every pair that reaches the similarity; what is reported is verified. Sets are compared as
64-bit hashes of shingles, as in ``near_dedup``, which lends classes, sets and components.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing. Shorter texts than ``words`` are
one shingle. Rows of repeated ids are documents of their own, ids may be of any ordered type, and a component of null ids only is
named null. Very long texts are parsed whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .near_dedup import SIMILARITY, WORDS, WordHashes, _sets, bucket_blocks, class_key, contract, one_name_each, same, shingle_set

#: Shingles counted before they are sent, aimed at in a shard, and at least in how many shards.
FLUSH, SHARD, LEAST_SHARDS = 4_000_000, 16_000_000, 64
#: Fewest documents of a shingle that may be marked, and most shingles that are: some 10 MB that every task reads.
RARE, MARKED = 8, 1_000_000
GRADES = 8  # for each doubling of a count
CELL_ROWS = 1000
BROADCAST_IDS = 500_000
SEEN = 300_000

U = np.uint64


def _hashed_sets(batch: pa.RecordBatch, words: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    for text in batch.column(1).to_pylist():
        yield shingle_set(text, words, hashes)


def _count(batches: Iterator[pa.RecordBatch], words: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (shard, keys that were met once, keys met more often, their counts)."""
    hashes, held, size = WordHashes(), [], 0

    def flushed() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held) >> U(32 - bits), return_counts=True)
        edges = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=U) << U(32))
        low, once = keys.astype(np.uint32), counts == 1
        rows = []
        for shard in np.flatnonzero(edges[1:] > edges[:-1]):
            part = slice(edges[shard], edges[shard + 1])
            single = once[part]
            rows.append((int(shard), low[part][single].tobytes(), low[part][~single].tobytes(), counts[part][~single].astype(np.uint32).tobytes()))
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "once", "more", "counts"])

    for batch in batches:
        for s in _hashed_sets(batch, words, hashes):
            held.append(s)
            size += len(s)
            if size >= FLUSH:
                yield flushed()
                held, size = [], 0
    if size:
        yield flushed()


def _frequent(rows: pd.DataFrame, least: int) -> pd.DataFrame:
    """The keys of a shard that ``least`` documents hold, with their counts."""
    array = lambda name: np.frombuffer(b"".join(rows[name]), np.uint32)
    once, counts = np.unique(array("once"), return_counts=True)
    once, counts = once[counts > 1], counts[counts > 1]  # a key met once in one place only adds one to another's count
    more, weights = array("more"), array("counts").astype(np.int64)
    keys = np.unique(np.concatenate([once, more]))
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, np.searchsorted(keys, once), counts)
    np.add.at(total, np.searchsorted(keys, more), weights)
    chosen = total >= least
    return pd.DataFrame({"key": (int(rows["shard"].iloc[0]) << 32) + keys[chosen].astype(np.int64), "n": total[chosen]})


def marked_shingles(docs: DataFrame, scratch: Scratch, words: int, most: int = MARKED, least: int = RARE) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, keys, grades): the most frequent shingles of all documents (id, text), by the first 32 + ``bits`` bits of their hashes.

    Their number is bounded by ``most``: where more reach ``least`` documents, the lowest grades are left unmarked.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_SHARDS.bit_length() - 1, int(log2(1 + size / 6 / SHARD)) + 1)
    counted = docs.mapInArrow(lambda it: _count(it, words, bits), "shard long, once binary, more binary, counts binary")
    grade = F.floor(F.log2("n") * GRADES).cast("int")
    often = scratch.keep(counted.groupBy("shard").applyInPandas(lambda rows: _frequent(rows, least), "key long, n long").select("key", grade.alias("grade")))
    room, lowest = most, 1 << 30
    for found, n in sorted(((r["grade"], r["count"]) for r in often.groupBy("grade").count().collect()), reverse=True):  # a row a grade
        if n > room:
            break
        room, lowest = room - n, found
    chosen = often.filter(F.col("grade") >= lowest).toPandas()  # at most ``most`` rows
    chosen = chosen.sort_values("key")
    return bits, chosen["key"].to_numpy(np.int64).astype(U), chosen["grade"].to_numpy(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n + percent * n // -100 + 1


def prefix(s: np.ndarray, percent: int, bits: int, keys: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the order of grade and hash."""
    take = prefix_length(len(s), percent)
    if not len(keys):
        return s[:take]
    cut = s >> U(32 - bits)
    at = np.minimum(np.searchsorted(keys, cut), len(keys) - 1)
    grade = np.where(keys[at] == cut, grades[at], -1)
    return s[np.argsort(grade, kind="stable")[:take]]


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set as bits of its hashes, two or more a member, in 64-bit words; halves of a bitmap fold into the next smaller one."""
    size = 1 << max(6, (2 * len(s) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    out[s & U(size - 1)] = 1
    return np.packbits(out, bitorder="little").view(U)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


SIGNED = "n long, k1 long, k2 long, g long, prefix binary, bits binary"


def _sign(batches: Iterator[pa.RecordBatch], words: int, percent: int, order: tuple) -> Iterator[pa.RecordBatch]:
    """(id, text) -> its set's size and class; of the first of a group in the task the prefix, of a class the bitmap."""
    hashes, groups, sets = WordHashes(), set(), {}
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for s in _hashed_sets(batch, words, hashes):
            row = [len(s), None, None, None, None, None]
            if len(s):
                row[1:3] = key = class_key(s)
                if key not in sets:
                    if len(sets) >= SEEN:
                        sets.clear()
                        groups.clear()
                    first = prefix(s, percent, *order).tobytes()
                    name = xxhash.xxh3_128_intdigest(first, seed=len(s))
                    sets[key] = g = (name >> 64) - (name >> 127 << 64)
                    if name not in groups:
                        groups.add(name)
                        row[4] = first
                    row[5] = bitmap(s).tobytes()
                row[3] = sets[key]
            for col, x in zip(cols, row, strict=True):
                col.append(x)
        kinds = (*[pa.int64()] * 4, pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n", "k1", "k2", "g", "prefix", "bits"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n, prefix) -> (token, g, n, at)."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            tokens = [np.frombuffer(p, np.int64) for p in part.column(2).to_pylist()]
            sizes = [len(t) for t in tokens]
            spread = [np.repeat(part.column(i).to_numpy(), sizes) for i in (0, 1)]
            at = np.concatenate([np.arange(n, dtype=np.int64) for n in sizes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *map(pa.array, spread), pa.array(at)], names=["token", "g", "n", "at"])


def reaches(overlap, total, percent: int):
    """Whether sets of ``total`` members together may reach the similarity with an overlap of at most ``overlap``."""
    return 100 * overlap >= percent * (total - overlap)


def may_match(a: str, b: str, percent: int) -> Column:
    """Size and position filter for two postings, given as the names of (n, at) structs, of one bucket: that is, from their first common shingle on."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at"))
    return reaches(F.least(na, nb), na + nb, percent) & reaches(most, na + nb, percent)


def _prune(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, n of a, n of b, bits of a, bits of b) -> (a, b, equal) of pairs that their bitmaps allow; ``equal`` bounds the overlap."""
    for batch in batches:
        na, nb = (batch.column(i).to_numpy() for i in (2, 3))
        differ = np.zeros(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            size = min(len(x), len(y)) // 8
            differ[i] = np.bitwise_count(folded(np.frombuffer(x, U), size) ^ folded(np.frombuffer(y, U), size)).sum()
        most = (na + nb - differ) // 2
        ok = pa.array(reaches(most, na + nb, percent))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(most)], names=["a", "b", "equal"]).filter(ok)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [same(np.frombuffer(x, U), np.frombuffer(y, U), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def block_pairs(a: np.ndarray, b: np.ndarray, cell: dict, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows ``a`` and ``b`` of two blocks (or twice of one), the pairs across components that all filters allow, with the bound of their overlap."""
    n, at, zone, comp = (cell[k] for k in ("n", "at", "zone", "c"))
    total = n[a][:, None] + n[b]
    ok = (comp[a][:, None] != comp[b]) & (np.minimum(zone[a][:, None], zone[b]) == 0)
    ok &= reaches(np.minimum(n[a][:, None], n[b]), total, percent) & reaches(np.minimum((n - at)[a][:, None], (n - at)[b]), total, percent)
    if a is b:
        ok &= a[:, None] < b
    rows, cols = np.nonzero(ok)
    out = [(np.zeros(0, np.int64),) * 3]
    bits = cell["bits"]
    size = min((len(bits[i]) for i in np.union1d(a, b)), default=8) // 8
    flat = {i: folded(np.frombuffer(bits[i], U), size) for i in np.union1d(a[rows], b[cols]).tolist()}
    step = max(1, 4_000_000 // size)
    for begin in range(0, len(rows), step):
        x, y = a[rows[begin : begin + step]], b[cols[begin : begin + step]]
        differ = np.bitwise_count(np.stack([flat[i] for i in x.tolist()]) ^ np.stack([flat[i] for i in y.tolist()])).sum(axis=1, dtype=np.int64)
        most = (n[x] + n[y] - differ) // 2
        left = reaches(most, n[x] + n[y], percent)
        out.append((x[left], y[left], most[left]))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _each_block_pair(rows: pd.DataFrame, percent: int) -> tuple[pd.DataFrame, tuple]:
    rows = rows.sort_values(["bh", "bi", "bj"], kind="stable", ignore_index=True)
    bh, bi, bj, block = (rows[c].to_numpy() for c in ("bh", "bi", "bj", "block"))
    cell = {c: rows[c].to_numpy() for c in ("n", "at", "zone", "c")} | {"bits": rows["bits"].tolist()}
    edge = np.flatnonzero((bh[1:] != bh[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
    pairs = []
    for begin, end in zip([0, *edge], [*edge, len(rows)], strict=True):
        at = np.arange(begin, end)
        a = at[block[at] == bi[begin]]
        b = a if bi[begin] == bj[begin] else at[block[at] == bj[begin]]
        pairs.append(block_pairs(a, b, cell, percent))
    return rows, tuple(np.concatenate(p) for p in zip(*pairs, strict=True))


def _open_members(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The members of block pairs that have a pair left."""
    rows, (x, y, _) = _each_block_pair(rows, percent)
    return rows.iloc[np.union1d(x, y).astype(int)]


def _block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """One verified link (a, b) for each two components of a cell that have one; likeliest pairs first."""
    rows, (x, y, most) = _each_block_pair(rows, percent)
    keys, comp = rows["k1"].to_numpy(), rows["c"].to_numpy()
    sets = [np.frombuffer(s, U) for s in rows["s"]]
    parent = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    links = []
    for i in np.argsort(-most, kind="stable"):
        p, q = top(int(comp[x[i]])), top(int(comp[y[i]]))
        if p != q and same(sets[x[i]], sets[y[i]], percent):
            parent[max(p, q)] = min(p, q)
            links.append((keys[x[i]], keys[y[i]]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


class _Join:
    """Candidate pairs of classes in, verified links merged into components."""

    def __init__(self, scratch: Scratch, docs: DataFrame, signed: DataFrame, classes: DataFrame, comps: DataFrame, words: int, percent: int):
        self.scratch, self.docs, self.classes, self.comps, self.words, self.percent = scratch, docs, classes, comps, words, percent
        self.bits = signed.filter("bits is not null").select("k1", "n", "bits")

    def bits_of(self, ends: DataFrame) -> DataFrame:
        return self.bits.join(ends, "k1", "left_semi").dropDuplicates(["k1"])

    def sets_of(self, ends: DataFrame) -> DataFrame:
        """(k, s): the full set of each class ``k1`` in ``ends``, made anew from one of its texts."""
        need = self.scratch.keep(self.classes.join(ends, "k1").select("k1", "k2", "rep"))
        need = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
        words = self.words
        texts = self.docs.join(need, self.docs["id"].eqNullSafe(need["rep"])).select("k1", "k2", "text")
        return self.scratch.keep(texts.mapInArrow(lambda it: _sets(it, words), "k long, s binary").dropDuplicates(["k"]))

    def across(self, pairs: DataFrame) -> DataFrame:
        comp = lambda end: self.comps.select(F.col("x").alias(end), F.col("c").alias("c" + end))
        return pairs.join(comp("a"), "a").join(comp("b"), "b").filter("ca <> cb")

    def merge(self, links: DataFrame) -> None:
        edges = self.across(links).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        moved = contract(self.scratch, edges).select(F.col("x").alias("c"), F.col("c").alias("to"))
        self.comps = self.scratch.keep(self.comps.join(moved, "c", "left").select("x", F.coalesce("to", "c").alias("c")))

    def settle(self, pairs: DataFrame) -> None:
        keep, percent = self.scratch.keep, self.percent
        pairs = keep(pairs)
        if not pairs.limit(1).count():
            return
        bits = keep(self.bits_of(pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()))
        of = lambda end: bits.select(F.col("k1").alias(end), F.col("n").alias("n" + end), F.col("bits").alias("bits" + end))
        alive = keep(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(lambda it: _prune(it, percent), "a long, b long, equal long"))
        sets = self.sets_of(alive.select(F.explode(F.array("a", "b")).alias("k1")).distinct())
        with_set = lambda end: sets.select(F.col("k").alias(end), F.col("s").alias("s" + end))
        for last in (False, False, True):
            cross = self.across(alive)
            if not last:
                cross = cross.groupBy("b").agg(F.max_by("a", F.struct("equal", "a")).alias("a"))
            cross = keep(cross.select("a", "b"))
            if not cross.limit(1).count():
                break
            self.merge(cross.join(with_set("a"), "a").join(with_set("b"), "b").select("a", "b", "sa", "sb").mapInArrow(lambda it: _verify(it, percent), "a long, b long"))
        self.scratch.drop(sets, bits)

    def search(self, members: DataFrame) -> None:
        """Try all pairs across components of the buckets ``members`` (bh, k1, n, at, zone) that may match."""
        percent, keep = self.percent, self.scratch.keep
        labelled = keep(members.join(self.comps.withColumnRenamed("x", "k1"), "k1"))
        sizes = keep(bucket_blocks(labelled))
        total = sizes.agg(F.sum("dealt")).first()[0] or 0
        rest = keep(labelled.join(sizes.drop("dealt"), "bh"))
        dealt = _deal(rest.join(self.bits_of(rest.select("k1").distinct()).select("k1", "bits"), "k1"))
        dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("bh", "bi", "bj"), F.lit(1 + total // CELL_ROWS)))
        left = keep(dealt.groupBy("cell").applyInPandas(lambda rows: _open_members(rows, percent), dealt.schema))
        if left.limit(1).count():
            sets = self.sets_of(left.select("k1").distinct())
            self.merge(left.join(sets.withColumnRenamed("k", "k1"), "k1").groupBy("cell").applyInPandas(lambda rows: _block_links(rows, percent), "a long, b long"))


def _deal(members: DataFrame) -> DataFrame:
    """A row for each pair of blocks (bi, bj) that a member takes part in; the main component's blocks come last and never meet."""
    top = F.coalesce(F.col("c") == F.col("top"), F.lit(False))
    key = F.xxhash64("k1")
    members = members.withColumn("block", F.when(top, F.col("rest_blocks") + F.pmod(key, F.col("main_blocks"))).otherwise(F.pmod(key, F.col("rest_blocks"))).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(top, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("main_blocks")) - 1)))
    return members.select("bh", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "k1", "n", "at", "zone", "c", "bits")


def buckets(postings: DataFrame) -> DataFrame:
    """(bh, g, n, at) of postings (token, g, n, at) that several groups share; tokens of the same groups are one bucket."""
    token = Window.partitionBy("token")
    seen = postings.withColumns({"low": F.min("g").over(token), "high": F.max("g").over(token), "all": F.bit_xor(F.xxhash64("g")).over(token), "size": F.count(F.lit(1)).over(token)})
    return seen.filter("low <> high").groupBy(F.xxhash64("low", "high", "all", "size").alias("bh"), "g").agg(F.min("n").alias("n"), F.min("at").alias("at"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY, most_marked: int = MARKED, least_marked: int = RARE) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id)."""
    scratch = Scratch(docs.sparkSession)
    keep = scratch.keep
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(marked_shingles(docs, scratch, words, most_marked, least_marked))  # at most ``most_marked`` keys
    signed = keep(docs.mapInArrow(lambda it: _sign(it, words, percent, order.value), f"id {kind}, {SIGNED}"))
    signed, classes = one_name_each(signed, scratch, [F.min("g").alias("g")])

    postings = signed.filter("prefix is not null").select("g", "n", "prefix").mapInArrow(_postings, "token long, g long, n long, at long")
    shared = keep(buckets(postings))
    own = keep(classes.groupBy("g").agg(F.min("k1").alias("first"), F.count(F.lit(1)).alias("classes")))
    crowds = own.filter("classes > 1")
    step = log(1.01 * 100 / percent)  # sizes that may match are in the same or in neighbouring classes
    zoned = shared.withColumn("zone", F.floor(F.log("n") / step))

    leads = zoned.groupBy("bh", "zone").agg(F.min(F.struct("g", "n", "at")).alias("lead"))
    led = zoned.select("bh", "zone", F.struct("g", "n", "at").alias("own")).join(leads, ["bh", "zone"])
    above = leads.select("bh", "zone", F.col("lead").alias("own")).join(leads.withColumn("zone", F.col("zone") + 1), ["bh", "zone"])
    groups = led.unionByName(above).filter((F.col("own.g") != F.col("lead.g")) & may_match("lead", "own", percent)).select(F.col("lead.g").alias("ga"), F.col("own.g").alias("gb")).distinct()
    firsts = own.select(F.col("g").alias("ga"), F.col("first").alias("a"))
    of_b = classes.select(F.col("g").alias("gb"), F.col("k1").alias("b"))
    expanded = groups.join(firsts, "ga").join(of_b, "gb").select("a", "b")
    within = crowds.select(F.col("g").alias("gb"), F.col("first").alias("a")).join(of_b, "gb").filter("a <> b").select("a", "b")

    members = classes.select("k1", "g", F.col("n").alias("size")).join(zoned, "g").select("bh", "k1", F.col("size").alias("n"), "at", "zone")
    alone = classes.select("k1", "g", "n").join(crowds, "g").select(F.xxhash64("g", F.lit("crowd")).alias("bh"), "k1", "n", F.lit(0).cast("long").alias("at"), F.floor(F.log("n") / step).alias("zone"))
    # A bucket is searched zone by zone, with the next zone's members beside it; only pairs with a member of the zone itself are tried there.
    members = keep(members.unionByName(alone).select("bh", "k1", "n", "at", "zone"))
    comps = keep(members.select(F.col("k1").alias("x")).distinct().withColumn("c", F.col("x")))
    join = _Join(scratch, docs, signed, classes, comps, words, percent)
    join.settle(expanded.union(within).distinct())
    beside = members.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1))))
    join.search(beside.select(F.xxhash64("bh", F.col("zone") - F.col("up")).alias("bh"), "k1", "n", "at", F.col("up").alias("zone")).dropDuplicates(["bh", "k1", "zone"]))

    named = classes.join(join.comps, classes["k1"] == join.comps["x"], "left").withColumn("c", F.coalesce("c", "k1"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = keep(named.select("k1", "c").join(least, "c").select("k1", "component_id"))
    out = signed.select("id", "n", "k1").join(named, "k1", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs
), sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid), shared AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach(rid, other) AS (
  SELECT rid, rid FROM docs UNION SELECT r.rid, l.y FROM reach r JOIN links l ON l.x = r.other
), named AS (SELECT r.rid, min(d.doc_id) AS component_id FROM reach r JOIN docs d ON d.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM docs JOIN named USING (rid) LEFT JOIN sizes USING (rid)
"""
