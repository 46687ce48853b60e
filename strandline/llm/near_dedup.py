"""MinHash near-dedup with sequential Bayesian verification.

1. One pass turns each text into its set of hashed word shingles, a fingerprint of the whole set, and for
   the first text of each set in a task a MinHash signature and its band hashes. Texts of equal
   sets form a class; only classes are compared.
2. Classes that share a band are candidates. A band's bucket is not paired with itself: each member
   meets the leader of its salt, and those leaders meet the bucket's, so the pairs number at most the members.
3. A pair's signatures are compared batch by batch. After each batch the posterior of "similarity
   reaches the threshold" under a uniform prior is bounded, and a pair below ``MISS`` is pruned. Survivors
   are verified on their full sets. In each round a class verifies its likeliest link into another
   component only, which is all a component needs; the last round takes every pair that is left.
4. Where a bucket still holds several components, all its pairs across components are tried as well, so that
   no link is lost to the choice of leaders. A bucket is cut into blocks of bounded size; a task compares the
   signatures of two blocks in memory, each pair in the first band it shares, and hands on the members that have a pair left,
   never the pairs; a second task verifies these on their sets and returns one link for each two components.
   The members of a large bucket's main component never meet each other: they are dealt to the blocks of the rest only.

Components come from rounds of minimum labels with pointer jumping over the contracted links.
Everything is keyed by hashes and aggregated before it is shuffled; the hot keys, copies, are one class.

With bands of 6 in 216 hashes a pair at the threshold 0.8 misses all bands with a probability of 2e-5, and
one above it less. Sets are compared as 64-bit hashes of shingles. A class is told apart by a 128-bit hash of its set and
named by half of it; where classes share a name, all but one of them are renamed before anything is joined by it.

Edge cases: a null or empty text, or one without words, has an empty set, links with nothing and is kept.
Rows of repeated ids are documents of their own in the comparison; one id may so stand in several
components. Ids may be of any type that has an order. A null id can't name a component: a component of null ids only is named null
and keeps all its rows.
An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

WORDS, SIMILARITY = 5, 80
BANDS, ROWS = 36, 6
HASHES = BANDS * ROWS
BATCH = 36
#: Chance of pruning a pair that reaches the threshold.
MISS = 1e-6
SALTS = 16
#: Members, and shingles of members, of one block of a bucket.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 4_000_000
CELL_ROWS = 1000
BROADCAST_IDS = 500_000
CACHE_WORDS = 300_000

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


#: One permutation of 32-bit values for each hash: exclusive or, then an odd factor.
FACTORS = (_mix(np.arange(1, HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32) | np.uint32(1)
FLIPS = (_mix(np.arange(1001, HASHES + 1001, dtype=U) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32)


class WordHashes(dict):
    """64-bit hashes of words; bounded, since it only saves time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; of the whole sequence if it is shorter."""
    found = text.lower().split()  # both only touch ASCII
    h = np.fromiter(map(hashes.__getitem__, found), U, len(found))
    if not len(h):
        return h
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, U)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = _mix(out * U(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def class_key(shingles: np.ndarray, name_bits: int = 64) -> tuple[int, int]:
    """The name of a set's class and what tells it from others of that name."""
    a, b = divmod(xxhash.xxh3_128_intdigest(shingles.tobytes()), 1 << 64)
    a >>= 64 - name_bits
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    top = (shingles >> U(32)).astype(np.uint32)[:, None]
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(top), 512):
        part = top[i : i + 512] ^ FLIPS
        part *= FACTORS
        np.minimum(low, part.min(axis=0), out=low)
    return low


def band_hashes(short: np.ndarray) -> np.ndarray:
    parts, out = short.reshape(BANDS, ROWS).astype(U), np.arange(BANDS, dtype=U)
    for k in range(ROWS):
        out = _mix(out ^ parts[:, k])
        with np.errstate(over="ignore"):
            out = out * U(0x9E3779B97F4A7C15) + U(k)
    return out.view(np.int64)


SIGNED = "n long, k1 long, k2 long, sig binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch], words: int, name_bits: int) -> Iterator[pa.RecordBatch]:
    hashes, seen = WordHashes(), set()
    for batch in batches:
        cols: list[list] = [[] for _ in range(5)]
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, words, hashes)
            row = [len(s), None, None, None, None]
            if len(s):
                row[1:3] = key = class_key(s, name_bits)
                if key not in seen:
                    if len(seen) >= CACHE_WORDS:
                        seen.clear()
                    seen.add(key)
                    short = (_mix(min_hashes(s).astype(U)) >> U(48)).astype(np.uint16)
                    row[3:] = short.tobytes(), band_hashes(short)
            for col, x in zip(cols, row, strict=True):
                col.append(x)
        keys = batch.columns[2:]
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *keys], names=["id", "n", "k1", "k2", "sig", "bands", *batch.schema.names[2:]])


def least_equal(threshold: float, miss: float = MISS) -> list[int]:
    """After each batch, the fewest equal hashes whose posterior P(similarity >= threshold) is not below ``miss``.

    Under a uniform prior that posterior after m of n equal hashes is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _prune(batches: Iterator[pa.RecordBatch], least: list[int]) -> Iterator[pa.RecordBatch]:
    """(a, b, sig of a, sig of b) -> (a, b, equal) of the pairs that no batch prunes."""
    for batch in batches:
        sig = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3)]
        alive, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for k, need in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            equal[alive] += (sig[0][alive, part] == sig[1][alive, part]).sum(axis=1)
            alive = alive[equal[alive] >= need]
        out = batch.select([0, 1]).take(pa.array(alive))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(equal[alive])], names=["a", "b", "equal"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(class, the second half of its hash, text) -> (class, its set), if the text is of that class."""
    hashes = WordHashes()
    for batch in batches:
        ids, sets = [], []
        for k, rest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = shingle_set(text, words, hashes)
            if len(s) and class_key(s)[1] == rest:
                ids.append(k)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["k", "s"])


def same(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of hashes reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def block_pairs(a: np.ndarray, b: np.ndarray, sig: np.ndarray, comp: np.ndarray, n: np.ndarray, band: int, least: list[int], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows ``a`` and ``b`` of two blocks of a bucket (or twice of one), the pairs across components that no
    batch prunes and that share no band before this one, with their equal hashes."""
    ok = (comp[a][:, None] != comp[b]) & (100 * np.minimum(n[a][:, None], n[b]) >= percent * np.maximum(n[a][:, None], n[b]))
    if a is b:
        ok &= a[:, None] < b
    rows, cols = np.nonzero(ok)
    out = [(np.zeros(0, np.int64),) * 3]
    for begin in range(0, len(rows), 50_000):
        x, y = a[rows[begin : begin + 50_000]], b[cols[begin : begin + 50_000]]
        equal = np.zeros(len(x), np.int64)
        for k, need in enumerate(least):
            same_hash = sig[x, k * BATCH : (k + 1) * BATCH] == sig[y, k * BATCH : (k + 1) * BATCH]
            equal = equal + same_hash.sum(axis=1)
            alive = equal >= need
            earlier = min(BATCH // ROWS, band - k * (BATCH // ROWS))
            if earlier > 0:
                alive &= ~same_hash[:, : earlier * ROWS].reshape(-1, earlier, ROWS).all(axis=2).any(axis=1)
            x, y, equal = x[alive], y[alive], equal[alive]
            if not len(x):
                break
        out.append((x, y, equal))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _each_block_pair(rows, least: list[int], percent: int):
    """The pairs of each block pair in a cell of them: (x, y, equal) as places in ``rows``, and the table's columns."""
    rows = rows.sort_values(["bh", "bi", "bj"], kind="stable", ignore_index=True)
    bh, bi, bj, block = (rows[c].to_numpy() for c in ("bh", "bi", "bj", "block"))
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, HASHES)
    comp, n, band = rows["c"].to_numpy(), rows["n"].to_numpy(), rows["band"].to_numpy()
    edge = np.flatnonzero((bh[1:] != bh[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
    pairs = []
    for begin, end in zip([0, *edge], [*edge, len(rows)], strict=True):
        at = np.arange(begin, end)
        a = at[block[at] == bi[begin]]
        b = a if bi[begin] == bj[begin] else at[block[at] == bj[begin]]
        pairs.append(block_pairs(a, b, sig, comp, n, int(band[begin]), least, percent))
    return rows, tuple(np.concatenate(p) for p in zip(*pairs, strict=True))


def _open_members(rows, least: list[int], percent: int):
    """The members of block pairs that have a pair left."""
    rows, (x, y, _) = _each_block_pair(rows, least, percent)
    return rows.iloc[np.union1d(x, y).astype(int)]


def _block_links(rows, least: list[int], percent: int):
    """One verified link (a, b) for each two components of a cell that have one; likeliest pairs first."""
    import pandas as pd

    rows, (x, y, equal) = _each_block_pair(rows, least, percent)
    keys, comp = rows["k1"].to_numpy(), rows["c"].to_numpy()
    sets = [np.frombuffer(s, U) for s in rows["s"]]
    parent = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    links = []
    for i in np.argsort(-equal, kind="stable"):
        p, q = top(int(comp[x[i]])), top(int(comp[y[i]]))
        if p != q and same(sets[x[i]], sets[y[i]], percent):
            parent[max(p, q)] = min(p, q)
            links.append((keys[x[i]], keys[y[i]]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [same(np.frombuffer(x, U), np.frombuffer(y, U), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def contract(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(x, c): the smallest node that each node of ``edges`` (a, b) reaches."""
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("c")).select(F.col("a").alias("x"), "c"))
    while True:
        near = both.join(labels.withColumnRenamed("x", "b"), "b").groupBy(F.col("a").alias("x")).agg(F.min("c").alias("m"))
        low = labels.join(near, "x").select("x", F.least("c", "m").alias("m"), F.col("c").alias("old"))
        up = labels.select(F.col("x").alias("m"), F.col("c").alias("top"))
        new = scratch.keep(low.join(up, "m").select("x", F.least("m", "top").alias("c"), (F.least("m", "top") < F.col("old")).alias("moved")))
        moved = new.filter("moved").limit(1).count()
        labels = new.select("x", "c")
        if not moved:
            return labels


def bucket_blocks(labelled: DataFrame) -> DataFrame:
    """(bh, top, main_blocks, rest_blocks, dealt): how the buckets of ``labelled`` (bh, k1, n, c) that hold several components are cut.

    A bucket that fits one block is one (``top`` is null then); of a larger one the main component ``top`` and the rest have blocks
    of their own. ``dealt`` counts the rows that ``deal_blocks`` makes of it: in proportion to the bucket for each block of the rest.
    """
    parts = labelled.groupBy("bh", "c").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    buckets = parts.groupBy("bh").agg(F.count(F.lit(1)).alias("components"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"), F.max(F.struct("size", "c", "shingles")).alias("main")).filter("components > 1")
    blocks = lambda size, shingles: F.greatest(F.ceil(size / BLOCK_MEMBERS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    whole = blocks(F.col("size"), F.col("shingles")) == 1
    main, rest = blocks(F.col("main.size"), F.col("main.shingles")), blocks(F.col("size") - F.col("main.size"), F.col("shingles") - F.col("main.shingles"))
    cut = buckets.select(
        "bh", "size", F.when(~whole, F.col("main.c")).alias("top"), F.when(~whole, F.col("main.size")).otherwise(0).alias("main_size"),
        F.when(whole, 0).otherwise(main).alias("main_blocks"), F.when(whole, 1).otherwise(rest).alias("rest_blocks"),
    )
    dealt = F.col("main_size") * F.col("rest_blocks") + (F.col("size") - F.col("main_size")) * (F.col("main_blocks") + F.col("rest_blocks"))
    return cut.select("bh", "top", "main_blocks", "rest_blocks", dealt.alias("dealt"))


def deal_blocks(members: DataFrame) -> DataFrame:
    """A row for each pair of blocks (bi, bj) that a member takes part in; blocks of the rest are numbered first."""
    key, top = F.xxhash64("k1"), F.coalesce(F.col("c") == F.col("top"), F.lit(False))
    members = members.withColumn("block", F.when(top, F.col("rest_blocks") + F.pmod(key, F.col("main_blocks"))).otherwise(F.pmod(key, F.col("rest_blocks"))).cast("int"))
    others = F.when(top, F.col("rest_blocks")).otherwise(F.col("rest_blocks") + F.col("main_blocks"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    dealt = dealt.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    return dealt.select("bh", "band", "bi", "bj", "block", "k1", "n", "c", "sig")


def one_name_each(signed: DataFrame, scratch: Scratch, first: list) -> tuple[DataFrame, DataFrame]:
    """``signed`` and its classes (k1, k2, rep, n), with a ``k1`` that no two classes share."""
    while True:
        grouped = signed.filter("k1 is not null").groupBy("k1")
        classes = scratch.keep(grouped.agg(F.min("k2").alias("k2"), F.max("k2").alias("k2_last"), F.min("id").alias("rep"), F.min("n").alias("n"), *first))
        shared = classes.filter("k2 <> k2_last").select("k1", F.col("k2").alias("owner"))
        if not shared.limit(1).count():
            return signed, classes
        renamed = signed.join(shared, "k1", "left").withColumn("k1", F.when(F.col("k2") != F.col("owner"), F.xxhash64("k1", "k2")).otherwise(F.col("k1")))
        signed = scratch.keep(renamed.select(*signed.columns))


class _Linker:
    """Candidates in, verified links merged into components of the classes."""

    def __init__(self, scratch: Scratch, docs: DataFrame, signed: DataFrame, classes: DataFrame, comps: DataFrame, words: int, percent: int):
        self.scratch, self.docs, self.signed, self.classes, self.comps = scratch, docs, signed, classes, comps
        self.words, self.percent, self.least = words, percent, least_equal(percent / 100)

    def across(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components, with these as ``ca`` and ``cb``."""
        comp = lambda end: self.comps.select(F.col("x").alias(end), F.col("c").alias("c" + end))
        return pairs.join(comp("a"), "a").join(comp("b"), "b").filter("ca <> cb")

    def settle(self, pairs: DataFrame) -> None:
        keep = self.scratch.keep
        pairs = keep(pairs)
        if not pairs.limit(1).count():
            return
        ends = pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
        sig = self.signed.filter("sig is not null").select("k1", "sig").join(ends, "k1", "left_semi").dropDuplicates(["k1"])
        sig = keep(sig)
        of = lambda end: sig.select(F.col("k1").alias(end), F.col("sig").alias("sig_" + end))
        least = self.least
        alive = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lambda it: _prune(it, least), "a long, b long, equal long")
        alive = keep(alive)
        sets = self.full_sets(alive.select(F.explode(F.array("a", "b")).alias("k1")).distinct())
        for last in (False, False, True):
            cross = self.across(alive)
            if not last:
                cross = cross.groupBy("b").agg(F.max_by("a", F.struct("equal", "a")).alias("a"))
            cross = keep(cross.select("a", "b"))
            if not cross.limit(1).count():
                break
            self.merge(self.verified(cross, sets))
        self.scratch.drop(sets, sig)

    def full_sets(self, ends: DataFrame) -> DataFrame:
        """(k, s): the full set of each class ``k1`` in ``ends``, made anew from one of its texts."""
        need = self.scratch.keep(self.classes.join(ends, "k1").select("k1", "k2", "rep"))
        need = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
        words = self.words
        texts = self.docs.join(need, self.docs["id"].eqNullSafe(need["rep"])).select("k1", "k2", "text")
        return self.scratch.keep(texts.mapInArrow(lambda it: _sets(it, words), "k long, s binary").dropDuplicates(["k"]))

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        of = lambda end: sets.select(F.col("k").alias(end), F.col("s").alias("s" + end))
        percent = self.percent
        return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(lambda it: _verify(it, percent), "a long, b long")

    def search_buckets(self, members: DataFrame) -> None:
        """Try all pairs across components that share a bucket, block by block."""
        least, percent = self.least, self.percent
        labelled = members.join(self.comps.withColumnRenamed("x", "k1"), "k1")
        # Written, so that the join below has a plain scan on both sides and AQE can split a bucket with very many members.
        labelled = self.scratch.keep(labelled)
        sizes = self.scratch.keep(bucket_blocks(labelled))
        total = sizes.agg(F.sum("dealt")).first()[0] or 0
        rest = self.scratch.keep(labelled.join(sizes.drop("dealt"), "bh"))
        sig = self.signed.filter("sig is not null").select("k1", "sig").join(rest.select("k1").distinct(), "k1", "left_semi").dropDuplicates(["k1"])
        dealt = deal_blocks(rest.join(sig, "k1"))
        # Block pairs are dealt to cells of some thousand rows; a large one fills a cell by itself.
        dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("bh", "bi", "bj"), F.lit(1 + total // CELL_ROWS)))
        left = self.scratch.keep(dealt.groupBy("cell").applyInPandas(lambda rows: _open_members(rows, least, percent), dealt.schema))
        if left.limit(1).count():
            sets = self.full_sets(left.select("k1").distinct())
            with_sets = left.join(sets.withColumnRenamed("k", "k1"), "k1")
            self.merge(with_sets.groupBy("cell").applyInPandas(lambda rows: _block_links(rows, least, percent), "a long, b long"))

    def merge(self, links: DataFrame) -> None:
        edges = self.across(links).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        moved = contract(self.scratch, edges).select(F.col("x").alias("c"), F.col("c").alias("to"))
        self.comps = self.scratch.keep(self.comps.join(moved, "c", "left").select("x", F.coalesce("to", "c").alias("c")))


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = SIMILARITY, row_col: str | None = None, name_bits: int = 64
) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id, kept).

    With ``row_col``, a long that is unique to each row, also that column and ``chosen``: true for one row of each component, of its
    smallest id (nulls last) and then of the smallest ``row_col``, and for each row with an empty set. ``name_bits`` is the width of
    the hashes that name classes at first.
    """
    scratch = Scratch(docs.sparkSession)
    keep = scratch.keep
    kind = docs.schema[id_col].dataType.simpleString()
    key = [] if row_col is None else [F.col(row_col).alias("row")]
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *key)
    signed = keep(docs.mapInArrow(lambda it: _sign(it, words, name_bits), f"id {kind}, {SIGNED}" + ", row long" * len(key)))
    first = [F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")] * len(key)
    signed, classes = one_name_each(signed, scratch, first)

    banded = signed.filter("bands is not null").select("k1", "n", F.posexplode("bands").alias("band", "bh"))
    shared = banded.groupBy("bh").agg(F.min("k1").alias("lead"), F.max("k1").alias("other")).filter("lead < other").select("bh", "lead")
    members = keep(banded.join(shared, "bh").groupBy("bh", "k1").agg(F.min("n").alias("n"), F.min("band").alias("band"), F.min("lead").alias("lead")))
    comps = keep(members.select(F.col("k1").alias("x")).distinct().withColumn("c", F.col("x")))
    linker = _Linker(scratch, docs, signed, classes, comps, words, percent)

    alike = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    salted = members.withColumn("salt", F.pmod(F.xxhash64("k1"), F.lit(SALTS)))
    leads = salted.groupBy("bh", "salt").agg(F.min(F.struct("k1", "n")).alias("sub"), F.min("lead").alias("lead"))
    leads = keep(leads.select("bh", "salt", F.col("sub.k1").alias("sub"), F.col("sub.n").alias("sub_n"), "lead"))
    tops = leads.filter("sub = lead").select("bh", F.col("sub").alias("top"), F.col("sub_n").alias("top_n"))
    lower = salted.join(leads.drop("lead"), ["bh", "salt"]).filter((F.col("k1") != F.col("sub")) & alike("n", "sub_n")).select(F.col("sub").alias("a"), F.col("k1").alias("b"))
    upper = leads.join(tops, "bh").filter((F.col("sub") != F.col("top")) & alike("sub_n", "top_n")).select(F.col("top").alias("a"), F.col("sub").alias("b"))
    linker.settle(lower.union(upper).distinct())

    linker.search_buckets(members)

    named = classes.join(linker.comps, classes["k1"] == linker.comps["x"], "left").withColumn("c", F.coalesce("c", "k1"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"), *[F.min("first").alias("first") for _ in key])
    named = keep(named.select("k1", "c").join(least, "c").select("k1", "component_id", *[F.col("first.row").alias("first_row") for _ in key]))
    out = signed.select("id", "n", "k1", *["row" for _ in key]).join(named, "k1", "left")
    component = F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    own = [F.col("row").alias(row_col), (F.col("k1").isNull() | (F.col("row") == F.col("first_row"))).alias("chosen")] if key else []
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), *own)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), words=4)


OP10_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs
), sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid), shared AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach(rid, other) AS (
  SELECT rid, rid FROM docs UNION SELECT r.rid, l.y FROM reach r JOIN links l ON l.x = r.other
), named AS (SELECT r.rid, min(d.doc_id) AS component_id FROM reach r JOIN docs d ON d.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, component_id IS NULL) AS kept
FROM docs JOIN named USING (rid) LEFT JOIN sizes USING (rid)
"""
