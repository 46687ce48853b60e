"""Exact top-k search by incremental multi-index hashing of binary codes.

A vector's code is the signs of its values. Codes are cut into segments of about log2(n) bits and
each segment's value is indexed. If two codes differ in less than m (r + 1) bits, one of their m segments differs in at
most r; so after the segments within radius r are searched and verified, every neighbour nearer than m (r + 1) is
known. The radius grows round by round, and a query leaves as soon as its kth distance is below that bound:
its result is then provably complete, whatever the data.

Equal codes are one numbered entry with the k + 1 smallest ids (enough for any result, as ties go to the smaller id), and equal
queries are asked once; so copies never meet in pairs. A query that has met every code, or whose radius reached a whole
segment, is complete as well. Rounds are joins on (segment, value) and grouped sums, and each is written to the shared folder. What a
query meets beyond its kth distance so far is dropped before it is shuffled; before the first round that distance is taken from
a few landmarks of the query's own segment values. A segment value that very many codes share is cut into blocks of codes, and its
probes go to each of them. A round has as many tasks as its probes ask for.

Edge cases: a null or empty vector, or one with null entries, has no code and is neither query nor answer;
NaN and zero count as not positive; a vector is compared with all vectors of its own length, by a search for each length that
is asked for; fewer than k other rows give as many as there are; a row is never its own answer, but a copy under another id is;
rows of a repeated id count once per code; ids may be of any type that has an order, and rows of a null id are left out; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K = 10
QUERY_STEP = 50
WORD = 63  # bits per long, so that no sign is involved
MAX_SEGMENT = 20
#: Index rows (some 60 bytes each) that may be broadcast; above that the probes are shuffled to the index.
BROADCAST_ROWS = 500_000
PROBES_A_TASK = 65_536
#: Codes of one segment value that first limit a query's distances, and codes of one block of such a value.
LANDMARKS, BLOCK_CODES = 32, 65_536


def code_of(vector: Column, dim: int) -> Column:
    """The signs as an array of longs."""
    words = []
    for start in range(0, dim, WORD):
        bits = F.slice(vector, start + 1, WORD)
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when((x > 0) & ~F.isnan(x.cast("double")), 1).otherwise(0).cast("long"))))
    return F.array(*words)


def _bits(dim: int, start: int, stop: int) -> list[tuple[int, int]]:
    """Where the bits of a segment lie: (word, shift)."""
    out = []
    for i in range(start, stop):
        word = i // WORD
        size = min(WORD, dim - word * WORD)
        out.append((word, size - 1 - i % WORD))
    return out


def segments(code: Column, dim: int, m: int) -> list[Column]:
    """The m segment values of a code; consecutive bits of one word are taken at once."""
    bounds = [round(i * dim / m) for i in range(m + 1)]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        value, bits = F.lit(0).cast("long"), _bits(dim, a, b)
        for word in sorted({w for w, _ in bits}):
            shifts = [s for w, s in bits if w == word]
            part = F.shiftright(F.get(code, F.lit(word)), min(shifts)).bitwiseAND(F.lit((1 << len(shifts)) - 1))
            value = F.shiftleft(value, len(shifts)).bitwiseOR(part)
        out.append(value)
    return out


def flips(spark: SparkSession, widths: list[int], radius: int) -> DataFrame:
    """(bits, flip): the masks of ``radius`` ones for each width; at most 2 ** MAX_SEGMENT of them."""
    frames = [spark.range(1 << b).filter(F.bit_count("id") == radius).select(F.lit(b).alias("bits"), F.col("id").alias("flip")) for b in widths]
    out = frames[0]
    for x in frames[1:]:
        out = out.unionAll(x)
    return out


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def search(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, rank, neighbor_id, distance): the k nearest other rows of each row that ``queries`` selects, ties by id."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), queries.alias("asks")).filter("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    dims = [r.dim for r in own.filter("asks").select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]  # lengths, not rows
    kind = vectors.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"`{id_col}` {kind}, rank int, neighbor_id {kind}, distance int")
    for dim in dims:
        out = out.unionByName(_search_length(scratch, own.filter(F.size("v") == dim), dim, k, id_col))
    return out


class _Index:
    """The codes (c, code, size) of one length under their segment values, those of very common values in blocks."""

    def __init__(self, scratch: Scratch, codes: DataFrame, n_codes: int, dim: int):
        self.scratch, self.dim = scratch, dim
        self.m = m = -(-dim // min(MAX_SEGMENT, max(1, round(math.log2(max(2, n_codes))))))
        self.widths = [round((i + 1) * dim / m) - round(i * dim / m) for i in range(m)]
        placed = codes.select("c", "code", "size", F.inline(self.parts(F.col("code")))).drop("bits")
        self.small = n_codes * m <= BROADCAST_ROWS
        self.hot = None
        if not self.small:
            placed = scratch.keep(placed)
            hot = placed.groupBy("seg", "val").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CODES).cast("int").alias("blocks")).filter("blocks > 1")
            hot = scratch.keep(hot)
            if hot.limit(1).count():
                self.hot = hot
        block = F.lit(0)
        if self.hot is not None:
            placed = placed.join(self.hot, ["seg", "val"], "left")
            block = F.pmod(F.xxhash64("c"), F.coalesce("blocks", F.lit(1))).cast("int")
        self.entries = scratch.keep(placed.select("seg", "val", block.alias("block"), "c", "code", "size"))

    def parts(self, code: Column) -> Column:
        """The segments of a code: (seg, val, bits)."""
        values = zip(segments(code, self.dim, self.m), self.widths, strict=True)
        return F.array(*[F.struct(F.lit(i).alias("seg"), v.alias("val"), F.lit(b).alias("bits")) for i, (v, b) in enumerate(values)])

    def first_limits(self, asking: DataFrame, k: int) -> DataFrame:
        """``asking`` (q, q_code) with ``limit``: a distance that k other entries are known to reach, or the length."""
        order = Window.partitionBy("seg", "val").orderBy(F.xxhash64("c"), "c")
        marks = self.entries.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= LANDMARKS).select("seg", "val", "c", "code", "size")
        met = asking.select("q", "q_code", F.inline(self.parts(F.col("q_code")))).join(marks, ["seg", "val"])
        met = met.groupBy("q", "c").agg(F.first(distance(F.col("q_code"), F.col("code"))).alias("d"), F.first(F.least("size", F.lit(k + 1))).alias("n"))
        sums = F.aggregate(F.array_sort(F.collect_list(F.struct("d", "n"))), _reached(F.lit(0), F.lit(self.dim)), lambda s, x: F.when(s["n"] > k, s).otherwise(_reached(s["n"] + x["n"], x["d"])))
        limits = met.groupBy("q").agg(sums.alias("s")).select("q", F.when(F.col("s.n") > k, F.col("s.d")).otherwise(self.dim).alias("limit"))  # of LANDMARKS entries a segment at most
        return asking.join(limits, "q", "left").select("q", "q_code", F.coalesce("limit", F.lit(self.dim)).alias("limit"))

    def hits(self, active: DataFrame, n_active: int, radius: int, k: int) -> DataFrame:
        """(q, d, c, n): what the queries meet at exactly this radius, within their limits."""
        n_probes = n_active * sum(math.comb(b, radius) for b in self.widths)
        masks = flips(active.sparkSession, sorted(set(self.widths)), radius)
        dealt = active.repartition(1 + n_probes // PROBES_A_TASK, "q").select("q", "q_code", "limit", F.inline(self.parts(F.col("q_code"))))
        probes = dealt.join(F.broadcast(masks), "bits").select("q", "q_code", "limit", "seg", F.col("val").bitwiseXOR(F.col("flip")).alias("val"))
        if self.hot is not None:
            probes = probes.join(self.hot, ["seg", "val"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
        else:
            probes = probes.withColumn("block", F.lit(0))
        entries = F.broadcast(self.entries) if self.small else self.entries
        d = distance(F.col("q_code"), F.col("code"))
        return probes.join(entries, ["seg", "val", "block"]).filter(d <= F.col("limit")).select("q", d.alias("d"), "c", F.least("size", F.lit(k + 1)).alias("n"))


def _reached(n: Column, d: Column) -> Column:
    return F.struct(n.cast("long").alias("n"), d.cast("int").alias("d"))


def _search_length(scratch: Scratch, own: DataFrame, dim: int, k: int, id_col: str) -> DataFrame:
    """The search among vectors (id, v, asks) of one length, some of which ask."""
    coded = scratch.keep(own.groupBy("id", code_of(F.col("v"), dim).alias("code")).agg(F.max("asks").alias("asks")))
    ids = coded.groupBy("code").agg(F.count(F.lit(1)).alias("size"), F.max("asks").alias("asks"))
    codes = scratch.keep(ids.withColumn("c", F.monotonically_increasing_id()))  # written, so that the numbers stay
    index = _Index(scratch, codes, codes.count(), dim)
    asking = codes.filter("asks").select(F.col("c").alias("q"), F.col("code").alias("q_code"))
    active = scratch.keep(index.first_limits(asking, k))
    top, done, radius = None, None, 0
    while n_active := active.count():
        found = _nearest(index.hits(active, n_active, radius, k), k + 1)
        merged = found if top is None else _nearest(top.join(active.select("q"), "q", "left_semi").unionByName(found), k + 1)
        merged = scratch.keep(merged)
        known = merged.groupBy("q").agg(F.sum("n").alias("n"), F.max("d").alias("last"))
        bound = index.m * (radius + 1)
        open_ = active.join(known, "q", "left").filter((F.coalesce("n", F.lit(0)) < k + 1) | (F.coalesce("last", F.lit(dim)) >= bound))
        limit = F.when(F.col("n") >= k + 1, F.least("last", "limit")).otherwise(F.col("limit")).alias("limit")
        open_ = open_.select("q", "q_code", limit)
        if radius >= max(index.widths):
            open_ = open_.limit(0)
        active = scratch.keep(open_)
        closed = merged.join(active.select("q"), "q", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        top, radius = merged, radius + 1
    asked = coded.filter("asks").join(codes, "code").select(F.col("id").alias("query"), F.col("c").alias("q"))
    answers = done.join(_smallest(coded, codes, k + 1), "c").select("q", "d", "other")
    per_code = answers.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k + 1).alias("near"))
    picked = asked.join(per_code, "q").select("query", F.slice(F.filter("near", lambda x: x["other"] != F.col("query")), 1, k).alias("near"))
    return picked.select(F.col("query").alias(id_col), F.posexplode("near").alias("rank", "x")).select(id_col, (F.col("rank") + 1).alias("rank"), F.col("x.other").alias("neighbor_id"), F.col("x.d").alias("distance"))


def _smallest(coded: DataFrame, codes: DataFrame, n: int) -> DataFrame:
    """(c, other): the n smallest ids of each code; Spark limits each task's rows before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    return coded.select("code", "id").withColumn("r", rank).filter(F.col("r") <= n).join(codes.select("code", "c"), "code").select("c", F.col("id").alias("other"))


def _nearest(pairs: DataFrame, n: int) -> DataFrame:
    """The n nearest codes of each query: fewer suffice where codes have several ids, but ties by id need all of a distance."""
    counts = pairs.groupBy("q", "c").agg(F.min("d").alias("d"), F.min("n").alias("n"))
    by_d = counts.groupBy("q", "d").agg(F.sum("n").alias("m"))
    reach = by_d.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("q").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = reach.filter(F.col("before") < n).groupBy("q").agg(F.max("d").alias("limit"))
    return counts.join(last, "q").filter(F.col("d") <= F.col("limit")).select("q", "c", "d", "n")


def op8_topk_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


OP8_SQL = """
WITH coded AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS code FROM embeddings WHERE len(embedding) > 0
), ranked AS (
  SELECT q.vec_id, b.vec_id AS neighbor_id, list_sum(list_transform(list_zip(q.code, b.code), lambda p: abs(p[1] - p[2])))::INTEGER AS distance
  FROM coded q, coded b WHERE q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM ranked
)
SELECT vec_id, rank, neighbor_id, distance FROM numbered WHERE rank <= 10
"""
