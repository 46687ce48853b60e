"""URL filters: path rules in front of an exact Bloom filter cascade (built-in functions only).

Level 1 of the cascade encodes the listed keys. Over the complete key universe its false
positives are known, so level 2 encodes those, level 3 the listed keys that level 2 wrongly
holds, and so on until no false positive is left: membership is then exact for every key of
the universe, with a few bits a key and without a join.

Small filters travel as constants of the plan; their size is computed from counts before they are built. Above ``MAX_BITS``
in total the key space is cut by hash into shards with a cascade each, of about ``SHARD_BITS``: a table with one row a shard, in the
shared folder, and a url probes the row of its shard. So the method is the same at any size of the list; neither keys
nor filters go through the driver then, and a hot host's urls are split over tasks by AQE, since its shard has one row.

Listed hosts that the corpus lacks take no part, as its keys are all that is ever asked for.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by its (empty) key. Null page ids and repeated rows pass through, one row out per row
in. An empty table gives no rows. Columns other than the id and the url are not read, so
their names can't clash.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Site names whose hosts are listed by default.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: (action, host, path) of the default rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Bits of all filters that may travel with a plan (1 MB).
MAX_BITS = 8 << 20
#: Bits of a shard's filters that are aimed at (512 KB).
SHARD_BITS = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` and its action; nulls if none fits."""
    rule = action = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def _positions(key: Column, level: int, n_hashes: int, n_bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(n_bits)) for j in range(n_hashes)]


class Filter:
    """One level: a bit array held as a constant of 64-bit words."""

    def __init__(self, keys: DataFrame, level: int, n_keys: int, rate: float):
        self.level = level
        self.n_hashes = max(1, round(-math.log2(rate)))
        self.n_bits = self.size(n_keys, rate)
        at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, self.n_hashes, self.n_bits))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        found = {r.word: r.bits for r in words.collect()}  # n_bits / 64 rows at most, and n_bits is checked
        self.words = F.from_json(F.lit(json.dumps([found.get(i, 0) for i in range(-(-self.n_bits // 64))])), "array<bigint>")

    @staticmethod
    def size(n_keys: int, rate: float) -> int:
        return max(64, math.ceil(n_keys * -math.log2(rate) / math.log(2)))

    def holds(self, key: Column) -> Column:
        held = F.lit(True)
        for at in _positions(key, self.level, self.n_hashes, self.n_bits):
            word = F.get(self.words, F.shiftright(at, 6).cast("int"))
            held = held & (F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return held


def cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> list[Filter] | None:
    """Filters over ``universe`` (distinct ``key``, ``listed``); None if they would exceed ``max_bits``."""
    n_listed, n_rest = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    own, other = universe.filter("listed"), universe.filter(~F.col("listed"))
    n_own, rate = n_listed, min(0.5, max(n_listed, 1) / max(n_rest, 1) / math.sqrt(2))
    levels, bits = [], 0
    while n_own:
        bits += Filter.size(n_own, rate)
        if bits > max_bits:
            return None
        levels.append(Filter(own, len(levels) + 1, n_own, rate))
        wrong = other.filter(levels[-1].holds(F.col("key")))
        own, other, n_own, rate = wrong, own, wrong.count(), 0.5
    return levels


def member(key: Column, levels: list[Filter]) -> Column:
    """Whether a key of the universe is listed."""
    result = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels), 0, -1):
        result = F.when(levels[i - 1].holds(key), result).otherwise(F.lit(i % 2 == 0))
    return result


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards))


def _held(key: Column, level: Column) -> Column:
    """Whether a filter (level, n_hashes, n_bits, words) of a table holds a key."""

    def is_set(j: Column) -> Column:
        at = F.pmod(F.xxhash64(key, level["level"], j), level["n_bits"])
        return F.call_function("shiftright", F.get(level["words"], F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return F.forall(F.sequence(F.lit(0), level["n_hashes"] - 1), is_set)


def _level_filters(own: DataFrame, other: DataFrame, level: int) -> DataFrame:
    """(shard, filter): a filter of the keys of ``own`` (shard, key) in each shard that has some; the first level's rate follows the other keys."""
    counts = own.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).join(other.groupBy("shard").agg(F.count(F.lit(1)).alias("rest")), "shard", "left")
    rate = F.least(F.lit(0.5), F.col("n") / F.coalesce("rest", F.lit(1)) / math.sqrt(2)) if level == 1 else F.lit(0.5)
    bits = -F.log2(rate)
    sizes = counts.select("shard", F.greatest(F.lit(1), F.round(bits)).cast("int").alias("n_hashes"), F.greatest(F.lit(64), F.ceil(F.col("n") * bits / math.log(2))).cast("long").alias("n_bits"))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_hashes") - 1), lambda j: F.pmod(F.xxhash64(F.col("key"), F.lit(level), j), F.col("n_bits"))))
    put = own.join(sizes, "shard").select("shard", at.alias("at")).select("shard", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    none = sizes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bits") - 1) / 64))).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = put.unionByName(none).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    arrays = words.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    return arrays.join(sizes, "shard").select("shard", F.struct(F.lit(level).alias("level"), "n_hashes", "n_bits", "words").alias("filter"))


def sharded_cascade(universe: DataFrame, scratch: Scratch, shard_bits: int = SHARD_BITS) -> tuple[DataFrame, int]:
    """((shard, levels), shards): the cascade of each shard of ``universe`` (distinct ``key``, ``listed``), as a table."""
    n_listed, n_rest = universe.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    rate = min(0.5, max(n_listed, 1) / max(n_rest, 1) / math.sqrt(2))
    shards = 1 + 2 * Filter.size(n_listed, rate) // max(1, shard_bits)
    dealt = scratch.keep(universe.select(_shard(F.col("key"), shards).alias("shard"), "key", "listed"))
    own, other = dealt.filter("listed").select("shard", "key"), dealt.filter(~F.col("listed")).select("shard", "key")
    levels = []
    while own.limit(1).count():
        levels.append(scratch.keep(_level_filters(own, other, len(levels) + 1)))
        wrong = scratch.keep(other.join(levels[-1], "shard").filter(_held(F.col("key"), F.col("filter"))).select("shard", "key"))
        own, other = wrong, own
    if not levels:
        return dealt.select("shard").limit(0).withColumn("levels", F.array().cast("array<struct<level:int,n_hashes:int,n_bits:bigint,words:array<bigint>>>")), shards
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    return scratch.keep(every.groupBy("shard").agg(F.array_sort(F.collect_list("filter")).alias("levels"))), shards


def sharded_member(key: Column, levels: Column) -> Column:
    """Whether a key is listed, by the levels of its shard; no key of a shard without levels is."""
    odd = F.size(levels) % 2 == 1
    return F.coalesce(F.aggregate(F.reverse(levels), odd, lambda result, level: F.when(_held(key, level), result).otherwise(level["level"] % 2 == 0)), F.lit(False))


def carries_label(host: Column, names=LISTED_SITES) -> Column:
    """Whether a host has one of ``names`` among its dot-separated labels."""
    return F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, names)))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, listed=carries_label, max_bits: int = MAX_BITS) -> DataFrame:
    """Judge every url: (id, host, path, rule, verdict, listed).

    ``listed`` is the list: a table whose first column holds its hosts, of any size, or a function from the host column to a boolean.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    scratch = Scratch(pages.sparkSession)
    hosts = urls.select(F.col("host").alias("key")).distinct()
    if isinstance(listed, DataFrame):
        keys = listed.select(F.col(f"`{listed.columns[0]}`").alias("key")).distinct().withColumn("listed", F.lit(True))
        universe = scratch.keep(hosts.join(keys, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    else:
        universe = scratch.keep(hosts.withColumn("listed", listed(F.col("key"))))
    levels = cascade(universe, max_bits)
    if levels is None:
        filters, shards = sharded_cascade(universe, scratch)
        urls = urls.withColumn("shard", _shard(F.col("host"), shards)).join(filters, "shard", "left").withColumn("listed", sharded_member(F.col("host"), F.col("levels"))).drop("shard", "levels")
    else:
        scratch.drop(universe)
        urls = urls.withColumn("listed", member(F.col("host"), levels))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return urls.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), ruled AS (
  SELECT *, '.' || host AS dotted,
         list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS listed FROM urls
), judged AS (
  SELECT *, CASE WHEN dotted LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
                 WHEN dotted LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
                 WHEN dotted LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
                 WHEN dotted LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
                 WHEN dotted LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule FROM ruled
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""
