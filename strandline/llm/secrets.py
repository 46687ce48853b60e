"""Secret scans with multipart credential linking (built-in functions only).

Base findings are three regular patterns. Weak candidates - bare mixed tokens and endpoints - are
noise on their own; they are reported only when a complementary part ends or begins within ``SCOPE``
code points of them: a token beside an access identifier or an endpoint, an endpoint beside an access
identifier or a secret. The distance is the gap between the two intervals, whatever their lengths, and parts that overlap are
no complements of each other. A token that overlaps an endpoint or a base finding is a piece of that and no
candidate, nor is an endpoint that overlaps a base finding; every part found counts as a complement.

Each part is laid out twice, where it begins and where it ends, and the interval join of each
candidate with its complements is a range frame over that order: the ends before a beginning, the
beginnings after an end. It sweeps once over the parts and never lists pairs.

Only the parts travel, keyed by the row they come from, so one source or one line in a third of
all texts is no hot key. Offsets are code points, end exclusive.

Edge cases: a null or empty text has no finding; repeated rows and repeated ids are judged each on
its own; a null id is kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"  # a run of 24 and more is a whole greedy run of [0-9a-f]
ENDPOINT = r"(https?://[A-Za-z0-9._:/-]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3})"
TOKEN = r"([A-Za-z0-9+/_-]{16,})"
#: kind, pattern, the group whose length counts, its least length. The first three are the base kinds.
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 1, 20), ("hex", HEX, 1, 24), ("endpoint", ENDPOINT, 1, 1), ("token", TOKEN, 1, 16))
SCOPE = 200


def _hits(text: Column, kind: int) -> Column:
    """For each match in order: the length of the gap before it, its own length, whether it holds."""
    _, pattern, group, least = KINDS[kind]
    regex = F.lit(pattern)
    whole, part = F.regexp_extract_all(text, regex, F.lit(0)), F.regexp_extract_all(text, regex, F.lit(group))
    holds = lambda w, p: F.length(p) >= least
    if KINDS[kind][0] == "token":
        holds = lambda w, p: w.rlike("[0-9]") & w.rlike("[A-Za-z]")
    gaps = F.split(text, pattern, -1)
    zipped = F.transform(
        F.arrays_zip(whole.alias("w"), part.alias("p"), gaps.alias("g")),
        lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["g"]).alias("gap"), F.length(z["w"]).alias("len"), F.coalesce(holds(z["w"], z["p"]), F.lit(False)).alias("ok")),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
    return F.when(text.rlike(pattern), F.filter(zipped, lambda z: z["len"].isNotNull())).otherwise(none)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, kind, start, end): every match that holds; a row with nulls for a text without matches."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hits = rows.select("row", "id", F.explode_outer(F.concat(*[_hits(F.col("text"), k) for k in range(len(KINDS))])).alias("h")).select("row", "id", "h.*")
    along = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("len")).over(along)
    placed = hits.repartition("row").withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    # Matches that fail stay until their lengths are counted; then only the row itself must stay.
    return placed.select("row", "id", F.when(F.col("ok"), F.col("kind")).alias("kind"), F.when(F.col("ok"), F.col("start")).alias("start"), F.when(F.col("ok"), F.col("end")).alias("end"))


def _is(*names: str) -> Column:
    return F.coalesce(F.col("kind").isin([i for i, k in enumerate(KINDS) if k[0] in names]), F.lit(False))


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Keep base parts, and weak ones only beside their complements. Adds ``base``."""
    base = _is("assign", "access", "hex")
    order, back = Window.partitionBy("row").orderBy("at"), Window.partitionBy("row").orderBy(F.desc("at"))
    ends_before, begins_after = order.rangeBetween(-scope, 0), order.rangeBetween(0, scope)
    edges = parts.select("*", base.alias("base"), F.explode(F.array(F.lit(True), F.lit(False))).alias("begins"))
    edges = edges.withColumn("at", F.when(F.col("begins"), F.col("start")).otherwise(F.col("end")))

    def beside(kind: Column) -> Column:
        """Whether a part of the kind ends near before a beginning, or begins near after an end."""
        some = lambda edge, frame: F.max(F.when(kind & edge, 1).otherwise(0)).over(frame) == 1
        return F.when(F.col("begins"), some(~F.col("begins"), ends_before)).otherwise(some(F.col("begins"), begins_after))

    def overlaps(kind: Column) -> Column:
        """At a beginning: whether a part of the kind begins no later and ends after it, or begins no earlier and before the end."""
        last = F.max(F.when(kind & F.col("begins"), F.col("end"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
        first = F.min(F.when(kind & F.col("begins"), F.col("start"))).over(back.rangeBetween(Window.unboundedPreceding, 0))  # a running minimum from the end
        return F.coalesce(F.col("begins") & ((last > F.col("start")) | (first < F.col("end"))), F.lit(False))

    weak = edges.select(
        "*", beside(_is("access")).alias("by_access"), beside(_is("endpoint")).alias("by_endpoint"), beside(_is("assign", "hex")).alias("by_secret"),
        overlaps(base).alias("in_base"), overlaps(_is("endpoint")).alias("in_endpoint"),
    )
    flags = ["by_access", "by_endpoint", "by_secret", "in_base", "in_endpoint"]
    seen = weak.groupBy("row", "id", "kind", "start", "end", "base").agg(*[F.bool_or(x).alias(x) for x in flags])
    token = _is("token") & ~F.col("in_endpoint") & (F.col("by_access") | F.col("by_endpoint"))
    endpoint = _is("endpoint") & (F.col("by_access") | F.col("by_secret"))
    keep = F.col("base") | (~F.col("in_base") & (token | endpoint))
    gone = lambda c: F.when(keep, F.col(c)).alias(c)
    return seen.select("row", "id", gone("kind"), gone("start"), gone("end"), "base")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: the id and ``found``, its findings (start, kind, end, base) in order."""
    linked = link_parts(find_parts(docs, id_col, text_col), scope)
    found = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end", "base"))))
    return linked.groupBy("row").agg(F.first("id").alias(id_col), found.alias("found")).drop("row")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    joined = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )


def _sql() -> str:
    """The same findings in DuckDB: gaps and matches give the places, range frames the neighbours."""
    hits = []
    for i, (name, pattern, group, least) in enumerate(KINDS):
        quoted = "'" + pattern.replace("'", "''") + "'"
        ok = "regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]')" if name == "token" else f"length(p) >= {least}"
        lists = f"SELECT rid, regexp_extract_all(t, {quoted}, 0) AS ws, regexp_extract_all(t, {quoted}, {group}) AS ps, string_split_regex(t, {quoted}) AS gs FROM docs"
        rows = f"SELECT rid, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(ps) AS p, unnest(gs[1:len(ws)]) AS g FROM ({lists})"
        hits.append(f"SELECT rid, {i} AS kind, '{name}' AS name, sum(length(g) + length(w)) OVER (PARTITION BY rid ORDER BY i) AS e, length(w) AS n, {ok} AS ok FROM ({rows})")
    base = "kind < 3"
    joined = lambda cond: f"coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE {cond}), '')"
    beside = lambda cond: f"CASE WHEN begins THEN bool_or(({cond}) AND NOT begins) OVER back_ ELSE bool_or(({cond}) AND begins) OVER ahead_ END"
    over = lambda cond: f"begins AND (coalesce(max(CASE WHEN ({cond}) AND begins THEN e END) OVER all_back_ > s, false) OR coalesce(min(CASE WHEN ({cond}) AND begins THEN s END) OVER all_ahead_ < e, false))"
    frame = lambda name, range_: f"{name} AS (PARTITION BY rid ORDER BY at_ RANGE BETWEEN {range_})"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), hits AS ({" UNION ALL ".join(hits)}), parts AS (
  SELECT rid, kind, name, (e - n)::BIGINT AS s, e::BIGINT AS e FROM hits WHERE ok
), edges AS (SELECT *, s AS at_, true AS begins FROM parts UNION ALL SELECT *, e, false FROM parts), flagged AS (
  SELECT rid, kind, name, s, e, {beside("kind = 1")} AS by_access, {beside("kind = 3")} AS by_endpoint, {beside("kind IN (0, 2)")} AS by_secret, {over(base)} AS in_base, {over("kind = 3")} AS in_endpoint
  FROM edges WINDOW {frame("back_", f"{SCOPE} PRECEDING AND CURRENT ROW")}, {frame("ahead_", f"CURRENT ROW AND {SCOPE} FOLLOWING")},
    {frame("all_back_", "UNBOUNDED PRECEDING AND CURRENT ROW")}, {frame("all_ahead_", "CURRENT ROW AND UNBOUNDED FOLLOWING")}
), seen AS (
  SELECT rid, kind, name, s, e, bool_or(by_access) AS by_access, bool_or(by_endpoint) AS by_endpoint, bool_or(by_secret) AS by_secret, bool_or(in_base) AS in_base, bool_or(in_endpoint) AS in_endpoint FROM flagged GROUP BY ALL
), kept AS (
  SELECT * FROM seen WHERE {base} OR NOT in_base AND (kind = 4 AND NOT in_endpoint AND (by_access OR by_endpoint) OR kind = 3 AND (by_access OR by_secret))
)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256({joined(base)}) AS base_sha256, {joined("kind IS NOT NULL")} AS spans
FROM docs LEFT JOIN kept USING (rid) GROUP BY rid
"""


OP5_SQL = _sql()
