"""Statistics, search, navigation, locate and extract over the event paths, bidirectional unless said otherwise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locate, search, stats, verify
from ..plans import oracle as O
from ..plans.tables import cut, dense_ids
from ..plans.index import PathIndex, flip, is_reverse, node_id, reverse_path
from ..sources.corpus import index, paths, patterns
from .base import query

SQL = O.sql
P, FD, E, R = O.patterns_sql(), O.FOUND, O.EDGES, O.RUNS


def positions(idx: PathIndex):
    """All positions (node, off)."""
    return idx.visits.select("node", "off")


def states(spark, sf):
    return search.find(index(spark, sf), patterns(spark, sf))


def absent(idx):
    """One row: a node that the index lacks."""
    return idx.node_sizes.agg((F.max("node") + 2).alias("to"))


def nexts(spark, sf):
    """The states of the patterns with every successor of their node, and with a node that the index lacks."""
    idx, own = index(spark, sf), states(spark, sf)
    along = own.join(idx.edges.filter("dst <> 0").select(F.col("src").alias("node"), F.col("dst").alias("to")), "node")
    return along.unionByName(own.crossJoin(F.broadcast(absent(idx))))  # one row


NEXTS = "nexts AS (SELECT f.*, t.to FROM found f JOIN (SELECT DISTINCT node, next AS to FROM visits WHERE next <> 0) t USING (node) UNION ALL SELECT *, (SELECT max(node) + 2 FROM visits) FROM found)"

# Statistics ------------------------------------------------------------------------------------------


@query("t01_sizes", SQL("SELECT count(*) FILTER (pos = 0) AS sequences, count(*) AS size, count(*) = 0 AS empty FROM visits"))
def t01(spark, sf):
    return index(spark, sf).header.select("sequences", "size", (F.col("size") == 0).alias("empty"))


@query("t02_alphabet", SQL("SELECT min(node) FILTER (node > 0) - 1 AS offset, max(node) + 1 AS sigma, max(node) + 1 - (min(node) FILTER (node > 0) - 1) AS effective, min(node) FILTER (node > 0) AS first_node FROM visits"))
def t02(spark, sf):
    return index(spark, sf).header.select("offset", F.col("alphabet_size").alias("sigma"), "effective", (F.col("offset") + 1).alias("first_node"))


@query("t03_records_of_nodes", SQL("SELECT DISTINCT node, CASE WHEN node = 0 THEN 0 ELSE node - o END AS comp, node AS back FROM visits, (SELECT min(node) FILTER (node > 0) - 1 AS o FROM visits)"))
def t03(spark, sf):
    idx = index(spark, sf)
    nodes = idx.visits.select("node").distinct().crossJoin(F.broadcast(idx.header.select("offset")))  # one row
    comp = stats.to_comp(F.col("node"), F.col("offset"))
    return nodes.select("node", comp.alias("comp"), stats.to_node(comp, F.col("offset")).alias("back"))


@query("t04_run_counts", SQL("SELECT (SELECT count(*) FROM runs) AS concrete, (SELECT count(*) FROM logical) AS logical", R))
def t04(spark, sf):
    return stats.run_counts(index(spark, sf))


@query("t04_runs", SQL("SELECT * FROM runs", R))
def t04_runs(spark, sf):
    return index(spark, sf).runs


@query("t04_logical_runs", SQL("SELECT * FROM logical", R))
def t04_logical(spark, sf):
    return index(spark, sf).logical_runs


@query("t05_sample_count", SQL("SELECT count(*) AS samples FROM visits WHERE next = 0 OR (pos + 1) % 16 = 0"))
def t05(spark, sf):
    return stats.sampled(index(spark, sf), 16).agg(F.count(F.lit(1)).alias("samples"))


@query("t06_flags", SQL("""SELECT 'both' AS kind, NOT EXISTS (SELECT 1 FROM seqs a LEFT JOIN seqs b ON b.seq_id = xor(a.seq_id, 1) WHERE b.path IS DISTINCT FROM list_transform(list_reverse(a.path), lambda x: xor(x, 1))) AS bidirectional, count(*) > 0 AS has_metadata FROM orders
  UNION ALL SELECT 'forward', bool_or(node % 2 = 1), false FROM rows_"""))
def t06(spark, sf):
    """Of an index in both orientations that was saved with metadata, and of one of forward paths alone."""
    from ..sources import bundle
    from .names import meta
    from .scan import place

    at = place(spark)
    bundle.save(index(spark, sf), at, metadata=meta(spark, sf))
    named, forward = bundle.load(spark, at)[0], PathIndex.from_paths(paths(spark, sf), both=False)
    flags = lambda kind, idx: idx.header.select(F.lit(kind).alias("kind"), "bidirectional", F.lit(idx.metadata is not None).alias("has_metadata"))
    return flags("both", named).unionAll(flags("forward", forward))


@query("t07_contains_node", SQL("SELECT n AS node, n = 0 OR (n > o AND n < m) AS contained FROM (SELECT unnest(generate_series(0, 15)) AS n), (SELECT min(node) FILTER (node > 0) - 1 AS o, max(node) + 1 AS m FROM visits)"))
def t07(spark, sf):
    return stats.contains_node(index(spark, sf), spark.range(16).withColumnRenamed("id", "node"))


@query("t07_contains_position", SQL("SELECT node, off FROM visits"))
def t07_position(spark, sf):
    idx = index(spark, sf)
    """Every position, and as many that no record has."""
    wanted = positions(idx)
    return stats.contains_position(idx, wanted.unionAll(wanted.withColumn("off", -F.col("off") - 1)))


@query("t08_has_edge", SQL("SELECT a.n AS src, b.n AS dst, EXISTS (SELECT 1 FROM edges e WHERE e.src = a.n AND e.dst = b.n) AS has_edge FROM (SELECT unnest(generate_series(0, 12)) AS n) a, (SELECT unnest(generate_series(0, 12)) AS n) b", E))
def t08(spark, sf):
    n = spark.range(13)
    return stats.has_edge(index(spark, sf), n.select(F.col("id").alias("src")).crossJoin(n.select(F.col("id").alias("dst"))))  # 169 pairs


@query("t09_edges", SQL("SELECT * FROM edges", E))
def t09(spark, sf):
    return index(spark, sf).edges


@query("t10_node_sizes", SQL("SELECT node, count(*) AS size FROM visits GROUP BY node"))
def t10(spark, sf):
    return stats.node_sizes(index(spark, sf))


@query("t11_degrees", SQL("SELECT node, outdegree, coalesce(indegree, 0) AS indegree FROM (SELECT src AS node, count(*) AS outdegree FROM edges GROUP BY src) LEFT JOIN (SELECT dst AS node, count(*) AS indegree FROM edges WHERE dst <> 0 GROUP BY dst) USING (node)", E))
def t11(spark, sf):
    return stats.degrees(index(spark, sf))


@query("t12_incoming_counts", SQL("SELECT dst AS node, src, (sum(cnt) OVER w - cnt)::BIGINT AS before, (sum(cnt) OVER w)::BIGINT AS until FROM edges WHERE dst <> 0 WINDOW w AS (PARTITION BY dst ORDER BY src)", E))
def t12(spark, sf):
    return stats.incoming_counts(index(spark, sf))


@query("t13_edge_ranks", SQL("SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS outrank FROM edges", E))
def t13(spark, sf):
    return stats.edge_ranks(index(spark, sf))


@query("t14_bwt_access", SQL("SELECT node, off, next AS symbol FROM visits UNION ALL SELECT node, off + n, 0 FROM visits JOIN (SELECT node, count(*) AS n FROM visits GROUP BY node) USING (node)"))
def t14(spark, sf):
    idx = index(spark, sf)
    """Every position, and as many behind the end of its node."""
    at = positions(idx)
    beyond = at.join(idx.node_sizes, "node").select("node", (F.col("off") + F.col("size")).alias("off"))
    return stats.bwt_at(idx, at.unionAll(beyond))


@query("t15_records", SQL("SELECT node, sum(len)::BIGINT AS visits, count(*) AS runs, count(DISTINCT successor) AS outdegree FROM runs GROUP BY node", R))
def t15(spark, sf):
    return stats.records(index(spark, sf))


def _runs_of(node, batches):
    """A record's runs, from its visits as they stream by: a run goes on from one batch into the next."""
    import numpy as np
    import pyarrow as pa

    names, run, begin, symbol, seen = ["node", "run_id", "start_off", "len", "successor"], 0, 0, None, 0
    for batch in batches:
        nexts_ = batch.column(1).to_numpy()
        changes = np.flatnonzero(np.concatenate([[symbol is not None and nexts_[0] != symbol], nexts_[1:] != nexts_[:-1]]))
        rows = []
        for at in changes.tolist():
            rows.append((node, run, begin, seen + at - begin, int(nexts_[at - 1]) if at else symbol))
            run, begin = run + 1, seen + at
        seen, symbol = seen + len(nexts_), int(nexts_[-1])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (node, run, begin, seen - begin, symbol)], names=names)


@query("t15_for_each_record", SQL("SELECT node, run_id, start_off, len, successor FROM runs", R))
def t15_each(spark, sf):
    """The runs of every record, by a function that sees one record at a time."""
    return stats.for_each_record(index(spark, sf), _runs_of, "node long, run_id long, start_off long, len long, successor long")


@query("t16_statistics", SQL("""SELECT count(*) FILTER (pos = 0) AS sequences, count(*) AS size, min(node) FILTER (node > 0) - 1 AS offset, max(node) + 1 AS alphabet_size, max(node) + 2 - min(node) FILTER (node > 0) AS effective,
  (SELECT count(*) FROM runs) AS concrete, (SELECT count(*) FROM logical) AS logical, count(*) FILTER (next = 0 OR (pos + 1) % 1024 = 0) AS samples FROM visits""", R))
def t16(spark, sf):
    return stats.summary(index(spark, sf))


@query("t17_distribution", SQL("""SELECT statistic, sum(value)::BIGINT AS total, sum(value) / count(*)::DOUBLE AS average,
    sort[ceil(0.9::DOUBLE * len(sort))::INT] AS q0, sort[ceil(0.99::DOUBLE * len(sort))::INT] AS q1, sort[ceil(0.999::DOUBLE * len(sort))::INT] AS q2, max(value) AS largest
  FROM (SELECT *, list_sort(list(value) OVER (PARTITION BY statistic)) AS sort FROM per_) GROUP BY statistic, sort""", R, """bounds_ AS (SELECT min(node) FILTER (node > 0) AS a, max(node) AS b FROM visits), nodes_ AS (SELECT unnest(generate_series(a, b)) AS node FROM bounds_), rec_ AS (
    SELECT node, count(r.node) AS runs, count(DISTINCT successor) AS outdegree FROM nodes_ LEFT JOIN runs r USING (node) GROUP BY node
  ), per_ AS (SELECT 'runs' AS statistic, runs AS value FROM rec_ UNION ALL SELECT 'outdegree', outdegree FROM rec_)"""))
def t17(spark, sf):
    return stats.distribution(index(spark, sf))


@query("t18_compare", SQL("SELECT 'visits' AS part, count(*) AS compared, 0::BIGINT AS differing FROM visits UNION ALL SELECT 'edges', count(*), 0 FROM edges UNION ALL SELECT 'header', count(DISTINCT 1), 0 FROM visits", E))
def t18(spark, sf):
    idx = index(spark, sf)
    return stats.differences(idx, PathIndex.from_paths(paths(spark, sf), method="doubling"))


@query("t19_orientations", SQL("SELECT DISTINCT node, node // 2 AS id, node % 2 = 1 AS is_reverse, xor(node, 1) AS reversed FROM visits WHERE node <> 0"))
def t19(spark, sf):
    nodes = index(spark, sf).visits.filter("node <> 0").select("node").distinct()
    return nodes.select("node", node_id(F.col("node")).alias("id"), is_reverse(F.col("node")).alias("is_reverse"), flip(F.col("node")).alias("reversed"))


@query("t20_reverse_path", SQL("SELECT seq_id, array_to_string(list_transform(list_reverse(path), lambda x: xor(x, 1)), ',') AS reversed FROM seqs"))
def t20(spark, sf):
    return index(spark, sf).paths.select("seq_id", F.array_join(reverse_path(F.col("path")).cast("array<string>"), ",").alias("reversed"))


# Search ----------------------------------------------------------------------------------------------


@query("q01_find_node", SQL("SELECT node, min(off) AS sp, max(off) AS ep, count(*) AS cnt FROM visits GROUP BY node"))
def q01(spark, sf):
    idx = index(spark, sf)
    return search.find_nodes(idx, idx.visits.select("node"))


@query("q02_find_pattern", SQL("SELECT * FROM found", P, FD))
def q02(spark, sf):
    return states(spark, sf)


@query("q02_find_orders", SQL("SELECT * FROM found", O.patterns_sql(2), FD, corpus="orders"))
def q02_orders(spark, sf):
    return search.find(index(spark, sf, "orders"), patterns(spark, sf, "orders", 2))


@query("q02_find_conversations", SQL("SELECT * FROM found", O.patterns_sql(2), FD, corpus="conversations"))
def q02_conversations(spark, sf):
    return search.find(index(spark, sf, "conversations"), patterns(spark, sf, "conversations", 2))


@query("q02_find_by_extension", SQL("SELECT * FROM found", P, FD))
def q02_extension(spark, sf):
    return search.find_by_extension(index(spark, sf), patterns(spark, sf), 4)


@query("q03_prefix_pattern", SQL("""SELECT query_id, v.node, min(off) AS sp, max(off) AS ep, count(*) AS cnt FROM heads q JOIN visits v ON v.node = q.pattern[-1] AND v.pos = len(q.pattern) JOIN seqs s USING (seq_id)
  WHERE s.path[1:len(q.pattern)] = q.pattern GROUP BY query_id, v.node UNION ALL SELECT -1, 0, 0, count(*) - 1, count(*) FROM seqs""", "heads AS (SELECT seq_id AS query_id, path[1:3] AS pattern FROM seqs WHERE len(path) >= 3)"))
def q03(spark, sf):
    idx = index(spark, sf)
    heads = idx.paths.filter("size(path) >= 3").select(F.col("seq_id").alias("query_id"), F.slice("path", 1, 3).alias("pattern"))
    empty = spark.range(1).select(F.lit(-1).cast("long").alias("query_id"), F.array().cast("array<bigint>").alias("pattern"))
    return search.prefix(idx, heads.unionByName(empty))


@query("q04_extend", SQL("SELECT query_id, x.to AS node, min(next_off) AS sp, max(next_off) AS ep, count(*) AS cnt FROM nexts x JOIN visits v ON v.node = x.node AND off BETWEEN sp AND ep AND next = x.to GROUP BY query_id, x.to", P, FD, NEXTS))
def q04(spark, sf):
    return search.extend(index(spark, sf), nexts(spark, sf))


@query("q05_lf", SQL("SELECT node, off, next, next_off FROM visits"))
def q05(spark, sf):
    idx = index(spark, sf)
    return search.lf(idx, positions(idx))


#: Every position with every node of the index and one that is absent: how many visits before it go there.
LFTO = """nodes_ AS (SELECT DISTINCT node AS to FROM visits UNION ALL SELECT max(node) + 2 FROM visits), pairs_ AS (
  SELECT v.node, v.off, t.to, sum(CASE WHEN v.next = t.to THEN 1 ELSE 0 END) OVER (PARTITION BY v.node, t.to ORDER BY v.off) - CASE WHEN v.next = t.to THEN 1 ELSE 0 END AS before
  FROM visits v, nodes_ t WHERE v.node <> 0
)"""


def targets(idx):
    nodes = idx.node_sizes.select(F.col("node").alias("to")).unionAll(absent(idx))
    return positions(idx).filter("node <> 0").crossJoin(F.broadcast(nodes))  # the labels of the events


@query("q06_lf_to", SQL("SELECT p.node, p.off, p.to, CASE WHEN p.to <> 0 THEN rank_off + before END::BIGINT AS target FROM pairs_ p LEFT JOIN edges e ON e.src = p.node AND e.dst = p.to", E, LFTO))
def q06(spark, sf):
    idx = index(spark, sf)
    return search.lf_to(idx, targets(idx))


@query("q07_lf_range", SQL("SELECT query_id, x.to AS node, min(next_off) AS sp, max(next_off) AS ep, count(*) AS cnt FROM nexts x JOIN visits v ON v.node = x.node AND off BETWEEN sp AND (sp + ep) // 2 AND next = x.to GROUP BY query_id, x.to", P, FD, NEXTS))
def q07(spark, sf):
    """Ranges that are no whole states: the first half of each."""
    half = F.floor((F.col("sp") + F.col("ep")) / 2).cast("long")
    return search.extend(index(spark, sf), nexts(spark, sf).withColumn("ep", half))


@query("q08_lf_range_first_run", SQL("""SELECT query_id, h.to AS node, h.nsp AS sp, h.nep AS ep, h.first = h.sp AS starts_with_to, l.run_id AS first_run FROM (
    SELECT query_id, v.node, x.to, x.sp, min(next_off) AS nsp, max(next_off) AS nep, min(off) AS first FROM nexts x JOIN visits v ON v.node = x.node AND off BETWEEN sp AND ep AND next = x.to GROUP BY ALL
  ) h JOIN logical l ON l.node = h.node AND h.first >= l.start_off AND h.first < l.start_off + l.len""", P, FD, NEXTS, R))
def q08(spark, sf):
    return search.lf_range_first(index(spark, sf), nexts(spark, sf))


@query("q09_run_lf", SQL("SELECT node, off, v.next, v.next_off, r.run_id, r.start_off + r.len - 1 AS run_end FROM visits v JOIN runs r USING (node) WHERE off BETWEEN r.start_off AND r.start_off + r.len - 1 ", R))
def q09(spark, sf):
    idx = index(spark, sf)
    return search.run_lf(idx, positions(idx))


@query("q10_full_lf", SQL("""SELECT p.node, p.off, p.to, CASE WHEN p.to <> 0 THEN coalesce(rank_off + before, (SELECT sum(cnt) FROM edges l WHERE l.dst = p.to AND l.src < p.node), 0) END::BIGINT AS target
  FROM pairs_ p LEFT JOIN edges e ON e.src = p.node AND e.dst = p.to""", E, LFTO))
def q10(spark, sf):
    idx = index(spark, sf)
    return search.full_lf(idx, targets(idx))


@query("q11_inverse_lf", SQL("SELECT node, off, prev, prev_off FROM visits WHERE node <> 0 "))
def q11(spark, sf):
    idx = index(spark, sf)
    return search.inverse_lf(idx, positions(idx))


@query("q12_offset_to", SQL("SELECT next AS to, next_off AS i, node, off FROM visits WHERE next <> 0"))
def q12(spark, sf):
    idx = index(spark, sf)
    return search.offset_to(idx, positions(idx).filter("node <> 0").select(F.col("node").alias("to"), F.col("off").alias("i")))


@query("q13_bd_find", SQL("SELECT node, min(off) AS sp, max(off) AS ep, xor(node, 1) AS back_node, min(off) AS back_sp, max(off) AS back_ep FROM visits WHERE node <> 0 GROUP BY node"))
def q13(spark, sf):
    idx = index(spark, sf)
    return search.bd_find(idx, idx.visits.filter("node <> 0").select("node"))


#: Edges both ways round, so that some pairs are none in the direction that is asked.
PAIRS = "edge_ AS (SELECT DISTINCT node AS a, next AS b FROM visits WHERE node <> 0 AND next <> 0), pair_ AS (SELECT a, b FROM edge_ UNION SELECT b, a FROM edge_), number_ AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS i FROM pair_)"


def _bd_oracle(order: str) -> str:
    both = f"patterns AS (SELECT i * 2 AS query_id, {order} AS pattern FROM number_ UNION ALL SELECT i * 2 + 1, list_transform(list_reverse({order}), lambda x: xor(x, 1)) FROM number_)"
    return SQL("SELECT a AS start, b AS to, f.node, f.sp, f.ep, b.node AS back_node, b.sp AS back_sp, b.ep AS back_ep FROM found f JOIN found b ON b.query_id = f.query_id + 1 JOIN number_ ON f.query_id = i * 2".replace("SELECT a AS start, b AS to", "SELECT number_.a AS start, number_.b AS to"), PAIRS, both, FD)


def _bd_step(spark, sf, how):
    idx = index(spark, sf)
    edges = idx.edges.filter("src <> 0 and dst <> 0")
    pairs = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).union(edges.select("dst", "src")).distinct()
    pairs = cut(dense_ids(pairs, ["node", "to"], "query_id"))
    moved = how(idx, search.bd_find(idx, pairs.select("node").distinct()).join(pairs, "node"))
    return pairs.select("query_id", F.col("node").alias("start"), "to").join(moved.select("query_id", *search.BD_STATE), "query_id").drop("query_id")


@query("q14_bd_extend_forward", _bd_oracle("[a, b]"))
def q14(spark, sf):
    return _bd_step(spark, sf, search.bd_extend_forward)


@query("q15_bd_extend_backward", _bd_oracle("[b, a]"))
def q15(spark, sf):
    return _bd_step(spark, sf, search.bd_extend_backward)


#: The states of the patterns with every real node and with one that is absent, whether there is such an edge or not.
EVERY = "nexts AS (SELECT f.*, t.to FROM found f, (SELECT DISTINCT node AS to FROM visits WHERE node <> 0 UNION ALL SELECT max(node) + 2 FROM visits) t)"


@query("q16_reverse_offset", SQL("SELECT query_id, x.to, count(*) FILTER (next <> x.to AND (next = 0 OR xor(next, 1) < xor(x.to, 1))) AS reverse_offset FROM nexts x JOIN visits v ON v.node = x.node AND off BETWEEN sp AND ep GROUP BY query_id, x.to", P, FD, EVERY))
def q16(spark, sf):
    idx = index(spark, sf)
    nodes = idx.node_sizes.filter("node <> 0").select(F.col("node").alias("to")).unionAll(absent(idx))
    return search.reverse_offset(idx, states(spark, sf).crossJoin(F.broadcast(nodes)))  # the labels of the events


BOTH = SQL(
    "SELECT f.query_id // 2 AS query_id, f.node, f.sp, f.ep, b.node AS back_node, b.sp AS back_sp, b.ep AS back_ep FROM found f JOIN found b ON b.query_id = f.query_id + 1 WHERE f.query_id % 2 = 0",
    P.replace("patterns AS", "plain_ AS"), "patterns AS (SELECT 2 * query_id AS query_id, pattern FROM plain_ UNION ALL SELECT 2 * query_id + 1, list_transform(list_reverse(pattern), lambda x: xor(x, 1)) FROM plain_)", FD,
)


@query("q17_bidirectional_search", BOTH)
def q17(spark, sf):
    return search.bd_search(index(spark, sf), patterns(spark, sf), 4)


@query("q18_start", SQL("SELECT seq_id, next AS node, next_off AS off FROM visits WHERE pos = 0"))
def q18(spark, sf):
    idx = index(spark, sf)
    return search.start(idx, idx.visits.filter("pos = 0").select("seq_id"))


LCS = SQL("SELECT node, off, 1 + coalesce(list_position(list_transform(list_zip(prefix[1:least(len(prefix), len(o))], o[1:least(len(prefix), len(o))]), lambda p: p[1] = p[2] AND p[1] <> 0), false), least(len(prefix), len(o)) + 1) - 1 AS lcs FROM (SELECT r.node, r.off, prefix, lead(prefix) OVER (PARTITION BY r.node ORDER BY r.off) AS o FROM rank_ r JOIN pref_ p USING (seq_id, pos) WHERE r.pos > 0) WHERE o IS NOT NULL")


@query("q19_longest_common_suffix", LCS)
def q19(spark, sf):
    return search.longest_common_suffix(index(spark, sf))


@query("q19_lcs_by_doubling", LCS)
def q19_doubling(spark, sf):
    return search.longest_common_suffix(index(spark, sf), "doubling")


@query("q20_extend_all", SQL("SELECT query_id, next AS node, min(next_off) AS sp, max(next_off) AS ep, count(*) AS cnt FROM found f JOIN visits v ON v.node = f.node AND off BETWEEN sp AND ep WHERE next <> 0 GROUP BY query_id, next", P, FD))
def q20(spark, sf):
    return search.extend_all(index(spark, sf), states(spark, sf))


@query("q21_cached_search", SQL("SELECT * FROM found", P, FD))
def q21(spark, sf):
    """The search over cached visits; the cache is released again."""
    idx = index(spark, sf)
    cached = PathIndex(idx.visits.cache(), True)
    out = cut(search.find(cached, patterns(spark, sf)))
    cached.visits.unpersist()
    return out


# Locate and extract ----------------------------------------------------------------------------------


@query("l01_try_locate", SQL("SELECT node, off, CASE WHEN next = 0 OR (pos + 1) % 8 = 0 THEN seq_id END AS seq_id FROM visits"))
def l01(spark, sf):
    idx = index(spark, sf)
    return locate.try_locate(idx, positions(idx), 8)


@query("l02_next_sample", SQL("SELECT p.node, p.off, s.g - p.start AS sample_off, s.seq_id FROM global_ p ASOF JOIN (SELECT * FROM global_ WHERE due) s ON p.g <= s.g", """due_ AS (SELECT *, next = 0 OR (pos + 1) % 8 = 0 AS due FROM visits), starts_ AS (
  SELECT node, (sum(n) OVER (ORDER BY node) - n)::BIGINT AS start FROM (SELECT node, count(*) AS n, bool_or(due) AS has FROM due_ GROUP BY node) WHERE has
), global_ AS (SELECT *, start + off AS g FROM due_ JOIN starts_ USING (node))"""))
def l02(spark, sf):
    idx = index(spark, sf)
    return locate.next_sample(idx, positions(idx), 8)


@query("l03_locate_positions", SQL("SELECT node, off, seq_id FROM visits"))
def l03(spark, sf):
    idx = index(spark, sf)
    return locate.locate_positions(idx, positions(idx))


@query("l03_locate_by_walking", SQL("SELECT node, off, seq_id FROM visits"))
def l03_walk(spark, sf):
    idx = index(spark, sf)
    return locate.locate_by_walking(idx, positions(idx), 4)


LOCATED = SQL("SELECT DISTINCT query_id, seq_id FROM found f JOIN visits v ON v.node = f.node AND off BETWEEN sp AND ep", P, FD)


@query("l04_locate_state", LOCATED)
def l04(spark, sf):
    return locate.locate_states(index(spark, sf), states(spark, sf))


@query("l05_locate_direct", LOCATED)
def l05(spark, sf):
    return locate.locate_offsets(index(spark, sf), states(spark, sf))


@query("l06_extract", SQL("SELECT seq_id, array_to_string(path, ',') AS path FROM seqs UNION ALL SELECT -1, ''"))
def l06(spark, sf):
    idx = index(spark, sf)
    wanted = idx.visits.filter("pos = 0").select("seq_id").unionAll(spark.range(1).select(F.lit(-1).cast("long")))
    return locate.extract(idx, wanted).select("seq_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("l07_extract_from", SQL("SELECT v.node, v.off, CASE WHEN v.pos = 0 THEN '' ELSE array_to_string(s.path[v.pos : v.pos + 4], ',') END AS path FROM visits v JOIN seqs s USING (seq_id)"))
def l07(spark, sf):
    idx = index(spark, sf)
    return locate.extract_from(idx, positions(idx), 5).select("node", "off", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("l08_resample", SQL("SELECT node, off, seq_id FROM visits WHERE next = 0 OR (pos + 1) % 10 = 0"))
def l08(spark, sf):
    return stats.sampled(index(spark, sf), 10)


@query("l09_samples_at_ends", SQL("SELECT node, off, seq_id FROM visits WHERE next = 0"))
def l09(spark, sf):
    return stats.sampled(index(spark, sf), 0)


SA = "lens_ AS (SELECT seq_id, max(pos) AS length FROM visits GROUP BY seq_id), sa AS (SELECT node, off, seq_id, length - pos AS seq_offset, seq_id * m + length - pos AS packed, m AS max_length FROM visits JOIN lens_ USING (seq_id), (SELECT max(length) + 1 AS m FROM lens_))"


@query("l10_run_samples", SQL("SELECT l.node, l.run_id, a.seq_id AS head_seq, a.seq_offset AS head_offset, b.seq_id AS tail_seq, b.seq_offset AS tail_offset FROM logical l JOIN sa a ON a.node = l.node AND a.off = l.start_off JOIN sa b ON b.node = l.node AND b.off = l.start_off + l.len - 1", R, SA))
def l10(spark, sf):
    return locate.run_samples(index(spark, sf))


@query("l11_find_with_first", SQL("SELECT query_id, f.node, sp, ep, packed AS first, max_length FROM found f JOIN sa ON sa.node = f.node AND sa.off = f.sp", P, FD, SA))
def l11(spark, sf):
    return locate.find_with_first(index(spark, sf), states(spark, sf))


@query("l12_locate_by_successors", LOCATED)
def l12(spark, sf):
    idx = index(spark, sf)
    return locate.locate_by_successors(idx, locate.find_with_first(idx, states(spark, sf)))


@query("l13_suffix_array", SQL("SELECT * FROM sa", SA))
def l13(spark, sf):
    return locate.suffix_array(index(spark, sf))


@query("l14_unpack", SQL("SELECT packed, seq_id, seq_offset FROM sa", SA))
def l14(spark, sf):
    seq, offset = locate.unpack(F.col("packed"), F.col("max_length"))
    return locate.suffix_array(index(spark, sf)).select("packed", seq.alias("seq_id"), offset.alias("seq_offset"))


@query("l15_locate_next", SQL("SELECT * FROM (SELECT node, packed, lead(packed) OVER (PARTITION BY node ORDER BY off) AS next_packed FROM sa) WHERE next_packed IS NOT NULL", SA))
def l15(spark, sf):
    idx = index(spark, sf)
    return locate.locate_next(idx, locate.suffix_array(idx).select("node", "packed", "max_length"))


@query("l15_second_next", SQL("SELECT seq_id AS seq, seq_offset AS off, next_seq, next_off FROM (SELECT *, lead(seq_id, 2) OVER w AS next_seq, lead(seq_offset, 2) OVER w AS next_off FROM sa WINDOW w AS (PARTITION BY node ORDER BY off)) WHERE next_seq IS NOT NULL", SA))
def l15_second(spark, sf):
    """The follower's follower of every visit, by jumps of two places."""
    idx = index(spark, sf)
    every = locate.suffix_array(idx).select(F.col("seq_id").alias("seq"), F.col("seq_offset").alias("off"))
    return locate.followed(every, cut(locate.doubled_jumps(cut(locate.successors(locate.run_samples(idx)))))).filter("next_seq is not null")


# Invariants: what was compared, and that nothing differs ----------------------------------------------


def agrees(table: str, *parts: str) -> str:
    return SQL(f"SELECT count(*) AS compared, 0::BIGINT AS differing FROM {table}", *parts)


@query("v01_find_agrees", agrees("found", P, FD))
def v01(spark, sf):
    return verify.find_agrees(index(spark, sf), patterns(spark, sf), 4)


@query("v02_bidirectional_agrees", f"SELECT count(*) AS compared, 0::BIGINT AS differing FROM ({BOTH})")
def v02(spark, sf):
    return verify.bidirectional_agrees(index(spark, sf), patterns(spark, sf), 4)


@query("v03_locate_agrees", f"SELECT count(*) AS compared, 0::BIGINT AS differing FROM ({LOCATED})")
def v03(spark, sf):
    return verify.locate_agrees(index(spark, sf), states(spark, sf))


@query("v04_extract_agrees", agrees("seqs"))
def v04(spark, sf):
    from ..plans.index import both_orientations

    return verify.extract_agrees(index(spark, sf), both_orientations(paths(spark, sf)))


@query("v05_inverse_agrees", agrees("visits WHERE next <> 0"))
def v05(spark, sf):
    return verify.inverse_agrees(index(spark, sf))


@query("v06_samples_agree", agrees("visits WHERE next = 0 OR (pos + 1) % 16 = 0"))
def v06(spark, sf):
    return verify.samples_agree(index(spark, sf), 16)


@query("v07_run_heads_agree", agrees("visits"))
def v07(spark, sf):
    return verify.run_head_agrees(index(spark, sf))


@query("v08_lf_equation", agrees("visits WHERE next <> 0"))
def v08(spark, sf):
    return verify.lf_equation(index(spark, sf))


@query("i05_well_formed", SQL("SELECT 'offsets' AS \"check\", count(DISTINCT node) AS compared, 0::BIGINT AS differing FROM visits UNION ALL SELECT unnest(['starts', 'positions']), count(DISTINCT seq_id), 0 FROM visits"))
def i05(spark, sf):
    return verify.well_formed(index(spark, sf))


@query("i10_total_length", SQL("SELECT sum(cnt)::BIGINT AS total FROM found", P, FD))
def i10(spark, sf):
    return states(spark, sf).agg(F.sum("cnt").alias("total"))
