"""Metadata over the orders: path = order, sample = customer, contig = nation, phase = priority, count = rank within the chain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..operators import metadata as M
from ..plans.tables import cut, dense_ids
from ..sources.corpus import once, read
from .base import query
from .strings import NAMES, NATIONS, names, nations


def _path_names(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cust = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("contig_id"))
    phases = dense_ids(orders, ["o_orderpriority"], "phase")
    ids = dense_ids(orders, ["o_orderkey"], "path_id")
    joined = orders.join(cust, "o_custkey").join(F.broadcast(phases), "o_orderpriority").join(ids, "o_orderkey")  # five priorities
    chain = Window.partitionBy("o_custkey", "contig_id", "phase").orderBy("o_orderdate", "o_orderkey")
    return cut(joined.select("path_id", F.col("o_custkey").alias("sample_id"), "contig_id", "phase", (10 * (F.row_number().over(chain) - 1)).cast("long").alias("count")))


def pn(spark, sf):
    return once(spark, ("names", sf), lambda: _path_names(spark, sf))


PN = """pn AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS path_id, o_custkey AS sample_id, c_nationkey::BIGINT AS contig_id, phase, 10 * (row_number() OVER (PARTITION BY o_custkey, c_nationkey, phase ORDER BY o_orderdate, o_orderkey) - 1) AS count
  FROM (SELECT *, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS phase FROM orders) JOIN customer ON c_custkey = o_custkey
)"""


def meta(spark, sf) -> M.Metadata:
    own = pn(spark, sf)
    n = M.counts(own).first()
    return M.Metadata(names(spark, sf).count(), n["haplotypes"], nations(spark, sf).count(), own, names(spark, sf), nations(spark, sf))


def sql(tail: str, *parts: str) -> str:
    return "WITH " + ", ".join([PN, *parts]) + " " + tail


@query("m01_counts", sql("SELECT count(*) AS paths, count(DISTINCT sample_id) AS samples, count(DISTINCT (sample_id, phase)) AS haplotypes, count(DISTINCT contig_id) AS contigs FROM pn"))
def m01(spark, sf):
    return M.counts(pn(spark, sf))


@query("m02_paths", sql("SELECT * FROM pn"))
def m02(spark, sf):
    return pn(spark, sf)


@query("m03_names_to_ids", sql("SELECT w.sample, w.contig, w.path_id, coalesce(n.id, (SELECT count(*) FROM names)) AS sample_id, coalesce(t.id, (SELECT count(*) FROM nations)) AS contig_id FROM (SELECT path_id, CASE WHEN path_id % 5 = 0 THEN '?' ELSE a.string END AS sample, CASE WHEN path_id % 7 = 0 THEN '?' ELSE b.string END AS contig FROM pn JOIN names a ON a.id = sample_id JOIN nations b ON b.id = contig_id) w LEFT JOIN names n ON n.string = w.sample LEFT JOIN nations t ON t.string = w.contig", NAMES, NATIONS))
def m03(spark, sf):
    full = M.full_names(pn(spark, sf), names(spark, sf), nations(spark, sf)).select("path_id", F.when(F.col("path_id") % 5 == 0, "?").otherwise(F.col("sample")).alias("sample"), F.when(F.col("path_id") % 7 == 0, "?").otherwise(F.col("contig")).alias("contig"))
    return M.ids_of(full, names(spark, sf), nations(spark, sf))


@query("m04_full_names", sql("SELECT path_id, coalesce(a.string, sample_id::VARCHAR) AS sample, contig_id::VARCHAR AS contig, phase, count FROM pn LEFT JOIN names a ON a.id = sample_id AND a.id % 2 = 0", NAMES))
def m04(spark, sf):
    return M.full_names(pn(spark, sf), names(spark, sf).filter("id % 2 = 0"), None)


@query("m05_find_fragment", sql("SELECT q.query_id, p.path_id FROM queries q ASOF LEFT JOIN pn p ON p.sample_id = q.sample_id AND p.contig_id = q.contig_id AND p.phase = q.phase AND q.count >= p.count", "queries AS (SELECT path_id AS query_id, sample_id, contig_id, phase, count + path_id % 25 - 7 AS count FROM pn)"))
def m05(spark, sf):
    asked = pn(spark, sf).select(F.col("path_id").alias("query_id"), "sample_id", "contig_id", "phase", (F.col("count") + F.col("path_id") % 25 - 7).alias("count"))
    return M.find_fragment(pn(spark, sf), asked)


@query("m06_find_paths", sql("SELECT path_id FROM pn WHERE sample_id = s AND contig_id = c", "top_ AS (SELECT sample_id AS s, contig_id AS c FROM pn WHERE path_id = 0)").replace("FROM pn WHERE sample_id = s", "FROM pn, top_ WHERE sample_id = s"))
def m06(spark, sf):
    r = pn(spark, sf).filter("path_id = 0").first()
    return M.find_paths(pn(spark, sf), r["sample_id"], r["contig_id"])


@query("m07_paths_for_sample", sql("SELECT path_id FROM pn WHERE sample_id = 7"))
def m07(spark, sf):
    return M.find_paths(pn(spark, sf), sample=7)


@query("m07_paths_for_contig", sql("SELECT path_id FROM pn WHERE contig_id = 3"))
def m07_contig(spark, sf):
    return M.find_paths(pn(spark, sf), contig=3)


@query("m08_add_path", sql("SELECT * FROM pn UNION ALL SELECT count(*), 1, 2, 3, 4 FROM pn"))
def m08(spark, sf):
    own = pn(spark, sf)
    return own.unionByName(own.agg(F.count(F.lit(1)).alias("path_id")).select("path_id", *[F.lit(x).cast("long").alias(c) for x, c in zip((1, 2, 3, 4), M.PATH_NAME, strict=True)]))


@query("m09_sample_names", sql("SELECT path_id, string AS sample FROM pn JOIN names ON id = sample_id", NAMES))
def m09(spark, sf):
    return D.strings_of(names(spark, sf), pn(spark, sf).select(F.col("sample_id").alias("id")).distinct()).join(pn(spark, sf).select("path_id", F.col("sample_id").alias("id")), "id").select("path_id", F.col("string").alias("sample"))


@query("m10_remove_sample", sql("SELECT row_number() OVER (ORDER BY path_id) - 1 AS path_id, CASE WHEN sample_id > 7 THEN sample_id - 1 ELSE sample_id END AS sample_id, contig_id, phase, count FROM pn WHERE sample_id <> 7"))
def m10(spark, sf):
    return M.remove_sample(meta(spark, sf), 7)[0].path_names


@query("m10_removed_counts", sql("SELECT (SELECT count(*) FROM customer) - 1 AS samples, (SELECT count(DISTINCT (sample_id, phase)) FROM pn) - (SELECT count(DISTINCT phase) FROM pn WHERE sample_id = 7) AS haplotypes, (SELECT count(*) FROM pn WHERE sample_id = 7) AS removed"))
def m10_counts(spark, sf):
    left, gone = M.remove_sample(meta(spark, sf), 7)
    return spark.createDataFrame([(left.n_samples, left.n_haplotypes, gone.count())], "samples long, haplotypes long, removed long")


@query("m11_remove_contig", sql("SELECT row_number() OVER (ORDER BY path_id) - 1 AS path_id, sample_id, CASE WHEN contig_id > 3 THEN contig_id - 1 ELSE contig_id END AS contig_id, phase, count FROM pn WHERE contig_id <> 3"))
def m11(spark, sf):
    return M.remove_contig(meta(spark, sf), 3)[0].path_names


def _halves(spark, sf, named: bool):
    """The orders in two halves of their own samples; the second half's dictionary is in reverse order."""
    own, people = pn(spark, sf), names(spark, sf)
    n = people.count()
    first = M.Metadata(n, 0, 25, own.filter("path_id % 2 = 0").withColumn("path_id", F.shiftright("path_id", 1)), people if named else None, nations(spark, sf) if named else None)
    flipped = people.withColumn("id", F.lit(n - 1) - F.col("id"))
    second = own.filter("path_id % 2 = 1").withColumn("path_id", F.shiftright("path_id", 1)).withColumn("sample_id", F.lit(n - 1) - F.col("sample_id"))
    return first, M.Metadata(n, 0, 25, second, flipped if named else None, nations(spark, sf) if named else None)


@query("m13_merge_by_name", sql("SELECT path_id // 2 AS path_id, sample_id, contig_id, phase, count FROM pn WHERE path_id % 2 = 0 UNION ALL SELECT path_id // 2 + (SELECT count(*) FROM pn WHERE path_id % 2 = 0), sample_id, contig_id, phase, count FROM pn WHERE path_id % 2 = 1"))
def m13(spark, sf):
    return M.merge(*_halves(spark, sf, True), False, False).path_names


@query("m13_merge_by_id", sql("SELECT path_id // 2 AS path_id, sample_id, contig_id, phase, count FROM pn WHERE path_id % 2 = 0 UNION ALL SELECT path_id // 2 + (SELECT count(*) FROM pn WHERE path_id % 2 = 0), 2 * n - 1 - sample_id, contig_id, phase, count FROM pn, (SELECT count(*) AS n FROM customer) WHERE path_id % 2 = 1"))
def m13_id(spark, sf):
    return M.merge(*_halves(spark, sf, False), False, True).path_names


@query("m12_merge_all", sql("SELECT 3 * (SELECT count(*) FROM customer) AS samples, 25::BIGINT AS contigs, 3 * count(*) AS paths FROM pn"))
def m12(spark, sf):
    one = M.Metadata(names(spark, sf).count(), 0, 25, pn(spark, sf))
    out = M.merge_all([one, one, one], same_samples=False, same_contigs=True)
    return spark.createDataFrame([(out.n_samples, out.n_contigs)], "samples long, contigs long").crossJoin(out.path_names.agg(F.count(F.lit(1)).alias("paths")))  # one row each


@query("m14_split", sql("SELECT CAST(contig_id % 3 AS BIGINT) AS subgraph, row_number() OVER (PARTITION BY contig_id % 3 ORDER BY path_id) - 1 AS path_id, dense_rank() OVER (PARTITION BY contig_id % 3 ORDER BY fs) - 1 AS sample_id, dense_rank() OVER (PARTITION BY contig_id % 3 ORDER BY fc) - 1 AS contig_id, phase, count, sample_id AS old_sample, contig_id AS old_contig FROM (SELECT *, min(path_id) OVER (PARTITION BY contig_id % 3, sample_id) AS fs, min(path_id) OVER (PARTITION BY contig_id % 3, contig_id) AS fc FROM pn)"))
def m14(spark, sf):
    return M.split(pn(spark, sf), pn(spark, sf).select("path_id", F.pmod("contig_id", F.lit(3)).cast("long").alias("subgraph")))


@query("m15_equal", "SELECT 0::BIGINT AS different")
def m15(spark, sf):
    a, b = pn(spark, sf), _path_names(spark, sf)
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count(F.lit(1)).alias("different"))


CHAINS = "fm AS (SELECT path_id, dense_rank() OVER (ORDER BY sample_id, contig_id, phase) - 1 AS chain, lag(path_id) OVER w AS prev_path, lead(path_id) OVER w AS next_path FROM pn WINDOW w AS (PARTITION BY sample_id, contig_id, phase ORDER BY count, path_id))"


@query("m16_fragment_map", sql("SELECT * FROM fm", CHAINS))
def m16(spark, sf):
    return M.fragment_map(pn(spark, sf))


@query("m17_oriented_next", sql("SELECT o AS oriented, 2 * CASE WHEN o % 2 = 1 THEN prev_path ELSE next_path END + o % 2 AS next_oriented, 2 * CASE WHEN o % 2 = 1 THEN next_path ELSE prev_path END + o % 2 AS prev_oriented FROM (SELECT *, 2 * path_id + r AS o FROM fm, (VALUES (0), (1)) x(r))", CHAINS))
def m17(spark, sf):
    own = M.fragment_map(pn(spark, sf))
    return M.oriented_next(own, own.select(F.explode(F.array(F.col("path_id") * 2, F.col("path_id") * 2 + 1)).alias("oriented")))


@query("m18_list_contigs", sql("SELECT n.id, n.string AS name, count(pn.path_id) AS paths FROM nations n LEFT JOIN pn ON contig_id = n.id GROUP BY ALL", NATIONS))
def m18(spark, sf):
    used = pn(spark, sf).groupBy("contig_id").agg(F.count(F.lit(1)).alias("paths"))
    return nations(spark, sf).join(used, F.col("id") == F.col("contig_id"), "left").select("id", F.col("string").alias("name"), F.coalesce("paths", F.lit(0).cast("long")).alias("paths"))
