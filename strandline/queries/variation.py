"""Variants and haplotypes. The reference is a path over the parts; sites, alleles and genotypes follow from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variants as V
from ..plans.tables import cut, placed
from ..sources.corpus import once, read
from .base import query

#: Sites of the contig that every customer has a genotype at.
SITES = 40


def _contig(marks, n: int) -> V.VariantPaths:
    """A contig of ``n`` sites (site, mark): every eighth reference position starts a site of 1 to 3 nodes, or of 10 where the mark says so, which overlaps the next one."""
    spark, alone = marks.sparkSession, 8 * n + 1000
    reference = marks.select(F.explode(F.sequence(F.col("site") * 8, F.col("site") * 8 + 7)).alias("pos")).unionAll(spark.range(8 * n, 8 * n + 16)).select("pos", (F.col("pos") + 1).alias("node"))
    sites = marks.select("site", (F.col("site") * 8).alias("ref_start"), (F.col("site") * 8 + F.when(F.col("mark") % 4 == 1, 10).otherwise(F.col("mark") % 3 + 1)).alias("ref_end"))
    alleles = sites.select("site", "ref_start", "ref_end", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("allele"))
    own = lambda k: F.col("site") * 10 + alone + k
    path = F.when((F.col("allele") == 2) & (F.col("site") % 2 == 1), F.concat(F.array(own(0)), F.transform(F.sequence(F.col("ref_start") + 1, F.col("ref_end") - 1), lambda x: x + 1))).otherwise(F.array(own(F.col("allele")), own(F.col("allele") + 5)))
    path = F.when(F.col("ref_end") - F.col("ref_start") >= 2, path).otherwise(F.array(own(F.col("allele"))))
    return V.VariantPaths(cut(reference), cut(sites), cut(alleles.select("site", "allele", path.alias("path"))))


def vp(spark, sf) -> V.VariantPaths:
    """A contig with a site for every part."""

    def make():
        part = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("mark"))
        marks = cut(placed(part, ["p_partkey"], "site", ["mark"]))
        return _contig(marks, marks.count())

    return once(spark, ("parts", sf), make)


def short(spark, sf) -> V.VariantPaths:
    """The contig of the customers' genotypes."""
    return once(spark, ("variants", sf), lambda: _contig(spark.range(SITES).select(F.col("id").alias("site"), F.col("id").alias("mark")), SITES))


_PATHS = """n_ AS (SELECT count(*) AS n FROM marks), reference AS (SELECT i AS pos, i + 1 AS node FROM (SELECT unnest(generate_series(0, 8 * n + 15)) AS i FROM n_)), sites AS (
  SELECT i AS site, i * 8 AS ref_start, i * 8 + CASE WHEN mark % 4 = 1 THEN 10 ELSE mark % 3 + 1 END AS ref_end FROM marks
), alleles AS (
  SELECT site, allele, CASE WHEN ref_end - ref_start < 2 THEN [own + allele] WHEN allele = 2 AND site % 2 = 1 THEN list_prepend(own, list_transform(generate_series(ref_start + 1, ref_end - 1), lambda x: x + 1))
    ELSE [own + allele, own + allele + 5] END AS path FROM (SELECT *, site * 10 + 8 * n + 1000 AS own FROM sites, n_), (VALUES (1::BIGINT), (2)) a(allele)
), every_ AS (
  SELECT site, 0 AS allele, (SELECT list(node ORDER BY pos) FROM reference WHERE pos >= ref_start AND pos < ref_end) AS path FROM sites UNION ALL SELECT site, allele, path FROM alleles
)"""
VP = "marks AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_size::BIGINT AS mark FROM part), " + _PATHS
SHORT = f"marks AS (SELECT i, i AS mark FROM (SELECT unnest(generate_series(0, {SITES - 1})) AS i)), " + _PATHS
GENOTYPES = "genotypes AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN (o_custkey % 3)::VARCHAR WHEN 2 THEN concat(o_custkey % 3, '|', o_orderkey % 2) WHEN 3 THEN concat(o_custkey % 3, '/', o_orderkey % 2) ELSE '.|.' END AS text, o_orderkey % 2 = 0 AS was, o_custkey % 2 = 0 AS homo FROM orders)"
PARSED = """parsed AS (SELECT id, text, CASE WHEN text = '' THEN 0 ELSE coalesce(try_cast(regexp_extract(text, '^([0-9]+)', 1) AS BIGINT), 0) END AS first,
  CASE WHEN text = '' THEN 0 ELSE coalesce(try_cast(regexp_extract(text, '[|/]([0-9]+)', 1) AS BIGINT), 0) END AS second, CASE WHEN text = '' THEN was ELSE regexp_matches(text, '[|/]') END AS diploid, text, was, homo FROM genotypes), typed AS (
  SELECT id, first, second, diploid, text = '' OR NOT regexp_matches(text, '[|/]') OR regexp_matches(text, '[|]') OR (homo AND first = second) AS phased FROM parsed)"""


def genotypes(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.when(o % 5 == 0, "").when(o % 5 == 1, (c % 3).cast("string")).when(o % 5 == 2, F.concat((c % 3).cast("string"), F.lit("|"), (o % 2).cast("string"))).when(o % 5 == 3, F.concat((c % 3).cast("string"), F.lit("/"), (o % 2).cast("string"))).otherwise(".|.")
    rows = read(spark, sf, "orders").select(o.alias("id"), text.alias("text"), (o % 2 == 0).alias("was"), (c % 2 == 0).alias("homo"))
    return rows.select("id", V.parse_genotype(F.col("text"), F.col("was"), F.col("homo")).alias("g"))


@query("h01_site_summary", f"WITH {VP} SELECT site, coalesce(lag(ref_end) OVER (ORDER BY site), 0) AS ref_prev, ref_start, ref_end, 3::BIGINT AS alleles FROM sites")
def h01(spark, sf):
    return V.site_summary(vp(spark, sf))


@query("h02_alleles", f"WITH {VP} SELECT site, allele, array_to_string(path, ',') AS path FROM every_")
def h02(spark, sf):
    return V.all_alleles(vp(spark, sf)).select("site", "allele", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("h03_node_width", f"WITH {VP} SELECT len(bin(2 * max(n) + 1)) AS width FROM (SELECT node AS n FROM reference UNION ALL SELECT unnest(path) FROM alleles)")
def h03(spark, sf):
    return V.node_width(vp(spark, sf))


@query("h04_first_occurrence", f"WITH {VP} SELECT node, min(pos) AS first FROM reference GROUP BY node")
def h04(spark, sf):
    return V.first_occurrence(vp(spark, sf))


@query("h05_build", f"WITH {VP} SELECT (SELECT count(*) FROM reference) AS size, (SELECT count(*) FROM sites) AS sites, (SELECT count(*) FROM alleles) AS paths")
def h05(spark, sf):
    v = vp(spark, sf)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(v.reference, "size").crossJoin(n(v.sites, "sites")).crossJoin(n(v.alleles, "paths"))  # one row each


@query("h08_overlaps", f"""WITH {VP}, near_ AS (SELECT *, lag(site) OVER (ORDER BY site) AS before, lag(ref_end) OVER (ORDER BY site) AS before_end FROM sites)
SELECT n.site, (before_end - n.ref_start)::INTEGER AS overlap, count(*) FILTER (fit) AS resolved, count(*) FILTER (NOT fit) AS unresolved FROM (
  SELECT n.*, len(a.path) >= before_end - n.ref_start AND len(b.path) >= before_end - n.ref_start AND a.path[len(a.path) - (before_end - n.ref_start) + 1 :] = b.path[1 : before_end - n.ref_start] AS fit
  FROM near_ n JOIN every_ a ON a.site = n.before JOIN every_ b ON b.site = n.site WHERE before_end > n.ref_start) n GROUP BY ALL""")
def h08(spark, sf):
    return V.overlaps(vp(spark, sf))


@query("k08_saved_variants", f"""WITH {VP} SELECT 'alleles' AS part, count(*) AS n, sum(list_sum(path))::BIGINT AS nodes FROM alleles UNION ALL SELECT 'reference', count(*), sum(node)::BIGINT FROM reference
  UNION ALL SELECT 'sites', count(*), sum(ref_end - ref_start)::BIGINT FROM sites""")
def k08(spark, sf):
    """A contig as written and read back with its checks."""
    from ..sources import bundle
    from .scan import place

    at = place(spark)
    bundle.save_variants(vp(spark, sf), at)
    v = bundle.load_variants(spark, at)
    total = lambda name, df, value: df.agg(F.count(F.lit(1)).alias("n"), F.sum(value).cast("long").alias("nodes")).select(F.lit(name).alias("part"), "n", "nodes")
    sums = F.aggregate("path", F.lit(0).cast("long"), lambda a, x: a + x)
    return total("alleles", v.alleles, sums).unionAll(total("reference", v.reference, F.col("node"))).unionAll(total("sites", v.sites, F.col("ref_end") - F.col("ref_start")))


@query("i08_node_ids", f"WITH {VP} SELECT site, allele, array_to_string(list_transform(path, lambda x: x // 2), ',') AS path FROM every_")
def i08(spark, sf):
    return V.node_ids(V.all_alleles(vp(spark, sf))).select("site", "allele", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("h09_parse_genotypes", f"WITH {GENOTYPES}, {PARSED} SELECT * FROM typed")
def h09(spark, sf):
    return genotypes(spark, sf).select("id", "g.*")


@query("h10_force_phased", f"WITH {GENOTYPES}, {PARSED} SELECT id, CASE WHEN NOT phased AND id % 3 = 0 THEN second ELSE first END AS first, CASE WHEN NOT phased AND id % 3 = 0 THEN first ELSE second END AS second, diploid, true AS phased FROM typed")
def h10(spark, sf):
    return genotypes(spark, sf).select("id", V.force_phased(F.col("g"), F.col("id") % 3 == 0).alias("g")).select("id", "g.*")


@query("h11_genotype_codes", f"WITH {GENOTYPES}, {PARSED} SELECT id, (CASE WHEN NOT diploid THEN 0 WHEN phased THEN 2 ELSE 1 END + 3 * first + 9 * second)::BIGINT AS code, first, second, 26::BIGINT AS top FROM typed")
def h11(spark, sf):
    two = F.lit(2).cast("long")
    coded = genotypes(spark, sf).select("id", V.encode_genotype(F.col("g"), two).alias("code"))
    return coded.select("id", "code", V.decode_genotype(F.col("code"), two).alias("d"), V.max_code(two).alias("top")).select("id", "code", "d.first", "d.second", "top")


@query("h12_print_genotypes", f"WITH {GENOTYPES}, {PARSED} SELECT id, CASE WHEN NOT diploid THEN first::VARCHAR ELSE concat(first, CASE WHEN phased THEN '|' ELSE '/' END, second) END AS text FROM typed")
def h12(spark, sf):
    return genotypes(spark, sf).select("id", V.print_genotype(F.col("g")).alias("text"))


def phasings(spark, sf):
    """A genotype for each site and customer: phased, unphased and haploid stretches."""
    cust = read(spark, sf, "customer").select(F.col("c_custkey").alias("sample")).repartition(4 * spark.sparkContext.defaultParallelism, "sample")  # a small file is one split
    rows = cust.crossJoin(F.broadcast(short(spark, sf).sites.select("site")))  # the sites of one contig
    x = F.col("sample") * 31 + F.col("site") * 17
    return rows.select((F.col("sample") % 2).alias("file"), "site", "sample", (x % 3).alias("first"), (F.floor(x / 3) % 3).alias("second"), (F.floor(F.col("site") / 10 + F.col("sample")) % 4 != 3).alias("diploid"), (x % 11 != 0).alias("phased"))


#: How many leading nodes two lists have in common.
ALIKE = "coalesce(nullif(list_position(list_transform(list_zip({x}[1:least(len({x}), len({y}))], {y}[1:least(len({x}), len({y}))]), lambda p: p[1] = p[2]), false), 0) - 1, least(len({x}), len({y})))"


def alike(x: str, y: str) -> str:
    return ALIKE.format(x=x, y=y)


@query("h06_fill_reference", f"""WITH {VP}, until_ AS (SELECT site, ref_end, coalesce(lead(ref_start) OVER (ORDER BY site), (SELECT count(*) FROM reference)) AS until FROM sites)
SELECT site, allele, array_to_string(list_concat(path, coalesce((SELECT list(node ORDER BY pos) FROM reference WHERE pos >= ref_end AND pos < until), [])), ',') AS path FROM every_ JOIN until_ USING (site)""")
def h06(spark, sf):
    return V.filled_alleles(vp(spark, sf)).select("site", "allele", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("h07_append_variant", f"""WITH {VP}, ref_ AS (SELECT list(node ORDER BY pos) AS r FROM reference), near_ AS (
  SELECT s.site, a.allele AS before, b.allele, a.path AS t, b.path AS h, t.ref_end AS e, s.ref_start AS b FROM sites s JOIN sites t ON t.site = s.site - 1 JOIN alleles a ON a.site = t.site JOIN alleles b ON b.site = s.site
), met_ AS (SELECT *, r[b + 1 : e] AS x, r[e + 1 : b] AS gap, list_reverse(t) AS rt, list_reverse(r[b + 1 : e]) AS rx FROM near_, ref_), both_ AS (SELECT *, {alike("rt", "rx")} AS s, {alike("h", "x")} AS p FROM met_)
SELECT site, before, allele, CASE WHEN s + p >= len(x) THEN s END AS cut, CASE WHEN s + p >= len(x) THEN array_to_string(list_concat(list_concat(t[1 : len(t) - s], gap), h[len(x) - s + 1 :]), ',') END AS path FROM both_""")
def h07(spark, sf):
    return V.joined_alleles(vp(spark, sf)).select("site", "before", "allele", "cut", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


#: The genotypes of ``phasings``, and one step of a recursion for each site: a walk (file, sample, phase) with its nodes, and what ends in the step.
PHASINGS = """phasings AS (
  SELECT c_custkey % 2 AS file, site, c_custkey AS sample, x % 3 AS first, (x // 3) % 3 AS second, (site // 10 + c_custkey) % 4 <> 3 AS diploid, x % 11 <> 0 AS phased
  FROM (SELECT *, c_custkey * 31 + site * 17 AS x FROM customer, sites)
)"""


def _generated(tail: str, skip: bool, files: str = "true") -> str:
    """``made``: (file, sample, phase, ends, k, path) in the order of the sites, and the query over it."""
    return f"""WITH RECURSIVE {SHORT}, {PHASINGS}, ref_ AS (SELECT list(node ORDER BY pos) AS r, count(*) AS size FROM reference), bounds_ AS (
  SELECT site, ref_start AS b, ref_end AS e, coalesce(lag(ref_end) OVER (ORDER BY site), 0) AS prev_end, coalesce(lead(ref_start) OVER (ORDER BY site), (SELECT size FROM ref_)) AS next_b FROM sites
), steps AS (
  SELECT p.*, phase, b, e, prev_end, next_b, a.path AS allele FROM phasings p JOIN bounds_ USING (site), (VALUES (0), (1)) f(phase)
  LEFT JOIN alleles a ON a.site = p.site AND a.allele = CASE WHEN phase = 0 THEN p.first ELSE p.second END WHERE {files}
), walk AS (
  SELECT file, sample, phase, -1::BIGINT AS site, false AS alive, false AS dip, []::BIGINT[] AS nodes, 0::BIGINT AS at_, []::STRUCT(ends BIGINT, path BIGINT[])[] AS ended FROM (SELECT DISTINCT file, sample, phase FROM steps)
  UNION ALL
  SELECT file, sample, phase, site, on_ AND phased, dip, CASE WHEN NOT on_ THEN []::BIGINT[] ELSE grown END, stop_,
         list_concat(list_concat(CASE WHEN broken THEN [{{'ends': site, 'path': closing}}] ELSE [] END, CASE WHEN torn THEN [{{'ends': site, 'path': nodes}}] ELSE [] END),
                     CASE WHEN on_ AND NOT phased THEN [{{'ends': site, 'path': list_concat(grown, r[stop_ + 1 : next_b])}}] ELSE [] END)
  FROM (
    SELECT *, CASE WHEN allele IS NULL OR clash AND NOT torn THEN nodes WHEN torn THEN allele ELSE list_concat(list_concat(nodes[1 : len(nodes) - s], r[at_ + 1 : b]), allele[len(x) - s + 1 :]) END AS grown,
           CASE WHEN allele IS NULL OR clash AND NOT torn THEN at_ ELSE e END AS stop_
    FROM (
      SELECT *, on_ AND allele IS NOT NULL AND s + p < len(x) AS clash, on_ AND allele IS NOT NULL AND s + p < len(x) AND NOT {str(skip).lower()} AS torn
      FROM (
        SELECT *, {alike("rn", "rx")} AS s, {alike("allele", "x")} AS p
        FROM (SELECT *, list_reverse(nodes) AS rn, list_reverse(x) AS rx FROM (SELECT *, r[b + 1 : at_] AS x FROM (
          SELECT file, sample, phase, site, broken, closing, phased, b, e, next_b, allele, r, phase = 0 OR diploid AS on_,
                 CASE WHEN broken OR NOT alive THEN []::BIGINT[] ELSE nodes END AS nodes, CASE WHEN broken OR NOT alive THEN prev_end ELSE at_ END AS at_, CASE WHEN broken OR NOT alive THEN diploid ELSE dip END AS dip
          FROM (
            SELECT w.nodes, w.at_, w.alive, w.dip, t.*, r, w.alive AND (NOT t.phased OR CASE WHEN t.phase = 0 THEN w.dip <> t.diploid ELSE NOT t.diploid END) AS broken, list_concat(w.nodes, r[w.at_ + 1 : t.b]) AS closing
            FROM walk w JOIN steps t ON t.file = w.file AND t.sample = w.sample AND t.phase = w.phase AND t.site = w.site + 1, ref_
          ))))
      )
    )
  )
), sites_n AS (SELECT count(*) AS n FROM sites), parts AS (
  SELECT file, sample, phase, site, i, ended[i].ends AS ends, ended[i].path AS path FROM (SELECT *, unnest(range(1, len(ended) + 1)) AS i FROM walk)
  UNION ALL SELECT file, sample, phase, n, 1, n, list_concat(nodes, r[at_ + 1 : size]) FROM walk, ref_, sites_n WHERE site = n - 1 AND alive
), counted AS (
  SELECT *, row_number() OVER (PARTITION BY file, sample, phase ORDER BY site, i) - 1 AS k FROM parts
), made AS (
  SELECT dense_rank() OVER (ORDER BY file, ends, sample, phase, k) - 1 AS seq_id, file, sample, phase, k AS count, path FROM counted
) {tail}"""


PRINTED = "SELECT seq_id, file, sample, phase, count, array_to_string(path, ',') AS path FROM made"


@query("h13_generate_haplotypes", _generated(PRINTED, skip=False))
def h13(spark, sf):
    return V.generate_haplotypes(short(spark, sf), phasings(spark, sf)).select("seq_id", "file", "sample", "phase", "count", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("h13_generate_skipping", _generated(PRINTED, skip=True, files="p.file = 1"))
def h13_skip(spark, sf):
    return V.generate_haplotypes(short(spark, sf), phasings(spark, sf), skip=True, files=[1], piece_sites=16).select("seq_id", "file", "sample", "phase", "count", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("h14_indexed_haplotypes", _generated("""SELECT sequences, size, least_ - 1 AS offset, top + 1 AS alphabet_size, top + 2 - least_ AS effective, true AS bidirectional FROM (
  SELECT 2 * count(*) AS sequences, (2 * sum(len(path) + 1))::BIGINT AS size, min(2 * list_min(path)) AS least_, max(2 * list_max(path)) + 1 AS top FROM made)""", skip=False))
def h14(spark, sf):
    """Generated, named, indexed in both orientations, and described."""
    from ..tools import build_from_variants
    from .scan import place

    return build_from_variants(spark, place(spark), short(spark, sf), phasings(spark, sf)).header
