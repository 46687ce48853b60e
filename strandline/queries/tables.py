"""Tools and the streaming builder, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tools
from ..operators import stats
from ..plans import oracle as O
from ..sources import bundle
from ..sources.corpus import index, paths
from ..streaming.builder import StreamingBuilder
from .base import query
from .construct import SHIFTED, _from, halves
from .scan import joined, place
from .names import PN
from .strings import NAMES, NATIONS


@query("e01_build_tool", O.sql("SELECT * FROM visits"))
def e01(spark, sf):
    """From a text file."""
    at = place(spark)
    joined(paths(spark, sf)).repartitionByRange(3, "path_id").sortWithinPartitions("path_id").select("path").write.text(f"{at}-text")
    return tools.build(spark, at, text=f"{at}-text").visits


@query("e02_run_head_tool", O.sql("SELECT node, count(*) AS runs FROM logical GROUP BY node", O.RUNS))
def e02(spark, sf):
    at = place(spark)
    bundle.save(index(spark, sf), at)
    return tools.build_run_heads(spark, at).groupBy("node").agg(F.count(F.lit(1)).alias("runs"))


@query("e03_merge_tool", _from(SHIFTED))
def e03(spark, sf):
    at = place(spark)
    first, second = halves(spark, sf)
    tools.build(spark, f"{at}-a", paths=second)
    tools.build(spark, f"{at}-b", paths=first)
    return tools.merge(spark, f"{at}-c", [f"{at}-a", f"{at}-b"]).visits


@query("e04_remove_tool", _from("SELECT path_id - 3 AS path_id, p, node FROM base_ WHERE path_id > 2"))
def e04(spark, sf):
    at = place(spark)
    bundle.save(index(spark, sf), at)
    tools.remove(spark, at, f"{at}-out", ids=[0, 1, 2])
    return bundle.load(spark, f"{at}-out")[0].visits


@query("e05_metadata_tool", f"WITH {PN}, {NAMES}, {NATIONS} SELECT 'samples' AS what, id, string AS name FROM names UNION ALL SELECT 'contigs', id, string FROM nations UNION ALL SELECT 'paths', path_id, printf('(%s, %s, %d, %d)', n.string, t.string, phase, count) FROM pn JOIN names n ON n.id = sample_id JOIN nations t ON t.id = contig_id")
def e05(spark, sf):
    """All that the tool lists by name; the same bundle without its metadata has nothing to list."""
    from .names import meta

    at = place(spark)
    bundle.save(index(spark, sf), at, metadata=meta(spark, sf))
    assert tools.clear_metadata(spark, at, f"{at}-bare").metadata is None
    listed = [tools.list_metadata(spark, at, what).select(F.lit(what).alias("what"), "id", "name") for what in ("samples", "contigs", "paths")]
    return listed[0].unionAll(listed[1]).unionAll(listed[2])


RESULTS = "SELECT unnest(['bidirectional', 'find', 'find_by_extension']) AS work, count(*) AS results FROM found UNION ALL SELECT unnest(['locate', 'locate_by_run_heads']), count(*) FROM (SELECT DISTINCT query_id, seq_id FROM found f JOIN visits v ON v.node = f.node AND off BETWEEN sp AND ep) UNION ALL SELECT 'extract', count(*) FROM seqs UNION ALL SELECT 'lcs', count(*) - count(DISTINCT node) FROM visits WHERE node <> 0"


@query("e06_benchmark_tool", O.sql(RESULTS, O.patterns_sql(), O.FOUND))
def e06(spark, sf):
    """How many results each of the timed searches has."""
    from ..sources.corpus import patterns

    at = place(spark)
    bundle.save(index(spark, sf), at)
    rows = [(name, results) for name, (_, results) in tools.benchmark(spark, at, patterns(spark, sf), 4).items()]
    return spark.createDataFrame(rows, "work string, results long")


@query("st01_streaming_builder", O.sql("SELECT * FROM visits"))
def st01(spark, sf):
    """The paths arrive in three parts, and the stream is started anew after each: every start reads what is new as one batch."""
    at = place(spark)
    source = paths(spark, sf).select(F.col("path_id").alias("key"), "path")
    n, parts = source.count(), 3
    builder = StreamingBuilder(spark, f"{at}-runs")
    for k in range(parts):
        source.filter((F.col("key") >= n * k // parts) & (F.col("key") < n * (k + 1) // parts)).write.mode("append").parquet(f"{at}-in")
        builder.run(spark.readStream.schema("key long, path array<bigint>").parquet(f"{at}-in"), f"{at}-state").awaitTermination()
    return builder.finish().visits


# Smaller operators -----------------------------------------------------------------------------------


@query("c12_decompressed_records", O.sql("SELECT node, off, next, next_off FROM visits"))
def c12(spark, sf):
    """Every record unfolded from its runs: one row a visit, offsets at the successor from the edge's start and the rank among equals."""
    return stats.unfolded(index(spark, sf))


@query("c14_metadata_policy", "SELECT 'insert' AS kind, 2 * (SELECT count(*) FROM customer) AS samples, 25::BIGINT AS contigs UNION ALL SELECT 'disjoint', (SELECT count(*) FROM customer), 50::BIGINT")
def c14(spark, sf):
    from ..operators import metadata as M
    from ..sources.corpus import read

    n = read(spark, sf, "customer").count()
    one = M.Metadata(n, n, 25)
    rows = [(kind, *M.merge_policy(kind, one, False, one).counts()[::2]) for kind in ("insert", "disjoint")]
    return spark.createDataFrame(rows, "kind string, samples long, contigs long")


@query("s09_phasing_scan", "SELECT o_custkey % 3 AS file, o_orderkey AS site, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_custkey % 3 = 1")
def s09(spark, sf):
    """One file's sites in order."""
    from pyspark.sql import Window

    from ..sources.corpus import read

    at = place(spark)
    bundle.append_phasings(read(spark, sf, "orders").select(F.col("o_orderkey").alias("site"), (F.col("o_custkey") % 3).alias("file")), at)
    order = Window.partitionBy("file").orderBy("site")
    return bundle.read_phasings(spark, at, [1]).select(F.col("file").cast("long").alias("file"), "site", (F.row_number().over(order) - 1).cast("long").alias("i"))


@query("k06_metadata_written", f"WITH {PN}, {NAMES}, {NATIONS} SELECT 'path_names' AS part, count(*) AS n, true AS written FROM pn UNION ALL SELECT 'samples', count(*), true FROM names UNION ALL SELECT 'contigs', count(*), true FROM nations")
def k06(spark, sf):
    """The rows of each part of the metadata as read back, and that it takes bytes."""
    from .names import meta

    at = place(spark)
    bundle.save(index(spark, sf), at, metadata=meta(spark, sf))
    back = bundle.load(spark, at)[1]
    rows = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    parts = rows("path_names", back.path_names).unionAll(rows("samples", back.samples)).unionAll(rows("contigs", back.contigs))
    return parts.join(bundle.sizes(spark, at), "part").select("part", "n", (F.col("bytes") > 0).alias("written"))


@query("k10_printed_header", O.sql("SELECT printf('bidirectional index: %d sequences, %d visits, nodes above %d and below %d', count(*) FILTER (pos = 0), count(*), min(node) FILTER (node > 0) - 1, max(node) + 1) AS text FROM visits"))
def k10(spark, sf):
    return stats.printed_header(index(spark, sf))


@query("k12_temporary_tables", O.sql("SELECT count(*) AS rows_before, true AS gone FROM visits"))
def k12(spark, sf):
    """A table that was cut and forgotten: its rows while it was there, and that its folder holds nothing any more."""
    from ..plans.tables import cut, forget, shared_dir

    table = cut(index(spark, sf).visits.select("node"))
    rows = table.count()
    forget(table)
    left = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(shared_dir(spark)).select("path").filter(F.col("path").contains(table.cut_path.rpartition("/")[2]))
    return spark.createDataFrame([(rows, left.limit(1).count() == 0)], "rows_before long, gone boolean")


@query("c11_converted_forms", O.sql("SELECT node, off, seq_id, pos, next, next_off, prev, prev_off FROM visits"))
def c11(spark, sf):
    """Written plain, read, written compressed, read: the same visits."""
    at = place(spark)
    bundle.save(index(spark, sf), f"{at}-plain", "plain")
    bundle.save(bundle.load(spark, f"{at}-plain")[0], f"{at}-compressed", "compressed")
    return bundle.load(spark, f"{at}-compressed")[0].visits


@query("u05_sample_ranges", O.sql("SELECT node, count(*) AS samples, min(off) AS first_off, max(off) AS last_off FROM visits WHERE next = 0 OR (pos + 1) % 8 = 0 GROUP BY node"))
def u05(spark, sf):
    return stats.sample_ranges(index(spark, sf), 8)


@query("k03_compression_helps", O.sql("SELECT unnest(['compressed', 'plain']) AS form, count(*) AS n, sum(off)::BIGINT AS offsets, true AS smaller FROM visits"))
def k03(spark, sf):
    """Both forms hold the same visits, and the compressed one is smaller."""
    at = place(spark)
    for form in bundle.CODECS:
        bundle.save(index(spark, sf), f"{at}-{form}", form)
    total = {form: bundle.sizes(spark, f"{at}-{form}").agg(F.sum("bytes")).first()[0] for form in bundle.CODECS}
    held = lambda form: bundle.load(spark, f"{at}-{form}")[0].visits.agg(F.count(F.lit(1)).alias("n"), F.sum("off").alias("offsets"))
    return held("compressed").withColumn("form", F.lit("compressed")).unionAll(held("plain").withColumn("form", F.lit("plain"))).select("form", "n", "offsets", F.lit(total["compressed"] < total["plain"]).alias("smaller"))


@query("i09_printed_states", O.sql("SELECT query_id, printf('(%d, [%d, %d])', node, sp, ep) AS state FROM found", O.patterns_sql(), O.FOUND))
def i09(spark, sf):
    from .navigate import states

    return states(spark, sf).select("query_id", F.format_string("(%d, [%d, %d])", "node", "sp", "ep").alias("state"))


@query("u17_merge_parameters", "SELECT n_nationkey::BIGINT AS id, greatest(1, least(64, n_nationkey * 5 - 20))::BIGINT AS jobs, greatest(1, least(4096, n_nationkey * 300 - 900))::BIGINT AS buffer_mb FROM nation UNION ALL SELECT -1, 4, 64")
def u17(spark, sf):
    """What is asked for, clamped; -1 are the defaults."""
    from ..operators.mutate import MergeParameters
    from ..sources.corpus import read

    keys = [r[0] for r in read(spark, sf, "nation").select("n_nationkey").collect()]  # 25 rows
    asked = [(-1, MergeParameters())] + [(k, MergeParameters(jobs=k * 5 - 20, buffer_mb=k * 300 - 900)) for k in keys]
    return spark.createDataFrame([(k, p.jobs, p.buffer_mb) for k, p in asked], "id long, jobs long, buffer_mb long")
