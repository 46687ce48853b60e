"""Sources, sinks and codecs: whatever is written is read back, so a result shows the round trip."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators.variants import all_alleles
from ..plans import oracle as O
from ..plans.index import PathIndex
from ..plans.tables import placed, shared_dir
from ..sources import bundle, pathfile
from ..sources.corpus import index, paths, read
from .base import query
from .names import PN, meta
from .strings import NAMES, names
from .variation import VP, vp

SEQ = "SELECT path_id, array_to_string(list(node ORDER BY p), ',') AS path FROM rows_ GROUP BY path_id"


def place(spark) -> str:
    return f"{shared_dir(spark)}/bundle-{uuid.uuid4().hex}"


def joined(df):
    return df.select("path_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def _round_trip(spark, sf, form: str):
    at = place(spark)
    bundle.save(index(spark, sf), at, form)
    return bundle.load(spark, at)[0]


@query("s01_load_bundle", O.sql("SELECT * FROM visits"))
def s01(spark, sf):
    return _round_trip(spark, sf, "compressed").visits


@query("k02_plain_bundle", O.sql("SELECT * FROM visits"))
def k02(spark, sf):
    return _round_trip(spark, sf, "plain").visits


@query("s02_load_path_file", O.sql("SELECT * FROM visits"))
def s02(spark, sf):
    """A file of the portable layout, written in place and read by ranges of records; sequences and positions follow from the records."""
    at = place(spark)
    pathfile.save(index(spark, sf), at)
    return pathfile.load(spark, at).visits


@query("s02_path_file_records", O.sql("SELECT node, run_id, start_off, len, successor FROM runs", O.RUNS, corpus="orders"))
def s02_records(spark, sf):
    at = place(spark)
    pathfile.save(index(spark, sf, "orders"), at)
    return pathfile.read_table(spark, at, "runs", 16)


@query("s02_path_file_edges", O.sql("SELECT src, dst, rank_off FROM edges", O.EDGES, corpus="orders"))
def s02_edges(spark, sf):
    at = place(spark)
    pathfile.save(index(spark, sf, "orders"), at)
    return pathfile.read_table(spark, at, "edges", 16)


@query("s03_load_and_insert", O.sql("SELECT count(*) AS size, count(*) FILTER (pos = 0) AS sequences FROM visits"))
def s03(spark, sf):
    """A loaded bundle is as mutable as a built one: the first half is saved and loaded, the second is appended."""
    from ..operators.mutate import insert
    from .construct import halves

    first, second = halves(spark, sf)
    at = place(spark)
    bundle.save(PathIndex.from_paths(first), at)
    return insert(bundle.load(spark, at)[0], second).header.select("size", "sequences")


@query("s04_text_paths", O.sql(SEQ).replace("FROM rows_ GROUP BY path_id", "FROM rows_ GROUP BY path_id UNION ALL SELECT max(path_id) + 1, '' FROM rows_"))
def s04(spark, sf):
    """Lines with a trailing comma, and a blank one."""
    own = paths(spark, sf)
    lines = joined(own).select(F.col("path_id").alias("line"), F.concat("path", F.lit(",")).alias("value"))
    blank = own.agg((F.max("path_id") + 1).alias("line")).select("line", F.lit("").alias("value"))
    return joined(bundle.parse_lines(lines.unionByName(blank)))


@query("s04_text_file", O.sql(SEQ))
def s04_file(spark, sf):
    at = place(spark)
    joined(paths(spark, sf)).repartitionByRange(3, "path_id").sortWithinPartitions("path_id").select("path").write.text(at)
    return joined(bundle.read_text_paths(spark, at))


def _flat(spark, sf):
    """(i, node): the paths one after the other, each with a zero behind it."""
    rows = paths(spark, sf).select("path_id", F.posexplode(F.concat("path", F.array(F.lit(0).cast("long")))).alias("p", "node"))
    return placed(rows, ["path_id", "p"], "i", ["node"])


@query("s05_integer_paths", O.sql(SEQ))
def s05(spark, sf):
    return joined(bundle.split_integers(_flat(spark, sf), block=1 << 12))


@query("s06_start_offsets", O.sql("SELECT (sum(len(path) + 1) OVER (ORDER BY seq_id) - len(path) - 1)::BIGINT AS i FROM seqs WHERE seq_id % 2 = 0"))
def s06(spark, sf):
    return bundle.start_offsets(_flat(spark, sf))


@query("s07_load_variants", f"WITH {VP} SELECT site, allele, array_to_string(path, ',') AS path FROM every_")
def s07(spark, sf):
    """The alleles of a contig that was saved and loaded, the reference's own among them."""
    at = place(spark)
    bundle.save_variants(vp(spark, sf), at)
    return all_alleles(bundle.load_variants(spark, at)).select("site", "allele", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("s08_phasing_files", "SELECT o_custkey % 3 AS file, count(*) AS n FROM orders WHERE o_custkey % 3 IN (0, 2) GROUP BY 1")
def s08(spark, sf):
    """A table partitioned by file; the subset is pruned by its folders."""
    at = place(spark)
    bundle.append_phasings(read(spark, sf, "orders").select(F.col("o_orderkey").alias("site"), (F.col("o_custkey") % 3).alias("file")), at)
    return bundle.read_phasings(spark, at, [0, 2]).groupBy(F.col("file").cast("long").alias("file")).agg(F.count(F.lit(1)).alias("n"))


@query("k09_append_phasings", "SELECT o_custkey % 3 AS file, 2 * count(*) AS n FROM orders GROUP BY 1")
def k09(spark, sf):
    at = place(spark)
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("site"), (F.col("o_custkey") % 3).alias("file"))
    for _ in range(2):
        bundle.append_phasings(rows, at)
    return bundle.read_phasings(spark, at).groupBy(F.col("file").cast("long").alias("file")).agg(F.count(F.lit(1)).alias("n"))


@query("s10_load_run_heads", O.sql("SELECT count(*) AS runs FROM logical", O.RUNS))
def s10(spark, sf):
    from ..tools import build_run_heads

    at = place(spark)
    bundle.save(index(spark, sf), at)
    return build_run_heads(spark, at).agg(F.count(F.lit(1)).alias("runs"))


@query("s11_load_metadata", f"WITH {PN} SELECT * FROM pn")
def s11(spark, sf):
    at = place(spark)
    bundle.save(index(spark, sf), at, metadata=meta(spark, sf))
    return bundle.load(spark, at)[1].path_names


@query("s12_header", O.sql("SELECT count(*) FILTER (pos = 0) AS sequences, count(*) AS size, min(node) FILTER (node > 0) - 1 AS offset, max(node) + 1 AS alphabet_size, max(node) + 2 - min(node) FILTER (node > 0) AS effective, true AS bidirectional FROM visits"))
def s12(spark, sf):
    return index(spark, sf).header


@query("s13_record_table", O.sql("SELECT node, count(*) AS runs FROM runs GROUP BY node", O.RUNS))
def s13(spark, sf):
    at = place(spark)
    index(spark, sf).runs.write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at).groupBy("node").agg(F.count(F.lit(1)).alias("runs"))


@query("s14_sample_table", O.sql("SELECT node, off, seq_id FROM visits WHERE next = 0 OR (pos + 1) % 8 = 0"))
def s14(spark, sf):
    from ..operators.stats import sampled

    at = place(spark)
    sampled(index(spark, sf), 8).write.parquet(at)
    return spark.read.parquet(at)


@query("s15_read_duplicated", f"WITH {NAMES} SELECT 2 * id AS id, string FROM names UNION ALL SELECT 2 * id + 1, reverse(string) FROM names")
def s15_file(spark, sf):
    at = place(spark)
    bundle.write_strings(names(spark, sf), at)
    return bundle.read_strings(spark, at, F.reverse)


@query("s16_load_dictionary", f"WITH {NAMES} SELECT id, string FROM names")
def s16(spark, sf):
    at = place(spark)
    bundle.write_strings(names(spark, sf), at, form="plain")
    return bundle.read_strings(spark, at)


@query("s17_read_rows", "SELECT n_name AS value FROM nation WHERE n_nationkey % 2 = 0")
def s17(spark, sf):
    """Empty lines are skipped."""
    at = place(spark)
    read(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("").alias("value")).write.text(at)
    return bundle.read_rows(spark, at, skip_empty=True)


@query("s18_file_sizes", O.sql("SELECT 'header' AS part, 1::BIGINT AS n, true AS written UNION ALL SELECT 'visits', count(*), true FROM visits"))
def s18(spark, sf):
    """The parts of a bundle with their rows, and that they take bytes."""
    at = place(spark)
    bundle.save(index(spark, sf), at)
    rows = lambda part: spark.read.parquet(f"{at}/{part}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return bundle.sizes(spark, at).join(rows("header").unionAll(rows("visits")), "part").select("part", "n", (F.col("bytes") > 0).alias("written"))


@query("s19_generated_queries", O.sql("SELECT seq_id, pos, array_to_string(path[pos : pos + 5], ',') AS pattern FROM (SELECT seq_id, path, unnest([1, 1 + (seq_id * 7919) % (len(path) - 5)]) AS pos FROM seqs WHERE len(path) >= 8) GROUP BY ALL"))
def s19(spark, sf):
    """Subpaths at places that a fixed rule picks from the sequence's number."""
    own = index(spark, sf).paths.filter("size(path) >= 8")
    at = own.select("seq_id", "path", F.explode(F.array(F.lit(1).cast("long"), 1 + (F.col("seq_id") * 7919) % (F.size("path") - 5))).alias("pos"))
    return at.select("seq_id", "pos", F.array_join(F.slice("path", F.col("pos").cast("int"), 6).cast("array<string>"), ",").alias("pattern")).distinct()


# Codecs ----------------------------------------------------------------------------------------------


@query("u01_varint", "SELECT l_orderkey AS value, l_orderkey AS back, greatest(1, ceil(len(bin(l_orderkey)) / 7.0))::BIGINT AS bytes FROM lineitem GROUP BY l_orderkey")
def u01(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("value")).distinct().withColumn("code", codecs.varint("value"))
    return rows.select("value", codecs.from_varint("code").alias("back"), F.length("code").cast("long").alias("bytes"))


@query("u02_run_code", O.sql("SELECT DISTINCT s::INTEGER AS sigma, len::INTEGER AS length, s::INTEGER - 1 AS value, len::INTEGER AS back FROM runs JOIN (SELECT node, count(DISTINCT successor) AS s FROM runs GROUP BY node) USING (node)", O.RUNS))
def u02(spark, sf):
    """The run lengths of the index, coded for alphabets of the size of their nodes' outdegrees."""
    runs = index(spark, sf).runs
    rows = runs.join(runs.groupBy("node").agg(F.count_distinct("successor").cast("int").alias("sigma")), "node").select("sigma", F.col("len").cast("int").alias("length")).distinct()

    @F.pandas_udf("int")
    def back(s: pd.Series, n: pd.Series) -> pd.Series:
        def one(sigma, length):
            out = bytearray()
            codecs.RunCode(sigma).write(out, sigma - 1, length)
            value, got, _ = codecs.RunCode(sigma).read(bytes(out), 0)
            return got if value == sigma - 1 else -1

        return pd.Series([one(int(a), int(b)) for a, b in zip(s, n, strict=True)])

    return rows.select("sigma", "length", (F.col("sigma") - 1).alias("value"), back("sigma", "length").alias("back"))


@query("u03_record_codec", O.sql("SELECT node, run_id, successor, len FROM runs", O.RUNS))
def u03(spark, sf):
    return codecs.decode_records(codecs.encode_records(index(spark, sf)))


@query("u06_gaps", O.sql("SELECT node, row_number() OVER w - 1 AS i, off - coalesce(lag(off) OVER w, 0) AS gap FROM (SELECT node, start_off AS off FROM runs) WINDOW w AS (PARTITION BY node ORDER BY off)", O.RUNS))
def u06(spark, sf):
    """Where the runs start."""
    return codecs.gaps(index(spark, sf).runs.select("node", F.col("start_off").alias("off")))


@query("u07_merged_ranks", O.sql("SELECT node, off FROM visits"))
def u07(spark, sf):
    """Two sorted runs of positions, merged by a range-partitioned sort."""
    v = index(spark, sf).visits.select("node", "off", "seq_id")
    forward = F.col("seq_id") % 2 == 0
    return v.filter(forward).unionByName(v.filter(~forward)).repartitionByRange("node", "off").sortWithinPartitions("node", "off").select("node", "off")


def _wang_sql() -> str:
    """The hash in 128-bit integers, cut to 64 bits after each step."""
    m = "18446744073709551615::HUGEINT"
    steps = [
        f"({m} - x + x * 2097152::HUGEINT) % 18446744073709551616::HUGEINT", "xor(x::UBIGINT, (x::UBIGINT >> 24))::HUGEINT", "(x * 265::HUGEINT) % 18446744073709551616::HUGEINT", "xor(x::UBIGINT, (x::UBIGINT >> 14))::HUGEINT",
        "(x * 21::HUGEINT) % 18446744073709551616::HUGEINT", "xor(x::UBIGINT, (x::UBIGINT >> 28))::HUGEINT", "(x * 2147483649::HUGEINT) % 18446744073709551616::HUGEINT",
    ]
    out = "SELECT c_custkey AS k, c_custkey::HUGEINT AS x FROM customer"
    for s in steps:
        out = f"SELECT k, {s} AS x FROM ({out})"
    return f"SELECT k AS key, CASE WHEN x > 9223372036854775807::HUGEINT THEN (x - 18446744073709551616::HUGEINT)::BIGINT ELSE x::BIGINT END AS hash FROM ({out})"


@query("u10_wang_hash", _wang_sql())
def u10(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), codecs.wang_hash("c_custkey").alias("hash"))


@query("u11_sizes", "SELECT p_partkey AS value, len(bin(p_partkey)) AS bits, p_partkey / 1048576.0::DOUBLE AS mb, p_partkey * 8.0::DOUBLE / 10 AS bpc FROM part")
def u11(spark, sf):
    v = F.col("p_partkey")
    return read(spark, sf, "part").select(v.alias("value"), codecs.bit_length(v).alias("bits"), codecs.megabytes(v).alias("mb"), codecs.bits_per_char(v, F.lit(10)).alias("bpc"))


@query("u12_zstd", "SELECT c_custkey AS id, c_name AS text FROM customer")
def u12(spark, sf):
    @F.pandas_udf("string")
    def there_and_back(text: pd.Series) -> pd.Series:
        return text.map(lambda t: codecs.unzstd(codecs.zstd(t.encode())).decode())

    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), there_and_back("c_name").alias("text"))


@query("u13_sorted_distinct", O.sql("SELECT seq_id, array_to_string(list_sort(list_distinct(path)), ',') AS nodes FROM seqs"))
def u13(spark, sf):
    return index(spark, sf).paths.select("seq_id", F.array_join(codecs.sorted_distinct(F.col("path")).cast("array<string>"), ",").alias("nodes"))


@query("u14_ranges", "SELECT n_nationkey::BIGINT AS sp, (n_nationkey % 7)::BIGINT AS ep, greatest(n_nationkey % 7 + 1 - n_nationkey, 0)::BIGINT AS length, greatest(3, least(n_nationkey, 9))::BIGINT AS bounded FROM nation")
def u14(spark, sf):
    k = F.col("n_nationkey").cast("long")
    rows = read(spark, sf, "nation").select(k.alias("sp"), (k % 7).alias("ep"))
    return rows.select("sp", "ep", codecs.range_length(F.col("sp"), F.col("ep")).cast("long").alias("length"), codecs.bound(F.col("sp"), F.lit(3).cast("long"), F.lit(9).cast("long")).alias("bounded"))
