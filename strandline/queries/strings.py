"""Dictionaries, string arrays and tags over the names of customers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dictionary as D
from ..sources.corpus import read
from .base import query


def names(spark, sf):
    """A dictionary of the customers' names by key."""
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("string"))


def nations(spark, sf):
    return read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("string"))


NAMES = "names AS (SELECT c_custkey AS id, c_name AS string FROM customer)"
NATIONS = "nations AS (SELECT n_nationkey::BIGINT AS id, n_name AS string FROM nation)"


@query("d01_string_array", f"WITH {NAMES} SELECT row_number() OVER (ORDER BY id) - 1 AS id, upper(string) AS string FROM names WHERE id % 3 = 0")
def d01(spark, sf):
    return D.string_array(names(spark, sf), lambda: F.upper("string"), F.col("id") % 3 == 0)


@query("d01_array_from_map", f"WITH {NATIONS} SELECT 2 * row_number() OVER (ORDER BY string) - 2 AS id, string FROM nations UNION ALL SELECT 2 * row_number() OVER (ORDER BY string) - 1, upper(string) FROM nations")
def d01_map(spark, sf):
    """The nations' names and what they are mapped to, in turn."""
    flat = nations(spark, sf).agg(F.map_from_entries(F.collect_list(F.struct("string", F.upper("string")))).alias("m"))  # the nations
    return D.from_list(flat.select(D.from_map(F.col("m")).alias("flat")), "flat")


@query("d02_lengths", f"WITH {NAMES} SELECT id, length(string) AS length, (sum(length(string)) OVER (ORDER BY id) - length(string))::BIGINT AS start FROM names")
def d02(spark, sf):
    return D.running_lengths(names(spark, sf))


@query("d02_remove", f"WITH {NAMES} SELECT CASE WHEN id > 5 THEN id - 1 ELSE id END AS id, string FROM names WHERE id <> 5")
def d02_remove(spark, sf):
    return D.remove_id(names(spark, sf), 5)


@query("d03_find", f"WITH {NAMES} SELECT w.string, coalesce(n.id, (SELECT count(*) FROM names)) AS id FROM (SELECT string FROM names WHERE id % 4 = 0 UNION ALL SELECT string || '?' FROM names WHERE id % 40 = 0) w LEFT JOIN names n USING (string)")
def d03(spark, sf):
    own = names(spark, sf)
    wanted = own.filter("id % 4 = 0").select("string").unionAll(own.filter("id % 40 = 0").select(F.concat("string", F.lit("?"))))
    return D.find_strings(own, wanted)


@query("d03_string_of", f"WITH {NAMES} SELECT w.id, coalesce(n.string, '') AS string FROM (SELECT id + d AS id FROM names, (VALUES (0), (1000000)) x(d)) w LEFT JOIN names n USING (id)")
def d03_of(spark, sf):
    own = names(spark, sf)
    return D.strings_of(own, own.select("id").unionAll(own.select(F.col("id") + 1_000_000)))


@query("d04_union", f"WITH {NAMES}, a AS (SELECT * FROM names WHERE id < 60), b AS (SELECT id - 40 AS id, string FROM names WHERE id >= 40) SELECT * FROM a UNION ALL SELECT 60 + row_number() OVER (ORDER BY id) - 1, string FROM b WHERE string NOT IN (SELECT string FROM a)")
def d04(spark, sf):
    own = names(spark, sf)
    return D.union(own.filter("id < 60"), own.filter("id >= 40").withColumn("id", F.col("id") - 40))


@query("d05_sorted_ids", f"WITH {NATIONS} SELECT row_number() OVER (ORDER BY string, id) - 1 AS rank, id, string FROM nations")
def d05(spark, sf):
    return D.sorted_ids(nations(spark, sf))


@query("d05_duplicates", "SELECT c_mktsegment AS string, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def d05_duplicates(spark, sf):
    return D.duplicates(read(spark, sf, "customer").select(F.col("c_mktsegment").alias("string")))


@query("d06_tags", f"WITH {NATIONS} SELECT id, CASE WHEN id % 5 = 4 THEN '' WHEN id % 5 = 3 THEN 'set' ELSE string END AS value FROM nations")
def d06(spark, sf):
    """Tags of the nations: all are set in capitals, some set again, some taken away; an absent one is empty."""
    rows = nations(spark, sf).collect()  # the nations
    tags = D.Tags({r["string"].upper(): r["string"] for r in rows})
    for r in rows:
        if r["id"] % 5 == 3:
            tags.set(r["string"], "set")
        elif r["id"] % 5 == 4:
            tags.unset(r["string"].capitalize())
    return spark.createDataFrame([(r["id"], tags.get(r["string"].lower())) for r in rows], "id long, value string")


@query("d06_tags_column", f"WITH {NAMES} SELECT id, string, string AS value FROM names")
def d06_column(spark, sf):
    """Tags as a column: each customer's own, a map of one key, looked up by its lower-cased name."""
    own = names(spark, sf).withColumn("tags", F.create_map(F.lower("string"), F.col("string")))
    return own.select("id", "string", F.element_at("tags", F.lower("string")).alias("value"))


@query("d07_alphabet", f"WITH {NATIONS}, c AS (SELECT DISTINCT unnest(string_split(string, '')) AS char FROM nations) SELECT row_number() OVER (ORDER BY char) - 1 AS code, char FROM c WHERE char <> ''")
def d07(spark, sf):
    return D.alphabet(nations(spark, sf))


@query("d07_compacted", f"WITH {NATIONS}, e AS (SELECT id, unnest(string_split(string, '')) AS char, generate_subscripts(string_split(string, ''), 1) - 1 AS pos FROM nations), c AS (SELECT char, row_number() OVER (ORDER BY char) - 1 AS code FROM (SELECT DISTINCT char FROM e WHERE char <> '')) SELECT id, pos, code FROM e JOIN c USING (char)")
def d07_compacted(spark, sf):
    return D.compacted(nations(spark, sf))


@query("i07_from_list", f"WITH {NATIONS} SELECT row_number() OVER (ORDER BY string) - 1 AS id, string FROM nations")
def i07(spark, sf):
    rows = nations(spark, sf).agg(F.array_sort(F.collect_list("string")).alias("all"))  # the nations
    return D.from_list(rows, "all")


@query("s15_duplicated", f"WITH {NAMES} SELECT 2 * id AS id, string FROM names UNION ALL SELECT 2 * id + 1, reverse(string) FROM names")
def s15(spark, sf):
    return D.duplicated(names(spark, sf), F.reverse)


@query("k05_even_only", f"WITH {NAMES} SELECT id, string FROM names")
def k05(spark, sf):
    return D.even_only(D.duplicated(names(spark, sf), F.reverse))
