"""Construction and mutation; every result is compared with the visits of the final paths built from scratch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mutate
from ..plans import oracle as O
from ..plans.index import PathIndex, both_orientations
from ..plans.tables import cut, placed
from ..sources.corpus import index, paths
from .base import query

ALL = "SELECT node, off, seq_id, pos, next, next_off, prev, prev_off FROM visits"


def _from(rows: str, both: bool = True, corpus: str = "events", tail: str = ALL, *parts: str) -> str:
    """The visits of the corpus's rows (path_id, p, node) after ``rows`` has changed them."""
    seqs = O.SEQS if both else "both_ AS (SELECT path_id AS seq_id, p AS pos, node FROM rows_), seqs AS (SELECT seq_id, list(node ORDER BY pos) AS path FROM both_ GROUP BY seq_id)"
    base = O.ROWS[corpus].replace("rows_ AS", "base_ AS", 1)
    return "WITH " + ",\n".join([base, f"rows_ AS ({rows})", seqs, O.RANKED, *parts]) + "\n" + tail


#: The paths in the order of a merge of their second half with their first.
SHIFTED = "SELECT CASE WHEN path_id < c // 2 THEN path_id + c - c // 2 ELSE path_id - c // 2 END AS path_id, p, node FROM base_, (SELECT max(path_id) + 1 AS c FROM base_)"


def halves(spark, sf, corpus="events"):
    """(first, second) half of the paths, both numbered from 0."""
    own = paths(spark, sf, corpus)
    middle = own.count() // 2
    return own.filter(F.col("path_id") < middle), own.filter(F.col("path_id") >= middle).withColumn("path_id", F.col("path_id") - middle)


def _written(own) -> PathIndex:
    """An index of its own, as one that is merged would be read."""
    return PathIndex(cut(PathIndex.from_paths(own).visits))


SAME = "SELECT * FROM base_"


@query("c00_visits", O.sql(ALL))
def c00(spark, sf):
    return index(spark, sf).visits


@query("c00_visits_orders", O.sql(ALL, corpus="orders"))
def c00_orders(spark, sf):
    return index(spark, sf, "orders").visits


@query("c00_visits_conversations", O.sql(ALL, corpus="conversations"))
def c00_conversations(spark, sf):
    return index(spark, sf, "conversations").visits


@query("c01_insert", _from(SAME))
def c01(spark, sf):
    """The first half, then the second half."""
    first, second = halves(spark, sf)
    return mutate.insert(PathIndex.from_paths(first), second).visits


@query("c01_insert_forward", _from(SAME, both=False))
def c01_forward(spark, sf):
    first, second = halves(spark, sf)
    return mutate.insert(PathIndex.from_paths(first, both=False), second, both=False).visits


@query("c02_insert_integers", _from(SAME, both=False))
def c02(spark, sf):
    """From one flat 0-terminated sequence."""
    from ..sources.bundle import split_integers

    flat = paths(spark, sf).select(F.col("path_id"), F.posexplode(F.concat("path", F.array(F.lit(0).cast("long")))).alias("p", "node"))
    return PathIndex.from_paths(split_integers(placed(flat, ["path_id", "p"], "i", ["node"])), both=False).visits


@query("c03_builder_orientations", O.sql("SELECT seq_id, array_to_string(path, ',') AS path FROM seqs"))
def c03(spark, sf):
    return both_orientations(paths(spark, sf)).select("seq_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("c04_build_by_doubling", O.sql(ALL))
def c04(spark, sf):
    return PathIndex.from_paths(paths(spark, sf), method="doubling").visits


@query("c04_insert_by_steps", _from(SAME, corpus="conversations"))
def c04_steps(spark, sf):
    """The second half stepped into the index of the first, whose visits keep their order."""
    first, second = halves(spark, sf, "conversations")
    return mutate.insert_by_steps(PathIndex(cut(PathIndex.from_paths(first).visits)), second).visits


@query("c05_edges_after_removal", _from("SELECT path_id - (path_id // 3) - 1 AS path_id, p, node FROM base_ WHERE path_id % 3 <> 0", True, "events", "SELECT * FROM edges", O.EDGES))
def c05(spark, sf):
    return _removed(spark, sf)[0].edges


def _removed(spark, sf):
    ids = paths(spark, sf).filter("path_id % 3 = 0").select(F.col("path_id").alias("id"))
    return mutate.remove(index(spark, sf), ids)


@query("c06_remove", _from("SELECT path_id - (path_id // 3) - 1 AS path_id, p, node FROM base_ WHERE path_id % 3 <> 0"))
def c06(spark, sf):
    return _removed(spark, sf)[0].visits


@query("c06_removed_length", O.sql("SELECT count(*) AS removed FROM visits WHERE seq_id // 2 % 3 = 0"))
def c06_length(spark, sf):
    return _removed(spark, sf)[1]


@query("c06_remove_invalid", O.sql("SELECT 0::BIGINT AS removed, count(*) AS size FROM visits"))
def c06_invalid(spark, sf):
    left, removed = mutate.remove(index(spark, sf), spark.createDataFrame([(0,), (1 << 40,)], "id long"))
    return removed.crossJoin(left.visits.agg(F.count(F.lit(1)).alias("size")))  # one row each


@query("c07_merge", _from(SHIFTED))
def c07(spark, sf):
    """The second half of the paths with the first half appended."""
    first, second = halves(spark, sf)
    return mutate.merge(_written(second), _written(first)).visits


@query("c07_merge_orders", _from(SHIFTED, corpus="orders"))
def c07_orders(spark, sf):
    first, second = halves(spark, sf, "orders")
    return mutate.merge(_written(second), _written(first)).visits


@query("c08_merge_parallel", _from(SHIFTED))
def c08(spark, sf):
    """The same from the halves of both halves, merged pair by pair."""
    parts = []
    for half in reversed(halves(spark, sf)):
        middle = half.count() // 2
        parts += [half.filter(F.col("path_id") < middle), half.filter(F.col("path_id") >= middle).withColumn("path_id", F.col("path_id") - middle)]
    return mutate.merge_all([_written(part) for part in parts]).visits


@query("c08_rank_array", O.sql("""SELECT b.seq_id - n AS seq_id, b.pos, b.node, count(a.off) AS at FROM (SELECT *, (SELECT count(*) FROM seqs) // 4 * 2 AS n FROM visits) b LEFT JOIN visits a ON a.node = b.node AND a.off < b.off AND a.seq_id < b.n
  WHERE b.seq_id >= b.n GROUP BY ALL"""))
def c08_ranks(spark, sf):
    """How many visits of the first half come before each of the second half's."""
    first, second = halves(spark, sf)
    return mutate.rank_array(_written(first), _written(second)).select("seq_id", "pos", "node", "at")


DISJOINT = "SELECT * FROM base_ UNION ALL SELECT path_id + c, p, node + d FROM base_, (SELECT max(path_id) + 1 AS c, max(node) + 2 AS d FROM base_)"


def _disjoint(spark, sf):
    """The paths, the paths again on nodes behind all of theirs, and how far those were moved."""
    own = paths(spark, sf)
    shift = own.select(F.max(F.array_max("path"))).first()[0] + 2
    return [_written(own), _written(own.select("path_id", F.transform("path", lambda x: x + shift).alias("path")))], shift


@query("c09_merge_disjoint", _from(DISJOINT))
def c09(spark, sf):
    return mutate.merge_disjoint(_disjoint(spark, sf)[0]).visits


@query("c09_shared_nodes", O.sql("SELECT DISTINCT node FROM visits WHERE node <> 0"))
def c09_shared(spark, sf):
    own = index(spark, sf)
    return mutate.shared_nodes(own, own)


_MOVED = "SELECT 1, CASE WHEN node = 0 THEN 0 ELSE node + d END, off, seq_id, pos, CASE WHEN next = 0 THEN 0 ELSE next + d END, next_off, CASE WHEN prev = 0 THEN 0 ELSE prev + d END, prev_off FROM visits, (SELECT max(node) + 2 AS d FROM rows_)"


@query("c10_split", _from(SAME, True, "events", f"SELECT 0 AS subgraph, * FROM visits UNION ALL {_MOVED}"))
def c10(spark, sf):
    """The disjoint merge taken apart again."""
    parts, shift = _disjoint(spark, sf)
    both = PathIndex(cut(mutate.merge_disjoint(parts).visits))
    nodes = both.visits.filter("node <> 0").select(F.shiftright("node", 1).alias("node_id")).distinct()
    return mutate.split(both, nodes.select("node_id", (F.col("node_id") * 2 >= shift).cast("int").alias("subgraph")))


@query("c13_runs_merged", O.sql("SELECT node, count(*) AS runs, sum(len)::BIGINT AS visits FROM runs GROUP BY node", O.RUNS))
def c13(spark, sf):
    return index(spark, sf).runs.groupBy("node").agg(F.count(F.lit(1)).alias("runs"), F.sum("len").alias("visits"))


@query("c16_partition_range", O.sql("SELECT node, i AS block, n * i // b AS first, n * (i + 1) // b - 1 AS last FROM (SELECT *, unnest(range(0, b)) AS i FROM (SELECT node, count(*) AS n, least(7, count(*)) AS b FROM visits GROUP BY node))"))
def c16(spark, sf):
    """The offsets of every node in seven ranges of nearly one size, or as many as there are offsets."""
    sizes = index(spark, sf).node_sizes
    return mutate.partition_ranges(sizes.select("node", F.lit(0).cast("long").alias("first"), (F.col("size") - 1).alias("last")), 7)


@query("c17_source_tag", O.sql("SELECT unnest(['built', 'inserted', 'removed', 'merged']) AS kind, 'strandline' AS source, count(*) FILTER (pos = 0) > 0 AS filled FROM visits"))
def c17(spark, sf):
    """The tag of every index, however it was made."""
    own, (first, second) = index(spark, sf), halves(spark, sf)
    made = {"built": own, "inserted": mutate.insert(PathIndex.from_paths(first), second), "removed": _removed(spark, sf)[0], "merged": mutate.merge(PathIndex.from_paths(first), PathIndex.from_paths(second))}
    rows = [i.visits.agg((F.count_if(F.col("pos") == 0) > 0).alias("filled")).select(F.lit(kind).alias("kind"), F.lit(i.tags.get("source")).alias("source"), "filled") for kind, i in made.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])
