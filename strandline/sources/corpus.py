"""Path corpora over the driver's tables, and their indexes, built once a session and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.index import PathIndex, both_orientations
from ..plans.tables import cut, dense_ids, forget, kept, passing, shared_dir

_BUILT: dict[tuple, object] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _collected(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(path_id, path) from rows with ``label``: ids follow the key's order, paths the given order."""
    ids = dense_ids(rows, [key], "path_id")
    ordered = F.sort_array(F.collect_list(F.struct(*order, "label")))
    paths = rows.groupBy(key).agg(F.transform(ordered, lambda x: x["label"] * 2).alias("path"))
    return paths.join(ids, key).select("path_id", "path")


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each user: the types of its events by time."""
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    labels = dense_ids(events, ["event_type"], "label").withColumn("label", F.col("label") + 1)
    return _collected(events.join(labels, "event_type"), "user_id", ["ts", "event_id"])


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each order: the suppliers of its lines."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return _collected(lines.withColumn("label", F.col("l_suppkey") + 1), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])


def conversation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each conversation: the roles of its turns."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    labels = dense_ids(turns, ["role"], "label").withColumn("label", F.col("label") + 1)
    return _collected(turns.join(labels, "role"), "conv_id", ["turn"])


PATHS = {"events": event_paths, "orders": order_paths, "conversations": conversation_paths}


def once(spark: SparkSession, key: tuple, make):
    """What ``make`` gives, kept for this application."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def paths(spark: SparkSession, sf_dir: str, corpus: str = "events") -> DataFrame:
    return once(spark, ("paths", sf_dir, corpus), lambda: kept(cut(PATHS[corpus](spark, sf_dir))))


def index(spark: SparkSession, sf_dir: str, corpus: str = "events") -> PathIndex:
    """The bidirectional index of a corpus."""
    shared_dir(spark)

    def make() -> PathIndex:
        own = paths(spark, sf_dir, corpus)
        stored = kept(cut(both_orientations(own)))
        with passing():
            built = kept(cut(PathIndex.build(stored, True).visits))
        visits = kept(cut(built, "node", "off"))  # from a table, as a sort by range reads its rows twice
        forget(built)
        return PathIndex(visits, stored_paths=stored)

    return once(spark, ("index", sf_dir, corpus), make)


def patterns(spark: SparkSession, sf_dir: str, corpus: str = "events", length: int = 4) -> DataFrame:
    """(query_id, pattern): a subpath from every path that is long enough, and for each one a variant that mostly misses."""
    own = paths(spark, sf_dir, corpus).filter(F.size("path") >= length + 2).select("path_id", F.slice("path", 3, length).alias("pattern"))
    missing = own.select((F.col("path_id") * 2 + 1).alias("query_id"), F.concat(F.slice("pattern", 1, length - 1), F.array(F.element_at("pattern", -1) + 2)).alias("pattern"))
    return own.select((F.col("path_id") * 2).alias("query_id"), "pattern").unionByName(missing)
