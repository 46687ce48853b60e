"""Path, sample and contig names; fragments of chains."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import dense_ids, places_within
from . import dictionary as D

PATH_NAME = ("sample_id", "contig_id", "phase", "count")


@dataclass
class Metadata:
    """Path names (path_id, sample_id, contig_id, phase, count), dictionaries (id, string) and counts.

    A dictionary or the path names may be missing; the counts hold always.
    """

    n_samples: int = 0
    n_haplotypes: int = 0
    n_contigs: int = 0
    path_names: DataFrame | None = None
    samples: DataFrame | None = None
    contigs: DataFrame | None = None

    def counts(self) -> tuple[int, int, int]:
        return self.n_samples, self.n_haplotypes, self.n_contigs


def n_paths(meta: Metadata) -> int:
    return meta.path_names.count() if meta.path_names is not None else 0


def counts(names: DataFrame) -> DataFrame:
    """One row: paths, samples, haplotypes and contigs that the path names use."""
    return names.agg(
        F.count(F.lit(1)).alias("paths"), F.countDistinct("sample_id").alias("samples"), F.countDistinct("sample_id", "phase").alias("haplotypes"), F.countDistinct("contig_id").alias("contigs")
    )


def ids_of(full: DataFrame, samples: DataFrame, contigs: DataFrame) -> DataFrame:
    """Full names (sample, contig, ...) with ids; an unknown name gets the dictionary's size."""
    size = lambda d, c: F.broadcast(d.agg(F.count(F.lit(1)).alias(c)))
    s, c = samples.select(F.col("id").alias("sample_id"), F.col("string").alias("sample")), contigs.select(F.col("id").alias("contig_id"), F.col("string").alias("contig"))
    found = full.join(s, "sample", "left").join(c, "contig", "left").crossJoin(size(samples, "ns")).crossJoin(size(contigs, "nc"))  # one row each
    return found.withColumn("sample_id", F.coalesce("sample_id", "ns")).withColumn("contig_id", F.coalesce("contig_id", "nc")).drop("ns", "nc")


def full_names(names: DataFrame, samples: DataFrame | None, contigs: DataFrame | None) -> DataFrame:
    """(path_id, sample, contig, phase, count): names for ids, the id itself where there is none."""
    out = names
    for one, col in ((samples, "sample"), (contigs, "contig")):
        if one is None:
            out = out.withColumn(col, F.col(f"{col}_id").cast("string"))
        else:
            known = one.select(F.col("id").alias(f"{col}_id"), F.col("string").alias(col))
            out = out.join(known, f"{col}_id", "left").withColumn(col, F.coalesce(col, F.col(f"{col}_id").cast("string")))
    return out.select("path_id", "sample", "contig", "phase", "count")


def find_fragment(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, path_id): the path of the same chain with the largest count not above the query's; ties by path id, null if none."""
    own = names.select("sample_id", "contig_id", "phase", "count", "path_id", F.lit(0).alias("asks"))
    rows = own.unionByName(queries.select("sample_id", "contig_id", "phase", "count", "query_id", F.lit(1).alias("asks")), allowMissingColumns=True)
    # An as-of join by one sweep along each chain: of equal counts the smallest path id comes last, and queries after it.
    along = Window.partitionBy("sample_id", "contig_id", "phase").orderBy("count", "asks", F.desc("path_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("path_id", F.last("path_id", ignorenulls=True).over(along)).filter("asks = 1").select("query_id", "path_id")


def find_paths(names: DataFrame, sample: int | None = None, contig: int | None = None) -> DataFrame:
    """(path_id) of a sample, a contig, or both."""
    out = names
    if sample is not None:
        out = out.filter(F.col("sample_id") == sample)
    if contig is not None:
        out = out.filter(F.col("contig_id") == contig)
    return out.select("path_id")


def _closed(names: DataFrame, column: str, gone: int) -> DataFrame:
    left = names.filter(F.col(column) != gone)
    ids = dense_ids(left, ["path_id"], "new_path")
    return left.join(ids, "path_id").select(F.col("new_path").alias("path_id"), *[F.when(F.col(c) > gone, F.col(c) - 1).otherwise(F.col(c)).alias(c) if c == column else c for c in PATH_NAME])


def remove_sample(meta: Metadata, sample: int) -> tuple[Metadata, DataFrame]:
    """Drop a sample's paths and close the gap in the ids; returns the removed path ids as well."""
    if meta.path_names is None:
        estimate = int(meta.n_haplotypes / meta.n_samples) if meta.n_samples else 0
        return replace(meta, n_samples=meta.n_samples - 1, n_haplotypes=meta.n_haplotypes - estimate, samples=D.remove_id(meta.samples, sample) if meta.samples is not None else None), None
    gone = meta.path_names.filter(F.col("sample_id") == sample)
    phases = gone.select("phase").distinct().count()
    kept = replace(meta, n_samples=meta.n_samples - 1, n_haplotypes=meta.n_haplotypes - phases, path_names=_closed(meta.path_names, "sample_id", sample))
    return replace(kept, samples=D.remove_id(meta.samples, sample) if meta.samples is not None else None), gone.select("path_id")


def remove_contig(meta: Metadata, contig: int) -> tuple[Metadata, DataFrame]:
    """As ``remove_sample``; haplotypes stay."""
    gone = meta.path_names.filter(F.col("contig_id") == contig) if meta.path_names is not None else None
    kept = replace(meta, n_contigs=meta.n_contigs - 1, path_names=_closed(meta.path_names, "contig_id", contig) if meta.path_names is not None else None)
    return replace(kept, contigs=D.remove_id(meta.contigs, contig) if meta.contigs is not None else None), gone.select("path_id") if gone is not None else None


def _merged_ids(own: DataFrame | None, new: DataFrame | None, n_own: int, n_new: int, same: bool):
    """The merged dictionary, its size, and the new ids (id, to) of the second one's entries."""
    if own is not None and new is not None:
        both = D.union(own, new)
        return both, both.count(), new.join(both.withColumnRenamed("id", "to"), "string").select("id", "to")
    if same:
        if n_own != n_new:
            raise ValueError("the same names in different numbers")
        return own if own is not None else new, n_own, None
    return None, n_own + n_new, n_own


def merge(meta: Metadata, source: Metadata, same_samples: bool, same_contigs: bool) -> Metadata:
    """Append ``source``. Names, where both have them, decide over the flags; path names survive only if both have them."""
    samples, n_samples, sample_to = _merged_ids(meta.samples, source.samples, meta.n_samples, source.n_samples, same_samples)
    contigs, n_contigs, contig_to = _merged_ids(meta.contigs, source.contigs, meta.n_contigs, source.n_contigs, same_contigs)
    by_name = meta.samples is not None and source.samples is not None
    n_haplotypes = meta.n_haplotypes
    if by_name:
        n_haplotypes = int(n_samples * meta.n_haplotypes / meta.n_samples) if meta.n_samples else source.n_haplotypes
    elif not same_samples:
        n_haplotypes += source.n_haplotypes
    names = None
    if meta.path_names is not None and source.path_names is not None:
        moved = _moved(_moved(source.path_names, "sample_id", sample_to), "contig_id", contig_to)
        shift = n_paths(meta)
        names = meta.path_names.unionByName(moved.withColumn("path_id", F.col("path_id") + shift))
        if by_name:
            n_haplotypes = names.select("sample_id", "phase").distinct().count()
    return Metadata(n_samples, n_haplotypes, n_contigs, names, samples, contigs)


def _moved(names: DataFrame, column: str, to) -> DataFrame:
    if to is None:
        return names
    if isinstance(to, int):
        return names.withColumn(column, F.col(column) + to)
    return names.join(to.withColumnRenamed("id", column), column, "left").withColumn(column, F.coalesce("to", column)).select("path_id", *PATH_NAME)


def merge_all(sources: list[Metadata], same_samples: bool, same_contigs: bool) -> Metadata:
    return reduce(lambda a, b: merge(a, b, same_samples, same_contigs), sources)


def merge_policy(kind: str, own: Metadata | None, own_empty: bool, source: Metadata | None) -> Metadata | None:
    """What an index keeps when indexes are merged: ``insert`` adds samples, ``disjoint`` adds contigs."""
    if own_empty:
        return source
    if own is None or source is None:
        return None
    return merge(own, source, same_samples=kind == "disjoint", same_contigs=kind != "disjoint")


def split(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """(subgraph, path_id, sample_id, contig_id, phase, count, old ids): ids anew, by first appearance in each subgraph."""
    own = names.join(mapping, "path_id")
    out = places_within(own, "subgraph", ["path_id"], "new_path")
    for column in ("sample_id", "contig_id"):
        first = own.groupBy("subgraph", column).agg(F.min("path_id").alias("first"))
        ids = places_within(first, "subgraph", ["first"], f"new_{column}", ["subgraph", column])
        out = out.join(ids, ["subgraph", column])
    return out.select("subgraph", F.col("new_path").alias("path_id"), F.col("new_sample_id").alias("sample_id"), F.col("new_contig_id").alias("contig_id"), "phase", "count", F.col("sample_id").alias("old_sample"), F.col("contig_id").alias("old_contig"))


def fragment_map(names: DataFrame) -> DataFrame:
    """(path_id, chain, prev_path, next_path): chains of (sample, contig, phase) in the order of their counts."""
    keys = ["sample_id", "contig_id", "phase"]
    chains = dense_ids(names, keys, "chain")
    along = Window.partitionBy(*keys).orderBy("count", "path_id")
    linked = names.withColumn("prev_path", F.lag("path_id").over(along)).withColumn("next_path", F.lead("path_id").over(along))
    return linked.join(chains, keys).select("path_id", "chain", "prev_path", "next_path")


def oriented_next(fragments: DataFrame, paths: DataFrame) -> DataFrame:
    """(oriented, next_oriented, prev_oriented): 2 * path + orientation; directions swap on reversed paths."""
    at = paths.withColumn("path_id", F.shiftright("oriented", 1)).withColumn("rev", F.col("oriented").bitwiseAND(F.lit(1)))
    joined = at.join(fragments, "path_id", "left")
    pick: dict[str, Column] = {
        "next_oriented": F.when(F.col("rev") == 1, F.col("prev_path")).otherwise(F.col("next_path")),
        "prev_oriented": F.when(F.col("rev") == 1, F.col("next_path")).otherwise(F.col("prev_path")),
    }
    return joined.select("oriented", *[(c * 2 + F.col("rev")).alias(n) for n, c in pick.items()])


def describe(meta: Metadata) -> str:
    """A one-line summary."""
    parts = [f"{n_paths(meta)} paths with names"] if meta.path_names is not None else []
    parts += [f"{meta.n_samples} samples" + (" with names" if meta.samples is not None else ""), f"{meta.n_haplotypes} haplotypes", f"{meta.n_contigs} contigs" + (" with names" if meta.contigs is not None else "")]
    return ", ".join(parts)
