"""Command line over bundles: build, merge, remove, describe, metadata, benchmark, run-heads, check.

    python -m strandline.tools build --text paths.txt --out bundle [--forward]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import locate, metadata, mutate, search, stats, variants, verify
from .plans.index import PathIndex
from .plans.shared import SharedIndex
from .sources import bundle


def build(
    spark: SparkSession, out: str, text: str | None = None, paths: DataFrame | None = None, base: str | None = None, forward: bool = False, form: str = "compressed", interval: int | None = None
) -> PathIndex:
    """Build a bundle from a text file or a table (path_id, path); ``base`` is a bundle to append to, ``interval`` that of the samples written beside it."""
    rows = bundle.read_text_paths(spark, text) if text else paths
    index = PathIndex.from_paths(rows, both=not forward) if base is None else mutate.insert(bundle.load(spark, base)[0], rows, both=not forward)
    bundle.save(index, out, form, index.metadata)
    index = bundle.load(spark, out)[0]
    if interval is not None:
        stats.sampled(index, interval).write.mode("overwrite").option("compression", bundle.CODECS[form]).parquet(f"{out}/samples_{interval}")
    return index


def build_from_variants(spark: SparkSession, out: str, v: variants.VariantPaths, phasings: DataFrame, skip: bool = False, samples: DataFrame | None = None) -> PathIndex:
    """Generate haplotypes, index them in both orientations, and name their paths. Haplotypes that samples share are ranked once."""
    made, parts = variants.shared_haplotypes(v, phasings, skip, samples)
    named = variants.path_names(made)
    n = metadata.counts(named).first()
    encoded = parts.select("part", F.transform("path", lambda x: x * 2).alias("path"))
    index = SharedIndex.from_parts(made.select(F.col("seq_id").alias("path_id"), "part"), encoded)
    bundle.save(index, out, metadata=metadata.Metadata(n["samples"], n["haplotypes"], 1, named))
    return bundle.load(spark, out)[0]


def build_run_heads(spark: SparkSession, source: str) -> DataFrame:
    """Write the run-head samples beside a bundle and read them back."""
    index, _ = bundle.load(spark, source)
    locate.run_samples(index).write.mode("overwrite").parquet(f"{source}/run_samples")
    return spark.read.parquet(f"{source}/run_samples")


def merge(spark: SparkSession, out: str, sources: list[str], disjoint: bool = False) -> PathIndex:
    """Merge bundles, by insertion or, for disjoint node sets, by copying; metadata follow the kind."""
    loaded = [bundle.load(spark, s) for s in sources]
    indexes, metas = [x[0] for x in loaded], [x[1] for x in loaded]
    if disjoint:
        index = mutate.merge_disjoint(indexes)
    else:
        index = indexes[0]
        for other in indexes[1:]:
            index = mutate.merge(index, other)
    meta = metas[0]
    for other in metas[1:]:
        meta = metadata.merge_policy("disjoint" if disjoint else "insert", meta, False, other)
    bundle.save(index, out, metadata=meta)
    return bundle.load(spark, out)[0]


def remove(spark: SparkSession, source: str, out: str, ids: list[int] | None = None, sample: int | None = None, contig: int | None = None) -> int:
    """Remove paths by id, or those of a sample or a contig; with path names, arbitrary ids are refused. Returns the removed visits."""
    index, meta = bundle.load(spark, source)
    named = meta is not None and meta.path_names is not None
    if ids is not None and named:
        raise ValueError("arbitrary paths can't be removed when paths have names")
    if ids is None:
        if not named:
            raise ValueError("samples and contigs need path names")
        meta, gone = metadata.remove_sample(meta, sample) if sample is not None else metadata.remove_contig(meta, contig)
        wanted = gone.select(F.col("path_id").alias("id"))
    else:
        wanted = spark.createDataFrame([(i,) for i in ids], "id long")
    left, removed = mutate.remove(index, wanted)
    n = removed.first()["removed"]
    bundle.save(left, out, metadata=meta)
    return n


def describe(spark: SparkSession, source: str) -> dict:
    """Sizes, tags and metadata of a bundle."""
    index, meta = bundle.load(spark, source)
    return {"statistics": stats.summary(index).first().asDict(), "tags": index.tags, "metadata": None if meta is None else metadata.describe(meta)}


def list_metadata(spark: SparkSession, source: str, what: str) -> DataFrame:
    """(id, name) of a bundle's samples, contigs, paths or tags; an error where it has none of them. A path is named by its four parts."""
    index, meta = bundle.load(spark, source)
    if what == "tags":
        return spark.createDataFrame([(i, f"{k} = {v}") for i, (k, v) in enumerate(sorted(index.tags.items()))], "id long, name string")
    named = None if meta is None else {"samples": meta.samples, "contigs": meta.contigs, "paths": meta.path_names}[what]
    if named is None:
        raise ValueError(f"the bundle has no names of {what}")
    if what != "paths":
        return named.select("id", F.col("string").alias("name"))
    full = metadata.full_names(named, meta.samples, meta.contigs)
    return full.select(F.col("path_id").alias("id"), F.format_string("(%s, %s, %d, %d)", "sample", "contig", "phase", "count").alias("name"))


def clear_metadata(spark: SparkSession, source: str, out: str) -> PathIndex:
    """Write a bundle again without its metadata."""
    index, _ = bundle.load(spark, source)
    bundle.save(PathIndex(index.visits, index.bidirectional, index.tags), out)
    return bundle.load(spark, out)[0]


def benchmark(spark: SparkSession, source: str, patterns: DataFrame, longest: int) -> dict[str, tuple[float, int]]:
    """(seconds, results) of each search shape over a bundle."""
    index, _ = bundle.load(spark, source)
    found = search.find(index, patterns)
    work = {
        "find": lambda: found, "find_by_extension": lambda: search.find_by_extension(index, patterns, longest), "bidirectional": lambda: search.bd_search(index, patterns, longest),
        "locate": lambda: locate.locate_states(index, found), "locate_by_run_heads": lambda: locate.locate_by_successors(index, locate.find_with_first(index, found)),
        "extract": lambda: locate.extract(index, index.visits.filter("pos = 0").select("seq_id")), "lcs": lambda: search.longest_common_suffix(index),
    }
    out = {}
    for name, make in work.items():
        began = time.time()
        rows = make()
        results = rows.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.hash(c)) for c in rows.columns]).first()["n"]  # every column is made
        out[name] = time.time() - began, results
    return out


def parse_ids(text: str) -> list[int]:
    """Ids and closed ranges of them: ``3,7-9``."""
    parts = [x.split("-") for x in text.split(",")]
    return sorted({i for p in parts for i in range(int(p[0]), int(p[-1]) + 1)})


def check(index: PathIndex) -> bool:
    """Whether the structural invariants hold."""
    return not any(q.filter("differing > 0").limit(1).count() for q in (verify.well_formed(index), verify.lf_equation(index), verify.run_head_agrees(index)))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandline", description=__doc__)
    sub = parser.add_subparsers(dest="tool", required=True)
    p = sub.add_parser("build")
    p.add_argument("--text", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--base")
    p.add_argument("--forward", action="store_true")
    p.add_argument("--form", choices=sorted(bundle.CODECS), default="compressed")
    p.add_argument("--interval", type=int, help="write samples at this interval beside the bundle")
    p = sub.add_parser("merge")
    p.add_argument("--out", required=True)
    p.add_argument("--disjoint", action="store_true")
    p.add_argument("sources", nargs="+")
    p = sub.add_parser("remove")
    p.add_argument("source")
    p.add_argument("--out", required=True)
    p.add_argument("--ids", type=parse_ids, help="ids and ranges, as in 3,7-9")
    p.add_argument("--sample", type=int)
    p.add_argument("--contig", type=int)
    p = sub.add_parser("metadata")
    p.add_argument("source")
    p.add_argument("--list", choices=("samples", "contigs", "paths", "tags"))
    p.add_argument("--clear", metavar="OUT", help="write the bundle there without its metadata")
    p = sub.add_parser("benchmark")
    p.add_argument("source")
    p.add_argument("--length", type=int, default=4, help="nodes of a pattern; one is taken from each path that has as many")
    for name in ("describe", "run-heads", "check"):
        sub.add_parser(name).add_argument("source")
    got = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if got.tool == "build":
        build(spark, got.out, got.text, base=got.base, forward=got.forward, form=got.form, interval=got.interval)
    elif got.tool == "merge":
        merge(spark, got.out, got.sources, got.disjoint)
    elif got.tool == "remove":
        print(remove(spark, got.source, got.out, got.ids, got.sample, got.contig), "visits removed")
    elif got.tool == "describe":
        print(describe(spark, got.source))
    elif got.tool == "metadata":
        if got.list:
            for row in list_metadata(spark, got.source, got.list).orderBy("id").toLocalIterator():
                print(row["name"])
        if got.clear:
            clear_metadata(spark, got.source, got.clear)
    elif got.tool == "benchmark":
        own = bundle.load(spark, got.source)[0].paths.filter(F.size("path") >= got.length).select(F.col("seq_id").alias("query_id"), F.slice("path", 1, got.length).alias("pattern"))
        for name, (seconds, results) in benchmark(spark, got.source, own, got.length).items():
            print(f"{name}: {seconds:.2f} s, {results} results")
    elif got.tool == "run-heads":
        print(build_run_heads(spark, got.source).count(), "runs")
    else:
        print("ok" if check(bundle.load(spark, got.source)[0]) else "broken")


if __name__ == "__main__":
    main()
