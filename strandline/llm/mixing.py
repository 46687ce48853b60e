"""Mixing sources to target weights by Poisson replication (built-in functions only).

Each source gets a mean repetition rate, its target share of the mixture divided by its share
of the corpus. A document's number of copies is a Poisson variable of that mean, found by
inverting the distribution at a uniform number hashed from the seed and the document's key:
a pure function of both, so retried tasks and later runs draw the same. Copies are exploded
and dealt to partitions, and ordered within them, by the hash of (seed, key, copy): a global shuffle.

Only per-source sums are aggregated (partial sums before the shuffle, so a source with a third of
all rows is no hot spot). The rates are broadcast if there are at most ``MAX_SOURCES`` of them
and joined with the help of AQE's skew handling otherwise.

Edge cases: a null source is a source of its own; a null or empty text counts one character; a
null key hashes as the empty string; repeated rows draw the same count each; a document whose count is 0
is left out, which is what a rate means; an empty table gives no rows. Extra columns of any name are carried along; one that has
the name given to ``copy_col`` is replaced by the number of the copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SEED = 20
#: Exponent of the sources' sizes in the target weights: 1 keeps proportions, 0 makes all sources equal.
TEMPERATURE = 0.5
#: Copies of the mean document.
EPOCHS = 1.0
MAX_SOURCES = 4096
#: A larger mean is drawn as a sum of independent draws, since exp(-mean) would underflow.
MAX_MEAN = 256.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of the parts' hash."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... until what is left is below the hash's resolution."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.exp(-mean)
    start = F.struct(F.array(first).alias("cdf"), first.alias("term"), first.alias("sum"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * mean / k.cast("double")
        return F.struct(F.concat(s["cdf"], F.array(s["sum"] + term)).alias("cdf"), term.alias("term"), (s["sum"] + term).alias("sum"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"]


def rates(docs: DataFrame, temperature: float = TEMPERATURE, epochs: float = EPOCHS, source_col: str = "source", text_col: str = "text", weights: dict | None = None) -> DataFrame:
    """(source, rate): the mean number of copies of each source's documents.

    ``weights`` gives target weights by source (others 0); without it they are size ** temperature.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("double").alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(temperature)) if temperature != 0.5 else F.sqrt("size")
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map()
        weight = F.coalesce(F.element_at(given.cast("map<string,double>"), F.col("source")), F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(total)).select("source", (F.lit(epochs) * share * F.col("all_size") / F.col("size")).alias("rate"))  # total is one row


def mix(docs: DataFrame, rate: DataFrame, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy") -> DataFrame:
    """Replicate each document by its Poisson count and shuffle globally; ``copy_col`` numbers the copies from 1."""
    rate = Scratch(docs.sparkSession).keep(rate)
    n_sources = rate.count()
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN)).cast("int")
    draws = rate.select("source", parts.alias("parts"), poisson_table(F.col("rate") / parts).alias("cdf"))
    draws = F.broadcast(draws) if n_sources <= MAX_SOURCES else draws

    def draw(part: Column) -> Column:
        u = uniform(F.lit(seed), F.col("key"), part)
        return F.size(F.filter("cdf", lambda p: p <= u))

    # The row travels as one column, so that its names can't meet those used here.
    own = docs.select(F.col(id_col).cast("string").alias("key"), F.col(source_col).alias("of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != copy_col]).alias("row"))
    count = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, part: n + draw(part))
    copies = own.join(draws, own["of"].eqNullSafe(draws["source"])).select("key", "row", F.explode(F.sequence(F.lit(1), F.when(count > 0, count))).alias("copy"))
    dealt = copies.withColumn("at", uniform(F.lit(seed), F.col("key"), F.lit("copy"), F.col("copy")))
    return dealt.repartition("at").sortWithinPartitions("at").select("row.*", F.col("copy").alias(copy_col))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    return mix(docs, rates(docs))


OP6_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(length(coalesce(text, '')) + 1) AS DOUBLE) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, 1.0::DOUBLE * (sqrt(size) / sum(sqrt(size)) OVER ()) * sum(size) OVER () / size AS rate FROM sizes
), steps AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS cdf FROM rates
  UNION ALL
  SELECT source, rate, k + 1, term * rate / (k + 1), cdf + term * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), drawn AS (
  SELECT d.*, (CAST('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents d
), counted AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.cdf <= d.u) AS n FROM drawn d
)
SELECT doc_id, source, lang, n_chars, text, CAST(unnest(generate_series(1, n)) AS INTEGER) AS copy FROM counted WHERE n > 0
"""
