"""The corpus pipeline: documents in, training mixture with tokens out.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir) and works on all that its predecessor
kept, and all but the last return the columns of documents. ``n_chars`` follows the text.

1. toxicity: documents that the classifier rejects go.
2. line_dedup: repeated lines go from the texts; every document stays.
3. near_dedup: of each group of near duplicates one document stays, of the smallest id (nulls last). Rows are judged, not ids: of
   rows that repeat an id, those of other groups stay, and of copies under one id or under null ids one stays.
4. mixing: documents are replicated to the sources' target weights and shuffled.
5. sentencepiece: sampled tokens, with the proof that they decode to the text; the copies of a document are cut by draws of their own.

Edge cases are those of the operators; a stage keeps rows with null ids, null texts and empty texts unless its decision names
them, and an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import line_dedup, mixing, near_dedup, pieces, toxicity
from strandline.llm.common import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, score_col="_score").filter(F.col("_score") < toxicity.THRESHOLD).drop("_score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = Scratch(spark).keep(docs.withColumn("_nd_row", F.monotonically_increasing_id()))  # written, so that the keys stay
    gone = near_dedup.near_components(keyed, row_col="_nd_row").filter("not chosen").select("_nd_row")
    return keyed.join(gone, "_nd_row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.rates(docs)).drop("copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source", "n_chars")  # rows that agree in all columns are the same
    keyed = docs.withColumn("_copy", F.row_number().over(again)).withColumn("_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("_copy") > 1, F.col("_copy"))))
    return pieces.round_trip(keyed, id_col="_key").drop("_copy", "_key")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Training, hashing and sampling have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read back."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
