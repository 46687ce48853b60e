"""An incremental builder: paths arrive as a stream and are merged into an index of levels, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mutate import merge, merge_all
from ..plans.index import VISIT_COLUMNS, PathIndex
from ..plans.tables import delete_path, dense_ids, passing, released

RUN = "first long, last long, level int"


class StreamingBuilder:
    """Each micro-batch becomes a small index of its own, a run of level 0; two neighbouring runs of one level are merged into one of the next.

    So a visit is moved once a level, a batch touches as many levels as its number's lowest binary digits carry over, and there are no more
    runs than levels. A run holds the batches ``first`` to ``last`` and is named after them; a manifest for each batch lists the runs after
    it. A batch is done once its manifest is written: when it is tried again after a failure, also in the middle of a merge, it starts from
    the manifest before it and writes the same runs over. A run is deleted when no manifest that may still be started from lists it.
    """

    def __init__(self, spark: SparkSession, path: str, both: bool = True):
        self.spark, self.path, self.both = spark, path.rstrip("/"), both
        self.manifests = f"{self.path}-manifests"

    def _runs(self, before: int | None = None) -> list[tuple[int, int, int]]:
        """(first, last, level) of the runs after the last batch, or the last one before a given one; a row a level."""
        try:
            rows = self.spark.read.schema(f"{RUN}, batch long").parquet(self.manifests)
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return []
            raise
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        last = rows.agg(F.max("batch")).first()[0]
        return sorted(tuple(r) for r in rows.filter(F.col("batch") == last).select("first", "last", "level").collect()) if last is not None else []

    def _at(self, run: tuple[int, int, int]) -> str:
        return f"{self.path}/run-{run[0]}-{run[1]}"

    def _read(self, run: tuple[int, int, int]) -> PathIndex:
        return PathIndex(self.spark.read.schema(", ".join(f"{c} bigint" for c in VISIT_COLUMNS)).parquet(self._at(run)), self.both)

    def _write(self, run: tuple[int, int, int], index: PathIndex) -> tuple[int, int, int]:
        with released(index.spark):
            index.visits.select(*[F.col(c).cast("long") for c in VISIT_COLUMNS]).write.mode("overwrite").parquet(self._at(run))
        return run

    def add(self, rows: DataFrame, batch: int) -> None:
        """Append one batch (key, path), ids in the order of its keys."""
        before = self._runs(batch)
        with passing():
            own = rows.join(dense_ids(rows, ["key"], "path_id"), "key").select("path_id", "path")
            runs = [*before, self._write((batch, batch, 0), PathIndex.from_paths(own, self.both))]
        made = {runs[-1]}
        while len(runs) > 1 and runs[-2][2] == runs[-1][2]:
            old, new = runs[-2:]
            with passing():
                runs[-2:] = [self._write((old[0], new[1], new[2] + 1), merge(self._read(old), self._read(new)))]
            made.add(runs[-1])
        self.spark.createDataFrame(runs, RUN).coalesce(1).write.mode("overwrite").parquet(f"{self.manifests}/batch={batch}")
        # What was only made on the way, and what the manifest before the last one lists, is out of reach once this one is written.
        out = made | set(self._runs(before[-1][1]) if before else [])
        for run in out - set(before) - set(runs):
            delete_path(self.spark, self._at(run))

    def run(self, stream: DataFrame, checkpoint: str):
        """Start the query: ``stream`` has (key, path)."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.add).trigger(availableNow=True).start()

    def finish(self) -> PathIndex:
        """The index of all batches so far: what is left of the levels, the small ones merged first."""
        runs = [self._read(r) for r in self._runs()]
        if not runs:
            empty = self.spark.createDataFrame([], "path_id long, path array<bigint>")
            return PathIndex.from_paths(empty, self.both)
        while len(runs) > 1:
            runs[-2:] = [merge_all(runs[-2:])]
        return runs[0]
