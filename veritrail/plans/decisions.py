"""The latest decision of every claim as a running table, kept up by micro-batches of the log.

The table is dealt out in buckets by claim. A batch writes the buckets it touches anew, as a version, and marks the
version last; a batch that is run again finds its version there and changes nothing. Decisions that come late, or twice,
end in the same rows as one pass over the whole log. Every FULL versions all buckets are written, so that older ones need
not be read.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from veritrail.plans.review import latest_decision
from veritrail.sources.staging import staged, versions

BUCKETS, FULL = 64, 20
KEYS = ["case_id", "claim_id"]


@dataclasses.dataclass(frozen=True)
class DecisionTable:
    """rows/version=N holds decisions by bucket, heads/version=N the buckets that are in it. The log's columns: case_id, claim_id, decision, note, updated_at."""

    spark: SparkSession
    folder: str

    def _last(self) -> int:
        return max(versions(self.spark, f"{self.folder}/heads"), default=0)

    def _rows(self, upto: int) -> DataFrame:
        """The rows of every bucket's last version, up to this one."""
        have = [v for v in versions(self.spark, f"{self.folder}/heads") if (upto - 1) // FULL * FULL < v <= upto or v == (upto - 1) // FULL * FULL]
        of = lambda name: self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/version={v}" for v in sorted(have)])
        last = of("heads").groupBy("bucket").agg(F.max("version").alias("version"))  # BUCKETS rows
        return of("rows").join(F.broadcast(last), ["bucket", "version"]).drop("version")

    def current(self) -> DataFrame | None:
        """The last decision of each claim; None before the first batch."""
        last = self._last()
        return self._rows(last).drop("bucket") if last else None

    def merge(self, batch: DataFrame, version: int) -> None:
        """The table with a batch's decisions, as that version. Versions rise by any steps; one that is there is left alone."""
        last = self._last()
        if version <= last:
            return
        batch = staged(batch.select(*KEYS, "decision", "note", "updated_at").withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int")), "decisions")
        full = last // FULL != version // FULL
        touched = self.spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")) if full else batch.select("bucket").distinct()
        touched = F.broadcast(staged(touched, "touched"))
        log = batch if not last else batch.unionByName(self._rows(last).join(touched, "bucket", "left_semi"))
        latest_decision(log).repartition("bucket").write.mode("overwrite").parquet(f"{self.folder}/rows/version={version}")
        touched.write.mode("overwrite").parquet(f"{self.folder}/heads/version={version}")

    def follow(self, log: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Keeps the table up with a stream of the log. trigger: as of DataStreamWriter.trigger()."""
        step = lambda batch, number: self.merge(batch, number + 1)
        return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
