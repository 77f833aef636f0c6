"""Streams (an extension beyond the batch operators): reference counts and standing of restaurants, kept as events arrive."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectra.operators import references


def keep_reference_counts(existence: DataFrame, refs: DataFrame, folder: str, checkpoint: str, **trigger):
    """Keep the state of ``references.count_state`` under ``folder`` from two streams of deltas.

    Each micro-batch is added to the last complete version and written as the next one; a batch that is run again
    writes the same version again, so counts stay exact.
    """
    e = existence.select("key", F.col("delta").cast("long").alias("e"), F.lit(0).cast("long").alias("r"))
    r = refs.select("key", F.lit(0).cast("long").alias("e"), F.lit(1).cast("long").alias("r"))

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        change = batch.groupBy("key").agg(F.sum("e").alias("n_existence"), F.sum("r").alias("n_references"))
        before = os.path.join(folder, f"version={batch_id - 1}")
        if batch_id > 0:
            change = spark.read.parquet(before).unionByName(change).groupBy("key").agg(F.sum("n_existence").alias("n_existence"), F.sum("n_references").alias("n_references"))
        change.write.mode("overwrite").parquet(os.path.join(folder, f"version={batch_id}"))

    return e.unionByName(r).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def orphans_now(spark: SparkSession, folder: str) -> DataFrame:
    """Current orphans of the last complete version."""
    done = [int(n.split("=")[1]) for n in os.listdir(folder) if n.startswith("version=") and os.path.exists(os.path.join(folder, n, "_SUCCESS"))]
    return references.current_orphans(spark.read.parquet(os.path.join(folder, f"version={max(done)}")))


def windowed_counts(events: DataFrame, *, at: str, by: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per window and key; events later than the watermark are left to the batch operators."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))
