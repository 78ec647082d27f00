"""Incremental ingest as file streams: what is new is processed once, upserts are idempotent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def run_available(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all files that have come since the last run, then stop; the checkpoint remembers them."""
    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def first_of_content(df: DataFrame, columns: list[str], time: str, delay: str) -> DataFrame:
    """Replayed records dropped by a hash of their content within the watermark."""
    return df.withColumn("__h", F.sha2(F.to_json(F.struct(*columns)), 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["__h"]).drop("__h")


def windowed(df: DataFrame, time: str, value: str, by: str, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling windows; rows later than the watermark are left out."""
    return df.withWatermark(time, delay).groupBy(F.window(time, length).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def run_batch(spark: SparkSession, sources: dict[str, str], state_path: str, work: Callable[[list[str]], None], batch_id: str, force: bool = False, blocking: tuple[str, ...] = ()) -> dict:
    """Run work(changed sources) where a source folder has changed since the last finished batch (all with ``force``); the manifest of the batch.

    States: blocked (a blocking source is missing; nothing is done), unchanged, done. Manifest and state are written only after the work.
    """
    import json

    from tesela.operators.reports import health
    from tesela.sources import files

    ids: dict[str, str | None] = {}
    for name, path in sources.items():
        system, target = files._file_system(spark, path)
        ids[name] = files.snapshot_id(files.snapshot(spark, path)) if system.exists(target) else None
    checks = health({k: v is not None for k, v in ids.items()}, set(blocking))
    before = (files.read_report(spark, f"{state_path}/state.json") or {}).get("sources", {})
    changed = [k for k, v in sorted(ids.items()) if v is not None and (force or before.get(k) != v)]
    status = "blocked" if any(s == "blocked" for _, s in checks) else "done" if changed else "unchanged"
    if status == "done":
        work(changed)
    manifest = {"batch_id": batch_id, "status": status, "changed": changed if status == "done" else [], "checks": dict(checks), "sources": ids if status == "done" else before}
    files.write_text(spark, f"{state_path}/batches/{batch_id}.json", json.dumps(manifest))
    if status == "done":
        files.write_text(spark, f"{state_path}/state.json", json.dumps(manifest))
    return manifest
