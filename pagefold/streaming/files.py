"""Structured Streaming over files as they arrive and over the rows they give.

A newest-wins view of objects cannot drop duplicates, which keeps the first; each batch is merged with what is stored, by key. Decisions
are an append-only stream, counted in event-time windows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.census import newest_records
from ..sources.frames import frame, parsed


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """A stream of files as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").load(path)


def parsed_stream(files: DataFrame, kind: str) -> DataFrame:
    """One frame of the files of a stream: parsing is a narrow step, so it needs no state."""
    return frame(parsed(files, [kind]), kind)


def windowed_decisions(decisions: DataFrame, at: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Decisions of each severity in windows of event time; rows later than the watermark are left out."""
    return decisions.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), "severity").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "severity", "n")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of a key without a longer gap."""
    w = F.session_window(at, gap)
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def keep_newest(stream: DataFrame, target: str, keys: list[str], order: list[str], checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Keeps the newest record of each key in a table at ``target``: each batch rewrites only the buckets its keys fall into.

    A batch that is run again after a failure gives the same result, because the newest of the same rows is the same.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return
        try:
            stored = spark.read.schema(fresh.schema).parquet(target).where(F.col("bucket").isin(touched))
            fresh = stored.unionByName(fresh)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        newest = newest_records(fresh, ["bucket", *keys], order).drop("times").select(*fresh.columns)
        newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}.next")
        done = spark.read.schema(fresh.schema).parquet(f"{target}.next")
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
