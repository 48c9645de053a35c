"""Structured Streaming: chunk scoring, rates, histograms, stale chunks."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.sources.shared import shared_folder


def drain(stream: DataFrame, out: str, checkpoint: str, each: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "append") -> int:
    """Run a stream over all that is there now; each batch overwrites its own folder, so a batch that runs twice is written once.

    Returns the watermark of the last batch in milliseconds, 0 where there is none.
    """

    def write(batch: DataFrame, number: int) -> None:
        (batch if each is None else each(batch, number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    mark = last and last["eventTime"].get("watermark")
    return round(dt.datetime.fromisoformat(mark).timestamp() * 1000) if mark else 0


def stream_rate(spark: SparkSession, sf_dir: str, minutes: int = 10, slide: int = 5) -> DataFrame:
    """Events a second by type in sliding windows; each batch writes the windows that it changed, and state is kept for an hour of event time.

    An event that comes over an hour behind the latest one is dropped with its window's state.
    """
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque*")
    counts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", f"{minutes} minutes", f"{slide} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    folder = f"{shared_folder(spark)}/rate-{uuid.uuid4().hex}"
    drain(counts, f"{folder}/out", f"{folder}/state", mode="update")
    last = spark.read.parquet(f"{folder}/out")
    # A window that several batches changed is there with each count; counts only grow, so the highest is the final one.
    out = last.groupBy("window", "event_type").agg(F.max("n").alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round(F.col("n") / (60.0 * minutes), 6).alias("per_second"))


def stream_score(spark: SparkSession, chunks: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score chunks as they come: at least once, written once; rows that a score refuses (p50 null) go to a dead-letter folder."""
    folder = f"{shared_folder(spark)}/score-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")

    def each(batch: DataFrame, number: int) -> DataFrame:
        scored = score(batch)
        scored.filter("p50 is null").write.mode("overwrite").parquet(f"{folder}/dead/batch={number}")
        return scored.filter("p50 is not null")

    drain(stream, f"{folder}/out", f"{folder}/state", each)
    return spark.read.parquet(f"{folder}/out").drop("batch")


def hist_quantile(samples: DataFrame, value: str, bounds: tuple[float, ...], q: float) -> DataFrame:
    """The q-quantile by group as cumulative buckets give it: linear within the bucket, the last bound for what lies beyond."""
    le = lambda b: F.count_if(F.col(value) <= b)
    out = samples.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.array(*(le(b) for b in bounds)).alias("cum"))
    rank = q * F.col("n")
    k = F.size(F.filter("cum", lambda c: c < rank))  # buckets below the rank
    edges, before = F.array(F.lit(0.0), *map(F.lit, bounds)), F.when(k > 0, F.get("cum", k - 1)).otherwise(F.lit(0))
    inside = (rank - before) / F.nullif(F.get("cum", k) - before, F.lit(0))
    value_at = F.get(edges, k) + (F.get(edges, k + 1) - F.get(edges, k)) * inside
    return out.select("event_type", "n", F.round(F.when(k >= len(bounds), F.lit(float(bounds[-1]))).otherwise(value_at), 6).alias("quantile"))
