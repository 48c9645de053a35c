"""Rules over time: breaches that must last before they fire, as state on a stream, and rates of counters that may start anew."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from harvestline.sources.shared import shared_folder
from harvestline.streaming import drain

#: Samples that the watermark hasn't reached, as int64, int64 and one byte each.
_STATE = "at binary, id binary, breach binary"
_TURN = "key string, ms long, id long, breach boolean"


def turns(at: np.ndarray, ids: np.ndarray, breach: np.ndarray) -> np.ndarray:
    """Places of the samples, in order of time and id, that tell which breaches outlast a slice: first and last dip, first breach after it.

    A breach that begins and ends within a slice no longer than the hold never fires, so no other sample of it matters.
    """
    order = np.lexsort((ids, at))
    dips = np.flatnonzero(~breach[order])
    since = dips[-1] + 1 if len(dips) else 0
    return order[np.unique([*dips[:1], *dips[-1:], *([since] if since < len(order) else [])]).astype(np.int64)]


def turning(samples: DataFrame, hold_ms: int) -> DataFrame:
    """key, ms, id, breach: of a stream (key, ts, id, breach; with a watermark) the samples that tell which breaches last hold_ms.

    Samples of a key are taken in slices of time of hold_ms, each a state of its own, once the watermark has passed them: late ones within
    its delay count, and a slice holds the delay's samples only. What the watermark passes of a slice at once is cut to three samples.
    """

    def follow(key: tuple[str, int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ids, breach = (np.frombuffer(x, kind) for x, kind in zip(state.get if state.exists else (b"", b"", b""), (np.int64, np.int64, np.bool_)))
        seen = list(frames)
        at = np.concatenate([at, *(f["ms"].to_numpy(np.int64) for f in seen)])
        ids = np.concatenate([ids, *(f["id"].to_numpy(np.int64) for f in seen)])
        breach = np.concatenate([breach, *(f["breach"].to_numpy(np.bool_) for f in seen)])
        mark = state.getCurrentWatermarkMs()
        done = np.flatnonzero(at <= mark)
        out = done[turns(at[done], ids[done], breach[done])]
        wait = at > mark
        if wait.any():
            state.update(tuple(x[wait].tobytes() for x in (at, ids, breach)))
            state.setTimeoutTimestamp(int(at[wait].min()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": key[0], "ms": at[out], "id": ids[out], "breach": breach[out]}, columns=["key", "ms", "id", "breach"])

    rows = samples.filter("ts is not null").withColumns({"ms": F.unix_millis("ts"), "id": F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1))})
    rows = rows.withColumn("slice", F.col("ms") - F.pmod("ms", F.lit(max(hold_ms, 1))))
    return rows.groupBy("key", "slice").applyInPandasWithState(follow, _TURN, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def sustained(turned: DataFrame, hold_ms: int, mark: Column) -> DataFrame:
    """key, since, fired_at (milliseconds): the breaches of turning's samples that lasted hold_ms without a sample within bounds before mark.

    An alert fires at since + hold, once for each breach; a dip at that very moment or before starts it anew. Windows go over three samples a
    key and slice at most for each time the watermark moved in it, however many samples there were.
    """
    order = Window.partitionBy("key").orderBy("ms", "id")
    begun = F.col("breach") & ~F.coalesce(F.lag("breach").over(order), F.lit(False))
    dip = F.min(F.when(~F.col("breach"), F.col("ms"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    fired = F.col("ms") + hold_ms
    lasted = F.coalesce(F.col("dip") > fired, fired < mark)
    return turned.withColumns({"begun": begun, "dip": dip}).filter(F.col("begun") & lasted).select("key", F.col("ms").alias("since"), fired.alias("fired_at"))


def sustained_events(spark: SparkSession, folder: str, breach: Column, key: Column, hold_minutes: int, delay_minutes: int, files: int = 4) -> DataFrame:
    """Sustained breaches of the event files in a folder, read as a stream of so many files a batch. Times are cut to milliseconds."""
    path = f"{folder}/events.parque*"
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/events.parquet").schema).option("maxFilesPerTrigger", files).parquet(path)
    ts = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    samples = stream.select(key.alias("key"), ts.alias("ts"), F.col("event_id").alias("id"), F.coalesce(breach, F.lit(False)).alias("breach")).withWatermark("ts", f"{delay_minutes} minutes")
    place = f"{shared_folder(spark)}/sustained-{uuid.uuid4().hex}"
    hold_ms = hold_minutes * 60_000
    mark = drain(turning(samples, hold_ms), f"{place}/out", f"{place}/state")
    out = sustained(spark.read.schema(_TURN).parquet(f"{place}/out"), hold_ms, F.lit(mark))
    return out.select("key", *(F.timestamp_millis(c).cast("timestamp_ntz").alias(c) for c in ("since", "fired_at")))


def counter_rate(samples: DataFrame, minutes: int, slide: int) -> DataFrame:
    """key, window_start, n, increase, per_second of cumulative counters (key, ts, value) in sliding windows, as PromQL's rate has them.

    A fall of the counter is a start from 0. The increase between a window's first and last sample is carried on to the window's edges,
    by half a mean step where an edge is over 1.1 mean steps away, and to the left no further than where the counter was 0. Windows
    with one sample, or all samples at one moment, have no rate.
    """
    before = F.lag("value").over(Window.partitionBy("key").orderBy("ts", "value"))
    rows = samples.withColumn("lost", F.when(F.col("value") < before, before).otherwise(0.0)).withColumn("at", F.struct("ts", "value", "lost"))
    seen = rows.groupBy("key", F.window("ts", f"{minutes} minutes", f"{slide} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("a"), F.max("at").alias("b"), F.sum("lost").alias("lost"))
    second = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    seen = seen.withColumns({
        "increase": F.col("b.value") - F.col("a.value") + F.col("lost") - F.col("a.lost"), "span": second(F.col("b.ts")) - second(F.col("a.ts")),
        "left": second(F.col("a.ts")) - second(F.col("w.start")), "right": second(F.col("w.end")) - second(F.col("b.ts")),
    }).filter("n > 1 and span > 0")
    step = F.col("span") / (F.col("n") - 1)
    reach = lambda c: F.when(F.col(c) >= 1.1 * step, step / 2).otherwise(F.col(c))
    zero = F.when((F.col("increase") > 0) & (F.col("a.value") >= 0), F.col("span") * F.col("a.value") / F.col("increase"))
    carried = F.col("increase") * (F.col("span") + F.least(reach("left"), zero) + reach("right")) / F.col("span")
    return seen.select("key", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "increase", (carried / (60.0 * minutes)).alias("per_second"))
