"""Sustained breaches over several batches, late samples and dips; counter rates by hand."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestline.streaming import alerts as A

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, kind string, value double"


def at(minute):
    return START + dt.timedelta(minutes=minute)


def fired(spark, folder, batches, hold=30, delay=10):
    """The alerts of a stream that reads each batch as a file of its own, in this order."""
    (folder / "events.parquet").mkdir()
    k = 0
    for number, batch in enumerate(batches):
        rows = [(k + j, at(m), key, v) for j, (key, m, v) in enumerate(batch)]
        k += len(rows)
        spark.createDataFrame(rows, SCHEMA).toPandas().astype({"ts": "datetime64[us]"}).to_parquet(f"{folder}/events.parquet/part-{number}.parquet")
    got = A.sustained_events(spark, str(folder), F.col("value") > 5, F.col("kind"), hold, delay, files=1)
    return sorted((r["key"], (r["since"] - START).total_seconds() / 60, (r["fired_at"] - START).total_seconds() / 60) for r in got.collect())


def test_a_dip_starts_the_time_anew(spark, tmp_path):
    steady = [("a", m, 9.0) for m in range(0, 60, 10)]
    dipping = [("b", m, 1.0 if m == 20 else 9.0) for m in range(0, 50, 10)]
    again = [("a", 60, 0.0), ("a", 70, 9.0), ("a", 105, 9.0), ("a", 200, 9.0)]
    assert fired(spark, tmp_path, [steady + dipping + again]) == [("a", 0.0, 30.0), ("a", 70.0, 100.0), ("b", 30.0, 60.0)]


def test_breaches_last_over_batches_and_late_dips_count(spark, tmp_path):
    first = [("a", 0, 9.0), ("a", 10, 9.0), ("b", 0, 9.0), ("c", 0, 9.0)]
    second = [("a", 25, 9.0), ("b", 26, 9.0)]
    third = [("b", 19, 1.0), ("a", 40, 9.0), ("b", 41, 9.0), ("d", 45, 9.0)]  # b's dip comes late, within the delay
    fourth = [("x", 120, 1.0)]
    assert fired(spark, tmp_path, [first, second, third, fourth]) == [("a", 0.0, 30.0), ("b", 26.0, 56.0), ("c", 0.0, 30.0), ("d", 45.0, 75.0)]


def test_a_dip_at_the_moment_of_firing_and_null_values(spark, tmp_path):
    rows = [("a", 0, 9.0), ("a", 30, 1.0), ("b", 0, 9.0), ("b", 31, None), ("c", 0, None), ("z", 300, 1.0)]
    assert fired(spark, tmp_path, [rows]) == [("b", 0.0, 30.0)]


def test_a_slice_of_any_number_of_samples_leaves_three():
    """Each slice of a key is a state of its own and is cut to three samples, against a walk over all samples of each slice."""
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 30)
        at, ids = np.array([r.randint(0, 20) for _ in range(n)]), np.array(r.sample(range(100), n))
        breach = np.array([r.random() < 0.7 for _ in range(n)])
        rows = sorted(zip(at.tolist(), ids.tolist(), breach.tolist()))
        kept = [(int(at[k]), int(ids[k]), bool(breach[k])) for k in A.turns(at, ids, breach)]
        dips = [x for x in rows if not x[2]]
        after = [x for x in rows if x[2] and (not dips or x > dips[-1])]
        assert kept == sorted({*dips[:1], *dips[-1:], *after[:1]}) and len(kept) <= 3


def test_many_samples_of_one_key_over_slices_and_batches(spark, tmp_path):
    r = random.Random(8)
    rows = sorted(((k % 2 and "a" or "b", r.randint(0, 60 * 40) / 2, 1.0 if r.random() < 0.03 else 9.0) for k in range(1500)), key=lambda x: x[1])
    end, want = max(m for _, m, _ in rows) - 10, []
    for key in "ab":
        since, fired_yet = None, False
        mine = [(m, k, v > 5) for k, (name, m, v) in enumerate(rows) if name == key and m <= end]
        for m, _, high in [*sorted(mine), (end - 1e-9, 0, True)]:
            if since is not None and not fired_yet and m > since + 30:
                want.append((key, since, since + 30))
                fired_yet = True
            if not high:
                since, fired_yet = None, False
            elif since is None:
                since = m
    assert len(want) > 5
    assert fired(spark, tmp_path, [rows[:600], rows[600:900], rows[900:]]) == sorted(want)


def test_counter_rate_by_hand(spark):
    values = {0: 0.0, 10: 20.0, 20: 30.0, 30: 5.0, 40: 15.0, 50: 15.0}
    rows = [("a", at(m), v) for m, v in values.items()] + [("one", at(5), 3.0), ("same", at(5), 3.0), ("same", at(5), 4.0)]
    samples = spark.createDataFrame(rows, "key string, ts timestamp_ntz, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    (r,) = A.counter_rate(samples, 60, 60).collect()
    assert (r["key"], r["n"], r["increase"]) == ("a", 6, 30 + 5 + 10)  # 0 to 30, from 0 to 5 after the fall, 5 to 15
    assert r["per_second"] == pytest.approx(45 * (50 + 0 + 10) / 50 / 3600)  # nothing to the left of 0; the right edge is a step away
