"""Stores that survive a load that dies, merging on read, memos, files, artifacts and the retrain driver."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harvestline.operators import boosting as G
from harvestline.operators import retrain as T
from harvestline.sources import store as W

SCHEMA = "k string, v long, x double"


def rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def dying(df):
    return df.withColumn("x", F.when(F.col("k") == "b", F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("x")))


def test_a_load_that_dies_leaves_the_old_data(spark, tmp_path):
    table = W.Store(spark, str(tmp_path), SCHEMA, ["k"])
    assert rows(table) == []
    with pytest.raises(Exception, match="killed"):
        table.load(dying(frame(spark, ("a", 1, 1.0), ("b", 1, 2.0)).repartition(2)))
    assert rows(table) == [] and table.load(frame(spark, ("a", 1, 1.0)))
    with pytest.raises(Exception, match="killed"):
        table.upsert(dying(frame(spark, ("a", 2, 9.0), ("b", 2, 9.0)).repartition(2)), "t1")
    with pytest.raises(Exception, match="killed"):
        table.replace(dying(frame(spark, ("b", 2, 9.0))))
    assert rows(table) == [("a", 1, 1.0)]
    assert table.upsert(frame(spark, ("a", 2, 9.0)), "t1") and rows(table) == [("a", 2, 9.0)]


def test_a_second_load_and_a_second_delivery_do_nothing(spark, tmp_path):
    table = W.Store(spark, str(tmp_path), SCHEMA, ["k"])
    assert table.load(frame(spark, ("a", 1, 1.0)))
    assert not table.load(dying(frame(spark, ("b", 1, 1.0))))  # not even computed
    assert table.upsert(frame(spark, ("b", 1, 1.0)), "chunk 1") and not table.upsert(dying(frame(spark, ("b", 1, 5.0))), "chunk 1")
    assert rows(table) == [("a", 1, 1.0), ("b", 1, 1.0)]


def test_the_highest_version_and_then_the_last_writer_wins(spark, tmp_path):
    plain, versioned = (W.Store(spark, f"{tmp_path}/{n}", SCHEMA, ["k"], v) for n, v in (("plain", None), ("versioned", "v")))
    for table in (plain, versioned):
        table.load(frame(spark, ("a", 5, 1.0), ("b", 1, 1.0), (None, 1, 1.0)))
        table.upsert(frame(spark, ("a", 4, 2.0), ("b", 1, 2.0), ("c", 0, None)), "1")
    assert sorted(map(str, plain.read().collect())) == sorted(map(str, frame(spark, ("a", 4, 2.0), ("b", 1, 2.0), ("c", 0, None), (None, 1, 1.0)).collect()))
    assert sorted(map(str, versioned.read().collect())) == sorted(map(str, frame(spark, ("a", 5, 1.0), ("b", 1, 2.0), ("c", 0, None), (None, 1, 1.0)).collect()))
    old = versioned.read()
    versioned.compact()
    assert len(versioned.parts()) == 1 and versioned.read().count() == 4 and old.count() == 4


def test_a_memo_is_read_until_a_file_changes(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/memo"
    frame(spark, ("a", 1, 1.0)).write.parquet(source)
    ask = lambda least=0: W.memo(spark.read.parquet(source).filter(F.col("v") > least).groupBy("k").agg(F.sum("x").alias("x")), folder, "sums")
    first, second = ask(), ask()
    assert first.inputFiles() == second.inputFiles() and all(f"{tmp_path}/memo" in f for f in second.inputFiles())
    assert ask(5).count() == 0 and second.collect()[0]["x"] == 1.0  # another plan
    frame(spark, ("a", 1, 2.0)).write.mode("append").parquet(source)
    assert ask().collect()[0]["x"] == 3.0 and ask().inputFiles() != second.inputFiles()


def test_files_come_back_as_they_went(spark, tmp_path):
    df = spark.createDataFrame([("a, \"b\"\n", dt.date(2020, 1, 2), None, 1.5), ("", None, 3, None)], "t string, d date, n int, x double")
    W.write_csv(df.select("d", "n", "x"), f"{tmp_path}/csv")
    back = spark.read.csv(f"{tmp_path}/csv", schema="d date, n int, x double", header=True, mode="FAILFAST")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select("d", "n", "x").collect()))
    W.write_metrics(df.select("d", "n", "x"), f"{tmp_path}/m")
    assert W.read_metrics(spark, f"{tmp_path}/m", "d date, n int, x double").groupBy("format").count().count() == 2
    W.write_csv(spark.createDataFrame([("i", "s", 1, 2), ("j", "s", 3, 4)], "item_id string, store_id string, d_1 long, d_2 long"), f"{tmp_path}/wide")
    wide = W.read_wide_sales(spark, f"{tmp_path}/wide", 2, ("item_id", "store_id"))
    assert sorted((r["id"], r["d_1"], r["d_2"]) for r in wide.collect()) == [("i_s", 1, 2), ("j_s", 3, 4)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        spark.createDataFrame([("i", "s", "x", "2")], "item_id string, store_id string, d_1 string, d_2 string").write.mode("overwrite").csv(f"{tmp_path}/bad", header=True)
        W.read_wide_sales(spark, f"{tmp_path}/bad", 2, ("item_id", "store_id")).collect()


@pytest.fixture(scope="module")
def models(spark):
    df = spark.createDataFrame([(float(k % 7), f"c{k % 3}", float(k % 7 + k % 3), 1.0) for k in range(200)], "a double, c string, label double, weight double")
    binning = G.fit_binning(df, ["a"], ["c"])
    made = [G.Training(df, binning, [G.Params("point", "l2", depth=2, min_rows=5), G.Params("q90", "quantile", alpha=0.9, depth=1, without=("c",))]).grow(n).model() for n in (1, 2)]
    return df, made


def test_a_promoted_model_is_taken_up_and_others_are_refused(spark, models, tmp_path):
    df, (one, two) = models
    artifacts, serving = (T.Artifacts(spark, str(tmp_path), ["a", "c"]) for _ in range(2))
    with pytest.raises(LookupError):
        serving.model()
    artifacts.promote(one, 0.7)
    made = lambda m: sorted((r["point"], r["q90"]) for r in m.transform(df).collect())
    assert made(serving.model()) == made(one) and serving.model() is serving.model()
    artifacts.promote(two, 0.6)
    assert made(serving.model()) == made(two) != made(one)  # without a restart
    about = serving.about().first()
    assert about["wrmsse"] == 0.6 and 0 <= about["artifact_age"] < 1
    with pytest.raises(ValueError, match="reads"):
        T.Artifacts(spark, str(tmp_path), ["a"]).model()


def test_a_failed_step_leaves_the_pointer(spark, models, tmp_path):
    _, (one, two) = models
    artifacts = T.Artifacts(spark, str(tmp_path), ["a", "c"])
    good, bad = (spark.createDataFrame([(9, n)], "n_rows long, units_negative long") for n in (0, 2))
    run = lambda violations, model, score: T.retrain(artifacts, violations, lambda: model, lambda m: score, 0.75)
    assert [s for s, _, _ in run(good, one, 0.5)] == ["validate", "train", "backtest", "gate", "promote"]
    path = artifacts.pointer.read().first()["path"]
    assert run(bad, two, 0.1) == [("validate", False, "units_negative: 2")]
    assert run(good, two, 0.9)[-1] == ("gate", False, "0.9000 of 0.75")
    assert run(good.filter("n_rows < 0").union(spark.createDataFrame([(0, 0)], "a long, b long")), two, 0.1)[0][1] is False
    assert artifacts.pointer.read().first()["path"] == path
