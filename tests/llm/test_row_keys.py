"""The pipeline's stages on rows with null and repeated ids: each row has its own verdict."""

import collections

import pytest
from pyspark.sql import functions as F

from harvestline.llm import exact_dedup, mixing, near_text

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A, B, C, D = (" ".join(f"{name}{k}" for k in range(60)) for name in "abcd")
#: Repeated rows, copies without an id, one id with two texts of which one is a copy, texts of one row.
ROWS = [(1, A), (1, A), (None, A), (None, B), (None, B), (2, C), (3, C), (2, D), (None, None), (4, "")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, near_text.keep_one])
def test_one_row_of_each_text_stays(spark, stage):
    got = collections.Counter((r["doc_id"], r["text"]) for r in stage(frame(spark, ROWS)).collect())
    ids = {A: 1, B: None, C: 3 if stage is exact_dedup.drop_copies else 2, D: 2, "": 4}
    assert got == collections.Counter((i, t) for t, i in ids.items())


def test_colliding_hashes_keep_the_same_rows(spark):
    docs = frame(spark, ROWS).withColumn("key", F.monotonically_increasing_id()).cache()
    rows = exact_dedup.exact_dedup(docs, lambda c: F.pmod(F.xxhash64(c), F.lit(3)), row="key").collect()
    assert len(rows) == len({r["key"] for r in rows}) == len(ROWS) and sum(r["kept"] for r in rows) == 5


def test_colliding_hashes_and_a_row_key_of_any_name(spark):
    docs = frame(spark, ROWS).withColumn("row", F.concat(F.lit("k"), F.monotonically_increasing_id().cast("string"))).cache()
    rows = exact_dedup.exact_dedup(docs, lambda c: F.pmod(F.xxhash64(c), F.lit(3)), row="row").collect()
    assert {r["row"] for r in rows} == {r["row"] for r in docs.collect()} and sum(r["kept"] for r in rows) == 5


def test_the_mix_takes_no_row_without_words(spark):
    """Also where each row is taken three times whole."""
    docs = frame(spark, [(1, "a b c"), (2, None), (3, ""), (4, " \n")]).withColumn("source", F.lit("s")).withColumns({n: F.lit(9) for n in ("__row", "row", "node", "copies")})
    for rows in (docs, docs.unionByName(docs.withColumns({"source": F.lit("t"), "text": F.repeat("text", 500)}))):
        taken = mixing.take_mix(rows)
        assert taken.columns == docs.columns
        assert {r["doc_id"] for r in taken.collect()} == {1}


def test_the_mix_takes_each_row_as_often_as_decided(spark):
    """Two sources by 5 to 2: the rows of the smaller share, with null and repeated ids, are taken to within one document of the target."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"{k} " + "w " * (k % 5), "en", f"s{k % 2}", 0) for k in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    size = lambda source: sum(1 + k % 5 for k in range(120) if k % 2 == source)
    taken, whole = mixing.take_mix(docs).collect(), size(0) + size(1)
    for name, share in (("s0", 5 / 7), ("s1", 2 / 7)):
        mine = [r for r in taken if r["source"] == name]
        assert abs(sum(len(r["text"].split()) for r in mine) - share * whole) <= 5
        assert {r["doc_id"] is None for r in mine} == {True, False}
    assert max(collections.Counter(r["text"] for r in taken).values()) <= 3
