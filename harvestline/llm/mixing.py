"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, n_words, with_row

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Fractional documents that one node of the reduction tree combines.
FAN_IN = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, n, target for (source, size) rows: shares by weight of the whole size, none above most times its source.

    Sharing the excess again and again ends at min(most * size, level * weight); the level is found from one ordering of the
    sources by the level at which each is full. Only one row for each source goes through the windows without a key.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name, full = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("full", F.asc_nulls_last("source"))
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))).cast("double")
    src = src.withColumn("w", weight).withColumn("most", F.col("source_size").cast("double") * most).withColumn("full", F.col("most") / F.col("w"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    total, everything = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()), F.sum("w").over(Window.partitionBy())
    src = src.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (everything - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    open_level = F.max(F.when(F.col("full") > F.col("level"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("full") <= F.col("level"), F.col("most")).otherwise(F.least("most", open_level * F.col("w")))
    return src.select("source", "source_size", "n", target.alias("target"))


def _uniform(*key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def _pair(state: Column, x: Column, level: int, seed: int) -> Column:
    """One pivotal step: words move between the carried document and x until one of them is whole; the sum of words stays.

    The direction is random so that each document's probability keeps its mean.
    """
    c = state["carry"]
    share = x["size"] / c["size"]
    up, down = F.least(1 - c["p"], x["p"] * share), F.least(c["p"], (1 - x["p"]) * share)
    chance = _uniform(F.lit(seed), F.lit(level), c["doc_id"], x["doc_id"])
    moved = F.when(chance * (up + down) < down, up).otherwise(-down)
    snap = lambda p: F.when(p < 1e-9, F.lit(0.0)).when(p > 1 - 1e-9, F.lit(1.0)).otherwise(p)
    unit = lambda u, p: F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), snap(p).alias("p"), u["row"].alias("row"))
    both = F.array(unit(c, c["p"] + moved), unit(x, x["p"] - moved / share))
    after = F.concat(state["done"], F.filter(both, lambda u: (u["p"] == 0) | (u["p"] == 1)))
    left = F.filter(both, lambda u: (u["p"] > 0) & (u["p"] < 1))
    return F.when(c.isNull(), F.struct(x.alias("carry"), state["done"].alias("done"))).otherwise(F.struct(F.get(left, F.lit(0)).alias("carry"), after.alias("done")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 17, fan_in: int = FAN_IN, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    A document's expected copies are its source's target over the source's size; the whole part is taken and the fraction
    rounded by pivotal steps that move words, so that a source's taken words miss its target by one document at most. A
    node of the reduction tree combines about fan_in fractions and passes one on. A null text has size 0, a null source is a source of its own (last in
    order); documents without words take 0; an empty table gives no rows. Chances come from hashes of the ids, so reruns agree.
    Rows with the same doc_id are separate units; a row key is returned as row. Columns other than these, text and source are not read.
    """
    rows = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), (F.col(row) if row else F.lit(None)).cast("string").alias("row")))
    targets = cut(source_targets(rows, weights, most))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio).cast("long")).withColumn("p", ratio - F.floor(ratio)).withColumn("b", F.ceil(F.col("n") / fan_in).cast("long"))
    per_source = targets.select(F.col("source").alias("source_"), "source_size", "target", "whole", "p", "b")
    rows = rows.join(per_source, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    plain = rows.filter((F.col("p") <= 1e-9) | (F.col("p") >= 1 - 1e-9) | (F.col("size") == 0)).withColumn("extra", F.round("p").cast("long"))
    keys = ["source", "source_size", "target", "whole"]
    parts = [plain.select("doc_id", "size", "row", *keys, "extra")]
    units = rows.filter((F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9) & (F.col("size") > 0))
    units = units.select(*keys, "b", F.pmod(F.xxhash64("doc_id", "size", "row", F.lit(seed)), "b").alias("node"), F.struct("doc_id", "size", "p", "row").alias("unit"))
    buckets, level = targets.agg(F.max("b")).first()[0] or 0, 0
    while buckets:
        start = F.struct(F.lit(None).cast("struct<doc_id:bigint,size:bigint,p:double,row:string>").alias("carry"), F.array().cast("array<struct<doc_id:bigint,size:bigint,p:double,row:string>>").alias("done"))
        folded = units.groupBy(*keys, "b", "node").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        folded = cut(folded.select(*keys, "b", "node", F.aggregate("units", start, lambda s, x: _pair(s, x, level, seed)).alias("s")))
        decided = folded.select(*keys, F.explode("s.done").alias("u"))
        parts.append(decided.select("u.doc_id", "u.size", "u.row", *keys, F.col("u.p").cast("long").alias("extra")))
        left = folded.filter("s.carry is not null")
        root = left.filter("b = 1").select(*keys, F.col("s.carry").alias("u"))
        last = (_uniform(F.lit(seed), F.lit(-1), F.col("u.doc_id")) < F.col("u.p")).cast("long")
        parts.append(root.select("u.doc_id", "u.size", "u.row", *keys, last.alias("extra")))
        fewer = F.ceil(F.col("b") / fan_in).cast("long")
        units = left.filter("b > 1").select(*keys, fewer.alias("b"), F.pmod("node", fewer).alias("node"), F.col("s.carry").alias("unit"))
        buckets, level = (-(-buckets // fan_in) if buckets > 1 else 0), level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "size", "source_size", "target", ((F.col("whole") + F.col("extra")) * F.col("size")).alias("taken"), (F.col("whole") + F.col("extra")).alias("copies"), *(["row"] if row else []))


def take_mix(docs: DataFrame, **options: object) -> DataFrame:
    """docs with each row as often as the mix takes it; documents that the mix leaves out are gone.

    Rows are known by their place and not by doc_id, so null and repeated ids are rows like any other, each with copies of its own. Rows
    without words (null and empty texts) are not taken; null sources are one source; texts of any length pass whole; an empty table stays
    empty; columns of any name stay as they are.
    """
    key, copies, copy = (free_name(docs, name) for name in ("__row", "__copies", "__copy"))
    rows = with_row(docs, key)
    taken = mix_sources(rows, row=key, **options).filter("size > 0").select(F.col("row").alias(key), F.col("copies").alias(copies))
    joined = rows.join(taken.filter(F.col(copies) > 0), key)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
