"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Each text is cut where its content says so, and its recipe is the ordered list of its chunks' identifiers. An identifier
is a 64-bit hash that is verified against the chunks' bytes: the distinct (hash, chunk) pairs are gathered once, and a hash
that stands for more than one chunk is told apart by the chunk's rank among them. After that only recipes move: long texts
are compared, grouped and joined as short lists of numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, free_name, small, with_row

#: A chunk ends after white space that follows a sentence mark, 1,024 to 16,384 characters after its start.
CHUNK = r"(?s).{1024,16384}?(?:(?<=[.!?;]\s)|\z)|.{1,16384}"


def exact_dedup(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64, chunk: str = CHUNK, row: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one (its recipe is the empty list). Of
    equal texts the row with the largest doc_id stays; rows that repeat a doc_id are one document and share its verdict, and
    a null doc_id stays only if its whole group has none. Other columns are not read, so their names can't clash. A group
    may hold any share of the rows: it is summed before the shuffle, and the join that hands out its verdict can be split.
    With a row key, which is returned too, each row is a document of its own: one row of each group stays, ids null or repeated or not.
    """
    carry = [row] if row else []
    text = docs.select("doc_id", *carry, ascii_lower(F.coalesce("text", F.lit(""))).alias("text"))
    chunks = F.regexp_extract_all("text", F.lit(chunk), F.lit(0))
    pairs = text.select(F.explode(chunks).alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = cut(pairs.withColumn("n", F.lit(1)).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    recipes = text.select("doc_id", *carry, F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.transform(chunks, lambda c: chunk_hash(c)).alias("recipe"))
    if shared.isEmpty():
        recipes = cut(recipes)
    else:
        recipes = cut(_told_apart(text, chunks, pairs, shared, chunk_hash, carry))
    last = [F.max(F.struct("doc_id", row))[row].alias("keep_row")] if row else []
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), *last, F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups.filter("group_size > 1"))  # cut, so that the join has its own exchange and a large group can be split
    kept = F.col(row) == F.coalesce("keep_row", row) if row else F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id"))
    return recipes.join(groups, "recipe", "left").select(
        "doc_id", *carry, F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"), "text_sha256",
    )


def _told_apart(text: DataFrame, chunks: Column, pairs: DataFrame, shared: DataFrame, chunk_hash: Callable[[Column], Column], carry: list[str]) -> DataFrame:
    """Recipes when some hashes stand for several chunks: those chunks are known by (hash, rank among the hash's chunks)."""
    rank, key = F.row_number().over(Window.partitionBy("h").orderBy("chunk")), free_name(text, "__n")
    ranked = pairs.join(shared, "h", "left_semi").withColumn("rank", rank)
    rows = text.withColumn(key, F.monotonically_increasing_id())
    rows = cut(rows.select(key, "doc_id", *carry, F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), chunks.alias("chunks")))
    parts = rows.select(key, F.posexplode("chunks").alias("at", "chunk")).withColumn("h", chunk_hash(F.col("chunk")))
    named = parts.join(ranked, ["h", "chunk"], "left").select(key, "at", "h", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))
    lists = named.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "h", "rank"))).alias("parts"))
    lists = lists.select(key, F.flatten(F.transform("parts", lambda p: F.array(p["h"].cast("long"), p["rank"]))).alias("recipe"))
    return rows.join(lists, key, "left").select("doc_id", *carry, "text_sha256", F.coalesce("recipe", F.array().cast("array<bigint>")).alias("recipe"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with their columns.

    Rows are known by their place and not by doc_id: null and repeated ids are rows like any other, of rows equal in doc_id and text one
    stays, and one doc_id with two texts is two documents. Null texts are empty ones and so copies of each other; texts of any length are
    compared whole; an empty table stays empty; columns of any name stay as they are.
    """
    key = free_name(docs, "__row")
    rows = with_row(docs, key)
    gone = cut(exact_dedup(rows, row=key).filter("not kept").select(key))
    return rows.join(small(gone), key, "left_anti").select(*docs.columns)
