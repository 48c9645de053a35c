"""Tables in a folder with all-or-nothing loads, last-writer-wins merging on read, results kept by what they are made of, and text files.

A store is parts (Parquet folders) and a manifest, one row a part. A part is written first and named in the manifest last, by one small file
that appears as a whole; what was not named does not exist for readers, so a load that dies half-way leaves the old data, and what it
left behind is never read. One writer at a time is assumed; readers need no lock.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "number long, path string, tag string, base boolean, committed_at timestamp"


def _found(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at a path, None where there is none."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _name(spark: SparkSession, folder: str, number: int, path: str, tag: str, base: bool) -> None:
    """One more row of the manifest, in a file of its own."""
    row = (F.lit(number).cast("long").alias("number"), F.lit(path).alias("path"), F.lit(tag).alias("tag"), F.lit(base).alias("base"), F.current_timestamp().alias("committed_at"))
    spark.range(1).select(*row).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


class Store:
    """A table of rows with keys; of rows with equal keys the highest version counts, and of these the latest part's."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], version: str | None = None) -> None:
        self.spark, self.folder, self.schema, self.keys, self.version = spark, folder, schema, keys, version

    def parts(self) -> list[tuple[int, str, str]]:
        """Number, path and tag of the parts that count, from the last full load on."""
        found = _found(self.spark, f"{self.folder}/manifest", _MANIFEST)
        rows = found.orderBy("number").collect() if found is not None else []  # a row a load
        first = max((r["number"] for r in rows if r["base"]), default=0)
        return [(r["number"], r["path"], r["tag"]) for r in rows if r["number"] >= first]

    def _commit(self, rows: DataFrame, tag: str, base: bool) -> None:
        number = max((n for n, _, _ in self.parts()), default=0) + 1
        path = f"{self.folder}/parts/{uuid.uuid4().hex}"
        rows.select(*StructType.fromDDL(self.schema).fieldNames()).write.parquet(path, compression="snappy")
        _name(self.spark, self.folder, number, path, tag, base)

    def load(self, rows: DataFrame) -> bool:
        """The first load; nothing is done, and rows are not computed, if the store holds anything."""
        if self.parts():
            return False
        self._commit(rows, "load", True)
        return True

    def replace(self, rows: DataFrame) -> None:
        """A full load that takes the place of all parts."""
        self._commit(rows, "replace", True)

    def upsert(self, rows: DataFrame, tag: str) -> bool:
        """More rows, once for each tag: what is delivered again under its tag changes nothing and is not computed."""
        if tag in {t for _, _, t in self.parts()}:
            return False
        self._commit(rows, tag, False)
        return True

    def compact(self) -> None:
        """One part of all; readers of the old parts are not disturbed."""
        self._commit(self.read(), f"compact-{uuid.uuid4().hex}", True)

    def read(self) -> DataFrame:
        """The rows that count, merged as they are read."""
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        merged = None
        for number, path, _ in parts:
            part = self.spark.read.schema(self.schema).parquet(path).withColumn("__part", F.lit(number))
            merged = part if merged is None else merged.unionByName(part)
        if len(parts) == 1 and self.version is None:
            return merged.drop("__part")
        order = [F.desc(self.version)] if self.version else []
        first = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order, F.desc("__part")))
        return merged.withColumn("__rank", first).filter("__rank = 1").drop("__rank", "__part")


def signature(df: DataFrame) -> str:
    """A digest of what a frame is made of: its plan, and path, length and time of each file that it reads (their contents aren't read)."""
    spark, files = df.sparkSession, sorted(df.inputFiles())
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    about = hashlib.sha256(f"{df.semanticHash()}|{df.schema.json()}|{plan}".encode())
    if files:
        seen = spark.read.format("binaryFile").load(files).select("path", "length", F.unix_micros("modificationTime").alias("at"))
        line = F.concat_ws(":", "path", F.col("length").cast("string"), F.col("at").cast("string"))
        total = seen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(line).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), line)).alias("b")).first()
        about.update(f"|{total['n']}|{total['a']}|{total['b']}".encode())
    return about.hexdigest()


def memo(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as it was written when a frame of this signature was first asked for; a changed file or plan is another signature."""
    spark, place = df.sparkSession, f"{folder}/{name}-{signature(df)}"
    if not Store(spark, place, "", []).parts():
        path = f"{place}/parts/{uuid.uuid4().hex}"
        df.write.parquet(path)
        _name(spark, place, 1, path, "memo", True)
    return spark.read.schema(df.schema).parquet(Store(spark, place, "", []).parts()[0][1])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, quoted where needed; nulls are empty fields and empty texts are quoted."""
    df.write.mode("overwrite").csv(path, header=True, emptyValue='""', nullValue="")


def write_metrics(df: DataFrame, path: str) -> None:
    """The same rows as JSON lines and as CSV."""
    df.write.mode("overwrite").json(f"{path}/json")
    write_csv(df, f"{path}/csv")


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """format and the rows of both files, typed and strict."""
    as_json = spark.read.json(f"{path}/json", schema=schema, mode="FAILFAST").withColumn("format", F.lit("json"))
    as_csv = spark.read.csv(f"{path}/csv", schema=schema, header=True, mode="FAILFAST").withColumn("format", F.lit("csv"))
    return as_json.unionByName(as_csv)


def wide_sales_schema(days: int, keys: tuple[str, ...]) -> str:
    return ", ".join([*(f"{k} string" for k in keys), *(f"d_{d} long" for d in range(1, days + 1))])


def read_wide_sales(spark: SparkSession, path: str, days: int, keys: tuple[str, ...]) -> DataFrame:
    """A wide CSV of a column a day, with an id made of the keys; nothing is inferred, and a malformed line fails the scan."""
    wide = spark.read.csv(path, schema=wide_sales_schema(days, keys), header=True, mode="FAILFAST")
    return wide.withColumn("id", F.concat_ws("_", *keys))
