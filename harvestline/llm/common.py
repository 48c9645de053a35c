"""Small helpers shared by the text operators."""

from __future__ import annotations

import json
import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure-ASCII texts take the fast built-in; the others keep their capitals beyond A-Z."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def json_literal(value: object, ddl: str) -> Column:
    """A constant of a nested type; the optimizer folds it to one literal."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), ddl)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: later steps read it, and lost executors don't lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like cut, but as compressed Parquet: for large frames whose columns repeat."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_row(docs: DataFrame, key: str) -> DataFrame:
    """docs with a key of each row, a string that is the same whenever the frame is read.

    Of a table read from files it is the row's file and place there; any other frame is checkpointed with numbered rows.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.children().isEmpty() and any(a.name() == "_metadata" for a in _items(plan.metadataOutput())):
        place = docs.metadataColumn("_metadata")
        return docs.withColumn(key, F.concat_ws(":", place["file_path"], place["row_index"].cast("string")))
    return cut(docs.withColumn(key, F.monotonically_increasing_id().cast("string")))


def _items(seq: object) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def free_name(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of keys that a join may broadcast; larger sides are joined by a shuffle.
SMALL_ROWS = 20_000


def small(keys: DataFrame) -> DataFrame:
    """The checkpointed keys, broadcast if they are SMALL_ROWS at most."""
    return F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys
