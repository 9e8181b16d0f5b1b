"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything but blank, tab, line feed, vertical tab, form feed and carriage return is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset and all run on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folioforge-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles():
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def key_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the column ``key`` out of batches that are sorted by it, one value at a time."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cuts = [0, *(np.flatnonzero(np.diff(held["key"].to_numpy())) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1])
    if held is not None and len(held):
        yield held


def hot_bound(total: int, keys: int = 1024, least: int = 1024) -> int:
    """A count that at most ``keys`` keys of a table of ``total`` rows can exceed."""
    return max(least, total // keys)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores after it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lookup_left(left: DataFrame, right: DataFrame, key: str | list[str], count: str, bound: int) -> DataFrame:
    """Like ``lookup``, but rows of left without a match stay, with nulls."""
    hot = right.where(F.col(count) > bound).drop(count)
    cold = right.where(F.col(count) <= bound).drop(count)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, "left"))


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], count: str, bound: int) -> DataFrame:
    """Inner join of left with right (one row a key; ``count``: how many rows of left have it) without a hot task.

    Keys with more than ``bound`` rows are few (see hot_bound), so they are broadcast; the others are shuffled.
    """
    hot = right.where(F.col(count) > bound).drop(count)
    cold = right.where(F.col(count) <= bound).drop(count)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))
