"""Parquet tables with replace-by-key and append-missing writes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, and the rows of old whose key isn't in new."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def appended(old: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """old, and the samples whose key isn't in old."""
    return old.unionByName(samples.join(old.select(key).distinct(), key, "left_anti").select(*old.columns))


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_plain_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, file_name and text of the plain-text and Markdown files below a folder."""
    files = read_binary(spark, path).where(F.lower("path").rlike(r"\.(txt|md|markdown)$"))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.decode("content", "UTF-8").alias("text"))


def text_blocks(documents: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, block_index, page and text of each line that isn't blank; [[page:N]] lines set the page."""
    lines = documents.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("block_index", "line"))
    mark = F.nullif(F.regexp_extract("line", r"^\s*(?:\[\[page:|【第)([0-9]+)(?:\]\]|页】)\s*$", 1), F.lit("")).cast("int")
    w = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("mark", mark).withColumn("page", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit(1)))
    return rows.where(F.col("mark").isNull() & (F.trim("line") != "")).select(key, "block_index", "page", F.trim("line").alias("text"))


def read_questions(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """seq, question, standard_answer and correct_file of a delimited file whose header names them in any of the usual words."""
    rows = spark.read.option("header", "true").option("sep", separator).option("multiLine", "true").option("escape", '"').csv(path)
    kinds = {"correct_file": "(?i)file|文件", "standard_answer": "(?i)answer|答案", "question": "(?i)question|问题", "seq": "(?i)^(seq|no|id|序号|编号)"}
    named, free = {}, list(rows.columns)
    for kind, pattern in kinds.items():  # the most specific first
        if found := next((c for c in free if re.search(pattern, c)), None):
            named[kind] = found
            free.remove(found)
    return rows.select(*[(F.trim(F.col(f"`{named[k]}`")) if k in named else F.lit(None).cast("string")).alias(k) for k in ("seq", "question", "standard_answer", "correct_file")]).where("question <> ''")


def shared_table(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share (spark.checkpoint.dir) and read back: what later steps read more than once survives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="folioforge-"))
    path = f"{context.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
