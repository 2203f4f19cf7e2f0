"""Sources and sinks with fixed schemas. Empty CSV cells are empty strings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULE = "ord int, first string, second string, result string, category string"
METER = "ord int, name string, groups string, pattern string"
EXAMPLE = "task string, src string, tgt string, provenance string"
ENCODED = "ids array<int>, loss_start int, task string"
SECTIONS = "sections array<struct<blocks: array<struct<content: string>>>>"


def once(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back, so that what is made of it several times is computed once."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cached(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """The table at ``path``; if it is missing or to be rebuilt, ``build()`` is written there first. A write cut short doesn't count."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if rebuild or not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Token ids from the file that ``write_vocabulary`` wrote; a vocabulary is a fixed table of some hundred tokens."""
    return {r["token"]: r["id"] for r in spark.read.schema("token string, id int").json(path).collect()}


def write_vocabulary(spark: SparkSession, table: dict[str, int], path: str) -> None:
    spark.createDataFrame(list(table.items()), "token string, id int").coalesce(1).write.mode("overwrite").json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path).na.fill("")


def text_lines(spark: SparkSession, path: str, pattern: str = "*.txt", limit_files: int | None = None) -> DataFrame:
    """(path, line) of all text files below ``path``; with a limit only of the first files by path."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    if limit_files is None:
        return rows
    first = rows.select("path").distinct().orderBy("path").limit(limit_files)
    return rows.join(F.broadcast(first), "path", "left_semi")  # limit_files rows


def last_field(line: str = "line", mark: str = "::"):
    return F.element_at(F.split(line, mark), -1)


def nested_lines(spark: SparkSession, path: str) -> DataFrame:
    """(content) of every block of a nested document; missing parts are empty."""
    doc = spark.read.schema(SECTIONS).option("multiLine", True).json(path)
    blocks = doc.select(F.explode_outer("sections").alias("s")).select(F.explode_outer("s.blocks").alias("b"))
    return blocks.select(F.coalesce("b.content", F.lit("")).alias("content"))


def examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXAMPLE).json(path)


def encoded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENCODED).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def first_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each value of ``by``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_n") <= n).drop("_n")
