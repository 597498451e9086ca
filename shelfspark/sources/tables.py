"""Schemas, tables and file sources."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import is_image_name


_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType(),
    "map<string,int>": T.MapType(T.StringType(), T.IntegerType()),
}


def schema(text: str) -> T.StructType:
    """A schema from "name type, name type"; no session is needed."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(", "))])


_PRODUCT = "code string, name string, category string, description string, price double, price_sample double, price_hundred double, price_thousand double, stock int, color_stock map<string,int>, image_url string, image_path string, image_hash string"
CATALOG = schema(f"id long, {_PRODUCT}, content_hash string, created_at timestamp")
OCCURRENCES = schema(f"pos long, source string, url string, {_PRODUCT}, image_error string, scraped_at timestamp, updated_at timestamp")
SNAPSHOT = schema(f"url string, {_PRODUCT}, content_hash string, created_at timestamp, updated_at timestamp")
RUNS = schema("id long, started_at timestamp, finished_at timestamp, processed int, created int, updated int, unchanged int, errors int, status string, message string")
CHANGES = schema("id long, history_id long, change_type string, code string, product_name string, field_name string, field_label string, old_value string, new_value string")
METADATA = schema("key string, value string")
CATEGORIES = schema("name string, url string")
PAGES = schema("page_id long, url string, html string")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which ``spark.checkpoint.dir`` names; a local one only where Spark runs in one
    process and none is named (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/shelfspark-shared"
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder: for what several steps read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Rows that a task takes of a table that is shuffled by key.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys in as many partitions as ``rows`` ask for, which joins and aggregations by these keys go on with.

    Without a number Spark merges small partitions by their compressed size, and rows that compress well come to fill a
    task's memory.
    """
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, target: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Missing columns added (with a default or null), legacy ones dropped, types as in ``target``."""
    defaults = defaults or {}
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in target])


def lookup(df: DataFrame, keys: DataFrame, on: str = "code") -> DataFrame:
    """Rows whose key is among ``keys``."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def lookup_one(df: DataFrame, value: object, on: str = "code") -> DataFrame:
    return df.where(F.col(on) == F.lit(value))


def in_order(df: DataFrame, by: str = "id") -> DataFrame:
    """A landing table as it was filled."""
    return df.orderBy(by)


def newest_first(df: DataFrame, by: str = "id") -> DataFrame:
    return df.orderBy(F.desc(by))


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the image files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(is_image_name(F.col("path"))).select("path", "content")


def image_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The paths alone: Spark lists the files and opens none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(is_image_name(F.col("path"))).select("path")


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def flags(metadata: DataFrame) -> DataFrame:
    """key and set: whether any of its values is "1"."""
    return metadata.groupBy("key").agg(F.coalesce(F.max(F.col("value") == "1"), F.lit(False)).alias("set"))


def flag(metadata: DataFrame, key: str) -> DataFrame:
    """One row: whether the key's value is "1"."""
    return metadata.where(F.col("key") == key).agg(F.coalesce(F.max(F.col("value") == "1"), F.lit(False)).alias("set"))


def set_value(metadata: DataFrame, key: str, value: str) -> DataFrame:
    """The metadata with a key set, whether it was there or not."""
    one = metadata.sparkSession.createDataFrame([(key, value)], METADATA)
    return metadata.where(~F.col("key").eqNullSafe(key)).unionByName(one)


def is_ready(metadata: DataFrame, catalog: DataFrame, key: str = "initialized") -> bool:
    return bool(flag(metadata, key).first()["set"]) or not catalog.isEmpty()
