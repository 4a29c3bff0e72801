"""Migration scripts as rows (filename, sql)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sql_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """All .sql files of a folder, by their path below it. Each file is one row."""
    reader = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.sql")
    rows = (reader.option("recursiveFileLookup", True) if recursive else reader).load(folder)
    base = folder.rstrip("/").split("://")[-1] + "/"
    path = F.col("_metadata.file_path")
    return rows.select(F.element_at(F.split(path, "\\Q" + base + "\\E"), -1).alias("filename"), F.col("value").alias("sql"))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of {filename, sql}."""
    return spark.read.schema("filename string, sql string").option("multiLine", True).json(path).where("filename IS NOT NULL")


def table_stats(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of {table_name, row_count, avg_row_size}."""
    return spark.read.schema("table_name string, row_count bigint, avg_row_size bigint").json(path)


def content_key(files: DataFrame) -> DataFrame:
    """Files with the key of the parse cache: a digest of text and base name."""
    name = F.element_at(F.split("filename", "/"), -1)
    return files.withColumn("cache_key", F.sha2(F.concat_ws("\x00", F.coalesce("sql", F.lit("")), name), 256))


def uncached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose key the cache lacks (left anti)."""
    return lacking(content_key(files), cache, "cache_key")


def lacking(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose `key` is no cache_key of the cache."""
    return rows.join(cache.select(F.col("cache_key").alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def dump(spark: SparkSession, path: str) -> DataFrame:
    """The tables of a snapshot that `sinks.snapshot_json` wrote: (full_name, created_in, table_comment, columns), camel-cased or not."""
    body = spark.read.option("multiLine", True).json(path).select(F.explode("tables").alias("t")).select("t.*")
    pick = lambda *names: next((F.col(n) for n in names if n in body.columns), F.lit(None))
    return body.select(pick("fullName", "full_name").alias("full_name"), pick("createdIn", "created_in").cast("string").alias("created_in"), pick("tableComment", "table_comment").cast("string").alias("table_comment"), "columns")
