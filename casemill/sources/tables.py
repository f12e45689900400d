"""Reading and writing: tables, requests, documents, samples and benchmark results."""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casemill.functions import vocab as V
from casemill.functions.schemas import REQUESTS, SAMPLES, conform


def scan(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A Parquet table; older files without newer columns read as null there."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    return reader.parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small scan dealt to every core before costly projections; one with enough partitions stays as it is."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.toJavaRDD().getNumPartitions() >= wanted else df.repartition(wanted, key)


def lookup(df: DataFrame, key: int, id_col: str = "id") -> DataFrame:
    """The row with that id or none; the filter reaches the scan."""
    return df.where(F.col(id_col) == key).limit(1)


def append(df: DataFrame, path: str, schema: StructType | None = None) -> None:
    (conform(df, schema, {}) if schema is not None else df).write.mode("append").parquet(path)


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Complaint requests, one JSON object a line; broken lines give null fields and are left out."""
    return spark.read.schema(REQUESTS).json(path).where(F.col("text").isNotNull())


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Files to recognise: known suffixes, not empty, at most 10 MiB. Rejected files are not read beyond their metadata."""
    suffix = "|".join(V.DOCUMENT_SUFFIXES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").rlike(rf"\.({suffix})$") & (F.col("length") > 0) & (F.col("length") <= V.MOST_DOCUMENT_BYTES))


def stored_name(path, stamp):
    """A safe name for an upload: time stamp, then the file's name with anything unusual as underscores."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.concat(F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit("_"), F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Stored samples; blank lines are skipped, and so is a line that is no JSON (not all that follow it)."""
    return spark.read.schema(SAMPLES).json(path).where(F.col("id").isNotNull() | F.col("confidence").isNotNull())


def append_samples(df: DataFrame, path: str) -> None:
    conform(df, SAMPLES, {}).write.mode("append").option("ignoreNullFields", "false").json(path)


def write_benchmark(df: DataFrame, path: str) -> None:
    """The rows of a benchmark as CSV with a header and as JSON; nested columns are JSON text in the CSV."""
    flat = df.select(*(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema))
    flat.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


@cache
def gazetteer(path: str | None, default: tuple[str, ...]) -> tuple[str, ...]:
    """Names of a JSON list; the default if there is none or it can't be read."""
    try:
        return tuple(json.loads(Path(path).read_text(encoding="utf-8"))) if path else default
    except (OSError, ValueError):
        return default
