"""Readers of the driver tables and of logs, with fixed schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A log with one object a line, or an array with one element a line; a line that doesn't parse is an error."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"^\[|,$|\]$", "").alias("line")).where("line <> ''")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def read_or_default(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, empty where the path does not exist; other failures stay failures."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.createDataFrame([], schema)


def inside(base: str, path: str) -> str:
    """A path under a folder; one that leads out of it is an error."""
    full = os.path.normpath(os.path.join(base, path))
    if full != os.path.normpath(base) and not full.startswith(os.path.normpath(base) + os.sep):
        raise ValueError(f"path leads out of {base}: {path}")
    return full


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(hash, short, created_ms, summary, parents) from lines ``hash short seconds parents...|summary``."""
    head, summary = F.split_part("value", F.lit("|"), F.lit(1)), F.regexp_replace("value", r"^[^|]*\|", "")
    p = F.filter(F.split(head, " "), lambda x: x != "")
    return spark.read.text(path).where("value <> ''").select(p[0].alias("hash"), p[1].alias("short"), (p[2].cast("long") * 1000).alias("created_ms"), summary.alias("summary"), F.slice(p, F.lit(4), F.greatest(F.size(p) - 3, F.lit(0))).alias("parents"))
