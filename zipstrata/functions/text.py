"""Entry names, deflate settings as text, numbers for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import kernel

def path_text(path, utf8_flag) -> Column:
    """Entry name from its bytes: UTF-8 if flagged, else code page 437 (which Spark's decode doesn't know)."""
    return kernel(lambda p, u: None if p is None else bytes(p).decode("utf-8" if u else "cp437", "replace"), "string")(path, utf8_flag)


def format_params(p: str) -> Column:
    """level=6,strategy=0,nowrap=true from a struct column; null for null."""
    return F.when(F.col(p).isNotNull(), F.format_string("level=%d,strategy=%d,nowrap=%s", f"{p}.level", f"{p}.strategy", F.col(f"{p}.nowrap").cast("string")))


def parse_params(text: str) -> Column:
    """Struct of settings from their text; null if it isn't one."""
    pattern = "^level=([1-9]),strategy=([0-2]),nowrap=(true|false)$"
    part = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    return F.when(F.col(text).rlike(pattern), F.struct(part[0].cast("int").alias("level"), part[1].cast("int").alias("strategy"), part[2].cast("boolean").alias("nowrap")))


def all_params(spark: SparkSession) -> DataFrame:
    """The 54 settings: level 1-9, strategy 0-2, with and without wrapper."""
    levels = spark.range(1, 10).select(F.col("id").cast("int").alias("level"))
    return levels.withColumn("strategy", F.explode(F.array(*map(F.lit, range(3))))).withColumn("nowrap", F.explode(F.array(F.lit(True), F.lit(False))))


def grouped_number(n) -> Column:
    return F.format_number(n, 0)
