"""Streams of archives (an extension; the operators themselves are batch): catalogue entries as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.zipfiles import catalog

_FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, glob: str = "*.zip", files_a_batch: int = 100) -> DataFrame:
    """Streaming (pair_id, content) of the folder's files."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("pair_id"), "content")


def watch_catalog(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Streaming catalogue; archives that can't be read are left out."""
    return catalog(watch(spark, folder, **options), strict=False)
