"""Intermediate results that several later steps read, written once."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the cluster's shared checkpoint folder and go on from there.

    The folder is the session's spark.checkpoint.dir; only where none is set
    (tests, notebooks) is one made below the warehouse, with a warning off a local master, as
    executors may not share that.  Never localCheckpoint: those blocks die with their executor.
    Files go when their frame is collected, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            folder = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
            if not context.master.startswith("local["):
                warnings.warn(f"spark.checkpoint.dir isn't set; {folder} must be shared by all executors", stacklevel=2)
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
