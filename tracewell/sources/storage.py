"""Cutting lineage in the storage that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def materialise(df: DataFrame) -> DataFrame:
    """The rows written to ``spark.checkpoint.dir`` once, and read from there; a folder is set only where none is."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(where or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return df.checkpoint()
