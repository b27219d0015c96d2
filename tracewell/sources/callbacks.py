"""Callbacks of agent frameworks: one JSON object a line, twelve kinds told apart by the column ``callback``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CALLBACK

#: What a callback says of a run, by its name.
STARTS = ("on_chain_start", "on_chat_model_start", "on_tool_start", "on_retriever_start")
ENDS = ("on_chain_end", "on_llm_end", "on_tool_end", "on_retriever_end")
ERRORS = ("on_chain_error", "on_llm_error", "on_tool_error", "on_retriever_error")


def _known(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("callback").isin(*STARTS, *ENDS, *ERRORS) & F.col("run_id").isNotNull())


def read_callbacks(spark: SparkSession, path: str) -> DataFrame:
    """Callbacks of a capture; other lines, and callbacks without a run, are left out."""
    return _known(spark.read.schema(CALLBACK).json(path))


def stream_callbacks(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The same, as files arrive; ``files_per_batch`` bounds what a batch takes in."""
    return _known(spark.readStream.schema(CALLBACK).option("maxFilesPerTrigger", files_per_batch).json(folder))
