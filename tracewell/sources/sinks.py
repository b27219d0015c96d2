"""When documents are written, under which name, and what is said about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import path_safe

#: A snapshot is due after so many new statements, or one for so many bytes of blobs.
EVERY_STATEMENTS, BYTES_PER_STATEMENT = 24, 65_536


def snapshot_due(new_statements: Column, blob_bytes: Column, is_first: Column) -> Column:
    """The first snapshot comes at once, later ones as statements have come in; large documents are written less often."""
    return is_first | (new_statements >= F.greatest(F.lit(EVERY_STATEMENTS), F.floor(blob_bytes / BYTES_PER_STATEMENT)))


def file_names(sessions: DataFrame) -> DataFrame:
    """(…, file_name) of sessions (session_id, incarnation, attributed): an earlier document is never written over."""
    stem = F.concat(path_safe(F.col("session_id").cast("string")), F.when(F.col("attributed"), F.lit("")).otherwise(".unattributed"))
    nth = F.row_number().over(Window.partitionBy("session_id", "attributed").orderBy("incarnation")) - 1
    return sessions.withColumn("file_name", F.concat(stem, F.when(nth > 0, F.concat(F.lit("."), nth)).otherwise(""), F.lit(".json")))


def announcements(written: DataFrame) -> DataFrame:
    """What is announced of documents that were written: the id of the bytes on disk, the place, the number of statements."""
    return written.filter("ok").select("session_id", "path", F.sha2("bytes", 256).alias("cid"), "n_statements", (~F.col("attributed")).alias("unattributed"))
