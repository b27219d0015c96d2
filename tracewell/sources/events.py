"""Host events and callbacks: JSON lines, decoded with the fixed envelope; what can't be decoded is kept and charged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import may_carry_lineage
from ..schemas import EVENT


def decode(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines -> the event's columns, ``undecodable``, ``charged`` (it may have carried lineage) and, of undecodable ones, the ``line``; blank lines are skipped."""
    lines = lines.filter(F.length(F.trim(value)) > 0)
    names = [f.name for f in EVENT]
    raw = lines.withColumn("raw", F.try_parse_json(value))
    plain = {f.name for f in EVENT if f.dataType.simpleString() == "string"}
    fields = [(F.try_variant_get("raw", f"$.{n}", "string") if n in plain else F.expr(f"try_variant_get(raw, '$.{n}')")).alias(n) for n in names if n != "attributes"]
    out = raw.select(*[c for c in lines.columns if c != value], F.col(value).alias("line"), "raw", *fields)
    broken = F.col("kind").isNull() | F.col("uuid").isNull()
    hook = F.try_variant_get("raw", "$.metadata.hook_event_name", "string")
    return out.withColumn("undecodable", broken).withColumn("charged", broken & may_carry_lineage(F.col("kind"), F.col("name"), hook)).withColumn("line", F.when(broken, F.col("line"))).drop("raw")


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """A capture of JSON lines, in order: ``seq`` numbers the lines of a file as they lie."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    return decode(lines)


def stream_capture(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The same, as files arrive."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return decode(lines)
