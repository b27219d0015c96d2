"""Manifest documents: read into tables, merged, and written one a session."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_safe

#: Larger documents are refused before they are read.
MAX_BODY = 64 << 20
#: Paths of documents: files, or Spark's files in a folder by the document's name.
DOCUMENT = r"\.json$|/document=[^/]*\.json/part-[^/]*$"


def list_documents(spark: SparkSession, folder: str, with_fragments: bool = False) -> DataFrame:
    """(path, length) of the manifests in a folder; fragments that no session owns are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "length")
    return found if with_fragments else found.filter(~F.col("path").endswith(".unattributed.json"))


def read_documents(spark: SparkSession, folder: str, max_body: int = MAX_BODY) -> DataFrame:
    """(path, doc VARIANT) of mergeable documents, files or what ``write_documents`` wrote: version 3, statements and blobs objects."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.col("path").rlike(DOCUMENT) & (F.col("length") <= max_body))
    docs = raw.select("path", F.try_parse_json(F.decode("content", "utf-8")).alias("doc"))
    kind = lambda k: F.coalesce(F.schema_of_variant(F.expr(f"try_variant_get(doc, '$.{k}')")), F.lit(""))
    return docs.filter((F.try_variant_get("doc", "$.version", "string") == "3") & kind("statements").startswith("OBJECT") & kind("blobs").startswith("OBJECT"))


def statements(docs: DataFrame) -> DataFrame:
    """(path, id, type, body VARIANT)."""
    docs.createOrReplaceTempView("__manifest_docs")
    return docs.sparkSession.sql(
        "SELECT path, e.key AS id, try_variant_get(e.value, '$.@type', 'string') AS type, e.value AS body "
        "FROM __manifest_docs, LATERAL variant_explode(variant_get(doc, '$.statements')) AS e"
    )


def blobs(docs: DataFrame) -> DataFrame:
    """(path, cid, bytes): keys with or without their prefix, base64 decoded."""
    docs.createOrReplaceTempView("__manifest_docs")
    found = docs.sparkSession.sql("SELECT path, e.key AS key, CAST(e.value AS STRING) AS value FROM __manifest_docs, LATERAL variant_explode(variant_get(doc, '$.blobs')) AS e")
    return found.select("path", F.regexp_replace("key", "^urn:cid:", "").alias("cid"), F.try_to_binary("value", F.lit("base64")).alias("bytes"))


def as_documents(statements: DataFrame, blobs: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, file_name, body): the JSON document of each session, of statements (id, body JSON) and blobs (cid, bytes)."""
    held = statements.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "body")))).alias("s"))
    bytes_of = blobs.dropDuplicates([session, "cid"]).groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cid", F.base64("bytes"))))).alias("b"))
    entry = F.array_join(F.transform(F.map_entries("s"), lambda e: F.concat(F.to_json(F.struct(e["key"])).substr(F.lit(8), F.length(F.to_json(F.struct(e["key"]))) - 8), F.lit(":"), e["value"])), ",")
    body = F.concat(F.lit('{"version":"3","contexts":{},"statements":{'), entry, F.lit('},"blobs":'), F.coalesce(F.to_json("b"), F.lit("{}")), F.lit("}"))
    return held.join(bytes_of, session, "left").select(session, F.concat(path_safe(F.col(session).cast("string")), F.lit(".json")).alias("file_name"), body.alias("body"))


def write_documents(documents: DataFrame, folder: str) -> None:
    """Documents (file_name, body), each in a folder by its name; one that is there already stays, and the new one is numbered.

    Spark's commit makes the files appear when all are whole. Names that are taken are read from the partitions of the folder, not from documents.
    """
    spark = documents.sparkSession
    try:
        taken = spark.read.option("basePath", folder).text(folder).select(F.col("document").cast("string").alias("taken"))
    except AnalysisException:  # nothing is written yet
        taken = spark.createDataFrame([], "taken string")
    stem = lambda c: F.regexp_replace(c, r"(\.\d+)?\.json$", "")
    held = taken.distinct().groupBy(stem(F.col("taken")).alias("stem")).agg(F.count("*").alias("n"))
    named = documents.withColumn("__stem", stem(F.col("file_name"))).join(held, F.col("__stem") == F.col("stem"), "left")
    name = F.when(F.col("n") > 0, F.concat("__stem", F.lit("."), "n", F.lit(".json"))).otherwise(F.col("file_name"))
    named.select(name.alias("document"), F.col("body").alias("value")).write.partitionBy("document").mode("append").text(folder)


def merge_into(documents: DataFrame, others: DataFrame, session: str = "session_id") -> DataFrame:
    """Documents (session, body JSON) with the statements (session, id, body JSON) of others that they lack; a document that gets none stays byte for byte.

    Ids that a document has already are its own; one that gets statements is put together anew of its four members.
    """
    own = F.from_json(F.get_json_object("body", "$.statements"), "map<string,string>")
    lacking = others.withColumnRenamed("body", "other").join(documents.select(F.col(session), own.alias("own")), session)
    lacking = lacking.filter(~F.coalesce(F.map_contains_key("own", F.col("id")), F.lit(False)))
    more = lacking.dropDuplicates([session, "id"]).groupBy(session).agg(F.collect_list(F.struct(F.col("id").alias("key"), F.col("other").alias("value"))).alias("more"))
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    entries = F.array_sort(F.concat(F.coalesce(F.map_entries(own), F.array()), "more"))
    held = F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ",")
    member = lambda name: F.coalesce(F.get_json_object("body", f"$.{name}"), F.lit("{}"))
    body = F.concat(F.lit('{"version":"3","contexts":'), member("contexts"), F.lit(',"statements":{'), held, F.lit('},"blobs":'), member("blobs"), F.lit("}"))
    return documents.join(more, session, "left").withColumn("body", F.when(F.col("more").isNotNull(), body).otherwise(F.col("body"))).drop("more")


def wire_complete(body: str = "body"):
    """Whether a captured response body ends in the stream's terminator."""
    return F.rtrim(F.decode(F.col(body), "utf-8")).endswith("data: [DONE]")
