"""Evidence that gateways hold: which calls to ask for, what an answer means, and what becomes of fetched documents. Fetching itself is left to whoever lands the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds between tries, for one call, for a session, and how long a missing record may still appear.
RETRY_S, CALL_S, SESSION_S, MISSING_S = 0.5, 45, 10, 3


def verdict(http_status: Column, record_status: Column, waited_s: Column) -> Column:
    """ready, failed, retry or missing, of an answer's HTTP status, the record's own status and the seconds since the first try."""
    return (
        F.when((http_status == 200) & (record_status == "ready"), "ready").when((http_status == 200) & (record_status == "failed"), "failed")
        .when(waited_s >= SESSION_S, "missing").when((http_status == 404) & (waited_s >= MISSING_S), "missing")
        .when((http_status == 200) | (http_status == 404) | (http_status >= 500), "retry").otherwise("missing")
    )


def request_id(headers: Column, name: str) -> Column:
    """A request's id from a map of headers, whatever their case; null unless it is a uuid."""
    from ..functions.text import is_uuid

    value = F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())), F.lit(0))
    return F.when(is_uuid(value), value)


def link(calls: DataFrame, fetched: DataFrame) -> DataFrame:
    """Calls with their fetched documents; a call that a provider serves and that has none is counted as missing."""
    found = calls.join(fetched.withColumn("__found", F.lit(True)), "request_id", "left")
    return found.withColumn("counter", F.when(F.col("provider").isNotNull(), F.when(F.col("__found"), "ProviderManifestMerged").otherwise("ProviderManifestMissing"))).drop("__found")
