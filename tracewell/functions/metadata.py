"""What is said about calls beside their content: metadata kept flat, identities of retrievers, results that report errors."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import REDACTED, SECRET_STEMS, SECRET_WORDS, _col, caller_metadata, caller_tags, redact

#: Keys that metadata may not have, and what is put before them.
RESERVED, RESERVED_PREFIX = ("obj", "path", "name", "description", "_store"), "LC-"
#: An integration that names a component, not a framework; and what a framework's keys start with.
COMPONENTS, GRAPH_PREFIX = ("langchain_chat_model",), "langgraph_"


def secret(key: str) -> bool:
    """``is_secret_key`` of one key."""
    parts = "".join(c if c.isascii() and c.isalnum() else " " for c in key.lower()).split()
    return any(p in SECRET_WORDS or p.startswith(SECRET_STEMS) for p in parts)


def redacted(value):
    """A decoded JSON value with the values of secret keys replaced, at any depth; without recursion, so depth has no bound."""
    top = [value]
    work = [(top, 0)]
    while work:
        holder, at = work.pop()
        held = holder[at]
        if isinstance(held, dict):
            holder[at] = copy = {k: REDACTED if secret(k) else v for k, v in held.items()}
            work += [(copy, k) for k, v in copy.items() if isinstance(v, (dict, list))]
        elif isinstance(held, list):
            holder[at] = copy = list(held)
            work += [(copy, i) for i, v in enumerate(copy) if isinstance(v, (dict, list))]
    return top[0]


@F.pandas_udf(T.StringType())
def redact_json(values: pd.Series) -> pd.Series:
    """JSON texts with the values of secret keys replaced at any depth, members in their order; null stays, and so does what is no JSON."""

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(redacted(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return text

    return values.map(one, na_action="ignore")


def verbose_metadata(values: Column | str) -> Column:
    """A flat map that may be unpacked: secrets redacted, reserved keys renamed until none is taken, null as the word null."""
    held = redact(values)
    taken = lambda k: F.map_contains_key(held, k)
    once = lambda k: F.concat(F.lit(RESERVED_PREFIX), k)
    name = lambda k: F.when(~k.isin(*RESERVED), k).when(taken(once(k)), once(once(k))).otherwise(once(k))
    return F.transform_keys(F.transform_values(held, lambda k, v: F.coalesce(v, F.lit("null"))), lambda k, v: name(k))


def flatten_nested(values: Column | str) -> Column:
    """A map of VARIANT values as strings: objects and arrays become JSON, scalars their text, null stays null."""
    return F.transform_values(_col(values), lambda k, v: F.when(F.is_variant_null(v), F.lit(None).cast("string")).when(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string")))


def retriever_identity(name: Column | str, metadata: Column | str, tags: Column | str) -> Column:
    """JSON of {retriever, class, config, tags}; what is missing or empty has no member."""
    config, own = caller_metadata(metadata), caller_tags(tags)
    kind = F.get(F.map_values(F.map_filter(_col(metadata), lambda k, v: k == "ls_retriever_name")), F.lit(0))
    entries = F.array_sort(F.map_entries(config))
    return F.to_json(F.struct(
        _col(name).alias("retriever"), F.when(kind != "", kind).alias("class"),
        F.when(F.size(entries) > 0, F.map_from_entries(entries)).alias("config"), F.when(F.size(own) > 0, own).alias("tags"),
    ))


def is_tool_error(status: Column | str, content: Column | str) -> Column:
    """Whether a tool's result reports a failure: by its status, else by how its text starts."""
    return _col(status).eqNullSafe(F.lit("error")) | F.coalesce(F.ltrim(_col(content)).startswith("Error"), F.lit(False))


def names_framework(metadata: Column | str) -> Column:
    """The framework that a run's metadata name, or null."""
    integration = F.get(F.map_values(F.map_filter(_col(metadata), lambda k, v: k == "ls_integration")), F.lit(0))
    graph = F.exists(F.map_keys(_col(metadata)), lambda k: k.startswith(GRAPH_PREFIX))
    return F.when((integration != "") & ~integration.isin(*COMPONENTS), integration).when(graph, "langgraph")
