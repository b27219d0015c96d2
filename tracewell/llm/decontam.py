"""Benchmark decontamination with DataFrame functions only.

Normalised windows of the benchmark are a hash set; every token window of the training texts is looked up in it, each hit is verified word for
word, and the hit words (or documents) can be removed. The set is broadcast; a set of more than BROADCAST_BYTES goes out in parts of that size, a pass over
the texts for each, so a larger benchmark takes longer and gives the same rows.

Defined results: every document row has a row of its own, also rows that share a doc_id or have none. A null or wordless text has no words and no hits; a
null or wordless benchmark item has no windows. Rows of one item_id are one item, those without an id too. Texts of any length are scanned
whole. Extra columns are ignored by ``contamination`` and kept, whatever their names, by ``remove_spans``. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialise

#: What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of windows that are broadcast at once, by an estimate from their words and item ids.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Words of a text: runs of digits, a-z and non-ASCII characters."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an optimiser may not copy it into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_hashes(ws: Column, n: int) -> Column:
    """The hash of each n consecutive words, by start."""
    last = F.size(ws) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(ws, i, n)))).otherwise(
        F.array().cast("array<bigint>")
    )


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, h, gram, items): distinct windows with the items that have them, as structs of their id."""
    item = benchmark.select(col(item_col).alias("item_id"), words(col(text_col)).alias("ws"))
    item = item.filter(F.size("ws") > 0).withColumn("size", F.least(F.size("ws"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1)
    grams = item.select("item_id", "size", F.explode(F.transform(starts, lambda i: F.slice("ws", i, F.col("size")))).alias("gram"))
    return grams.groupBy("size", "gram").agg(F.collect_set(F.struct("item_id")).alias("items")).select("size", F.xxhash64("gram").alias("h"), "gram", "items")


def find_hits(documents: DataFrame, windows: DataFrame, limit: int | None = None) -> DataFrame:
    """(key, n_words, at, size, items) of documents (key, text): a row per verified occurrence, and one with null ``at`` per document.

    One pass: the word array is built once a document, its window hashes are generated and probed in the broadcast set inside one
    code-generated stage, and the join condition compares the words themselves.
    """
    windows = materialise(windows)
    held = 48 + F.octet_length(F.array_join("gram", " ")) + 16 * F.col("size") + 48 * F.size("items")
    size, sizes = windows.agg(F.coalesce(F.sum(held), F.lit(0)), F.sort_array(F.collect_set("size"))).first()  # at most n sizes
    parts = max(1, -(-size // (BROADCAST_BYTES if limit is None else limit)))
    if parts > 1:
        documents = materialise(documents)  # keys are made once
    docs = documents.select("key", words(F.col("text")).alias("ws0"))

    def placed(k: int):
        return lambda h, i: F.struct(F.lit(k).alias("k"), (i + 1).alias("at"), h.alias("hash"))

    def grams(ws: Column) -> Column:
        by_size = [F.transform(_window_hashes(ws, k), placed(k)) for k in sizes]
        head = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("at"), F.lit(None).cast("bigint").alias("hash")))
        return F.struct(ws.alias("ws"), F.concat(head, *by_size).alias("grams"))

    found = docs.select("key", _bound(F.col("ws0"), grams).alias("x"))
    found = found.select("key", F.col("x.ws").alias("ws"), F.inline("x.grams"))
    same = (F.col("hash") == F.col("h")) & (F.col("k") == F.col("size")) & (F.slice("ws", F.greatest(F.col("at"), F.lit(1)), F.col("k")) == F.col("gram"))
    out = None
    for part in range(parts):
        some = windows.filter(F.pmod("h", F.lit(parts)) == part) if parts > 1 else windows
        joined = found.join(F.broadcast(some), same, "left")
        joined = joined.filter(F.col("size").isNotNull() | (F.col("k") == 0)) if not part else joined.filter(F.col("size").isNotNull())
        hits = joined.select("key", F.when(F.col("k") == 0, F.size("ws")).cast("bigint").alias("n_words"), F.when(F.col("k") > 0, F.col("at")).alias("at"), "size", "items")
        out = hits if out is None else out.unionByName(hits)
    return out


def _gathered(hits: DataFrame, *more: Column) -> DataFrame:
    """(key, n_words, hit_words, items, ...) of each key."""
    runs = F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "size")))
    per = hits.groupBy("key").agg(F.max("n_words").alias("n_words"), runs.alias("runs"), F.collect_set("items").alias("items"), *more)
    hit_words = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + r["size"] - 1))))
    return per.withColumn("hit_words", F.array_sort(hit_words)).withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10, limit: int | None = None) -> DataFrame:
    """(doc_id, n_words, hit_words, items) of every row: sorted 1-based positions of hit words and sorted ids of found items."""
    rows = documents.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id")).alias("key"), "text")
    found = _gathered(find_hits(rows, benchmark_windows(benchmark, n), limit))
    return found.select("key.doc_id", "n_words", "hit_words", F.transform("items", lambda x: x["item_id"]).alias("items"))


def _text_key(text: Column) -> Column:
    """What tells texts apart: equal texts have equal hits."""
    data = text.cast("binary")
    return F.struct(F.xxhash64(data).alias("a"), F.crc32(data).alias("b"), F.octet_length(data).alias("c"))


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", limit: int | None = None) -> DataFrame:
    """Documents with every hit word taken out of the text, separators kept; other texts, null ones too, stay as they are.

    Hits belong to a text, not to an id: documents are joined with the distinct contaminated texts' keys. A document that is left without words is dropped.
    """
    text = col(text_col)
    keyed = documents.filter(text.isNotNull()).select(_text_key(text).alias("key"), text.alias("text"))
    dirty = _gathered(find_hits(keyed, benchmark_windows(benchmark, n), limit).filter("at IS NOT NULL"))
    dirty = dirty.select(F.col("key").alias("of"), F.col("hit_words").alias("gone"))
    joined = documents.alias("d").join(dirty.alias("x"), _text_key(col(text_col, "d")) == F.col("x.of"), "left")
    # Word and separator runs alternate, so a run's place gives its word number.
    body = col(text_col, "d")
    runs = F.regexp_extract_all(body, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    first_is_word = F.when(body.rlike(r"^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(0)).otherwise(F.lit(1))

    def cleaned(x: Column) -> Column:
        number = lambda i: F.shiftright(i - x["first"], 1) + 1
        return F.array_join(F.filter(x["runs"], lambda r, i: ((i - x["first"]) % 2 != 0) | ~F.array_contains(F.col("x.gone"), number(i))), "")

    new = F.when(F.col("x.of").isNotNull(), _bound(F.struct(runs.alias("runs"), first_is_word.alias("first")), cleaned)).otherwise(body)
    row = F.struct(*[(new if c == text_col else col(c, "d")).alias(c) for c in documents.columns])
    out = joined.select(row.alias("row"), F.col("x.of").isNotNull().alias("cut"))
    out = out.filter(~F.col("cut") | (F.size(words(col(text_col, "row"))) > 0))
    return out.select(*[col(c, "row").alias(c) for c in documents.columns])
