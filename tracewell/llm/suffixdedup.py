"""Removal of long byte strings that occur earlier in the corpus, by Burrows-Wheeler interval expansion.

Every window of ``least`` bytes is assigned to an anchor, the least k-gram in it, so equal windows meet at equal anchors.
A run of windows of one anchor is a context. Anchors are dealt by their hash; equal contexts are one class with its earliest
place as representative, all others are covered. Where an anchor has several different contexts, the representatives'
bytes are gathered, and the Burrows-Wheeler transform of their text is searched breadth first up to ``least``: windows
that stay in one interval are equal, and all but the earliest are covered.

Texts travel compressed, anchors and ranges as packed arrays, a row for each batch and bucket. Texts meet the ranges that concern them
by a bucket of their id. Equal contexts of a batch are merged before the shuffle, and an anchor with very many
different contexts is dealt again by single windows, so no key's rows pile up in a task.

Defined results: null and empty texts have no bytes and no spans; texts of any length are read whole; doc_id is read as a 64-bit integer; rows that repeat a
doc_id and its text are one document (an id's texts have to be equal); a null doc_id counts as the smallest; an empty table gives no rows; extra columns
are ignored by ``deduplicate`` and kept, of whatever name and kind, by ``cut_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from . import bwt
from .common import col, materialise, released

#: Bytes of an anchor: longer ones meet less by chance, shorter ones are fewer.
GRAM = 48
#: Text whose anchors are sought at once (longer texts in overlapping stretches), bytes of contexts sent at once, and bytes of one transform.
STRETCH, BLOCK, TRANSFORM = 1 << 19, 1 << 22, 1 << 20
#: An anchor with more different contexts than this is dealt by single windows.
MANY = 1024
#: Buckets of a partition; rows that a task gathers before it packs them by bucket, so packed rows are few for each pair of tasks.
BUCKETS, GATHERED = 2, 1 << 16
#: Bytes of input for each partition of a shuffle beyond spark.sql.shuffle.partitions.
PARTITION_BYTES = 64 << 20
LEAST_ID = -(1 << 63)

ANCHOR = np.dtype([("key", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("more", "<u2")])
RANGE = np.dtype([("doc", "<i8"), ("start", "<u4"), ("more", "<u2")])
WANTED = np.dtype([("doc", "<i8"), ("start", "<u4"), ("more", "<u2"), ("key", "<u8"), ("many", "<u1")])
HELD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("more", "<u2")])
COVERED, ANCHORS, CONTEXTS, TEXTS = 0, 1, 2, 3
ROW = "bucket int, kind int, doc bigint, id bigint, data binary"
NAMES = ["bucket", "kind", "doc", "id", "data"]


def squeeze(rows: np.ndarray, extra: bytes = b"") -> bytes:
    """A packed structured array, column after column, and bytes after it."""
    columns = b"".join(np.ascontiguousarray(rows[name]).tobytes() for name in rows.dtype.names)
    return len(rows).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(columns + extra)


def unsqueeze(data: bytes, kind: np.dtype) -> tuple[np.ndarray, bytes]:
    rows, raw, at = np.empty(int.from_bytes(data[:8], "little"), kind), zstandard.ZstdDecompressor().decompress(data[8:]), 0
    for name in kind.names:
        size = len(rows) * kind[name].itemsize
        rows[name] = np.frombuffer(raw[at : at + size], kind[name])
        at += size
    return rows, raw[at:]


def unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def spread(x: np.ndarray, buckets: int) -> np.ndarray:
    return (bwt._mix(x.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * 5
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "kind", "doc", "id", "data"])


def _dealt(rows: np.ndarray, to: np.ndarray, kind: int, lengths: np.ndarray | None = None, data: np.ndarray | None = None) -> list[tuple]:
    """A packed row for each bucket that gets some of the rows (with their stretches of ``data``)."""
    if not len(to):
        return []
    order = np.argsort(to, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) > 0]))
    found = []
    for lo, hi in zip(heads, [*heads[1:], len(to)], strict=True):
        mine, extra = order[lo:hi], b""
        if data is not None:
            ends = np.cumsum(lengths)
            size = lengths[mine]
            extra = data[np.repeat(ends[mine] - size - np.cumsum(size) + size, size) + np.arange(size.sum())].tobytes()
        found.append((int(to[mine[0]]), kind, None, None, squeeze(rows[mine], extra)))
    return found


def stretches(docs: list[bytes], ids: list[int], least: int):
    """Blocks of (text, id, place in its text): texts together up to STRETCH bytes, a longer one by itself in pieces that share ``least - 1`` bytes."""
    block, size = [], 0
    for doc, k in zip(docs, ids, strict=True):
        for at in range(0, max(1, len(doc) - least + 1), STRETCH):
            piece = doc[at : at + STRETCH + least - 1] if len(doc) > STRETCH else doc
            if block and size + len(piece) > STRETCH:
                yield block
                block, size = [], 0
            block.append((piece, k, at))
            size += len(piece)
            if len(doc) <= STRETCH:
                break
    if block:
        yield block


def contexts(docs: list[bytes], ids: np.ndarray, least: int, base: np.ndarray | int = 0) -> np.ndarray:
    """The contexts of a block of texts as ANCHOR rows. ``more``: windows of a context beside its first; ``base``: each text's place in its document."""
    data = np.frombuffer(b"".join(docs), np.uint8)
    if len(data) < least:
        return np.empty(0, ANCHOR)
    sizes = np.array([len(d) for d in docs])
    ends = np.cumsum(sizes)
    gram = min(GRAM, least)
    hashes, whole = bwt.gram_hashes(data, gram, least)
    place = bwt.anchors(hashes, least - gram + 1)
    start = np.arange(len(place))
    doc = np.repeat(np.arange(len(docs)), sizes)[: len(place)]
    inside = start + least <= ends[doc]
    start, place, doc = start[inside], place[inside], doc[inside]
    if not len(start):
        return np.empty(0, ANCHOR)
    first = np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(start) != 1)])
    lo = np.flatnonzero(first)
    hi = np.concatenate([lo[1:], [len(start)]]) - 1
    rows = np.empty(len(lo), ANCHOR)
    a, b = start[lo], start[hi]
    rows["key"], rows["more"], rows["doc"] = hashes[place[lo]], b - a, ids[doc[lo]]
    rows["context"] = bwt._mix(whole[a]) * np.uint64(3) + whole[b] + bwt._mix((b - a).astype(np.uint64))
    rows["start"] = a - (ends - sizes - base)[doc[lo]]
    return rows


def earliest(rows: np.ndarray, *by: str) -> tuple[np.ndarray, np.ndarray]:
    """(an order by the columns, then place; the number of the class of each row in that order)."""
    order = np.lexsort([rows["start"], rows["doc"], *(rows[c] for c in reversed(by))])
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in by:
        new[1:] |= rows[c][order[1:]] != rows[c][order[:-1]]
    return order, np.cumsum(new) - 1


def classes(rows: np.ndarray, *by: str) -> tuple[np.ndarray, np.ndarray]:
    """(representatives: the earliest of each class; the others that lie later), for rows equal in the columns."""
    if not len(rows):
        return rows, rows
    order, number = earliest(rows, *by)
    rows = rows[order]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(number) > 0]))
    head = rows[heads[number]]
    return rows[heads], rows[(rows["doc"] != head["doc"]) | (rows["start"] != head["start"])]


def _cover(rows: np.ndarray, to: int) -> list[tuple]:
    out = np.empty(len(rows), RANGE)
    for name in RANGE.names:
        out[name] = rows[name]
    out = out[np.argsort(out["doc"], kind="stable")]
    return _dealt(out, spread(out["doc"], to), COVERED)


def by_document(packed: list[np.ndarray], kind: np.dtype) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """All rows by document, and where each document's are."""
    rows = np.concatenate([np.empty(0, kind), *packed])
    rows = rows[np.argsort(rows["doc"], kind="stable")]
    names, first = np.unique(rows["doc"], return_index=True)
    return rows, dict(zip(names.tolist(), zip(first.tolist(), np.append(first, len(rows))[1:].tolist(), strict=True), strict=True))


def _by_bucket(batches):
    """(bucket, [(kind, doc, id, data)]) of rows sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if b != bucket and held:
                yield bucket, held
                held = []
            bucket = b
            held.append(row)
    if held:
        yield bucket, held


def windows_in_contexts(held: np.ndarray, data: np.ndarray, least: int) -> np.ndarray:
    """Of contexts and their bytes, the windows (as RANGE rows) that are equal to an earlier one, by the transform."""
    size = held["more"].astype(np.int64) + least
    starts = np.cumsum(size) - size
    text = np.zeros(int(size.sum()) + len(held), np.uint8)
    at = starts + np.arange(len(held))
    text[np.repeat(at, size) + np.arange(size.sum()) - np.repeat(starts, size)] = data
    windows = held["more"].astype(np.int64) + 1
    owner = np.repeat(np.arange(len(held)), windows)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    found = np.empty(len(owner), [("class", "<i8"), *RANGE.descr])
    found["doc"], found["start"], found["more"] = held["doc"][owner], held["start"][owner] + shift, 0
    order, number = bwt.repeat_classes(text, least)
    of = np.empty(len(text), np.int64)
    of[order] = number
    found["class"] = of[at[owner] + shift]
    return classes(found, "class")[1]


def ranges(documents: DataFrame, raw: DataFrame, least: int, to: int) -> DataFrame:
    """Rows of kind COVERED: starts of windows that occur earlier, packed by the bucket (of ``to``) of their document.

    ``documents``: rows of kind TEXTS; ``raw``: (doc, data) of the same, as they are.
    """
    parts = partitions(documents)
    buckets = BUCKETS * parts

    def find(batches):
        """Texts -> their contexts by key; those equal to an earlier one of the batch are covered at once."""
        for batch in batches:
            got = []
            for block in stretches(batch.column(1).to_pylist(), batch.column(0).to_pylist(), least):
                docs, ids, base = zip(*block, strict=True)
                got.append(contexts(list(docs), np.array(ids, np.int64), least, np.array(base)))
            firsts, later = classes(np.concatenate(got) if got else np.empty(0, ANCHOR), "key", "context")
            firsts = firsts[np.lexsort([firsts["start"], firsts["doc"]])]
            yield _rows(_dealt(firsts, spread(firsts["key"], buckets), ANCHORS) + [(b, k, d, i, x) for b, k, d, i, x in _cover(later, to)])

    def meet(batches):
        """Contexts of a bucket of keys: covered ones, and representatives where a key has several."""
        late, asked, size = [], [], 0
        for _, rows in _by_bucket(batches):
            got = [unsqueeze(x, ANCHOR)[0] for _, _, _, x in rows]
            firsts, later = classes(np.concatenate(got), "key", "context")
            n = len(firsts)
            new = np.concatenate([[True], firsts["key"][1:] != firsts["key"][:-1]])
            number = np.cumsum(new) - 1
            count = np.bincount(number)[number] if n else np.zeros(0, np.int64)
            wanted = np.empty(int((count > 1).sum()), WANTED)
            for name in ("doc", "start", "more", "key"):
                wanted[name] = firsts[name][count > 1]
            wanted["many"] = count[count > 1] > MANY
            late.append(later)
            asked.append(wanted)
            size += len(later) + len(wanted)
            if size >= GATHERED:
                yield told(late, asked)
                late, asked, size = [], [], 0
        if size:
            yield told(late, asked)

    def told(late, asked):
        wanted = np.concatenate(asked)
        return _rows(_cover(np.concatenate(late), to) + _dealt(wanted, spread(wanted["doc"], to), CONTEXTS))

    def cut(batches):
        """Texts and the contexts wanted of them, by the bucket of the document -> contexts with their bytes, by key."""
        pending, bucket, size = [], None, 0
        wanted, heads = np.empty(0, WANTED), {}

        def flush():
            held = np.concatenate([h for h, _ in pending])
            data = np.frombuffer(b"".join(d for _, d in pending), np.uint8)
            return _rows(_dealt(held, spread(held["key"], buckets), CONTEXTS, held["more"].astype(np.int64) + least, data))

        for batch in batches:
            for b, kind, doc, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if b != bucket:
                    bucket, parts_of, heads = b, [], None
                if kind == CONTEXTS:
                    parts_of.append(unsqueeze(data, WANTED)[0])
                    heads = None
                    continue
                if heads is None:
                    wanted, heads = by_document(parts_of, WANTED)
                if doc not in heads:
                    continue
                data = unzip(data)
                lo, hi = heads[doc]
                mine = wanted[lo:hi]
                mine = mine[mine["start"].astype(np.int64) + mine["more"] + least <= len(data)]
                held = np.empty(int((mine["many"] == 0).sum()), HELD)
                for name in HELD.names:
                    held[name] = mine[name][mine["many"] == 0]
                singles = mine[mine["many"] == 1]
                if len(singles):
                    n = singles["more"].astype(np.int64) + 1
                    one = np.empty(int(n.sum()), HELD)
                    one["doc"], one["more"] = doc, 0
                    one["start"] = np.repeat(singles["start"].astype(np.int64) - np.cumsum(n) + n, n) + np.arange(n.sum())
                    one["key"] = bwt._mix(bwt.gram_hashes(np.frombuffer(data, np.uint8), least)[0][one["start"]])
                    held = np.concatenate([held, one])
                if not len(held):
                    continue
                spans = zip(held["start"].tolist(), (held["start"].astype(np.int64) + held["more"] + least).tolist(), strict=True)
                pending.append((held, b"".join([data[s:e] for s, e in spans])))
                size += len(pending[-1][1])
                if size >= BLOCK:
                    yield flush()
                    pending, size = [], 0
        if pending:
            yield flush()

    def expand(batches):
        """Contexts of a bucket of keys -> covered windows."""
        late, many = [], 0
        for _, rows in _by_bucket(batches):
            parts_of = [unsqueeze(x, HELD) for _, _, _, x in rows]
            held, data = np.concatenate([h for h, _ in parts_of]), np.frombuffer(b"".join(d for _, d in parts_of), np.uint8)
            size = held["more"].astype(np.int64) + least
            starts = np.cumsum(size) - size
            order = np.argsort(held["key"], kind="stable")
            keys, sums = held["key"][order], np.cumsum(size[order])
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            lo = 0
            while lo < len(keys):
                base = sums[lo - 1] if lo else 0
                fit = ends[(ends > lo) & (sums[ends - 1] - base <= TRANSFORM)]
                hi = int(fit[-1]) if len(fit) else int(ends[ends > lo][0])
                mine = order[lo:hi]
                take = np.repeat(starts[mine] - np.cumsum(size[mine]) + size[mine], size[mine]) + np.arange(size[mine].sum())
                late.append(windows_in_contexts(held[mine], data[take], least))
                many += len(late[-1])
                if many >= GATHERED:
                    yield _rows(_cover(np.concatenate(late), to))
                    late, many = [], 0
                lo = hi
        if many:
            yield _rows(_cover(np.concatenate(late), to))

    found = raw.select("doc", "data").mapInArrow(lambda batches: released(find(batches)), ROW)
    found = materialise(found)
    met = materialise(by_bucket(found.filter(F.col("kind") == ANCHORS), parts).mapInArrow(lambda batches: released(meet(batches)), ROW))
    home = documents.select("bucket", F.lit(TEXTS).alias("kind"), "doc", F.lit(None).cast("bigint").alias("id"), "data")
    asked = met.filter(F.col("kind") == CONTEXTS).unionByName(home)
    held = asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda batches: released(cut(batches)), ROW)
    expanded = by_bucket(held, parts).mapInArrow(lambda batches: released(expand(batches)), ROW)
    is_cover = F.col("kind") == COVERED
    return found.filter(is_cover).unionByName(met.filter(is_cover)).unionByName(expanded)


def partitions(df: DataFrame) -> int:
    """Partitions of a shuffle: the session's number, or more if the input is large."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size // PARTITION_BYTES), 200_000)) if size < 1 << 60 else least


def by_bucket(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket")


def kept_bytes(data: bytes, found: np.ndarray, least: int) -> tuple[np.ndarray, int]:
    """(whether each byte is covered, number of covered runs), given RANGE rows of the document."""
    lo = np.minimum(found["start"].astype(np.int64), len(data))
    hi = np.minimum(lo + found["more"] + least, len(data))
    edge = np.bincount(lo, minlength=len(data) + 1) - np.bincount(hi, minlength=len(data) + 1)
    covered = np.cumsum(edge)[: len(data)] > 0
    return covered, int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())


def kept_text(data: bytes, covered: np.ndarray) -> str:
    """What is left as text: a character stays unless all its bytes are covered."""
    raw = np.frombuffer(data, np.uint8)
    heads = np.flatnonzero(raw & 0xC0 != 0x80)
    if not len(heads):
        return ""
    gone = np.minimum.reduceat(covered.astype(np.uint8), heads)
    size = np.diff(np.append(heads, len(raw)))
    return raw[heads[0] :][np.repeat(gone == 0, size)].tobytes().decode("utf-8", "replace")


def deduplicate(documents: DataFrame, least: int = 100, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text][, rest]) of every row (doc_id bigint, text).

    ``rest`` is a struct of the carried columns, by their numbers: c0, c1, ...
    """
    if not 1 <= least < 1 << 16:
        raise ValueError("strings of 1 to 65535 bytes can be sought")
    to = BUCKETS * partitions(documents)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST_ID))
    rest = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(None).cast("string")
    base = documents.select(doc.alias("doc"), F.col("doc_id").cast("bigint").alias("id"), data.alias("data"), rest.alias("rest"))

    def placed(batches):
        for batch in batches:
            bucket = spread(batch.column(0).to_numpy(), to).astype(np.int32)
            packer = zstandard.ZstdCompressor(level=1)
            data = pa.array([packer.compress(x) for x in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(len(bucket), TEXTS, np.int32)), *batch.columns[:2], data, batch.column(3)], [*NAMES, "rest"])

    kind = base.schema["rest"].dataType
    texts = base.mapInArrow(lambda batches: released(placed(batches)), StructType([*_parse_datatype_string(ROW).fields, StructField("rest", kind)]))
    covered = ranges(texts.drop("rest"), base, least, to).withColumn("rest", F.lit(None).cast(kind))

    def remove(batches):
        bucket, parts_of, rows, heads = None, [], np.empty(0, RANGE), None
        for batch in batches:
            out, at = [], []
            for i, (b, kind, doc, row_id, data) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                if b != bucket:
                    bucket, parts_of, heads = b, [], None
                if kind == COVERED:
                    parts_of.append(unsqueeze(data, RANGE)[0])
                    continue
                if heads is None:
                    rows, heads = by_document(parts_of, RANGE)
                lo, hi = heads.get(doc, (0, 0))
                data = unzip(data)
                gone, spans = kept_bytes(data, rows[lo:hi], least)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
                at.append(i)
                out.append((row_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept_text(data, gone)] if with_text else [])))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds)]  # noqa: B905
                yield pa.RecordBatch.from_arrays([*columns, batch.column(5).take(pa.array(at))], names_out)

    names_out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text, "rest"]
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * with_text
    schema = StructType([*_parse_datatype_string(schema).fields, StructField("rest", kind)])
    both = covered.unionByName(texts)
    done = both.repartition(partitions(documents), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(lambda batches: released(remove(batches)), schema)
    return done if carry else done.drop("rest")


def cut_repeats(documents: DataFrame, least: int = 100) -> DataFrame:
    """The documents, with all their columns, without the strings of ``least`` bytes that occur earlier; a document that only repeats others goes.

    A character stays unless all its bytes are repeated. Texts in which nothing repeats, null ones too, stay as they are.
    """
    found = deduplicate(documents, least, with_text=True, carry=tuple(documents.columns))
    found = found.filter((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    text = lambda own: F.when(F.col("n_removed") == 0, own).otherwise(F.col("kept_text"))
    return found.select(*[(text(F.col(f"rest.c{i}")) if c == "text" else F.col(f"rest.c{i}")).alias(c) for i, c in enumerate(documents.columns)])
