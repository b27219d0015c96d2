"""Token counts, pieces and best-fit packing into sequences by minimum bin slack.

Texts are tokenised a block at a time: the splitting rule of byte-level BPE is applied to all code points at
once, and each distinct piece of text is encoded once by the tokeniser and kept. Lengths are
counted in a histogram; per bin, a bitset subset-sum over the available lengths finds the fullest
combination with the largest length left, and the combination is taken as often as the counts allow,
so the number of combinations depends on the capacity and not on the input. Pieces then look their
place up by their rank among the pieces of their length.

Defined results: null and empty texts are the end-of-text id alone; repeated rows are packed each;
an empty table gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, materialise, released, stored

#: Code points encoded at once (or one longer text), and rows of a batch taken as strings at once: what a worker holds beside the batch.
BLOCK, ROWS = 1 << 21, 2048
#: Distinct pieces of text whose ids a worker keeps; beyond it those that most blocks held stay.
KEPT = 500_000
#: White space of the splitting rule outside ASCII, and what may follow an apostrophe.
SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, OTHER, SPACE, BREAK = 1, 2, 3, 4, 5


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    found = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            found[c] = LETTER if kind == "L" else NUMBER
    found[[*range(9, 14), 32, *SPACES]] = SPACE
    return found


def pieces_of_text(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces that the splitting rule makes of the texts, and how many each text has."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[stops] = BREAK
    n = len(points)
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    runs = np.concatenate([[0], change])
    ends = np.concatenate([change, [n]])
    # Neighbouring breaks are one run; each break is cut off by itself below.
    of = kind[runs]
    begins = np.zeros(n + 1, bool)
    solid = runs[(of != SPACE) & (of != BREAK)]
    joins = (solid > 0) & (kind[solid - 1] == SPACE) & (points[solid - 1] == 32)
    begins[solid - joins] = True
    space = of == SPACE
    a, b = runs[space], ends[space]
    begins[a] = True
    begins[b[kind[np.minimum(b, n - 1)] != BREAK] - 1] = True
    begins[stops] = begins[stops + 1] = True
    # Contractions: an apostrophe at the start of a piece, then one of the endings.
    mark = solid[~joins]
    mark = mark[points[mark] == 39]
    for ending in CONTRACTIONS:
        hit = mark[mark + len(ending) < n]
        for k, c in enumerate(ending):
            hit = hit[points[hit + 1 + k] == ord(c)]
        begins[hit + 1] = False
        begins[hit + 1 + len(ending)] = True
    begins[n] = True
    at = np.flatnonzero(begins)
    width = np.ones(n, np.uint8)
    for last in (0x7F, 0x7FF, 0xFFFF):
        width += points > last
    byte = np.concatenate([[0], np.cumsum(np.add.reduceat(width, at[:-1], dtype=np.int64))])
    data = pa.py_buffer(joined.encode())
    array = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(byte.astype(np.int64).tobytes()), data])
    first = np.searchsorted(at, stops)  # the break's own place among the pieces
    keep = np.ones(len(at) - 1, bool)
    keep[first] = False
    counts = np.diff(np.concatenate([[-1], first])) - 1
    return array.filter(pa.array(keep)), counts


class Encoder:
    """Ids of texts by a tokeniser file; ids of the distinct pieces are kept, up to ``KEPT``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.number: dict[str, int] = {}
        self.sizes, self.ids, self.met = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def _places(self, found: np.ndarray) -> np.ndarray:
        """Where the ids of the numbered pieces are, one after another."""
        size = self.sizes[found]
        ends = np.cumsum(size)
        return np.repeat((np.cumsum(self.sizes) - self.sizes)[found] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)

    def _forget(self) -> None:
        """Keep the pieces that most blocks held, at most half of the store and none that only one block held."""
        keep = np.argsort(-self.met, kind="stable")[: KEPT // 2]
        keep = np.sort(keep[self.met[keep] > 1])
        names = list(self.number)
        self.number = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.ids, self.sizes, self.met = self.ids[self._places(keep)], self.sizes[keep], self.met[keep] // 2

    def _learn(self, new: list[str]) -> np.ndarray:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        at = np.arange(len(self.number), len(self.number) + len(new))
        self.number.update(zip(new, at.tolist(), strict=True))
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, got), np.int64, len(got))])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32)])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        return at

    def _numbers(self, names: list[str]) -> np.ndarray:
        """The numbers of different pieces, new ones encoded."""
        look = lambda: np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        at = look()
        if len(self.number) + np.count_nonzero(at < 0) > KEPT:
            self._forget()
            at = look()
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn([names[k] for k in new.tolist()])
        self.met[at] += 1
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, little-endian unsigned 32-bit.

        A text that holds an added token's string is encoded whole: it isn't split by the rule there.
        """
        if self.added and any(whole := [bool(self.added.search(t)) for t in texts]):
            rest = iter(self.encode([t for t, w in zip(texts, whole, strict=True) if not w]))
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") if w else next(rest) for t, w in zip(texts, whole, strict=True)]
        if not texts:
            return []
        pieces, counts = pieces_of_text(texts)
        coded = pieces.dictionary_encode()
        number = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ends = np.cumsum(self.sizes[number])
        ids = self.ids[self._places(number)]
        cuts = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.split(ids.astype("<u4", copy=False), cuts[:-1]) if len(cuts) else []


@stored
@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker, with what it has learnt in earlier tasks."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, and what is left over before them."""
    rest = n % capacity if n > capacity else n
    head = [(0, rest)] if rest else []
    return head + [(s, capacity) for s in range(rest, n, capacity)]


def tokenise(documents: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank[, ids]): the pieces of every document.

    ``part`` and ``rank`` number the pieces of one length within a task. Written to the shared folder, so both stay.
    """

    def run(batches):
        encoder, part, met = encoder_of(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for k, block in blocks(texts, BLOCK):
                out = []
                for ids in encoder.encode(block):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for j, (start, length) in enumerate(cut(len(ids), capacity)):
                        mine = ids[start : start + length]
                        out.append((doc_ids[k], j, start, length, zlib.crc32(mine.tobytes()), part, int(met[length]), *([mine.astype(np.int32)] if with_ids else [])))
                        met[length] += 1
                    k += 1
                columns = list(zip(*out, strict=True))
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names[: len(columns)])  # noqa: B905

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint" + ", ids array<int>" * with_ids
    return materialise(documents.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches), encoder_of), schema))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``, by bitset subset-sum."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            take = min(size, left)
            grown = (reach | reach << length * take) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    target, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            found[length] = found.get(length, 0) + take
            target -= length * take
    return found


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, lengths and copies in each) that use up the histogram, the fullest bin with the largest length first."""
    counts, found = {x: n for x, n in histogram.items() if n}, []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        combo = fullest(counts, capacity - largest)
        counts[largest] += 1
        combo[largest] = combo.get(largest, 0) + 1
        times = min(counts[x] // c for x, c in combo.items())
        for x, c in combo.items():
            counts[x] -= c * times
            if not counts[x]:
                del counts[x]
        found.append((times, combo))
    return found


def _plan(found: list[tuple[int, dict[int, int]]], capacity: int) -> np.ndarray:
    """Rows (length and first rank as one number, copies in a bin, first bin, first offset), sorted."""
    used, rows, base = [0] * (capacity + 1), [], 0
    for times, combo in found:
        offset = 0
        for length in sorted(combo, reverse=True):
            rows.append((length << 48 | used[length], combo[length], base, offset))
            used[length] += combo[length] * times
            offset += combo[length] * length
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pieces with sequence_id and offset: as few sequences of at most ``capacity`` as minimum bin slack finds.

    Full pieces are sequences of their own, with negative numbers. Only the histogram (one row a length) comes to the
    driver and only the combinations (their number is bounded by the capacity) go out; ranks across tasks are sums over
    (task, length) counts, joined back by that key.
    """
    partial = pieces.filter(F.col("length") < capacity)
    counts = partial.groupBy("part", "length").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan = _plan(combinations(histogram, capacity), capacity)
    ranked = partial.join(offsets, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("rank") + F.col("ahead"))
    names = [c for c in pieces.columns if c not in ("part", "rank")]
    at = names.index("length")

    def place(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            length, rank = batch.column(at).to_numpy(), batch.column(len(names)).to_numpy()
            row = plan[np.searchsorted(plan[:, 0], length << 48 | rank, side="right") - 1]
            nth = rank - (row[:, 0] & (1 << 48) - 1)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + nth // row[:, 1]), pa.array(row[:, 3] + nth % row[:, 1] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names) + ", sequence_id bigint, offset bigint"
    placed = ranked.select(*names, "rank").mapInArrow(place, schema)
    whole = pieces.filter(F.col("length") == capacity).select(
        *names, (-1 - F.shiftleft(F.col("part").cast("bigint"), 40) - F.col("rank")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return placed.unionByName(whole)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; one row a piece."""
    return pack(tokenise(documents, tokenizer_path, capacity, end_id, with_ids), capacity)
