"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified Hamming distance.

Fingerprints that differ in at most ``max_bits`` of 64 bits agree on all but ``max_bits`` of any number of blocks, so every close pair shares the key made
of some of the blocks. More blocks make longer keys, and more of them: their number is chosen by the counted distinct fingerprints, so that few share a key by
chance at any size. Distinct fingerprints are dealt by those keys; within a key all pairs are compared
in numpy blocks and only a spanning forest of the links leaves the task.

Defined results: null, empty and wordless texts have fingerprint zero, which links like any other; texts of any length are read whole;
repeated texts fall into one class, by its smallest id; doc_id is read as a 64-bit integer, rows that share one have a row each, and a null one is
nobody's component while another id is there; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, released
from .components import connected_components, contract, roots

#: Distinct fingerprints that may share a key by chance, on average; blocks at most.
PER_KEY, MOST_BLOCKS = 64, 12
#: A key with more distinct fingerprints than this is compared in pairs of chunks of this size, by several tasks.
CHUNK = 4096
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16


def majority(text: str | None, shingle: int, digest, bits: int, distinct: bool) -> bytes:
    """The bits that are set in over half the digests of a text's shingles; no bit for a text without words."""
    buf = b" ".join((text or "").encode("utf-8", "replace").lower().split())
    if not buf:
        return bytes(bits // 8)
    gaps = np.flatnonzero(np.frombuffer(buf, np.uint8) == 0x20)
    n = len(gaps) + 1
    if n <= shingle:
        return digest(buf)
    starts = [0, *(gaps[: n - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(buf)]
    found, counts, total = set(), np.zeros(bits, np.int64), 0
    for lo in range(0, len(starts), AT_ONCE):
        mine = [digest(buf[s:e]) for s, e in zip(starts[lo : lo + AT_ONCE], ends[lo : lo + AT_ONCE], strict=True)]
        if distinct:
            mine = set(mine) - found
            found |= mine
        total += len(mine)
        counts += np.unpackbits(np.frombuffer(b"".join(mine), np.uint8)).reshape(-1, bits).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > total).tobytes()


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """The fingerprint of a text as an unsigned integer."""
    return int.from_bytes(majority(text, shingle, lambda x: xxhash.xxh64_digest(x, seed), 64, False), "big")


def fingerprints(documents: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda batches: released(run(batches)), "doc_id bigint, fp bigint")


def blocks_for(n: int, max_bits: int) -> int:
    """The number of blocks for n distinct fingerprints: the least whose keys few of them share by chance."""
    fits = (b for b in range(max_bits + 2, MOST_BLOCKS + 1) if n >> 64 * (b - max_bits) // b <= PER_KEY)
    return max(6 if max_bits == 4 else max_bits + 2, next(fits, MOST_BLOCKS))


def _keys(blocks: int, shared: int):
    """An array of the keys of column fp: the number of a choice of blocks, then the bits of those blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), shared)):
        key, at = F.lit(k << 48), 0
        for i in chosen:
            width = cuts[i + 1] - cuts[i]
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << width) - 1)), at))
            at += width
        keys.append(key)
    return F.array(*keys)


def forest(fps: np.ndarray, reps: np.ndarray, max_bits: int):
    """Links of a spanning forest of the fingerprints within max_bits, as pairs of reps."""
    n = len(fps)
    labels = np.arange(n, dtype=np.int64)
    step = max(1, (1 << 20) // n)
    for lo in range(0, n - 1, step):
        near = np.bitwise_count(fps[lo : lo + step, None] ^ fps[None, lo:]) <= max_bits
        a, b = np.nonzero(near)
        far = b > a
        if far.any():
            labels = roots(n, a[far] + lo, b[far] + lo, labels)
    out = np.flatnonzero(labels != np.arange(n))
    return reps[out], reps[labels[out]]


def links_in_groups(batches, max_bits: int):
    """Rows (g, fp, rep) sorted by g -> links (u, v). Groups are bounded by CHUNK, so a group fits in memory."""
    rest = [np.empty(0, np.int64)] * 3

    def links(cols, ends):
        found, lo = [], 0
        for hi in ends:
            if hi - lo > 1:
                found.append(forest(cols[1][lo:hi].view(np.uint64), cols[2][lo:hi], max_bits))
            lo = hi
        u, v = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        cols = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
        ends = np.flatnonzero(np.diff(cols[0])) + 1
        last = int(ends[-1]) if len(ends) else 0
        rest = [c[last:] for c in cols]
        if last:
            yield links([c[:last] for c in cols], ends.tolist())
    if len(rest[0]):
        yield links(rest, [len(rest[0])])


def met(keyed: DataFrame, names: tuple[str, ...], solve) -> DataFrame:
    """(u, v): what ``solve`` finds in the rows (g, *names) of each key, sorted by g.

    Rows are dealt by their key once. The rows of a key that more than CHUNK have are dealt again, to every pair of its chunks that has their own.
    """
    counted = keyed.withColumn("m", F.count("*").over(Window.partitionBy("key")))
    few = counted.filter(F.col("m").between(2, CHUNK)).select(F.col("key").alias("g"), *names).sortWithinPartitions("g")
    many = counted.filter(F.col("m") > CHUNK).withColumn("chunks", F.ceil(F.col("m") / CHUNK).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64(*names), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    many = many.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), *names).repartition("g").sortWithinPartitions("g")
    run = lambda batches: released(contract(solve(batches)))
    return few.mapInArrow(run, "u bigint, v bigint").unionByName(many.mapInArrow(run, "u bigint, v bigint"))


def close_links(classes: DataFrame, max_bits: int, blocks: int | None = None) -> DataFrame:
    """(u, v): links that join all fingerprints of ``classes`` (fp, rep) within max_bits into their components."""
    blocks = blocks or blocks_for(classes.count(), max_bits)
    keyed = classes.select("fp", "rep", F.explode(_keys(blocks, blocks - max_bits)).alias("key"))
    return met(keyed, ("fp", "rep"), lambda batches: links_in_groups(batches, max_bits))


def near_duplicates(documents: DataFrame, shingle: int = 5, max_bits: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): each document's fingerprint and the smallest id reachable by links."""
    if not 1 <= max_bits <= 8:
        raise ValueError("1 to 8 differing bits can be covered by blocks")
    prints = materialise(fingerprints(documents, shingle, seed))
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comps = connected_components(close_links(classes, max_bits), forest=True)
    placed = classes.join(comps, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(placed, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")


#: The wide fingerprints of ``similar_groups``: bits, bits of a block, the share of pairs at just the least similarity that have a common key.
WIDE_BITS, WIDE_BLOCK, WIDE_RECALL = 128, 4, 0.95
#: Standard deviations by which the differing bits of a pair at the least similarity may exceed their mean.
SPREAD = 3.0
#: Leaders of a component in a round of ``similar_groups`` and the characters of their texts at most; members compared by one task.
LEADERS, LEADERS_CHARS, MEMBERS = 512, 1 << 23, 2048


def differing(similarity: float) -> float:
    """The share of fingerprint bits that differ on average between two sets of such a Jaccard similarity: their angle over a half turn."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def most_differing(similarity: float) -> int:
    """The bits of a wide fingerprint in which a pair of that similarity differs at most, but for a few in a thousand."""
    p = differing(similarity)
    return int(WIDE_BITS * p + SPREAD * (WIDE_BITS * p * (1 - p)) ** 0.5)


def wide_key_shape(n: int, similarity: float) -> tuple[int, int]:
    """(blocks of a key, keys) for n distinct fingerprints: few share a key by chance, and WIDE_RECALL of the pairs of just that similarity share one.

    Differing bits are binomial; a pair that differs in d of them misses a key unless all d lie elsewhere. More similar pairs are missed less.
    """
    blocks = max(4, -(-max(0, (n // PER_KEY).bit_length()) // WIDE_BLOCK))
    p, bits = differing(similarity), WIDE_BLOCK * blocks
    shares = [(comb(WIDE_BITS, d) * p**d * (1 - p) ** (WIDE_BITS - d), comb(WIDE_BITS - bits, d) / comb(WIDE_BITS, d)) for d in range(most_differing(similarity) + 1)]
    keys = 1
    while sum(w * (1 - (1 - q) ** keys) for w, q in shares) < WIDE_RECALL:
        keys += 1 + keys // 16
    return blocks, keys


def wide_fingerprints(documents: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, a, b): 128 bits of fingerprint of the distinct shingles as two signed integers."""

    def run(batches):
        for batch in batches:
            raw = b"".join(majority(t, shingle, xxhash.xxh3_128_digest, WIDE_BITS, True) for t in batch.column(1).to_pylist())
            halves = np.frombuffer(raw, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1))], ["doc_id", "a", "b"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda batches: released(run(batches)), "doc_id bigint, a bigint, b bigint")


def _wide_keys(blocks: int, keys: int):
    """Keys of some blocks each, drawn once and for all; close fingerprints agree on some of them."""
    rng, found, half = np.random.default_rng(11), [], 64 // WIDE_BLOCK
    for k in range(keys):
        key = F.lit(k << 40)
        for j, block in enumerate(rng.permutation(2 * half)[:blocks].tolist()):
            part = F.shiftrightunsigned("a" if block < half else "b", WIDE_BLOCK * (block % half)).bitwiseAND(F.lit((1 << WIDE_BLOCK) - 1))
            key = key.bitwiseOR(F.shiftleft(part, WIDE_BLOCK * j))
        found.append(key)
    return F.array(*found)


def wide_links_in_groups(batches, max_bits: int):
    """Rows (g, a, b, rep) sorted by g -> links (u, v) of a spanning forest of each group."""
    rest = [np.empty(0, np.int64)] * 4

    def links(cols, ends):
        found, lo = [], 0
        for hi in ends:
            n = hi - lo
            if n > 1:
                a, b, reps = (c[lo:hi] for c in cols[1:])
                a, b, labels, step = a.view(np.uint64), b.view(np.uint64), np.arange(n, dtype=np.int64), max(1, (1 << 20) // n)
                for k in range(0, n - 1, step):
                    far = np.bitwise_count(a[k : k + step, None] ^ a[None, k:]) + np.bitwise_count(b[k : k + step, None] ^ b[None, k:])
                    i, j = np.nonzero(far <= max_bits)
                    i, j = i[j > i], j[j > i]
                    if len(i):
                        labels = roots(n, i + k, j + k, labels)
                out = np.flatnonzero(labels != np.arange(n))
                found.append((reps[out], reps[labels[out]]))
            lo = hi
        u, v = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        cols = [np.concatenate([r, batch.column(i).to_numpy()]) for i, r in enumerate(rest)]
        ends = np.flatnonzero(np.diff(cols[0])) + 1
        last = int(ends[-1]) if len(ends) else 0
        rest = [c[last:] for c in cols]
        if last:
            yield links([c[:last] for c in cols], ends.tolist())
    if len(rest[0]):
        yield links(rest, [len(rest[0])])


def shingles(text: str | None, size: int) -> set[int]:
    """Hashes of the distinct shingles of a text; of the whole of it if it has fewer words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    return {xxhash.xxh64_intdigest(b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))} if words else set()


def shingle_array(text: str | None, size: int) -> np.ndarray:
    """The shingles of a text as sorted numbers."""
    own = shingles(text, size)
    return np.sort(np.fromiter(own, np.uint64, len(own)))


class Leaders:
    """Texts by id of which none is similar to an earlier one, and the first of them that a text is similar to."""

    def __init__(self, similarity: float):
        self.similarity, self.ids, self.sizes, self.held, self.new = similarity, [], [], None, []

    def first(self, mine: np.ndarray) -> int | None:
        """The place of the first leader that is at least that similar, or None."""
        if self.new and (self.held is None or len(self.new) >= 32):
            self._index()
        both = np.zeros(len(self.ids), np.int64)
        if self.held is not None and len(mine):
            keys, owner = self.held
            lo, hi = np.searchsorted(keys, mine), np.searchsorted(keys, mine, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both += np.bincount(owner[at], minlength=len(both))
        for place, own in self.new:
            both[place] = len(np.intersect1d(mine, own, assume_unique=True))
        same = np.flatnonzero(both >= self.similarity * (len(mine) + np.array(self.sizes, np.int64) - both))
        return int(same[0]) if len(same) else None

    def add(self, doc_id: int, mine: np.ndarray):
        self.new.append((len(self.ids), mine))
        self.ids.append(doc_id)
        self.sizes.append(len(mine))

    def _index(self):
        keys, owner = np.concatenate([x for _, x in self.new]), np.repeat([p for p, _ in self.new], [len(x) for _, x in self.new])
        if self.held is not None:
            keys, owner = np.concatenate([self.held[0], keys]), np.concatenate([self.held[1], owner])
        order = np.argsort(keys, kind="stable")
        self.held, self.new = (keys[order], owner[order]), []


def led_in_groups(batches, shingle: int, similarity: float):
    """Rows (component, salt, member, doc_id, text) in order, a component's next leaders (member false) before its members.

    -> (doc_id, component, text, leader): of each member the first leader that it is similar to, itself if it leads; null, with its text, if it is left.
    """
    group, leaders = None, Leaders(similarity)
    for batch in batches:
        out = []
        for component, salt, member, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if (component, salt) != group:
                group, leaders = (component, salt), Leaders(similarity)
            mine = shingle_array(text, shingle)
            at = leaders.first(mine) if leaders.ids else None
            if member:
                out.append((doc_id, component, text if at is None else None, None if at is None else leaders.ids[at]))
            elif at is None:
                leaders.add(doc_id, mine)
        ids, components, texts, found = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(components, pa.int64()), pa.array(texts, pa.string()), pa.array(found, pa.int64())], ["doc_id", "component", "text", "leader"]
        )


def similar_groups(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, leader): documents to drop, each with an earlier document whose shingles are at least that similar (Jaccard).

    Candidates are components of wide fingerprints that differ in no more bits than pairs of that similarity do, but for a few in a thousand. Of members with equal shingles
    the first stands for all. The smallest ids of a component lead it, but for those that are similar to an earlier leader; members that aren't
    similar to a leader choose leaders among themselves again, until none is left. So no two kept members of a component are that similar, and
    every dropped document is verified against its leader. The work is the members of a component times its dissimilar ones.

    Null, empty and wordless texts are equal to one another. Rows that share a doc_id are dropped or kept together, those without one are kept. Texts of any length are
    compared whole; extra columns are ignored; an empty table gives no rows.
    """
    prints = materialise(wide_fingerprints(documents, shingle))
    classes = materialise(prints.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    keyed = classes.select("a", "b", "rep", F.explode(_wide_keys(*wide_key_shape(classes.count(), similarity))).alias("key"))
    max_bits = most_differing(similarity)
    comps = connected_components(met(keyed, ("a", "b", "rep"), lambda batches: wide_links_in_groups(batches, max_bits)), forest=True)
    # Only documents that share a component: linked classes, and classes of several documents.
    several = classes.join(comps, F.col("rep") == F.col("node"), "left").filter((F.col("n") > 1) | F.col("component").isNotNull())
    several = several.select(F.col("a").alias("x"), F.col("b").alias("y"), F.coalesce("component", "rep").alias("component"))
    members = prints.join(several, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select(F.col("doc_id").alias("id"), "component")
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def digests(batches):
        for batch in batches:
            found = [xxhash.xxh3_128_digest(shingle_array(t, shingle).tobytes()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], ["doc_id", "component", "text", "digest"])

    known = texts.join(members, F.col("doc_id") == F.col("id")).select("doc_id", "component", "text").mapInArrow(lambda batches: released(digests(batches)), "doc_id bigint, component bigint, text string, digest binary")
    known = materialise(known)
    reps = materialise(known.groupBy("component", "digest").agg(F.min("doc_id").alias("rep")).select(F.col("component").alias("rc"), F.col("digest").alias("rd"), "rep"))
    mine = (F.col("component") == F.col("rc")) & (F.col("digest") == F.col("rd"))
    copies = known.select("doc_id", "component", "digest").join(reps, mine).filter("doc_id <> rep").select("doc_id", "rep")
    # The rows of a document that repeats itself count once.
    left = known.join(reps, mine & (F.col("doc_id") == F.col("rep"))).select("doc_id", "component", "text", "digest").dropDuplicates(["doc_id", "component", "digest"]).drop("digest")
    dropped = None
    while True:
        sizes = left.groupBy("component").agg(F.count("*").alias("m")).filter("m > 1")
        chunks = sizes.select(F.col("component").alias("c"), F.ceil(F.col("m") / MEMBERS).cast("int").alias("chunks"))
        open_ = left.join(chunks, F.col("component") == F.col("c"))
        salt = F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")
        order = Window.partitionBy("component").orderBy("doc_id")
        # The first of each chunk, then the first of these: no task sorts a whole component.
        first = Window.partitionBy("component", "salt").orderBy("doc_id")
        lead = open_.withColumn("salt", salt).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= LEADERS)
        lead = lead.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LEADERS)
        lead = lead.withColumn("chars", F.sum(F.length(F.coalesce("text", F.lit("")))).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("place") == 1) | (F.col("chars") <= LEADERS_CHARS))
        lead = lead.select("component", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("salt"), F.lit(False).alias("member"), "doc_id", "text")
        rows = lead.unionByName(open_.select("component", salt.alias("salt"), F.lit(True).alias("member"), "doc_id", "text"))
        rows = rows.repartition("component", "salt").sortWithinPartitions("component", "salt", "member", "doc_id")
        judged = materialise(rows.mapInArrow(lambda batches: released(led_in_groups(batches, shingle, similarity)), "doc_id bigint, component bigint, text string, leader bigint"))
        found = judged.filter("leader < doc_id").select("doc_id", "leader")
        dropped = found if dropped is None else dropped.unionByName(found)
        left = judged.filter("leader IS NULL").select("doc_id", "component", "text")
        if left.isEmpty():
            break
    led = dropped.select(F.col("doc_id").alias("d"), "leader")
    return dropped.unionByName(copies.join(led, F.col("rep") == F.col("d"), "left").select("doc_id", F.coalesce("leader", "rep").alias("leader")))
