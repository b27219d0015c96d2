"""Identities of content: what everything in the graph is keyed by."""

from __future__ import annotations

import base64
import json
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the BLAKE3 hash function, and of the content id's prefix: version 1, raw codec, BLAKE3, 32 bytes.
BLAKE3_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
BLAKE3_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CID_PREFIX = b"\x01\x55\x1e\x20"
_MASK = 0xFFFFFFFF


def _compress(chain, words, counter, size, flags):
    v = [*chain, *BLAKE3_IV[:4], counter & _MASK, counter >> 32, size, flags]
    m = list(words)
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))):
            for x, r, s in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + x) & _MASK
                y = v[d] ^ v[a]
                v[d] = (y >> r | y << 32 - r) & _MASK
                v[c] = (v[c] + v[d]) & _MASK
                y = v[b] ^ v[c]
                v[b] = (y >> s | y << 32 - s) & _MASK
        if turn < 6:
            m = [m[i] for i in BLAKE3_ORDER]
    return [x ^ y for x, y in zip(v[:8], v[8:], strict=True)]


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 hash."""
    chunks = [data[i : i + 1024] for i in range(0, len(data), 1024)] or [b""]

    def leaf(k, root):
        chain, chunk = BLAKE3_IV, chunks[k]
        pieces = [chunk[i : i + 64] for i in range(0, len(chunk), 64)] or [b""]
        for j, piece in enumerate(pieces):
            flags = CHUNK_START * (j == 0) | (CHUNK_END | ROOT * root) * (j == len(pieces) - 1)
            chain = _compress(chain, struct.unpack("<16I", piece.ljust(64, b"\0")), k, len(piece), flags)
        return chain

    def tree(lo, hi, root=False):
        if hi - lo == 1:
            return leaf(lo, root)
        half = 1 << (hi - lo - 1).bit_length() - 1
        return _compress(BLAKE3_IV, [*tree(lo, lo + half), *tree(lo + half, hi)], 0, 64, PARENT | ROOT * root)

    return struct.pack("<8I", *tree(0, len(chunks), True))


def content_id_of(data: bytes) -> str:
    """CIDv1 of raw bytes in lower-case base32."""
    return "b" + base64.b32encode(CID_PREFIX + blake3(data)).decode().lower().rstrip("=")


def _mapped(f, value: Column | str) -> Column:
    """A string function over Arrow batches; made when it is used, as a session must exist."""
    import pandas as pd

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else f(v))

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(F.col(value) if isinstance(value, str) else value)


def content_id(data: Column | str) -> Column:
    """The content id of a binary column, for interchange; joins inside the engine use digest()."""
    return _mapped(lambda x: content_id_of(bytes(x)), data)


def canonical_json_of(value: str) -> str:
    return json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(value: Column | str) -> Column:
    """JSON with sorted keys and no white space."""
    return _mapped(canonical_json_of, value)


def digest(value: Column | str) -> Column:
    """The engine's own content key: SHA-256 in hex."""
    return F.sha2(F.col(value) if isinstance(value, str) else value, 256)


def sorted_map_json(m: Column | str) -> Column:
    """A flat map as JSON with sorted keys."""
    m = F.col(m) if isinstance(m, str) else m
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def withheld_descriptor(cid: Column | str, withheld: bool = True) -> Column:
    """What is hashed for content that may not be stored: the true id is in it, the path isn't."""
    cid = F.col(cid) if isinstance(cid, str) else cid
    return F.concat(F.lit('{"content-cid":"'), cid, F.lit(f'","withheld":{str(withheld).lower()}}}'))


def actor_descriptor(kind: Column | str, name: Column | str) -> Column:
    """{"kind","name"} through a serialiser, never by concatenation."""
    kind, name = (F.col(x) if isinstance(x, str) else x for x in (kind, name))
    return F.to_json(F.struct(kind.alias("kind"), name.alias("name")))


def collection_id(members: Column | str) -> Column:
    """Of an array of (ordinal, cid), sorted."""
    members = F.col(members) if isinstance(members, str) else members
    return F.sha2(F.array_join(F.transform(F.array_sort(members), lambda m: F.concat_ws(":", m["ordinal"], m["cid"])), ","), 256)
