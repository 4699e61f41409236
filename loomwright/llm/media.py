"""Media columns with signature sniffing.

A payload is stored losslessly as 8-bit samples (RIFF/WAVE, one channel) under a declared type
that need not be true. An Aho-Corasick automaton over the magic bytes of all known formats
locates signatures in the stored bytes; a validator of the format confirms structure and length
at each place; the format that is confirmed at the start corrects the declared type, and formats
that are confirmed further inside are carved as embedded media (offset, length, type; nested
hits inside a carved piece are left to that piece). The samples are then read back from the
stored bytes and features computed from them.

Defined cases: a very long text is one payload of its own length, and searches for a format's end
go forward once; ties (signatures at one place) cannot be, as no magic begins another; null text
is empty: its payload is 576 bytes 255; nothing confirmed at the start:
application/octet-stream; truncated or damaged structures are not confirmed; repeated rows get
equal values; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwright.llm.common import arrow_map, slices

UNIT, RATE, TAIL = 576, 8000, 32
DECLARED = ("audio/wav", "image/png", "application/pdf", "image/gif")


class Bytes(bytes):
    """Stored bytes; `later` finds a pattern at or after growing places and reads each byte once."""

    def later(self, pattern: bytes, at: int) -> int:
        known = self.__dict__.setdefault("known", {})
        if pattern not in known or 0 <= known[pattern] < at:
            known[pattern] = self.find(pattern, at)
        return known[pattern]


def _wav(b: bytes, at: int) -> int:
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 44:
        return 0
    size = 8 + struct.unpack_from("<I", b, at + 4)[0]
    end, p, data, fmt = at + size, at + 12, False, False
    if end > len(b):
        return 0
    while p + 8 <= end:
        n = struct.unpack_from("<I", b, p + 4)[0]
        fmt |= b[p : p + 4] == b"fmt " and n >= 16
        data |= b[p : p + 4] == b"data"
        p += 8 + n + (n & 1)
    return size if fmt and data and p in (end, end + 1) else 0


def _png(b: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if b[at + 3 : at + 6] not in (b"87a", b"89a") or len(b) < at + 14:
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x2C and p + 10 < len(b):
            p += 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 128 else 0) + 1
        elif b[p] == 0x21:
            p += 2
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2 or not 0xC0 <= kind <= 0xFE:
            return 0
        p += 2 + n
        if kind == 0xDA:
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if p < 0:
                return 0
    return 0


def _pdf(b: bytes, at: int) -> int:
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return 0
    end, table = b.later(b"%%EOF", at), b.later(b"startxref", at)
    return end + 5 - at if 0 <= table < end else 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    size, zero, start, head = struct.unpack_from("<IIII", b, at + 2)
    return size if not zero and head in (40, 108, 124) and 14 + head <= start <= size <= len(b) - at else 0


def _gzip(b: bytes, at: int) -> int:
    d, p, view = zlib.decompressobj(31), at, memoryview(b)
    try:
        while not d.eof and (p < len(b) or d.unconsumed_tail):  # 64 kB of output at a time, which is dropped
            part = d.unconsumed_tail or view[p : p + 65536]
            p += 0 if d.unconsumed_tail else len(part)
            d.decompress(part, 65536)
    except zlib.error:
        return 0
    return p - at - len(d.unused_data) if d.eof else 0


def _zip(b: bytes, at: int) -> int:
    end = b.later(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start = struct.unpack_from("<II", b, end + 12)
    return end + 22 + struct.unpack_from("<H", b, end + 20)[0] - at if at + start + size == end and b[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") else 0


# magic bytes, media type, validator (the confirmed length, or 0)
FORMATS = (
    (b"RIFF", "audio/wav", _wav), (b"\x89PNG\r\n\x1a\n", "image/png", _png), (b"GIF8", "image/gif", _gif), (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf), (b"BM", "image/bmp", _bmp), (b"\x1f\x8b\x08", "application/gzip", _gzip), (b"PK\x03\x04", "application/zip", _zip),
)


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


def sniff(raw: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of each confirmed format; pieces inside another piece are left out,
    except that the piece that begins at 0 is searched inside."""
    found, end, raw = [], 0, Bytes(raw)
    for last, k in _automaton().iter(raw.decode("latin-1")):
        magic, kind, check = FORMATS[k]
        at = last + 1 - len(magic)
        if at >= end and (n := check(raw, at)):
            found.append((at, n, kind))
            end = at + n if at else 0
    return found


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) & 1)


def read_back(media: bytes) -> bytes:
    p = 12
    while media[p : p + 4] != b"data":
        n = struct.unpack_from("<I", media, p + 4)[0]
        p += 8 + n + (n & 1)
    return media[p + 8 : p + 8 + struct.unpack_from("<I", media, p + 4)[0]]


def describe(media: bytes, declared: str) -> tuple[str, list[tuple[int, int, str]], bytes, str]:
    """(true type, carved pieces, samples read back, feature text)."""
    found = sniff(media)
    true = found[0][2] if found and found[0][0] == 0 else "application/octet-stream"
    carved = [f for f in found if f[0]]
    samples = read_back(media) if true == "audio/wav" else media
    a = np.frombuffer(samples, np.uint8)
    n = np.bincount(a, minlength=256)
    p = n[n > 0] / len(a)
    turns = int(np.count_nonzero((a[1:] >= 128) != (a[:-1] >= 128)))
    kinds = "+".join(f"{k}@{s}:{e}" for s, e, k in carved) or "none"
    feature = f"{declared}>{true};carved={kinds};mean={a.mean():.6f};entropy={max(0.0, float(-(p * np.log2(p)).sum())):.6f};turns={turns};peak={int(a.max())}"
    return true, carved, samples, feature


def declared_type(payload: bytes) -> str:
    """The type that the column declares for a payload; it may be wrong, as in real columns."""
    return DECLARED[zlib.crc32(payload) % len(DECLARED)]


def _digests(batches):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in slices(batches):
        rows = []
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            payload = payload_of(t)
            media = store(payload)
            _, _, back, feature = describe(media, declared_type(payload))
            rows.append((i, len((t or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _columns(batches):
    kinds = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
    for b in slices(batches):
        media = [store(payload_of(t)) for t in b.column("text").to_pylist()]
        said = [declared_type(read_back(m)) for m in media]
        got = [describe(m, d) for m, d in zip(media, said)]
        carved = [[{"offset": s, "length": n, "type": k} for s, n, k in g[1]] for g in got]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary()), pa.array(said), pa.array([g[0] for g in got]), pa.array(carved, kinds)], names=["doc_id", "media", "declared_type", "media_type", "carved"])


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, media (binary), declared_type, media_type (corrected), carved."""
    return arrow_map(docs.select("doc_id", "text"), _columns, "doc_id long, media binary, declared_type string, media_type string, carved array<struct<offset: long, length: long, type: string>>")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return arrow_map(docs.select("doc_id", "text"), _digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
