"""Token-id output packed into rows of fixed length by best-fit decreasing.

Texts are encoded by a public rank file (tiktoken). A document longer than a row is split
without loss into pieces of at most `length` ids. Pieces are dealt by a hash to shards of about
`shard_bytes` bytes of text, so that a shard fits in one task's memory whatever the sources or
copies are. In a shard the pieces are taken by decreasing length, and each goes to the open row
with the least room that holds it; a segment tree over the rooms finds that row in O(log length).
An output row has its ids (little-endian uint16 or uint32, padded to the full length), the
cumulative segment lengths, the places where positions start again at 0, and for each segment
the document, the piece's number and its offset in the document.

Defined cases: null or empty texts have no ids and no segment (all other ids come back exactly,
see `unpack`); ties in length go by doc_id, text hash and piece number; repeated rows are packed
as often as they are given; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.bpe import PUBLIC, read_ranks
from loomwright.llm.common import arrow_map, slices

LENGTH, SHARD_BYTES = 2048, 4_000_000

PIECE = "doc_id long, text_key long, piece int, n int, start int, ids binary"
ROW = "shard long, row int, n_tokens int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, pieces array<int>, offsets array<int>"


class Rooms:
    """Open rows by room (0..length): a segment tree over the rooms that have rows."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least `need`, with its room."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        while at:
            self.tree[at] -= 1
            at >>= 1
        return row, room


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; sizes must fall from piece to piece and be at most length."""
    rooms, out = Rooms(length), []
    for k, n in enumerate(sizes):
        got = rooms.take(n)
        row, room = got if got else (len(out), length)
        if got is None:
            out.append([])
        out[row].append(k)
        if room > n:
            rooms.put(room - n, row)
    return out


SHARDS_A_PART = 32
_ENCODINGS: dict = {}


def encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    key = (len(ranks), max(ranks.values()), pattern)
    if key not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def _pieces(ranks, pattern, length, dtype):
    def run(batches):
        names = ["doc_id", "text_key", "piece", "n", "start", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        enc = encoding(ranks.value, pattern)
        for b in slices(batches):
            rows = []
            for i, k, t in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("text").to_pylist()):
                ids = np.array(enc.encode_ordinary(t or ""), dtype)
                for p, s in enumerate(range(0, len(ids), length)):
                    cut = ids[s : s + length]
                    rows.append((i, k, p, len(cut), s, cut.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def _pack(length, dtype, pad):
    def run(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        least = -(1 << 63)
        order = sorted(range(len(t["n"])), key=lambda r: (-t["n"][r], least if t["doc_id"][r] is None else t["doc_id"][r], t["text_key"][r], t["piece"][r]))
        packed = best_fit([t["n"][r] for r in order], length)
        out: dict[str, list] = {c: [] for c in ("shard", "row", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "pieces", "offsets")}
        for k, row in enumerate(packed):
            at = [order[r] for r in row]
            cu = np.cumsum([0] + [t["n"][r] for r in at]).tolist()
            fill = np.full(length - cu[-1], pad, dtype).tobytes()
            for c, v in zip(out, (t["shard"][0], k, cu[-1], b"".join([t["ids"][r] for r in at]) + fill, cu, cu[:-1], [t["doc_id"][r] for r in at], [t["piece"][r] for r in at], [t["start"][r] for r in at])):
                out[c].append(v)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), ints, ints, longs, ints, ints)
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})

    return run


def pack(docs: DataFrame, path: str, pattern: str = PUBLIC, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Packed rows (see ROW) of all documents."""
    ranks = read_ranks(path)
    top = max(ranks.values())
    dtype, pad = ("<u2", top + 1) if top + 1 < 1 << 16 else ("<u4", top + 1)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: its size does not follow the data
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    pieces = arrow_map(keyed, _pieces(shared, pattern, length, dtype), PIECE)
    # copies share doc_id and text_key only if they are equal rows; the piece number salts long documents
    shard = F.pmod(F.xxhash64("doc_id", "text_key", "piece"), F.lit(shards))
    # a partition takes SHARDS_A_PART shards, however many there are in all
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-shards // SHARDS_A_PART), min(shards, 2 * cores))
    return pieces.withColumn("shard", shard).repartition(parts, "shard").groupBy("shard").applyInArrow(_pack(length, dtype, pad), ROW)


def _unpack(dtype):
    def run(batches):
        for b in batches:
            rows = []
            for raw, cu, docs, pieces, offsets in zip(*(b.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "pieces", "offsets"))):
                ids = np.frombuffer(raw, dtype)
                rows += [(d, p, o, ids[s:e].tolist()) for d, p, o, s, e in zip(docs, pieces, offsets, cu, cu[1:])]
            if rows:
                d, p, o, i = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(o, pa.int32()), pa.array(i, pa.list_(pa.int32()))], names=["doc_id", "piece", "start", "ids"])

    return run


def unpack(packed: DataFrame, dtype: str = "<u2") -> DataFrame:
    """The pieces of packed rows: doc_id, piece, start, ids."""
    return arrow_map(packed.select("ids", "cu_seqlens", "doc_ids", "pieces", "offsets"), _unpack(dtype), "doc_id long, piece int, start int, ids array<int>")
