"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Texts are cut by the public pattern; pieces that a task has not seen yet go to DuckDB in
batches. There the state is a table of token positions; each step of a recursive query joins the
neighbouring tokens with the merge table and contracts, in every piece, the leftmost pair of
least rank, until no pair is left. An aggregation in order gives the ids of a piece, another
decodes ids to bytes. The merge table has every split of every token into two tokens, so a pair
merges exactly if its bytes are a token, as the tiktoken library does it. It is made once on
the driver and travels as two arrays.

A step for each contraction would be quadratic in a piece of many kilobytes, so pieces over
`STEPPED` bytes take a second recursive query (`RUNS`). Its step contracts, from the left, all
occurrences of a piece's least pair up to the first whose contraction makes a pair of lower
rank: until then the leftmost pair of least rank is always the next of them, so the order is
that of single contractions. It keeps only the newest state of each position.

Defined cases: null text is the empty text (no tokens, hashes of nothing); a very long text is
cut into pieces like any other and one huge piece is a table of its positions in one task; ties
of rank go to the leftmost pair; equal rows give equal rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwright.llm.common import arrow_map, slices

STEPPED = 400
TEXT_BYTES = 1_000_000  # of texts that are cut into pieces at a time
CACHE = 150_000  # pieces in each of the two generations of the cache
BATCH_BYTES = 100_000  # of pieces in one recursive query, which holds every step of them
# \\s as the pattern's own library reads it: Unicode White_Space
_S = r"\t-\r \x85\xa0  -     　"
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"  # letters, numbers below U+0250
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\t-\r \x85\xa0{_L}{_N}]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")
_HIGH = re.compile("[ɐ-\U0010ffff]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """pair (left id << 17 | right id) and m, the id of both together: every split of every token."""
    rows = [(ranks[t[:i]] << 17 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return pa.table({"pair": pa.array([p for p, _ in rows], pa.int64()), "m": pa.array([m for _, m in rows], pa.int32())})


def _batched(raws: list[bytes]):
    """The pieces in runs of about BATCH_BYTES."""
    batch, held = [], 0
    for raw in raws:
        batch.append(raw)
        held += len(raw)
        if held >= BATCH_BYTES:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


# q: where the neighbour begins; m: the rank of the pair that begins at p; i: the step
STEPS = """
    WITH RECURSIVE step AS (
        SELECT 0 AS i, a.w, a.p, a.p + 1 AS q, a.tok, a.nxt, m.m FROM piece_rows a LEFT JOIN merges m ON m.pair = (a.tok::BIGINT << 17 | a.nxt)
        UNION ALL
        SELECT n.i, n.w, n.p, n.q, n.tok, n.nxt, CASE WHEN n.pair IS NULL THEN n.m ELSE m.m END FROM (
            SELECT s.i + 1 AS i, s.w, s.q, s.m,
                   CASE WHEN s.p = b.q THEN b.p ELSE s.p END AS p,
                   CASE WHEN s.p = b.q THEN b.m ELSE s.tok END AS tok,
                   CASE WHEN s.q = b.p THEN b.m ELSE s.nxt END AS nxt,
                   CASE WHEN s.p = b.q THEN b.m << 17 | s.nxt WHEN s.q = b.p THEN s.tok::BIGINT << 17 | b.m END AS pair
            FROM step s JOIN (
                SELECT w, least >> 16 AS m, least & 65535 AS p, q FROM (
                    SELECT w, min(m::BIGINT << 16 | p) AS least, arg_min(q, m::BIGINT << 16 | p) AS q FROM step WHERE m IS NOT NULL GROUP BY w)
            ) b ON b.w = s.w WHERE s.p <> b.p
        ) n LEFT JOIN merges m ON m.pair = n.pair
    ), last AS (SELECT w, max(i) AS i FROM step GROUP BY w), ended AS (SELECT s.w, s.p, s.tok FROM step s JOIN last USING (w, i))
"""
# prv: the token before; x, y: the tokens on both sides of a contraction when its turn comes; tok -1: the position is gone
RUNS = """
    WITH RECURSIVE step(w, p, q, prv, tok, nxt, m) USING KEY (w, p) AS (
        SELECT a.w, a.p, a.p + 1, a.prv, a.tok, a.nxt, m.m FROM piece_rows a LEFT JOIN merges m ON m.pair = (a.tok::BIGINT << 17 | a.nxt)
        UNION
        (WITH live AS MATERIALIZED (SELECT * FROM recurring.step WHERE tok >= 0),
        best AS (SELECT w, min(m) AS r FROM live GROUP BY w HAVING min(m) IS NOT NULL),
        found AS (SELECT l.*, b.r, lag(l.q) OVER (PARTITION BY l.w ORDER BY l.p) AS before FROM live l JOIN best b ON b.w = l.w AND b.r = l.m),
        runs AS (SELECT *, sum(CASE WHEN before = p THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY p) AS run FROM found),
        apart AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY w, run ORDER BY p) % 2 = 1),
        ends AS (SELECT o.w, o.p, o.q, o.prv, o.r, n.q AS q2, n.nxt AS y FROM apart o JOIN live n ON n.w = o.w AND n.p = o.q),
        turns AS MATERIALIZED (SELECT *, CASE WHEN lag(q2) OVER (PARTITION BY w ORDER BY p) = p THEN r ELSE prv END AS x FROM ends),
        cut AS (SELECT w, min(p) AS upto FROM (
            SELECT t.w, t.p FROM turns t JOIN merges m ON m.pair = (t.x::BIGINT << 17 | t.r) WHERE t.x >= 0 AND m.m < t.r
            UNION ALL SELECT t.w, t.p FROM turns t JOIN merges m ON m.pair = (t.r::BIGINT << 17 | t.y) WHERE t.y >= 0 AND m.m < t.r) GROUP BY w),
        taken AS MATERIALIZED (SELECT t.* FROM turns t LEFT JOIN cut c ON c.w = t.w WHERE c.upto IS NULL OR t.p <= c.upto),
        changed AS (
            SELECT t.w, t.p, t.q2 AS q, t.x AS prv, t.r AS tok, CASE WHEN n.p IS NULL THEN t.y ELSE t.r END AS nxt FROM taken t LEFT JOIN taken n ON n.w = t.w AND n.p = t.q2
            UNION ALL SELECT w, q, q, -1, -1, -1 FROM taken
            UNION ALL SELECT l.w, l.p, l.q, coalesce(a.r, l.prv), l.tok, coalesce(b.r, l.nxt)
            FROM live l LEFT JOIN taken a ON a.w = l.w AND a.q2 = l.p LEFT JOIN taken b ON b.w = l.w AND b.p = l.q
            LEFT JOIN taken c ON c.w = l.w AND c.p = l.p LEFT JOIN taken d ON d.w = l.w AND d.q = l.p
            WHERE (a.r IS NOT NULL OR b.r IS NOT NULL) AND c.p IS NULL AND d.q IS NULL)
        SELECT c.w, c.p, c.q, c.prv, c.tok, c.nxt, m.m FROM changed c LEFT JOIN merges m ON m.pair = CASE WHEN c.tok >= 0 AND c.nxt >= 0 THEN c.tok::BIGINT << 17 | c.nxt END)
    ), ended AS (SELECT w, p, tok FROM step WHERE tok >= 0)
"""
# ordered aggregations: the ids of each piece, and the bytes that they stand for
ENDED = """
    SELECT e.w, string_agg(e.tok::VARCHAR, ' ' ORDER BY e.p) AS ids, string_agg(v.raw, '' ORDER BY e.p) AS raw
    FROM ended e JOIN vocab v ON v.id = e.tok GROUP BY e.w
"""
# the same over rows that are sorted once for both: faster, but only the order inside an aggregate is promised
SORTED = """
    SELECT w, string_agg(tok::VARCHAR, ' ') AS ids, string_agg(raw, '') AS raw
    FROM (SELECT e.w, e.tok, v.raw FROM ended e JOIN vocab v ON v.id = e.tok ORDER BY e.w, e.p) GROUP BY w
"""


class Coder:
    """Encodes and decodes with the ranks; one for each task."""

    def __init__(self, ranks: dict[bytes, int], merges: pa.Table, pattern: str):
        import duckdb
        import regex

        self.ranks, self.ids, self.raws, self.old = ranks, {}, {}, ({}, {})
        self.any = regex.compile(pattern.replace(r"\s", "\0").replace("[^\0", f"[^{_S}").replace("\0", f"[{_S}]").replace(r"(?!\S)", f"(?![^{_S}])"))
        self.public = pattern == PUBLIC
        self.one = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '200MB'; SET enable_progress_bar = false; SET preserve_insertion_order = false")
        self.db.register("merge_rows", merges)
        self.db.register("vocab_rows", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "raw": [t.decode("latin-1") for t in ranks]}))
        self.db.execute("CREATE TABLE merges AS SELECT pair, m FROM merge_rows; CREATE TABLE vocab AS SELECT id, raw FROM vocab_rows")
        self.db.unregister("merge_rows")
        self.db.unregister("vocab_rows")

    def close(self) -> None:
        self.db.close()
        self.ids, self.raws, self.old = {}, {}, ({}, {})

    def split(self, text: str) -> list[str]:
        if self.public and not _HIGH.search(text):
            return _LATIN.findall(text)
        return self.any.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Put the pieces into the cache: ids as text, the decoded bytes."""
        whole, raws = [], []
        for p in pieces:
            raw = p.encode()
            (whole if raw in self.ranks else raws).append(raw)
        self._keep(whole, self.decode([[self.ranks[raw]] for raw in whole]), [str(self.ranks[raw]) for raw in whole])
        raws.sort(key=len)
        cut = bisect.bisect_right(raws, STEPPED, key=len)
        for query, part in ((STEPS, raws[:cut]), (RUNS, raws[cut:])):
            for batch in _batched(part):
                got = self._contracted(query + SORTED, batch)
                if apart := [raw for raw, _, back in got if raw != back]:  # not aggregated in their order
                    got = [g for g in got if g[0] == g[2]] + self._contracted(query + ENDED, apart)
                self._keep([g[0] for g in got], ((w, g[2]) for w, g in enumerate(got)), [g[1] for g in got])

    def _contracted(self, query: str, batch: list[bytes]) -> list[tuple[bytes, str, bytes]]:
        """(piece, ids as text, the decoded bytes) of a batch."""
        got = self._rows(query, "piece_rows", self._positions(batch))
        return [(batch[w], ids, raw.encode("latin-1")) for w, ids, raw in zip(*(got.column(c).to_pylist() for c in ("w", "ids", "raw")))]

    def _recall(self, pieces: set[str]) -> None:
        """Have the pieces in the young generation: from the old one, or learnt. A full young one becomes the old."""
        if len(new := pieces - self.ids.keys()) + len(self.ids) > CACHE:
            self.old, self.ids, self.raws, new = (self.ids, self.raws), {}, {}, pieces
        ids, raws = self.old
        for p in new & ids.keys():
            self.ids[p], self.raws[p] = ids.pop(p), raws.pop(p)
        if new := new - self.ids.keys():
            self.learn(new)

    def _keep(self, raws: list[bytes], decoded, ids: list[str]) -> None:
        names = [raw.decode() for raw in raws]
        self.ids.update(zip(names, ids))
        self.raws.update((names[w], raw) for w, raw in decoded)

    def _positions(self, raws: list[bytes]) -> pa.Table:
        n = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(n)
        tok = self.one[np.frombuffer(b"".join(raws), np.uint8)]
        nxt, prv = np.empty_like(tok), np.empty_like(tok)
        nxt[:-1], prv[1:] = tok[1:], tok[:-1]
        nxt[ends - 1], prv[ends - n] = -1, -1
        p = (np.arange(len(tok)) - np.repeat(ends - n, n)).astype(np.int32)
        return pa.table({"w": np.repeat(np.arange(len(raws), dtype=np.int32), n), "p": p, "tok": tok, "nxt": nxt, "prv": prv})

    def _rows(self, query: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        got = self.db.sql(query).to_arrow_table()
        self.db.unregister(name)
        return got

    def decode(self, ids: list[list[int]]) -> list[tuple[int, bytes]]:
        """(position in ids, bytes) by an ordered aggregation; ids must be in the vocabulary."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        if not n.sum():
            return [(i, b"") for i in range(len(ids))]
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows = pa.table({"w": np.repeat(np.arange(len(ids)), n), "p": p, "id": pa.array([t for x in ids for t in x], pa.int32())})
        got = self._rows("SELECT r.w, count(*) AS n, string_agg(v.raw, '' ORDER BY r.p) AS raw FROM id_rows r JOIN vocab v USING (id) GROUP BY r.w", "id_rows", rows)
        if sum(got.column("n").to_pylist()) != len(p):
            raise ValueError("an id is not in the vocabulary")
        return [(w, raw.encode("latin-1")) for w, raw in zip(got.column("w").to_pylist(), got.column("raw").to_pylist())] + [(i, b"") for i, x in enumerate(ids) if not x]

    def encode(self, texts: list[str]) -> list[tuple[str, int, bytes]]:
        """For each text: its ids in decimal joined by blanks, their number, the decoded bytes."""
        out, pieces = [], [self.split(t) for t in texts]
        self._recall(set().union(*pieces))
        ids, raws = self.ids.__getitem__, self.raws.__getitem__
        for x in pieces:
            text = " ".join(map(ids, x))
            out.append((text, text.count(" ") + 1 if x else 0, b"".join(map(raws, x))))
        return out


PUBLIC = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _coded(vocabulary, pattern, fn):
    """An Arrow pass with one coder a task, which is closed at its end: workers are reused."""

    def run(batches):
        c = Coder(*vocabulary.value, pattern)
        try:
            for b in batches:
                yield from fn(c, b)
        finally:
            c.close()

    return run


def _texts(b: pa.RecordBatch):
    for part in slices([b], most=TEXT_BYTES):
        yield part, [t or "" for t in part.column("text").to_pylist()]


def _digest(c: Coder, b: pa.RecordBatch):
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    for part, texts in _texts(b):
        got = [(n, sha(i.encode()), sha(r)) for i, n, r in c.encode(texts)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got]), pa.array([g[2] for g in got])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encode(c: Coder, b: pa.RecordBatch):
    for part, texts in _texts(b):
        ids = pa.array([[int(x) for x in i.split()] for i, _, _ in c.encode(texts)], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])


def _decode(c: Coder, b: pa.RecordBatch):
    for part in slices([b], "ids", 1_000_000):
        raws = dict(c.decode([x or [] for x in part.column("ids").to_pylist()]))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([raws[i] for i in range(part.num_rows)], pa.binary())], names=["doc_id", "raw"])


def _pass(df: DataFrame, columns: list[str], path: str, pattern: str, fn, schema: str) -> DataFrame:
    ranks = read_ranks(path)
    vocabulary = df.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks)))  # its size does not follow the data
    return arrow_map(df.select(*columns), _coded(vocabulary, pattern, fn), schema)


def encode(docs: DataFrame, path: str, pattern: str = PUBLIC) -> DataFrame:
    """doc_id, ids (array<int>)."""
    return _pass(docs, ["doc_id", "text"], path, pattern, _encode, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str = PUBLIC) -> DataFrame:
    """doc_id, raw (binary) from doc_id, ids."""
    return _pass(ids, ["doc_id", "ids"], path, pattern, _decode, "doc_id long, raw binary")


def round_trip(docs: DataFrame, path: str, pattern: str = PUBLIC) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _pass(docs, ["doc_id", "text"], path, pattern, _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
