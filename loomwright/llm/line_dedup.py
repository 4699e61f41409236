"""Line dedup by a segment-partition edit join.

Lines are normalised (single blanks, no blanks at the ends). Equal lines of any length are one
class by their hash. Two different lines of at least MIN_CHARS characters are also linked if
their edit distance is at most tau (most lines of a few characters are within two edits of each
other, so shorter lines have no inexact links). Linked and equal lines form classes
(components); the first line of a class, by doc_id and position, stays and the others go.

Search: a line is cut into tau + 1 segments; of a line within tau edits at least one segment is
a substring of the other line near its own place. A line's rows are the substrings that the
multi-match-aware windows allow, for each length from own - tau to own; the row of a segment at
its own place also stands in the index. Rows of one key meet in one sorted pass. A parity
sketch of the characters (tau edits change at most 2 tau bits) drops most false candidates and
a banded bit-parallel edit distance verifies the rest.

A key with more than HOT index rows has no pairs. Its members meet one leader (a star), and the
key is done if that leaves them in one component. Otherwise the equal segment is cut out of
them, and the rest, in which the edits must lie, is a line of the next level, in the name of
that key: the same search, until the rest has EXACT characters or fewer. Then all patterns of
up to tau edits (a character dropped or wild) are exact keys: with tau edits or fewer in all, an
equal pattern proves a link, and a star around the member with fewest edits stands for all
pairs. So the classes are those of all pairs, and no key makes a square. A key with up to
GROUP_ROWS members and GROUP_BYTES of text goes through its levels in one task, which holds no
more than that; larger ones go level by level over the cluster. Both give the same classes.
Keys that are frequent in one slice of texts, or counted on the later levels, are not even
brought together: their leaders are minima that are combined before the shuffle.

Defined cases: null text has no lines; lines without a word are never removed, and by
`dedup_lines` none under its `least` characters; null doc_id comes last; rows equal in doc_id
and text are one document: they get the same verdict and do not remove each other's lines; ties
(equal lines in one place of the order) can only be such rows; a very long text is cut into
lines as any other, and a line takes about 40 bytes of memory a character; an empty table
gives an empty result; other columns are ignored by `removals` and kept by `dedup_lines`, whose
own columns begin with _lw_ (reserved).
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import arrow_map, connected_components, materialize, slices, small

TAU, MIN_CHARS = 2, 12  # MIN_CHARS bounds the inexact links only
KEYED_BYTES = 1_000_000  # of text at a time: its keys take about 40 times as much
HOT = 32  # index rows of a key that meet in pairs
EXACT = 12  # characters of a rest that gets exact keys
GROUP_ROWS, GROUP_BYTES = 20_000, 8_000_000  # of a key that one task takes through its levels
SPREAD, MOST_SPREAD = 64, 10_000  # parts of a frequent key; how many keys are treated so (all others meet in one pass)
SEEN = 200_000  # lines that a task remembers, to give copies their keys once
CUT = "\n"  # stands for the segment that was cut out; no line has it


def normal(line: str) -> str:
    return " ".join(line.split())


def lines_of(text: str | None) -> list[str]:
    """The normalised lines of a text."""
    return [normal(x) for x in (text or "").split("\n")]


def as_line(text: str) -> list[str]:
    """A text that is one line, as it is."""
    return [text]


def line_id(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def segment(n, tau: int, i: int):
    """(start, length) of segment i of tau + 1 in lines of n characters, the longer ones last."""
    k, extra = n // (tau + 1), n % (tau + 1)
    late = np.maximum(0, i - (tau + 1 - extra))
    return i * k + late, k + (i >= tau + 1 - extra)


_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the odd base and of its inverse, modulo 2^64


def _powers(n: int):
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, np.uint64(base))
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Chars:
    """The characters of lines in one array, with a hash of any substring and a sketch of each line."""

    def __init__(self, lines: list[str]):
        self.n = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.cumsum(self.n) - self.n
        self.points = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        power, self.inverse = _powers(len(self.points))
        self.sums = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum(_mix(self.points.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def hashes(self, row: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        at = self.starts[row]
        return (self.sums[at + e] - self.sums[at + s]) * self.inverse[at + s]

    def sketches(self) -> np.ndarray:
        """Of lines that are not empty."""
        return np.bitwise_xor.reduceat(np.uint32(1) << (self.points & np.uint32(31)), self.starts).astype(np.int64)


def keys_of(chars: Chars, tau: int, length: np.ndarray | None = None, index: np.ndarray | None = None, space: np.ndarray | None = None):
    """(row, key, role, gap, segment, start) of all rows of the lines. length: of the index lines
    that a line meets (None: all from own - tau to own); index: which lines are in the index."""
    out = []
    for gap in range(tau + 1):
        met = chars.n - gap >= MIN_CHARS if length is None else chars.n - gap == length
        rows = np.flatnonzero(met)
        if not len(rows):
            continue
        n = chars.n[rows]
        for i in range(tau + 1):
            p, z = segment(n - gap, tau, i)
            seed = ((n - gap) << 3 | i).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            if space is not None:
                seed ^= space[rows].view(np.uint64)
            for d in range(max(-i, gap - (tau - i)), min(i, gap + tau - i) + 1):
                ok = np.flatnonzero((p + d >= 0) & (p + d + z <= n))
                r, s = rows[ok], (p + d)[ok]
                key = _mix(chars.hashes(r, s, s + z[ok]) + _mix(seed[ok]))
                role = np.full(len(r), gap == d == 0) if index is None else (index[r] if gap == d == 0 else np.zeros(len(r), bool))
                out.append((r, key.view(np.int64), role.astype(np.int64), np.full(len(r), gap), np.full(len(r), i), s))
    if not out:
        return [np.zeros(0, np.int64)] * 6
    return [np.concatenate(c) for c in zip(*out)]


# a tag has, from the top: role (1 bit), gap (2), segment (2), start (26), sketch (32)
def _tags(role, gap, i, s, sk):
    return role << 62 | gap << 60 | i << 58 | np.minimum(s, (1 << 26) - 1) << 32 | sk


def _untag(tag: int) -> tuple[int, int, int, int]:
    return tag >> 62 & 1, tag >> 60 & 3, tag >> 58 & 3, tag >> 32 & (1 << 26) - 1


def _rows(least, tau, split):
    """The ids of a text's lines, and the keys that are frequent in its slice."""

    def run(batches):
        for b in slices(batches, most=KEYED_BYTES):
            ids, ends, new = [], [0], {}
            for t in b.column("text").to_pylist():
                for line in split(t):
                    i = line_id(line) if len(line) >= least else None
                    ids.append(i)
                    if len(line) >= MIN_CHARS:
                        new[i] = line
                ends.append(len(ids))
            chars = Chars(list(new.values()))
            _, key, role, *_ = keys_of(chars, tau)
            key, n = np.unique(key[role == 1], return_counts=True)
            hot = key[n > max(HOT, len(new) // 64)].tolist()
            lids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), lids, pa.array([hot] + [[]] * (b.num_rows - 1), pa.list_(pa.int64()))], names=["doc_id", "text_key", "lids", "hot"])

    return run


def _parts(key: np.ndarray, lid: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """0, or for a row of a frequent key the part of it that the row goes to."""
    at = np.minimum(np.searchsorted(hot, key), max(len(hot) - 1, 0))
    known = hot[at] == key if len(hot) else np.zeros(len(key), bool)
    return np.where(known, 1 + (lid & (SPREAD - 1)), 0)


def _keys(tau, least, hot, split):
    def run(batches):
        seen: set[int] = set()
        for part in slices(batches, most=KEYED_BYTES):
            new = {}
            for t in part.column("text").to_pylist():
                for line in split(t):
                    if len(line) >= max(least, MIN_CHARS) and (i := line_id(line)) not in seen:
                        seen.add(i)
                        new[i] = line
            if len(seen) > SEEN:
                seen.clear()
            if not new:
                continue
            lids, chars = np.fromiter(new, np.int64, len(new)), Chars(list(new.values()))
            row, key, role, gap, i, s = keys_of(chars, tau)
            lid = lids[row]
            cols = [key, lid, _tags(role, gap, i, s, chars.sketches()[row]), _parts(key, lid, hot.value)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "lid", "tag", "part"])

    return run


def _near(x: np.ndarray, y: np.ndarray, tau: int) -> np.ndarray:
    return np.bitwise_count((x ^ y) & 0xFFFFFFFF) <= 2 * tau


HELD = 65_536  # rows of one key that the pass holds


def _meet(tau, most):
    """One pass over rows sorted by key, index rows first: pairs (a, b) of keys with up to `most`
    index rows, and the members (key, b, tag) of the others. It holds `most` rows of a key, or HELD."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "key", "tag")])

    def batch(a, b, key=None, tag=None):
        none = pa.nulls(len(b), pa.int64())
        return pa.RecordBatch.from_arrays([none if a is None else pa.array(a), pa.array(b), none if key is None else pa.array(key), none if tag is None else pa.array(tag)], schema=schema)

    def crossed(x, y, above):
        """Pairs of each row of x with `above[i]` rows of y: (positions in x, in y)."""
        first, n = above
        left = np.repeat(np.arange(len(x)), n)
        return left, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)

    def pairs(index, lid, tag, first, n):
        for lo in range(0, len(index), 8192):
            i, j = crossed(index[lo : lo + 8192], lid, (first[lo : lo + 8192], n[lo : lo + 8192]))
            i = index[lo : lo + 8192][i]
            ok = (lid[i] != lid[j]) & ((j > i) | (tag[j] >> 62 == 0)) & _near(tag[i], tag[j], tau)
            if ok.any():
                a, b = lid[i[ok]], lid[j[ok]]
                yield batch(np.minimum(a, b), np.maximum(a, b))

    def run(batches):
        held: list = []  # rows of the key that may go on
        hot = None  # a key of which all further rows are members
        few = None  # (key, its index rows) of which all further rows are probes
        for b in itertools.chain(batches, [None]):
            if b is None:
                key = lid = tag = np.zeros(0, np.int64)
            else:
                key, lid, tag, part = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lid", "tag", "part"))
                if (spread := part > 0).any():
                    yield batch(None, lid[spread], key[spread], tag[spread])
                    key, lid, tag = key[~spread], lid[~spread], tag[~spread]
            if hot is not None and len(key):
                n = np.searchsorted(key != hot, True)
                yield batch(None, lid[:n], key[:n], tag[:n])
                if n < len(key):
                    hot = None
                key, lid, tag = key[n:], lid[n:], tag[n:]
            if few is not None and len(key):
                n = int(np.searchsorted(key != few[0], True))
                c = len(few[1])
                x, y = np.concatenate([few[1], lid[:n]]), np.concatenate([few[2], tag[:n]])
                yield from pairs(np.arange(c), x, y, np.full(c, c), np.full(c, n))
                if n < len(key):
                    few = None
                key, lid, tag = key[n:], lid[n:], tag[n:]
            if held:
                key, lid, tag = (np.concatenate(c) for c in zip(*held, (key, lid, tag)))
                held = []
            if not len(key):
                continue
            same = np.flatnonzero((key[1:] == key[:-1]) & (lid[1:] == lid[:-1]) & (tag[1:] == tag[:-1])) + 1
            if len(same):
                key, lid, tag = (np.delete(c, same) for c in (key, lid, tag))
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            if b is not None:
                last = starts[-1]
                if len(key) - last > HELD:
                    index = tag[last:] >> 62 == 1
                    if index.sum() > most:
                        hot = key[last]
                    else:
                        few = (key[last], lid[last:][index], tag[last:][index])
                else:
                    held = [(key[last:], lid[last:], tag[last:])]
                    key, lid, tag, starts = key[:last], lid[:last], tag[:last], starts[:-1]
            if not len(key):
                continue
            sizes = np.diff(np.append(starts, len(key)))
            role = tag >> 62
            index = np.add.reduceat(role, starts)
            dense = np.repeat(index > most, sizes)
            if dense.any():
                yield batch(None, lid[dense], key[dense], tag[dense])
            rows = np.flatnonzero((role == 1) & ~dense & (np.repeat(sizes, sizes) > 1))
            if len(rows):
                yield from pairs(rows, lid, tag, np.repeat(starts, sizes)[rows], np.repeat(sizes, sizes)[rows])

    return run


def within(a: str, b: str, tau: int) -> bool:
    """Edit distance <= tau by a bit-parallel band of 2 tau + 1 diagonals."""
    if abs(len(a) - len(b)) > tau:
        return False
    k = len(os.path.commonprefix((a, b)))
    a, b = a[k:], b[k:]
    k = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = (a[:-k], b[:-k]) if k else (a, b)
    if not a or not b:
        return max(len(a), len(b)) <= tau
    # bit d of reach[e]: with e edits, a[:i] can become b[:i + d - tau]
    width = 2 * tau + 1
    full = (1 << width) - 1
    places: dict[str, int] = {}
    for j, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << j
    valid = lambda i: sum(1 << d for d in range(width) if 0 <= i + d - tau <= len(b))
    reach = [0] * (tau + 1)
    for e in range(tau + 1):
        reach[e] = sum(1 << (tau + d) for d in range(min(e, len(b)) + 1))
    for i, c in enumerate(a):
        at = places.get(c, 0)
        match = (at >> (i - tau) if i >= tau else at << (tau - i)) & full  # bit d: b[i + d - tau] == c
        ok = valid(i + 1) if i + 1 <= tau or i + 1 + tau > len(b) else full
        new = []
        for e in range(tau + 1):
            r = reach[e] & match
            if e:
                r |= reach[e - 1] | reach[e - 1] >> 1 | new[e - 1] << 1  # substitute, delete, insert
            new.append(r & ok & full)
        reach = new
        if not reach[tau]:
            return False
    return bool(reach[tau] >> (len(b) - len(a) + tau) & 1) if 0 <= len(b) - len(a) + tau < width else False


def _verify(tau):
    def run(batches):
        for b in batches:
            keep = [within(x, y, tau) for x, y in zip(b.column("line_a").to_pylist(), b.column("line_b").to_pylist())]
            t = pa.Table.from_batches([b.select(["a", "b"])]).filter(pa.array(keep, pa.bool_()))
            yield from t.to_batches()

    return run


def _picked(split):
    """(lid, line) of the lines of a text that are asked for (lid, pos)."""

    def run(batches):
        for b in slices(batches, most=KEYED_BYTES):
            lid, line = [], []
            for t, want in zip(b.column("text").to_pylist(), b.column("want").to_pylist()):
                lines = split(t)
                for w in want:
                    lid.append(w["lid"])
                    line.append(lines[w["pos"]])
            yield pa.RecordBatch.from_arrays([pa.array(lid, pa.int64()), pa.array(line, pa.string())], names=["lid", "line"])

    return run


def _cut(tau):
    """What is left of the members of a key without its segment; before: a hash of what stands before it."""

    def run(batches):
        for b in slices(batches, "line", KEYED_BYTES):
            rows = []
            for key, lid, root, tag, line in zip(*(b.column(c).to_pylist() for c in ("key", "lid", "root", "tag", "line"))):
                role, gap, i, s = _untag(tag)
                m = len(line) - gap
                z = int(segment(m, tau, i)[1])
                rows.append((key, lid, root, m - z + 1, role, xxhash.xxh3_64_intdigest(line[:s].encode()) - (1 << 63) if i else None, line, line[:s] + CUT + line[s + z :]))
            cols = list(zip(*rows)) if rows else [[]] * 8
            types = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["space", "lid", "root", "m", "role", "before", "line", "rest"])

    return run


LEVEL = "space long, lid long, root long, m long, role int, before long, line string"


def _level_keys(tau):
    def run(batches):
        for b in slices(batches, "line", KEYED_BYTES // 4):
            lines = b.column("line").to_pylist()
            chars = Chars(lines)
            space, lid, root, m, role = (b.column(c).to_numpy(zero_copy_only=False) for c in ("space", "lid", "root", "m", "role"))
            row, key, own, gap, i, s = keys_of(chars, tau, m, role == 1, space)
            cols = [key, lid[row], root[row], _tags(own, gap, i, s, chars.sketches()[row])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), b.column("line").take(pa.array(row))], names=["key", "lid", "root", "tag", "line"])

    return run


def patterns(line: str, tau: int):
    """(pattern, wild characters, dropped characters) of up to tau edits; CUT is never edited."""
    free = [k for k, c in enumerate(line) if c != CUT]
    for edits in range(tau + 1):
        for at in itertools.combinations(free, edits):
            for kinds in itertools.product((False, True), repeat=edits):  # True: dropped
                chars = list(line)
                for k, dropped in zip(at, kinds):
                    chars[k] = "" if dropped else "\r"
                yield "".join(chars), edits - sum(kinds), sum(kinds)


def _patterns(tau):
    def run(batches):
        for b in slices(batches, "line", 2_000):
            key, lid, drops, wild = [], [], [], []
            for space, i, line in zip(*(b.column(c).to_pylist() for c in ("space", "lid", "line"))):
                for pattern, w, d in set(patterns(line, tau)):
                    key.append(xxhash.xxh3_64_intdigest(f"{space}:{w}:{pattern}".encode()) - (1 << 63))
                    lid.append(i)
                    drops.append(d)
                    wild.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(lid, pa.int64()), pa.array(drops, pa.int32()), pa.array(wild, pa.int32())], names=["key", "lid", "drops", "wild"])

    return run


class Joined:
    """Disjoint sets of lines, and the links that joined them."""

    def __init__(self, lid: list[int], line: list[str], tau: int):
        self.lid, self.line, self.tau = lid, line, tau
        self.up = list(range(len(lid)))
        self.links: list[tuple[int, int]] = []
        self.bits = [0] * len(lid)
        if lid:
            self.bits = Chars(line).sketches().tolist()

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int, sure: bool = False) -> None:
        a, b = self.root(x), self.root(y)
        if a == b or not sure and ((self.bits[x] ^ self.bits[y]).bit_count() > 2 * self.tau or not within(self.line[x], self.line[y], self.tau)):
            return
        self.up[max(a, b)] = min(a, b)
        self.links.append((min(self.lid[x], self.lid[y]), max(self.lid[x], self.lid[y])))

    def whole(self, some) -> bool:
        some = iter(some)
        first = self.root(next(some))
        return all(self.root(x) == first for x in some)


def solve(sets: Joined, rows: list[int], rests: list[str], m: int, role: list[int], most: int) -> None:
    """Join the lines of one key: all pairs of an index line with any other, through the levels.
    A line can be there twice, with two rests, where it has the key's segment in two places."""
    tau, work = sets.tau, [(rows, rests, m, role)]
    while work:
        rows, rests, m, role = work.pop()
        if sets.whole(rows):
            continue
        if m <= EXACT:
            hubs: dict = {}
            for x, rest in sorted(zip(rows, rests), key=lambda r: sets.lid[r[0]]):
                for pattern, w, d in set(patterns(rest, tau)):
                    hubs.setdefault((pattern, w), []).append((d, x))
            for (_, w), found in hubs.items():
                least, hub = min(found)
                for d, x in found:
                    if d + least + w <= tau:
                        sets.join(hub, x, sure=True)
            continue
        chars = Chars(rests)
        row, key, own, gap, i, start = keys_of(chars, tau, np.full(len(rests), m), np.array(role) == 1)
        order = np.lexsort((-own, key))
        row, key, own, gap, i, start = (c[order].tolist() for c in (row, key, own, gap, i, start))
        at = 0
        while at < len(key):
            end = at
            while end < len(key) and key[end] == key[at]:
                end += 1
            index = sum(own[at:end])
            if index and end - at > 1:
                for x in range(at, at + (index if index <= most else 1)):
                    for y in range(x + 1, end):
                        sets.join(rows[row[x]], rows[row[y]])
                members = list(range(at, end))
                if index > most and not sets.whole(rows[row[k]] for k in members):
                    if not i[at] or len({rests[row[k]][: start[k]] for k in members}) > 1:  # else the first segment serves them
                        z = int(segment(m, tau, i[at])[1])
                        cut = [rests[row[k]][: start[k]] + CUT + rests[row[k]][start[k] + z :] for k in members]
                        work.append(([rows[row[k]] for k in members], cut, m - z + 1, [own[k] for k in members]))
            at = end


def _solved(tau, most):
    def run(table: pa.Table) -> pa.Table:
        lid, line, rest, role = (table.column(c).to_pylist() for c in ("lid", "line", "rest", "role"))
        place = {i: k for k, i in enumerate(dict.fromkeys(lid))}
        text = dict(zip(lid, line))
        sets = Joined(list(place), [text[i] for i in place], tau)
        solve(sets, [place[i] for i in lid], rest, table.column("m")[0].as_py(), role, most)
        return pa.table({"a": pa.array([a for a, _ in sets.links], pa.int64()), "b": pa.array([b for _, b in sets.links], pa.int64())})

    return run


def _sorted_meeting(rows: DataFrame, tau: int, most: int) -> DataFrame:
    rows = rows.repartition("key", "part").sortWithinPartitions("key", F.desc("tag"), "lid")
    return materialize(arrow_map(rows, _meet(tau, most), "a long, b long, key long, tag long"))


def _leaders(members: DataFrame) -> DataFrame:
    """The least index line of each key, with its tag."""
    return members.where(F.shiftright("tag", 62) == 1).groupBy("key").agg(F.min(F.struct("lid", "tag")).alias("l"))


def _stars(members: DataFrame, tau: int) -> DataFrame:
    """Pairs (a, b) of each key's leader with its members (key, lid, tag)."""
    lead = _leaders(members)
    near = F.bit_count(F.col("tag").bitwiseXOR(F.col("l.tag")).bitwiseAND(F.lit(0xFFFFFFFF))) <= 2 * tau
    met = members.join(small(materialize(lead)), "key").where((F.col("lid") != F.col("l.lid")) & near)
    return met.select(F.least("lid", "l.lid").alias("a"), F.greatest("lid", "l.lid").alias("b"))


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (lid) with the root of their component."""
    groups = materialize(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    return rows.join(small(groups), F.col("lid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "lid")).drop("node")


def _open(rows: DataFrame, by: str) -> DataFrame:
    """The rows of those keys whose members are still in different components."""
    split = rows.groupBy(by).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(by)
    return rows.join(small(materialize(split)), by, "left_semi")


def _level(members: DataFrame) -> DataFrame:
    """A level's members without the keys that another segment serves: if all members are equal
    before their segment, the first segment is equal too, and its key has them all."""
    kept = _open(members, "space")
    alike = kept.groupBy("space").agg(F.min("before").alias("lo"), F.max("before").alias("hi")).where("lo = hi").select("space")
    return materialize(kept.join(small(materialize(alike)), "space", "left_anti"))


def linked_classes(rows: DataFrame, texts: DataFrame, tau: int = TAU, least: int = 1, most: int = HOT, rows_a_task: int = GROUP_ROWS, split=lines_of) -> DataFrame:
    """Links (a, b), a < b, between different lines whose components are those of all pairs
    within tau edits. rows: doc_id, text_key, lids, hot; texts: doc_id, text_key, text."""
    spark = rows.sparkSession
    # keys that are frequent in some slice; others only take another path, so their number is free to choose
    frequent = rows.select(F.explode("hot").alias("key")).groupBy("key").count().orderBy(F.desc("count"), "key").limit(MOST_SPREAD)
    frequent = np.array(sorted(r["key"] for r in frequent.collect()), np.int64)
    keyed = arrow_map(texts.select("text"), _keys(tau, least, spark.sparkContext.broadcast(frequent), split), "key long, lid long, tag long, part long")
    met = _sorted_meeting(keyed, tau, most)
    members = met.where("key is not null").select("key", F.col("b").alias("lid"), "tag").distinct()
    members = materialize(members)
    dense = not members.isEmpty()
    pairs = met.where("key is null").select("a", "b")
    pairs = materialize((pairs.union(_stars(members, tau)) if dense else pairs).distinct())

    need = pairs.select(F.col("a").alias("lid")).union(pairs.select("b"))
    need = small(materialize((need.union(members.select("lid")) if dense else need).distinct()))
    place = F.struct("text_key", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "pos")
    held = rows.select("doc_id", "text_key", F.posexplode("lids").alias("pos", "lid")).join(need, "lid", "left_semi").groupBy("lid").agg(F.min(place).alias("p"))
    want = held.groupBy("p.text_key", "p.none", "p.id").agg(F.collect_list(F.struct("lid", "p.pos")).alias("want"))
    want = small(materialize(want.toDF("w_key", "w_none", "w_id", "want")))
    same = (F.col("text_key") == F.col("w_key")) & (F.col("doc_id").isNull() == F.col("w_none")) & (F.coalesce("doc_id", F.lit(0)) == F.col("w_id"))
    found = arrow_map(texts.join(want, same).select("text", "want"), _picked(split), "lid long, line string")
    found = materialize(found.groupBy("lid").agg(F.first("line").alias("line")))

    def verified(some: DataFrame) -> DataFrame:
        text = lambda c: small(found).select(F.col("lid").alias(c), F.col("line").alias("line_" + c))
        return materialize(arrow_map(some.join(text("a"), "a").join(text("b"), "b"), _verify(tau), "a long, b long"))

    links = verified(pairs)
    if not dense:
        return links
    # keys with a member that is neither the leader nor linked with it
    lead = small(materialize(_leaders(members)))
    star = members.join(lead, "key").select("key", "lid", F.least("lid", "l.lid").alias("a"), F.greatest("lid", "l.lid").alias("b"))
    alone = star.where("a <> b").join(small(links.withColumn("linked", F.lit(1))), ["a", "b"], "left_anti").select("key").distinct()
    left = members.join(small(materialize(alone)), "key", "left_semi").join(small(found), "lid")
    level = arrow_map(left.select("key", "lid", F.col("lid").alias("root"), "tag", "line"), _cut(tau), LEVEL + ", rest string")
    level = materialize(level)
    if level.isEmpty():
        return links
    sizes = level.groupBy("space").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"), F.min("before").alias("lo"), F.max("before").alias("hi"))
    # if all members are equal before their segment, the first segment is equal too, and its key has them all
    sizes = materialize(sizes.where("lo is null or lo <> hi").withColumn("one", (F.col("n") <= rows_a_task) & (F.col("chars") <= GROUP_BYTES)))
    apart = level.join(small(sizes.where("one").select("space")), "space", "left_semi").select("space", "lid", "m", "role", "line", "rest")
    solved = apart.groupBy("space").applyInArrow(_solved(tau, most), "a long, b long")
    links = materialize(links.union(solved).distinct())
    many = sizes.where("not one").select("space")
    if many.isEmpty():
        return links
    level = level.join(small(many), "space", "left_semi").drop("root")
    level = _level(_rooted(level, links).withColumn("line", F.col("rest")).drop("rest"))
    while not level.isEmpty():
        short = arrow_map(level.where(F.col("m") <= EXACT).select("space", "lid", "line"), _patterns(tau), "key long, lid long, drops int, wild int")
        short = materialize(short)
        hub = materialize(short.groupBy("key").agg(F.min(F.struct("drops", "lid")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"))
        sure = short.join(small(hub), "key").where(f"lid <> hub.lid and drops + hub.drops + wild <= {tau}")
        sure = sure.select(F.least("lid", "hub.lid").alias("a"), F.greatest("lid", "hub.lid").alias("b"))
        keyed = materialize(arrow_map(level.where(F.col("m") > EXACT), _level_keys(tau), "key long, lid long, root long, tag long, line string"))
        counts = keyed.where(F.shiftright("tag", 62) == 1).groupBy("key").agg(F.countDistinct("lid").alias("n")).where(F.col("n") > most).select("key")
        counts = small(materialize(counts))
        few = keyed.join(counts, "key", "left_anti").select("key", "lid", "tag", F.lit(0).cast("long").alias("part"))
        members = materialize(keyed.join(counts, "key", "left_semi"))
        some = _sorted_meeting(few, tau, most).select("a", "b").union(_stars(members, tau)).distinct()
        links = materialize(links.union(sure).union(verified(materialize(some.join(links, ["a", "b"], "left_anti")))).distinct())
        level = _open(_rooted(members.drop("root"), links), "key")
        level = _level(arrow_map(level.select("key", "lid", "root", "tag", "line"), _cut(tau), LEVEL + ", rest string").drop("line").withColumnRenamed("rest", "line"))
    return links


def link_lines(lines: DataFrame, tau: int = TAU, most: int = HOT, rows_a_task: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b), a < b, between different lines (column line: string, as they are) by their
    line_id: all pairs within tau edits, but for keys with more than `most` index rows links with
    the same components."""
    texts = lines.select(F.lit(None).cast("long").alias("doc_id"), F.xxhash64("line").alias("text_key"), F.col("line").alias("text"))
    return linked_classes(materialize(arrow_map(texts, _rows(1, tau, as_line), ROWS)), texts, tau, 1, most, rows_a_task, as_line)


ROWS = "doc_id long, text_key long, lids array<long>, hot array<long>"


def removals(docs: DataFrame, tau: int = TAU, least: int = 1) -> DataFrame:
    """A row for each document with lines: doc_id, text_key, n_lines, n_links (its lines that are
    equal to or linked with another line), removed (positions), classes and class_docs (the
    classes of those lines and the doc_id of each one's first line).

    least: lines of fewer characters do not count and stay; 1 takes all lines with a word.
    The texts are split anew in each pass over them: that costs less than to write the lines."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    rows = materialize(arrow_map(keyed, _rows(least, tau, lines_of), ROWS))
    linked = linked_classes(rows, keyed, tau, least)
    groups = small(materialize(connected_components(linked.select(F.col("a").alias("src"), F.col("b").alias("dst")))))
    lines = rows.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.posexplode("lids").alias("pos", "lid")).where("lid is not null")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key", "pos")
    lines = lines.join(groups, F.col("lid") == F.col("node"), "left").select("doc_id", "text_key", "pos", F.coalesce("root", "lid").alias("class"), place.alias("place"))
    first = lines.groupBy("class").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "first")
    marked = lines.join(small(materialize(first)), "class", "left")
    shared = F.col("first").isNotNull()
    name = F.struct("class", F.when(~F.col("first.none"), F.col("first.id")).alias("doc"))
    out = marked.groupBy("doc_id", "text_key").agg(
        F.count("*").alias("n_lines"), F.count_if(shared).alias("n_links"),
        F.sort_array(F.collect_list(F.when(shared & (F.col("place") != F.col("first")), F.col("pos")))).alias("removed"),
        F.sort_array(F.collect_set(F.when(shared, name))).alias("names"))
    return out.select("doc_id", "text_key", "n_lines", "n_links", "removed", F.col("names.class").alias("classes"), F.col("names.doc").alias("class_docs"))


def line_report(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """A row for each document: doc_id, n_lines, n_links, n_removed, kept_sha256 (the text that
    stays), classes and class_docs: membership, as pairs of the document with representatives."""
    out = _without(docs.select("doc_id", "text"), tau, ["n_lines", "n_links", "classes", "class_docs"])
    n = F.coalesce(F.size("_lw_removed"), F.lit(0)).cast("long")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    ids = lambda c: F.coalesce(c, F.array().cast("array<long>")).alias(c)
    return out.select("doc_id", count("n_lines"), count("n_links"), F.when(n > 0, n).otherwise(0).cast("long").alias("n_removed"), F.sha2(F.coalesce("_lw_text", F.lit("")), 256).alias("kept_sha256"), ids("classes"), ids("class_docs"))


def _without(docs: DataFrame, tau: int, more: list[str], least: int = 1) -> DataFrame:
    per = removals(docs, tau, least)
    per = small(materialize(per.select(F.col("doc_id").alias("_lw_id"), F.col("text_key").alias("_lw_key"), F.col("removed").alias("_lw_removed"), *more)))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    out = docs.join(per, docs["doc_id"].eqNullSafe(per["_lw_id"]) & (key == per["_lw_key"]), "left")
    left = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_lw_removed", i))
    return out.withColumn("_lw_text", F.when(F.size("_lw_removed") > 0, F.array_join(left, "\n")).otherwise(F.col("text")))


def dedup_lines(docs: DataFrame, tau: int = TAU, least: int = MIN_CHARS) -> DataFrame:
    """docs with all its rows and columns, without the lines that repeat an earlier one.

    Lines under `least` characters stay; the pipeline gives 1, so that equal lines of any length go."""
    out = _without(docs, tau, [], least)
    n_chars = {"n_chars": F.when(F.size("_lw_removed") > 0, F.length("_lw_text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return out.withColumns({**n_chars, "text": F.col("_lw_text")}).select(*docs.columns)
