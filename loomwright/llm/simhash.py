"""SimHash near-duplicates, found with Golay-code keys.

A fingerprint has 64 bits: bit k is 1 if it is set in over half of the XXH64 hashes (seed 42)
of a text's word shingles. Fingerprints within two bits are linked.

Search: the fingerprint is cut into segments of 23, 23 and 18 bits, and each segment is decoded
by the perfect binary Golay code (23, 12, 7) to the index of its nearest codeword. If two
fingerprints differ in at most two bits, some word lies within one bit of both, and its one
error against either falls into one segment only (pigeonhole). So a fingerprint has the key of
its three indices, and for each segment the keys in which that segment is decoded with one bit
flipped: about 16 keys of 36 bits, and linked fingerprints share one. Rows are joined on the
key and verified in the join condition. Keys that hold more than `bucket` fingerprints are left
out of that join; their members get all 65 words within one bit as exact keys instead, where
equal keys prove a link and a star around the least member stands for all pairs.

Defined cases: a very long text is hashed like any other; a bit set in exactly half is 0; null or empty texts have fingerprint 0 and are linked like any other; fewer
words than a shingle: the whole sequence is the shingle; null doc_id never names a component
unless it has no other member; repeated rows come back as often as they are given; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import arrow_map, connected_components, discard, materialize, slices, small

SHINGLE, SEED, BUCKET = 3, 42, 256
GOLAY = 0b101011100011  # fixed value: generator polynomial of the binary Golay code
SEGMENTS = ((41, 23), (18, 23), (0, 18))  # shift and width
_BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the text's shingles in their order, repeats included (uint64)."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - shingle + 1].tolist()
    ends = np.concatenate((gaps, [len(joined)]))[shingle - 1 :].tolist()
    return np.fromiter((hashed(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The fingerprint of the hashes; 0 without any."""
    if not len(h):
        return 0
    octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(shingle):
    def run(batches):
        for b in slices(batches):
            got = [_signed(fingerprint(t, shingle)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(got, pa.int64())], names=["doc_id", "text_key", "fp"])

    return run


def _syndrome(x: int) -> int:
    for k in range(22, 10, -1):
        if x >> k & 1:
            x ^= GOLAY << (k - 11)
    return x


@functools.cache
def _golay():
    """(syndromes of each 12-bit half, the error of each syndrome)."""
    low, high = (np.array([_syndrome(i << s) for i in range(1 << 12)], np.int64) for s in (0, 11))
    leader = np.zeros(1 << 11, np.int64)
    ones = [1 << k for k in range(23)]
    for i in range(23):
        for j in range(i + 1):
            for k in range(j + 1):
                e = functools.reduce(int.__or__, {ones[i], ones[j], ones[k]})
                leader[_syndrome(e)] = e
    return low, high, leader


def decode(x: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the codeword nearest to each 23-bit word."""
    low, high, leader = _golay()
    return (x ^ leader[low[x & 0x7FF] ^ high[x >> 11]]) >> 11


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of the fingerprints (uint64)."""
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    own = [decode(p) for p in parts]
    rows, keys = [np.arange(len(fp))], [own[0] << 24 | own[1] << 12 | own[2]]
    for k, (p, (_, w)) in enumerate(zip(parts, SEGMENTS)):
        near = np.sort(decode(p[:, None] ^ (1 << np.arange(w))[None, :]), axis=1)
        new = (near != own[k][:, None]) & np.concatenate([np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        r, c = np.nonzero(new)
        at = [o[r] for o in own]
        at[k] = near[r, c]
        rows.append(r)
        keys.append(at[0] << 24 | at[1] << 12 | at[2])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches):
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        r, k = golay_keys(fp.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(fp[r], pa.int64())], names=["key", "fp"])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (src, dst) between different fingerprints (column fp, distinct) that connect all
    that lie within two bits of each other."""
    keys = materialize(arrow_map(fps.select("fp"), _keys, "key long, fp long"))
    hot = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key"))
    dense = None
    if not hot.isEmpty():
        hot = small(hot)
        dense = keys.join(hot, "key", "left_semi").select("fp").distinct()
        keys = keys.join(hot, "key", "left_anti")
    a, b = keys.select("key", F.col("fp").alias("src")), keys.select("key", F.col("fp").alias("dst"))
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2
    found = a.join(b, (a["key"] == b["key"]) & (F.col("src") < F.col("dst")) & near).select("src", "dst")
    if dense is not None:
        flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
        mids = dense.select("fp", F.explode(flips).alias("mid"))
        hubs = mids.groupBy("mid").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("mid", "hub")
        found = found.union(mids.join(hubs, "mid").where("fp <> hub").select(F.col("hub").alias("src"), F.col("fp").alias("dst")))
    return found.distinct()


def components(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, text_key, fp, component_id (the least doc_id that can be reached)."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    prints = materialize(arrow_map(keyed, _fingerprints(shingle), "doc_id long, text_key long, fp long"))
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = connected_components(links(fps, bucket))
    # only fingerprints that have a link need a root; all others are their own
    rooted = fps.join(small(materialize(linked)), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted)
    many = small(materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id"))))
    named = materialize(rooted.join(many, "root").select(F.col("fp").alias("print"), "component_id"))
    return prints.join(named, F.col("fp") == F.col("print")).select("doc_id", "text_key", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


GROUP_WORK = 200_000_000  # members times shingles of a band that one task takes
ROWS_A_BAND, BANDS = 5, 24  # at a similarity of 0.8 two texts share a band with 1 - 7e-5, above it with more
_MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(ROWS_A_BAND * BANDS)], np.uint64)
_ADD = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(ROWS_A_BAND * BANDS)], np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima; none for the empty set."""
    if not len(hashes):
        return []
    low = np.full(len(_MIX), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 4096):
        h = hashes[i : i + 4096, None] * _MIX[None, :] + _ADD[None, :]
        low = np.minimum(low, h.min(axis=0))
    rows = low.reshape(BANDS, ROWS_A_BAND)
    return [_signed(xxhash.xxh64_intdigest(r.tobytes(), k)) for k, r in enumerate(rows)]


def _prints(shingle):
    def run(batches):
        for b in slices(batches, most=1_000_000):
            fps, keys = [], []
            for t in b.column("text").to_pylist():
                h = shingle_hashes(t, shingle)
                fps.append(_signed(majority(h)))
                keys.append(bands(np.unique(h)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "fp", "bands"])

    return run


def _shingle_sets(shingle):
    def run(batches):
        for b in slices(batches, most=1_000_000):
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(sets, pa.list_(pa.int64()))], names=["k", "grams"])

    return run


def _similar(keyed: DataFrame, pairs: DataFrame, shingle: int, min_similarity: float) -> DataFrame:
    """Those of the pairs (a, b: text keys) whose shingle sets have the Jaccard similarity."""
    need = materialize(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct())
    grams = keyed.select(F.col("text_key").alias("k"), "text").join(small(need), "k", "left_semi").dropDuplicates(["k"])
    grams = materialize(arrow_map(grams, _shingle_sets(shingle), "k long, grams array<long>"))
    side = lambda c: grams.select(F.col("k").alias(c), F.col("grams").alias("grams_" + c))
    common, either = F.size(F.array_intersect("grams_a", "grams_b")), F.size("grams_a") + F.size("grams_b")
    held = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", common.alias("common"), either.alias("sum"))
    # both empty: equal texts without words
    found = materialize(held.where(F.col("common") >= (F.col("sum") - F.col("common")) * min_similarity).select("a", "b"))
    discard(need)
    discard(grams)
    return found


def _paired(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


class _Search:
    """Links between texts found so far, and the pairs that need no second look."""

    def __init__(self, keyed: DataFrame, shingle: int, min_similarity: float):
        self.keyed, self.shingle, self.min_similarity = keyed, shingle, min_similarity
        self.held = self.done = self.groups = None

    def check(self, pairs: DataFrame) -> bool:
        """Check pairs (a, b) that were not checked before; whether there were any."""
        pairs = pairs.distinct()
        pairs = materialize(pairs if self.done is None else pairs.join(self.done, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return False
        self.done = pairs if self.done is None else self.done.union(pairs)
        found = _similar(self.keyed, pairs, self.shingle, self.min_similarity)
        self.held = found if self.held is None else self.held.union(found)
        return True

    def links(self, none: DataFrame) -> DataFrame:
        return none.limit(0) if self.held is None else self.held

    def split(self, members: DataFrame) -> DataFrame:
        """The members (band, k, company) of bands that are in different components, with their
        roots and how many they are. Pairs within a component could change nothing."""
        if self.held is None:
            now = members.withColumn("root", F.col("k"))
        else:
            if self.groups is not None:
                discard(self.groups)
            self.groups = groups = materialize(connected_components(self.held.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
            now = members.join(small(groups), F.col("k") == F.col("node"), "left").select("band", "k", "company", F.coalesce("root", "k").alias("root"))
        open_ = now.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", "n")
        return materialize(now.join(open_, "band"))


def _group_links(min_similarity):
    """Links that join the members of one band: common shingles are counted through postings."""

    def run(table: pa.Table) -> pa.Table:
        k, root = table.column("k").to_pylist(), table.column("root").to_pylist()
        grams = table.column("grams").combine_chunks()
        sizes = np.diff(grams.offsets.to_numpy())
        owner = np.repeat(np.arange(len(k)), sizes)
        _, gram = np.unique(grams.flatten().to_numpy(), return_inverse=True)
        order = np.argsort(gram, kind="stable")
        holders, ends = owner[order], np.cumsum(np.bincount(gram))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        name = dict(zip(root, range(len(root))))
        group = np.array([name[r] for r in root])
        out: list[tuple[int, int]] = []
        for i in range(len(k) - 1):
            own = gram[at[i] : at[i + 1]]
            n = ends[own] - starts[own]
            place = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(holders[place], minlength=len(k))
            near = np.flatnonzero((common >= (sizes + sizes[i] - common) * min_similarity) & (group != group[i]))
            for j in near[near > i].tolist():
                if group[j] != group[i]:
                    out.append((min(k[i], k[j]), max(k[i], k[j])))
                    group[group == group[j]] = group[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _banded_links(prints: DataFrame, keyed: DataFrame, first: DataFrame, shingle: int, min_similarity: float, stars: int = 2, work: int = GROUP_WORK) -> DataFrame:
    """Links (a, b) that hold, with the pairs `first` among the candidates: as components they
    equal those of all pairs of texts in a common band.

    Each band's members meet one leader (first the one with most company), and only bands whose
    members are still in different components get another leader; so a large group of near copies
    costs a star and no square. Bands that are open after `stars` rounds (texts that share much,
    but not enough) are solved in one task each, where no pairs are made, if their members times
    their shingles are at most `work` (bands with the same members once). What is beyond that is
    compared pair by pair.
    """
    texts = prints.groupBy("text_key").agg(F.first("bands").alias("bands"))
    every = texts.select(F.col("text_key").alias("k"), F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(every.join(shared, "band"))
    company = materialize(members.groupBy("k").agg(F.sum("n").alias("company")))
    left = materialize(members.join(small(company), "k").withColumn("root", F.col("k")))
    search = _Search(keyed, shingle, min_similarity)
    for turn in range(stars):
        if turn:
            old, left = left, search.split(members)  # members are rows of the old one
            discard(old)
            if left.isEmpty():
                return search.links(first)
        rank = F.struct("company", "k") if not turn else F.struct(F.xxhash64("k", F.lit(turn)), "k")
        leader = materialize(left.groupBy("band").agg(F.max_by(F.struct("k", "root"), rank).alias("l")))
        met = left.join(small(leader), "band").where("root <> l.root").select(*_paired("k", "l.k"))
        search.check(met if turn else met.union(first))
        discard(leader)
        members = left.where("n > 2").select("band", "k", "company")  # a band of two has met
    left = search.split(members)
    if left.isEmpty():
        return search.links(first)
    alike = left.groupBy("band").agg(F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("sig"), F.first("n").alias("n"))
    once = small(materialize(alike.groupBy("sig", "n").agg(F.min("band").alias("band")).select("band")))
    left = left.join(once, "band", "left_semi").select("band", "k", "root", "n")
    need = small(materialize(left.select("k").distinct()))
    rows = keyed.select(F.col("text_key").alias("k"), "text").join(need, "k", "left_semi").dropDuplicates(["k"])
    grams = materialize(arrow_map(rows, _shingle_sets(shingle), "k long, grams array<long>"))
    load = left.join(small(materialize(grams.select("k", F.size("grams").alias("size")))), "k").groupBy("band").agg((F.sum("size") * F.first("n")).alias("work"))
    load = small(materialize(load))
    apart = left.join(load.where(F.col("work") <= work).select("band"), "band", "left_semi").join(grams, "k").select("band", "k", "root", "grams")
    search.held = search.links(first).union(materialize(apart.groupBy("band").applyInArrow(_group_links(min_similarity), "a long, b long")))
    large = left.join(load.where(F.col("work") > work).select("band"), "band", "left_semi")
    x, y = large.select("band", F.col("k").alias("x"), F.col("root").alias("rx")), large.select("band", F.col("k").alias("y"), F.col("root").alias("ry"))
    search.check(x.join(y, "band").where("x < y and rx <> ry").select(*_paired("x", "y")))
    return search.held


def keep_one(docs: DataFrame, shingle: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies, with all columns of docs: the least doc_id.

    Links are proposed by fingerprints within two bits (Golay keys) and, because texts of
    similarity 0.8 differ in about 10 of 64 bits, by bands of minima of the shingle hashes; a
    link holds if the Jaccard similarity of the two texts' shingle sets is min_similarity or
    more (two texts without words are equal). Groups are the components of the links that hold.
    A null doc_id stays only in a group without others; of rows equal in doc_id and text one stays.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", key.alias("text_key"), "text")
    prints = materialize(arrow_map(keyed, _prints(shingle), "doc_id long, text_key long, fp long, bands array<long>"))
    texts = materialize(prints.groupBy("fp", "text_key").agg(F.count("*").alias("n")))
    fps = materialize(texts.groupBy("fp").agg(F.min("text_key").alias("rep"), F.count("*").alias("texts")))
    same = texts.join(fps.where("texts > 1").select("fp", "rep"), "fp").where("text_key <> rep").select(*_paired("rep", "text_key"))
    linked = materialize(links(fps))
    rep = lambda c: fps.select(F.col("fp").alias(c), F.col("rep").alias(c + "_rep"))
    other = linked.join(rep("src"), "src").join(rep("dst"), "dst").select(*_paired("src_rep", "dst_rep"))
    held = _banded_links(prints, keyed, materialize(same.union(other)), shingle, min_similarity)
    groups = connected_components(held.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    ids = prints.groupBy("text_key", "doc_id").agg(F.count("*").alias("n"))
    grouped = materialize(ids.join(small(materialize(groups)), F.col("text_key") == F.col("node"), "left").select("doc_id", "text_key", "n", F.coalesce("root", "text_key").alias("root")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = materialize(grouped.groupBy("root").agg(F.min(order).alias("stays"), F.count("*").alias("members")).where("members > 1").select("root", "stays"))
    gone = grouped.join(small(first), "root").where(~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_key") == F.col("stays.text_key"))))
    gone = small(materialize(gone.select(F.col("doc_id").alias("_lw_id"), F.col("text_key").alias("_lw_key"))))
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_lw_id"]) & (key == gone["_lw_key"]), "left_anti")
    twice = grouped.where("n > 1")
    return kept if twice.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
