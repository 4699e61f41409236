"""Language identification by nearest centroids.

Texts become hashed byte 3-grams of their lower-case letters (words apart by one blank); a
vector has the weights (1 + ln tf) x idf and length 1. The idf counts all training documents.
Each language gets up to `clusters` centroids by spherical k-means over a bounded sample of its
training rows (PER_LANGUAGE a language by a hash of doc_id, at most 2 x SAMPLE_ROWS ids in all:
documented parameters; equal texts of a language count once). A document takes
the language of the centroid with the greatest cosine; score is that language's share of the
languages' softmax. A best cosine below the language's distance bound (the QUANTILE of the
training sample's cosines) marks the row as rejected: the nearest language stays the prediction.

Defined cases: null text, or no letter (Unicode category L): `und`, score 0; a very long text is
one vector of DIMS dimensions like any other; null lang trains nothing; no training
row at all: every row is `und`; ties go to the language first in code-point order; repeated rows
get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import arrow_map, slices

DIMS, CLUSTERS, PER_LANGUAGE, SAMPLE_ROWS, QUANTILE, SHARP = 1 << 14, 4, 500, 4000, 0.01, 20.0
_LETTERS = regex.compile(r"\p{L}+")


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(dimensions, how often) of the 3-grams, or None without a letter."""
    words = _LETTERS.findall((text or "").lower())
    if not words:
        return None
    a = np.frombuffer((" " + " ".join(words) + " ").encode(), np.uint8).astype(np.uint32)
    code = a[:-2] << 16 | a[1:-1] << 8 | a[2:]
    dims = (code * np.uint32(2654435769)) >> np.uint32(18)
    n = np.bincount(dims, minlength=DIMS)
    at = np.flatnonzero(n)
    return at, n[at]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    got = counts(text)
    if got is None:
        return None
    at, n = got
    w = (1 + np.log(n)) * idf[at]
    return at, w / max(np.sqrt((w * w).sum()), 1e-12)


def _frequencies(batches):
    n, df = 0, np.zeros(DIMS, np.int64)
    for b in slices(batches):
        for t in b.column("text").to_pylist():
            got = counts(t)
            if got is not None:
                n += 1
                df[got[0]] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIMS), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["dim", "n"])


def _sample(batches):
    for b in slices(batches):
        lang, dims, ns = [], [], []
        for l, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            got = counts(t)
            if got is not None:
                lang.append(l)
                dims.append(got[0])
                ns.append(got[1])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(dims, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int32()))], names=["lang", "dims", "ns"])


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; rows of x have length 1."""
    unit = lambda c: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        near = (x @ x[seeds].T).max(1)
        if near.min() > 1 - 1e-9:
            break
        seeds.append(int(np.argmin(near)))
    c = x[seeds]
    for _ in range(15):
        own = (x @ c.T).argmax(1)
        c = unit(np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def train(docs: DataFrame, folds: int, held: int) -> dict:
    """The model from documents with a language outside the held-out fold."""
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (rest != held))
    freq = arrow_map(rows.select("text"), _frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # at most DIMS + 1 rows
    df = np.zeros(DIMS + 1, np.int64)
    for r in freq:
        df[r["dim"]] = r["n"]
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS).collect()
    each = max(1, min(PER_LANGUAGE, SAMPLE_ROWS // max(1, len(langs))))
    share = F.lit(0.0)
    for r in langs:
        share = F.when(F.col("lang") == r["lang"], F.lit(each / r["n"])).otherwise(share)
    draw = (F.xxhash64("doc_id", F.lit("language")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
    # about `each` rows a language; the bound on all is over narrow rows, in the order of the draw
    drawn = rows.where(draw < share).select("doc_id", draw.alias("draw")).orderBy("draw", "doc_id").limit(2 * SAMPLE_ROWS).select("doc_id").distinct()
    picked = rows.join(F.broadcast(drawn), "doc_id").select("lang", F.xxhash64("text").alias("h"), "text").dropDuplicates(["lang", "h"])
    got = arrow_map(picked.select("lang", "text"), _sample, "lang string, dims array<int>, ns array<int>").toArrow().combine_chunks()
    by: dict[str, list[int]] = {}
    for i, l in enumerate(got.column("lang").to_pylist()):
        by.setdefault(l, []).append(i)
    names = sorted(by)
    cents, owner, bounds = [], [], []
    for k, name in enumerate(names):
        x = np.zeros((len(by[name]), DIMS), np.float32)  # one language at a time
        for j, i in enumerate(by[name]):
            dims, ns = (got.column(c)[i].values.to_numpy() for c in ("dims", "ns"))
            w = (1 + np.log(ns)) * idf[dims]
            x[j, dims] = w / np.linalg.norm(w)
        x = np.stack(sorted(x, key=lambda v: v.tobytes()))
        c = _means(x, CLUSTERS)
        cents.append(c)
        owner += [k] * len(c)
        bounds.append(float(np.quantile((x @ c.T).max(1), QUANTILE)))
    return {"langs": names, "idf": idf, "centroids": np.concatenate(cents) if cents else np.zeros((0, DIMS)), "owner": np.array(owner, int), "bounds": bounds}


def _predict(model):
    def run(batches):
        m = model.value
        for b in slices(batches):
            lang, score, far = [], [], []
            for t in b.column("text").to_pylist():
                v = vector(t, m["idf"]) if m["langs"] else None
                if v is None:
                    lang.append("und")
                    score.append(0.0)
                    far.append(True)
                    continue
                cos = m["centroids"][:, v[0]] @ v[1]
                best = np.array([cos[m["owner"] == k].max() for k in range(len(m["langs"]))])
                k = int(best.argmax())
                e = np.exp(SHARP * (best - best[k]))
                lang.append(m["langs"][k])
                score.append(float(1 / e.sum()))
                far.append(bool(best[k] < m["bounds"][k]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, folds, held))  # DIMS x CLUSTERS x languages
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    return arrow_map(docs.select("doc_id", out.alias("held_out"), "text"), _predict(model), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
