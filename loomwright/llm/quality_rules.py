"""Quality rules: per-document base rules and cross-document line frequency.

What counts as a document here is a distinct text of a host: exact copies are one document, since
a thousand copies of one page would else make all its lines frequent and reject every copy.

Lines are normalised (lower case, single blanks, digits to 0) and hashed. For each host
(`source`) the distinct texts that hold a line are counted; a line in more texts than
max(min_docs, min(max_docs, share x the host's distinct texts)) is over the limit and is removed:
copies count once on both sides, and max_docs keeps the share from growing out of reach on a
large host. A document that
loses lines and keeps fewer than min_words_left words, or less than min_share_left of its
words, is depleted and rejected.

Defined cases: null text is a text without words (base_failed, not kept); null doc_id and null
source are values of their own; rows equal in doc_id and text are one document and get one
verdict each; copies of a text count once for a line, so copies alone never make it frequent.
Ties do not occur (a line is over its limit or not); a very long text is one row of line hashes.
An empty table gives an empty result; other columns are ignored here and kept by `apply_rules`.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import arrow_map, doc_key, materialize, out_batch, slices, small

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
MAX_DOCS = 100  # different texts of a host that may hold a line, however large the host
MIN_DOCS, HOST_SHARE, MIN_WORDS_LEFT, MIN_SHARE_LEFT = 20, 0.10, 20, 0.30
SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_DIGIT = re.compile(r"\d")
_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words)) + np.uint64(1)
    ids *= np.uint64(0xD6E8FEB86659FD93)
    ids ^= ids >> np.uint64(32)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += ids[k : k + n] * _ODD[k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def line_hash(line: str) -> int:
    raw = b" ".join(_DIGIT.sub("0", line.lower()).encode().split())
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def text_stats(text: str) -> dict:
    raw = text.encode()
    words = raw.split()
    seen, dup, lines = set(), 0, []
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            dup += line in seen
            seen.add(line)
            lines.append({"h": line_hash(line), "w": n})
    rep = repeat_words(words)
    return {
        "n_words": len(words), "word_chars": len(text) - (len(raw) - len(raw.translate(None, SPACES))),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)), "n_dup_lines": dup, "n_repeat_words": rep,
        "base_failed": len(words) < MIN_WORDS or 100 * rep > REPEAT_PERCENT * len(words), "lines": lines,
    }


BASE = "doc_id long, host long, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<struct<h: long, w: int>>"


def _base(batches):
    line = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("lines", line)])
    for b in slices(batches):
        got = [text_stats(t or "") for t in b.column("text").to_pylist()]
        cols = {c: b.column(c) for c in ("doc_id", "host", "text_key")}
        yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.array([g[f.name] for g in got], f.type) for f in schema], schema=schema)


def _keyed(docs: DataFrame) -> DataFrame:
    host = F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    return doc_key(docs.select("doc_id", "text", "source")).select("doc_id", host.alias("host"), "text_key", "text")


def assess(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, max_docs: int = MAX_DOCS) -> tuple[DataFrame, DataFrame]:
    """(a verdict for each row with its text_key, the lines over the limit: doc_id, text_key, removed)."""
    base = materialize(arrow_map(_keyed(docs), _base, BASE).withColumn("uid", F.monotonically_increasing_id()))
    lines = base.select("uid", "doc_id", "host", "text_key", F.explode("lines").alias("l")).select("uid", "doc_id", "host", "text_key", "l.h", "l.w")
    counted = lines.groupBy("host", "h", "text_key").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    hosts = base.groupBy("host", "text_key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("texts"))
    frequent = materialize(counted.join(hosts, "host").where(F.col("n") > F.least(F.col("texts") * host_share, F.lit(float(max_docs)))).select("host", "h"))
    over = lines.join(small(frequent), ["host", "h"]).groupBy("uid", "doc_id", "text_key").agg(F.collect_set("h").alias("removed"), F.sum("w").alias("lost"))
    over = materialize(over)
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    depleted = F.coalesce("lost", F.lit(0)) > 0
    depleted &= (left < MIN_WORDS_LEFT) | (left < F.col("n_words") * MIN_SHARE_LEFT)
    verdict = base.drop("lines", "host").join(small(over.select("uid", "lost")), "uid", "left")
    verdict = verdict.withColumn("lines_words_removed", F.coalesce("lost", F.lit(0))).withColumn("kept", ~F.col("base_failed") & ~depleted)
    return verdict.drop("uid", "lost"), over.groupBy("doc_id", "text_key").agg(F.first("removed").alias("removed"))


def _drop_lines(batches):
    for b in batches:
        at = b.schema.get_field_index("text")
        removed = b.column(b.schema.get_field_index("_lw_removed")).to_pylist()
        text = b.column(at).to_pylist()
        for i, r in enumerate(removed):
            if r:
                gone = set(r)
                text[i] = "\n".join(x for x in text[i].split("\n") if not x.encode().split() or line_hash(x) not in gone)
        cols = [pa.array(text, pa.string()) if k == at else b.column(k) for k in range(b.num_columns) if b.schema.names[k] != "_lw_removed"]
        names = [n for n in b.schema.names if n != "_lw_removed"]
        if "n_chars" in names and any(removed):
            k = names.index("n_chars")
            cols[k] = pa.array([len(t) if r else n for t, r, n in zip(text, removed, cols[k].to_pylist())], cols[k].type)
        yield pa.RecordBatch.from_arrays(cols, names=names)


def apply_rules(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """The kept documents without their lines over the limit, with all columns of docs."""
    verdict, over = assess(docs, min_docs, host_share, max_docs)
    bad = small(materialize(verdict.where(~F.col("kept")).select(F.col("doc_id").alias("_lw_id"), F.col("text_key").alias("_lw_key")).distinct()))
    over = small(materialize(over.toDF("_lw_id", "_lw_key", "_lw_removed")))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    same = lambda t: F.col("doc_id").eqNullSafe(t["_lw_id"]) & (key == t["_lw_key"])
    kept = docs.join(bad, same(bad), "left_anti")
    kept = kept.join(over, same(over), "left").select(*[kept[c] for c in docs.columns], "_lw_removed")
    return arrow_map(kept, _drop_lines, docs.schema)


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    verdict, _ = assess(docs, min_docs, host_share, max_docs)
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("lines_words_removed").cast("long").alias("words_removed"))


def oracle(min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, max_docs: int = MAX_DOCS) -> str:
    """verdicts in DuckDB's SQL, with the lines and windows themselves in place of their hashes."""
    word = r"[^\x20\x09-\x0D]+"
    found = lambda x: f"regexp_extract_all({x}, '{word}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source IS NULL AS none, coalesce(source, '') AS src, coalesce(text, '') AS text FROM documents),
    words AS (SELECT r, {found('text')} AS ws FROM d),
    wins AS (SELECT r, p, array_to_string(ws[p:p + {WINDOW - 1}], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM words) w),
    twice AS (SELECT r, win FROM wins GROUP BY r, win HAVING count(*) > 1),
    repeated AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(p, p + {WINDOW})) AS k FROM wins JOIN twice USING (r, win)) c GROUP BY r),
    lines AS (SELECT * FROM (SELECT r, none, src, text, unnest(string_split(text, chr(10))) AS line FROM d) s WHERE regexp_matches(line, '{word}')),
    dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
    normal AS (SELECT r, none, src, text, array_to_string({found("regexp_replace(lower(line), '[0-9]', '0', 'g')")}, ' ') AS line, len({found('line')}) AS w FROM lines),
    counted AS (SELECT none, src, line, count(DISTINCT text) AS n FROM normal GROUP BY none, src, line HAVING count(DISTINCT text) > {min_docs}),
    hosts AS (SELECT none, src, count(DISTINCT text) AS texts FROM d GROUP BY none, src),
    frequent AS (SELECT none, src, line FROM counted JOIN hosts USING (none, src) WHERE n > least(texts * {host_share}::DOUBLE, {float(max_docs)})),
    lost AS (SELECT r, sum(w)::BIGINT AS n FROM normal JOIN frequent USING (none, src, line) GROUP BY r),
    base AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, length(array_to_string(w.ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS words_removed
        FROM d JOIN words w USING (r) LEFT JOIN dup u USING (r) LEFT JOIN repeated p USING (r) LEFT JOIN lost l USING (r)),
    judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed, n_words - words_removed AS rest FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_removed,
        NOT base_failed AND NOT (words_removed > 0 AND (rest < {MIN_WORDS_LEFT} OR rest < n_words * {MIN_SHARE_LEFT}::DOUBLE)) AS kept FROM judged"""
