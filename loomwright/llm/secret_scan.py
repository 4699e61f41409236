"""Secret scans with a trigram index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived (an OR of ANDs:
what every match must contain, case folded). The index has a posting (trigram, document) for
each trigram of the queries that a document holds. Postings meet the clauses of the queries in
an equi-join and are intersected by counting, which gives each document's candidate rules; only
these are verified by their expressions. Rules without a mandatory trigram (runs of hexadecimal
digits) scan every text.

Spans are kind:start:end in code points, end exclusive, matches leftmost and not overlapping
within a kind; spans of different kinds may overlap. Defined cases: null text is empty and has
no spans; a null doc_id has no postings, so its text is verified for every rule; rows with equal
doc_id share their candidates, which verification makes exact; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import materialize, small


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # characters of that group
    guard: str = ""  # a cheaper pattern that every match contains


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # runs of one class are whole runs either way, so a least length in the pattern equals dropping short matches
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("stripe", r"sk_live_[0-9a-zA-Z]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE
MOST = 64  # strings that a stretch of a pattern may expand to


_TIMES = re.compile(r"([*+?])|\{(\d+)(?:(,)(\d*))?\}")


def _one(p: str, i: int) -> tuple[str | None, int]:
    """The character at i and what follows; None for an escape that stands for a class."""
    if p[i] != "\\":
        return p[i], i + 1
    if p[i + 1] == "x":
        return chr(int(p[i + 2 : i + 4], 16)), i + 4
    return (None if p[i + 1] in "dDwWsSbBAZ" else {"n": "\n", "t": "\t", "r": "\r"}.get(p[i + 1], p[i + 1])), i + 2


def parse(p: str, i: int = 0):
    """(alternatives, end) of a pattern from i on: lists of (what, least, most), where what is a set
    of lower-case characters, the alternatives of a group, or None for anything else."""
    out: list[list] = [[]]
    while i < len(p) and p[i] != ")":
        if p[i] == "|":
            out.append([])
            i += 1
            continue
        if p.startswith("(?i)", i):
            i += 4
            continue
        what: set[str] | list | None
        if p[i] == "(":
            what, i = parse(p, i + (3 if p.startswith("(?:", i) else 1))
            i += 1
        elif p[i] == "[":
            i, what = i + 1, set()
            if p[i] == "^":
                i, what = i + 1, None
            while p[i] != "]":
                c, i = _one(p, i)
                if p[i] == "-" and p[i + 1] != "]":  # a range
                    _, i = _one(p, i + 1)
                    c = None
                what = None if c is None or what is None else what | {c.lower()}
            i += 1
        elif p[i] in ".^$":
            what, i = None, i + 1
        else:
            c, i = _one(p, i)
            what = None if c is None else {c.lower()}
        low = high = 1
        if m := _TIMES.match(p, i):
            i = m.end()
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[1]] if m[1] else (int(m[2]), int(m[4]) if m[4] else None if m[3] else int(m[2]))
            i += i < len(p) and p[i] in "?+"  # lazy or possessive: the same strings
        out[-1].append((what, low, high))
    return out, i


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of trigrams, one of which every match holds whole; empty if there is no such thing."""
    best: list[frozenset[str]] = []

    def weigh(strings: set[str]) -> None:
        nonlocal best
        clauses = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
        if clauses and all(clauses) and (not best or min(map(len, clauses)) > min(map(len, best))):
            best = list(dict.fromkeys(clauses))

    def expand(items) -> set[str] | None:
        """Every string that the items match, or None; on the way stretches are weighed."""
        now: set[str] = {""}
        whole = True
        for what, low, high in items:
            part = None
            if (low, high) in ((1, 1), (0, 1)):
                part = every(what) if isinstance(what, list) else what
                part = part if part is None or low else part | {""}
            if part is not None and len(now) * len(part) <= MOST:
                now = {a + b for a, b in product(now, part)}
            else:
                weigh(now)
                whole, now = False, part if part is not None else {""}
        if not whole:
            weigh(now)
            return None
        return now

    def every(branches) -> set[str] | None:
        nonlocal best
        if len(branches) == 1:
            return expand(branches[0])
        before = best
        each = [expand(x) for x in branches]
        best = before  # what one branch must hold, another need not
        return None if any(x is None for x in each) else set().union(*each)

    got = every(parse(pattern)[0])
    if got is not None:
        weigh(got)
    return best


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<s, k, e>> of the rule's spans: the text between the matches gives the places."""
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    sizes = F.zip_with(F.transform(between, F.length), F.transform(found, F.length), lambda a, b: F.struct(a.alias("gap"), b.alias("len")))
    sizes = F.zip_with(sizes, F.transform(counts, F.length), lambda a, b: F.struct(a["gap"].alias("gap"), a["len"].alias("len"), b.alias("n")))
    start = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<s:int,k:int,e:int>>").alias("out"))

    def step(acc, x):
        s = acc["p"] + x["gap"]
        e = s + F.coalesce(x["len"], F.lit(0))
        one = F.struct(s.alias("s"), F.lit(order).alias("k"), e.alias("e"))
        return F.struct(e.alias("p"), F.when(x["n"] >= rule.least, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (trigram, doc_id) for each document that holds the trigram, case folded."""
    low = docs.where("doc_id is not null and text is not null").select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", F.explode(held).alias("trigram")).select("trigram", "doc_id")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, mask): bit k is set if the document holds a whole clause of rule k."""
    clauses = [(k, c, t, len(ts)) for k, r in enumerate(rules) for c, ts in enumerate(trigram_query(r.pattern)) for t in sorted(ts)]
    spark = docs.sparkSession
    query = F.broadcast(spark.createDataFrame(clauses, "rule int, clause int, trigram string, need int"))  # fixed by the rules
    index = postings(docs, sorted({c[2] for c in clauses}))
    whole = index.join(query, "trigram").groupBy("doc_id", "rule", "clause", "need").agg(F.count_distinct("trigram").alias("n")).where("n = need")
    return whole.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("mask"))


def all_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found: array<struct<s, k, e>> by start, then rule."""
    every = sum(1 << k for k, r in enumerate(rules) if not trigram_query(r.pattern))
    found = small(materialize(candidates(docs, rules)).withColumnRenamed("doc_id", "_lw_id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(found, F.col("doc_id") == F.col("_lw_id"), "left")
    mask = F.when(F.col("doc_id").isNull(), F.lit((1 << len(rules)) - 1)).otherwise(F.coalesce("mask", F.lit(0)).bitwiseOR(F.lit(every)))
    rows = rows.select("doc_id", "text", mask.alias("mask"))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    each = []
    for k, r in enumerate(rules):
        due = F.col("mask").bitwiseAND(F.lit(1 << k)) != 0
        if r.guard:
            due &= F.col("text").rlike(r.guard)
        each.append(F.when(due, spans_of(F.col("text"), r, k)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("found"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")
    n = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    base = F.filter("found", lambda x: x["k"] < len(BASE))
    return all_spans(docs, rules).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def oracle() -> str:
    """DuckDB SQL of `scan` with its default rules."""
    lists, spans = [], []
    for k, r in enumerate(RULES):
        q = r.pattern.replace("'", "''")
        lists.append(f"list_transform(string_split_regex(t, '{q}'), lambda x: length(x)) AS gap{k}, list_transform(regexp_extract_all(t, '{q}', 0), lambda x: length(x)) AS len{k}, list_transform(regexp_extract_all(t, '{q}', {r.group}), lambda x: length(x)) AS n{k}")
        before = f"coalesce(list_sum(gap{k}[1:i]), 0) + coalesce(list_sum(len{k}[1:i - 1]), 0)"
        spans.append(f"list_filter(list_transform(range(1, len(len{k}) + 1), lambda i: {{'s': CAST({before} AS BIGINT), 'k': {k}, 'e': CAST({before} + len{k}[i] AS BIGINT), 'n': n{k}[i]}}), lambda z: z.n >= {r.least})")
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    show = f"array_to_string(list_transform({{}}, lambda z: {kinds}[z.k + 1] || ':' || z.s || ':' || z.e), ',')"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, {', '.join(lists)} FROM d),
        f AS (SELECT doc_id, list_sort(flatten([{', '.join(spans)}])) AS found FROM m)
        SELECT doc_id, CAST(len(list_filter(found, lambda z: z.k = 0)) AS BIGINT) AS n_assign, CAST(len(list_filter(found, lambda z: z.k = 1)) AS BIGINT) AS n_access,
               CAST(len(list_filter(found, lambda z: z.k = 2)) AS BIGINT) AS n_hex, sha256(coalesce({show.format('list_filter(found, lambda z: z.k < 3)')}, '')) AS base_sha256,
               coalesce({show.format('found')}, '') AS spans
        FROM f"""
