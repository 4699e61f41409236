"""Toxicity by weak supervision.

Voters are lexicons and patterns, three of them lexicons that are induced from a bounded sample
of labelled rows. Each fires or not, so a document has one of 2^VOTERS patterns, and the counts
of the patterns over all documents are the label model's main input. The label model is
generative: a hidden label, and for each label a tree of voters (Chow-Liu: the strongest
conditional dependences), so that a voter's accuracy and its correlation with one other voter
are both estimated, by expectation maximisation over all documents, in which a labelled row is one
document whose label is known. The posterior labels of the sample train a logistic classifier on
words and votes, which then scores every document; a row's own label, which can be wrong, counts
half in its posterior.

Labels are read only outside the held-out fold (crc32(doc_id) mod 5 is not 0), at most
SAMPLE_ROWS of them by a hash, one row an id. Word counts, induction and the vocabulary are
aggregated by the cluster; the driver gets the vocabulary and the sample's word numbers. Defined cases: a very long
text is one set of words; ties of words go by code point; null or empty text gets the
classifier's score of no word; null doc_id counts as held out; without labelled rows the
lexicons alone drive the model; repeated rows get equal scores; an empty table gives an empty
result; other columns, also such as are named like the labels', are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import arrow_map, materialize, slices

SAMPLE_ROWS, VOCABULARY, ROUNDS, VOTE_L2, WORD_L2 = 6000, 20_000, 300, 0.2, 60.0
# Lexicons: plain word lists of this operator
INSULT_NAMES = frozenset("idiot idiots moron morons fool fools loser losers clown clowns imbecile dumbass jerk scumbag dimwit halfwit cretin".split())
INSULT_SLURS = frozenset("scum vermin filth filthy swine pig parasite parasites degenerate degenerates bastard bitch asshole".split())
INSULT_TRAITS = frozenset("stupid pathetic worthless disgusting dumb useless ignorant ugly brainless hopeless revolting repulsive".split())
REFUSE = frozenset("trash garbage rubbish crap shit bullshit".split())
HOSTILE = frozenset("hate hates kill killing destroy murder threaten".split())
FOREIGN = frozenset("crétin imbécile salaud ordure connard stupide idiote dumm dummkopf trottel arschloch abschaum wertlos estúpido estúpida idiota imbécil basura escoria inútil".split())
LEXICONS = (INSULT_NAMES, INSULT_SLURS, INSULT_TRAITS, REFUSE, HOSTILE, FOREIGN)
ADDRESS = re.compile(r"\b(?:you(?:'re| are)?|such|total|complete) (?:an? |all )?(?:%s)\b" % "|".join(sorted(INSULT_NAMES | INSULT_SLURS | INSULT_TRAITS)))
INDUCED = 3
VOTERS = len(LEXICONS) + INDUCED + 3
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def terms_of(words: set[str]) -> set[str]:
    """The words and their beginnings of 4 to 7 letters, which are marked by a star."""
    return words | {w[:k] + "*" for w in words for k in range(4, min(8, len(w)))}


def votes(text: str | None, words: set[str], induced: list[frozenset[str]]) -> int:
    """Bit k is set if voter k fires."""
    hits: list = [words & lex for lex in LEXICONS]
    if induced:
        terms = terms_of(words)
        hits += [not terms.isdisjoint(lex) for lex in induced]
    fired = [bool(h) for h in hits] + [False] * (INDUCED - len(induced))
    some = sum(map(len, hits[: len(LEXICONS)]))
    fired.append(some >= 2)
    fired.append(bool(some) and bool(ADDRESS.search((text or "").lower())))
    fired.append(bool(some) and 3 * sum(map(str.isupper, text)) > len(text))
    return sum(1 << k for k, f in enumerate(fired) if f)


def induced_terms(counts: DataFrame, n1: int, n0: int, most: int = 300) -> list[frozenset[str]]:
    """Words and beginnings of words that mark the sample's toxic rows (term, toxic, clean: in how
    many rows), dealt to three voters."""
    p = n1 / max(1, n1 + n0)
    k, n = F.col("toxic"), F.col("toxic") + F.col("clean")
    marks = (k >= 6) & (k >= 0.8 * n) & (k - n * p >= 6 * F.sqrt(n * p * (1 - p)))
    rate = (k / max(1, n1)) / ((F.col("clean") + 0.5) / max(1, n0))
    chosen = sorted(r["term"] for r in counts.where(marks).orderBy(F.desc(rate), "term").limit(most).collect())
    return [frozenset(chosen[k::INDUCED]) for k in range(INDUCED)]


def label_model(counts: dict[int, int], known: dict[tuple[int, int], int], prior: float = 0.1, rounds: int = 8) -> dict[int, float]:
    """P(toxic | votes) for each pattern, by the tree model.

    counts: how often a pattern is in all documents; known: how often it has a label in the sample.
    A labelled row counts as one document whose label is known; the rest is the agreement of the
    voters over all documents. The labelled rows' votes give the first estimates.
    """
    patterns = np.array(sorted(counts.keys() | {p for p, _ in known}))
    n = np.array([counts.get(p, 0) for p in patterns.tolist()], float)
    seen = np.array([[known.get((p, y), 0) for p in patterns.tolist()] for y in (0, 1)], float)
    anchored = seen.sum() > 0
    n = np.maximum(n - seen.sum(0), 0)
    prior = float(np.clip(seen[1].sum() / seen.sum(), 0.001, 0.5)) if anchored else prior
    x = (patterns[:, None] >> np.arange(VOTERS)) & 1
    silent = x.sum(1) == 0
    post = np.where(silent, 0.02, 0.9)
    for step in range(rounds):
        like = np.zeros((2, len(patterns)))
        for y in (0, 1):
            w = seen[y] + (0 if anchored and not step else n * (post if y else 1 - post))  # first the labelled rows alone
            total = w.sum() + 1
            one = (x.T @ w + 0.1) / (total + 0.2 - 1)
            both = ((x * w[:, None]).T @ x + 0.02) / (total + 0.08 - 1)
            cell = [np.clip(1 - one[:, None] - one[None, :] + both, 1e-9, 1), np.clip(one[None, :] - both, 1e-9, 1), np.clip(one[:, None] - both, 1e-9, 1), np.clip(both, 1e-9, 1)]
            side = [np.clip(1 - one, 1e-9, 1), np.clip(one, 1e-9, 1)]
            gain = sum(c * np.log(c / (side[k >> 1][:, None] * side[k & 1][None, :])) for k, c in enumerate(cell))
            like[y] = np.log(np.where(x[:, 0] == 1, side[1][0], side[0][0]))
            inside, outside = [0], list(range(1, VOTERS))  # the greatest spanning tree, from voter 0
            while outside:
                a, b = max(((i, j) for i in inside for j in outside), key=lambda e: (gain[e], -e[0], -e[1]))
                for u in (0, 1):
                    for v in (0, 1):
                        p = np.clip(cell[2 * u + v][a, b] / side[u][a], 1e-6, 1)
                        at = (x[:, a] == u) & (x[:, b] == v)
                        like[y][at] += np.log(p)
                inside.append(b)
                outside.remove(b)
        odds = np.log(prior / (1 - prior)) + like[1] - like[0]
        # voters are one-sided: silence is never evidence for toxicity
        post = np.where(silent, np.minimum(prior, 0.05), 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        prior = float(np.clip(((n * post).sum() + seen[1].sum()) / max(1, n.sum() + seen.sum()), 0.001, 0.5))
    return dict(zip(patterns.tolist(), post.tolist()))


def fit(rows: np.ndarray, cols: np.ndarray, size: int, y: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Logistic regression on 0/1 features (cols of rows) with soft labels; the last weight is the
    constant. Steps shrink to nothing, so that the order of sums makes no difference that counts."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(rows, w[cols], len(y)) + w[-1]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(cols, g[rows], size) + l2 * w[:-1], g.sum()) / max(1, len(y))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (1 - step / (ROUNDS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def _counted(make):
    """How many of a task's rows have each term, by label."""

    def run(batches):
        seen: dict[str, list[int]] = {}
        for b in slices(batches):
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                for w in make(words_of(t)):
                    seen.setdefault(w, [0, 0])[bool(y)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([c[1] for c in seen.values()], pa.int64()), pa.array([c[0] for c in seen.values()], pa.int64())], names=["term", "toxic", "clean"])

    return run


def _same(words: set[str]) -> set[str]:
    return words


def _features(shared):
    """Each sample row's label, votes and word numbers."""

    def run(batches):
        induced, vocab = shared.value
        for b in slices(batches):
            text = b.column("text").to_pylist()
            words = [words_of(t) for t in text]
            marks = pa.array([votes(t, w, induced) for t, w in zip(text, words)], pa.int32())
            ids = pa.array([sorted(vocab[x] for x in w if x in vocab) for w in words], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("toxic"), marks, ids], names=["id", "toxic", "mark", "ids"])

    return run


def _patterns(induced):
    def run(batches):
        seen: dict[int, int] = {}
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                p = votes(t, words_of(t), induced)
                seen[p] = seen.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    return run


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> dict:
    spark = docs.sparkSession
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (rest != held)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = materialize(ids.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(SAMPLE_ROWS))
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).join(F.broadcast(ids), "doc_id")  # SAMPLE_ROWS ids at most
    first = rows.groupBy("doc_id").agg(F.min("h").alias("h"))  # of rows that share an id the one with the least hash is the sample's
    rows = rows.join(F.broadcast(first), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "toxic", "text")
    labelled = materialize(rows)
    n1, n0 = labelled.agg(F.count_if(F.col("toxic") != 0), F.count_if(F.col("toxic") == 0)).first()
    summed = lambda df, make: arrow_map(df, _counted(make), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    induced = induced_terms(summed(labelled, terms_of), n1, n0)
    common = summed(labelled, _same).select("term", (F.col("toxic") + F.col("clean")).alias("n")).where("n >= 3").orderBy(F.desc("n"), "term").limit(VOCABULARY).collect()
    vocab = {w: VOTERS + k for k, w in enumerate(sorted(r["term"] for r in common))}
    counted = arrow_map(docs.select("text"), _patterns(induced), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 2^VOTERS rows
    got = arrow_map(labelled, _features(spark.sparkContext.broadcast((induced, vocab))), "id long, toxic int, mark int, ids array<int>").orderBy("id").toArrow()
    marks, known = got.column("mark").to_pylist(), {}
    for p, y in zip(marks, got.column("toxic").to_pylist()):
        if y is not None:
            known[p, int(y != 0)] = known.get((p, int(y != 0)), 0) + 1
    model = label_model({r["pattern"]: r["n"] for r in counted}, known) if counted else {}
    soft = np.array([(model[p] + (y != 0)) / 2 for p, y in zip(marks, got.column("toxic").to_pylist())])
    size = VOTERS + len(vocab)
    if len(marks):
        lists = got.column("ids").combine_chunks()
        fired = [(i, k) for i, p in enumerate(marks) for k in range(VOTERS) if p >> k & 1]
        at = np.concatenate([np.repeat(np.arange(len(marks)), np.diff(lists.offsets.to_numpy())), np.array([i for i, _ in fired], np.int64)])
        cols = np.concatenate([lists.flatten().to_numpy(), np.array([k for _, k in fired], np.int64)]).astype(np.int64)
        w = fit(at, cols, size, soft, np.append(np.full(VOTERS, VOTE_L2), np.full(len(vocab), WORD_L2)))
    else:
        w = np.append(np.full(VOTERS, 4.0), -3.0)
    return {"induced": induced, "votes": w[:VOTERS], "words": {x: float(w[k]) for x, k in vocab.items() if abs(w[k]) > 1e-6}, "constant": float(w[-1])}


def _score(model):
    def run(batches):
        m = model.value
        for b in slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                p = votes(t, words, m["induced"])
                z = m["constant"] + sum(float(m["votes"][k]) for k in range(VOTERS) if p >> k & 1) + sum(m["words"][x] for x in sorted(words & m["words"].keys()))
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, held))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(True))
    return arrow_map(docs.select("doc_id", out.alias("held_out"), "text"), _score(model), "doc_id long, held_out boolean, score double, predicted int")
