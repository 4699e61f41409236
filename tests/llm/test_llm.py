"""The operators on a small fixture with nulls, empty and very long texts, ties, repeated rows,
clashing column names, and empty tables; each against brute force, a round trip or held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import xxhash

from loomwright.llm import bpe, common, language_id, line_dedup, media, mixing, packing, quality_rules, secret_scan, simhash, toxicity
from loomwright.session import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, row int, text_key string, toxic string, lid int"
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = "\n".join(prose(60) for _ in range(60))
NEAR = prose(200)
TEXTS = [None, "", " \t\n", "one", LONG, NEAR, NEAR, NEAR + " tail", NEAR.replace(" ", "  "), "!!! 123 \n!!!", "ab " * 300,
         "x\n" + prose(15) + "\n" + prose(15), 'my api_key = "abcdEFGH12345678" and password:short', "AKIA" + "Z" * 16 + " " + "0f" * 20 + " token=a=b_c.d-e", "é" * 500, "日本語 🙂 text"]


def rows():
    out = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, 1, 2, "f", 3, "k", "t", 4) for i, t in enumerate(TEXTS)]
    return out + [out[5], out[5], (None, NEAR, None, None, None, None, None, None, None, None, None), (3, "same id, other text here", "en", "s0", 1, 2, "f", 3, "k", "t", 4)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((v is None, v) for v in r)


def test_simhash_brute_force(spark, docs, none, sf_dir):
    def brute(pairs):
        def fp(t):
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
            return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

        got = [(i, fp(t)) for i, t in pairs]
        fps = sorted({f for _, f in got})
        root = {f: f for f in fps}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a in fps:
            for b in fps:
                if a < b and (a ^ b).bit_count() <= 2:
                    root[find(a)] = find(b)
        least = {}
        for i, f in got:
            if i is not None:
                least[find(f)] = min(i, least.get(find(f), i))
        return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in got), key=key)

    for d in (docs, table(spark, sf_dir, "documents")):
        want = brute([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()])
        assert sorted(map(tuple, simhash.near_duplicates(d).collect()), key=key) == want
        small_buckets = simhash.components(d, bucket=1).select("doc_id", "component_id").collect()  # all through the exact keys
        assert sorted(map(tuple, small_buckets), key=key) == sorted([(i, c) for i, _, c in want], key=key)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[5] == 1 and not ids[6] and not ids[7] and ids[0] == 1 and not ids[1] and ids[4] == 1 and not ids[None]


def test_keep_one_brute_force(spark):
    """Near copies of similarity 0.7 to 1, and a group of 150 that meets in few bands or many."""
    r = random.Random(11)
    edit = lambda t, n: " ".join(r.choice(WORDS) + "x" if i in at else w for at in [set(r.sample(range(len(t.split())), n))] for i, w in enumerate(t.split()))
    texts = []
    for _ in range(60):
        base = prose(r.randint(40, 300))
        texts += [base] + [edit(base, r.randint(1, 1 + len(base.split()) // 25)) for _ in range(r.randint(0, 3))]
    hub = prose(300)
    texts += [edit(hub, 4) for _ in range(150)] + [hub + " " + prose(400) for _ in range(30)]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = sorted({find(i) for i in range(len(texts))})
    assert len(want) < len(texts) - 150
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(x.doc_id for x in simhash.keep_one(docs).collect()) == want


def test_bpe_equals_library(spark, docs, none):
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.round_trip(docs, RANKS).collect()}
    for r in docs.collect():
        t = r["text"] or ""
        ids = enc.encode_ordinary(t)
        x = got[r["doc_id"], hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()]
        assert x["n_tokens"] == len(ids) and x["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    c = bpe.Coder(ranks, bpe.merge_table(ranks), public_tokenizers.PATTERN)
    odd = ["a" * 1000, "x\x1cy \x1c", "½²³ 12", "b\x85\xa0 c", "ͅa ̀b", "don't I'LL", "abc" * 400, "١٢٣ Ⅷ", "\t\t x\r\n\r\n"]
    odd += ["".join(rng.choice("ab \n'\x1c\x85\xa0stdlé½1_-日🙂") for _ in range(rng.randint(0, 50))) for _ in range(500)]
    assert [i for i, _, _ in c.encode(odd)] == [" ".join(map(str, enc.encode_ordinary(t))) for t in odd]
    huge = ["a" * 100_000, "ab" * 5_000, "the" * 400, " " * 3_000 + "x", "日本" * 500, "0f" * 700] + ["".join(rng.choice(s) for _ in range(n)) for s in ("ab", "acgt", "etaoinshrdlu", "thequickbrown", "-=*") for n in (401, 1_500)]
    assert [i for i, _, _ in c.encode(huge)] == [" ".join(map(str, enc.encode_ordinary(t))) for t in huge]
    bpe.STEPPED, c2 = 0, bpe.Coder(ranks, bpe.merge_table(ranks), public_tokenizers.PATTERN)
    assert c2.encode(odd) == c.encode(odd)  # both queries give the same
    bpe.STEPPED = 400
    back = {r["doc_id"]: bytes(r["raw"]) for r in bpe.decode(bpe.encode(docs.where("doc_id > 3"), RANKS), RANKS).collect()}
    assert back[15].decode() == TEXTS[15] and back[4].decode() == LONG
    assert bpe.round_trip(none, RANKS).count() == 0


def test_bpe_learns_a_piece_once(monkeypatch):
    ranks = bpe.read_ranks(RANKS)
    c = bpe.Coder(ranks, bpe.merge_table(ranks), public_tokenizers.PATTERN)
    learnt = Counter()
    monkeypatch.setattr(c, "learn", lambda pieces: (learnt.update(pieces), c._keep([p.encode() for p in pieces], ((w, p.encode()) for w, p in enumerate(pieces)), ["0"] * len(pieces))))
    letters = str.maketrans("0123456789", "ghijklmnop")
    slices = [[" ".join(hex(n)[2:].translate(letters) for n in range(k, k + 20_000))] for k in range(0, 140_000, 20_000)]
    for part in slices + slices:  # as many as one generation of the cache takes
        c.encode(part)
    assert len(learnt) > 130_000 and set(learnt.values()) == {1}


def test_bpe_rows_out_of_order(monkeypatch):
    ranks = bpe.read_ranks(RANKS)
    make = lambda: bpe.Coder(ranks, bpe.merge_table(ranks), public_tokenizers.PATTERN)
    texts = [prose(30), "unsortable pieces 12345678901", "日本語 🙂"]
    whole = make().encode(texts)
    monkeypatch.setattr(bpe, "SORTED", bpe.SORTED.replace("e.w, e.p)", "e.w, e.p DESC)"))
    assert make().encode(texts) == whole and "DESC" in bpe.SORTED


def test_secret_spans(docs, none):
    def brute(t):
        out = []
        for k, r in enumerate(secret_scan.RULES):
            for m in re.finditer(r.pattern, t):
                if len(m[r.group]) >= r.least:
                    out.append((m.start(), k, r.kind, m.end()))
        return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))

    got = Counter((r["doc_id"], r["spans"]) for r in secret_scan.scan(docs).collect())
    assert got == Counter((r["doc_id"], brute(r["text"] or "")) for r in docs.collect())
    assert secret_scan.scan(none).count() == 0
    for r in secret_scan.RULES:
        for clause in secret_scan.trigram_query(r.pattern):
            assert all(len(t) == 3 for t in clause)
    assert not secret_scan.trigram_query("[0-9a-f]{32,}") and not secret_scan.trigram_query("(abcd[0-9]|xy)z")
    query = lambda p: {tuple(sorted(c)) for c in secret_scan.trigram_query(p)}
    assert query(r"a\.b{1}c\x41") == {(".bc", "a.b", "bca")} and query("(?i)(ABCD|wxyz)[0-9]+") == {("abc", "bcd"), ("wxy", "xyz")}
    for _ in range(300):  # every match holds all trigrams of some clause
        parts = [rng.choice(["abc", "xyz9", "(?:foo|barbaz)", "q?", "[mn]op", "[0-9]+", "k{2}", "tok_?en", r"\."]) for _ in range(rng.randint(1, 5))]
        made = "".join({"(?:foo|barbaz)": rng.choice(["foo", "barbaz"]), "q?": rng.choice(["q", ""]), "[mn]op": rng.choice("mn") + "op", "[0-9]+": str(rng.randint(0, 999)), "k{2}": "kk", "tok_?en": rng.choice(["token", "tok_en"]), r"\.": "."}.get(p, p) for p in parts)
        assert re.fullmatch("".join(parts), made)
        clauses = secret_scan.trigram_query("".join(parts))
        assert not clauses or any(all(t in made for t in c) for c in clauses), (parts, made, clauses)


def test_quality_rules(spark, docs, none):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep)

    got = Counter((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in quality_rules.verdicts(docs).collect())
    assert got == Counter((r["doc_id"], *brute(r["text"] or "")) for r in docs.collect())
    bad = "the very same menu line of this host"
    many = [(i, f"{bad}\n{prose(4)}\n{bad.upper()} 1" if i % 2 else f"{bad}\n{prose(80)}", "en", "h", 0) for i in range(60)]
    own = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long")
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(own).collect()}
    assert all(verdict[i] == (i % 2 == 0) for i in range(60))
    kept = quality_rules.apply_rules(own).collect()
    assert {r["doc_id"] for r in kept} == {i for i in range(60) if i % 2 == 0} and not any(bad in r["text"] for r in kept)
    assert all(r["n_chars"] == len(r["text"]) for r in kept)
    copies = spark.createDataFrame([(i, NEAR, "en", "h", 0) for i in range(60)], own.schema)
    assert quality_rules.apply_rules(copies).count() == 60  # copies alone never make a line frequent
    assert quality_rules.verdicts(none).count() == 0 and quality_rules.apply_rules(docs).columns == docs.columns


def test_quality_rules_skewed_hosts(spark):
    """Copies count once on both sides of the limit, and a large host's share has an upper bound."""
    bad = "a line of many pages"
    own = lambda host, n, m: [(f"{bad}\n{prose(30)} {i}" if i < m else f"{prose(30)} {i}", host) for i in range(n)]
    texts = own("copies", 210, 30) + [(NEAR, "copies")] * 200 + own("large", 1200, 110) + own("rare", 1200, 90)
    d = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(texts)], "doc_id long, text string, source string")
    held = Counter(r["source"] for r in quality_rules.apply_rules(d).collect() if bad in r["text"])
    assert held == {"rare": 90}


def test_line_dedup(spark, docs, none):
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in "ab")
        tau = rng.randint(1, 3)
        assert line_dedup.within(a, b, tau) == (distance(a, b) <= tau), (a, b, tau)
    base = [prose(8) for _ in range(40)]
    lines = base + [x[:7] + "Q" + x[7:] for x in base[:20]] + [x[:5] + x[7:] for x in base[10:30]] + [x[:3] + "ZZZ" + x[3:] for x in base[:5]]
    ids = {line_dedup.line_id(x): x for x in lines}
    got = {(r["a"], r["b"]) for r in line_dedup.link_lines(spark.createDataFrame(list(ids.items()), "lid long, line string")).collect()}
    assert got == {(a, b) for a in ids for b in ids if a < b and distance(ids[a], ids[b]) <= 2} and len(got) >= 40
    d = spark.createDataFrame([(2, f"{base[0]}\n{base[1]}\nshort"), (1, f"{base[0][:-1]}\n{base[2]}\n{base[2]}\nshort"), (1, f"{base[0][:-1]}\n{base[2]}\n{base[2]}\nshort"), (None, base[2]), (4, None)], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(d).collect()), key=key)
    first = (1, f"{base[0][:-1]}\n{base[2]}\nshort")
    assert out == sorted([first, first, (2, f"{base[1]}\nshort"), (4, None), (None, "")], key=key)
    assert line_dedup.line_report(docs).count() == docs.count() and line_dedup.line_report(none).count() == 0
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_line_dedup_short_lines(spark):
    """Equal lines of any length go but for the first; short lines have no inexact links."""
    import corpus_pipeline

    texts = [(1, "Les.\nMenu\n" + " \n日本\n\nLes"), (2, "Menu \nLes.\nLes!\n\nx"), (3, " Les.\nx\nx\n日本\n"), (4, "Menu\n \n")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, d, None).collect()}
    assert out == {1: texts[0][1], 2: "Les!\n\nx", 3: "", 4: " \n"}
    got = {r["doc_id"]: (r["n_lines"], r["n_links"], r["n_removed"], r["class_docs"]) for r in line_dedup.line_report(d).collect()}
    assert got == {1: (4, 3, 0, [1, 1, 1]), 2: (4, 3, 2, got[2][3]), 3: (4, 4, 4, got[3][3]), 4: (1, 1, 1, [1])}
    assert sorted(got[2][3]) == [1, 1, 2] and sorted(got[3][3]) == [1, 1, 2]


def edited(r, line, n):
    for _ in range(n):
        k, c, kind = r.randrange(len(line)), r.choice("abcXYZ"), r.random()
        line = line[:k] + c + line[k + 1 :] if kind < 0.4 else line[:k] + line[k + 1 :] if kind < 0.7 else line[:k] + c + line[k:]
    return line_dedup.normal(line)


def least_reached(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("most,rows_a_task", [(10_000, 0), (3, 20_000), (1, 60)])
def test_line_classes_of_dense_groups(spark, most, rows_a_task):
    """The classes are those of all pairs: in groups where all pairs are links, where lines share
    most of their characters and few are links, and where all share a segment and none is a link."""
    r = random.Random(3)
    hub, far, num = prose(10), prose(10), prose(6)
    lines = [edited(r, hub, 1) for _ in range(90)] + [edited(r, far, r.randint(1, 4)) for _ in range(90)]
    lines += [f"{num} {r.randrange(10**5):05d} {num[:9]}" for _ in range(90)]
    lines += [f"{prose(1)}{r.randrange(10**4)} shared part of a line that is common to all of them {prose(1)}{r.randrange(100)}" for _ in range(60)]
    lines = sorted({x for x in lines if len(x) >= line_dedup.MIN_CHARS})
    ids = {line_dedup.line_id(x): x for x in lines}
    pairs = {(a, b) for a in ids for b in ids if a < b and line_dedup.within(ids[a], ids[b], 2)}
    got = {(x["a"], x["b"]) for x in line_dedup.link_lines(spark.createDataFrame([(x,) for x in lines], "line string").repartition(4), most=most, rows_a_task=rows_a_task).collect()}
    assert got <= pairs and least_reached(got, ids) == least_reached(pairs, ids)
    assert len(pairs) > 3000 and (got == pairs if most > 1000 else len(got) < len(pairs) / 4)


@pytest.mark.parametrize("edge_bytes", [0, 1 << 20])
def test_components(spark, edge_bytes):
    """Chains, stars, loops and repeats: both ways give every node the least one it reaches."""
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 160)] + [(-5, k) for k in range(200, 240)] + [(7, 7), (8, 9), (9, 8), (8, 9)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)]
    want = least_reached([e for e in edges if e[0] != e[1]], {x for e in edges if e[0] != e[1] for x in e})
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    assert {x["node"]: x["root"] for x in common.connected_components(frame, edge_bytes=edge_bytes).collect()} == want
    assert common.connected_components(frame.limit(0)).count() == 0


def test_line_report_brute_force(spark, docs):
    """Every column of the report against plain Python, repeated rows and null ids included."""
    want = Counter()
    distinct = {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    place = lambda d, t, p: (d is None, d or 0, xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(t.encode(), 42) >> 63 else 0), p)
    lines = {(d, t, p): line_dedup.normal(x) for d, t in distinct for p, x in enumerate(t.split("\n")) if line_dedup.normal(x)}
    ids = {line_dedup.line_id(x): x for x in lines.values()}
    long = [i for i in ids if len(ids[i]) >= 12]
    root = least_reached([(a, b) for a in long for b in long if a < b and line_dedup.within(ids[a], ids[b], 2)], ids)
    members = defaultdict(list)
    for (d, t, p), x in lines.items():
        members[root[line_dedup.line_id(x)]].append((place(d, t, p), d))
    for r in docs.collect():
        d, t = r["doc_id"], r["text"] or ""
        own = [(p, root[line_dedup.line_id(lines[d, t, p])]) for p in range(t.count("\n") + 1) if (d, t, p) in lines]
        shared = [(p, c) for p, c in own if len(members[c]) > 1]
        gone = {p for p, c in shared if min(members[c])[0] != place(d, t, p)}
        kept = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
        names = sorted({(c, min(members[c])[1]) for _, c in shared})
        want[d, len(own), len(shared), len(gone), hashlib.sha256(kept.encode()).hexdigest(), tuple(c for c, _ in names), tuple(i for _, i in names)] += 1
    got = Counter((*(x[c] for c in ("doc_id", "n_lines", "n_links", "n_removed", "kept_sha256")), tuple(x["classes"]), tuple(x["class_docs"])) for x in line_dedup.line_report(docs).collect())
    assert got == want


def test_mixing(spark, docs, none, sf_dir):
    for d in (docs, table(spark, sf_dir, "documents")):
        got = mixing.plan_mix(d, block=64).collect()
        assert len(got) == d.count()
        size, taken, target = Counter(), Counter(), {}
        for r in got:
            size[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] >= r["size"]
        order = sorted(size, key=lambda s: (s is None, s))
        want, open_ = {}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
        rest = 1.5 * sum(size.values())
        while open_:
            level = rest / sum(open_.values())
            over = [s for s, w in open_.items() if w * level > 2 * size[s]]
            for s in over or list(open_):
                want[s] = 2.0 * size[s] if over else open_[s] * level
                rest -= want[s]
                del open_[s]
        for s in order:
            assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
        assert sorted(map(tuple, got), key=key) == sorted(map(tuple, mixing.plan_mix(d, block=64).collect()), key=key)
    words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rs)
    d = spark.createDataFrame(rows()[: len(TEXTS)], SCHEMA)
    assert words(mixing.mixed_documents(d, block=64).collect()) == sum(r["taken"] for r in mixing.plan_mix(d, block=64).collect())
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).columns == none.columns


def test_packing_round_trip(docs, none):
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    packed = packing.pack(docs, RANKS, length=128, shard_bytes=20_000)
    for r in packed.collect():
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 128 and len(r["ids"]) == 256 and r["resets"] == r["cu_seqlens"][:-1]
    by = defaultdict(list)
    for r in packing.unpack(packed).collect():
        by[r["doc_id"]].append((r["start"], r["ids"]))
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(enc.encode_ordinary(r["text"] or ""))
    for i, lists in texts.items():
        assert sum(map(len, lists)) == sum(len(x) for _, x in by[i])
        if len(lists) == 1:
            assert [t for _, x in sorted(by[i]) for t in x] == lists[0]
    sizes = sorted((rng.randint(1, 50) for _ in range(400)), reverse=True)
    rooms, want = [], []
    for n in sizes:
        fit = [r for r in range(len(rooms)) if rooms[r] >= n]
        row = min(fit, key=lambda r: rooms[r]) if fit else len(rooms)
        if not fit:
            rooms.append(50)
        rooms[row] -= n
    got = packing.best_fit(sizes, 50)
    want = sorted(50 - r for r in rooms)
    assert sorted(sum(sizes[k] for k in row) for row in got) == want and sorted(k for row in got for k in row) == list(range(400))
    assert packing.pack(none, RANKS).count() == 0


def test_language_held_out(spark, docs, none, sf_dir):
    d = table(spark, sf_dir, "documents")
    truth = {r["doc_id"]: r["lang"] for r in d.collect()}
    got = language_id.predict(d).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    small = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs).collect()}
    assert small[0] == small[1] == small[2] == "und" and small[9] == "und" and small[4] == "en"
    assert language_id.predict(none).count() == 0


def test_language_brute_force(spark, sf_dir):
    """Counts, idf, cosines and the rule of rejection in plain Python against the operator."""
    import math

    import regex

    d = table(spark, sf_dir, "documents")
    model = language_id.train(d, 3, 1)

    def grams(t):
        w = regex.findall(r"\p{L}+", (t or "").lower())
        raw = (" " + " ".join(w) + " ").encode()
        return Counter(((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 2654435769 % 2**32) >> 18 for k in range(len(raw) - 2)) if w else None

    rows = [(r["doc_id"], grams(r["text"]), r["lang"]) for r in d.collect()]
    train = [g for i, g, lang in rows if g and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    df = Counter(k for g in train for k in g)
    idf = lambda k: math.log((1 + len(train)) / (1 + df[k])) + 1
    assert all(model["idf"][k] == pytest.approx(idf(k)) for k in list(df)[:2000])
    got = {r["doc_id"]: r for r in language_id.predict(d).collect()}
    for i, g, _ in rows:
        if not g:
            assert got[i]["lang_pred"] == "und"
            continue
        v = {k: (1 + math.log(n)) * idf(k) for k, n in g.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(c[k] * x for k, x in v.items()) / norm for c in model["centroids"]]
        best = [max(x for x, o in zip(cos, model["owner"]) if o == k) for k in range(len(model["langs"]))]
        top = max(best)
        assert got[i]["lang_pred"] == model["langs"][best.index(top)] and got[i]["score"] == pytest.approx(1 / sum(math.exp(20 * (b - top)) for b in best), rel=1e-4)
        assert got[i]["rejected"] == (top < model["bounds"][best.index(top)]) or abs(top - model["bounds"][best.index(top)]) < 1e-6
    assert all(abs((c * c).sum() - 1) < 1e-4 for c in model["centroids"])
    odd = spark.createDataFrame([(1, "²③½"), (2, "12 ² !"), (3, "ab ²")], "doc_id long, text string").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in language_id.predict(d.select("doc_id", "text", "lang").union(odd.selectExpr("doc_id + 10000000", "text", "lang"))).where("doc_id > 10000000").collect()} == {10000001: True, 10000002: True, 10000003: False}


def test_label_model_recovers_accuracies():
    """Votes drawn from known rates, two voters copying each other: posteriors follow the truth,
    labelled rows anchor it, and the classifier settles whatever the order of its rows."""
    import numpy as np

    r = np.random.default_rng(1)
    n, n_voters = 20_000, toxicity.VOTERS
    y = r.random(n) < 0.15
    votes = [np.where(y, r.random(n) < 0.6, r.random(n) < 0.03) for _ in range(n_voters - 1)]
    votes.append(np.where(r.random(n) < 0.9, votes[0], r.random(n) < 0.1))  # a copy of the first
    pattern = sum(v.astype(int) << k for k, v in enumerate(votes))
    known = Counter((int(p), int(t)) for p, t in zip(pattern[:2000], y[:2000]))
    post = toxicity.label_model(Counter(pattern.tolist()), known)
    p = np.array([post[int(x)] for x in pattern])
    assert ((p >= 0.5) == y).mean() > 0.98 and abs(p.mean() - 0.15) < 0.06  # silence has 0.05
    rows, cols = np.repeat(np.arange(200), 3), r.integers(0, 30, 600)
    soft, l2 = r.random(200), np.full(30, 1.0)
    order = r.permutation(600)
    a, b = toxicity.fit(rows, cols, 30, soft, l2), toxicity.fit(rows[order], cols[order], 30, soft, l2)
    assert np.abs(a - b).max() < 1e-6


def test_toxicity_held_out(spark, docs, none, sf_dir):
    base = sf_dir.rsplit("/", 1)[0] + "/sf0.01"
    d, labels = table(spark, base, "documents"), table(spark, base, "labels")
    got = {r["doc_id"]: r for r in toxicity.score(d, labels).collect()}
    insult = re.compile(r"\b(idiot|moron|stupid|pathetic|worthless|clown|loser)\b")
    hits = [r["doc_id"] for r in d.collect() if insult.search(r["text"].lower())]
    assert sum(got[i]["predicted"] for i in hits) >= 0.95 * len(hits)
    clean = [r["doc_id"] for r in labels.collect() if not r["toxic"]]
    assert sum(got[i]["predicted"] for i in clean) <= 0.03 * len(clean)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, empty).count() == docs.count() and toxicity.score(none, empty).count() == 0


def test_media_brute_force(docs):
    """Every column of the digests from Python's own wave module and plain arithmetic."""
    import io
    import math
    import time
    import wave

    for r in media.digests(docs).collect():
        raw = next(t for t in ([(x["text"] or "").encode() for x in docs.where("doc_id <=> " + ("NULL" if r["doc_id"] is None else str(r["doc_id"]))).collect()]) if len(t) == r["n_bytes"])
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(payload)
        n = Counter(payload)
        entropy = -sum(c / len(payload) * math.log2(c / len(payload)) for c in n.values())
        turns = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        got = dict(x.split("=") for x in r["feature"].split(";")[1:])
        assert r["feature"].split(";")[0].endswith(">audio/wav") and got["carved"] == "none" and int(got["turns"]) == turns and int(got["peak"]) == max(payload)
        assert float(got["mean"]) == pytest.approx(sum(payload) / len(payload), abs=1e-6) and float(got["entropy"]) == pytest.approx(max(0, entropy), abs=1e-5)
    for magic in (b"%PDF-1.", b"PK\x03\x04", b"%PDF-1. startxref "):
        began = time.time()
        media.sniff(media.store(magic * 40_000))
        assert time.time() - began < 2
    import gzip

    bomb = gzip.compress(b"\0" * 50_000_000)
    assert [(k, n) for _, n, k in media.sniff(media.store(b".." + bomb + b".."))[1:]] == [("application/gzip", len(bomb))]


def test_media_round_trip(docs, none):
    for r in media.digests(docs).collect():
        assert r["payload_bytes"] % 576 == 0 and r["payload_bytes"] >= max(576, r["n_bytes"])
    for t in TEXTS:
        p = media.payload_of(t)
        m = media.store(p)
        true, carved, back, _ = media.describe(m, "image/png")
        assert back == p and true == "audio/wav" and p.startswith((t or "").encode())
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0\0\0\1\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    import gzip

    pieces = [(gif, "image/gif"), (png, "image/png"), (gzip.compress(b"hello"), "application/gzip"), (b"%PDF-1.4 x startxref 0 %%EOF", "application/pdf")]
    inside = media.store(b"..GIF8 no BM ".join(p for p, _ in pieces) + b"\x89PNG broken")
    assert [(k, n) for _, n, k in media.sniff(inside)[1:]] == [(k, len(p)) for p, k in pieces]
    assert media.sniff(media.store(b"abc")[:-2]) == []
    cols = media.media_columns(docs).collect()
    assert all(r["media_type"] == "audio/wav" for r in cols) and media.digests(none).count() == 0


def test_pipeline_brute_force(spark):
    """All five stages against plain Python on a small corpus with a hot line, near lines, near
    copies, nulls and repeated rows; also empty, and with columns of other names."""
    import corpus_pipeline

    r = random.Random(8)
    menu, words = "the menu of this host 7", re.compile(r"[^\x20\x09-\x0D]+")
    sentence = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base = [f"{sentence(30)}\n{sentence(9)}" for _ in range(60)]
    texts = [(f"{menu}\n{x}" if i % 2 else x, f"h{i % 2}") for i, x in enumerate(base)]
    texts += [(x + " " + sentence(1), "h0") for x in base[:6]] + [(f"{sentence(25)}\n{edited(r, base[7].split(chr(10))[1], 2)}", None) for _ in range(3)]
    long_ = [sentence(70) for _ in range(5)]
    texts += [(" ".join("Xyzzyplugh" + w if k == j else w for k, w in enumerate(x.split())), f"h{n % 2}") for n, x in enumerate(long_) for j in (-1, 10, 40)]  # one word of 70: similarity 0.86
    texts += [("few words", "h0"), ("same words here and again " * 9, "h1"), (f"{menu} \n" + sentence(4), "h1"), (None, "h0"), ("", None)]
    rows = [(i, t, "en", s, None if t is None else len(t), i) for i, (t, s) in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[9], "en", "h0", 1, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _other long"
    docs = spark.createDataFrame(rows, schema).repartition(3)

    # quality rules
    norm = lambda x: " ".join(words.findall(re.sub(r"\d", "0", x.lower())))
    distinct, holds = defaultdict(set), defaultdict(set)
    for _, t, _, s, *_ in rows:
        distinct[s].add(t or "")
        for x in (t or "").split("\n"):
            if norm(x):
                holds[s, norm(x)].add(t or "")
    over = {k for k, v in holds.items() if len(v) > max(20, min(100, 0.1 * len(distinct[k[0]])))}
    assert over
    d = []
    for i, t, lang, s, n, o in rows:
        w = words.findall(t or "")
        wins = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = len({j for k in range(len(w) - 7) if wins[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)})
        gone = sum(len(words.findall(x)) for x in (t or "").split("\n") if (s, norm(x)) in over)
        left = len(w) - gone
        if len(w) >= 20 and 100 * rep <= 30 * len(w) and not (gone and (left < 20 or left < 0.3 * len(w))):
            d.append((i, "\n".join(x for x in t.split("\n") if (s, norm(x)) not in over), s))
    got = corpus_pipeline.quality(spark, docs, None)
    assert got.columns == docs.columns and Counter((x["doc_id"], x["text"], x["source"]) for x in got.collect()) == Counter(d)
    stage = spark.createDataFrame(got.collect(), schema)

    # line dedup
    key = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), 42), "big", signed=True)
    at = {(i is None, i or 0, key(t), p): line_dedup.normal(x) for i, t, _ in d for p, x in enumerate(t.split("\n")) if line_dedup.normal(x)}
    ids = {line_dedup.line_id(x): x for x in at.values()}
    long = [i for i in ids if len(ids[i]) >= 12]
    root = least_reached([(a, b) for a in long for b in long if a < b and line_dedup.within(ids[a], ids[b], 2)], ids)
    first = {}
    for k in sorted(at, reverse=True):
        first[root[line_dedup.line_id(at[k])]] = k
    stays = lambda i, t, p: (k := (i is None, i or 0, key(t), p)) not in at or first[root[line_dedup.line_id(at[k])]] == k
    d = [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if stays(i, t, p)), s) for i, t, s in d]
    got = corpus_pipeline.lines(spark, stage, None)
    assert Counter((x["doc_id"], x["text"], x["source"]) for x in got.collect()) == Counter(d)
    stage = spark.createDataFrame(got.collect(), schema)

    # near-dedup: five words, similarity 0.8
    def grams(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {t: grams(t) for _, t, _ in d}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    order = {t: k for k, t in enumerate(sets)}
    group = least_reached([(order[a], order[b]) for a in sets for b in sets if order[a] < order[b] and near(sets[a], sets[b])], list(order.values()))
    best = {}
    for i, t, s in d:
        k = (i is None, i or 0, key(t))
        best[group[order[t]]] = min(best.get(group[order[t]], (k, i, t)), (k, i, t), key=lambda x: x[0])
    kept = {(i, t) for _, i, t in best.values()}
    got = corpus_pipeline.near_copies(spark, stage, None)
    assert Counter((x["doc_id"], x["text"]) for x in got.collect()) == Counter(kept) and len(kept) < len({(i, t) for i, t, _ in d})
    stage = spark.createDataFrame(got.collect(), schema)
    d = [(x["doc_id"], x["text"], x["source"]) for x in stage.collect()]

    # mixing: golden-ratio slots over blocks of 4,096 words, in plain loops
    size = Counter()
    for _, t, s in d:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target, open_, rest = {}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values())
    while open_:
        level = rest / sum(open_.values())
        full = [s for s, w in open_.items() if w * level > 2 * size[s]]
        for s in full or list(open_):
            target[s] = 2.0 * size[s] if full else open_[s] * level
            rest -= target[s]
            del open_[s]
    live = [s for s in names if size[s]]
    want = {s: int(target[s] + 0.5) for s in live}
    blocks = {s: -(-size[s] // 4096) for s in live}
    need = {s: want[s] // size[s] * blocks[s] + -(-(want[s] % size[s]) // 4096) for s in live}
    total, edge, low = sum(need[s] + 64 for s in live), {}, 0
    for s in live:
        edge[s] = (int(2**32 * low / total), int(2**32 * (low + need[s] + 64) / total))
        low += need[s] + 64
    rank, whole, part = Counter(), Counter(), Counter()
    for t in range(total):
        for s in live:
            if edge[s][0] <= t * 2654435769 % 2**32 < edge[s][1]:
                k, rest_ = rank[s], want[s] % size[s]
                rank[s] += 1
                if k < need[s]:
                    if k == need[s] - 1 and rest_:
                        part[s, k % blocks[s]] += (rest_ - 1) % 4096 + 1
                    else:
                        whole[s, k % blocks[s]] += 1
    mixed = Counter()
    for s in live:
        h = lambda i: int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:12], 16)
        start = 0
        for i, t, _ in sorted((x for x in d if x[2] == s), key=lambda x: (h(x[0]) % 4096, h(x[0]), x[0] is not None, x[0] or 0)):
            n = len(t.split())
            take = 0
            for b in range(start // 4096, (start + n - 1) // 4096 + 1 if n else 0):
                lo, hi = max(start, b * 4096) - b * 4096, min(start + n, (b + 1) * 4096) - b * 4096
                take += whole[s, b] * (hi - lo) + max(0, min(hi, part[s, b]) - lo)
            start += n
            if n:
                times, tail = divmod(take, n)
                mixed[i, t] += times
                if tail:
                    ends = [m.end() for m in words.finditer(t)]
                    mixed[i, t[: ends[tail - 1]]] += 1
    got = corpus_pipeline.mixture(spark, stage, None)
    assert Counter((x["doc_id"], x["text"]) for x in got.collect()) == +mixed
    stage = spark.createDataFrame(got.collect(), schema)

    # BPE, and the whole run
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    tokens = Counter((x["doc_id"], len(e := enc.encode_ordinary(x["text"])), sha(" ".join(map(str, e)).encode()), sha(x["text"].encode())) for x in stage.collect())
    assert Counter(map(tuple, corpus_pipeline.tokens(spark, stage, None).collect())) == tokens
    none = spark.createDataFrame([], schema)
    for name, fn in corpus_pipeline.STAGES:
        out = fn(spark, none, None)
        assert out.count() == 0 and (out.columns == none.columns or name == "byte-level BPE")


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    before = table(spark, sf_dir, "documents")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and all(r["n_tokens"] > 0 for r in out)
    d = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, d, sf_dir)
        assert nxt.columns == before.columns, name
        d = spark.createDataFrame(nxt.collect(), before.schema)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = Counter((r["doc_id"], len(enc.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in d.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in out) == want


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stage_gives_heaps_back(spark, none, stage):
    """The heap that the stage before has left is collected whole before a stage's workers start."""
    import corpus_pipeline

    def whole():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))

    before = whole()
    corpus_pipeline.STAGES[stage][1](spark, none, None)
    assert whole() > before
