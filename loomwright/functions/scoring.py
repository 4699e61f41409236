"""Quality scores as expressions over a dialect; no function of Python runs on rows."""

from __future__ import annotations


from loomwright.functions.dialect import PLAIN_LINE, Dialect

# Patterns, word lists and weights of the scores.
TECHNICAL = (
    (r"\b(function|class|method|variable|array|object|string|boolean|integer)\b", "i"), (r"\b(javascript|python|java|html|css|sql|json|xml|api|sdk)\b", "i"),
    (r"\b(database|server|client|frontend|backend|framework|library)\b", "i"), (r"\b(documentation|docs|guide|tutorial|example|usage|syntax|parameter)\b", "i"),
    (r"\b(install|setup|configure|deploy|build|test|debug)\b", "i"), (r"[{}\[\]();]", ""), (r"\b[a-zA-Z_][a-zA-Z0-9_]*\(", ""), (r"\$[a-zA-Z_][a-zA-Z0-9_]*", ""), (r"https?://[^\s]+", ""),
)
# What a text must have for a technical pattern to match: one of the words (lower case), or the character
TECHNICAL_MARKS = (*(tuple(p[3:-3].split("|")) for p, _ in TECHNICAL[:5]), tuple("{}[]();"), ("(",), ("$",), ("://",))
TERMS = (
    "function", "class", "method", "api", "endpoint", "database", "server", "client", "protocol", "algorithm", "framework", "library", "module", "interface", "implementation",
    "configuration", "deployment", "testing", "debugging", "optimization", "performance", "security", "authentication", "authorization", "encryption", "compression", "serialization",
    "parsing", "validation", "error", "exception", "logging", "monitoring", "metrics",
)
CODE = (
    "const", "let", "var", "function", "return", "if", "else", "for", "while", "class", "extends", "import", "export", "async", "await", "promise", "try", "catch", "finally",
    "throw", "new", "this", "super",
)
EXTENSION = r"\.(js|ts|jsx|tsx|py|java|c|cpp|cs|php|rb|go|rs|swift|kt|scala|clj|hs|ml|sql|html|css|json|xml|yaml|yml|toml|ini|conf|sh|bash|ps1|bat)$"
ADS = ("advertisement", "sponsored", "promoted", "banner", "advert", "click here", "learn more", "sign up", "subscribe", "newsletter", "limited time", "special offer", "discount", "sale", "free trial")
NAV = ("home", "about", "contact", "privacy", "terms", "sitemap", "navigation", "menu", "breadcrumb", "sidebar", "footer")
PLATE = ("all rights reserved", "copyright", "powered by", "made with", "designed by", "developed by", "created by", "built with")
CLIENT_TECHNICAL = (
    r"function\s*\(", r"class\s+\w+", r"api/", r"http[s]?://", r"\.(js|ts|html|css|json|xml|md|txt)$", r"database|server|client", r"import\s+|export\s+",
    r"const\s+|let\s+|var\s+", r"async\s+function", r"Promise\.", r"fetch\(", r"XMLHttpRequest",
)
FINAL_ERRORS = ("abort", "404", "403", "invalid content")  # a request that failed so is not tried again
RETRIES, RETRY_BASE, RETRY_MOST = 3, 1000, 10_000  # waits of base x 2^n milliseconds, at most the last
WEIGHTS = {"readability": 0.25, "completeness": 0.30, "technical": 0.25, "structure": 0.20}
CLASS_WEIGHTS = {"length": 0.2, "structure": 0.25, "readability": 0.2, "technical": 0.2, "noise": 0.15}
FACTORY_WEIGHTS = {"length": 0.15, "structure": 0.3, "readability": 0.25, "technical": 0.25, "noise": 0.05}
CLIENT_WEIGHTS = {"length": 0.3, "readability": 0.2, "technical": 0.3, "structure": 0.2}
ADVICE = (
    ("length", 0.5, "Content is too short - consider adding more detail"), ("structure", 0.4, "Add structural elements like headings, lists, or code blocks"),
    ("readability", 0.6, "Improve readability by using shorter sentences and simpler words"), ("technical", 0.3, "Consider adding technical terminology and code examples"),
    ("noise", 0.7, "Remove promotional content and navigation elements"),
)


def clamp(x: str) -> str:
    return f"greatest(0.0D, least(1.0D, {x}))".replace("0.0D", "CAST(0 AS DOUBLE)").replace("1.0D", "CAST(1 AS DOUBLE)")


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"({dbl(a)} / nullif({dbl(b)}, 0))"


def sentences(d: Dialect, x: str, longer_than: int = 0) -> str:
    return d.filter(d.split(x, r"[.!?]+"), "s", f"length({d.trim('s')}) > {longer_than}")


def basis(d: Dialect, source: str, x: str, text: bool = True, hits: bool = True) -> str:
    """source with what the scores of x share, each computed once a row: words n, different words u,
    sentences s and their different word counts k, sentences over 10 characters r, of which ru differ,
    characters outside white space solid, pieces between white space p, lower-cased text low, and hits
    h0.. of the technical patterns."""
    if text and d.java:
        source = _counted(d, source, x)
    elif text:
        pieces, trimmed = d.split(x, r"\s+"), d.map(d.split(x, r"[.!?]+"), "s", d.trim("s"))
        source = d.stage(source, {"ps": pieces, "ss": d.filter(trimmed, "s", "s <> ''"), "low": f"lower({x})"})
        source = d.stage(source, {"ws": d.filter("ps", "w", "w <> ''"), "rs": d.map(d.filter("ss", "z", "length(z) > 10"), "z", "lower(z)")})
        count = lambda xs: d.size(d.distinct(xs))
        source = d.stage(source, {
            "n": d.size("ws"), "u": count(d.map("ws", "w", "lower(w)")), "p": d.size("ps"), "s": d.size("ss"), "k": count(d.map("ss", "z", d.size(d.split("z", r"\s+")))),
            "r": d.size("rs"), "ru": count("rs"), "solid": f"CAST(length({d.join('ws', '')}) AS BIGINT)",
        })
    if hits:
        where = [words if text else f"lower({x})" for words in ["words_of"] * 5] + [x] * 4
        source = d.stage(source, {f"h{i}": d.count_where(x, marks, pattern, f, at) for i, ((pattern, f), marks, at) in enumerate(zip(TECHNICAL, TECHNICAL_MARKS, where, strict=True))})
    return source


def _counted(d: Dialect, source: str, x: str) -> str:
    """basis's figures in Spark: the lower-cased text is split once, and for white space most texts
    need a small class only. Pieces ps, of which only the first and the last can be empty, are in lower case (each by itself where the text has other white
    space, which can change a letter's form); words_of has each word of the text once."""
    trimmed = d.map(d.split(x, r"[.!?]+"), "s", d.trim("s"))
    source = d.stage(source, {"low": f"lower({x})", "raw": f"CASE WHEN {d.wide(x)} THEN {d.split(x, r'\s+')} END", "ss": d.filter(trimmed, "s", "s <> ''")})
    lowered, wide = d.split(f"lower({d.join('raw', ' ')})", " "), "raw IS NOT NULL"
    source = d.stage(source, {"ps": f"CASE WHEN {wide} THEN {lowered} ELSE {d.split_spaces('low', 'false')} END", "rs": d.map(d.filter("ss", "z", "length(z) > 10"), "z", "lower(z)")})
    source = d.stage(source, {"us": d.distinct("ps"), "p": d.size("ps"), "n": f"{d.size('ps')} - CASE WHEN {d.at('ps', 1)} = '' THEN 1 ELSE 0 END - CASE WHEN size(ps) > 1 AND {d.last('ps')} = '' THEN 1 ELSE 0 END"})
    solid = f"CASE WHEN {wide} THEN length({d.join('raw', '')}) ELSE length({x}) - length(low) + length({d.join('ps', '')}) END"
    return d.stage(source, {
        "u": f"{d.size('us')} - CASE WHEN p > n THEN 1 ELSE 0 END", "s": d.size("ss"), "k": d.size(d.distinct(d.map("ss", "z", d.size(d.split_spaces("z", wide))))),
        "r": d.size("rs"), "ru": d.size(d.distinct("rs")), "solid": f"CAST({solid} AS BIGINT)", "words_of": d.join("us", " "),
    })


# The functions from here on that say "basis" take a row of basis().
def repetition(d: Dialect, x: str) -> str:
    """basis"""
    return f"CASE WHEN r < 3 THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), 2 * (1 - {ratio('ru', 'r')})) END"


def readability(d: Dialect, x: str) -> str:
    """basis"""
    first = f"greatest(CAST(0 AS DOUBLE), 1 - abs({ratio('n', 's')} - 17.5) / 17.5)"
    second = f"least(CAST(1 AS DOUBLE), 2 * {ratio('u', 'n')})"
    return f"CASE WHEN length({x}) < 50 OR s = 0 OR n = 0 THEN CAST(0 AS DOUBLE) ELSE {dbl(f'0.4 * {first} + 0.4 * {second} + 0.2 * (1 - ({repetition(d, x)}))')} END"


def completeness(d: Dialect, x: str) -> str:
    t, w = d.test, d.test_where
    lead = rf"^[{PLAIN_LINE}]*+" if d.java else r"^[\s]*"  # what is before an item on its own line decides
    good = [w(x, "#", r"^#{1,6}\s+.+$", "m"), f"({w(x, ['```'], r'```[\s\S]*?```')} OR {w(x, ['    '], r'^    \S.*$', 'm')})", f"({w(x, '-*+', lead + r'[-*+]\s+.+$', 'm')} OR {t(x, lead + r'\d+\.\s+.+$', 'm')})",
            f"{d.size(d.split(x, r'\n\n'))} > 2", f"length({x}) >= 200"]
    last = d.rest(d.trim(x), -1) if d.java else d.trim(x)
    bad = [w(x, ("...", "…"), r"\.{3,}|…"), f"NOT {t(last, r'[.!?]$')}", w(x, ("more", "reading"), r"read\s+more|continue\s+reading|see\s+more", "i", f"lower({x})")]
    return clamp(dbl(d.sum_of([(c, 0.2) for c in good] + [(c, -0.15) for c in bad])))


def technical(d: Dialect, x: str) -> str:
    """basis"""
    kinds = "(" + " + ".join(f"CASE WHEN h{i} > 0 THEN 1 ELSE 0 END" for i in range(len(TECHNICAL))) + ")"
    total = "(" + " + ".join(f"h{i}" for i in range(len(TECHNICAL))) + ")"
    return f"(0.6 * {ratio(kinds, '9')} + 0.4 * least(CAST(1 AS DOUBLE), {ratio(f'100 * {total}', 'p')}))"


def structure(d: Dialect, x: str) -> str:
    fence = f"(NOT {d.has(x, '```')} OR {d.test(x, r'```[\s\S]*?```')})"
    flags = [(d.test_where(x, "#", r"^#{1,2}\s+.+", "m"), 0.25), (d.test_where(x, "#", r"^#{3,6}\s+.+", "m"), 0.20), (f"{d.count_where(x, '#', r'^#{1,6}\s+', 'm')} >= 2", 0.20), (f"NOT {d.test_where(x, [chr(10) * 4], r'\n{4,}')}", 0.15), (fence, 0.10), ("TRUE", 0.10)]
    return dbl(d.sum_of(flags))


PARTS = {"readability": readability, "completeness": completeness, "technical": technical, "structure": structure}


def overall(d: Dialect, x: str, least: int = 100, weights: dict = WEIGHTS) -> str:
    """The server score (basis); NULL and short texts have 0."""
    total = " + ".join(f"{w} * ({PARTS[k](d, x)})" for k, w in weights.items())
    return f"CASE WHEN {x} IS NULL OR length({x}) < {least} THEN CAST(0 AS DOUBLE) ELSE {dbl(total)} END"


# Why a text has its score
REASONS = ("Invalid or empty content", "Content too short", "Insufficient technical content", "Quality assessment complete", "Content quality is marginal, consider review", "Content quality is below acceptable threshold")


def assessment(d: Dialect, source: str, x: str, least: int = 100, technical_least: float | None = None) -> str:
    """source (basis) with the parts, the score, its level and reason, and the details. With
    technical_least a text whose technical part is lower scores 0."""
    source = d.stage(source, {k: make(d, x) for k, make in PARTS.items()})
    total = dbl(" + ".join(f"{w} * {k}" for k, w in WEIGHTS.items()))
    gate = "FALSE" if technical_least is None else f"technical < {technical_least}"
    source = d.stage(source, {"score": f"CASE WHEN {x} IS NULL OR length({x}) < {least} OR {gate} THEN CAST(0 AS DOUBLE) ELSE {total} END"})
    short = f"concat({d.lit(REASONS[1] + ' (')}, CAST(length({x}) AS STRING), ' < {least} characters)')"
    why = f"""CASE WHEN {x} IS NULL OR {x} = '' THEN {d.lit(REASONS[0])} WHEN length({x}) < {least} THEN {short} WHEN {gate} THEN {d.lit(REASONS[2])}
        WHEN score >= 0.6 THEN {d.lit(REASONS[3])} WHEN score >= 0.4 THEN {d.lit(REASONS[4])} ELSE {d.lit(REASONS[5])} END"""
    different = "u + CASE WHEN p > n THEN 1 ELSE 0 END" if d.java else d.size(d.distinct(d.map("ps", "w", "lower(w)")))  # the empty piece at a blank end counts
    return d.stage(source, {"level": f"CASE WHEN length({x}) >= {least} AND NOT ({gate}) THEN {level('score')} END", "reason": why, "unique_words": different, "characters": f"CAST(length({x}) AS BIGINT)"})


def level(s: str, names=("excellent", "good", "fair", "poor"), edges=(0.8, 0.6, 0.4)) -> str:
    return "CASE " + " ".join(f"WHEN {s} >= {e} THEN '{n}'" for e, n in zip(edges, names)) + f" ELSE '{names[-1]}' END"


def class_length(d: Dialect, x: str) -> str:
    """basis"""
    bands = "WHEN n < 20 THEN 0.0 WHEN n > 50000 THEN 0.5 WHEN n BETWEEN 100 AND 2000 THEN 1.0 WHEN n BETWEEN 50 AND 5000 THEN 0.8 WHEN n <= 10000 THEN 0.6 ELSE 0.3"
    return dbl(f"CASE {bands} END")


TAGS = {"headings": r"<h[1-6][^>]*>", "paragraphs": r"<p[^>]*>", "lists": r"<(ul|ol)[^>]*>", "code": r"<(pre|code)[^>]*>", "links": r"<a[^>]*>", "images": r"<img[^>]*>", "tables": r"<table[^>]*>", "quotes": r"<blockquote[^>]*>"}


def class_structure(d: Dialect, x: str) -> str:
    kinds = "(" + " + ".join(f"CASE WHEN {d.test(x, p, 'i')} THEN 1 ELSE 0 END" for p in TAGS.values()) + ")"
    levels = d.size(d.distinct(d.extract_all(x, r"<h([1-6])[^>]*>", 1, "i")))
    score = f"least({dbl('0.4')}, {dbl(f'0.1 * {kinds}')}) + least({dbl('0.3')}, {dbl(f'0.1 * {levels}')}) + " + d.sum_of([(d.test(x, TAGS["code"], "i"), 0.2), (d.test(x, TAGS["links"], "i"), 0.1)])
    return f"CASE WHEN {kinds} = 0 THEN {dbl('0.2')} ELSE least(CAST(1 AS DOUBLE), {dbl(score)}) END"


def class_readability(d: Dialect, x: str) -> str:
    """basis"""
    long, wide = ratio("n", "s"), ratio("solid", "n")
    score = f"1 - CASE WHEN {long} > 25 THEN 0.3 WHEN {long} > 20 THEN 0.1 ELSE 0 END - CASE WHEN {wide} > 8 THEN 0.2 WHEN {wide} > 6 THEN 0.1 ELSE 0 END + 0.1 * {ratio('k', 's')}"
    return f"CASE WHEN s = 0 OR n = 0 THEN CAST(0 AS DOUBLE) ELSE {clamp(dbl(score))} END"


def _any_of(d: Dialect, words: tuple[str, ...]) -> str:
    """basis: how many of the words are in the text; a single word is in it if it is in one of its words"""
    if not d.java:
        return d.any_of("low", words)
    return "(" + " + ".join(d.any_of("low" if " " in w else "words_of", [w]) for w in words) + ")"


def class_technical(d: Dialect, x: str) -> str:
    """basis"""
    each = [(0.4, f"0.05 * {_any_of(d, TERMS)}"), (0.3, f"0.03 * {_any_of(d, CODE)}"), (0.2, f"0.1 * {d.count('low', EXTENSION, 'i')}"), (0.1, f"0.05 * {d.count_where('low', ['://'], r'(https?://|ftp://|sftp://|ssh://|git://)', 'i')}")]
    return "least(CAST(1 AS DOUBLE), " + " + ".join(f"least({dbl(str(m))}, {dbl(e)})" for m, e in each) + ")"


def class_noise(d: Dialect, x: str) -> str:
    """basis"""
    each = [(0.4, f"0.1 * {_any_of(d, ADS)}"), (0.3, f"0.05 * {_any_of(d, NAV)}"), (0.2, f"0.05 * {_any_of(d, PLATE)}"), (0.1, f"0.02 * {d.count_where('low', ('!!', '??'), r'[!]{2,}|[?]{2,}')}")]
    return clamp("1 - " + " - ".join(f"least({dbl(str(m))}, {dbl(e)})" for m, e in each))


CLASS_PARTS = {"length": class_length, "structure": class_structure, "readability": class_readability, "technical": class_technical, "noise": class_noise}


def client_parts(d: Dialect, x: str) -> dict[str, str]:
    """basis"""
    n, mean = "n", ratio("solid", "n")
    tech = " OR ".join(d.test(x, p, "i") for p in CLIENT_TECHNICAL)
    once = [d.test(x, p, "m") for p in (r"^#+\s+", r"^[-*+]\s+", r"^\d+\.\s+", r"```[\s\S]*```", r"^\s*>\s+")]
    struct = d.sum_of([(c, 0.2) for c in once]) + f" + 0.2 * {d.count(x, r'`[^`]+`')} + 0.2 * {d.count(x, r'\[.*?\]\(.*?\)')}"
    return {
        "length": f"least(CAST(1 AS DOUBLE), {ratio(n, '100')})",
        "readability": f"CASE WHEN {mean} BETWEEN 3 AND 8 THEN CAST(1 AS DOUBLE) WHEN {mean} > 0 THEN greatest({dbl('0.3')}, 1 - abs({mean} - 5.5) / 5.5) ELSE CAST(0 AS DOUBLE) END",
        "technical": f"CASE WHEN {tech} THEN {dbl('0.8')} ELSE CAST(0 AS DOUBLE) END",
        "structure": f"least(CAST(1 AS DOUBLE), {dbl(struct)})",
    }


def client_overall(d: Dialect, x: str, least: int = 30) -> str:
    parts = client_parts(d, x)
    total = " + ".join(f"{w} * ({parts[k]})" for k, w in CLIENT_WEIGHTS.items())
    return f"CASE WHEN {x} IS NULL OR length({x}) < {least} THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), {dbl(total)}) END"


def soft_404(d: Dialect, title: str, x: str, n: str) -> str:
    c, t = f"lower({x})", f"lower({title})"
    both = f"({d.has(c, '404')} AND {d.has(c, 'not found')})"
    return f"({d.has(t, '404')} OR {d.has(t, 'not found')} OR ({both} AND {n} BETWEEN 20 AND 200) OR ({n} < 20 AND ({d.has(c, 'not found')} OR {d.has(c, '404')})))"


def validity(d: Dialect, x: str, n: str, least: int = 10) -> tuple[str, str]:
    """(is valid, score)."""
    c = f"lower({x})"
    lost = f"({d.has(c, '404')} AND {d.has(c, 'not found')} AND {n} < 200)"
    score = f"CASE WHEN {lost} THEN CAST(0 AS DOUBLE) WHEN {n} < {least} THEN {ratio(n, str(least))} ELSE least(CAST(1 AS DOUBLE), {ratio(n, '500')}) END"
    return f"(NOT {lost} AND {n} >= {least})", score


def error_type(d: Dialect, x: str) -> str:
    kinds = (("HTTP 404", "404 Not Found"), ("HTTP 500", "500 Server Error"), ("HTTP", "Other HTTP Error"), ("timeout", "Timeout"), ("network", "Network Error"))
    return "CASE " + " ".join(f"WHEN {d.has(x, a)} THEN '{b}'" for a, b in kinds) + " ELSE 'Other Error' END"
