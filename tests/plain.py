"""Scores and cleaning in plain Python, written from the rules: what the expressions are held against."""

import re
import unicodedata

from loomwright.functions import cleaning as C
from loomwright.functions import scoring as S

SPACES = "".join(map(chr, (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
BLANK = f"[{SPACES}]"


def rx(pattern, flags=""):
    """An ECMAScript pattern: its white space, ASCII word characters, $ at the very end."""
    pattern = pattern.replace(r"[\s\S]", "(?:.|\n)").replace(r"[^\s]", f"[^{SPACES}]").replace(r"[\s]", BLANK).replace(r"\S", f"[^{SPACES}]")
    pattern = re.sub(r"\\s", lambda m: BLANK, pattern)
    if "m" not in flags:
        pattern = re.sub(r"(?<!\\)\$$", r"\\Z", pattern)
    return re.compile(pattern, re.A | (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0))


def words(x):
    return [w for w in re.split(f"{BLANK}+", x) if w]


def sentences(x):
    return [s for s in re.split(r"[.!?]+", x) if s.strip(SPACES)]


def repetition(x):
    long = [s.strip(SPACES).lower() for s in sentences(x) if len(s.strip(SPACES)) > 10]
    return 0 if len(long) < 3 else min(1, 2 * (1 - len(set(long)) / len(long)))


def readability(x):
    w, s = words(x), sentences(x)
    if len(x) < 50 or not w or not s:
        return 0
    return 0.4 * max(0, 1 - abs(len(w) / len(s) - 17.5) / 17.5) + 0.4 * min(1, 2 * len({v.lower() for v in w}) / len(w)) + 0.2 * (1 - repetition(x))


def completeness(x):
    has = lambda p, f="": bool(rx(p, f).search(x))
    good = [has(r"^#{1,6}\s+.+$", "m"), has(r"```[\s\S]*?```") or has(r"^    \S.*$", "m"), has(r"^[\s]*[-*+]\s+.+$", "m") or has(r"^[\s]*\d+\.\s+.+$", "m"), len(x.split("\n\n")) > 2, len(x) >= 200]
    bad = [has(r"\.{3,}|…"), x.strip(SPACES)[-1:] not in (".", "!", "?") or not x.strip(SPACES), has(r"read\s+more|continue\s+reading|see\s+more", "i")]
    return max(0, min(1, 0.2 * sum(good) - 0.15 * sum(bad)))


def technical(x):
    hits = [len(rx(p, f).findall(x)) for p, f in S.TECHNICAL]
    return 0.6 * sum(h > 0 for h in hits) / 9 + 0.4 * min(1, sum(hits) / (len(re.split(f"{BLANK}+", x)) / 100))


def structure(x):
    has = lambda p: bool(rx(p, "m").search(x))
    flags = [(has(r"^#{1,2}\s+.+"), 0.25), (has(r"^#{3,6}\s+.+"), 0.2), (len(rx(r"^#{1,6}\s+", "m").findall(x)) >= 2, 0.2), ("\n" * 4 not in x, 0.15), ("```" not in x or x.count("```") >= 2, 0.1), (True, 0.1)]
    return sum(v for c, v in flags if c)


def q1(x, least=100):
    return 0 if x is None or len(x) < least else 0.25 * readability(x) + 0.3 * completeness(x) + 0.25 * technical(x) + 0.2 * structure(x)


def q2(x):
    t = re.sub(f"{BLANK}+", " ", re.sub(r"<[^>]*>", " ", x)).strip(SPACES)
    w, s, low = words(t), sentences(t), t.lower()
    n = len(w)
    length = 0 if n < 20 else 0.5 if n > 50000 else 1 if 100 <= n <= 2000 else 0.8 if 50 <= n <= 5000 else 0.6 if n <= 10000 else 0.3
    kinds = sum(bool(re.search(p, x, re.I)) for p in S.TAGS.values())
    levels = len(set(re.findall(r"<h([1-6])[^>]*>", x, re.I)))
    struct = 0.2 if not kinds else min(1, min(0.4, 0.1 * kinds) + min(0.3, 0.1 * levels) + 0.2 * bool(re.search(S.TAGS["code"], x, re.I)) + 0.1 * bool(re.search(S.TAGS["links"], x, re.I)))
    read = 0
    if w and s:
        long, wide = n / len(s), sum(map(len, w)) / n
        read = 1 - (0.3 if long > 25 else 0.1 if long > 20 else 0) - (0.2 if wide > 8 else 0.1 if wide > 6 else 0) + 0.1 * len({len(re.split(f"{BLANK}+", v.strip(SPACES))) for v in s}) / len(s)
        read = max(0, min(1, read))
    some = lambda terms: sum(v in low for v in terms)
    tech = min(0.4, 0.05 * some(S.TERMS)) + min(0.3, 0.03 * some(S.CODE)) + min(0.2, 0.1 * len(rx(S.EXTENSION, "i").findall(low))) + min(0.1, 0.05 * len(re.findall(r"(?:https?://|ftp://|sftp://|ssh://|git://)", low)))
    noise = 1 - min(0.4, 0.1 * some(S.ADS)) - min(0.3, 0.05 * some(S.NAV)) - min(0.2, 0.05 * some(S.PLATE)) - min(0.1, 0.02 * len(re.findall(r"[!]{2,}|[?]{2,}", low)))
    return {"length": length, "structure": struct, "readability": read, "technical": min(1, tech), "noise": max(0, min(1, noise))}


def fold(x, rules):
    for p, f, to in rules:
        x = rx(p, f).sub(to, x)
    return x


def first_steps(x):
    x = fold(unicodedata.normalize("NFC", x), [(a, "i", b) for a, b in C.MOJIBAKE])
    gap = r"(?:\s*\n\s*)?"
    x = fold(x, [(gap + p + gap, "i", "") for p in C.BOILERPLATE] + [(rf"(?:\s*{p}\s*)+", "i", "") for p in C.REPEATED])
    return fold(x, [(gap + p + gap, "i", "") for p in C.VIDEO])


def last_steps(x):
    x = fold(x, [(a, "i", b) for a, b in C.ENTITIES] + [(r"&[a-zA-Z0-9#]+;", "", " ")])
    x = fold(x, [(p, "", r"\1") for p, _ in (*C.EMPHASIS, *C.LINKS)])
    for a, b in C.CHARACTERS:
        x = x.replace(a, b)
    x = re.sub(r"[ \t]+", " ", re.sub("&para;", "", x.replace("¶", ""), flags=re.I))
    x = re.sub(r"\n{3}", "\n\n", re.sub(r"\n{4,}", "\n\n\n", x))
    return "\n".join(line.strip(SPACES) for line in x.split("\n")).strip(SPACES)
