"""One expression language for two engines.

Operators are written once as SQL expressions over a `Dialect`; Spark runs the one form, and the
other form is the oracle. Patterns are written as ECMAScript regular expressions and translated:
white space and word boundaries become explicit classes, `$` without m is the very end, and only
\\n ends a line.
"""

from __future__ import annotations

import re

# ECMAScript white space, written for use inside a class
SPACE = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
PLAIN_LINE = SPACE.replace(r"\t-", r"\t\x0b-")  # without the line end
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
# White space that most texts have only, and what a text must have to have any other
PLAIN_SPACE, WIDE = r"[\t-\r ]", r"[\x{a0}\x{1680}-\x{feff}]"
_W = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"


def translate(pattern: str, flags: str, java: bool) -> str:
    words = re.fullmatch(r"\\b\(([a-z|]+)\)\\b", pattern)
    if java and words:  # a list of whole words: look at the first letter before anything else
        first = "".join(sorted({w[0] for w in words[1].split("|")}))
        return f"{'(?i)' * ('i' in flags)}(?=[{first}])(?<!{_W})(?:{words[1]})(?!{_W})"
    if java and pattern.startswith(r"\b["):  # a class of word characters
        return translate(pattern[2:], flags, java).replace("[", f"(?<!{_W})[", 1)
    out, inside, i = [], False, 0
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if pattern.startswith(r"[\s\S]", i):
            out.append("(?s:.)")
            i += 6
            continue
        if two in (r"\s", r"\S") and (two == r"\s" or not inside):
            out.append(SPACE if inside else f"[{'^' * (two == r'\S')}{SPACE}]")
        elif two == r"\b" and not inside:
            out.append(_BOUNDARY if java else r"\b")
        elif c == "\\":
            out.append(two)
        elif c == "$" and not inside and "m" not in flags:
            out.append(r"\z")
        else:
            inside = (inside or c == "[") and c != "]"
            out.append(c)
        i += 2 if c == "\\" else 1
    marks = ("d" if java else "") + "".join(f for f in flags if f in "im")
    return (f"(?{marks})" if marks else "") + "".join(out)


class Dialect:
    java = True

    def lit(self, s: str) -> str:
        raise NotImplementedError

    def rx(self, pattern: str, flags: str = "") -> str:
        return self.lit(translate(pattern, flags, self.java))

    def fold(self, x: str, rules) -> str:
        """Apply (pattern, flags, replacement) rules in order; replacements use \\1."""
        for pattern, flags, to in rules:
            x = self.replace(x, pattern, flags, to)
        return x

    def if_any(self, where: str, marks, then: str, x: str) -> str:
        """then, but x where none of the marks occurs: for rules that change nothing without one."""
        return f"CASE WHEN {' OR '.join(self.has(where, m) for m in marks)} THEN {then} ELSE {x} END"

    def fold_where(self, x: str, rules, low: bool = False) -> str:
        """fold with rules (marks, pattern, flags, replacement): a rule changes nothing unless all of
        its marks are in the text as it is then (low: in lower case), so Spark looks for them first."""
        return self.fold(x, [r[1:] for r in rules])

    def let(self, x: str, name: str, body) -> str:
        """body(x), where Spark computes x once: an expression inside a lambda is computed for each element."""
        return body(x)

    def only_with(self, x: str, mark: str, then: str) -> str:
        """then, which is x where the mark is not in x; Spark looks for the mark first."""
        return then

    def test_where(self, x: str, marks, pattern: str, flags: str = "", where: str | None = None) -> str:
        """test of a pattern that no text without one of the marks matches (where: the text that has them)."""
        return self.test(x, pattern, flags)

    def count_where(self, x: str, marks, pattern: str, flags: str = "", where: str | None = None) -> str:
        """count, likewise"""
        return self.count(x, pattern, flags)

    def words(self, x: str) -> str:
        return self.filter(self.split(x, r"\s+"), "w", "w <> ''")

    def n_words(self, x: str) -> str:
        return self.size(self.words(x))

    def any_of(self, x: str, words) -> str:
        """How many of the words are substrings of x."""
        return "(" + " + ".join(f"CASE WHEN {self.has(x, w)} THEN 1 ELSE 0 END" for w in words) + ")"

    def fixed(self, x: str, n: int = 0) -> str:
        """A number that is not negative with n decimals, halves upwards."""
        v = f"CAST(floor({x} * {10**n} + 0.5) AS BIGINT)"
        if not n:
            return f"CAST({v} AS STRING)"
        return f"concat(CAST({self.div(v, 10**n)} AS STRING), '.', lpad(CAST({v} % {10**n} AS STRING), {n}, '0'))"

    def sum_of(self, flags) -> str:
        return "(" + " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in flags) + ")"


class Spark(Dialect):
    java = True
    double = "DOUBLE"

    def lit(self, s):
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def trim(self, x):
        return f"trim(BOTH {self.lit(SPACES)} FROM {x})"

    def replace(self, x, pattern, flags, to):
        return f"regexp_replace({x}, {self.rx(pattern, flags)}, {self.lit(re.sub(r'\\(\d)', r'$\1', to.replace('$', r'\$')))})"

    def fold_where(self, x, rules, low=False):
        """One aggregate over the rules' places, as a lambda for each rule would nest too deep."""
        value, where = ("s.v", "s.l") if low else ("s", "s")
        pair = lambda v: f"named_struct('v', {v}, 'l', lower({v}))" if low else v
        whens = []
        for k, (marks, pattern, flags, to) in enumerate(rules):
            done = self.replace(value, pattern, flags, to)
            done = self.let(done, "t", pair) if low else done
            whens.append(f"WHEN k = {k} AND {' AND '.join(self.has(where, m) for m in marks)} THEN {done}")
        zero = self.let(x, "t", pair) if low else x
        return f"aggregate(sequence(0, {len(rules) - 1}), {zero}, (s, k) -> CASE {' '.join(whens)} ELSE s END, s -> {value})"

    def let(self, x, name, body):
        return f"element_at(transform(array({x}), {name} -> {body(name)}), 1)"

    def only_with(self, x, mark, then):
        return f"CASE WHEN {self.has(x, mark)} THEN {then} ELSE {x} END"

    def test_where(self, x, marks, pattern, flags="", where=None):
        return f"(({' OR '.join(self.has(where or x, m) for m in marks)}) AND {self.test(x, pattern, flags)})"

    def count_where(self, x, marks, pattern, flags="", where=None):
        return f"CASE WHEN NOT ({' OR '.join(self.has(where or x, m) for m in marks)}) THEN CAST(0 AS BIGINT) ELSE {self.count(x, pattern, flags)} END"

    def test(self, x, pattern, flags=""):
        return f"({x} RLIKE {self.rx(pattern, flags)})"

    def count(self, x, pattern, flags=""):
        return f"CAST(regexp_count({x}, {self.rx(pattern, flags)}) AS BIGINT)"

    def extract(self, x, pattern, group, flags=""):
        return f"regexp_extract({x}, {self.rx(pattern, flags)}, {group})"

    def extract_all(self, x, pattern, group, flags=""):
        return f"regexp_extract_all({x}, {self.rx(pattern, flags)}, {group})"

    def split(self, x, pattern, flags=""):
        return f"split({x}, {self.rx(pattern, flags)}, -1)"

    def filter(self, xs, v, cond):
        return f"filter({xs}, {v} -> {cond})"

    def map(self, xs, v, e):
        return f"transform({xs}, {v} -> {e})"

    def size(self, xs):
        return f"CAST(size({xs}) AS BIGINT)"

    def distinct(self, xs):
        return f"array_distinct({xs})"

    def has(self, x, s):
        return f"contains({x}, {self.lit(s)})"

    def join(self, xs, sep):
        return f"array_join({xs}, {self.lit(sep)})"

    def last(self, xs):
        return f"try_element_at({xs}, -1)"

    def cut(self, xs, a, n):
        return f"slice({xs}, {a}, {n})"

    def explode(self, xs, name):
        return f"explode({xs}) AS {name}"

    def left(self, x, n):
        return f"substring({x}, 1, {n})"

    def rest(self, x, n):
        return f"substring({x}, {n})"

    def stage(self, source, columns):
        """source with further columns that are computed once: no filter or projection above is
        merged into the generator, so costly expressions are not evaluated again."""
        made = ", ".join(f"{self.lit(k)}, {e}" for k, e in columns.items())
        return f"SELECT * FROM ({source}) src LATERAL VIEW inline(array(named_struct({made}))) made AS {', '.join(columns)}"

    def joined(self, x, sep, order):
        return f"listagg({x}, {self.lit(sep)}) WITHIN GROUP (ORDER BY {order})"

    def array(self, items):
        return f"array({', '.join(items)})"

    def map_at(self, xs, v, e):
        """e: from the element's place, counted from 0, to the new element."""
        return f"transform({xs}, ({v}, i) -> {e('i')})"

    def at(self, xs, n):
        """The n-th element, counted from 1; NULL if there is none."""
        return f"try_element_at({xs}, CAST({n} AS INT))"

    def place(self, xs, v):
        return f"array_position({xs}, {v})"

    def matches(self, x, pattern):
        """A pattern that is a value of the row."""
        return f"({x} RLIKE {pattern})"

    def div(self, a, b):
        return f"({a} div {b})"

    def thousands(self, n):
        return f"format_number({n}, 0)"

    def micros(self, ts):
        return f"unix_micros(CAST({ts} AS TIMESTAMP))"

    def iso(self, ts):
        return f"date_format({ts}, {self.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")})"

    def powers(self, base, n):
        return f"CAST(power({base}, {n}) AS BIGINT)"


    def wide(self, x):
        """Whether x may have white space beyond PLAIN_SPACE."""
        return f"CASE WHEN octet_length({x}) = length({x}) THEN false ELSE {x} RLIKE {self.lit(WIDE)} END"

    def split_spaces(self, x, wide):
        """split at white space; a class of few characters is several times as fast."""
        return f"split({x}, CASE WHEN {wide} THEN {self.rx(r'\s+')} ELSE {self.lit(PLAIN_SPACE + '+')} END, -1)"


class Duck(Dialect):
    java = False

    def lit(self, s):
        return "'" + s.replace("'", "''") + "'"

    def trim(self, x):
        return f"trim({x}, {self.lit(SPACES)})"

    def replace(self, x, pattern, flags, to):
        return f"regexp_replace({x}, {self.rx(pattern, flags)}, {self.lit(to)}, 'g')"

    def test(self, x, pattern, flags=""):
        return f"regexp_matches({x}, {self.rx(pattern, flags)})"

    def count(self, x, pattern, flags=""):
        return f"CAST(len(regexp_extract_all({x}, {self.rx(pattern, flags)})) AS BIGINT)"

    def extract(self, x, pattern, group, flags=""):
        return f"regexp_extract({x}, {self.rx(pattern, flags)}, {group})"

    def extract_all(self, x, pattern, group, flags=""):
        return f"regexp_extract_all({x}, {self.rx(pattern, flags)}, {group})"

    def split(self, x, pattern, flags=""):
        return f"string_split_regex({x}, {self.rx(pattern, flags)})"

    def filter(self, xs, v, cond):
        return f"list_filter({xs}, lambda {v}: {cond})"

    def map(self, xs, v, e):
        return f"list_transform({xs}, lambda {v}: {e})"

    def size(self, xs):
        return f"CAST(len({xs}) AS BIGINT)"

    def distinct(self, xs):
        return f"list_distinct({xs})"

    def has(self, x, s):
        return f"contains({x}, {self.lit(s)})"

    def join(self, xs, sep):
        return f"array_to_string({xs}, {self.lit(sep)})"

    def last(self, xs):
        return f"({xs})[-1]"

    def cut(self, xs, a, n):
        return f"({xs})[{a}:{a} + {n} - 1]"

    def explode(self, xs, name):
        return f"unnest({xs}) AS {name}"

    def left(self, x, n):
        return f"substring({x}, 1, {n})"

    def rest(self, x, n):
        return f"substring({x}, {n})"

    def stage(self, source, columns):
        return f"SELECT *, {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM ({source}) src"

    def joined(self, x, sep, order):
        return f"string_agg({x}, {self.lit(sep)} ORDER BY {order})"

    def array(self, items):
        return f"[{', '.join(items)}]"

    def map_at(self, xs, v, e):
        return f"list_transform({xs}, lambda {v}, i: {e('(i - 1)')})"

    def at(self, xs, n):
        return f"({xs})[{n}]"

    def place(self, xs, v):
        return f"list_position({xs}, {v})"

    def matches(self, x, pattern):
        return f"regexp_matches({x}, {pattern})"

    def div(self, a, b):
        return f"({a} // {b})"

    def thousands(self, n):
        return f"format('{{:,}}', {n})"

    def micros(self, ts):
        return f"epoch_us(CAST({ts} AS TIMESTAMP))"

    def iso(self, ts):
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"

    def powers(self, base, n):
        return f"CAST(power({base}, {n}) AS BIGINT)"


SPARK, DUCK = Spark(), Duck()
