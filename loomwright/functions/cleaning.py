"""Text cleaning as ordered replacement rules (pattern, flags, replacement) over a dialect."""

from __future__ import annotations

import re

from loomwright.functions.dialect import PLAIN_LINE, Dialect

# Phrases, entities, characters and patterns that the results depend on.
BOILERPLATE = (
    r"Sorry, your browser doesn't support embedded video\.?", r"Your browser doesn't support embedded video\.?", r"Browser doesn't support embedded video\.?", r"Video not supported\.?",
    r"Scroll For More", r"Learn More About\s+\w+", r"Made with.*cyberspace", r"Cookie Policy", r"Privacy Policy", r"Terms of Service", r"All rights reserved",
    r"Loading\.\.\.", r"Please wait\.\.\.", r"Click here to continue", r"Enable JavaScript", r"JavaScript is required",
)
REPEATED = (r"Sorry, your browser doesn't support embedded video", r"Your browser doesn't support embedded video", r"Browser doesn't support embedded video", r"Video not supported", r"Loading\.\.\.", r"Please wait\.\.\.")
VIDEO = (
    r"(Sorry, )?your browser doesn'?t support embedded video\.?", r"(Sorry, )?browser doesn'?t support embedded video\.?", r"Video not supported\.?", r"Video playback not supported\.?",
    r"Unable to play video\.?", r"\[Video Player\]", r"\[Video\]", r"\[Media Player\]", r"Play", r"Pause", r"Stop", r"Volume", r"Fullscreen",
    r"Video format not supported\.?", r"Codec not supported\.?", r"Flash Player required\.?", r"Adobe Flash required\.?",
)
ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#x2F;", "/"), ("&apos;", "'"), ("&#39;", "'"),
    ("&hellip;", "..."), ("&mdash;", "—"), ("&ndash;", "–"), ("&rsquo;", "'"), ("&lsquo;", "'"), ("&rdquo;", '"'), ("&ldquo;", '"'), ("&para;", ""),
)
MOJIBAKE = (("cafÃ©", "café"), ("naÃ¯ve", "naïve"), ("rÃ©sumÃ©", "résumé"), ("faÃ§ade", "façade"), ("garÃ§on", "garçon"))
CHARACTERS = (("¶", ""), ("\u00a0", " "), ("\u200b", ""), ("\u200c", ""), ("\u200d", ""), ("\ufeff", ""))
DROPPED_TAGS = ("script", "style", "nav", "header", "footer", "aside")
FRAMEWORK = (
    r"CopyCopied!", r"Find something\.\.\.", r"self\.__next_f\.push\([^)]*\)", r'\["\$[^"]*",[^\]]*\]', r'"\$\d+"', r'"\$L[^"]*"', r"self\.__next_f\.push\(\[[^\]]*\]\)",
    r'"\$undefined"', r'"\$S[^"]*"', r'"\$1[^"]*"', r'\["\$","\$[^"]*",[^\]]*\]', r'\["\$","html",[^\]]*\]', r'templateStyles.*?"\$undefined"', r'templateScripts.*?"\$undefined"',
    r'notFound.*?"\$undefined"', r'forbidden.*?"\$undefined"', r'unauthorized.*?"\$undefined"', r"else\s*\}\s*else\s*if\s*\([^)]*\)",
    r"""if\s*\([^)]*===\s*['"]light['"]\|\|[^)]*===\s*['"]dark['"]\)""", r"d\.style\.colorScheme\s*=\s*[^;]+", r"catch\s*\([^)]*\)\s*\{\s*\}\s*\}\s*\(\)",
)
SCRIPTS = (
    r"```(?:javascript|js|typescript|ts)[\s\S]*?```", r"self\.__next_f\.push\([^)]*\)", r"""import\s+from\s+["'][^"']*["']""", r"const\s+\w+\s*=\s*[^;]+;",
    r"function\s+\w+\s*\([^)]*\)\s*\{[^}]*\}", r"async\s+function\s+\w+\s*\([^)]*\)\s*\{[^}]*\}", r"=>\s*\{[^}]*\}", r"\.catch\([^)]*\)", r"\.then\([^)]*\)",
)
STYLES = (r"```(?:css|scss|sass)[\s\S]*?```", r"""style\s*=\s*["'][^"']*["']""", r"""class\s*=\s*["'][^"']*["']""")
COMMENTS = ((r"<!--[\s\S]*?-->", ""), (r"/\*[\s\S]*?\*/", ""), (r"//.*$", "m"))
NAVIGATION = (
    (r"^.*?Home\s*[>»→]\s*.*?[>»→].*$", "m"), (r"^.*?breadcrumb.*$", "im"), (r"skip\s+to\s+(main\s+)?content", "i"), (r"^(menu|navigation|nav|sidebar)$", "im"),
    (r"^.*?©.*?\d{4}.*$", "m"), (r"^.*?copyright.*?\d{4}.*$", "im"), (r"back\s+to\s+top", "i"), (r"↑.*?top", "i"), (r"print\s+this\s+page", "i"), (r"share\s+this", "i"),
    (r"this\s+site\s+uses\s+cookies", "i"), (r"we\s+use\s+cookies", "i"), (r"edit\s+this\s+page", "i"), (r"edit\s+on\s+github", "i"),
    (r"^.{0,50}(home|about|contact|blog|news|search|login|register|menu).*$", "im"),
)
EMPHASIS = ((r"\*\*\*(.*?)\*\*\*", 1), (r"\*\*_(.*?)_\*\*", 1), (r"_\*\*(.*?)\*\*_", 1), (r"\*\*(.*?)\*\*", 1), (r"__(.*?)__", 1), (r"\b\*(.*?)\*\b", 1), (r"\b_(.*?)_\b", 1), (r"~~(.*?)~~", 1))
LINKS = ((r"\[([^\]]+)\]\([^)]+\)", 1), (r"!\[([^\]]*)\]\([^)]+\)", 1))
# Suffixes that titles lose; a site's configuration gives its own (site_suffixes)
SUFFIX_WORDS = ("Cookbook", "Docs", "Documentation")
# What the enhancer takes for leavings of scripts, in its order
ARTIFACTS = (
    r"self\.__next_f\.push\([^)]*\)", r'\["\$[^"]*",[^\]]*\]', r'"\$\d+"', r'"\$L[^"]*"', r'"\$undefined"', r'"\$S[^"]*"', r'"\$1[^"]*"',
    r'\["\$","\$[^"]*",[^\]]*\]', r'\["\$","html",[^\]]*\]', r'templateStyles.*?"\$undefined"', r'templateScripts.*?"\$undefined"',
    r'notFound.*?"\$undefined"', r'forbidden.*?"\$undefined"', r'unauthorized.*?"\$undefined"', r"else\s*\}\s*else\s*if\s*\([^)]*\)",
    r"""if\s*\([^)]*===\s*['"]light['"]\|\|[^)]*===\s*['"]dark['"]\)""", r"d\.style\.colorScheme\s*=\s*[^;]+", r"catch\s*\([^)]*\)\s*\{\s*\}\s*\}\s*\(\)",
    r"""import\s+from\s+["'][^"']*["']""", r"const\s+\w+\s*=\s*[^;]+;", r"function\s+\w+\s*\([^)]*\)\s*\{[^}]*\}", r"async\s+function\s+\w+\s*\([^)]*\)\s*\{[^}]*\}",
    r"=>\s*\{[^}]*\}", r"\.catch\([^)]*\)", r"\.then\([^)]*\)", r"CopyCopied!", r"Find something\.\.\.",
)
FENCE, INLINE = r"```[\s\S]*?```", r"`[^`\n]+`"

# What must be in the lower-cased text for a group of rules to change anything
BOILERPLATE_MARKS = (
    "browser doesn't support embedded video", "video not supported", "scroll for more", "learn more about", "made with", "cookie policy", "privacy policy", "terms of service",
    "all rights reserved", "loading...", "please wait...", "click here to continue", "enable javascript", "javascript is required",
)
VIDEO_MARKS = ("video", "play", "pause", "stop", "volume", "fullscreen", "media player", "codec", "flash")
MARKDOWN_MARKS = ("*", "_", "~~", "[", "`")
EMPHASIS_MARKS = (("***",), ("**_", "_**"), ("_**", "**_"), ("**",), ("__",), ("*",), ("_",), ("~~",))

_GAP = r"(\s*\n\s*)?"
_SOME = rf"[{PLAIN_LINE}]*+\n\s*+"  # white space with a line end in it, in one way only


def _marks(pattern: str) -> tuple[str, ...]:
    """The runs of plain characters that each match of a pattern of this module has, in lower case."""
    must = re.sub(r"\([^()]*\)\?|\\?.[?*]|\\[sw]\+", "\n", pattern)
    return tuple(m.lower() for m in re.sub(r"\\(.)", r"\1", must).split("\n") if m)


def _between(d: Dialect, pattern: str) -> str:
    """pattern with white space around it that has a line end. Java's form starts only where a match
    can: at a first character of the pattern or at the first of a run of white space."""
    if not d.java:
        return _GAP + pattern + _GAP
    optional = re.match(r"\((.)[^)]*\)\?(.)", pattern)
    first = set("".join(optional.groups()) if optional else pattern.lstrip("\\")[0])
    first |= {c for f in first for c in (f.lower(), f.upper())}
    other = "".join(rf"\x{ord(c):02x}" for c in map(chr, range(33, 127)) if c not in first)
    return rf"(?![{other}])(?:(?<!\s){_SOME})?+{pattern}(?:{_SOME})?+"


def mojibake(d: Dialect, x: str) -> str:
    return d.fold_where(x, [(("Ã",), a, "i", b) for a, b in MOJIBAKE])


def boilerplate(d: Dialect, x: str) -> str:
    rules = [(_marks(p), _between(d, p), "i", "") for p in BOILERPLATE]
    return d.fold_where(x, [*rules, *((_marks(p), rf"(?:\s*{p}\s*)+", "i", "") for p in REPEATED)], True)


def video(d: Dialect, x: str) -> str:
    rules = [(_marks(p), _between(d, p), "i", "") for p in VIDEO]
    every = r"(Sorry, )?(your )?browser doesn'?t support embedded video\.?"
    return d.fold_where(x, [*rules, (_marks(every), rf"({_GAP}{every}{_GAP})+", "i", "")], True)


def entities(d: Dialect, x: str) -> str:
    return d.fold_where(x, [*(((a.lower(),), a, "i", b) for a, b in ENTITIES), (("&", ";"), r"&[a-zA-Z0-9#]+;", "", " ")], True)


def markdown(d: Dialect, x: str, client: bool = False) -> str:
    code = ((("`",), r"\b`([^`]+)`\b"),) if client else ()
    rules = (*zip(EMPHASIS_MARKS, (p for p, _ in EMPHASIS), strict=True), *code, *((("[", "]("), p) for p, _ in LINKS))
    return d.fold_where(x, [(m, p, "", r"\1") for m, p in rules])


def special(d: Dialect, x: str) -> str:
    return d.fold_where(x, [((a,), a, "", b) for a, b in CHARACTERS])


def _lines(d: Dialect, x: str) -> str:
    return d.trim(d.join(d.map(d.split(x, r"\n"), "l", d.trim("l")), "\n"))


def whitespace(d: Dialect, x: str, structure: bool = True) -> str:
    x = d.fold_where(d.fold_where(x, [(("¶",), "¶", "", "")]), [(("&para;",), "&para;", "i", "")], True)
    return _lines(d, d.fold_where(d.replace(x, r"[ \t]+", "", " "), [(("\n" * 4,), r"\n{4,}", "", "\n\n\n"), (("\n" * 3,), r"\n{3}", "", "\n\n")] if structure else [(("\n" * 2,), r"\n{2,}", "", "\n")]))


def strip_html(d: Dialect, x: str) -> str:
    rules = [(rf"<{t}\b[\s\S]*?</{t}>", "i", "") for t in DROPPED_TAGS]
    rules += [(p, "i", "") for p in (r"Sorry, your browser doesn't support embedded video", r"Scroll For More", r"Learn More About", r"Made with.*cyberspace")]
    return d.trim(d.fold(x, [*rules, (r"<[^>]*>", "", ""), (r"&[a-zA-Z0-9#]+;", "", " "), (r"\s+", "", " ")]))


def strip_tags(d: Dialect, x: str) -> str:
    if d.java:  # the pieces between white space with blanks between them
        return d.trim(d.let(d.fold_where(x, [(("<", ">"), r"<[^>]*>", "", " ")]), "y", lambda y: d.join(d.split_spaces(y, d.wide(y)), " ")))
    return d.trim(d.fold(x, [(r"<[^>]*>", "", " "), (r"\s+", "", " ")]))


def scripts(d: Dialect, x: str) -> str:
    return d.fold(x, [(p, "", "") for p in SCRIPTS])


def styles(d: Dialect, x: str) -> str:
    return d.fold(x, [(p, "", "") for p in STYLES])


def comments(d: Dialect, x: str) -> str:
    return d.fold(x, [(p, f, "") for p, f in COMMENTS])


def collapse(d: Dialect, x: str) -> str:
    return d.fold(x, [(r"\s+", "", " "), (r"^\s+|\s+$", "m", "")])


def framework(d: Dialect, x: str) -> str:
    return d.trim(d.fold(x, [(p, "", "") for p in FRAMEWORK]))


def code_cap(d: Dialect, x: str, most: int = 1000) -> str:
    """Fenced blocks of more than `most` characters are cut there and end in three dots; a fence
    without an end is left as it is."""
    whole = "concat('```', p, '```')"
    cut = lambda parts, i: f"CASE WHEN {i} % 2 = 0 THEN p WHEN {i} = {d.size(parts)} - 1 THEN concat('```', p) WHEN length(p) + 6 > {most} THEN concat({d.left(whole, most)}, '...') ELSE {whole} END"
    return d.let(d.split(x, "```"), "cp", lambda parts: d.join(d.map_at(parts, "p", lambda i: cut(parts, i)), ""))


def content_filters(d: Dialect, x: str, most_code: int = 2000) -> str:
    """The crawler's configured chain: scripts, styles, comments, white space, the cap on code, then framework noise."""
    return framework(d, code_cap(d, collapse(d, comments(d, styles(d, scripts(d, x)))), most_code))


def enhancer_filters(d: Dialect, x: str, most_code: int = 1000) -> str:
    """The enhancer's chain: artifacts (fenced blocks stay), style and class attributes, comments, white space, the cap."""
    x = d.fold(x, [(p, "", "") for p in (*ARTIFACTS, *STYLES[1:])])
    return d.trim(code_cap(d, collapse(d, comments(d, x)), most_code))


def isolate_code(d: Dialect, x: str) -> str:
    """Blank lines around fenced blocks, single blanks in inline code, and a blank line before and
    after runs of lines that begin with four blanks."""
    x = d.fold_where(x, [(("```",), f"({FENCE})", "", "\n\n\\1\n\n")])
    blank = lambda c: d.replace(c, r"\s+", "", " ")
    is_code, some, nl = lambda y: d.test(y, r"^    \S"), lambda y: f"{d.trim(y)} <> ''", d.lit("\n")

    def inline(y: str) -> str:
        return d.let(d.extract_all(y, INLINE, 0), "ic", lambda code: d.join(d.map_at(d.split(y, INLINE), "p", lambda i: f"concat(p, coalesce({blank(d.at(code, f'{i} + 1'))}, ''))"), ""))

    def spaced(lines: str, i: str) -> str:
        before = f"CASE WHEN {i} = 0 THEN NULL ELSE {d.at(lines, f'greatest({i}, 1)')} END"
        starts = f"{i} > 0 AND {is_code('l')} AND NOT {is_code(before)} AND {some(before)}"
        ends = f"{i} > 0 AND NOT {is_code('l')} AND {is_code(before)} AND {some('l')}"
        return f"CASE WHEN {starts} OR {ends} THEN concat({nl}, l) ELSE l END"

    x = d.let(x, "iy", lambda y: d.only_with(y, "`", inline(y)))
    return d.let(x, "iz", lambda y: d.only_with(y, "    ", d.let(d.split(y, r"\n"), "ls", lambda lines: d.join(d.map_at(lines, "l", lambda i: spaced(lines, i)), "\n"))))


def spacing(d: Dialect, x: str) -> str:
    """Headings, fenced blocks and paragraphs set apart."""
    return d.trim(d.fold(x, [(r"^(#{1,6})\s+(.+?)(\s*)$", "m", r"\1 \2"), (r"^(#{1,6}\s+.+)$", "m", "\\1\n"), (f"({FENCE})", "", "\n\\1\n"), (r"\n{3,}", "", "\n\n")]))


def bare(d: Dialect, x: str) -> str:
    """Markup without scripts, styles, tags and anything that looks like an entity."""
    return d.fold(x, [(r"<script\b[\s\S]*?</script>", "i", ""), (r"<style\b[\s\S]*?</style>", "i", ""), (r"<[^>]*>", "", ""), (r"&[^;]+;", "", " ")])


def enhanced(d: Dialect, x: str, line_safe: bool = False) -> str:
    """The enhancer's whole chain over markup. Stripping puts the text on one line, so that what
    follows acts on the whole document; line_safe keeps the lines."""
    text = bare(d, x) if line_safe else strip_html(d, bare(d, x))
    return d.trim(navigation(d, headings(d, isolate_code(d, tidy_lines(d, text)))))


def plain_text(d: Dialect, x: str) -> str:
    return d.trim(d.replace(x, r"\s+", "", " "))


def manual_text(d: Dialect, x: str) -> str:
    """Text of a manual extraction: without tags and entities if it has both < and >, on one line."""
    return f"CASE WHEN {d.has(x, '<')} AND {d.has(x, '>')} THEN {plain_text(d, d.fold(x, [(r'<[^>]*>', '', ''), (r'&[^;]+;', '', ' ')]))} ELSE {plain_text(d, x)} END"


def text_file(d: Dialect, x: str) -> str:
    """Cleaning of a plain-text file: the server's chain with tags taken out where the DOM step stands."""
    x = d.replace(video(d, boilerplate(d, mojibake(d, x))), r"<[^>]*>", "", "")
    return whitespace(d, special(d, markdown(d, entities(d, x))))


def client_chain(d: Dialect, x: str) -> str:
    """The browser's chain on markup without a DOM: white space ends in single newlines."""
    x = d.replace(video(d, boilerplate(d, mojibake(d, x))), r"<[^>]*>", "", "")
    return whitespace(d, special(d, markdown(d, entities(d, x), True)), False)


def tidy_lines(d: Dialect, x: str) -> str:
    rules = [(r"\r\n", "", "\n"), (r"\r", "", "\n"), (r"[ \t]+$", "m", ""), (r"^[ \t]+", "m", ""), (r"\n{3,}", "", "\n\n"), (r"[ \t]+", "", " "), (r"^\s+", "", ""), (r"\s+$", "", "")]
    return d.fold(x, rules)


def headings(d: Dialect, x: str) -> str:
    return d.fold(x, [(r"^(#{1,6})\s*(.+?)\s*#*$", "m", r"\1 \2"), (r"^(#{1,6}\s+.+)$", "m", "\n\\1\n"), (r"\n{3,}", "", "\n\n")])


def navigation(d: Dialect, x: str) -> str:
    return d.trim(d.fold(x, [*((p, f, "") for p, f in NAVIGATION), (r"\n{3,}", "", "\n\n")]))


def server_chain(d: Dialect, x: str) -> str:
    """Cleaning of plain text in the canonical order (without NFC and the DOM step)."""
    return whitespace(d, special(d, markdown(d, entities(d, video(d, boilerplate(d, mojibake(d, x)))))))


def first_steps(d: Dialect, source: str, x: str, name: str) -> str:
    """source with the text x after the repair of mojibake, boilerplate and video noise. Each group
    of rules runs only where one of its marks is in the text: without one it would change nothing."""
    source = d.stage(source, {"fs_0": d.if_any(x, ("Ã", "ã"), mojibake(d, x), x)})
    source = d.stage(d.stage(source, {"fs_low": "lower(fs_0)"}), {"fs_1": d.if_any("fs_low", BOILERPLATE_MARKS, boilerplate(d, "fs_0"), "fs_0")})
    return d.stage(d.stage(source, {"fs_low1": "lower(fs_1)"}), {name: d.if_any("fs_low1", VIDEO_MARKS, video(d, "fs_1"), "fs_1")})


def last_steps(d: Dialect, source: str, x: str, name: str, client: bool = False) -> str:
    """source with the text x after entities, markdown, special characters and white space."""
    source = d.stage(source, {"ls_0": d.if_any(x, ("&",), entities(d, x), x)})
    source = d.stage(source, {"ls_1": d.if_any("ls_0", MARKDOWN_MARKS, markdown(d, "ls_0", client), "ls_0")})
    source = d.stage(source, {"ls_2": d.if_any("ls_1", [c for c, _ in CHARACTERS], special(d, "ls_1"), "ls_1")})
    return d.stage(source, {name: whitespace(d, "ls_2", not client)})


def server_query(d: Dialect, source: str, x: str, name: str) -> str:
    """source with the whole chain over a text column: the same as server_chain, in steps."""
    return last_steps(d, first_steps(d, source, x, "sq_text"), "sq_text", name)


def clean_title(d: Dialect, x: str) -> str:
    return d.left(d.trim(d.fold(x, [(r"\s+", "", " "), (r"[^\w\s()\[\]-]", "", "")])), 200)


def site_suffixes(words: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """Rules that take a site's own words off the end of its titles: after a dash, then bare."""
    return [(rf"\s*-\s*({'|'.join(words)})\s*$", "i", ""), *((rf"\s*{w}\s*$", "i", "") for w in words)]


def document_title(d: Dialect, x: str, words: tuple[str, ...] = SUFFIX_WORDS) -> str:
    return d.trim(d.replace(d.fold(x, site_suffixes(words)), r"\s+", "", " "))


def enhancer_title(d: Dialect, x: str) -> str:
    return d.left(d.trim(d.replace(x, r"\s+", "", " ")), 200)


def slug(d: Dialect, x: str) -> str:
    return d.replace(x, r"[^a-zA-Z0-9]", "", "-")


def display_title(d: Dialect, x: str) -> str:
    x = d.replace(x, r"\s*[|\-–—]\s*(Cookbook|Documentation|Docs|Guide|Tutorial|Help|Support|Home|Index|Main|Page)\s*$", "i", "")
    x = d.trim(d.fold(d.trim(x), [(r"[#*_`]", "", ""), (r"\s+", "", " ")]))
    return f"coalesce(nullif({x}, ''), 'Untitled')"


def url_host(d: Dialect, u: str) -> str:
    return f"lower({d.extract(u, r'^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)})"


def url_path(d: Dialect, u: str) -> str:
    return d.extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_parts(d: Dialect, u: str) -> str:
    return d.filter(d.split(url_path(d, u), "/"), "p", "p <> ''")


_NAME = [(r"[-_]", "", " "), (r"\.(html?|php|aspx?)$", "i", "")]


def url_title(d: Dialect, u: str) -> str:
    name = d.fold(f"coalesce({d.last(url_parts(d, u))}, 'Home')", _NAME)
    return d.join(d.map(d.split(name, " "), "w", f"concat(upper({d.left('w', 1)}), lower({d.rest('w', 2)}))"), " ")


def first_upper(d: Dialect, x: str, lower: bool = False) -> str:
    rest = d.rest(x, 2)
    return f"concat(upper({d.left(x, 1)}), {f'lower({rest})' if lower else rest})"


def bare_host(d: Dialect, u: str) -> str:
    return d.replace(url_host(d, u), r"^www\.", "", "")


def enhancer_url_title(d: Dialect, u: str) -> str:
    """The last path segment with each word's first letter raised, else the host."""
    name = d.fold(d.last(url_parts(d, u)), _NAME)
    words = d.map(d.extract_all(name, r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+", 0), "w", first_upper(d, "w"))
    return f"coalesce({d.join(words, '')}, {bare_host(d, u)})"


_FILE = r"\.(html?|php|aspx?|md|txt)$"


def client_url_title(d: Dialect, source: str, u: str, name: str) -> str:
    """source with the browser's title of a URL: last segment, or what is above a generic one, and its context."""
    parts, plain = url_parts(d, u), lambda x: d.replace(x, r"[-_]", "", " ")
    generic = lambda x: d.test(x, r"^(index|home|readme)?$", "i")
    source = d.stage(source, {"ct_host": bare_host(d, u), "ct_last": d.replace(f"coalesce({d.last(parts)}, '')", _FILE, "i", ""), "ct_up": f"CASE WHEN {d.size(parts)} > 1 THEN {d.at(parts, d.size(parts) + ' - 1')} ELSE '' END"})
    own = f"CASE WHEN {generic('ct_last')} THEN CASE WHEN ct_up <> '' THEN ct_up ELSE ct_host END ELSE ct_last END"
    above = f"CASE WHEN {generic('ct_last')} OR {generic('ct_up')} THEN {d.extract('ct_host', r'^([^.]*)', 1)} ELSE {plain('ct_up')} END"
    source = d.stage(source, {"ct_own": plain(own), "ct_above": above})
    source = d.stage(source, {"ct_own2": first_upper(d, "ct_own"), "ct_above2": first_upper(d, "ct_above")})
    full = "CASE WHEN ct_above2 <> '' AND lower(ct_above2) <> lower(ct_own2) THEN concat(ct_own2, ' - ', ct_above2) ELSE ct_own2 END"
    return d.stage(source, {name: f"coalesce(nullif({d.trim(full)}, ''), 'Untitled Document')"})


def breadcrumb_path(d: Dialect, u: str) -> str:
    """host > Segment > Segment, the last one without its file extension."""
    parts = url_parts(d, u)
    named = d.map_at(parts, "p", lambda i: first_upper(d, d.replace(f"CASE WHEN {i} = {d.size(parts)} - 1 THEN {d.replace('p', _FILE, 'i', '')} ELSE p END", r"[-_]", "", " "), True))
    return f"CASE WHEN {d.size(parts)} = 0 THEN {url_host(d, u)} ELSE concat({url_host(d, u)}, ' > ', {d.join(named, ' > ')}) END"


def tidy_url(d: Dialect, u: str, tracking: tuple[str, ...]) -> str:
    """Default scheme https, host of 3 characters or more (else NULL), no tracking parameters; of
    parameters with one name the last value in the first one's place."""
    u = f"CASE WHEN {d.test(u, r'^https?://')} THEN {u} ELSE concat('https://', {u}) END"
    path, end = f"coalesce(nullif({url_path(d, u)}, ''), '/')", d.extract(u, r"(#.*)$", 1)
    pairs = d.filter(d.split(d.extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), "q", "q <> ''")
    key = lambda q: d.extract(q, r"^([^=]*)", 1)
    names = d.map(pairs, "k", key("k"))
    same = d.last(d.filter(pairs, "z", f"{key('z')} = {key('p')}"))
    kept = lambda i: f"CASE WHEN {key('p')} IN ({', '.join(map(d.lit, tracking))}) OR {d.place(names, key('p'))} <> {i} + 1 THEN '' ELSE concat({key('p')}, '=', {d.replace(same, r'^[^=]*=?', '', '')}) END"
    query = d.join(d.filter(d.map_at(pairs, "p", kept), "t", "t <> ''"), "&")
    host = d.extract(u, r"^[a-z]+://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return f"CASE WHEN length({url_host(d, u)}) < 3 THEN NULL ELSE concat({d.extract(u, r'^([a-z]+://)', 1)}, lower({host}), {path}, CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END, {end}) END"


def breadcrumbs(d: Dialect, u: str) -> str:
    return d.map(url_parts(d, u), "p", f"lower({d.fold('p', _NAME)})")
