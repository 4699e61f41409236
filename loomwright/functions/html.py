"""HTML to content: the one Python step, an Arrow pass over pages.

A tolerant parser builds a tree; everything that walks it uses an explicit stack, so depth is no
limit. From the tree come the semantic candidate (ordered selectors on a tree that loses its
excluded elements as it is searched), structured text, titles, links and metadata. What the score
gate decides is left to SQL (plans.extraction), which gets the candidate and, only where the gate
can fail, the body's markup for the last resort.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

from loomwright.functions.dialect import SPACES
from loomwright.session import SLICE_BYTES, arrow_map

# Elements, selectors in order, and structural marks
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("button caption html marquee object table td th template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
REMOVED = ("script", "style", "noscript", "iframe", "embed", "object", "applet", "video", "audio", "canvas", "svg")
UNWRAPPED = ("nav", "header", "footer", "aside", "div", "span", "strong", "b", "em", "i", "u", "mark", "small", "sub", "sup")
SELECTORS = ("main", "article", '[role="main"]', ".content", ".main-content", "#content", "#main", "body")
EXCLUDED = ("nav", "header", "footer", "aside", ".sidebar", ".navigation", ".menu", ".breadcrumb", ".pagination", ".comments", ".advertisement", ".ads", '[class*="ad-"]', '[id*="ad-"]')
HEADINGS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### "}
CODE_TAGS = frozenset(("pre", "code", "samp", "kbd", "var"))
CLIENT_MARKED = CODE_TAGS | frozenset(HEADINGS) | {"li", "blockquote", "p", "dt", "dd"}
RAW_TEXT = frozenset(("script", "style"))
LEAST, LEAST_SCORED = 50, 100
_BLANKS = re.compile(f"[{SPACES}]+")


class Node:
    __slots__ = ("tag", "attrs", "items", "parent")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.items, self.parent = tag, {k: v or "" for k, v in attrs}, [], parent

    def walk(self):
        """The node and those below it, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(x for x in reversed(n.items) if isinstance(x, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.items))
        return "".join(out)

    def trimmed(self) -> str:
        return self.text().strip(SPACES)

    def markup(self) -> str:
        """The markup of what is inside."""
        out, stack = [], list(reversed(self.items))
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, str):
                out.append(escape(x, quote=False))
            else:
                out.append(f"<{x.tag}{''.join(f' {k}="{escape(v)}"' for k, v in x.attrs.items())}>")
                if x.tag in RAW_TEXT:
                    out.append(x.text() + f"</{x.tag}>")
                elif x.tag not in VOID:
                    stack.append((f"</{x.tag}>",))
                    stack.extend(reversed(x.items))
        return "".join(out)

    def matches(self, selector: str) -> bool:
        """Tag, .class, #id, [attribute="value"] and [attribute*="part"]."""
        first = selector[0]
        if first == ".":
            return selector[1:] in self.attrs.get("class", "").split()
        if first == "#":
            return self.attrs.get("id") == selector[1:]
        if first == "[":
            name, value = selector[1:-1].split("=", 1)
            value = value.strip("\"'")
            return value in self.attrs.get(name[:-1], "") if name.endswith("*") else self.attrs.get(name) == value
        return self.tag == selector

    def find(self, *selectors: str) -> Node | None:
        """The first node below that matches any of the selectors."""
        return next((n for n in self.walk() if n is not self and any(n.matches(s) for s in selectors)), None)

    def remove(self, *selectors: str) -> None:
        """Without the nodes below that match any of the selectors."""
        stack = [self]
        while stack:
            n = stack.pop()
            n.items = [x for x in n.items if isinstance(x, str) or not any(x.matches(s) for s in selectors)]
            stack.extend(x for x in n.items if isinstance(x, Node))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.count: dict[str, int] = {}  # of open elements by tag

    def _push(self, node: Node) -> None:
        self.open.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def _cut(self, k: int) -> None:
        for n in self.open[k:]:
            self.count[n.tag] -= 1
        del self.open[k:]

    def _close_p(self) -> list[Node]:
        """Close an open paragraph; the formatting elements that were open inside it go on after it."""
        for k in range(len(self.open) - 1, 0, -1) if self.count.get("p") else ():
            if self.open[k].tag == "p":
                again = [n for n in self.open[k + 1 :] if n.tag in FORMATTING]
                self._cut(k)
                return again
            if self.open[k].tag in SCOPE:
                break
        return []

    def _add(self, tag, attrs) -> Node:
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].items.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        again = self._close_p() if tag in CLOSES_P else []
        if tag in IMPLIED:
            while len(self.open) > 1 and self.open[-1].tag in IMPLIED[tag]:
                self._cut(len(self.open) - 1)
        node = self._add(tag, attrs)
        if tag not in VOID:
            self._push(node)
            for f in again:
                self._push(self._add(f.tag, f.attrs.items()))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1) if self.count.get(tag) else ():
            if self.open[k].tag == tag:
                self._cut(k)
                break

    def handle_data(self, data):
        self.open[-1].items.append(data)


def parse(html: str | None) -> Node:
    """The document: a node #root that has a body, even if the markup has none."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    if b.root.find("body") is None:
        body = Node("body", (), b.root)
        body.items = [x for x in b.root.items if isinstance(x, str) or x.tag != "head"]
        b.root.items = [x for x in b.root.items if isinstance(x, Node) and x.tag == "head"] + [body]
        for x in body.items:
            if isinstance(x, Node):
                x.parent = body
    return b.root


def body_of(root: Node) -> Node:
    return root.find("body")


def structured(node: Node) -> str:
    """Text of a tree with marks for headings, lists, quotes, definitions and code."""
    frames: list = [(node, iter(node.items), [])]
    while True:
        n, items, parts = frames[-1]
        x = next(items, None)
        if isinstance(x, str):
            x = x.strip(SPACES)
            parts.append(x + " " if x else "")
            continue
        if x is not None:
            if x.tag == "br":
                parts.append("\n")
            elif x.tag == "hr":
                parts.append("\n---\n\n")
            elif x.tag in ("pre", "code"):
                inner = x.trimmed()
                parts.append("" if not inner else f"```\n{inner}\n```\n\n" if x.tag == "pre" else f"`{inner}` ")
            else:
                frames.append((x, iter(x.items), []))
            continue
        frames.pop()
        inner = "".join(parts).strip(SPACES)
        if not inner:
            out = ""
        elif n.tag in HEADINGS:
            out = f"{HEADINGS[n.tag]}{inner}\n\n"
        elif n.tag == "p":
            out = inner + "\n\n"
        elif n.tag == "li":
            out = f"- {inner}\n"
        elif n.tag == "blockquote":
            out = "".join(f"> {s}\n" for line in inner.split("\n") if (s := line.strip(SPACES))) + "\n"
        elif n.tag == "dt":
            out = f"**{inner}**\n"
        elif n.tag == "dd":
            out = f": {inner}\n"
        else:
            out = inner + " "
        if not frames:
            return out
        frames[-1][2].append(out)


def client_structured(node: Node) -> str:
    """The browser's form: a structural element gives its flat text with one mark, others their children's."""
    filled: set[int] = set()  # nodes with text
    for n in node.walk():
        if any(isinstance(x, str) and x.strip(SPACES) for x in n.items):
            while n is not None and id(n) not in filled:
                filled.add(id(n))
                n = n.parent
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if id(x) not in filled:
            continue
        text = x.trimmed() if x.tag in CLIENT_MARKED else ""
        if x.tag in HEADINGS:
            out.append(f"{HEADINGS[x.tag]}{text}\n")
        elif x.tag == "pre":
            out.append(f"```\n{text}\n```\n\n")
        elif x.tag in CODE_TAGS:
            out.append(f"`{text}`")
        elif x.tag == "li":
            out.append(f"- {text}\n")
        elif x.tag == "blockquote":
            out += [f"> {s}\n" for line in text.split("\n") if (s := line.strip(SPACES))]
        elif x.tag == "p":
            out.append(text + "\n")
        elif x.tag in ("dt", "dd"):
            out.append(f"{'**' if x.tag == 'dt' else ': '}{text}\n")
        else:
            stack.extend(reversed(x.items))
    return "".join(out)


def clean_dom(html: str | None, client: bool = False) -> str:
    """Markup to structured text: some elements go with their content, some leave their flat text."""
    if not html:
        return html or ""
    root = parse(html)
    root.remove(*REMOVED)
    for tag in UNWRAPPED:
        stack = [root]
        while stack:
            n = stack.pop()
            items = []
            for x in n.items:
                if isinstance(x, Node) and x.tag == tag:
                    text = x.trimmed()
                    items += [text + "\n"] if text else []
                else:
                    items.append(x)
            n.items = items
            stack.extend(x for x in items if isinstance(x, Node))
    return (client_structured if client else structured)(body_of(root))


def semantic(root: Node) -> tuple[str | None, str]:
    """(text, reason) of the first selector with over LEAST characters. The tree loses the excluded
    elements of each candidate, also for the selectors that come after."""
    for s in SELECTORS:
        n = root.find(s)
        if n is not None and len(n.trimmed()) > LEAST:
            n.remove(*EXCLUDED)
            text = n.trimmed()
            if len(text) > LEAST:
                return text, f"found_content_in_{s}"
    return None, "no_suitable_content_found"


def surely_scored(text: str) -> bool:
    """Whether the score is over the gate of 0.05 whatever else is in the text: 100 characters or
    more, no run of four newlines, fences balanced give 0.35 x 0.2 at least."""
    return len(text) >= LEAST_SCORED and "\n" * 4 not in text and ("```" not in text or re.search(r"```[\s\S]*?```", text) is not None)


def resolve(href: str, base: str | None) -> str | None:
    """href against base as a browser does it, for http and https; None if that cannot be."""
    try:
        url = urljoin(base or "", href.strip(SPACES))
        parts = urlsplit(url)
        if parts.scheme in ("http", "https"):
            if not parts.hostname:
                return None
            port = f":{parts.port}" if parts.port and parts.port != {"http": 80, "https": 443}[parts.scheme] else ""
            user = parts.netloc.rpartition("@")[0]
            url = f"{parts.scheme}://{user + '@' if user else ''}{parts.hostname}{port}{parts.path or '/'}"
            return url + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")
        return url if parts.scheme else None
    except ValueError:
        return None


def first_text(root: Node, selectors: tuple[str, ...]) -> str:
    """The first text that is not blank, by selector order."""
    for s in selectors:
        n = root.find(s)
        if n is not None and (text := n.trimmed()):
            return text
    return ""


def words(text: str) -> int:
    return sum(1 for w in _BLANKS.split(text) if w)


def manual(root: Node, selectors: tuple[str, ...]) -> str:
    """The crawler's own extraction: the first selector that is there, its text on one line."""
    for s in selectors:
        n = root.find(s)
        if n is not None:
            text = n.text()
            if "<" in text and ">" in text:
                text = re.sub(r"&[^;]+;", " ", re.sub(r"<[^>]*>", "", text))
            return _BLANKS.sub(" ", text).strip(SPACES)
    return ""


def enhanced(root: Node, selectors: tuple[str, ...], least: int = 50) -> tuple[str, str]:
    """The enhancer's extraction: the first selector with enough words, else the body."""
    for s in selectors:
        n = root.find(s)
        if n is not None and words(n.text()) >= least:
            return _BLANKS.sub(" ", n.text()).strip(SPACES), s
    return _BLANKS.sub(" ", body_of(root).text()).strip(SPACES), "body"


def metadata(root: Node, url: str | None) -> dict[str, str]:
    """What <meta>, <link> and the address tell about a page."""
    tags: dict[str, str] = {}
    for n in root.walk():
        if n.tag == "meta" and n.attrs.get("content"):
            name = n.attrs.get("name") or n.attrs.get("property")
            if name:
                tags.setdefault(name.lower(), n.attrs["content"])
    icon = next((n.attrs["href"] for n in root.walk() if n.tag == "link" and "icon" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href")), "")
    pick = lambda *names: next((tags[n] for n in names if n in tags), "")
    host = urlsplit(url or "").hostname or ""
    found = {
        "description": pick("description", "og:description", "twitter:description"), "domain": host.removeprefix("www."), "favicon": resolve(icon, url) or "" if icon else "",
        "image": pick("og:image", "twitter:image"), "published": pick("article:published_time", "date"), "author": pick("author", "article:author"), "site": pick("og:site_name"),
    }
    return {k: v for k, v in found.items() if v}


def links(root: Node, url: str | None) -> list[str]:
    """The distinct resolved targets of a page's anchors, in their order."""
    found = (resolve(n.attrs["href"], url) for n in root.walk() if n.tag == "a" and n.attrs.get("href"))
    return list(dict.fromkeys(x for x in found if x))


FIELDS = {
    "title": pa.string(), "heading": pa.string(), "content": pa.string(), "reason": pa.string(), "body": pa.string(), "structured": pa.string(),
    "manual": pa.string(), "enhanced": pa.string(), "enhanced_by": pa.string(), "links": pa.list_(pa.string()), "meta": pa.map_(pa.string(), pa.string()),
}
DDL = {"links": "array<string>", "meta": "map<string, string>"}
MANUAL = ("main", "article", ".content", '[role="main"]')
ENHANCED = ("main", ".content", "article", '[role="main"]')


def extract(html: str | None, url: str | None, wanted: frozenset[str]) -> dict:
    root = parse(html)
    out: dict = {}
    if "links" in wanted:
        out["links"] = links(root, url)
    if "meta" in wanted:
        out["meta"] = list(metadata(root, url).items())
    head = root.find("title", "h1")  # in document order
    out["title"] = head.trimmed() if head is not None else ""
    out["heading"] = first_text(root, ("h1", "title"))  # headings first
    if "manual" in wanted:
        out["manual"] = manual(root, MANUAL)
    if "enhanced" in wanted or "enhanced_by" in wanted:
        out["enhanced"], out["enhanced_by"] = enhanced(root, ENHANCED)
    if "structured" in wanted:
        out["structured"] = clean_dom(html)
    if "content" in wanted:
        out["content"], out["reason"] = semantic(root)
        sure = out["content"] is not None and surely_scored(out["content"])
        out["body"] = None if sure else body_of(root).markup()  # after the search, as the last resort sees it
    return out


def _run(wanted: tuple[str, ...]):
    need = frozenset(wanted)

    def run(batches):
        for b in batches:
            html, url = b.column("html").to_pylist(), b.column("url").to_pylist()
            ids, at = b.column("page_id").to_pylist(), 0
            while at < len(html):
                rows, held, start = [], 0, at
                while at < len(html) and (not rows or held < SLICE_BYTES):
                    rows.append(extract(html[at], url[at], need))
                    held += len(html[at] or "")
                    at += 1
                cols = [pa.array(ids[start:at], pa.int64()), pa.array(url[start:at], pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([r[n] for r in rows], FIELDS[n]) for n in wanted], names=["page_id", "url", *wanted])

    return run


def extract_fields(pages: DataFrame, *wanted: str) -> DataFrame:
    """page_id, url and the wanted FIELDS of each page. Null markup is an empty page."""
    ddl = ", ".join(f"{n} {DDL.get(n, 'string')}" for n in wanted)
    return arrow_map(pages.select("page_id", "url", "html"), _run(wanted), f"page_id long, url string, {ddl}")


def _selector_lengths(selectors: tuple[str, ...]):
    def run(batches):
        for b in batches:
            rows = []
            for i, h in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist()):
                root = parse(h)
                for s in selectors:
                    n = root.find(s)
                    rows.append((i, s, 0 if n is None else len(n.trimmed())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["page_id", "selector", "chars"])

    return run


def selector_lengths(pages: DataFrame, selectors: tuple[str, ...] = SELECTORS) -> DataFrame:
    """page_id, selector, chars: how much text each selector finds (0: nothing)."""
    return arrow_map(pages.select("page_id", "html"), _selector_lengths(tuple(selectors)), "page_id long, selector string, chars long")


def mapped(df: DataFrame, column: str, fn, schema: str) -> DataFrame:
    """df with one text column passed through a Python function of a text, batch by batch."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(column)
            col = pa.array([None if t is None else fn(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([col if k == at else b.column(k) for k in range(b.num_columns)], names=b.schema.names)

    return arrow_map(df, run, schema)


def _nfc(text: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", text)


def composed(df: DataFrame, column: str) -> DataFrame:
    """df with a text column in canonical composition, for which Spark has no function."""
    return mapped(df, column, _nfc, df.schema)


def dom_cleaned(df: DataFrame, column: str, client: bool = False) -> DataFrame:
    """df with a text column cleaned as markup."""
    return mapped(df, column, lambda t: clean_dom(t, client), df.schema)


def nfc(docs: DataFrame) -> DataFrame:
    """doc_id, cleaned."""
    return composed(docs.select("doc_id", docs["text"].alias("cleaned")), "cleaned")
