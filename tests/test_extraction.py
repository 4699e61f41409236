"""Extraction and cleaning of pages: hand-made pages with results worked out by hand, and plain Python."""

import duckdb
import plain
import pytest

from loomwright.functions import cleaning as C
from loomwright.functions import html as H
from loomwright.functions import scoring as S
from loomwright.functions.dialect import DUCK, SPARK
from loomwright.operators.catalog import CATALOG
from loomwright.plans import extraction as X
from loomwright.session import table

LONG = "These are the words of a page. " * 8


def both(spark, make, text):
    spark.createDataFrame([(text,)], "text string").createOrReplaceTempView("fixture")
    got = spark.sql(f"SELECT {make(SPARK, 'text')} AS v FROM fixture").first()["v"]
    con = duckdb.connect()
    con.execute("CREATE TABLE fixture (text VARCHAR)")
    con.execute("INSERT INTO fixture VALUES (?)", [text])
    assert got == con.sql(f"SELECT {make(DUCK, 'text')} AS v FROM fixture").fetchall()[0][0]
    return got


def tree(html):
    return H.body_of(H.parse(html))


def test_structured_text():
    page = "<h1>Head</h1><p>one  <b>two</b></p><ul><li>a<li>b</ul><blockquote>q\nr</blockquote><pre> x = 1\n y </pre><p>use <code> f() </code> now<br>next<hr><dl><dt>k<dd>v</dl><p> </p><div>end</div>"
    want = "# Head\n\none two\n\n- a\n- b > q\n> r\n\n```\nx = 1\n y\n```\n\nuse `f()` now \nnext\n\n\n---\n\n**k**\n: v end "
    assert H.structured(tree(page)) == want
    assert H.client_structured(tree(page)) == "# Head\none  two\n- a\n- b\n> q\n> r\n```\nx = 1\n y\n```\n\nuse  f()  nownext\n**k\n: v\nend"


def test_clean_dom():
    assert H.clean_dom("<p>a <script>x</script><svg><text>no</text></svg></p><div><h2>flat</h2> text</div><h2>kept</h2>") == "a\n\nflat text ## kept "
    assert H.clean_dom("") == "" and H.clean_dom("plain  text") == "plain  text "


def test_selectors_on_the_changed_tree():
    page = f"<main>short <nav>{LONG}</nav></main><article class='x'><nav>go</nav><div id='top-ad-1'>ad</div>{LONG}</article>"
    text, reason = H.semantic(H.parse(page))
    assert reason == "found_content_in_article" and text == LONG.strip()  # main falls short without its nav
    assert H.semantic(H.parse(f"<div class='content'>{LONG}</div>"))[1] == "found_content_in_.content"
    assert H.semantic(H.parse(f"<div id='main'>{LONG}</div>"))[1] == "found_content_in_#main"
    assert H.semantic(H.parse("<p>few words</p>")) == (None, "no_suitable_content_found")
    gone = H.semantic(H.parse(f"<body>{LONG}<div class='menu'>m</div><div class='my-ad-box'>a</div><aside>b</aside></body>"))[0]
    assert gone == LONG.strip()


def test_deep_and_broken_markup():
    deep = "<div>" * 50_000 + LONG + "</div>" * 50_000
    got = H.extract(deep, None, frozenset(H.FIELDS))
    assert got["content"] == LONG.strip() and got["structured"].strip() and H.clean_dom(deep, True).strip()
    assert H.extract(None, None, frozenset(H.FIELDS))["content"] is None
    assert H.parse("</p></div><b>x").find("b").text() == "x" and H.parse("<p>a<p>b").find("p").text() == "a"


@pytest.mark.parametrize("href,want", [("/x", "https://h.example/x"), ("y?q=1#z", "https://h.example/d/y?q=1#z"), ("//o.example", "https://o.example/"), ("HTTP://A.example:80/b", "http://a.example/b"),
                                       ("mailto:x@y", "mailto:x@y"), ("http://", None), ("http://[bad", None), ("", "https://h.example/d/e"), ("../..", "https://h.example/")])
def test_resolve(href, want):
    assert H.resolve(href, "https://h.example/d/e") == want


def test_metadata_and_titles():
    root = H.parse('<head><title>T</title><meta name="Description" content="D"><meta property="og:image" content="I"><link rel="shortcut icon" href="/f.ico"></head><h1> H </h1>')
    assert H.metadata(root, "https://www.h.example/x") == {"description": "D", "domain": "h.example", "favicon": "https://www.h.example/f.ico", "image": "I"}
    assert H.first_text(root, ("h1", "title")) == "H" and root.find("title", "h1").tag == "title"
    assert H.manual(H.parse("<article>a &amp;lt; <b>x</b> 1 &gt; 0 &lt; 2</article>"), H.MANUAL) == "a x 1 > 0 < 2"
    assert H.enhanced(H.parse(f"<main>few</main><article>{LONG * 2}</article>"), H.ENHANCED)[1] == "article"


@pytest.mark.parametrize("make,text,want", [
    (lambda d, x: C.code_cap(d, x, 12), "a ```0123456789``` b ```ok``` c ```open", "a ```012345678... b ```ok``` c ```open"), (lambda d, x: C.code_cap(d, x, 5), "``````", "`````..."),
    (C.isolate_code, "t\n    x\n    y\nz", "t\n\n    x\n    y\n\nz"), (C.isolate_code, "a ```x``` b", "a \n\n```x```\n\n b"), (C.isolate_code, "use `a  \t b` here", "use `a b` here"),
    (C.isolate_code, "t\n\n    x\n\nz", "t\n\n    x\n\nz"), (C.spacing, "# T  \ntext\n```x```", "# T\n\ntext\n\n```x```"), (C.slug, "a/b.c", "a-b-c"), (C.enhancer_title, "  a \n b ", "a b"),
    (C.enhanced, "<p>one</p><script>x</script> &copy 1; two", "one   two".replace("   ", " ")), (C.manual_text, "<b>x</b> &amp; y", "x y"), (C.manual_text, "a  b < c", "a b < c"),
    (C.tidy_lines, "x\t \n y", "x\ny"), (C.enhancer_url_title, "https://www.h.example/a/get-started_now2.html", "Get Started Now2"), (C.enhancer_url_title, "https://www.h.example/", "h.example"),
    (C.breadcrumb_path, "https://h.example/docs/Get-started.md?x", "h.example > Docs > Get started"), (C.breadcrumb_path, "https://h.example", "h.example"),
    (lambda d, x: C.tidy_url(d, x, ("utm_source",)), "h.example?b=1&utm_source=x&a=2&b=3#f", "https://h.example/?b=3&a=2#f"), (lambda d, x: C.tidy_url(d, x, ("utm_source",)), "http://x/", None),
    (lambda d, x: C.document_title(d, x, ("My Docs",)), "Intro - My Docs", "Intro"), (lambda d, x: d.fixed(f"length({x}) / 8e0", 2), "abcde", "0.63"), (lambda d, x: d.thousands(f"length({x}) * 1234567"), "a", "1,234,567"),
])
def test_scalars(spark, make, text, want):
    assert both(spark, make, text) == want


@pytest.mark.parametrize("url,want", [("https://www.h.example/docs/get-started.md", "Get started - Docs"), ("https://www.h.example/docs/index.html", "Docs - H"), ("https://h.example/", "H.example - H"),
                                      ("https://docs.example/docs", "Docs"), ("https://h.example/readme/x", "X - H")])
def test_client_titles(spark, url, want):
    spark.createDataFrame([(url,)], "url string").createOrReplaceTempView("fixture")
    con = duckdb.connect()
    con.execute("CREATE TABLE fixture AS SELECT ? AS url", [url])
    make = lambda d: f"SELECT title FROM ({C.client_url_title(d, 'SELECT url FROM fixture', 'url', 'title')}) t"
    assert spark.sql(make(SPARK)).first()[0] == con.sql(make(DUCK)).fetchall()[0][0] == want


def test_scores_against_plain_python(spark, sf_dir):
    """Every document's scores, and odd texts', equal those of plain Python."""
    odd = ["", "short", "# Head\n\nSome text here. Another one!\n\n- item\n\n```js\nfunction f() {}\n```\n" * 4, "see more " * 30 + "…", "a.b!c? " * 20, "<h1>x</h1><h2>y</h2><pre>let a = 1</pre><a href='x'>y</a>" + "word " * 60,
           "x\n\n\n\n\ny " * 30, "```open " * 30, "    code\n" * 20, "One sentence is here. " * 9, " lead " + "w " * 120 + "Sale!! sign up?? file.js"]
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()] + list(enumerate(odd, 10**6))
    text = dict(rows)
    spark.createDataFrame(rows, "doc_id long, text string").createOrReplaceTempView("documents")
    for r in spark.sql(CATALOG["q1_overall"](SPARK)).collect():
        assert r["score"] == pytest.approx(plain.q1(text[r["doc_id"]])), text[r["doc_id"]][:200]
    got = {k: {r["doc_id"]: r["score"] for r in spark.sql(CATALOG[f"q2_{k}"](SPARK)).collect()} for k in ("length", "readability", "technical", "noise")}
    total = {r["doc_id"]: r["total"] for r in spark.sql(CATALOG["q2_overall"](SPARK)).collect()}
    for i, t in rows:
        want = plain.q2(t)
        for k, by in got.items():
            assert by[i] == pytest.approx(want[k]), (k, t[:200])
        assert total[i] == pytest.approx(sum(w * want[k] for k, w in S.CLASS_WEIGHTS.items()))


def test_server_chain_in_steps(spark, sf_dir):
    """The guarded steps equal the chain of all rules, and plain Python."""
    odd = ["Made with love in cyberspace", "PlVolumeay", "x Loading... Loading... y", "**a** _b_ [l](u) &amp;lt; ¶", "cafÃ© au lait", "a\n\n\n\n\nb c", "Learn More About it\nnext", "\n Cookie Policy \n", "STOP it"]
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()] + list(enumerate(odd, 10**6))
    spark.createDataFrame(rows, "doc_id long, text string").createOrReplaceTempView("documents")
    steps = {r["doc_id"]: r["cleaned"] for r in spark.sql(CATALOG["clean_server_chain"](SPARK)).collect()}
    chain = {r["doc_id"]: r["cleaned"] for r in spark.sql(f"SELECT doc_id, {C.server_chain(SPARK, 'text')} AS cleaned FROM documents").collect()}
    assert steps == chain == {i: plain.last_steps(plain.first_steps(t)) for i, t in rows}


def test_pages_against_plain_python(spark, sf_dir):
    """extract_pages and curate_pages against plain Python over every page."""
    pages = table(spark, sf_dir, "pages")
    extra = [(10**6, "https://x.example/a", f"<body>{LONG[:80]}</body>"), (10**6 + 1, "https://x.example/index", "<title>Index</title><main>" + "```x " * 40 + "</main>"), (10**6 + 2, "https://x.example/f.txt", "plain &amp; **text**"),
             (10**6 + 3, "https://x.example/e", None), (10**6 + 4, "https://x.example/n", "<main>" + "para\n\n\n\n\n" * 30 + "</main>")]
    every = pages.select("page_id", "url", "html").union(spark.createDataFrame(extra, "page_id long, url string, html string"))
    want, chosen = {}, {}
    for r in every.collect():
        root = H.parse(r["html"])
        text, reason = H.semantic(root)
        method = "semantic_dom"
        if text is None or plain.q1(text) <= X.GATE:
            text = both_strip(H.body_of(root).markup())
            method, score = "fallback", plain.q1(text)
            reason = "min_length_not_met" if len(text) <= 50 else "stripHTML_success" if score > X.LAST_GATE else "low_quality"
            text = None if reason == "low_quality" else text
        want[r["page_id"]] = (text, method, reason)
        if r["url"].endswith(".txt"):
            cleaned = plain.last_steps(H.clean_dom(plain.first_steps(r["html"] or "")))
            chosen[r["page_id"]] = (cleaned, 1.0)
        else:
            cleaned = plain.last_steps(H.clean_dom(plain.first_steps(text or "")))
            chosen[r["page_id"]] = (cleaned, plain.q1(cleaned, 30))
    got = {r["page_id"]: (r["content"], r["method"], r["reason"]) for r in X.extract_pages(every).collect()}
    assert got == want
    assert {m for _, m, _ in want.values()} == {"semantic_dom", "fallback"}
    for r in X.clean_documents(every).collect():
        text, score = chosen[r["page_id"]]
        assert r["score"] == pytest.approx(score) and (r["content"] == text if score >= 0.2 else r["content"] is None and r["error"].startswith("Content quality too low"))
        assert r["words"] == len(plain.words(text))
    own = lambda p: p.selectExpr("page_id", "repeat('own words ', 9) AS content").where("page_id % 2 = 0")  # noqa: E731  a slot, not a query
    first = {r["page_id"]: r["method"] for r in X.extract_pages(every, own).collect()}
    assert all((m == "extractor") == (i % 2 == 0) for i, m in first.items())


def both_strip(markup):
    import re

    for t in C.DROPPED_TAGS:
        markup = re.sub(rf"<{t}\b(?:.|\n)*?</{t}>", "", markup, flags=re.I)
    for p in ("Sorry, your browser doesn't support embedded video", "Scroll For More", "Learn More About", "Made with.*cyberspace"):
        markup = re.sub(p, "", markup, flags=re.I)
    markup = re.sub(r"&[a-zA-Z0-9#]+;", " ", re.sub(r"<[^>]*>", "", markup))
    return re.sub(f"{plain.BLANK}+", " ", markup).strip(plain.SPACES)


def test_other_profiles(spark):
    rows = [(1, "https://www.a.example/x", f"<h1>Head</h1><main>{LONG}</main>"), (2, "https://www.a.example/y", "<main>404 not found</main>"), (3, "https://blog.b.example/z", f"<article>{LONG[:200]}</article>"),
            (4, "https://c.example/index.html", "<p>few</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    crawl = {r["page_id"]: (r["title"], r["words"], r["rejected"]) for r in X.crawl_rows(pages).collect()}
    assert crawl == {1: ("Head", 56, None), 2: ("Y", 3, "404"), 3: ("Z", len(LONG[:200].split()), "too few words"), 4: ("Index", 0, "too few words")}
    client = {r["page_id"]: (r["method"], r["reason"]) for r in X.client_documents(pages).collect()}
    assert client[1] == ("semantic_dom", "found_content_in_main") and client[3][1] == "found_content_in_article" and set(client) <= {1, 2, 3, 4}
    enhanced = {r["page_id"]: (r["title"], r["valid"]) for r in X.enhancer_rows(pages).collect()}
    assert enhanced == {1: ("Head", True), 2: ("Y", False), 3: ("Z", False), 4: ("Index", False)}
    lengths = {(r["page_id"], r["selector"]): r["chars"] for r in H.selector_lengths(pages).collect()}
    assert lengths[1, "main"] == len(LONG.strip()) and lengths[1, "article"] == 0 and lengths[4, "body"] == 3
