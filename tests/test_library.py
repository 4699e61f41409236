"""Cleaning, scoring, titles, graph and files on literal fixtures; the catalog against DuckDB."""

import json
import os

import duckdb
import plain
import pytest

from pyspark.sql import functions as F

from loomwright.functions import cleaning as C
from loomwright.functions import html
from loomwright.functions import scoring as S
from loomwright.functions.dialect import DUCK, SPARK
from loomwright import cli
from loomwright.operators import batch, reports
from loomwright.operators.graph import crawl_order, crawl_sites
from loomwright.operators.ranking import by_score
from loomwright.sources import files, web
from loomwright.streaming import curate


def both(spark, make, text, source=lambda d: "fixture"):
    """The expression's value in both engines, which must agree."""
    spark.createDataFrame([(text,)], "text string").createOrReplaceTempView("fixture")
    got = spark.sql(f"SELECT {make(SPARK, 'text')} AS v FROM {source(SPARK)}").first()["v"]
    con = duckdb.connect()
    con.execute("CREATE TABLE fixture (text VARCHAR)")
    con.execute("INSERT INTO fixture VALUES (?)", [text])
    want = con.sql(f"SELECT {make(DUCK, 'text')} AS v FROM {source(DUCK)}").fetchall()[0][0]
    assert got == pytest.approx(want) if isinstance(got, float) else got == want
    return got


@pytest.mark.parametrize("make,text,want", [
    (C.entities, "&amp;lt;b&amp;gt; &bogus; &hellip;", "<b>   ..."), (C.markdown, "![alt](u) **b** [x](y) a_b_c", "!alt b x a_b_c"), (C.video, "display nonstop", "dis non"),
    (C.comments, "see https://x y\nnext", "see https:\nnext"), (C.special, "a¶b c​d", "ab cd"), (C.whitespace, "a  b\t\n\n\n\n\n c ", "a b\n\nc"),
    (C.boilerplate, "x Loading... Loading... y", "x   y"), (C.strip_html, "<nav>n</nav><p>a&nbsp;b</p><script>1<2</script>", "a b"), (C.navigation, "ok\n© Co 2024 x\nskip to content", "ok"),
    (C.navigation, "all on one line © 2024", ""), (C.headings, "##Title ##\ntext", "\n## Title\n\ntext"), (C.clean_title, "Café: <x> (1)", "Caf x (1)"), (C.document_title, "Intro - Cookbook", "Intro"),
    (C.url_title, "https://h.example/a/get-started_now.html?q#f", "Get Started Now"), (C.url_title, "https://h.example/", "Home"), (C.display_title, "# Guide `x` | Docs", "Guide x"),
    (C.mojibake, "cafÃ© au lait", "café au lait"), (C.tidy_lines, "  a \r\n\r\n\r\n\r\n b", "a\n\nb"),
])
def test_cleaning(spark, make, text, want):
    got = both(spark, make, text)
    assert got == want if make is not C.entities else got.split() == ["<b>", "..."]


@pytest.mark.parametrize("n,want", [(19, 0), (20, 0.6), (49, 0.6), (50, 0.8), (99, 0.8), (100, 1), (2000, 1), (2001, 0.8), (5000, 0.8), (5001, 0.6), (10000, 0.6), (10001, 0.3), (50000, 0.3), (50001, 0.5)])
def test_length_bands(spark, n, want):
    assert both(spark, S.class_length, "w " * n, basis) == pytest.approx(want)


def test_scores_in_range(spark):
    texts = ["", "short", "# Head\n\nSome text here. Another one!\n\n- item\n\n```js\nfunction f() {}\n```\n" * 4, "word " * 300, "...", "see more " * 30 + "…"]
    for t in texts:
        for make in (S.readability, S.completeness, S.technical, S.structure, S.overall, S.client_overall, S.class_structure, S.class_readability, S.class_technical, S.class_noise):
            assert 0 <= (both(spark, make, t, basis) or 0) <= 1
    assert both(spark, S.structure, "plain prose") == pytest.approx(0.35)
    assert both(spark, S.overall, None, basis) == 0


def test_counts_of_whole_words(spark):
    text = "Function functions myfunction class_x class.method API (api) apis f( _g2( 9h("
    for i, n in ((0, 3), (1, 2), (6, 2)):
        pattern, flags = S.TECHNICAL[i]
        assert both(spark, lambda d, x: d.count(x, pattern, flags), text) == n


@pytest.mark.parametrize("n,want", [(17, True), (20, True), (196, True), (300, False)])
def test_soft_404(spark, n, want):
    assert both(spark, lambda d, x: S.soft_404(d, "'t'", x, "n"), "404 not found " + "w " * n, basis) is want


def test_html():
    page = "<title>T</title><main>tiny</main><article><h1>Head</h1><p>one<p>two <code>c</code><br>three<pre>x = 1</pre><ul><li>a<li>b</ul><nav>no</nav>" + "<p>" + "long text " * 10 + "</article><a href='/x#y'>l</a>"
    got = html.extract(page, "https://h.example/d/", frozenset(html.FIELDS))
    assert got["reason"] == "found_content_in_article" and got["links"] == ["https://h.example/x#y"] and got["content"].startswith("Headonetwo c") and "no" not in got["content"].split()
    assert "# Head" in got["structured"] and "- a" in got["structured"] and "```\nx = 1\n```" in got["structured"]
    assert html.extract("", None, frozenset(html.FIELDS))["reason"] == "no_suitable_content_found"


def test_site_crawls(spark):
    """Against a plain queue: depth and page limits by site, rejected pages kept out and not followed."""
    import random

    r = random.Random(2)
    nodes = [(s, f"{s}{k}") for s in "ab" for k in range(40)]
    links = sorted({(s, u, f"{s}{r.randrange(40)}") for s, u in nodes for _ in range(3)})
    limits, rejected, known = {"a": (3, 12), "b": (2, 100)}, {"a1", "b3", "b4"}, {"a5"}
    want = set()
    for s, (depth, pages) in limits.items():
        queue, seen, kept = [(0, f"{s}0"), (0, f"{s}1")], {f"{s}0", f"{s}1"}, 0
        while queue:
            after = []
            for d, u in sorted(queue):
                if kept >= pages or d > depth or u in known or u in rejected:
                    continue
                kept += 1
                want.add((s, u, d))
                if kept < pages and d < depth:
                    after += [(d + 1, v) for _, x, v in links if x == u and v not in seen and not seen.add(v)]
            queue = after
    frame = spark.createDataFrame
    got = crawl_sites(frame(links, "site string, src string, dst string"), frame([(s, f"{s}{k}", 0) for s in "ab" for k in (0, 1)], "site string, url string, depth int"),
                      frame([(s, d, p) for s, (d, p) in limits.items()], "site string, max_depth int, max_pages int"), frame([(u,) for u in rejected], "url string"), frame([(u,) for u in known], "url string"))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 20


def test_ranks_in_cells(spark):
    import random

    r = random.Random(4)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}" if i % 2 else None, r.choice([0.0, 0.25, 0.25, r.random(), 1.0])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, score double")
    for up in (False, True):
        order = sorted(rows, key=lambda x: (x[2] if up else -x[2], x[0]))
        want = {i: 1 + [x[0] for x in order if x[1] == g].index(i) for i, g, _ in rows}
        assert {x["id"]: x["position"] for x in by_score(df, "g", "id", up).collect()} == want


def test_batches(spark):
    """Retries, errors that are final, the gate, a time limit, and the summary."""
    import time

    assert batch.waits() == [1000, 2000, 4000] and batch.waits(6)[-1] == 10_000
    tries, slept = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("HTTP 500")
        return "x"

    assert batch.with_retry(flaky, [5, 7], sleep=slept.append) == ("x", 3) and slept == [0.005, 0.007]
    for message, n in (("HTTP 404: gone", 1), ("HTTP 500", 3)):
        count = []
        with pytest.raises(RuntimeError) as e:
            batch.with_retry(lambda m=message, c=count: c.append(1) or (_ for _ in ()).throw(RuntimeError(m)), [0, 0], sleep=lambda s: None)
        assert len(count) == n == e.value.attempts

    def work(row):
        if row["id"] == 0:
            raise RuntimeError("HTTP 403")
        if row["id"] == 1:
            time.sleep(3)
        return {"title": "t", "content": "c", "score": row["id"] / 10}

    out = batch.extract_batch(spark.range(2, 10).union(spark.range(0, 2)).coalesce(2), work, gate=0.5, concurrency=3, timeout=0.5, retries=0)
    got = {r["id"]: (r["status"], r["content"], r["error"]) for r in out.collect()}
    assert got[0] == ("failed", None, "HTTP 403") and got[1] == ("failed", None, "timeout") and got[2] == ("filtered", None, "Content quality too low: 0.20 < 0.5") and got[9] == ("ok", "c", None)
    s = batch.summary(out).first()
    assert (s["total"], s["successful"], s["failed"], round(s["mean_quality"], 6)) == (10, 5, 2, 0.7)
    assert batch.summary(out.limit(0)).first()["mean_quality"] == 0
    assert batch.adapted([100, 3000, 3000, 1500, 10]) == [3, 4, 3, 2, 2]
    now, waited = [0.0], []
    bucket = batch.TokenBucket(2, 2, clock=lambda: now[0], sleep=lambda s: (waited.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(4):
        bucket.take()
    assert waited == [0.5, 0.5]


def test_page_source(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Site(BaseHTTPRequestHandler):
        hits: dict = {}

        def do_GET(self):
            n = self.hits[self.path] = self.hits.get(self.path, 0) + 1
            status = 404 if self.path == "/gone" else 500 if self.path == "/flaky" and n < 2 else 200
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if self.path == "/t" else "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write("café".encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "urls").write_text(f"{base}/a\n\n{base}/gone\n{base}/flaky\n{base}/t\n{base}/x.txt\n")
    spark.dataSource.register(web.PageSource)
    rows = spark.read.format("loomwright_pages").options(urls=str(tmp_path / "urls"), delay=1, rate=1000, partitions=2).load().collect()
    server.shutdown()
    got = {r["url"][len(base):]: (r["status"], r["body"], r["is_plain_text"], r["error"]) for r in rows}
    assert got == {"/a": (200, "café", False, None), "/gone": (None, None, False, "HTTP 404: Not Found"), "/flaky": (200, "café", False, None), "/t": (200, "café", True, None), "/x.txt": (200, "café", True, None)}
    assert Site.hits["/gone"] == 1 and Site.hits["/flaky"] == 2


def test_reports_by_hand(spark, tmp_path):
    """A site's report, its collection and the batch's report from three pages, word by word."""
    good = "Some plain words stand here for a reader. They say little, but they end well. " * 6
    rows = [(1, "https://a.example/docs/start.html", f"<title>Home</title><p>{good}</p>"), (2, "https://a.example/lost", "<title>404</title><p>gone</p>"), (3, "https://a.example/thin", "<title>Thin</title><p>x</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").createOrReplaceTempView("pages")
    outcomes = spark.sql(reports.judged(SPARK))
    outcomes.createOrReplaceTempView("page_outcomes")
    status = {r["page_id"]: r["status"] for r in outcomes.collect()}
    assert status == {1: "ok", 2: "failed", 3: "filtered"}
    score = plain.q1("Home" + good.strip(), 30)
    text = spark.sql(reports.site_report(SPARK)).first()["report"]
    assert text == (
        "📊 a.example - Content Extraction Report\n" + "=" * 50 + "\n\nSite: a.example\nBase URL: https://a.example\nGenerated: 1970-01-01T00:00:00.000Z\n\n📈 EXTRACTION STATISTICS\n" + "-" * 30
        + f"\nTotal pages: 3\nSuccessful: 1\nFailed: 1\nQuality filtered: 1\nTotal words: 90\nAverage words per page: 90\n\nAverage quality score: {score:.3f}\n\n🔧 EXTRACTION METHODS\n" + "-" * 25
        + "\nfallback: 1 (100.0%)\n\n❌ ERRORS\n" + "-" * 15 + "\n- https://a.example/lost: HTTP 404: Not Found\n\n"
    )
    whole = spark.sql(reports.parsing_report()(SPARK)).first()["report"]
    for line in ("Total URLs processed: 3", "Successful extractions: 1 (33.3%)", "Failed extractions: 1 (33.3%)", "404 Not Found: 1", "technical content: 0 (0.0%)", "Content density: 30.0 words/URL", "Success rate: 33.3%"):
        assert f"\n{line}\n" in whole, line
    sections = sorted(tuple(r) for r in spark.sql(reports.collection()(SPARK)).collect())
    assert "".join(s for *_, s in sections) == (
        "# Documentation Collection\n\nGenerated on: 1970-01-01T00:00:00.000Z\nTotal documents: 1\nTotal words: 90\n\n## Table of Contents\n\n### Included Documents\n\n1. [Start](https://a.example/docs/start.html)\n"
        "\n### Excluded Documents (Quality Filtered)\n\n1. https://a.example/thin\n\n---\n\n# 1. Home\n\nDocument Number: 1\nSource: https://a.example/docs/start.html\nWords: 90\n"
        f"Quality Score: {score:.3f}\nExtraction Method: fallback\nExtraction Reason: stripHTML_success\n\nHome{good.strip()}\n"
    )
    assert files.write_compressed(spark.range(2000).selectExpr("'the same line' AS value"), str(tmp_path / "z")) and not files.write_compressed(spark.sql("SELECT 'x' AS value"), str(tmp_path / "s"))


def test_command_line(spark, sf_dir, tmp_path):
    out = str(tmp_path / "made")
    cli.generate(spark, sf_dir, out)
    hosts = {r["site"] for r in files.read_sections(spark, out + "/llms").select("site").distinct().collect()}
    assert len(hosts) > 20 and spark.read.text(out + "/reports").where("value like '%Content Extraction Report'").count() == len(hosts)
    before = os.path.getmtime(out + "/llms")
    cli.generate(spark, sf_dir, out)
    assert os.path.getmtime(out + "/llms") == before


def test_entry_guard(tmp_path):
    """Without the optional subpackage the entry imports; any other missing module is an error."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    run = lambda code: subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True)
    assert run("import __spark_entry__ as e; q = e.queries(); assert 'op2_byte_bpe' not in q and 'pipeline' not in q and len(q) > 100").returncode == 0
    (tmp_path / "r" / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    assert "no_such_module_at_all" in run("import __spark_entry__").stderr


def test_cyclic_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a", 0)], "url string, depth int")
    assert {(r["url"], r["depth"]) for r in crawl_order(edges, seeds, 3).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    known = spark.createDataFrame([("b",)], "url string")
    assert [r["url"] for r in crawl_order(edges, seeds, 3, known=known).collect()] == ["a"]


def test_files(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"generated": "x", "sites": {"s": {"name": "S", "pages": [{"url": "u", "title": "t", "depth": 1}]}}}))
    assert files.read_index(spark, str(tmp_path / "index.json")).select("site_key", "name", "url", "depth").collect() == [("s", "S", "u", 1)]
    (tmp_path / "config.json").write_text(json.dumps({"b": {"name": "B", "excludePatterns": ["/ja/", "/x/i"]}, "a": {"name": "A"}}))
    rows = files.read_config(spark, str(tmp_path / "config.json")).orderBy("ordinal").collect()
    assert [r["site_key"] for r in rows] == ["b", "a"] and rows[0]["excludePatterns"] == ["ja", "(?i)x"]
    docs = spark.createDataFrame([("s1", "text\nmore")], "source string, content string")
    files.write_collections(docs, str(tmp_path / "out"))
    assert os.path.isdir(tmp_path / "out" / "source=s1")


def test_streams_read_folders_and_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    want = {r["event_type"]: r["n"] for r in events.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    for d in (sf_dir, str(tmp_path)):
        assert curate.new_events(spark, d).count() == events.select("event_id").distinct().count()
        assert {r["event_type"]: r["n"] for r in curate.running_totals(spark, d).collect()} == want


def basis(d):
    return f"({S.basis(d, 'SELECT * FROM fixture', 'text')}) b"


def value(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["quality_by_lang", "q2_overall", "content_filters", "url_title", "run_totals", "document_set", "parsed_set", "link_edges", "link_bfs", "stream_new_events", "stream_totals", "stream_pages", "clean_nfc", "rank_by_quality", "excluded_rank", "page_order", "collections_sink", "index_file", "config_file", "site_report_text", "parsing_report", "collection_sections", "admissible_url", "tidy_url"])
def test_against_duckdb(spark, sf_dir, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    got = entry.queries()[name](spark, sf_dir)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(value(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(value(r[k]) for k in at) for r in want.fetchall())
