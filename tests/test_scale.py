"""Odd and larger inputs: the same rows as DuckDB's, in a time that grows with the text."""

import json
import random
import time

import duckdb
import pyarrow as pa
import pytest

from loomwright.functions import cleaning as C
from loomwright.functions import scoring as S
from loomwright.functions.dialect import DUCK, SPARK
from loomwright.operators import reports
from loomwright.functions import html
from loomwright.session import spread, table
from loomwright.sources import files


def rows_of_both(spark, make, texts, column="text", source=lambda d: "fixture"):
    """Every text's value in Spark; DuckDB must have the same."""
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, f"id long, {column} string").createOrReplaceTempView("fixture")
    got = {r["id"]: r["v"] for r in spark.sql(f"SELECT id, {make(SPARK, column)} AS v FROM {source(SPARK)}").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE TABLE fixture (id BIGINT, {column} VARCHAR)")
    con.executemany("INSERT INTO fixture VALUES (?, ?)", rows)
    want = dict(con.sql(f"SELECT id, {make(DUCK, column)} AS v FROM {source(DUCK)}").fetchall())
    assert [(t, got[i], want[i]) for i, t in rows if got[i] != want[i]] == []
    return got


PIECES = (" ", "  ", "\n", "\t", " ", "\r\n", "x", "é", ".", "Play", "STOP", "display", "[Video]", "Video not supported.", "Loading...", "Please wait...", "Sorry, ", "your browser doesn't support embedded video",
          "browser doesnt support embedded video.", "Made with", "cyberspace", "Scroll For More", "Learn More About ", "cookie policy", "&amp;", "&nbsp;", "&hellip;", "&zz;", "¶", "​", "**", "_", "***", "~~", "[a](b)", "![a](b)", "`", "<b>", "cafÃ©")


@pytest.mark.parametrize("make", [C.mojibake, C.boilerplate, C.video, C.entities, C.markdown, C.special, C.whitespace, C.text_file, C.client_chain])
def test_guarded_rules_on_odd_texts(spark, make):
    draw = random.Random(5)
    rows_of_both(spark, make, ["", None, *("".join(draw.choices(PIECES, k=draw.randint(1, 14))) for _ in range(250))])


@pytest.mark.parametrize("make", [C.boilerplate, C.video, C.text_file, C.client_chain])
def test_guarded_rules_take_long_runs_of_blanks(spark, make):
    began = time.monotonic()
    rows_of_both(spark, make, ["Play" + " " * 40_000 + "x Loading... y"])
    assert time.monotonic() - began < 20


OUTCOME = "page_id long, url string, site string, title string, content string, words long, score double, method string, reason string, status string, error string"


def test_pages_of_one_url_and_score_are_in_the_order_of_ids(spark):
    rows = [(i, "http://a.example/x", "a.example", f"T{i}", "text", 1, 0.5, "fallback", "r", "ok", None) for i in (9, 4, 7, 1)]
    spark.createDataFrame(rows, OUTCOME).coalesce(1).createOrReplaceTempView("page_outcomes")
    assert {r["page_id"]: r["position"] for r in spark.sql(reports.batch_sorted(SPARK)).collect()} == {1: 1, 4: 2, 7: 3, 9: 4}
    sections = spark.sql(reports.collection()(SPARK)).where("part = 3").orderBy("n").collect()
    assert [r["section"].split(". ")[1].split("\n")[0] for r in sections] == ["T1", "T4", "T7", "T9"]


def test_code_is_set_apart_in_texts_of_many_lines(spark):
    lines = ["t" if i % 2 else "    x" for i in range(20_000)]
    spark.createDataFrame([("\n".join(lines),)], "text string").createOrReplaceTempView("fixture")
    began = time.monotonic()
    assert spark.sql(f"SELECT {C.isolate_code(SPARK, 'text')} AS v FROM fixture").first()["v"] == "\n\n".join(lines)
    assert time.monotonic() - began < 20


@pytest.mark.parametrize("make", [C.isolate_code, lambda d, x: C.code_cap(d, x, 12), C.strip_tags])
def test_blocks_and_tags_of_odd_texts(spark, make):
    draw = random.Random(6)
    rows_of_both(spark, make, ["", None, *("".join(draw.choices((*PIECES, "```", "    y", "\n    z", "`a  b`", "\u2003", "\ufeff"), k=draw.randint(1, 14))) for _ in range(250))])


WORDS = (" ", "  ", "\n", "\n\n\n\n", "\t", "\u00a0", "\u2003", "\ufeff", ". ", "! ", "?? ", "...", "Σ", "ΑΣ", "É", "word", "Word", "api", "API(", "the docs", "{", "$x", "https://h.example/a", "# Head\n", "- item\n", "1. one\n",
         "\n  2. two", "    code", "```", "read  more", "click here", "home", "const", "x.js", "…", "<b>", "a long sentence of several words")
FIGURES = {"counts": "n + 10 * u + 100 * p + 1000 * s + 10000 * k + 100000 * r + 1000000 * ru + 10000000 * solid", "hits": " + ".join(f"{10**i} * h{i}" for i in range(9))}


@pytest.mark.parametrize("make", [*FIGURES.values(), S.readability, S.completeness, S.technical, S.structure, S.overall, S.class_readability, S.class_technical, S.class_noise])
def test_scores_of_odd_texts(spark, make):
    draw = random.Random(7)
    texts = ["", " ", None, *("".join(draw.choices(WORDS, k=draw.randint(1, 30))) for _ in range(250))]
    value = (lambda d, x: f"CAST({make} AS BIGINT)") if isinstance(make, str) else lambda d, x: f"round({make(d, x)}, 9)"
    rows_of_both(spark, value, texts, source=lambda d: f"({S.basis(d, 'SELECT * FROM fixture', 'text')}) b")


def test_completeness_takes_many_line_ends(spark):
    began = time.monotonic()
    rows_of_both(spark, S.completeness, ["a" + "\n" * 60_000 + "b-"])
    assert time.monotonic() - began < 20


def test_large_inputs_are_worked_on_in_small_tasks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cut = spread(docs, bytes_a_core=1, bytes_a_task=20_000)
    assert cut.rdd.getNumPartitions() >= 10
    assert max(cut.rdd.glom().map(len).collect()) < docs.count() / 3
    assert cut.exceptAll(docs).count() == docs.exceptAll(cut).count() == 0
    assert spread(docs, bytes_a_core=1, bytes_a_task=1 << 30).rdd.getNumPartitions() == docs.rdd.getNumPartitions()


def test_a_large_site_is_many_lines_of_the_index(spark, tmp_path):
    rows = spark.range(2000).selectExpr("'s' AS site_key", "'S' AS site_name", "concat('u', id) AS url", "'t' AS title", "'c' AS content", "1 AS estimated_words", "'x' AS last_modified", "'a|b' AS breadcrumbs", "2 AS depth")
    files.write_index(rows, str(tmp_path / "index"))
    lines = [json.loads(x) for p in (tmp_path / "index").glob("*.json") for x in p.read_text().splitlines()]
    assert max(len(x["sites"]["s"]["pages"]) for x in lines) <= 256
    got = files.read_index(spark, str(tmp_path / "index"), lines=True)
    assert sorted(r["url"] for r in got.collect()) == sorted(f"u{i}" for i in range(2000))


def test_python_passes_get_small_batches(spark, monkeypatch):
    def sizes(wanted):
        def run(batches):
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes] * n, pa.int64()), pa.array([""] * n), pa.array([""] * n)], names=["page_id", "url", "title"])
        return run

    monkeypatch.setattr(html, "_run", sizes)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pages = spark.range(0, 4000, 1, 1).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 10000) AS html")
    assert html.extract_fields(pages, "title").agg({"page_id": "max"}).first()[0] < 8_000_000
