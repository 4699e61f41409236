"""Queries that are programs rather than one expression: extraction, traversal, files, batches, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomwright.functions import cleaning as C
from loomwright.functions import html as H
from loomwright.functions.dialect import DUCK, SPARK
from loomwright.functions.scoring import level
from loomwright.operators import catalog, reports
from loomwright.operators.batch import extract_batch
from loomwright.operators.graph import crawl_order, crawl_sites
from loomwright.operators.ranking import by_score, ranked
from loomwright.plans import extraction as X
from loomwright.session import materialize, shared_dir, spread, table
from loomwright.sources import files
from loomwright.streaming.curate import new_events, new_pages, running_totals

DEPTH = 3


def _pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"))


def extracted(spark, sf_dir):
    return X.extract_pages(_pages(spark, sf_dir)).select("page_id", "title", "method", "reason", F.length("content").cast("long").alias("chars"), F.size("links").cast("long").alias("links"))


def curated(spark, sf_dir):
    """Pages to ranked documents: extraction, cleaning, score, gate, position within the host."""
    rows = X.clean_documents(_pages(spark, sf_dir)).where("error is null").withColumn("host", F.expr(C.url_host(SPARK, "url")))
    out = by_score(rows.select("page_id", "host", "title", "words", "score", F.expr(level("score")).alias("level")), "host", "page_id")
    return out.select("page_id", "host", "title", "words", "score", "level", F.col("position").cast("long").alias("position"))


def walk(spark, sf_dir):
    """The crawl of all sites from the feed's pages, three steps deep."""
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    edges = materialize(spark.sql(catalog.edges(SPARK)))
    seeds = spark.sql(f"SELECT url, 0 AS depth FROM pages WHERE {catalog.SEEDS}")
    return crawl_order(edges, seeds, DEPTH).select("url", F.col("depth").cast("long").alias("depth"))


WALK = f"""WITH RECURSIVE edges AS MATERIALIZED ({catalog.edges(DUCK)}), walk AS (
        SELECT url, CAST(0 AS BIGINT) AS depth FROM pages WHERE {catalog.SEEDS}
        UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth < {DEPTH})
    SELECT url, min(depth) AS depth FROM walk GROUP BY url"""


def site_walk(spark, sf_dir):
    """Every site's own crawl: its depth and page limits, no links of rejected pages followed."""
    pages = _pages(spark, sf_dir)
    pages.createOrReplaceTempView("pages")
    rows = materialize(X.crawl_rows(pages).select("url", "rejected"))
    limits = materialize(spark.sql(f"SELECT host AS site, max_depth, max_pages FROM ({catalog.sites(SPARK)}) c"))
    edges = materialize(spark.sql(f"SELECT host AS site, src, dst FROM (SELECT {C.url_host(SPARK, 'src')} AS host, src, dst FROM ({catalog.edges(SPARK)}) e) f"))
    seeds = spark.sql(f"SELECT {C.url_host(SPARK, 'url')} AS site, url, 0 AS depth FROM pages").join(limits.select("site"), "site", "left_semi")
    return crawl_sites(edges, seeds, limits, rows.where("rejected is not null").select("url")).select("site", "url", F.col("depth").cast("long").alias("depth"))


def _scored(spark, sf_dir):
    spread(table(spark, sf_dir, "documents")).createOrReplaceTempView("documents")
    return spark.sql(f"SELECT doc_id, source, score FROM ({catalog.scored(SPARK)}) s")


def rank_by_quality(spark, sf_dir):
    return by_score(_scored(spark, sf_dir).where("score >= 0.2"), "source", "doc_id")


def excluded_rank(spark, sf_dir):
    return by_score(_scored(spark, sf_dir).where("score < 0.4"), "source", "doc_id", True).select("doc_id", "source", "position")


def collections(spark, sf_dir):
    """All sites' collections through the text sink: written by site, read back and counted."""
    _pages(spark, sf_dir).createOrReplaceTempView("pages")
    outcomes = materialize(spark.sql(reports.judged(SPARK)))
    numbered = by_score(outcomes.where("status = 'ok'"), "site", "url", name="n")
    outcomes.createOrReplaceTempView("page_outcomes")
    numbered.createOrReplaceTempView("numbered_pages")
    sections = spark.sql(reports.collection(rows="SELECT * FROM numbered_pages")(SPARK))
    path = f"{shared_dir(spark)}/loomwright/collections-{uuid.uuid4().hex}"
    files.write_sections(sections, path)
    back = files.read_sections(spark, path)
    return back.groupBy("site").agg(F.count("*").alias("lines"), F.count_if(F.col("value").rlike(r"^# \d+\. ")).alias("documents"))


COLLECTIONS = f"""SELECT site, CAST(sum(len(string_split(section, chr(10))) - CASE WHEN ends_with(section, chr(10)) THEN 1 ELSE 0 END) AS BIGINT) AS lines,
    CAST(sum(len(list_filter(string_split(section, chr(10)), lambda x: regexp_matches(x, '^# [0-9]+[.] ')))) AS BIGINT) AS documents FROM ({reports.collection()(DUCK)}) s GROUP BY site"""


def index_file(spark, sf_dir):
    """The page index written as one JSON object and read back: its rows, each URL's first."""
    _pages(spark, sf_dir).createOrReplaceTempView("pages")
    rows = spark.sql(f"SELECT * FROM ({catalog.page_record(SPARK)}) r")
    path = f"{shared_dir(spark)}/loomwright/index-{uuid.uuid4().hex}"
    files.write_index(rows, path)
    return files.read_index(spark, path, lines=True).select("site_key", "url", "title", F.col("estimatedWords").cast("long").alias("words"), F.array_join("breadcrumbs", "|").alias("breadcrumbs"), F.col("depth").cast("long").alias("depth"))


def config_file(spark, sf_dir):
    """The site configuration written as JSON and read back, patterns decoded."""
    _pages(spark, sf_dir).createOrReplaceTempView("pages")
    path = f"{shared_dir(spark)}/loomwright/config-{uuid.uuid4().hex}"
    files.write_config(spark.sql(catalog.sites(SPARK)), path)
    rows = files.read_config(spark, path)
    return rows.select("site_key", "name", F.col("baseUrl").alias("base_url"), F.col("maxDepth").cast("long").alias("max_depth"), F.array_join("excludePatterns", " ").alias("patterns"))


def batch(spark, sf_dir):
    """The pages through the batch operator: title and text by a function of a row, with retries and a gate."""
    got = extract_batch(_pages(spark, sf_dir).select("page_id", "url", "html"), _first_heading, gate=0.4)
    return got.select("page_id", "status", "attempts", "title", "score")


def _first_heading(row: dict) -> dict:
    root = H.parse(row["html"])
    text = H.body_of(root).trimmed()
    return {"title": H.first_text(root, ("h1", "title")), "content": text, "score": min(1.0, H.words(text) / 500)}


def page_order(spark, sf_dir):
    """Pages in the order of the list: configured sites first, then by host; ranks inside a host and hosts before it."""
    _pages(spark, sf_dir).createOrReplaceTempView("pages")
    crumbs = SPARK.join(C.breadcrumbs(SPARK, "url"), " / ")
    sites = spark.sql(catalog.sites(SPARK)).select("host", "ordinal")
    rows = spark.sql(f"SELECT page_id, {C.url_host(SPARK, 'url')} AS host, {crumbs} AS crumbs FROM pages").join(F.broadcast(sites), "host", "left")  # one row a configured site
    hosts = materialize(rows.groupBy("host", "ordinal").agg(F.count("*").alias("n")))
    hosts.createOrReplaceTempView("page_hosts")
    before = spark.sql("SELECT host, coalesce(sum(n) OVER (ORDER BY CASE WHEN ordinal IS NULL THEN 1 ELSE 0 END, ordinal, host ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM page_hosts")
    out = ranked(rows.select("page_id", "host", "crumbs"), "host", F.lit(0), [F.col("crumbs"), F.col("page_id")])
    return out.join(before, "host").select("page_id", (F.col("position") + F.col("before")).cast("long").alias("position"))


def queries():
    return {
        "extract_pages": extracted, "curate_pages": curated, "link_bfs": walk, "crawl_sites": site_walk, "rank_by_quality": rank_by_quality, "excluded_rank": excluded_rank, "page_order": page_order,
        "clean_nfc": lambda spark, sf_dir: H.nfc(spread(table(spark, sf_dir, "documents"))),
        "client_pages": lambda spark, sf_dir: X.client_documents(_pages(spark, sf_dir)).select("page_id", "title", "words", "score", "method", "reason"),
        "crawl_pages": lambda spark, sf_dir: X.crawl_rows(_pages(spark, sf_dir)).select("page_id", "title", "words", "rejected"),
        "enhancer_pages": lambda spark, sf_dir: X.enhancer_rows(_pages(spark, sf_dir)).select("page_id", "title", "words", "valid", "score"),
        "structured_text": lambda spark, sf_dir: H.extract_fields(_pages(spark, sf_dir), "structured").select("page_id", "structured"),
        "resolved_links": lambda spark, sf_dir: H.extract_fields(_pages(spark, sf_dir), "links").select("page_id", F.explode("links").alias("dst")),
        "page_meta": lambda spark, sf_dir: H.extract_fields(_pages(spark, sf_dir), "meta").select("page_id", F.explode("meta").alias("name", "value")),
        "selector_probe": lambda spark, sf_dir: H.selector_lengths(_pages(spark, sf_dir)),
        "collections_sink": collections, "index_file": index_file, "config_file": config_file, "batch_extract": batch,
        "stream_new_events": new_events, "stream_totals": running_totals, "stream_pages": new_pages,
    }


def oracle_sql():
    patterns = DUCK.join(DUCK.map("excluded", "x", f"CASE WHEN {DUCK.test('x', '^/.*/$')} THEN {DUCK.extract('x', '^/(.*)/$', 1)} ELSE x END"), " ")
    return {
        "link_bfs": WALK, "rank_by_quality": catalog.ranked(DUCK), "excluded_rank": catalog.excluded(DUCK), "page_order": catalog.ordered_pages(DUCK),
        "clean_nfc": "SELECT doc_id, nfc_normalize(text) AS cleaned FROM documents",
        "collections_sink": COLLECTIONS,
        "index_file": f"SELECT site_key, url, title, estimated_words AS words, breadcrumbs, depth FROM ({catalog.page_record(DUCK)}) r",
        "config_file": f"SELECT site_key, name, base_url, CAST(max_depth AS BIGINT) AS max_depth, {patterns} AS patterns FROM ({catalog.sites(DUCK)}) c",
        "stream_new_events": "SELECT DISTINCT event_id, event_type FROM events",
        "stream_totals": "SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type",
        "stream_pages": f"SELECT p.page_id, p.words FROM ({catalog.page_rows(DUCK)}) p WHERE p.words >= 10",
    }
