"""Pages to documents: extraction, cleaning and the quality gate of each profile."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import cleaning as C
from loomwright.functions import html as H
from loomwright.functions import scoring as S
from loomwright.functions.dialect import SPARK as D
from loomwright.operators.catalog import GENERIC, sites

GATE, LAST_GATE, LEAST = 0.05, 0.01, H.LEAST


def _view(df: DataFrame) -> str:
    name = f"lw_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    return name


def _scored(df: DataFrame, column: str, name: str, least: int, client: bool = False) -> DataFrame:
    """df with the words (n) and the score of a text column."""
    source = S.basis(D, f"SELECT * FROM {_view(df)}", column, hits=not client)
    made = (S.client_overall if client else S.overall)(D, column, least)
    keep = ", ".join(df.columns)
    return df.sparkSession.sql(f"SELECT {keep}, n AS {name}_words, {name} FROM ({D.stage(source, {name: made})}) s")


def strategies(pages: DataFrame, *more: str) -> DataFrame:
    """The semantic candidate, and the last resort where it did not pass the gate: page_id, url,
    title, heading, content, method, reason and the further fields. Only candidates that can miss the
    gate are scored (functions.html.surely_scored); the others are known to pass."""
    found = H.extract_fields(pages, "title", "heading", "content", "reason", "body", *more)
    keep = ["page_id", "url", "title", "heading", *more]
    sure = found.where("body is null").select(*keep, "content", F.lit("semantic_dom").alias("method"), "reason")
    open_ = _scored(found.where("body is not null"), "content", "gate", H.LEAST_SCORED)
    passed = (F.col("content").isNotNull()) & (F.col("gate") > GATE)
    open_ = open_.withColumn("rest", F.when(~passed, F.expr(C.strip_html(D, "body"))))
    last = _scored(open_.drop("gate", "gate_words"), "rest", "last", H.LEAST_SCORED).withColumn("passed", F.col("rest").isNull())
    long = F.length("rest") > LEAST
    content = F.when(F.col("passed"), F.col("content")).when(long & (F.col("last") <= LAST_GATE), None).otherwise(F.col("rest"))
    reason = F.when(F.col("passed"), F.col("reason")).when(~long, "min_length_not_met").when(F.col("last") > LAST_GATE, "stripHTML_success").otherwise("low_quality")
    method = F.when(F.col("passed"), "semantic_dom").otherwise("fallback")
    return sure.unionByName(last.select(*keep, content.alias("content"), method.alias("method"), reason.alias("reason")))


def extract_pages(pages: DataFrame, extractor=None) -> DataFrame:
    """page_id, url, title, content, method, reason, links, meta. extractor: a first strategy, a
    function from the pages to (page_id, content) rows; its text of over 50 characters goes first."""
    out = strategies(pages, "links", "meta").drop("heading")
    if extractor is None:
        return out
    own = extractor(pages).where(F.length(F.trim("content")) > LEAST).select(F.col("page_id").alias("own_id"), F.trim("content").alias("own"))
    out = out.join(own, F.col("page_id") == F.col("own_id"), "left")
    pick = lambda a, b: F.when(F.col("own").isNotNull(), F.lit(a) if isinstance(a, str) else a).otherwise(F.col(b)).alias(b)
    return out.select("page_id", "url", "title", pick(F.col("own"), "content"), pick("extractor", "method"), pick("success_clean_text", "reason"), "links", "meta")


def _steps(df: DataFrame, make, **options) -> DataFrame:
    """df with its content after the steps of functions.cleaning."""
    made = make(D, f"SELECT * FROM {_view(df)}", "content", "cleaned_content", **options)
    others = ", ".join(c for c in df.columns if c != "content")
    return df.sparkSession.sql(f"SELECT {others}, cleaned_content AS content FROM ({made}) s")


def _titled(df: DataFrame) -> DataFrame:
    """Generic and empty titles give way to one made from the URL; all are cleaned."""
    generic = D.test("title", GENERIC, "i")
    return df.withColumn("title", F.expr(C.clean_title(D, f"CASE WHEN {generic} THEN {C.url_title(D, 'url')} ELSE title END")))


def clean_documents(pages: DataFrame, threshold: float = 0.2, extractor=None) -> DataFrame:
    """The server's chain: page_id, url, title, content, words, score, source, method, reason, error.

    NFC, boilerplate, video, DOM, entities, markdown, special characters, white space, then the
    gate: rows under the threshold have an error and no content. URLs of text files take the same
    chain without extraction and pass with score 1."""
    plain = F.col("url").endswith(".txt")
    files = pages.where(plain).select("page_id", "url", F.expr(C.url_title(D, "url")).alias("title"), F.coalesce("html", F.lit("")).alias("content"), F.lit("plain-text").alias("method"), F.lit("plain-text-file").alias("reason"))
    found = _titled(extract_pages(pages.where(~plain), extractor)).select("page_id", "url", "title", F.coalesce("content", F.lit("")).alias("content"), "method", "reason")
    rows = _steps(H.composed(found.unionByName(files), "content"), C.first_steps)
    rows = _scored(_steps(H.dom_cleaned(rows, "content"), C.last_steps), "content", "score", 30)
    text = F.col("method") == "plain-text"
    score = F.when(text, 1.0).otherwise(F.col("score"))
    low = ~text & (F.col("score") < threshold)
    error = F.when(low, F.expr(f"concat('Content quality too low: ', {D.fixed('score', 2)}, ' < {threshold}')"))
    return rows.select("page_id", "url", "title", F.when(~low, F.col("content")).alias("content"), F.col("score_words").alias("words"), score.alias("score"), F.when(text, "plain-text").otherwise("html").alias("source"), "method", "reason", error.alias("error"))


def client_documents(pages: DataFrame, threshold: float = 0.2) -> DataFrame:
    """The browser's profile: the semantic text as it is, or the stripped body; its own score and gate."""
    found = H.extract_fields(pages, "title", "content", "reason", "body")
    kept = found.where("content is not null").select("page_id", "url", "title", "content", F.lit("semantic_dom").alias("method"), "reason")  # its lowest score is over the gate
    rest = H.composed(found.where("content is null").select("page_id", "url", "title", F.col("body").alias("content")), "content")
    rest = _steps(H.dom_cleaned(_steps(rest, C.first_steps), "content", True), C.last_steps, client=True)
    long = F.length("content") > LEAST
    rest = rest.select("page_id", "url", "title", "content", F.lit("fallback").alias("method"), F.when(long, "stripHTML_success").otherwise("min_length_not_met").alias("reason"))
    rows = _scored(_titled(kept.unionByName(rest)), "content", "score", 30, True)
    return rows.where(F.col("score") >= threshold).select("page_id", "url", "title", "content", F.col("score_words").alias("words"), "score", "method", "reason")


def crawl_rows(pages: DataFrame) -> DataFrame:
    """The crawler's profile: page_id, url, title, content, words, rejected (null: accepted). The
    text of the first of its selectors, the site's filters, soft 404 and the site's least words."""
    spark = pages.sparkSession
    found = H.extract_fields(pages, "heading", "manual")
    pages.createOrReplaceTempView("pages")
    rows = _view(found.withColumn("host", F.expr(C.url_host(D, "url"))))
    title = f"CASE WHEN heading = '' THEN {C.url_title(D, 'url')} ELSE heading END"
    text = f"CASE WHEN filtered THEN {C.content_filters(D, 'manual')} ELSE manual END"
    joined = f"SELECT r.*, coalesce(c.filtered, false) AS filtered, coalesce(nullif(c.min_words, 0), 10) AS least FROM {rows} r LEFT JOIN ({sites(D)}) c ON c.host = r.host"
    staged = D.stage(D.stage(joined, {"content": text, "name": title}), {"words": D.n_words("content")})
    lost = S.soft_404(D, "name", "content", "words")
    why = f"CASE WHEN {lost} THEN '404' WHEN words < least THEN 'too few words' END"
    return spark.sql(f"SELECT page_id, url, {C.clean_title(D, 'name')} AS title, content, words, {why} AS rejected FROM ({staged}) s")


def enhancer_rows(pages: DataFrame, least: int = 50) -> DataFrame:
    """The enhancer's profile: page_id, title, content, words, valid, score. The first selector with
    enough words or the body, its filters and its check of length."""
    found = _view(H.extract_fields(pages, "heading", "enhanced"))
    text = D.stage(f"SELECT * FROM {found}", {"content": C.enhancer_filters(D, "enhanced")})
    text = D.stage(text, {"words": D.n_words("content")})
    valid, score = S.validity(D, "content", "words", least)
    title = f"CASE WHEN heading = '' THEN {C.enhancer_url_title(D, 'url')} ELSE {C.enhancer_title(D, 'heading')} END"
    return pages.sparkSession.sql(f"SELECT page_id, {title} AS title, content, words, {valid} AS valid, {score} AS score FROM ({text}) t")
