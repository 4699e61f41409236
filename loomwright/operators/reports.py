"""Batch metrics, reports and collections, each written once for both engines.

A batch's outcome is one row a page: ok, filtered (score under the threshold) or failed (soft
404). Reports are one text a site; collections are rows (site, part, n, section), which read in
that order are the site's file, so no file has to fit in one row or task.
"""

from __future__ import annotations

from loomwright.functions import cleaning as C
from loomwright.functions import scoring as S
from loomwright.functions.dialect import Dialect
from loomwright.operators.catalog import GENERIC, sites, title_of

THRESHOLD, GENERATED = 0.2, "1970-01-01T00:00:00.000Z"  # the caller's time of generation
NL = "\n"
# The headings and labels of the reports
BANDS = ((0.9, 1.0, "Excellent (0.9-1.0)"), (0.7, 0.9, "Good (0.7-0.9)"), (0.5, 0.7, "Fair (0.5-0.7)"), (0.3, 0.5, "Poor (0.3-0.5)"), (0.0, 0.3, "Very Poor (0.0-0.3)"))
CLIENT_METHODS = ("defuddle", "fallback")
STRUCTURE = (("headers", r"^#+\s+", "m"), ("lists", r"^[-*+]\s+", "m"), ("code", r"```[\s\S]*```|`[^`]+`", ""), ("links", r"\[.*?\]\(.*?\)", ""))


def outcomes(d: Dialect) -> str:
    """page_id, url, site, title, content, words, score, method, reason, status, error. A report reads
    them several times: Spark's queries read a table that is written once (SHARED)."""
    return "SELECT * FROM page_outcomes" if d.java else judged(d)


def judged(d: Dialect, threshold: float = THRESHOLD) -> str:
    source = d.stage("SELECT page_id, url, html FROM pages", {"site": C.url_host(d, "url"), "title": title_of(d), "content": C.strip_html(d, "html")})
    source = d.stage(S.basis(d, source, "content"), {"words": "n", "score": S.overall(d, "content", 30)})
    lost = S.soft_404(d, "title", "content", "words")
    reason = "CASE WHEN length(content) > 50 AND score > 0.01 THEN 'stripHTML_success' ELSE 'min_length_not_met' END"
    status = f"CASE WHEN {lost} THEN 'failed' WHEN score < {threshold} THEN 'filtered' ELSE 'ok' END"
    error = f"CASE WHEN {lost} THEN 'HTTP 404: Not Found' WHEN score < {threshold} THEN concat('Content quality too low: ', {d.fixed('score', 2)}, ' < {threshold}') END"
    return f"SELECT page_id, url, site, title, content, words, score, CASE WHEN {d.test('content', r'^#+\s+', 'm')} THEN 'semantic_dom' ELSE 'fallback' END AS method, {reason} AS reason, {status} AS status, {error} AS error FROM ({source}) b"


def _n(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


OK, FILTERED, FAILED = "status = 'ok'", "status = 'filtered'", "status = 'failed'"
WORDS = "CAST(coalesce(sum(CASE WHEN status = 'ok' THEN words END), 0) AS BIGINT)"
MEAN_WORDS, MEAN_SCORE = "coalesce(avg(CASE WHEN status = 'ok' THEN words END), 0)", "coalesce(avg(CASE WHEN status = 'ok' THEN score END), 0)"


def metrics(d: Dialect, by: str = "site") -> str:
    http = {"http_404": d.has("error", "HTTP 404"), "http_500": d.has("error", "HTTP 500")}
    http["http_other"] = f"{d.has('error', 'HTTP')} AND NOT {http['http_404']} AND NOT {http['http_500']}"
    codes = ", ".join(f"{_n(f'{FAILED} AND {c}')} AS {k}" for k, c in http.items())
    return f"""SELECT {by}, count(*) AS total, {_n(OK)} AS successful, {_n(FAILED)} AS failed, {_n(FILTERED)} AS quality_filtered, {codes},
        {WORDS} AS total_words, {MEAN_WORDS} AS mean_words, {MEAN_SCORE} AS mean_score FROM ({outcomes(d)}) o GROUP BY {by}"""


def histogram(column: str, client: bool = False):
    """How many ok pages have each value of a column, with its share of the site's; the browser's
    form always has its two expected values."""

    def make(d: Dialect) -> str:
        counted = f"SELECT site, {column}, count(*) AS n FROM ({outcomes(d)}) o WHERE {OK} GROUP BY site, {column}"
        if client:
            seeded = f"SELECT site, {d.explode(d.array([d.lit(v) for v in CLIENT_METHODS]), column)} FROM (SELECT DISTINCT site FROM ({outcomes(d)}) o) s"
            counted = f"SELECT site, {column}, CAST(sum(n) AS BIGINT) AS n FROM (SELECT site, {column}, 0 AS n FROM ({seeded}) z UNION ALL SELECT * FROM ({counted}) c) u GROUP BY site, {column}"
        share = "CASE WHEN sum(n) OVER (PARTITION BY site) = 0 THEN CAST(0 AS DOUBLE) ELSE 100.0 * n / CAST(sum(n) OVER (PARTITION BY site) AS DOUBLE) END"
        return f"SELECT site, {column}, n, {share} AS percent FROM ({counted}) g"

    return make


def batch_summary(d: Dialect) -> str:
    return f"SELECT count(*) AS total, {_n(OK)} AS successful, {_n(FAILED)} AS failed, {MEAN_SCORE} AS mean_quality FROM ({outcomes(d)}) o"


def _best_first(d: Dialect) -> str:
    """Pages of one URL and score are a tie in SQL; Spark takes the lesser page first, as in the table's order."""
    return "score DESC, url" + ", page_id" * d.java


def batch_sorted(d: Dialect) -> str:
    return f"SELECT page_id, score, row_number() OVER (PARTITION BY site ORDER BY {_best_first(d)}) AS position FROM ({outcomes(d)}) o WHERE {OK}"


def side_outputs(d: Dialect) -> str:
    """The rows that callbacks would get: errors, and filtered pages with their constant score."""
    return f"SELECT url, status, error, CASE WHEN {FILTERED} THEN CAST(0.1 AS DOUBLE) END AS quality_score FROM ({outcomes(d)}) o WHERE NOT {OK}"


def performance(d: Dialect) -> str:
    """The browser's roll-up over all pages: bands, means, and shares of two families of methods."""
    good = "coalesce(content, '') <> ''"
    share = lambda names: f"coalesce(100.0 * {_n(f'{good} AND method IN ({names})')} / nullif({S.dbl(_n(good))}, 0), 0)"
    return f"""SELECT count(*) AS total, {_n(good)} AS successful, {_n(f'NOT ({good})')} AS failed, {_n(f'{good} AND score >= 0.7')} AS high, {_n(f'{good} AND score >= 0.4 AND score < 0.7')} AS medium,
        {_n(f'{good} AND score < 0.4')} AS low, coalesce(avg(CASE WHEN {good} THEN score END), 0) AS mean_score, coalesce(avg(CASE WHEN {good} THEN words END), 0) AS mean_words,
        100.0 * {_n(good)} / {S.dbl('count(*)')} AS success_percent, {share("'defuddle', 'defuddle_semantic', 'defuddle_cleaned'")} AS readability_percent,
        {share("'semantic_dom', 'defuddle_semantic'")} AS semantic_percent FROM ({outcomes(d)}) o"""


def telemetry(d: Dialect) -> str:
    """Per user's run of requests: how long (ms), how many, their mean time and pages a second."""
    ms = d.div(f"(max({d.micros('ts')}) - min({d.micros('ts')}))", "1000")
    return f"SELECT user_id, {ms} AS duration, count(*) AS requests, avg(value) AS mean_response, coalesce(1000 * {S.ratio(_n("event_type <> 'error'"), ms)}, 0) AS pages_per_second FROM events GROUP BY user_id"


def _text(d: Dialect, *parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _line(d: Dialect, label: str, value: str, end: str = NL) -> str:
    return f"{d.lit(label)}, {value}, {d.lit(end)}"


def _count(d: Dialect, label: str, n: str, of: str, end: str = NL) -> str:
    return f"{d.lit(label)}, CAST({n} AS STRING), ' (', {d.fixed(f'coalesce(100.0 * {n} / nullif({of}, 0), 0)', 1)}, {d.lit('%)' + end)}"


def _methods(d: Dialect) -> str:
    """site, methods: a line for each method, in the order of its first page."""
    rows = f"SELECT site, method, count(*) AS n, min(page_id) AS first, sum(count(*)) OVER (PARTITION BY site) AS total FROM ({outcomes(d)}) o WHERE {OK} GROUP BY site, method"
    line = _text(d, "method", "': '", "CAST(n AS STRING)", "' ('", d.fixed("(100.0 * n / total)", 1), d.lit("%)" + NL))
    return f"SELECT site, {d.joined(line, '', 'first')} AS methods FROM ({rows}) m GROUP BY site"


def _errors(d: Dialect) -> str:
    """site, errors: the first ten errors and how many more there are."""
    rows = f"SELECT site, url, error, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n, count(*) OVER (PARTITION BY site) AS total FROM ({outcomes(d)}) o WHERE {FAILED}"
    line = _text(d, "'- '", "url", "': '", "error", d.lit(NL))
    more = f"CASE WHEN max(total) > 10 THEN {_text(d, d.lit('... and '), 'CAST(max(total) - 10 AS STRING)', d.lit(' more errors' + NL))} ELSE '' END"
    return f"SELECT site, concat({d.joined(line, '', 'n')}, {more}) AS errors FROM ({rows}) e WHERE n <= 10 GROUP BY site"


def site_report(d: Dialect) -> str:
    """site, report: the text of a site's extraction report."""
    head = _text(d, "'📊 '", "name", d.lit(" - Content Extraction Report" + NL + "=" * 50 + NL * 2), "'Site: '", "name", d.lit(NL + "Base URL: "), "base_url", d.lit(f"{NL}Generated: {GENERATED}{NL * 2}📈 EXTRACTION STATISTICS{NL}{'-' * 30}{NL}"))
    counts = _text(d, _line(d, "Total pages: ", "CAST(total AS STRING)"), _line(d, "Successful: ", "CAST(successful AS STRING)"), _line(d, "Failed: ", "CAST(failed AS STRING)"), _line(d, "Quality filtered: ", "CAST(quality_filtered AS STRING)"),
                   _line(d, "Total words: ", "CAST(total_words AS STRING)"), _line(d, "Average words per page: ", d.fixed("mean_words"), NL * 2))
    good = f"CASE WHEN successful > 0 THEN {_text(d, _line(d, 'Average quality score: ', d.fixed('mean_score', 3), NL * 2), d.lit('🔧 EXTRACTION METHODS' + NL + '-' * 25 + NL), 'methods', d.lit(NL))} ELSE '' END"
    bad = f"CASE WHEN errors IS NOT NULL THEN {_text(d, d.lit('❌ ERRORS' + NL + '-' * 15 + NL), 'errors', d.lit(NL))} ELSE '' END"
    rows = f"SELECT m.*, h.methods, e.errors, coalesce(c.name, m.site) AS name, coalesce(c.base_url, concat('https://', m.site)) AS base_url FROM ({metrics(d)}) m LEFT JOIN ({_methods(d)}) h ON h.site = m.site LEFT JOIN ({_errors(d)}) e ON e.site = m.site LEFT JOIN ({sites(d)}) c ON c.host = m.site"
    return f"SELECT site, concat({head}, {counts}, {good}, {bad}) AS report FROM ({rows}) r"


def parsing_report(client: bool = False):
    """The text of a whole batch's parsing report, one row. The browser's form counts technical content by 12 patterns instead of 8."""
    technical = S.CLIENT_TECHNICAL if client else S.CLIENT_TECHNICAL[:8]

    def make(d: Dialect) -> str:
        ok = lambda c: _n(f"{OK} AND {c}")
        cols = {"total": "count(*)", "good": _n(OK), "failed": _n(FAILED), "filtered": _n(FILTERED), "words": WORDS, "mean_words": MEAN_WORDS, "mean_score": MEAN_SCORE,
                "high": ok("score >= 0.7"), "medium": ok("score >= 0.4 AND score < 0.7"), "low": ok("score < 0.4"),
                **{f"band{k}": ok(f"score >= {a} AND score < {b}") for k, (a, b, _) in enumerate(BANDS)},
                **{f"has_{k}": ok(d.test("content", p, f)) for k, p, f in STRUCTURE}, "has_technical": ok("(" + " OR ".join(d.test("content", p, "i") for p in technical) + ")")}
        rows = f"SELECT {', '.join(f'{e} AS {k}' for k, e in cols.items())} FROM ({outcomes(d)}) o"
        each = f"SELECT method, count(*) AS n, min(page_id) AS first, sum(count(*)) OVER () AS total FROM ({outcomes(d)}) o WHERE {OK} GROUP BY method"
        line = _text(d, "method", "': '", "CAST(n AS STRING)", "' ('", d.fixed("(100.0 * n / total)", 1), d.lit("%)" + NL))
        methods = f"SELECT {d.joined(line, '', 'first')} AS methods FROM ({each}) m"
        kinds = f"SELECT {S.error_type(d, 'error')} AS kind, count(*) AS n, min(page_id) AS first FROM ({outcomes(d)}) o WHERE {FAILED} GROUP BY {S.error_type(d, 'error')}"
        errors = f"SELECT {d.joined(_text(d, 'kind', d.lit(': '), 'CAST(n AS STRING)', d.lit(NL)), '', 'first')} AS errors FROM ({kinds}) k"
        title = lambda text, n: d.lit(f"{text}{NL}{'-' * n}{NL}")
        band = lambda k, label: f"CASE WHEN band{k} > 0 THEN {_text(d, _count(d, label + ': ', f'band{k}', 'good'))} ELSE '' END"
        quality = _text(d, title("📊 QUALITY ANALYSIS", 30), _count(d, "High quality (≥0.7): ", "high", "good"), _count(d, "Medium quality (0.4-0.7): ", "medium", "good"), _count(d, "Low quality (<0.4): ", "low", "good", NL * 2),
                        *(band(k, label) for k, (_, _, label) in enumerate(BANDS)), d.lit(NL))
        names = {"has_headers": "has headers", "has_lists": "has lists", "has_code": "has code", "has_links": "has links", "has_technical": "technical content"}
        text = _text(
            d, d.lit(f"📊 ENHANCED PARSING REPORT{NL}{'=' * 60}{NL * 2}"), title("📈 OVERALL STATISTICS", 30), _line(d, "Total URLs processed: ", "CAST(total AS STRING)"),
            _count(d, "Successful extractions: ", "good", "total"), _count(d, "Failed extractions: ", "failed", "total"), _count(d, "Quality filtered: ", "filtered", "total"),
            _line(d, "Total words extracted: ", d.thousands("words")), _line(d, "Average words per document: ", d.fixed("mean_words")), _line(d, "Average quality score: ", d.fixed("mean_score", 3), NL * 2),
            title("🔧 EXTRACTION METHODS (Enhanced)", 40), "coalesce(methods, '')", d.lit(NL), f"CASE WHEN good > 0 THEN {quality} ELSE '' END", title("🏗️ CONTENT STRUCTURE ANALYSIS", 40),
            *(_count(d, f"{label}: ", k, "good") for k, label in names.items()), d.lit(NL),
            f"CASE WHEN errors IS NOT NULL THEN {_text(d, title('❌ ERROR ANALYSIS', 30), 'errors', d.lit(NL))} ELSE '' END", title("⚡ PERFORMANCE SUMMARY", 30),
            f"'Success rate: ', {d.fixed('coalesce(100.0 * good / nullif(total, 0), 0)', 1)}, {d.lit('%' + NL)}", _line(d, "Average content quality: ", d.fixed("mean_score", 3)),
            _line(d, "Total content extracted: ", d.thousands("words"), " words" + NL), _line(d, "Average words per document: ", d.fixed("mean_words")),
            _line(d, "Content density: ", d.fixed("coalesce(1.0 * words / nullif(total, 0), 0)", 1), " words/URL" + NL * 2),
            d.lit(f"{'=' * 60}{NL}Report generated: {GENERATED}{NL}Enhanced content extraction with semantic preservation{NL}"),
        )
        return f"SELECT {text} AS report FROM (SELECT r.*, ({methods}) AS methods, ({errors}) AS errors FROM ({rows}) r) t"

    return make


def run_summary(d: Dialect) -> str:
    """The closing lines of a run over all sites."""
    rows = f"SELECT count(DISTINCT site) AS sites, count(*) AS pages, {_n(OK)} AS good, {_n(FAILED)} AS failed, {_n(FILTERED)} AS filtered, {WORDS} AS words FROM ({outcomes(d)}) o"
    text = _text(d, _line(d, "Sites processed: ", "CAST(sites AS STRING)"), _line(d, "Total pages: ", "CAST(pages AS STRING)"), _line(d, "Successful extractions: ", "CAST(good AS STRING)"), _line(d, "Failed extractions: ", "CAST(failed AS STRING)"),
                 _line(d, "Quality filtered: ", "CAST(filtered AS STRING)"), _line(d, "Total words extracted: ", d.thousands("words")), "'Success rate: '", d.fixed("coalesce(100.0 * good / nullif(pages, 0), 0)", 1), "'%'")
    return f"SELECT {text} AS summary FROM ({rows}) r"


def collection(client: bool = False, scores: bool = True, metadata: bool = True, excluded: bool = True, most: int | None = None, rows: str | None = None):
    """A site's llms.txt as sections: part 0 the head, 1 the contents, 2 what was excluded, 3 the
    documents; a site without documents has one section that says so. rows: numbered documents
    that are given (plans.programs numbers them without a sort of a whole site)."""

    def make(d: Dialect) -> str:
        limit = "" if most is None else f" WHERE n <= {most}"
        numbered = rows or f"SELECT *, row_number() OVER (PARTITION BY site ORDER BY {_best_first(d)}) AS n FROM ({outcomes(d)}) o WHERE {OK}"
        docs = f"SELECT * FROM ({numbered}) r{limit}"
        name = C.document_title(d, "title")
        shown = f"CASE WHEN {d.test(name, GENERIC, 'i')} THEN {C.url_title(d, 'url')} ELSE {name} END"
        toc = _text(d, f"CASE WHEN n = 1 THEN {d.lit('### Included Documents' + NL * 2)} ELSE '' END", "CAST(n AS STRING)", "'. ['", shown, "']('", "url", d.lit(")" + NL))
        head = _text(d, d.lit(f"# Documentation Collection{NL * 2}Generated on: {GENERATED}{NL}"), _line(d, "Total documents: ", "CAST(count(*) AS STRING)"), _line(d, "Total words: ", "CAST(CAST(sum(words) AS BIGINT) AS STRING)", NL * 2), d.lit("## Table of Contents" + NL * 2))
        body = [d.lit(NL + "---" + NL * 2), "'# '", "CAST(n AS STRING)", "'. '", "coalesce(nullif(title, ''), 'Untitled Document')", d.lit(NL * 2)]
        if metadata:
            body += [_line(d, "Document Number: ", "CAST(n AS STRING)"), _line(d, "Source: ", "url"), _line(d, "Words: ", "CAST(words AS STRING)")]
            body += [_line(d, "Quality Score: ", d.fixed("score", 3))] if scores else []
            body += [_line(d, "Extraction Method: ", "'html'", NL * 2)] if client else [_line(d, "Extraction Method: ", "method"), _line(d, "Extraction Reason: ", "reason", NL * 2)]
        body += ["content", d.lit(NL)]
        parts = [f"SELECT site, 0 AS part, 0 AS n, {head} AS section FROM ({docs}) h GROUP BY site", f"SELECT site, 1 AS part, n, {toc} AS section FROM ({docs}) t", f"SELECT site, 3 AS part, n, {_text(d, *body)} AS section FROM ({docs}) b"]
        if excluded:
            left = f"SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) AS n FROM ({outcomes(d)}) o WHERE {FILTERED}"  # all have the constant score 0.1
            parts.append(f"SELECT site, 2 AS part, n, {_text(d, f"CASE WHEN n = 1 THEN {d.lit(NL + '### Excluded Documents (Quality Filtered)' + NL * 2)} ELSE '' END", 'CAST(n AS STRING)', d.lit('. '), 'url', d.lit(NL))} AS section FROM ({left}) x")
        stub = _text(d, "'# '", "site", d.lit(f" - No Content Available{NL * 2}No high-quality content could be extracted from this site.{NL * 2}Generated: {GENERATED}"))
        parts.append(f"SELECT site, 0 AS part, 0 AS n, {stub} AS section FROM ({outcomes(d)}) o GROUP BY site HAVING {_n(OK)} = 0")
        return " UNION ALL ".join(parts)

    return make


SHARED = {"page_outcomes": judged}
REPORTS = {
    "batch_metrics": metrics, "method_histogram": histogram("method"), "reason_histogram": histogram("reason"), "method_histogram_client": histogram("method", True), "batch_summary": batch_summary,
    "batch_sorted": batch_sorted, "side_outputs": side_outputs, "extraction_performance": performance, "crawl_telemetry": telemetry, "site_report_text": site_report,
    "parsing_report": parsing_report(), "parsing_report_client": parsing_report(True), "run_summary": run_summary, "collection_sections": collection(), "collection_sections_client": collection(client=True, scores=False),
    "collection_top": collection(most=3, metadata=False, excluded=False),
    "iso_times": lambda d: f"SELECT event_id, {d.iso('ts')} AS iso, {d.left(d.iso('ts'), 10)} AS day FROM events",
    "display_tree": lambda d: f"SELECT site, status, {d.joined('url', NL, 'url')} AS urls FROM (SELECT DISTINCT site, status, url FROM ({outcomes(d)}) o) t GROUP BY site, status",
}
