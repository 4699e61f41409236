"""The library's queries, each written once for both engines (see functions.dialect).

Text is scored behind a subquery, so that cleaned text and word lists are computed once a row.
Every ordering has a tie-break; percentages and means of nothing are 0.
"""

from __future__ import annotations

from loomwright.functions import cleaning as C
from loomwright.functions import scoring as S
from loomwright.functions.dialect import Dialect

# What a user would give, as conditions over the tables: the pages that are selected and the seeds
SELECTED, SEEDS = "url LIKE '%/en/%'", "url LIKE '%utm_source=feed%'"
# The status of a failed request is not in the event table: 400 and twice the number in its props stands for it
STATUS = (400, 2)
GENERIC = r"^(|untitled document|index|home|get(ting)? started)$"
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")


def scored(d: Dialect) -> str:
    """documents with word count, score and title: what most of the relational queries start from."""
    made = d.stage(S.basis(d, "SELECT doc_id, source, lang, text FROM documents", "text"), {"words": "n", "score": S.overall(d, "text", 30)})
    return f"SELECT doc_id, source, lang, text, words, score FROM ({made}) m"


def _per_doc(column: str, make):
    return lambda d: f"SELECT doc_id, {make(d, 'text')} AS {column} FROM documents"


def _scored_doc(column: str, make, **parts):
    return lambda d: f"SELECT doc_id, {make(d, 'text')} AS {column} FROM ({S.basis(d, 'SELECT doc_id, text FROM documents', 'text', **parts)}) b"


def plain(d: Dialect) -> str:
    return S.basis(d, d.stage("SELECT doc_id, text FROM documents", {"t": C.strip_tags(d, "text")}), "t", hits=False)


def _stripped(column: str, make):
    return lambda d: f"SELECT doc_id, {make(d, 't')} AS {column} FROM ({plain(d)}) s"


def _page(column: str, make):
    return lambda d: f"SELECT page_id, {make(d, 'html')} AS {column} FROM pages"


def _url(column: str, make):
    return lambda d: f"SELECT page_id, {make(d, 'url')} AS {column} FROM pages"


def assessed(technical_least: float | None):
    """The whole assessment of each document, with or without the gate on technical content."""

    def make(d: Dialect) -> str:
        rows = S.assessment(d, S.basis(d, "SELECT doc_id, text FROM documents", "text"), "text", 100, technical_least)
        return f"SELECT doc_id, readability, completeness, technical, structure, score, level, reason, n AS n_words, unique_words, characters FROM ({rows}) a"

    return make


def class_scores(d: Dialect) -> str:
    return d.stage(plain(d), {k: make(d, "text" if k == "structure" else "t") for k, make in S.CLASS_PARTS.items()})


def class_overall(weights: dict):
    def make(d: Dialect) -> str:
        total = " + ".join(f"{w} * {k}" for k, w in weights.items())
        level = S.level("total", ("excellent", "good", "acceptable", "poor", "very-poor"), (0.8, 0.6, 0.4, 0.2))
        return f"SELECT doc_id, total, {level} AS level FROM (SELECT doc_id, {S.dbl(total)} AS total FROM ({class_scores(d)}) p) q"

    return make


def class_gate(weights: dict, least: float):
    """Passed or not against the class score, with the content only of what passed."""

    def make(d: Dialect) -> str:
        total = S.dbl(" + ".join(f"{w} * {k}" for k, w in weights.items()))
        return f"SELECT doc_id, total >= {least} AS passed, CASE WHEN total >= {least} THEN length(text) END AS kept_chars FROM (SELECT doc_id, text, {total} AS total FROM ({class_scores(d)}) p) q"

    return make


def advice(d: Dialect) -> str:
    items = d.filter(d.array([f"CASE WHEN {k} < {edge} THEN {d.lit(text)} ELSE '' END" for k, edge, text in S.ADVICE]), "r", "r <> ''")
    return f"SELECT doc_id, {d.size(items)} AS n_advice, {d.join(items, '; ')} AS advice FROM ({class_scores(d)}) p"


def site_report(d: Dialect) -> str:
    return f"""SELECT source, count(*) AS pages, CAST(sum(words) AS BIGINT) AS total_words, CAST(floor(avg(words) + 0.5) AS BIGINT) AS mean_words, avg(score) AS mean_score,
        CAST(sum(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN score >= 0.4 AND score < 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS medium,
        CAST(sum(CASE WHEN score < 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN score >= 0.2 THEN 0 ELSE 1 END) AS BIGINT) AS filtered FROM ({scored(d)}) s GROUP BY source"""


def run_totals(d: Dialect) -> str:
    return f"""SELECT coalesce(source, 'all sites') AS site, count(*) AS pages, CAST(sum(words) AS BIGINT) AS total_words, 100.0 * CAST(sum(CASE WHEN score >= 0.2 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS success_percent
        FROM ({scored(d)}) s GROUP BY ROLLUP(source)"""


def buckets(d: Dialect) -> str:
    edges = ((0.9, 1.0, "excellent"), (0.7, 0.9, "good"), (0.5, 0.7, "fair"), (0.3, 0.5, "poor"), (0.0, 0.3, "very poor"))
    case = "CASE " + " ".join(f"WHEN score >= {a} AND score < {b} THEN '{n}'" for a, b, n in edges) + " END"
    return f"SELECT bucket, count(*) AS n FROM (SELECT {case} AS bucket FROM ({scored(d)}) s) b WHERE bucket IS NOT NULL GROUP BY bucket"


def level_share(d: Dialect) -> str:
    return f"""SELECT source, level, n, 100.0 * n / CAST(sum(n) OVER (PARTITION BY source) AS DOUBLE) AS percent FROM (
        SELECT source, level, count(*) AS n FROM (SELECT source, {S.level('score')} AS level FROM ({scored(d)}) s) l GROUP BY source, level) g"""


def structure_counts(d: Dialect) -> str:
    flags = {"has_headers": d.test("text", r"^#+\s+", "m"), "has_lists": d.test("text", r"^[-*+]\s+", "m"), "has_code": d.test("text", r"```[\s\S]*```|`[^`]+`"), "has_links": d.test("text", r"\[.*?\]\(.*?\)"), "technical": "(" + " OR ".join(d.test("text", p, "i") for p in S.CLIENT_TECHNICAL[:8]) + ")"}
    return "SELECT " + ", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k, c in flags.items()) + " FROM documents"


def error_types(d: Dialect) -> str:
    return f"SELECT error_type, count(*) AS n FROM (SELECT {S.error_type(d, 'message')} AS error_type FROM ({failures(d)}) e) t GROUP BY error_type"


def failures(d: Dialect) -> str:
    """Error events as failed requests: event_id, user_id, message (timeouts are the slowest values)."""
    status = f"CAST({STATUS[0]} + {STATUS[1]} * CAST({d.extract('props', r'(\d+)', 1)} AS BIGINT) AS STRING)"
    message = f"CASE WHEN value > 90 THEN 'timeout of 15000 ms' WHEN value < 2 THEN 'network down' ELSE concat('HTTP ', {status}) END"
    return f"SELECT event_id, user_id, {message} AS message FROM events WHERE event_type = 'error'"


def retries(d: Dialect) -> str:
    """Whether a failed request is tried again, how often at most, and after which waits (ms)."""
    final = " OR ".join(d.has("lower(message)", w) for w in S.FINAL_ERRORS)
    waits = d.join(d.map(d.array([str(k) for k in range(S.RETRIES)]), "k", f"CAST(least({d.powers('2', 'k')} * {S.RETRY_BASE}, {S.RETRY_MOST}) AS STRING)"), ",")
    return f"SELECT event_id, ({final}) AS final, CASE WHEN {final} THEN 0 ELSE {S.RETRIES} END AS retries, CASE WHEN {final} THEN '' ELSE {waits} END AS waits FROM ({failures(d)}) f"


def ranked(d: Dialect) -> str:
    return f"SELECT doc_id, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS position FROM ({scored(d)}) s WHERE score >= 0.2"


def excluded(d: Dialect) -> str:
    return f"SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY score, doc_id) AS position FROM ({scored(d)}) s WHERE score < 0.4"


def title_of(d: Dialect) -> str:
    return C.document_title(d, d.extract("html", r"<title[^>]*>([\s\S]*?)</title>", 1, "i"))


def page_rows(d: Dialect) -> str:
    title = f"CASE WHEN {d.test('title', GENERIC, 'i')} THEN {C.url_title(d, 'url')} ELSE title END"
    return f"SELECT page_id, url, host, {title} AS title, content, {d.n_words('content')} AS words FROM ({d.stage('SELECT page_id, url, html FROM pages', {'host': C.url_host(d, 'url'), 'title': title_of(d), 'content': C.strip_html(d, 'html')})}) p"


def page_record(d: Dialect) -> str:
    """The ten fields of an indexed page (the time of the crawl is the caller's)."""
    crumbs = d.join(C.breadcrumbs(d, "url"), "|")
    return f"""SELECT p.page_id, p.url, {C.clean_title(d, 'p.title')} AS title, p.content, p.words AS estimated_words, '1970-01-01T00:00:00.000Z' AS last_modified, {crumbs.replace('url', 'p.url')} AS breadcrumbs,
        coalesce(c.site_key, 'unknown') AS site_key, coalesce(c.name, 'Unknown Site') AS site_name, {d.size(C.url_parts(d, 'p.url'))} AS depth FROM ({page_rows(d)}) p LEFT JOIN ({sites(d)}) c ON c.host = p.host"""


def estimates(d: Dialect) -> str:
    words = "coalesce(nullif(words, 0), greatest(300, 15 * length(title)))"
    return f"SELECT page_id, CAST({words} AS BIGINT) AS est_words, CAST(floor(5.5 * {words} + 0.5) AS BIGINT) AS est_chars FROM ({page_rows(d)}) p"


def _chosen(d: Dialect) -> str:
    return f"SELECT url FROM pages WHERE {SELECTED}"


def selection_sum(d: Dialect) -> str:
    n = "CAST(sum(est_chars) AS BIGINT)"
    size = f"CASE WHEN {n} < 1000 THEN CAST({n} AS STRING) WHEN {n} < 1000000 THEN concat({d.fixed(f'({n} / 1000.0)', 1)}, 'K') ELSE concat({d.fixed(f'({n} / 1000000.0)', 1)}, 'M') END"
    return f"SELECT count(*) AS pages, {n} AS chars, {size} AS size FROM ({estimates(d)}) e WHERE page_id IN (SELECT page_id FROM pages WHERE url IN ({_chosen(d)}))"


def tri_state(d: Dialect) -> str:
    picked = f"sum(CASE WHEN {SELECTED} THEN 1 ELSE 0 END)"
    return f"SELECT host, CASE {picked} WHEN 0 THEN 'none' WHEN count(*) THEN 'all' ELSE 'some' END AS state FROM (SELECT url, {C.url_host(d, 'url')} AS host FROM pages) p GROUP BY host"


def single_site(d: Dialect) -> str:
    """Whether the selection is all pages of one site, for whose collection there is a file already."""
    mine, all_of = "sum(CASE WHEN chosen THEN 1 ELSE 0 END)", "sum(CASE WHEN site_chosen > 0 THEN 1 ELSE 0 END)"
    hosts = "count(DISTINCT CASE WHEN chosen THEN host END)"
    rows = f"SELECT host, chosen, sum(CASE WHEN chosen THEN 1 ELSE 0 END) OVER (PARTITION BY host) AS site_chosen FROM (SELECT {C.url_host(d, 'url')} AS host, {SELECTED} AS chosen FROM pages) p"
    return f"SELECT {hosts} AS hosts, CAST({mine} AS BIGINT) AS selected, CAST({all_of} AS BIGINT) AS pages_of_sites, CASE WHEN {hosts} = 1 AND {mine} = {all_of} THEN concat('/', min(CASE WHEN chosen THEN host END), '-llms.txt') END AS route FROM ({rows}) q"


def links(d: Dialect) -> str:
    refs = d.distinct(d.extract_all("html", r"""<a\s[^>]*href\s*=\s*["']([^"']*)["']""", 1, "i"))
    return f"SELECT page_id, url, {d.explode(refs, 'href')} FROM pages"


def edges(d: Dialect) -> str:
    """Absolute and root-relative links of the same host without a fragment."""
    return f"SELECT DISTINCT url AS src, dst FROM ({targets(d)}) t WHERE NOT {d.has('dst', '#')} AND host = {C.url_host(d, 'dst')}"


def sites(d: Dialect) -> str:
    """The site configuration as a relation, which stands for a file read by sources.files: the
    hosts of two families are configured, each family with its limits, patterns and selectors."""
    blog = "host LIKE 'blog.%'"
    none = f"CASE WHEN {blog} THEN {{}} END"
    patterns = f"CASE WHEN {blog} THEN {d.array([d.lit('/de/'), d.lit('/fr/')])} ELSE {d.array([d.lit('/es/'), d.lit(r'[?]page=[0-9]+')])} END"
    return f"""SELECT row_number() OVER (ORDER BY host) - 1 AS ordinal, {C.slug(d, 'host')} AS site_key, concat('Site ', host) AS name, host, concat('https://', host) AS base_url,
        CASE WHEN {blog} THEN 2 ELSE 3 END AS max_depth, CASE WHEN {blog} THEN 10 ELSE 20 END AS max_pages, CASE WHEN {blog} THEN 50 ELSE 0 END AS min_words, {patterns} AS excluded,
        {none.format("'article, main'")} AS selectors, {blog} AS filtered, {none.format('2000')} AS most_code
        FROM (SELECT DISTINCT {C.url_host(d, 'url')} AS host FROM pages) h WHERE {blog} OR host LIKE 'www.%'"""


DEFAULT_SELECTORS = "main, article, .content, .main, [role=\"main\"]"


def hosted(d: Dialect, columns: str = "page_id, url") -> str:
    return f"SELECT {columns}, {C.url_host(d, 'url')} AS host FROM pages"


def host_config(d: Dialect) -> str:
    """Each page with its site's settings, or the defaults."""
    return f"""SELECT p.page_id, coalesce(c.site_key, 'default') AS site_key, coalesce(c.max_depth, 3) AS max_depth, coalesce(c.selectors, {d.lit(DEFAULT_SELECTORS)}) AS selectors,
        {d.size('c.excluded')} AS patterns FROM ({hosted(d)}) p LEFT JOIN ({sites(d)}) c ON c.host = p.host"""


def url_options(d: Dialect) -> str:
    """The selectors of each selected URL, as a list and how many there are."""
    trimmed = d.map(d.split("selectors", ","), "s", d.trim("s"))
    rows = f"SELECT p.url, coalesce(c.selectors, {d.lit(DEFAULT_SELECTORS)}) AS selectors FROM (SELECT DISTINCT url, {C.url_host(d, 'url')} AS host FROM pages WHERE {SELECTED}) p LEFT JOIN ({sites(d)}) c ON c.host = p.host"
    return f"SELECT url, {d.join(trimmed, '|')} AS selectors, {d.size(trimmed)} AS n FROM ({rows}) r"


def admissible(d: Dialect) -> str:
    """Whether a link may be crawled from its page: same host, no fragment, none of the site's patterns."""
    ok = f"{C.url_host(d, 'dst')} = p.host AND NOT {d.has('dst', '#')} AND {d.size(d.filter('coalesce(c.excluded, p.nothing)', 'x', d.matches('dst', 'x')))} = 0"
    links_ = f"SELECT page_id, url, host, dst, {d.filter(d.array([d.lit('')]), 'x', 'x <> ' + d.lit(''))} AS nothing FROM ({targets(d)}) t"
    return f"SELECT p.page_id, p.dst, ({ok}) AS admissible FROM ({links_}) p LEFT JOIN ({sites(d)}) c ON c.host = p.host"


def targets(d: Dialect) -> str:
    """Each page's absolute and root-relative links: page_id, url, host, dst."""
    origin = d.extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    to = f"CASE WHEN {d.test('href', r'^https?://')} THEN href WHEN {d.test('href', r'^/[^/]')} THEN concat({origin}, href) END"
    return f"SELECT page_id, url, {C.url_host(d, 'url')} AS host, dst FROM (SELECT page_id, url, {to} AS dst FROM ({links(d)}) l) e WHERE dst IS NOT NULL"


def site_min_words(d: Dialect) -> str:
    """Pages with enough words for their site; 0 and no figure mean 10."""
    return f"SELECT p.page_id, p.words FROM ({page_rows(d)}) p LEFT JOIN ({sites(d)}) c ON c.host = p.host WHERE p.words >= coalesce(nullif(c.min_words, 0), 10)"


def site_filters(d: Dialect) -> str:
    """The crawler's filters where the site is configured for them; other pages stay as they are."""
    return f"SELECT page_id, CASE WHEN filtered THEN {C.content_filters(d, 'content')} ELSE content END AS content FROM (SELECT p.page_id, p.html AS content, coalesce(c.filtered, false) AS filtered FROM ({hosted(d, 'page_id, url, html')}) p LEFT JOIN ({sites(d)}) c ON c.host = p.host) q"


def site_results(d: Dialect) -> str:
    """Per configured site its pages and mean words, with what its configuration says of it."""
    return f"SELECT c.site_key, c.name, c.base_url, count(*) AS pages, CAST(floor(avg(p.words) + 0.5) AS BIGINT) AS mean_words FROM ({page_rows(d)}) p JOIN ({sites(d)}) c ON c.host = p.host GROUP BY c.site_key, c.name, c.base_url"


def pages_by_site(d: Dialect) -> str:
    rows = f"SELECT coalesce(c.site_key, 'unknown') AS site_key, coalesce(c.name, 'Unknown Site') AS site_name, p.page_id FROM ({hosted(d)}) p LEFT JOIN ({sites(d)}) c ON c.host = p.host"
    return f"SELECT site_key, site_name, count(*) AS n, {d.joined('CAST(page_id AS STRING)', ',', 'page_id')} AS page_ids FROM ({rows}) r GROUP BY site_key, site_name"


def site_order(d: Dialect) -> str:
    """Sites as listed: the configured ones in their order, then the others by key."""
    return f"""SELECT site_key, row_number() OVER (ORDER BY CASE WHEN ordinal IS NULL THEN 1 ELSE 0 END, ordinal, site_key) AS position FROM (
        SELECT DISTINCT coalesce(c.site_key, p.host) AS site_key, c.ordinal FROM ({hosted(d)}) p LEFT JOIN ({sites(d)}) c ON c.host = p.host) q"""


def selected_order(d: Dialect) -> str:
    """The selected pages in the order of their list, Root where a page has no path."""
    path = f"coalesce(nullif({d.join(C.breadcrumbs(d, 'url'), ' / ')}, ''), 'Root')"
    return f"""SELECT page_id, path, row_number() OVER (PARTITION BY host ORDER BY path, page_id) AS position, coalesce(ordinal, -1) AS site FROM (
        SELECT p.page_id, p.host, c.ordinal, {path} AS path FROM ({hosted(d)}) p LEFT JOIN ({sites(d)}) c ON c.host = p.host WHERE {SELECTED}) q"""


def existing_urls(d: Dialect) -> str:
    """The indexed URLs over all sites, each once, and in how many sites' indexes it is."""
    return f"SELECT url, count(DISTINCT site) AS sites FROM (SELECT url, {C.url_host(d, 'url')} AS site FROM pages UNION ALL SELECT dst, host FROM ({targets(d)}) t) u GROUP BY url"


def selection_edit(d: Dialect) -> str:
    """The selection after the feed's pages were added and Spanish ones taken away."""
    return f"(SELECT url FROM pages WHERE {SELECTED} UNION SELECT url FROM pages WHERE {SEEDS}) EXCEPT SELECT url FROM pages WHERE url LIKE '%/es/%'"


def selection_common(d: Dialect) -> str:
    return f"SELECT url FROM pages WHERE {SELECTED} INTERSECT SELECT url FROM pages WHERE {SEEDS}"


def index_union(d: Dialect) -> str:
    """Indexed pages and newly crawled ones, which have fields that the old rows lack."""
    old = f"SELECT url, {C.url_title(d, 'url')} AS title, CAST(NULL AS BIGINT) AS words, true AS existing FROM pages WHERE NOT ({SEEDS})"
    new = f"SELECT p.url, p.title, p.words, false AS existing FROM ({page_rows(d)}) p JOIN (SELECT page_id FROM pages WHERE {SEEDS}) s ON s.page_id = p.page_id"
    return f"{old} UNION ALL {new}"


def chunk_union(d: Dialect) -> str:
    """The results of chunks put together again: each row stays as often as it is there."""
    parts = " UNION ALL ".join(f"SELECT source, doc_id FROM documents WHERE lang {c}" for c in ("= 'en'", "<> 'en'", "IS NULL"))
    return f"SELECT source, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM ({parts}) u GROUP BY source"


def progress(d: Dialect) -> str:
    """How far a source's run is at each document, in the order of ids."""
    return "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS completed, count(*) OVER (PARTITION BY source) AS total FROM documents"


def capped_pages(d: Dialect) -> str:
    """New pages of a site up to its limit, in which the pages that it has already count."""
    old = f"sum(CASE WHEN {SEEDS} THEN 0 ELSE 1 END) OVER (PARTITION BY host)"
    rows = f"SELECT page_id, host, {SEEDS} AS new, {old} AS existing, row_number() OVER (PARTITION BY host, {SEEDS} ORDER BY page_id) AS n FROM ({hosted(d)}) p"
    return f"SELECT r.page_id, r.host FROM ({rows}) r LEFT JOIN ({sites(d)}) c ON c.host = r.host WHERE r.new AND r.n <= coalesce(c.max_pages, 50) - r.existing"


def file_sites(d: Dialect) -> str:
    """Sites that are one text file, unless its URL is indexed: a row at depth 0 with the site's name as its path."""
    names = f"SELECT {C.bare_host(d, 'url')} AS host, count(*) AS n FROM pages GROUP BY {C.bare_host(d, 'url')}"
    files = f"SELECT concat('https://', host, '/llms.txt') AS url, concat('Site ', host) AS name FROM ({names}) n"
    return f"SELECT f.url, f.name, {C.url_title(d, 'f.url')} AS title, 0 AS depth, f.name AS path FROM ({files}) f WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = f.url)"


def contrast(d: Dialect) -> str:
    """Contrast of each page's colour (its id as #rrggbb) against white, by relative luminance."""
    part = lambda k: f"(({d.div('page_id * 9973 % 16777216', 256**k)} % 256) / 255e0)"
    light = " + ".join(f"{w}e0 * CASE WHEN {part(k)} <= 0.03928e0 THEN {part(k)} / 12.92e0 ELSE power(({part(k)} + 0.055e0) / 1.055e0, 2.4e0) END" for k, w in ((2, 0.2126), (1, 0.7152), (0, 0.0722)))
    return f"SELECT page_id, CAST(floor(1000 * 1.05e0 / ({light} + 0.05e0) + 0.5e0) AS DOUBLE) / 1000 AS contrast FROM pages"


def canonical(d: Dialect) -> str:
    keys = "|".join(TRACKING)
    bare = d.fold("url", [(rf"([?&])(?:{keys})=[^&#]*", "", r"\1"), (r"([?&])&+", "", r"\1"), (r"[?&]+(#|$)", "", r"\1")])
    return f"SELECT page_id, {bare} AS canonical_url FROM pages"


def union_except(d: Dialect) -> str:
    path = C.url_path(d, "url")
    return f"SELECT path, min(seed) AS origin FROM (SELECT DISTINCT {path} AS path, 0 AS seed FROM pages WHERE {SEEDS} UNION ALL SELECT DISTINCT {path}, 1 FROM pages) u GROUP BY path"


def new_paths(d: Dialect) -> str:
    path = C.url_path(d, "url")
    return f"SELECT {path} AS path FROM pages EXCEPT SELECT {path} FROM pages WHERE {SEEDS}"


def entry_points(d: Dialect) -> str:
    path = f"SELECT path, min(origin) AS origin FROM ({union_except(d)}) x GROUP BY path"
    n = d.size(d.filter(d.split("path", "/"), "p", "p <> ''"))
    return f"SELECT path, {n} AS depth, row_number() OVER (ORDER BY ordinal DESC) AS queue FROM (SELECT path, row_number() OVER (ORDER BY origin, path) AS ordinal FROM ({path}) y) z WHERE ordinal <= 50"


def ordered_pages(d: Dialect) -> str:
    crumbs = d.join(C.breadcrumbs(d, "url"), " / ")
    return f"""SELECT page_id, row_number() OVER (ORDER BY CASE WHEN ordinal IS NULL THEN 1 ELSE 0 END, ordinal, host, crumbs, page_id) AS position FROM (
        SELECT p.page_id, p.host, p.crumbs, c.ordinal FROM (SELECT page_id, {C.url_host(d, 'url')} AS host, {crumbs} AS crumbs FROM pages) p LEFT JOIN ({sites(d)}) c ON c.host = p.host) q"""


def page_tree(d: Dialect) -> str:
    first = f"coalesce({d.cut(C.url_parts(d, 'url'), 1, 1)}[{{}}], 'general')".format("0" if d.java else "1")
    if d.java:
        first = f"coalesce(try_element_at({C.url_parts(d, 'url')}, 1), 'general')"
    return f"SELECT host, category, count(*) AS pages, min(url) AS first_url FROM (SELECT {C.url_host(d, 'url')} AS host, {first} AS category, url FROM pages) p GROUP BY host, category"


def class_words(d: Dialect) -> str:
    names = d.extract_all("html", r"""class\s*=\s*["']([^"']*)["']""", 1, "i")
    word = f"SELECT {d.explode(d.words('c'), 'word')} FROM (SELECT {d.explode(names, 'c')} FROM pages) n"
    return f"SELECT word, count(*) AS n FROM ({word}) w GROUP BY word ORDER BY n DESC, word LIMIT 20"


def specific_title(d: Dialect) -> str:
    crumbs = d.map(d.filter(C.breadcrumbs(d, "url"), "c", "c NOT IN ('index', 'main', 'home', 'default') AND length(c) > 1"), "c", f"concat(upper({d.left('c', 1)}), {d.rest('c', 2)})")
    cut = lambda x: f"CASE WHEN length({x}) > 55 THEN concat({d.left(x, 52)}, '...') ELSE {x} END"
    contained = "(contains(lower(title), lower(context)) OR contains(lower(context), lower(title)))"
    full = f"CASE WHEN n > 0 AND NOT {contained} AND length(context) < 30 AND n <= 2 THEN concat(title, ' (', context, ')') ELSE title END"
    return f"SELECT page_id, {cut('t')} AS title FROM (SELECT page_id, {full} AS t FROM (SELECT page_id, title, {d.join('crumbs', ' / ')} AS context, {d.size('crumbs')} AS n FROM (SELECT page_id, {C.display_title(d, 'title')} AS title, {crumbs} AS crumbs FROM (SELECT page_id, url, {title_of(d)} AS title FROM pages) a) b) c) e"


def document_set(d: Dialect) -> str:
    """The text of one collection for each source: header, contents, numbered documents."""
    toc = d.joined("concat(CAST(n AS VARCHAR(20)), '. [Document ', CAST(doc_id AS VARCHAR(20)), '](doc:', CAST(doc_id AS VARCHAR(20)), ')')", "\n", "n")
    head = "concat('# ', CAST(n AS VARCHAR(20)), '. Document ', CAST(doc_id AS VARCHAR(20)), {nl}, {nl}, 'Document Number: ', CAST(n AS VARCHAR(20)), {nl}, 'Source: doc:', CAST(doc_id AS VARCHAR(20)), {nl}, 'Words: ', CAST(words AS VARCHAR(20)), {nl}, {nl}, text, {nl})".format(nl=d.lit("\n"))
    body = d.joined(head, "\n---\n\n", "n")
    top = f"concat('# Documentation Collection', {d.lit(chr(10) * 2)}, 'Total documents: ', CAST(count(*) AS VARCHAR(20)), {d.lit(chr(10))}, 'Total words: ', CAST(sum(words) AS VARCHAR(40)), {d.lit(chr(10) * 2)}, {d.lit('## Table of Contents' + chr(10) * 2 + '### Included Documents' + chr(10) * 2)}, {toc}, {d.lit(chr(10) * 2 + '---' + chr(10) * 2)}, {body})"
    return f"SELECT source, {top} AS content FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS n FROM ({scored(d)}) s WHERE score >= 0.2) r GROUP BY source"


def parsed_set(d: Dialect) -> str:
    """The inverse: sections of a collection, with title, source and words."""
    section = d.explode(d.cut(d.split("content", r"\n---\n"), 2, 1_000_000), "section")
    return f"""SELECT source, {d.extract('section', r'^\s*# \d+\. ([^\n]*)', 1)} AS title, {d.extract('section', r'\nSource: ([^\n]*)', 1)} AS url, CAST({d.extract('section', r'\nWords: (\d+)', 1)} AS BIGINT) AS words
        FROM (SELECT source, {section} FROM ({document_set(d)}) t) s WHERE {d.test('section', r'^\s*# \d+\. ')} AND {d.test('section', r'\nSource: ')}"""


def labels_join(d: Dialect) -> str:
    return f"SELECT l.quality, count(*) AS n, avg(s.score) AS mean_score FROM ({scored(d)}) s JOIN labels l ON l.doc_id = s.doc_id GROUP BY l.quality"


CATALOG = {
    # first slice and document statistics
    "quality_by_lang": lambda d: f"SELECT lang, count(*) AS documents, CAST(sum(CASE WHEN score >= 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS kept, avg(score) AS mean_score, CAST(sum(words) AS BIGINT) AS total_words FROM ({scored(d)}) s GROUP BY lang",
    "word_stats": lambda d: f"SELECT doc_id, n AS n_words, u AS unique_words, s AS sentences, CAST(length(text) AS BIGINT) AS chars FROM ({S.basis(d, 'SELECT doc_id, text FROM documents', 'text', hits=False)}) b",
    # scores
    "q1_readability": _scored_doc("readability", S.readability, hits=False), "q1_repetition": _scored_doc("repetition", S.repetition, hits=False), "q1_completeness": _per_doc("completeness", S.completeness),
    "q1_technical": _scored_doc("technical", S.technical), "q1_structure": _per_doc("structure", S.structure),
    "q1_overall": lambda d: f"SELECT doc_id, score, {S.level('score')} AS level FROM ({d.stage(S.basis(d, 'SELECT doc_id, text FROM documents', 'text'), {'score': S.overall(d, 'text')})}) s",
    "q1_assessment": assessed(None), "q1_technical_gate": assessed(0.3),
    "q2_length": _stripped("score", S.class_length), "q2_structure": _page("score", S.class_structure), "q2_readability": _stripped("score", S.class_readability),
    "q2_technical": _stripped("score", S.class_technical), "q2_noise": _stripped("score", S.class_noise),
    "q2_overall": class_overall(S.CLASS_WEIGHTS), "q2_factory": class_overall(S.FACTORY_WEIGHTS), "q2_recommendations": advice,
    "q3_client": lambda d: f"SELECT doc_id, score, {S.level('score', ('high', 'medium', 'low'), (0.7, 0.4))} AS level FROM ({d.stage(S.basis(d, 'SELECT doc_id, text FROM documents', 'text', hits=False), {'score': S.client_overall(d, 'text')})}) s",
    "q4_document_stats": lambda d: f"SELECT doc_id, {d.n_words('text')} AS words, CAST(length(text) AS BIGINT) AS chars, ({' OR '.join(d.test('text', p, 'i') for p in S.CLIENT_TECHNICAL)}) AS technical, {d.test('text', r'^#+\s+|^[-*+]\s+|^\d+\.\s+', 'm')} AS has_structure FROM documents",
    # filters
    "quality_filter": lambda d: f"SELECT doc_id, score FROM ({scored(d)}) s WHERE score >= 0.2",
    "annotated_filter": lambda d: f"SELECT doc_id, score, {S.level('score')} AS level FROM ({scored(d)}) s WHERE score >= 0.4",
    "high_quality_filter": lambda d: f"SELECT doc_id, score, {S.level('score')} AS level, words FROM ({scored(d)}) s WHERE score >= 0.7",
    "pass_or_null": class_gate(S.CLASS_WEIGHTS, 0.3), "pass_or_null_factory": class_gate(S.FACTORY_WEIGHTS, 0.4),
    "min_words": site_min_words, "site_filters": site_filters, "truthy_results": lambda d: f"SELECT doc_id FROM (SELECT doc_id, CASE WHEN score >= 0.4 THEN text END AS result FROM ({scored(d)}) s) r WHERE result IS NOT NULL AND result <> ''",
    "retries": retries,
    "soft_404": lambda d: f"SELECT page_id, {S.soft_404(d, 'title', 'content', 'words')} AS is_404 FROM ({page_rows(d)}) p",
    "valid_content": lambda d: f"SELECT doc_id, {S.validity(d, 'text', 'n')[0]} AS valid, {S.validity(d, 'text', 'n')[1]} AS score FROM ({d.stage('SELECT doc_id, text FROM documents', {'n': d.n_words('text')})}) b",
    "admissible_url": admissible,
    # cleaning
    "clean_mojibake": _per_doc("cleaned", C.mojibake), "clean_boilerplate": _per_doc("cleaned", C.boilerplate), "clean_video": _per_doc("cleaned", C.video), "clean_entities": _page("cleaned", C.entities),
    "clean_markdown": _per_doc("cleaned", C.markdown), "clean_markdown_client": _per_doc("cleaned", lambda d, x: C.markdown(d, x, True)), "clean_special": _per_doc("cleaned", C.special),
    "clean_whitespace": _per_doc("cleaned", C.whitespace), "clean_whitespace_flat": _page("cleaned", lambda d, x: C.whitespace(d, x, False)), "clean_server_chain": lambda d: f"SELECT doc_id, cleaned FROM ({C.server_query(d, 'SELECT doc_id, text FROM documents', 'text', 'cleaned')}) c",
    "strip_html": _page("cleaned", C.strip_html), "strip_tags": _page("cleaned", C.strip_tags), "filter_scripts": _page("cleaned", C.scripts), "filter_styles": _page("cleaned", C.styles),
    "filter_comments": _page("cleaned", C.comments), "filter_collapse": _page("cleaned", C.collapse), "filter_framework": _page("cleaned", C.framework), "content_filters": _page("cleaned", C.content_filters),
    "tidy_lines": _page("cleaned", C.tidy_lines), "code_cap": _per_doc("cleaned", lambda d, x: C.code_cap(d, x, 60)), "code_cap_pages": _page("cleaned", C.code_cap), "enhancer_filters": _page("cleaned", C.enhancer_filters),
    "isolate_code": _per_doc("cleaned", C.isolate_code), "spacing": _per_doc("cleaned", C.spacing), "enhanced": _page("cleaned", C.enhanced), "enhanced_lines": _page("cleaned", lambda d, x: C.enhanced(d, x, True)),
    "plain_text": _per_doc("cleaned", C.plain_text), "manual_text": _page("cleaned", C.manual_text), "clean_text_file": _per_doc("cleaned", C.text_file), "clean_client_chain": _page("cleaned", C.client_chain),
    "enhance_headings": _per_doc("cleaned", C.headings), "nav_noise": _per_doc("cleaned", C.navigation),
    # titles and URLs
    "url_title": _url("title", C.url_title), "url_host": _url("host", C.url_host), "url_path": _url("path", C.url_path), "url_depth": _url("depth", lambda d, u: d.size(C.url_parts(d, u))),
    "breadcrumbs": _url("crumbs", lambda d, u: d.join(C.breadcrumbs(d, u), " > ")), "canonical_url": canonical, "tidy_url": _url("tidy_url", lambda d, u: C.tidy_url(d, u, TRACKING)), "breadcrumb_path": _url("path", C.breadcrumb_path), "enhancer_url_title": _url("title", C.enhancer_url_title),
    "client_url_title": lambda d: f"SELECT page_id, title FROM ({C.client_url_title(d, 'SELECT page_id, url FROM pages', 'url', 'title')}) t", "page_slug": lambda d: f"SELECT page_id, concat('page-', {C.slug(d, 'host')}, '-', {C.slug(d, 'url')}) AS slug FROM ({hosted(d)}) p",
    "enhancer_title": lambda d: f"SELECT page_id, {C.enhancer_title(d, 't')} AS title FROM (SELECT page_id, {d.extract('html', r'<h1[^>]*>([^<]*)', 1, 'i')} AS t FROM pages) p",
    "plain_title": lambda d: f"SELECT doc_id, CASE WHEN length(t) < 100 AND t <> '' THEN t ELSE 'Glossary' END AS title FROM (SELECT doc_id, {C.plain_text(d, 'text')} AS t FROM documents) p",
    "page_record": page_record, "page_rows": page_rows, "estimates": estimates, "specific_title": specific_title,
    "clean_title": lambda d: f"SELECT page_id, {C.clean_title(d, 't')} AS title FROM (SELECT page_id, {title_of(d)} AS t FROM pages) p",
    "display_title": lambda d: f"SELECT page_id, {C.display_title(d, 't')} AS title FROM (SELECT page_id, {title_of(d)} AS t FROM pages) p",
    # aggregations and windows
    "site_report": site_report, "run_totals": run_totals, "score_buckets": buckets, "level_share": level_share, "structure_counts": structure_counts, "error_types": error_types,
    "rank_by_quality": ranked, "excluded_rank": excluded, "top_documents": lambda d: f"SELECT doc_id, score FROM ({scored(d)}) s ORDER BY score DESC, doc_id LIMIT 10",
    "first_errors": lambda d: f"SELECT source, doc_id, total - 10 AS more FROM (SELECT *, count(*) OVER (PARTITION BY source) AS total FROM ({excluded(d)}) e) x WHERE position <= 10", "class_words": class_words, "page_tree": page_tree, "tri_state": tri_state, "single_site": single_site, "selection_sum": selection_sum,
    # joins and sets
    "host_config_join": host_config, "url_options": url_options, "site_results": site_results, "pages_by_site": pages_by_site, "site_order": site_order, "selected_order": selected_order,
    "existing_urls": existing_urls, "selection_edit": selection_edit, "selection_common": selection_common, "index_union": index_union, "chunk_union": chunk_union, "progress": progress,
    "capped_pages": capped_pages, "file_sites": file_sites, "contrast": contrast, "labels_join": labels_join, "selected_semi": lambda d: f"SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM ({_chosen(d)}) c WHERE c.url = p.url)",
    "existing_anti": lambda d: f"SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM ({_chosen(d)}) c WHERE c.url = p.url)",
    "selection_lookup": lambda d: f"SELECT c.url, min(p.page_id) AS page_id FROM ({_chosen(d)}) c JOIN pages p ON p.url = c.url GROUP BY c.url",
    "seed_union": union_except, "new_paths": new_paths, "entry_points": entry_points, "page_order": ordered_pages, "page_links": links, "link_edges": edges,
    # collections
    "document_set": document_set, "parsed_set": parsed_set,
}
