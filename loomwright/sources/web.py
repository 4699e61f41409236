"""Pages over HTTP as a Spark data source, for crawls whose pages are not in a table yet.

    spark.dataSource.register(PageSource)
    spark.read.format("loomwright_pages").option("urls", path_of_a_text_file).load()

Each partition fetches its URLs one after the other through its own token bucket, with a time limit
and retries. A failure is a row with an error, never a failed job.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomwright.operators.batch import TokenBucket, waits, with_retry

AGENT, ACCEPT = "Mozilla/5.0 (compatible; loomwright/1.0)", "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"
SCHEMA = "url string, status int, content_type string, body string, is_plain_text boolean, error string"


def fetch(url: str, timeout: float = 15.0) -> tuple[int, str, str]:
    """(status, content type, body); raises on a status of 400 or more."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept": ACCEPT}), timeout=timeout) as r:
            return r.status, r.headers.get("Content-Type", ""), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}: {e.reason}") from None


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        n = int(self.options.get("partitions", 4))
        with open(self.options["urls"]) as f:  # the driver's list of addresses
            urls = [u for line in f if (u := line.strip())]
        return [_Part(urls[k::n]) for k in range(n) if urls[k::n]]

    def read(self, part):
        o = self.options
        bucket = TokenBucket(float(o.get("rate", 2)), int(o.get("burst", 5)))
        delays = waits(int(o.get("retries", 3)), int(o.get("delay", 1000)))

        def get(url):
            bucket.take()
            return fetch(url, float(o.get("timeout", 15)))

        for url in part.urls:
            try:
                (status, kind, body), _ = with_retry(lambda url=url: get(url), delays)
                yield url, status, kind, body, "text/plain" in kind or url.endswith(".txt"), None
            except Exception as e:
                yield url, None, None, None, False, str(e)


class PageSource(DataSource):
    @classmethod
    def name(cls):
        return "loomwright_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))
