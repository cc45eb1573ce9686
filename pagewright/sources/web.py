"""Pages over HTTP as a Spark data source: one partition a host, asked politely.

``spark.dataSource.register(PageSource)``, then
``spark.read.format("web_pages").option("urls", "\\n".join(...)).load()`` gives
(url, status, content_type, html, error). Options: ``delay`` seconds between two
requests to a host, ``tries``, ``wait`` before the second try, ``timeout``. One
honest user agent; nothing is done to look like a browser."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AGENT = "pagewright (page analytics; respects robots.txt)"
# Statuses for which another try is of no use, and types of pages.
FINAL = (403, 404, 405, 410)
PAGE_TYPES = ("text/html", "application/xhtml+xml")


def politely(fetch: Callable[[str], tuple], url: str, tries: int, wait: float) -> tuple:
    """(status, type, body, error), tried again with growing waits unless the answer is final."""
    for n in range(tries):
        try:
            return (*fetch(url), None)
        except urllib.error.HTTPError as e:
            last = (e.code, e.headers.get_content_type() if e.headers else None, None, str(e))
            if e.code in FINAL:
                break
        except (OSError, ValueError) as e:
            last = (None, None, None, str(e))
        if n + 1 < tries:
            time.sleep(wait * 2**n)
    return last


def jitter(url: str) -> float:
    """A factor of the delay between 0.7 and 3, by the URL, so that reruns agree."""
    h = sum(url.encode()) % 100
    return 0.7 + 0.3 * (h % 10) / 10 if h < 30 else 1.0 + 0.5 * (h % 10) / 10 if h < 70 else 1.5 + 1.5 * (h % 10) / 10


class _Host(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.delay, self.wait, self.timeout = (float(options.get(k, d)) for k, d in (("delay", 2.0), ("wait", 1.0), ("timeout", 20.0)))
        self.tries = int(options.get("tries", 3))

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for u in dict.fromkeys(self.urls):
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        return [_Host(us) for us in hosts.values()] or [_Host([])]

    def read(self, partition) -> Iterator[tuple]:
        def fetch(url):
            request = urllib.request.Request(url, headers={"User-Agent": AGENT})
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return r.status, r.headers.get_content_type(), r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

        for i, url in enumerate(partition.urls):
            if i:
                time.sleep(self.delay * jitter(url))
            yield (url, *politely(fetch, url, self.tries, self.wait))


class PageSource(DataSource):
    @classmethod
    def name(cls):
        return "web_pages"

    def schema(self):
        return "url string, status int, content_type string, html string, error string"

    def reader(self, schema):
        return _Reader(self.options)


def is_page(status: Column, content_type: Column) -> Column:
    """Whether an answer is a page: status 200 and a type of pages."""
    return F.coalesce((status == 200) & content_type.isin(*PAGE_TYPES), F.lit(False))


def fetched(spark: SparkSession, todo: DataFrame, **options) -> DataFrame:
    """(url, html) of a crawl wave's URLs (a bounded number), for ``crawl(fetch=...)``."""
    spark.dataSource.register(PageSource)
    urls = "\n".join(r.url for r in todo.select("url").toLocalIterator())
    got = spark.read.format("web_pages").options(urls=urls, **{k: str(v) for k, v in options.items()}).load()
    return got.where(is_page(F.col("status"), F.col("content_type"))).select("url", "html")
