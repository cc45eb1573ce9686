"""Pages: main text, links, validity, frontier, robots rules, seeds, crawl waves."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import lists as L
from ..functions import scores as S
from ..functions import text as T
from ..sources.io import written

#: Tags whose content isn't text of the page.
DROPPED = ["script", "style", "noscript", "svg", "iframe", "form", "nav", "footer"]


def decode_entities(c: Column) -> Column:
    for name, ch in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def main_text(html: Column) -> Column:
    """Title and main text of well-behaved pages by expressions only: the
    article, or else the body, its text nodes parted by blank lines."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in DROPPED:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    title = T.strip(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    article, body = (F.regexp_extract(t, rf"(?is)<{k}\b[^>]*>(.*)</{k}>", 1) for k in ("article", "body"))
    nodes = F.split(F.regexp_replace(F.when(article != "", article).otherwise(body), "<[^>]+>", "\u0001"), "\u0001")
    nodes = F.filter(F.transform(nodes, lambda x: T.strip(decode_entities(x))), lambda x: x != "")
    text = F.regexp_replace(F.array_join(nodes, "\n\n"), r"\n{3,}", "\n\n")
    return F.concat(F.when(title != "", F.concat(F.lit("TITLE: "), title, F.lit("\n\n"))).otherwise(""), text)


#: What may hold a page's main text, best first: (tag, attribute, value).
SELECTORS = [("main", None, None), ("article", None, None), ("*", "id", "content"), ("*", "class", "content"), ("*", "id", "main-content"), ("*", "class", "main-content"), ("*", "class", "page-content"), ("*", "class", "container"), ("div", "class", "entry-content"), ("*", "class", "article"), ("section", None, None), ("body", None, None)]


class _Page(HTMLParser):
    """Text nodes of the best selected element, by one walk over the page."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[int]]] = []
        self.nodes: dict[int, list[str]] = {}
        self.used: set[int] = set()
        self.dropped = 0
        self.title, self.in_title = "", False

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        have, opened = dict(attrs), []
        for i, (name, key, value) in enumerate(SELECTORS):
            if i not in self.used and name in ("*", tag) and (key is None or value in (have.get(key) or "").split()):
                self.used.add(i)  # the first hit of each selector counts
                self.nodes[i] = []
                opened.append(i)
        self.stack.append((tag, opened))
        self.dropped += tag in DROPPED
        self.in_title = tag == "title"

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, _ = self.stack.pop()
            self.dropped -= t in DROPPED
            if t == tag:
                break
        self.in_title = False

    def handle_data(self, data):
        if self.in_title and not self.title:
            self.title = data.strip()
        if not self.dropped and data.strip():
            for _, opened in self.stack:
                for i in opened:
                    self.nodes[i].append(data.strip())


def parse_main_text(html: str | None) -> str:
    p = _Page()
    p.feed(html or "")
    p.close()
    best = next((p.nodes[i] for i in range(len(SELECTORS)) if i in p.nodes), [])
    return (f"TITLE: {p.title}\n\n" if p.title else "") + re.sub(r"\n{3,}", "\n\n", "\n\n".join(best))


@F.pandas_udf(StringType())
def main_text_any(html: pd.Series) -> pd.Series:
    """``main_text`` for any page, by a real parser (Arrow batches)."""
    return html.map(parse_main_text)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, dst_url): distinct absolute links in order of appearance."""
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))
    good = F.filter(hrefs, lambda h: (h != "") & ~h.rlike("^(javascript:|#|mailto:|tel:)"))
    joined = F.array_distinct(F.transform(good, lambda h: T.join_url(F.col("url"), decode_entities(h))))
    return pages.select("page_id", F.posexplode(joined).alias("pos", "dst_url"))


def same_site(host: Column, base: str) -> Column:
    return (host == base) | F.endswith(host, F.lit("." + base)) | F.endswith(F.lit(base), F.concat(F.lit("."), host))


def is_valid_url(url: Column, base_domain: str, rules: list[str] = ()) -> Column:
    """http(s) on the site, no blocked ending or path, no rule of robots.txt."""
    path = F.lower(T.url_path(url))
    ok = T.url_scheme(url).isin("http", "https") & (T.url_host(url) != "") & same_site(T.url_host(url), base_domain)
    ok = ok & ~path.rlike(rf"\.({L.BLOCKED_EXTENSIONS})$") & ~path.rlike(rf"/({L.BLOCKED_PATHS})")
    for rule in rules:
        ok = ok & ~F.startswith(path, F.lit(rule))
    return ok


def robots_anti_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages whose path starts with no rule. Rules of one site's file: a handful of rows."""
    path = F.lower(T.url_path(F.col("url")))
    return pages.join(rules, F.startswith(path, F.col("prefix")), "left_anti")


def robots_rules(lines: DataFrame) -> DataFrame:
    """(prefix, crawl_delay) from (line_no, line): Disallow lines of agents that
    mean us; the largest delay counts. One file, so one window over its lines."""
    name = F.lower(T.strip(F.split_part("line", F.lit(":"), F.lit(1))))
    value = T.strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    w = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    told = lines.select("line_no", name.alias("name"), value.alias("value"))
    told = told.withColumn("agent", F.last(F.when(F.col("name") == "user-agent", F.lower("value")), True).over(w))
    ours = told.where(F.col("agent").isin("*", "bot", ""))
    delay = ours.where("name = 'crawl-delay'").agg(F.max(F.expr("try_cast(value AS double)")).alias("crawl_delay"))
    return ours.where("name = 'disallow' AND value <> ''").select(F.col("value").alias("prefix")).distinct().crossJoin(F.broadcast(delay))


def seeds(sites: DataFrame, url: str = "url", priority_paths: list[str] = L.PRIORITY_PATHS) -> DataFrame:
    """(url, pos, seed): where a crawl of each site begins, without repeats: its
    URL, the priority and common paths of its host, the host with or without
    "www.", and https for a site that came by http."""
    u = F.col(url)
    scheme, host, path = T.url_scheme(u), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), T.url_path(u)
    root = F.concat(scheme, F.lit("://"), host)
    other = F.when(F.startswith(host, F.lit("www.")), F.substr(host, F.lit(5))).otherwise(F.concat(F.lit("www."), host))
    paths = [F.concat(root, F.lit(p)) for p in [*priority_paths, *L.SEED_PATHS]]
    every = F.array_compact(F.array(u, *paths, F.concat(scheme, F.lit("://"), other, path), F.when(scheme == "http", F.concat(F.lit("https://"), host, path))))
    return sites.select(u.alias("url"), F.posexplode(F.array_distinct(every)).alias("pos", "seed"))


def prioritized(urls: DataFrame) -> DataFrame:
    """URLs with their priority, best first, ties by position."""
    return urls.withColumn("priority", S.url_priority(F.col("url"))).orderBy(F.desc("priority"), "pos")


def frontier(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct candidate URLs that aren't among the seen ones (left-anti hash join)."""
    return candidates.select("url").distinct().join(seen.select("url"), "url", "left_anti")


def crawl(pages: DataFrame, start: DataFrame, base_domain: str, max_pages: int = 30, wave: int = 10, fetch: Callable[[DataFrame], DataFrame] | None = None, save: Callable[[DataFrame, DataFrame], None] | None = None, save_each: int = 5) -> DataFrame:
    """Crawl by waves over a page source until ``max_pages`` or nothing is left.

    A wave takes the best URLs of the frontier, fetches them (a join with
    ``pages`` unless ``fetch`` is given) and adds their valid links. The wave
    loop runs on the driver; rows don't go there. Each wave is a written table. ``save``
    gets what was found and seen whenever ``save_each`` more pages are there."""
    fetch = fetch or (lambda todo: todo.join(pages, "url"))

    open_, seen = written(start.select("url").distinct()), None
    got, saved, left = None, 0, 3 * max_pages  # so many URLs are tried at most
    while left > 0:
        todo = written(prioritized(open_.withColumn("pos", F.col("url"))).limit(min(wave, left)).select("url"))
        n = todo.count()
        if not n:
            break
        left -= n
        seen = todo if seen is None else written(seen.union(todo))
        found = written(fetch(todo))
        got = found if got is None else got.union(found)
        n = got.count()
        if save and n >= saved + save_each:
            save(got, seen)
            saved = n
        if n >= max_pages:
            break
        out = links(found.withColumn("page_id", F.lit(0))).select(F.col("dst_url").alias("url")).where(is_valid_url(F.col("url"), base_domain))
        open_ = written(frontier(open_.union(out), seen))
    got = got if got is not None else pages.limit(0)
    told = got.withColumn("text", main_text(F.col("html"))).withColumn("quality", S.page_quality(F.col("text"), F.col("url")))
    return told.where(T.is_valid_content(F.col("text"))).orderBy(F.desc("quality"), "url").limit(max_pages)
