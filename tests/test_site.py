"""A whole run over a small site, its parts, models and the web source."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagewright.functions import lists as L
from pagewright.functions import providers as V
from pagewright.functions import scores as S
from pagewright.operators import pages as P
from pagewright.operators import quality as Q
from pagewright.operators import questions as G
from pagewright.operators import retrieve as R
from pagewright.plans import site
from pagewright.sources import io, web

BODY = "The Library Center is located near the main hall and it is open for every student of the campus. Students can use the quiet rooms when they need time for study. The tutoring service is offered by the academic office each week. Counseling support is available at the wellness center for all students who ask for help. "


def page(title, links, body=BODY):
    return f"<html><head><title>{title}</title></head><body><article><h1>{title}</h1><p>{body}</p>{''.join(f'<a href={chr(34)}{x}{chr(34)}>x</a>' for x in links)}</article></body></html>"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    rows = [("http://a.edu", page("Home", ["/about", "/library", "/login"])), ("http://a.edu/about", page("About", ["/library"], BODY.replace("Library", "Writing"))), ("http://a.edu/library", page("Library", [], BODY + BODY)), ("http://a.edu/login", page("Login", [])), ("http://b.edu/other", page("Other", []))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")


def test_whole_run_and_resume(spark, pages, tmp_path):
    config = io.Config("http://a.edu", str(tmp_path), max_pages=10, max_pairs=4)
    models = V.Providers(answer=V.extracted_answer, cross=V.overlap_scorer)
    pairs = site.run(spark, pages, config, models).collect()
    at = site.paths(config)
    found = {r.url for r in spark.read.parquet(at["crawl"] + "-pages").collect()}
    assert found == {"http://a.edu", "http://a.edu/about", "http://a.edu/library"}
    kb = io.load_kb(spark, at["kb"])
    assert kb["documents"].count() == 3 and kb["chunks"].where("size(entities) > 0").count() > 0
    assert 3 <= len(pairs) <= 12 and all(r.question.endswith("?") and 0 <= r.overall <= 1 and r.answer for r in pairs)
    assert len({r.source_url for r in pairs}) > 1
    for name in ("qa_pairs.json", "qa_pairs.csv", "qa_pairs.md"):
        assert spark.read.text(f"{at['output']}/{name}").count() > 0
    assert io.load_pairs(spark, f"{at['output']}/qa_pairs.json").count() == len(pairs)
    assert spark.read.json(f"{at['metrics']}/averages").first().total_pairs == len(pairs)
    # a second run finds all stages done: no page is needed any more
    again = site.run(spark, pages.limit(0), config, models)
    assert sorted(r.pos for r in again.collect()) == sorted(r.pos for r in pairs)
    assert io.load_progress(spark, at["progress"], "http://a.edu") == dict.fromkeys(L.STAGES, True)


def stored(spark, kb, path):
    io.save_kb(kb["documents"], kb["chunks"], kb["postings"], path)
    return io.load_kb(spark, path)


def test_run_without_models_and_with_all(spark, pages, tmp_path):
    content = pages.where("url like 'http://a%'").select("url", P.main_text(F.col("html")).alias("text"))
    kb = stored(spark, site.process_documents(content), f"{tmp_path}/a")
    q = site.generate_questions(kb, io.Config(max_pairs=2)).limit(4).checkpoint()
    plain = site.answer_questions(q, kb["chunks"]).collect()
    assert {r.answer for r in plain} == {L.NO_MODEL}
    assert {r.answer for r in site.answer_questions(q, kb["chunks"].limit(0)).collect()} == {L.DECLINED}
    models = V.Providers(embed=V.hashed_embedding, cross=V.overlap_scorer, judge=lambda a, b: F.lit(0.9), check=lambda a, b: F.lit(0.8), ask=lambda p: F.concat(F.lit("what of "), F.substring_index(F.substring_index(p, "Content:", 1), " ", 6)), answer=V.extracted_answer)
    kb = stored(spark, site.process_documents(content, models), f"{tmp_path}/b")
    q = site.generate_questions(kb, io.Config(max_pairs=2), models).checkpoint()
    got = site.answer_questions(q, kb["chunks"], models).collect()
    assert got and all(r.n_context > 0 and r.factuality >= 0.5 for r in got) and any(r.quality_score == 0.8 for r in q.collect())


def test_models_load_once_and_fall_back(spark):
    def broken():
        raise OSError("too large")

    double = V.batch_model([broken, lambda: lambda x: np.asarray(x) * 2.0], DoubleType(), tries=2, wait=0.0)
    assert [r[0] for r in spark.range(3).select(double(F.col("id").cast("double"))).collect()] == [0.0, 2.0, 4.0]
    with pytest.raises(RuntimeError):
        V.first_that_loads([broken], tries=2, wait=0.0)


def test_probabilities(spark):
    r = spark.range(1).select(S.softmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(1000.0))).alias("s"), S.sigmoid(F.lit(-800.0)).alias("a"), S.sigmoid(F.lit(0.0)).alias("b")).first()
    assert r.s[2] == pytest.approx(1.0) and sum(r.s) == pytest.approx(1.0) and (r.a, r.b) == (pytest.approx(0.0), 0.5)


def test_crawl_saves_on_the_way(spark, pages):
    saved = []
    start = spark.createDataFrame([("http://a.edu",)], "url string")
    got = P.crawl(pages, start, "a.edu", max_pages=3, wave=1, save=lambda found, seen: saved.append((found.count(), seen.count())), save_each=1)
    assert got.count() == 3 and [n for n, _ in saved] == [1, 2, 3]


def test_seeds(spark):
    got = [r.seed for r in P.seeds(spark.createDataFrame([("https://www.a.edu/x",)], "url string")).orderBy("pos").collect()]
    assert got[0] == "https://www.a.edu/x" and got[-1] == "https://a.edu/x" and not any(u.startswith("http://") for u in got)
    got = [r.seed for r in P.seeds(spark.createDataFrame([("http://a.edu",)], "url string")).orderBy("pos").collect()]
    assert got[-2:] == ["http://www.a.edu", "https://a.edu"] and len(got) == len(set(got)) and "http://a.edu/home" in got


def test_checkpoint_is_validated(spark, tmp_path):
    good = "word " * 30
    content = spark.createDataFrame([("u", good, 0.5), ("v", "short", 0.9)], "url string, text string, quality double")
    io.save_crawl(content, spark.createDataFrame([("u", "visited")], "url string, status string"), f"{tmp_path}/a")
    io.validate_crawl(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert [r.url for r in io.load_crawl(spark, f"{tmp_path}/b")[0].collect()] == ["u"]


def blocks_brute(blocks, budget):
    """The rule, said sequentially."""
    if sum(len(t) for *_, t in blocks) <= budget:
        return [(p, t) for p, _, _, t in blocks]
    chosen, rest, used = [], list(blocks), 0
    for url in dict.fromkeys(b[1] for b in blocks):
        best = max((b for b in rest if b[1] == url), key=lambda b: b[2])
        if used + len(best[3]) <= budget:
            chosen.append(best)
            rest.remove(best)
            used += len(best[3])
    have = {b[1] for b in chosen}
    rest.sort(key=lambda b: -b[2])
    rest.sort(key=lambda b: -(b[2] * (0.95 if b[1] in have else 1.0)))
    out = [(b[0], b[3]) for b in chosen]
    for b in rest:
        left = budget - used
        if len(b[3]) <= left:
            out.append((b[0], b[3]))
            used += len(b[3])
            continue
        cut = b[3][:left].rsplit(".", 1)[0] + "."
        if left > 200 and len(cut) > 100:
            out.append((b[0], cut))
        break
    return out


def test_context_blocks_against_the_rule(spark):
    rng, rows = np.random.default_rng(3), []
    for g in range(40):
        for p in range(int(rng.integers(1, 9))):
            rows.append((g, p, f"u{rng.integers(3)}", round(float(rng.random()), 3), ("s" * int(rng.integers(5, 60)) + ". ") * int(rng.integers(1, 14))))
    df = spark.createDataFrame(rows, "g long, pos long, url string, score double, text string")
    got = {}
    for r in Q.context_blocks(df, "g", "url").orderBy("g", "pick").collect():
        got.setdefault(r.g, []).append((r.pos, r.text))
    for g in range(40):
        assert got[g] == blocks_brute([r[1:] for r in rows if r[0] == g], 1500), g
    both = Q.assembled_context(Q.context_blocks(df, "g", "url"), "g", "url")
    assert both.count() == 40


def test_answer_choice(spark):
    cols = spark.createDataFrame([(["I don't have enough information to answer this question.", "short", "a much longer answer that says more"], "x")], "c array<string>, t string")
    assert cols.select(G.substantive_answer(F.col("c"))).first()[0] == "a much longer answer that says more"
    marks = spark.createDataFrame([(n,) for n in (10, 20, 49, 50, 200, 400, 2000)], "n int").select(G.length_score(F.repeat(F.lit("x"), F.col("n"))).alias("s"))
    assert [round(r.s, 4) for r in marks.collect()] == [0.5, 0.5, 0.9833, 1.0, 1.0, 0.75, 0.5]


def test_fallback_only_for_questions_with_few_hits(spark):
    hits = spark.createDataFrame([(1, i, 1.0 * i, 5 - i) for i in range(1, 5)] + [(2, 1, 3.0, 1)], "q long, d long, score double, rank long")
    q = spark.createDataFrame([(1,), (2,), (3,)], "q long")
    asked = []

    def search(few):
        asked.extend(r.q for r in few.collect())
        return few.select("q", F.explode(F.array(F.lit(1), F.lit(9))).alias("d")).select("q", F.col("d").cast("long").alias("d"), F.lit(0.5).alias("score"), F.lit(1).alias("rank"))

    got = R.with_fallback(hits, q, "q", "d", search).collect()
    assert sorted(asked) == [2, 3] and sorted((r.q, r.d) for r in got if r.q > 1) == [(2, 1), (2, 9), (3, 1), (3, 9)]


def test_web_source(spark):
    seen = []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers["User-Agent"]))
            n = sum(p == self.path for p, _ in seen)
            code = {"/gone": 404, "/late": 503 if n < 2 else 200}.get(self.path, 200)
            self.send_response(code)
            self.send_header("Content-Type", "application/pdf" if self.path == "/pdf" else "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(f"<p>é {self.path}</p>".encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        todo = spark.createDataFrame([(base + p,) for p in ("/a", "/gone", "/late", "/pdf")], "url string")
        got = {r.url: r.html for r in web.fetched(spark, todo, delay=0, wait=0.01).collect()}
    finally:
        server.shutdown()
    assert got == {base + "/a": "<p>é /a</p>", base + "/late": "<p>é /late</p>"}
    tried = [p for p, _ in seen]
    assert tried.count("/late") >= 2 and {a for _, a in seen} == {web.AGENT}
    assert all(0.7 <= web.jitter(u) <= 3 for u in ("a", "b/c", "d" * 50))
