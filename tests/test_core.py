"""Hand-derived values of the core engine's functions."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import scores as S
from pagewright.functions import text as T
from pagewright.operators import chunks as C
from pagewright.operators import pages as P
from pagewright.operators import quality as Q
from pagewright.operators import questions as G
from pagewright.plans import oracles, registry
from pagewright.sources import io


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], names).select(expr(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [("a" * 49, False), ("abcd " * 10, True), ("abcdefg " * 8 + "x", False)],
)
def test_valid_content(spark, text, want):
    assert one(spark, T.is_valid_content, t=text) is want


def test_url_priority(spark):
    assert round(one(spark, S.url_priority, u="https://a.edu/about"), 6) == 1.0
    assert round(one(spark, S.url_priority, u="https://a.edu/news/page/2?x=1"), 6) == 0.4


def test_topic_types(spark):
    for topic, want in (("student center", "SERVICE"), ("health", "WELLNESS"), ("library", "LOCATION"), ("xyz", "GENERAL"), ("paid leave", "SUPPORT")):
        assert one(spark, S.topic_type, t=topic) == want


def test_topic_type_reads_whole_texts(spark, tmp_path):
    rows = [(1, "x " * 50 + "zut"), (2, "x " * 50), (3, "thing " + "x " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.topic_type for r in registry.QUERIES["topic_type"](spark, str(tmp_path)).collect()} == {1: "LOCATION", 2: "GENERAL", 3: "SERVICE"}


def test_hybrid_boost_counts_all_terms(spark, tmp_path):
    spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    asked = "aa bb cc dd ee ff gg hh ninth tenth Ninth"
    docs = [(50, asked, "s"), (1, "aa", "s"), (2, "NINTH tenth", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["hybrid_topk_boost"](spark, str(tmp_path)).where("query_id = 50").collect()
    assert {r.vec_id: (r.score, r.rank) for r in got} == {2: (1.1, 1), 1: (1.05, 2)}


def test_sentences_and_windows(spark):
    assert one(spark, T.sentences, t="Dr. Smith left. He ran") == ["Dr. Smith left.", "He ran."]
    for n, want in ((2, 0), (3, 1), (10, 1), (11, 2)):
        text = " ".join(f"S{i} x." for i in range(n))
        assert len(one(spark, lambda c: T.windows_of(T.sentences(c)), t=text)) == want


def test_packing_keeps_overlap(spark):
    a, b, c = "a" * 600, "b" * 600, "c" * 100
    got = spark.createDataFrame([([a, b, c],)], "p array<string>").select(C.pack(F.col("p")).alias("x")).first().x
    assert got == [a, f"{a} {b}", f"{b} {c}"]


def test_answers(spark):
    assert one(spark, T.fix_ending, t="Done. More") == "Done. More."
    assert one(spark, T.clean_artifacts, t="We learn.") == "We lea."
    assert one(spark, T.signature, t="The cat sat on the mat") == "cat mat sat"
    assert one(spark, T.clean_question, t="Q: what is is x") == "What is is x?"
    assert one(spark, T.is_disclaimer, t="I don't have enough information to answer this question.") is True


def test_scores(spark):
    assert one(spark, S.questions_similar, a="what is a b c", b="what is a b") is True
    assert round(one(spark, S.factuality, a="a b c", b="a b d"), 6) == 0.6
    assert one(spark, S.factuality, a="one", b="some context") == 0.0
    short = one(spark, lambda q, a, c: S.evaluation(q, a, c, F.lit(2)), q="what", a="x" * 14, c="y z")
    assert tuple(short) == (0.0,) * 5


def test_urls(spark):
    for href, want in (("/a", "http://h/a"), ("b?q#f", "http://h/d/b"), ("../c", "http://h/c"), ("https://o/x#y", "https://o/x")):
        assert one(spark, T.join_url, b="http://h/d/e", h=href) == want


def test_main_text_forms_agree(spark):
    html = "<html><head><title>T &amp; x</title></head><body><nav>no</nav><article><h1>A</h1><p>b <b>c</b></p><script>var t='</p>'</script></article></body></html>"
    assert one(spark, P.main_text, h=html) == P.parse_main_text(html) == "TITLE: T & x\n\nA\n\nb\n\nc"


def test_robots(spark):
    lines = ["User-agent: *", "Disallow: /private", "Crawl-delay: 2", "User-agent: other", "Disallow: /x"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    assert [tuple(r) for r in P.robots_rules(df).collect()] == [("/private", 2.0)]


def test_greedy_repeats(spark):
    rows = [(1, i, t, q) for i, (t, q) in enumerate([("what is a b c", 0.5), ("what is a b", 0.9), ("who knows the other thing here", 0.1)])]
    df = spark.createDataFrame(rows, "g long, pos long, text string, quality_score double")
    assert sorted(r.kept_pos for r in G.without_repeats(df, "g").collect()) == [1, 2]


def test_near_duplicate_texts_against_brute_force(spark):
    head = "the same first forty characters of a text "
    many = [f"w{i}" for i in range(60)]
    docs = [(0, head + " ".join(many)), (1, head + " ".join(many)), (2, head + " ".join(many[:-3] + ["x", "y", "z"])), (3, head + " ".join(many[::-1])), (4, head + "short"), (5, head + "short one"), (6, "a" * 120), (7, "a" * 120), (8, "tiny"), (9, "tiny"), (10, ""), (11, None), (12, head + "short" + " ".join(many))]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    def like(a, b):
        if a is None or b is None or a[:40] != b[:40]:
            return False
        if min(len(a), len(b)) < 100:
            return a in b or b in a
        x, y = grams(a), grams(b)
        return bool(x | y) and len(x & y) / len(x | y) > 0.8

    least = {t: i for i, t in reversed(docs)}
    want = sorted((least[t], i) for i, t in docs if t is not None and least[t] != i and like(t, t))
    reps = [(i, t) for i, t in docs if t is not None and least[t] == i]
    want = sorted(want + [(i, j) for i, a in reps for j, b in reps if i < j and like(a, b)])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in Q.near_duplicate_texts(df, "doc_id", "text").collect()) == want and len(want) > 4
    assert Q.near_duplicate_texts(df.limit(0), "doc_id", "text").count() == 0


def test_near_dup_text_pairs_compares_texts_with_any_head(spark, tmp_path):
    many = [f"word{i}" for i in range(60)]
    body = " ".join(many)
    texts = [body, "another title " + body, "edited " + " ".join(many[1:]), "word5 word6", "ord59", "ORD59", "", "  ", "x" * 130, "y" + "x" * 130, body[::-1], "x" * 20, " ".join(many[20:]), "tiny", None, body, "d6 w"]

    def like(a, b):
        if min(len(a), len(b)) < 100:
            return a in b or b in a
        x, y = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (a.split(), b.split()))
        return bool(x and y) and len(x & y) / len(x | y) > 0.8

    reps = [(i, t) for i, t in enumerate(texts) if t is not None and texts.index(t) == i]
    want = [(i, j) for i, a in reps for j, b in reps if i < j and like(a, b)] + [(0, 15)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in registry.QUERIES["near_dup_text_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {(0, 1), (0, 2), (0, 3), (0, 4)} <= set(got)


def test_csv_quotes(spark):
    df = spark.createDataFrame([('a "b"', "x\ny", "u", "t", "T", (0.1, 0.2, 0.3, 0.4, 0.5))], io.PAIR)
    assert io.csv_lines(df).first().value == '"a ""b""","x\ny","u","t","T",0.5'


def test_progress(spark, tmp_path):
    io.save_progress(spark, str(tmp_path / "p"), "http://a", {"crawling": True})
    assert io.load_progress(spark, str(tmp_path / "p"), "http://a")["crawling"] is True
    assert io.load_progress(spark, str(tmp_path / "p"), "http://b") is None
    assert io.load_progress(spark, str(tmp_path / "none"), "http://b") is None


def test_oracles_have_queries():
    assert set(oracles.ORACLES) <= set(registry.QUERIES)
