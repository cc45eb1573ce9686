"""What must not grow faster than the input."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import chunks as C
from pagewright.operators import quality as Q
from pagewright.operators import questions as G
from pagewright.operators import retrieve as R
from pagewright.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_phrases_shuffles_nothing(spark):
    text = "Red apples fall. Red apples rot! Green pears hang"
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, " " * 30), (None, text)], "doc_id long, text string")
    out = C.key_phrases(df, "doc_id", F.col("text"), 3)
    assert "Exchange" not in plan(out)
    # "red" is second and too short to be told
    assert [(r.doc_id, r.phrase, r.score, r.rank) for r in out.collect()] == [(1, "apples", 0.698996, 1), (1, "red apples", 0.698996, 3)]


def test_term_search_moves_no_postings(spark, monkeypatch):
    monkeypatch.setattr(R, "QUESTION_BLOCK", 2)  # blocks of questions
    asked = [(1, "the cat sat the end", "s"), (2, "at  a é\tx", "t"), (3, "", "s"), (4, None, "s"), (5, "zz on the cat", None), (6, "n the c", "u")]
    docs = [(1, "The cats  sat on the end", "s"), (2, "bat\tat a é x", "t"), (3, "", "t"), (4, None, "s"), (5, "on the\ncat sat the", None), (6, "\0the cat sat on the cat\0", "s"), (7, "On the cat sat the end", "u")]
    q = spark.createDataFrame(asked, "q long, text string, own string")
    d = spark.createDataFrame(docs, "d long, body string, source string")
    want, share = [], []
    for i, text, own in asked:
        said = (text or "").split()
        ts = list(dict.fromkeys(said))
        runs = {" ".join(ts[a : a + m]) for m in (2, 3, 4) for a in range(len(ts) - m + 1)}
        told = [(j, sum(t in x.lower() for t in ts), sum(p in x.lower() for p in runs)) for j, x, _ in docs if x]
        first = sorted((-m - 2 * p, j, m, p) for j, m, p in told if m)[:3]
        want += [(i, j, m, p, -s, r) for r, (s, j, m, p) in enumerate(first, 1)]
        parts = [(round(sum(t in x.lower() for t in said) / len(said) * (2 if own and own == src else 1), 6), j) for j, x, src in docs if x and said]
        share += [(i, j, s, r) for r, (s, j) in enumerate(sorted((x for x in parts if x[0]), key=lambda x: (-x[0], x[1]))[:3], 1)]
    found = R.text_search(q, d, "q", F.col("text"), "d", F.col("body"), 3)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    fall = R.fallback_search(q, d, "q", F.col("text"), F.col("own"), "d", F.col("body"), F.col("source"), 3)
    assert sorted(tuple(r) for r in fall.collect()) == sorted(share)
    for df in (found, fall):
        again = plan(df.select("*"))
        assert "Join" not in again and again.count("Exchange") == 1  # the first of each partition


def test_quality_is_one_row_a_page(spark, tmp_path):
    rows = [(1, "http://a", ""), (2, "http://a", ""), (3, "http://a", ""), (4, None, ""), (6, "http://b", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.QUERIES["quality_lookup"](spark, str(tmp_path)).where("url is not null").collect()
    assert sorted(tuple(r) for r in got) == [(1, "http://a", 0.7), (2, "http://a", 0.7), (3, "http://a", 0.0), (6, "http://b", 0.0)]
    scores = spark.createDataFrame([("u", 0.2), ("u", 0.4)], "url string, quality double")
    assert [tuple(r) for r in R.with_quality(spark.createDataFrame([("u",), ("v",)], "url string"), scores).orderBy("url").collect()] == [("u", 0.4), ("v", 0.0)]


def test_endings_take_time_in_proportion(spark, tmp_path):
    n = 200_000
    rows = [(1, "a" * n + "." + "b"), (2, "x" + " " * n + "y"), (3, "Done. More"), (4, "One! two?? \n "), (5, "?! ."), (6, "a.b"), (7, "aaaaaa?b\n"), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    start = time.time()
    got = {r.doc_id: r.text for r in registry.QUERIES["answer_ending"](spark, str(tmp_path)).collect()}
    assert time.time() - start < 30
    assert got == {1: "a" * n + ".", 2: "x" + " " * n + "y.", 3: "Done. More.", 4: "One! two.", 5: "", 6: "a.b.", 7: "aaaaaa?", 8: ""}


def test_patterns_against_brute_force(monkeypatch):
    monkeypatch.setattr(R, "POSITIONS", 7)
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab c\0é") for _ in range(rnd.randint(1, n)))
    one, two = ([{word(4): rnd.randint(1, 3) for _ in range(6)} for _ in range(5)] for _ in range(2))
    texts = [word(40) for _ in range(30)] + ["", "aaaa"]
    for cells in (1, 20, 1 << 20):  # edges, both, the table
        monkeypatch.setattr(R, "TRIE_CELLS", cells)
        got = R._Parts(one, two).ready().counts(texts)
        for kind, counts in zip((one, two), got):
            assert counts.tolist() == [[sum(n for p, n in w.items() if p in t) for w in kind] for t in texts]
    assert R._Parts([{}]).ready().counts(["x"])[0].tolist() == [[0.0]]


def test_vector_search_holds_few_scores():
    rng = np.random.default_rng(1)
    q, v, k = rng.integers(-3, 4, (1000, 4)).astype(float), rng.integers(-3, 4, (20_000, 4)).astype(float), 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(v))), pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))], names=["vec_id", "embedding"])
    tracemalloc.start()
    got = pa.Table.from_batches(list(R._nearest([batch, batch.slice(0, 0)], {4: (list(range(len(q))), q)}, k))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20  # all scores are 160 MB
    for i in (0, 7, 999):
        s = v @ q[i]
        want = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[j], j))[:k]
        assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == i] == [(j, s[j]) for j in want]


def test_filter_evaluates_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def one(x):
        seen.add(1)
        return x

    rows = [(i, "u", f"answer number {i % 3} of all", i / 10) for i in range(10)]
    raw = spark.createDataFrame(rows, "pos long, source_url string, answer string, overall double")
    pairs = raw.withColumn("overall", F.udf(one, "double")("overall"))
    assert sorted((r.pos, r.overall) for r in Q.filtered(pairs).collect()) == [(7, 0.7), (8, 0.8), (9, 0.9)]
    assert seen.value == len(rows)
    assert sorted(r.pos for r in Q.filtered(raw.where("pos < 5")).collect()) == [2, 3, 4]


def test_rule_questions_read_chunks_once(spark):
    topics = spark.createDataFrame([("d", "zoo", "LOCATION"), ("e", "zoo", "LOCATION"), ("f", "tea", "GENERAL")], "doc_url string, topic string, topic_type string")
    chunks = [("d", 1, "A Zoo is big. The zoo opened. No more."), ("d", 0, "Nothing here."), ("d", 2, "You can see the zoo. The zoo was far."), ("f", 0, "Take tea. No tea.")]
    c = spark.createDataFrame(chunks, "doc_url string, chunk_ord int, text string")
    out = G.rule_questions(topics, c)
    assert plan(out).count("Scan ExistingRDD") == 2
    want = [("d", 1, "What is zoo and what does it offer?", 0.65), ("d", 3, "How can students use zoo?", 0.65), ("e", 1, "Where is zoo located on campus?", 0.6)]
    assert sorted((r.doc_url, r.pos, r.text, r.quality_score) for r in out.collect()) == want


def test_chunks_take_their_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def one(x):
        seen.add(1)
        return x

    long = " ".join(f"Sentence {i} is here." for i in range(200))
    df = spark.createDataFrame([("a", long), ("b", "# x"), ("c", ""), ("d", None)], "u string, t string").coalesce(1)
    assert C.chunk_documents(df, F.col("u"), F.udf(one, "string")("t")).count() > 3
    assert seen.value == 4


def test_dotted_abbreviations(spark):
    text = "A Ph.D. B has M.D.M.A. C or i.e.g. D e.g. E i.g. F xPh.D. G Ph.A. H B.A. I"
    got = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t"))).first()[0]
    assert got == ["A Ph.D. B has M.D.M.A. C or i.e.g.", "D e.g. E i.g.", "F xPh.D.", "G Ph.A.", "H B.A. I."]
