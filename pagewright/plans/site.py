"""A whole run: pages to a knowledge base, questions, answers, scores and outputs.

Every stage is a plan over tables and leaves tables behind; a run that is started
again goes on after the last stage whose tables and manifest entry are there."""

from __future__ import annotations

import argparse
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lists as L
from ..functions import scores as S
from ..functions import text as T
from ..functions.providers import Providers
from ..operators import chunks as C
from ..operators import pages as P
from ..operators import quality as Q
from ..operators import questions as G
from ..operators import retrieve as R
from ..sources import io

#: Fewer questions than this ask for adaptive ones, fewer pairs for a lower bar.
FEW = 5
#: Key phrases of a document that questions are asked about.
TOPICS = 10


def session(config: io.Config) -> SparkSession:
    """A session for a run; what the launcher set stays."""
    return SparkSession.builder.appName("pagewright").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def paths(config: io.Config) -> dict[str, str]:
    """Where a run keeps its tables: by the md5 of its site, under the output folder."""
    root = f"{config.checkpoint or config.output}/{hashlib.md5(config.url.encode()).hexdigest()}"
    return {k: f"{root}/{k}" for k in ("crawl", "kb", "pairs", "metrics", "progress", "output")}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def crawl_website(spark: SparkSession, pages: DataFrame, config: io.Config, fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(url, text, quality) of a site. With fewer than three pages its variant with
    or without "www." is crawled too, and wins if it gave more."""
    at = paths(config)["crawl"]

    def once(url: str) -> DataFrame:
        site = spark.createDataFrame([(url,)], "url string")
        start = P.seeds(site).select(F.col("seed").alias("url"))
        domain = url.split("://", 1)[1].split("/")[0]
        got = P.crawl(pages, start, domain.removeprefix("www."), config.max_pages, fetch=fetch)
        return got.select("url", "text", "quality")

    first = once(config.url)
    io.save_crawl(first, first.select("url", F.lit("visited").alias("status")), at)
    content, _ = io.load_crawl(spark, at)
    if content.count() < 3:
        scheme, rest = config.url.split("://", 1)
        other = once(f"{scheme}://{rest[4:] if rest.startswith('www.') else 'www.' + rest}")
        both = io.merged_crawl(content, other)
        io.save_crawl(both, both.select("url", F.lit("visited").alias("status")), at + "-merged")
        content, _ = io.load_crawl(spark, at + "-merged")
    return content


def process_documents(content: DataFrame, providers: Providers | None = None) -> dict[str, DataFrame]:
    """documents (url, title, text, entities, topics), chunks (chunk_id, doc_url,
    chunk_ord, idx, text, entities[, embedding]) and postings (term, chunk_id).
    Documents without a chunk are left out."""
    p = providers or Providers()
    entities = p.entities or C.entities
    text = content.select("url", T.title_of(F.col("text")).alias("title"), T.clean_text(F.col("text")).alias("text")).where("text <> ''")
    chunks = C.chunk_documents(text, F.col("url"), F.col("text")).withColumn("entities", entities(F.col("text")))
    if p.embed:
        chunks = chunks.withColumn("embedding", p.embed(F.col("text")))
    phrases = C.key_phrases(text, "url", F.col("text"), TOPICS).groupBy("url").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "phrase", "score"))), lambda x: F.struct(x["phrase"].alias("text"), x["score"].alias("score"), F.lit("PHRASE").alias("type"))).alias("topics"))
    named = F.transform(C.capital_phrases(F.col("text"), TOPICS), lambda x: F.struct(x.alias("text"), F.lit(0.5).alias("score"), F.lit("CAP_PHRASE").alias("type")))
    documents = text.join(chunks.select(F.col("doc_url").alias("url")).distinct(), "url", "left_semi").join(phrases, "url", "left")
    documents = documents.select("url", "title", "text", entities(F.col("text")).alias("entities"), F.coalesce("topics", named).alias("topics"))
    return {"documents": documents, "chunks": chunks, "postings": R.postings(chunks, "chunk_id", F.col("text"))}


def generate_questions(kb: dict[str, DataFrame], config: io.Config, providers: Providers | None = None) -> DataFrame:
    """(question_id, text, topic, topic_type, source_url, quality_score). A site that
    gives too few questions gets adaptive ones too."""
    p = providers or Providers()
    topics = kb["documents"].select(F.col("url").alias("doc_url"), F.explode("topics").alias("t")).select("doc_url", F.col("t.text").alias("topic")).distinct()
    topics = topics.withColumn("topic_type", S.topic_type(F.col("topic")))
    model = general = None
    if p.ask:
        asked = G.topic_prompts(G.topic_content(topics, kb["chunks"]).join(topics, ["doc_url", "topic"]))
        model = asked.select("doc_url", "topic", "pos", p.ask(F.col("prompt")).alias("text"))
        general = G.general_prompts(kb["chunks"]).select("doc_url", "pos", p.ask(F.col("prompt")).alias("text"))
    q = G.document_questions(topics, kb["chunks"], config.max_pairs, general, model)
    q = q.select("text", "topic", "topic_type", F.col("doc_url").alias("source_url"), "quality_score")
    if q.limit(FEW).count() < FEW:
        a = G.adaptive_questions(kb["chunks"].withColumn("site", F.lit(1)), "site", "doc_url", "text", "doc_url")
        q = q.unionByName(a.select("text", "topic", "topic_type", "source_url", "quality_score"))
    return q.withColumn("question_id", F.xxhash64("source_url", "topic", "text"))


def answer_questions(questions: DataFrame, chunks: DataFrame, providers: Providers | None = None) -> DataFrame:
    """(pos, question, answer, source_url, topic, topic_type, context, n_context, and
    five scores): every question with its answer from the whole knowledge base, set by set."""
    p = providers or Providers()
    told = chunks.select("chunk_id", "doc_url", "text")
    if p.embed:
        asked = questions.select(F.col("question_id").alias("query_id"), p.embed(F.col("text")).alias("query"))
        index = R.search_index(chunks).select(F.col("chunk_id").alias("vec_id"), "embedding")
        first = R.vector_topk(asked, index, 60).join(told.withColumnRenamed("chunk_id", "vec_id"), "vec_id").join(questions.select(F.col("question_id").alias("query_id"), F.col("text").alias("q_text")), "query_id")
        hits = R.term_boost(first, F.array_distinct(T.words(F.lower("q_text"))), F.lower("text"), "query_id")
        hits = hits.select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("chunk_id"), "score", "rank")
        q_text, q_source = F.col("text"), F.col("source_url")
        hits = R.with_fallback(hits, questions, "question_id", "chunk_id", lambda q: R.fallback_search(q, told, "question_id", q_text, q_source, "chunk_id", F.col("text"), F.col("doc_url")))
        own = questions.select("question_id", F.col("source_url").alias("own"))
        hits = hits.join(told.select("chunk_id", F.col("doc_url").alias("source")), "chunk_id").join(own, "question_id").withColumn("is_source", F.col("source") == F.col("own"))
        picked = R.diverse(hits, "question_id", "source").select("question_id", "chunk_id", "source", "score", "pick")
    else:
        picked = R.retrieved(questions, told, "question_id", F.col("text"), F.col("source_url"), "chunk_id", F.col("text"), F.col("doc_url"))
    texts = picked.join(told.select("chunk_id", "text"), "chunk_id").withColumnRenamed("pick", "rank")
    if p.cross:
        named = texts.join(questions.select("question_id", F.col("text").alias("q_text")), "question_id")
        texts = R.rerank(named, p.cross(F.col("q_text"), F.col("text")), "question_id", "chunk_id").withColumn("score", F.col("final_score"))
    context = R.merged_context(texts, "question_id", "source", "text")
    pairs = questions.withColumnRenamed("text", "question").join(context, "question_id", "left")
    if p.answer:
        best = T.format_answer(G.substantive_answer(p.answer(F.col("question"), F.col("context"))))
    else:
        best = F.lit(L.NO_MODEL)
    answer = F.when(F.coalesce("n_texts", F.lit(0)) == 0, F.lit(L.DECLINED)).otherwise(best)
    pairs = pairs.select(F.col("question_id").alias("pos"), "question", answer.alias("answer"), "source_url", "topic", "topic_type", "context", F.coalesce("n_texts", F.lit(0)).alias("n_context"))
    return Q.evaluated(pairs, judge=p.judge, check=p.check)


def qa_pairs(pairs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The pairs that are good enough; once more with a lower bar if that leaves few."""
    kept = Q.filtered(pairs, min_score)
    if kept.limit(FEW).count() < FEW:
        return Q.filtered(pairs, min_score - 0.1)
    return kept


def evaluate(pairs: DataFrame) -> dict[str, DataFrame]:
    """The report of a run, a table a section."""
    return {"averages": Q.average_scores(pairs), "distribution": Q.distribution(pairs), "topics": Q.topic_coverage(pairs, "topic"), "urls": Q.url_coverage(pairs, "source_url")}


def as_output(pairs: DataFrame) -> DataFrame:
    scores = F.struct(*[F.col(k) for k in ("relevance", "factuality", "completeness", "formatting", "overall")]).alias("scores")
    return pairs.select("pos", "question", "answer", "source_url", "topic", "topic_type", scores)


def save_output(pairs: DataFrame, path: str) -> None:
    """JSON lines, CSV and Markdown of the pairs."""
    out = as_output(pairs)
    io.save_pairs(out.drop("pos"), f"{path}/qa_pairs.json")
    io.save_csv(out, f"{path}/qa_pairs.csv")
    sections = io.markdown(out)
    io.save_text(sections.orderBy("group_pos"), f"{path}/qa_pairs.md")


def run(spark: SparkSession, pages: DataFrame, config: io.Config, providers: Providers | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All stages of a site's run; the pairs. ``force`` begins anew."""
    at = paths(config)
    done = {} if config.force else io.load_progress(spark, at["progress"], config.url) or {}

    def stage(name: str, tables: list[str], work: Callable[[], None]) -> None:
        if done.get(name) and all(_exists(spark, t) for t in tables):
            return
        work()
        for later in L.STAGES[L.STAGES.index(name) :]:
            done[later] = False
        done[name] = True
        io.save_progress(spark, at["progress"], config.url, done)

    stage("resources_setup", [], lambda: None)
    found = at["crawl"] + "-pages"
    stage("crawling", [found], lambda: crawl_website(spark, pages, config, fetch).write.mode("overwrite").parquet(found))

    def process() -> None:
        kb = process_documents(io.valid_crawl(spark.read.parquet(found)), providers)
        io.save_kb(kb["documents"], kb["chunks"], kb["postings"], at["kb"])

    stage("processing", [at["kb"]], process)

    def generate() -> None:
        kb = io.load_kb(spark, at["kb"])
        asked = at["pairs"] + "-questions"
        generate_questions(kb, config, providers).write.mode("overwrite").parquet(asked)
        raw = at["pairs"] + "-raw"
        answer_questions(spark.read.parquet(asked), kb["chunks"], providers).write.mode("overwrite").parquet(raw)
        qa_pairs(spark.read.parquet(raw), config.min_score).write.mode("overwrite").parquet(at["pairs"])

    stage("qa_generation", [at["pairs"]], generate)
    pairs = spark.read.parquet(at["pairs"])

    def report() -> None:
        for name, df in evaluate(pairs).items():
            io.save_metrics(df, f"{at['metrics']}/{name}")

    stage("evaluation", [at["metrics"]], report)
    stage("output", [at["output"]], lambda: save_output(pairs, at["output"]))
    return pairs


def arguments(argv: list[str] | None = None) -> tuple[io.Config, str | None]:
    """Parameters of a run from a command line, and the page table, if one is given."""
    p = argparse.ArgumentParser(prog="pagewright")
    p.add_argument("--url", required=True)
    p.add_argument("--output", default="output")
    p.add_argument("--max-pages", type=int, default=30)
    p.add_argument("--max-pairs", type=int, default=10)
    p.add_argument("--no-gpu", action="store_true")
    p.add_argument("--checkpoint", default=None)
    p.add_argument("--force", action="store_true")
    p.add_argument("--pages", default=None, help="a table of pages (url, html) instead of the network")
    a = p.parse_args(argv)
    options = {"gpu": not a.no_gpu}
    return io.Config(a.url, a.output, a.max_pages, a.max_pairs, a.checkpoint, a.force, options=options), a.pages


def main(argv: list[str] | None = None) -> None:
    """Run from a command line, from a page table or the network."""
    from ..sources import web

    config, table = arguments(argv)
    spark = session(config)
    pages = spark.read.parquet(table) if table else spark.createDataFrame([], "url string, html string")
    run(spark, pages, config, fetch=None if table else lambda todo: web.fetched(spark, todo))


if __name__ == "__main__":
    main()
