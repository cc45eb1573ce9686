"""Questions: content of a topic, rules, near-repeats, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lists as L
from ..functions import scores as S
from ..functions import text as T
from ..sources.io import written


def topic_content(topics: DataFrame, chunks: DataFrame, budget: int = 1000, least_tail: int = 100) -> DataFrame:
    """(doc_url, topic, content, n_chunks): chunks of a topic's document, whole
    mentions (2) before half of its words (1), cut at a length.

    A topic of several words is half contained with half of them, rounded down."""
    terms = T.words(F.lower("topic"))
    low = F.lower("text")
    some = (F.size(terms) > 1) & (T.matching_terms(terms, low) >= F.floor(F.size(terms) / 2))
    told = topics.join(chunks, "doc_url").withColumn("rel", F.when(F.contains(low, F.lower("topic")), 2).when(some, 1))
    told = told.where("rel is not null")
    w = Window.partitionBy("doc_url", "topic").orderBy(F.desc("rel"), "chunk_ord")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = told.withColumn("before", before).withColumn("fits", F.col("before") + F.length("text") <= budget)
    tail = ~F.col("fits") & (F.col("before") <= budget) & (budget - F.col("before") > least_tail)
    told = told.withColumn("piece", F.when(F.col("fits"), F.col("text")).when(tail, F.left("text", (budget - F.col("before")).cast("int"))))
    kept = told.where("piece is not null").withColumn("r", F.row_number().over(w))
    return kept.groupBy("doc_url", "topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "piece"))), lambda x: x["piece"]), " ").alias("content"), F.count("*").alias("n_chunks"))


def summary_context(chunks: DataFrame, budget: int = 1500) -> DataFrame:
    """(doc_url, head, rest): leading chunks while what stands before is within a
    length, and the two slices that summaries begin from."""
    w = Window.partitionBy("doc_url").orderBy("chunk_ord").rowsBetween(Window.unboundedPreceding, -1)
    kept = chunks.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).where(F.col("before") <= budget)
    joined = kept.groupBy("doc_url").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_ord", "text"))), lambda x: x["text"]), " ").alias("c"))
    return joined.select("doc_url", F.left("c", F.lit(1000)).alias("head"), F.substr("c", F.lit(501), F.lit(1000)).alias("rest"))


# What a sentence says, by kind, and the question it gives.
_SENTENCE_RULES = [
    ("is|are|was|were|will be", "What is %s and what does it offer?"),
    ("can|could|may|might|should", "How can students use %s?"),
    ("located|found|available|offered|provided", "Where can students access %s?"),
    ("eligible|qualify|qualifies|requirement", "Who is eligible for %s?"),
]
_TYPE_RULES = {"SERVICE": "What services does %s provide?", "LOCATION": "Where is %s located on campus?", "PROGRAM": "What is the purpose of the %s program?"}
_GENERIC = "What information is available about %s?"


def rule_questions(topics: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """(doc_url, topic, pos, text, quality_score): by rule from the first sentences
    that mention a topic; without any, one by the topic's type.

    Topics meet chunks by document. A sentence that fits no rule gives nothing."""
    told = topics.join(chunks.select("doc_url", "chunk_ord", "text"), "doc_url", "left")
    ask = lambda s: F.coalesce(*[F.when(F.lower(s).rlike(p), F.format_string(q, "topic")) for p, q in _SENTENCE_RULES])
    mention = F.slice(F.filter(T.sentences(F.col("text")), lambda s: F.contains(F.lower(s), F.lower("topic"))), 1, most)
    asked = F.when(F.contains(F.lower("text"), F.lower("topic")), F.struct("chunk_ord", F.transform(mention, ask).alias("asks")))
    # topics without a mention stay; of a chunk only its questions go on, none where a sentence fits no rule
    per = told.select("doc_url", "topic", "topic_type", asked.alias("a")).groupBy("doc_url", "topic", "topic_type").agg(F.sort_array(F.collect_list("a")).alias("a"))
    first = F.slice(F.flatten(F.transform("a", lambda x: x["asks"])), 1, most)
    by_type = F.coalesce(*[F.when(F.col("topic_type") == t, F.format_string(q, "topic")) for t, q in _TYPE_RULES.items()], F.format_string(_GENERIC, "topic"))
    item = lambda pos, text, q: F.struct(pos.cast("long").alias("pos"), text.alias("text"), F.lit(q).alias("quality_score"))
    by_sentence = lambda f: F.filter(F.transform(f, lambda t, i: item(i + 1, t, 0.65)), lambda x: x["text"].isNotNull())
    out = T.let(first, lambda f: F.when(F.size(f) > 0, by_sentence(f)).otherwise(F.array(item(F.lit(1), by_type, 0.6))))
    return per.select("doc_url", "topic", F.explode(out).alias("q")).select("doc_url", "topic", "q.*")


def without_repeats(questions: DataFrame, group: str, text: str = "text", quality: str = "quality_score", pos: str = "pos") -> DataFrame:
    """(group, kept_pos, text): greedy, best first; a question goes if it is like
    one that stays. Groups are a document's or a conversation's questions."""
    item = F.struct((-F.col(quality)).alias("q"), F.col(pos).alias("pos"), F.col(text).alias("t"))
    per = questions.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))
    empty = F.slice("items", 1, 0)
    kept = F.aggregate("items", empty, lambda acc, x: F.when(F.exists(acc, lambda y: S.questions_similar(x["t"], y["t"])), acc).otherwise(F.concat(acc, F.array(x))))
    out = per.select(group, F.explode(kept).alias("k"))
    return out.select(group, F.col("k.pos").alias("kept_pos"), F.col("k.t").alias("text"))


def capped(questions: DataFrame, url: str, most: int = 10, topic: str | None = None) -> DataFrame:
    """At most ``most`` questions of a URL by quality, and with ``topic`` at most
    max(2, most / topics) of each topic first."""
    q = questions
    if topic:
        topics = q.groupBy(url).agg(F.countDistinct(topic).alias("n_topics"))
        r = F.row_number().over(Window.partitionBy(url, topic).orderBy(F.desc("quality_score"), "pos"))
        q = q.withColumn("r", r).join(topics, url).where(F.col("r") <= F.greatest(F.lit(2), F.floor(F.lit(most) / F.col("n_topics")))).drop("r", "n_topics")
    r = F.row_number().over(Window.partitionBy(url).orderBy(F.desc("quality_score"), "pos"))
    return q.withColumn("rank", r.cast("long")).where(F.col("rank") <= most)


def adaptive_questions(chunks: DataFrame, site: str, url: str, text: str, order: str, keywords: list[str] = L.ADAPTIVE_KEYWORDS, most: int = 3) -> DataFrame:
    """(site, pos, text, topic, topic_type, source, quality_score, source_url):
    questions for a site that gave too few: three fixed ones, and one for each of
    the first ``most`` keywords, in alphabetical order, that its chunks have;
    without near-repeats, which leaves little of the latter. The source is the
    site's first URL by ``order``.

    A keyword has no blank, so it lies in one chunk; which ones a site has is a
    partial aggregate, and no text moves."""
    names = sorted(keywords)
    has = [F.bool_or(F.contains(F.lower(F.col(text)), F.lit(k))).alias(f"k{i}") for i, k in enumerate(names)]
    per = chunks.groupBy(site).agg(F.min_by(url, order).alias("source_url"), *has)
    found = F.slice(F.array_compact(F.array(*[F.when(F.col(f"k{i}"), F.lit(k)) for i, k in enumerate(names)])), 1, most)
    fixed = F.array(*[F.struct(F.lit(q).alias("text"), F.lit(t).alias("topic"), F.lit(k).alias("topic_type"), F.lit("adaptive_fallback").alias("source"), F.lit(0.6).alias("quality_score")) for q, t, k in L.FALLBACK_QUESTIONS])
    asked = F.transform(found, lambda k: F.struct(F.format_string(L.ADAPTIVE_QUESTION, k).alias("text"), F.initcap(k).alias("topic"), F.lit("KEYWORD").alias("topic_type"), F.lit("adaptive_keyword").alias("source"), F.lit(0.65).alias("quality_score")))
    every = per.select(site, "source_url", F.posexplode(F.concat(fixed, asked)).alias("pos", "q")).select(site, "source_url", F.col("pos").cast("long").alias("pos"), "q.*")
    kept = without_repeats(every, site).select(F.col(site).alias("_site"), F.col("kept_pos").alias("pos"))
    return every.join(kept, every[site].eqNullSafe(kept["_site"]) & (every["pos"] == kept["pos"])).select(every["*"])


def topic_prompts(contents: DataFrame) -> DataFrame:
    """(doc_url, topic, pos, prompt): what a question model is asked about a topic,
    from (doc_url, topic, topic_type, content)."""
    tail = F.concat(F.lit("\n\nContent: "), F.col("content"), F.lit("\n\nQuestion:"))
    simple = lambda p: F.concat(F.format_string(p, "topic"), tail)
    by_type = [F.when(F.col("topic_type") == t, simple(p)) for t, ps in L.TYPE_PROMPTS.items() for p in ps]
    steps = F.concat(
        F.format_string("Based on this content, create a thoughtful question about %s:", "topic"),
        F.lit("\n\nContent: "), F.col("content"),
        F.format_string("\n\nStep 1: Identify the most important information about %s.\nStep 2: Consider what students would want to know about %s.\nStep 3: Formulate a clear, specific question.\nQuestion:", "topic", "topic"),
    )
    by_word = [F.when(T.any_of(F.lower("content"), ws), simple(p)) for ws, p in L.WORD_PROMPTS]
    some = contents.where(F.coalesce("content", F.lit("")) != "")
    return some.select("doc_url", "topic", F.posexplode(F.array_compact(F.array(simple(L.TOPIC_PROMPT), *by_type, steps, *by_word))).alias("pos", "prompt"))


def general_prompts(chunks: DataFrame) -> DataFrame:
    """(doc_url, pos, prompt): what a question model is asked about a whole document."""
    s = summary_context(chunks)
    parts = [F.col("head"), F.col("rest"), F.col("head"), F.col("rest")]
    asks = F.array(*[F.concat(F.lit(p + "\n\nContent: "), c, F.lit("\n\nQuestion:")) for p, c in zip(L.GENERAL_PROMPTS, parts)])
    return s.select("doc_url", F.posexplode(asks).alias("pos", "prompt"))


def topic_questions(topics: DataFrame, chunks: DataFrame, most: int = 3, model: DataFrame | None = None) -> DataFrame:
    """(doc_url, topic, pos, text, quality_score): a topic's questions, a model's
    first (doc_url, topic, pos, text), if there are any, and where these are fewer
    than ``most`` those by rule; without near-repeats, all with a question mark."""
    ruled = rule_questions(topics, chunks).withColumn("pos", F.col("pos") + 1000)
    if model is not None:
        model = model.select("doc_url", "topic", F.col("pos").cast("long").alias("pos"), T.clean_question(F.col("text")).alias("text"), F.lit(0.8).alias("quality_score")).where("text <> ''")
        enough = model.groupBy("doc_url", "topic").agg(F.count("*").alias("n")).where(F.col("n") >= most)
        ruled = model.unionByName(ruled.join(enough, ["doc_url", "topic"], "left_anti"))
    # a few rows a topic, used twice
    q = written(ruled).withColumn("_key", F.struct("doc_url", "topic"))
    kept = without_repeats(q, "_key").select(F.col("_key.doc_url").alias("doc_url"), F.col("_key.topic").alias("topic"), F.col("kept_pos").alias("pos"))
    out = q.drop("_key").join(kept, ["doc_url", "topic", "pos"])
    r = F.row_number().over(Window.partitionBy("doc_url", "topic").orderBy(F.desc("quality_score"), "pos"))
    asked = F.when(F.endswith("text", F.lit("?")), F.col("text")).otherwise(F.concat("text", F.lit("?")))
    return out.withColumn("r", r).where(F.col("r") <= most).select("doc_url", "topic", F.col("r").cast("long").alias("pos"), asked.alias("text"), "quality_score")


def document_questions(topics: DataFrame, chunks: DataFrame, most: int = 10, general: DataFrame | None = None, model: DataFrame | None = None) -> DataFrame:
    """(doc_url, pos, text, topic, topic_type, quality_score): all questions of the
    documents: at most max(2, most / topics) a topic, then a model's general ones
    (doc_url, pos, text) if there are any, at most four; at most ``most`` a document, the best first."""
    n = topics.groupBy("doc_url").agg(F.count("*").alias("n_topics"))
    q = topic_questions(topics, chunks, most, model).join(n, "doc_url").where(F.col("pos") <= F.greatest(F.lit(2), F.floor(F.lit(most) / F.col("n_topics")))).drop("n_topics")
    q = q.join(topics.select("doc_url", "topic", "topic_type"), ["doc_url", "topic"]).select("doc_url", "topic", "topic_type", "pos", "text", "quality_score", F.lit(0).alias("kind"))
    if general is not None:
        said = general.select("doc_url", F.col("pos").cast("long").alias("pos"), T.clean_question(F.col("text")).alias("text"), F.lit(0.8).alias("quality_score")).where("text <> ''")
        kept = without_repeats(said, "doc_url").select("doc_url", F.col("kept_pos").alias("pos"))
        said = said.join(kept, ["doc_url", "pos"]).withColumn("r", F.row_number().over(Window.partitionBy("doc_url").orderBy("pos"))).where("r <= 4")
        q = q.unionByName(said.select("doc_url", F.lit("General").alias("topic"), F.lit("GENERAL").alias("topic_type"), "pos", "text", "quality_score", F.lit(1).alias("kind")))
    r = F.row_number().over(Window.partitionBy("doc_url").orderBy(F.desc("quality_score"), "kind", "topic", "pos"))
    return q.withColumn("r", r).where(F.col("r") <= most).select("doc_url", F.col("r").cast("long").alias("pos"), "text", "topic", "topic_type", "quality_score")


def length_score(c: Column) -> Column:
    """How good an answer's length is: rising to 50 characters, best up to 200, then falling to a half."""
    n = F.length(c)
    return F.when(n < 20, n / 20.0).when(n < 50, F.lit(0.5) + (n - 20) / 60.0).when(n <= 200, 1.0).otherwise(F.greatest(F.lit(0.5), F.lit(1.0) - (n - 200) / 800.0))


def selected_answer(candidates: Column, context: Column) -> Column:
    """Of candidate answers the first best by length (0.3) and by the share of their
    pairs of words that the context has (0.7); none gives the empty text."""

    def score(a, theirs):
        mine = T.ngrams(T.words(F.lower(a)), 2)
        return F.lit(0.3) * length_score(a) + F.lit(0.7) * F.coalesce(F.try_divide(F.size(F.array_intersect(mine, theirs)), F.size(mine)), F.lit(0.0))

    marks = T.let(T.ngrams(T.words(F.lower(context)), 2), lambda theirs: F.transform(candidates, lambda a: score(a, theirs)))
    best = T.let(marks, lambda m: F.get(candidates, (F.array_position(m, F.array_max(m)) - 1).cast("int")))
    return F.when(F.size(candidates) == 0, F.lit("")).when(F.size(candidates) == 1, F.get(candidates, F.lit(0))).otherwise(best)


def substantive_answer(candidates: Column) -> Column:
    """The longest candidate that doesn't only decline, ten characters less for each
    time it does in part; the first if all only decline. The first of equals."""
    real = F.filter(candidates, lambda c: ~T.is_disclaimer(c))
    marks = F.transform(real, lambda c: F.length(c) - F.regexp_count(c, F.lit("I don't have")) * 10)
    best = F.get(real, (F.array_position(marks, F.array_max(marks)) - 1).cast("int"))
    return F.when(F.size(real) > 0, best).otherwise(F.get(candidates, F.lit(0)))
