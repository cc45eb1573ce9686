"""Question-answer pairs: evaluation, adaptive filter, signatures, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scores as S
from ..functions import text as T
from ..sources.io import written
from .retrieve import token_hits


def evaluated(pairs: DataFrame, context: str = "context", n_context: str = "n_context", judge=None, check=None) -> DataFrame:
    """Pairs with all scores, rounded to six digits. ``judge`` (question, answer) and
    ``check`` (answer, context) are a model's probabilities, if there are any."""
    q, a, c = F.col("question"), F.col("answer"), F.col(context)
    s = S.evaluation(q, a, c, F.col(n_context), judge(q, a) if judge else None, check(a, c) if check else None)
    out = pairs.withColumn("_s", T.let(s, lambda x: x))
    return out.select(*pairs.columns, *[F.round(F.col(f"_s.{k}"), 6).alias(k) for k in ("relevance", "factuality", "completeness", "formatting", "overall")])


def by_signature(pairs: DataFrame, url: str = "source_url") -> DataFrame:
    """The best pair of each URL and answer signature."""
    r = F.row_number().over(Window.partitionBy(url, "signature").orderBy(F.desc("overall"), "pos"))
    return pairs.withColumn("signature", T.signature(F.col("answer"))).withColumn("r", r).where("r = 1").drop("r")


def filtered(pairs: DataFrame, min_score: float = 0.5, url: str = "source_url", rescue: int = 3, last: int = 5) -> DataFrame:
    """Pairs of enough quality. With fewer than five pairs the bar is lower; if
    fewer than ``rescue`` pass, the best ``rescue`` of all do; then one a
    signature. If fewer than ``rescue`` are left, the best ``last`` of all.

    The pairs are written once, since their scores are dear and read many times. The
    counts are one-row aggregates; the first ranks are a top-k by sort and limit, so
    no window runs over all pairs."""
    pairs = written(pairs)
    n = pairs.agg(F.count("*").alias("n"))
    bar = F.when(F.col("n") < 5, F.lit(min_score - 0.1) * 0.8).otherwise(F.lit(min_score))
    told = pairs.crossJoin(F.broadcast(n)).withColumn("passes", F.col("overall") >= bar)
    best = lambda k: pairs.orderBy(F.desc("overall"), "pos").limit(k).select("pos")
    passing = told.agg(F.count_if("passes").alias("n_pass"))
    few = told.crossJoin(F.broadcast(passing)).withColumn("few", (F.col("n_pass") < rescue) & (F.col("n") > rescue))
    top = best(rescue).withColumn("top", F.lit(True))
    kept = few.join(F.broadcast(top), "pos", "left").where(F.when(F.col("few"), F.coalesce("top", F.lit(False))).otherwise(F.col("passes")))
    one = by_signature(kept.select(pairs.columns), url)
    left = one.agg(F.count("*").alias("n_left"))
    final = one.crossJoin(F.broadcast(left)).where(F.col("n_left") >= rescue).select(*pairs.columns)
    again = pairs.join(F.broadcast(best(last)), "pos").crossJoin(F.broadcast(left)).where(F.col("n_left") < rescue).select(*pairs.columns)
    return final.unionByName(again)


def average_scores(pairs: DataFrame) -> DataFrame:
    """One row: the mean of each score, rounded to three digits, and the count."""
    keys = ("relevance", "factuality", "completeness", "formatting", "overall")
    return pairs.agg(F.count("*").alias("total_pairs"), *[F.round(F.avg(k), 3).alias(f"avg_{k}") for k in keys])


def distribution(pairs: DataFrame) -> DataFrame:
    """(bucket, n) of overall scores, a row for each bucket that occurs."""
    bucket = F.when(F.col("overall") >= 0.8, "excellent").when(F.col("overall") >= 0.7, "good").when(F.col("overall") >= 0.6, "average").otherwise("below_avg")
    return pairs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def topic_coverage(pairs: DataFrame, topic: str, most: int = 10) -> DataFrame:
    """(topic, n): the most frequent topics but none and "general"."""
    low = F.lower(topic)
    named = pairs.where(~F.coalesce(low, F.lit("")).isin("", "general"))
    return named.groupBy(low.alias("topic")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(most)


def url_coverage(pairs: DataFrame, url: str) -> DataFrame:
    """(url, n) by falling count."""
    return pairs.groupBy(F.col(url).alias("url")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url")


def without_redundant(blocks: DataFrame, group: str, threshold: float = 0.7) -> DataFrame:
    """(group, pos, text, score): blocks, best first, but those whose word pairs are
    like a kept block's, unless their scores are close and they are longer."""
    item = F.struct((-F.col("score")).alias("q"), "pos", F.col("text").alias("t"))
    per = blocks.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"))

    def redundant(x, y):
        longer = (F.try_divide(x["q"], y["q"]) > 0.85) & (F.length(y["t"]) < F.length(x["t"]) * 0.8)
        return (S.bigram_similarity(x["t"], y["t"]) > threshold) & ~F.coalesce(longer, F.lit(False))

    kept = F.aggregate("items", F.slice("items", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: redundant(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return per.select(group, F.explode(kept).alias("k")).select(group, F.col("k.pos").alias("pos"), F.col("k.t").alias("text"), (-F.col("k.q")).alias("score"))


def context_blocks(blocks: DataFrame, group: str, url: str, budget: int = 1500) -> DataFrame:
    """(group, pick, pos, url, text) of blocks for a context of ``budget``
    characters; all, in their order, if they fit.

    Else the best block of each document, documents in order of appearance, where
    it fits; then the others by score, less 5 % where their document has one
    already, up to the first that doesn't fit; of that one its whole sentences, if
    over 200 characters are left and over 100 come of it. A group is a question's hits."""
    item = F.struct("pos", F.col(url).alias("url"), F.col("score").cast("double").alias("score"), F.col("text").alias("text"))
    per = blocks.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum(F.length("text")).alias("total"))
    first = lambda u: F.array_sort(F.filter("items", lambda x: x["url"] == u), lambda x, y: F.when(x["score"] != y["score"], F.signum(y["score"] - x["score"]).cast("int")).otherwise(F.signum(x["pos"] - y["pos"]).cast("int")))[0]
    per = per.withColumn("best", F.transform(F.array_distinct(F.transform("items", lambda x: x["url"])), first))
    none = F.slice("items", 1, 0)
    state = F.struct(F.lit(0).alias("len"), none.alias("out"))
    fits = lambda s, x: s["len"] + F.length(x["text"]) <= budget
    add = lambda s, x, when: F.struct(F.when(when, s["len"] + F.length(x["text"])).otherwise(s["len"]).alias("len"), F.when(when, F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))
    per = per.withColumn("one", F.aggregate("best", state, lambda s, x: add(s, x, fits(s, x))))
    has = lambda x: F.exists("one.out", lambda y: y["url"] == x["url"])
    rest = F.filter("items", lambda x: ~F.exists("one.out", lambda y: y["pos"] == x["pos"]))
    keyed = F.transform(rest, lambda x: F.struct((-x["score"] * F.when(has(x), 0.95).otherwise(1.0)).alias("a"), (-x["score"]).alias("b"), x["pos"].alias("p"), x.alias("x")))
    per = per.withColumn("rest", F.transform(F.array_sort(keyed), lambda k: k["x"]))
    start = F.struct(F.col("one.len").alias("len"), F.col("one.out").alias("out"), F.lit(True).alias("open"))

    def step(s, x):
        left = F.lit(budget) - s["len"]
        cut = F.concat(F.regexp_replace(F.left(x["text"], left), r"\.[^.]*$", ""), F.lit("."))
        part = F.struct(x["pos"].alias("pos"), x["url"].alias("url"), x["score"].alias("score"), cut.alias("text"))
        both = add(s, x, s["open"] & fits(s, x))
        late = s["open"] & ~fits(s, x) & (left > 200) & (F.length(cut) > 100)
        return F.struct(both["len"].alias("len"), F.when(late, F.concat(s["out"], F.array(part))).otherwise(both["out"]).alias("out"), (s["open"] & fits(s, x)).alias("open"))

    chosen = F.when(F.col("total") <= budget, F.col("items")).otherwise(F.aggregate("rest", start, step, lambda s: s["out"]))
    out = per.select(group, F.posexplode(chosen).alias("pick", "b"))
    return out.select(group, F.col("pick").cast("long").alias("pick"), F.col("b.pos").alias("pos"), F.col("b.url").alias(url), F.col("b.text").alias("text"))


def assembled_context(blocks: DataFrame, group: str, url: str, order: str = "pos") -> DataFrame:
    """(group, context): a group's blocks by document, in order of appearance and
    there by ``order``, each document named if there are several."""
    per = blocks.groupBy(group, url).agg(F.min("pick").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"))
    name = F.split_part(F.regexp_replace(F.col(url), "https?://", ""), F.lit("/"), F.lit(1))
    docs = per.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("first", name.alias("name"), "text"))).alias("d"))
    named = F.transform("d", lambda x: F.concat(F.lit("[From: "), x["name"], F.lit("] "), x["text"]))
    return docs.select(group, F.when(F.size("d") > 1, F.array_join(named, "\n\n")).otherwise(F.get("d", F.lit(0))["text"]).alias("context"))


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """(pos, conv_id, turn, question, answer, source_url, context, n_context): a
    user's turn with the assistant's next; the conversation's other turns are the
    context. Turns meet by conversation and number (an equi-join)."""
    q = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = q.join(a, ["conv_id", "turn"])
    rest = pairs.select("conv_id", "turn").join(turns.select("conv_id", F.col("turn").alias("t"), "text"), "conv_id").where("t <> turn and t <> turn + 1")
    ctx = rest.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "text"))), lambda x: x["text"]), " ").alias("context"), F.count("*").alias("n_context"))
    out = pairs.join(ctx, ["conv_id", "turn"], "left")
    return out.select((F.col("conv_id") * F.lit(1 << 31) + F.col("turn")).alias("pos"), "conv_id", "turn", "question", "answer", F.concat(F.lit("conv://"), F.col("conv_id").cast("string")).alias("source_url"), "context", F.coalesce("n_context", F.lit(0)).alias("n_context"))


def near_duplicate_texts(docs: DataFrame, id_col: str, text_col: str, head: int | None = 40, like: float = 0.8) -> DataFrame:
    """Links (a_id, b_id) of texts that are too similar: one inside the other if
    either has fewer than 100 characters, else by their distinct runs of three
    words. With ``head``, only of texts with the same first ``head`` characters.

    Equal texts are a class, linked to their least id only; different texts are
    compared by that id. Long ones meet over the first of their hashed runs in one
    order, rare ones first, of which two texts beyond ``like`` share one. A short
    text can only lie in texts with a token that holds its longest word; one
    without words meets all. Null texts link with nothing."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.sha2(text_col, 256).alias("digest"))
    least = rows.groupBy("digest").agg(F.min("id").alias("rep"))
    some_run = (F.length("text") < 100) | (T.n_words(F.col("text")) >= 3)
    copies = rows.where(some_run).select("id", "digest").join(least, "digest").where("id <> rep").select(F.col("rep").alias("a_id"), F.col("id").alias("b_id"))

    def runs(t):
        hashed = F.transform(F.sequence(F.lit(0), F.size(t) - 3), lambda i: F.xxhash64(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2)))
        return F.when(F.size(t) >= 3, F.array_sort(F.array_distinct(hashed))).otherwise(F.array().cast("array<bigint>"))

    bucket = F.md5(F.substring("text", 1, head)) if head else F.lit("")
    reps = rows.join(least.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").select("id", "text", bucket.alias("bucket"))
    long = reps.where(F.length("text") >= 100).select("id", "bucket", T.let(T.words(F.col("text")), runs).alias("g"))
    every = long.select("id", "bucket", F.size("g").alias("n"), F.explode("g").alias("key"))
    times = every.groupBy("key").agg(F.count("*").alias("times"))
    ordered = every.join(times, "key").groupBy("id", "bucket", "n").agg(F.array_sort(F.collect_list(F.struct("times", "key"))).alias("o"))
    first = F.slice("o", 1, F.col("n") - F.floor(F.col("n") * like).cast("int"))
    keys = ordered.select("id", "bucket", "n", F.explode(first).alias("k")).where("k.times > 1").select("id", "bucket", "n", "k.key")
    a, b = (keys.select(F.col("id").alias(f"{k}_id"), F.col("n").alias(f"{k}_n"), "bucket", "key") for k in "ab")
    near_size = F.least("a_n", "b_n") > F.greatest("a_n", "b_n") * like
    maybe = a.join(b, ["bucket", "key"]).where((F.col("a_id") < F.col("b_id")) & near_size).select("a_id", "b_id").distinct()
    for k in "ab":
        maybe = maybe.join(long.select(F.col("id").alias(f"{k}_id"), F.col("g").alias(f"{k}_g")), f"{k}_id")
    both = F.size(F.array_intersect("a_g", "b_g"))
    alike = maybe.withColumn("both", both).where(F.col("both") / (F.size("a_g") + F.size("b_g") - F.col("both")) > like).select("a_id", "b_id")

    longest = F.array_max(F.transform(T.words(F.col("text")), lambda w: F.struct(F.length(w), w.alias("term"))))["term"]
    short = reps.where(F.length("text") < 100).select(F.col("id").alias("s_id"), F.col("text").alias("s"), F.col("bucket").alias("s_bucket"), longest.alias("term"))
    posts = reps.select("id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("token"))
    worded = short.where("term is not null")
    met = token_hits(posts, "id", worded.select("term")).join(worded, "term").join(reps, "id")
    met = met.unionByName(short.where("term is null").crossJoin(reps))
    held = met.where((F.col("bucket") == F.col("s_bucket")) & (F.col("id") != F.col("s_id")) & F.contains("text", "s"))
    held = held.select(F.least("id", "s_id").alias("a_id"), F.greatest("id", "s_id").alias("b_id")).distinct()
    return copies.unionByName(alike).unionByName(held)
