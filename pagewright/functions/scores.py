"""Column functions that score pages, URLs, questions and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists as L
from . import text as T


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def when(condition: Column, value: float) -> Column:
    """``value`` where the condition holds, else 0."""
    return F.when(condition, F.lit(value)).otherwise(0.0)


def page_quality(content: Column, url: Column, phrases: list[str] = L.MEANINGFUL_PHRASES, priority_paths: list[str] = L.PRIORITY_PATHS) -> Column:
    """Quality of a page from its length, path and phrases. Beyond 500 words the
    bonus stays the same; every path starts with "/", so most get the path bonus."""
    n, path, low = T.n_words(content), F.lower(T.url_path(url)), F.lower(content)
    by_length = F.when(n < 100, -0.2).when(n < 300, -0.1).when(n > 500, 0.1).otherwise(0.0)
    by_path = F.when(F.exists(F.array(*map(F.lit, priority_paths)), lambda p: F.startswith(path, p)), 0.15).otherwise(0.0)
    home = when((path == "/") | (path == "/index.html") | F.startswith(path, F.lit("/about")), 0.1)
    said = F.least(F.lit(0.2), T.count_of(low, phrases) * 0.02)
    marks = when(F.contains(content, F.lit("HEADING:")), 0.05) + when(F.contains(content, F.lit("TITLE:")), 0.05)
    return F.when(F.coalesce(content, F.lit("")) == "", 0.0).otherwise(clamp(F.lit(0.5) + by_length + by_path + home + said + marks))


def url_priority(url: Column) -> Column:
    """Priority of a URL from its path."""
    path = F.lower(T.url_path(url))
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    by_words = F.when(T.any_of(path, L.HIGH_PATHS), 0.4).when(T.any_of(path, L.MEDIUM_PATHS), 0.3).when(T.any_of(path, L.LOW_PATHS), 0.2).otherwise(0.0)
    pages = when(path.rlike(r"/(page|p)/\d+") | path.rlike(r"/\d{4}/(0\d|1[0-2])"), -0.2)
    by_depth = F.when(depth <= 1, 0.1).when(depth >= 4, -0.1).otherwise(0.0)
    return F.lit(0.5) + by_words + pages + by_depth + when(T.url_query(url) != "", -0.1)


def topic_type(topic: Column, types: dict[str, list[str]] = L.TOPIC_TYPES) -> Column:
    """The first type with a word that is a part of the topic."""
    return F.coalesce(*[F.when(T.any_of(F.lower(topic), ws), F.lit(t)) for t, ws in types.items()], F.lit("GENERAL"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 when both are empty."""

    def of(x, y, both):
        return F.coalesce(F.try_divide(both, F.size(x) + F.size(y) - both), F.lit(0.0))

    return T.let(a, lambda x: T.let(b, lambda y: T.let(F.size(F.array_intersect(x, y)), lambda both: of(x, y, both))))


def questions_similar(a: Column, b: Column) -> Column:
    """Alike by words, or short and alike by edit distance."""
    wa, wb = F.array_distinct(T.words(a)), F.array_distinct(T.words(b))
    some = (F.size(wa) > 0) & (F.size(wb) > 0)
    short = (F.length(a) < 50) & (F.length(b) < 50)
    edits = F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))) < 0.3
    return some & ((jaccard(wa, wb) > 0.7) | (short & F.coalesce(edits, F.lit(False))))


def texts_too_similar(a: Column, b: Column) -> Column:
    """One inside the other if either is short, else by runs of three words."""
    return F.when((F.length(a) < 100) | (F.length(b) < 100), F.contains(a, b) | F.contains(b, a)).otherwise(jaccard(T.ngrams(T.words(a), 3), T.ngrams(T.words(b), 3)) > 0.8)


def bigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(T.ngrams(T.words(F.lower(a)), 2), T.ngrams(T.words(F.lower(b)), 2))


def question_terms(q: Column) -> Column:
    """Distinct lower-case words but stop words."""
    return F.array_except(F.array_distinct(T.words(F.lower(q))), F.array(*map(F.lit, L.STOP_WORDS)))


def sigmoid(x: Column) -> Column:
    """The logistic function, without overflow at either end."""
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))


def softmax(xs: Column) -> Column:
    """Probabilities from an array of scores."""

    def of(v, most):
        e = F.transform(v, lambda x: F.exp(x - most))
        return T.let(e, lambda y: T.let(F.aggregate(y, F.lit(0.0), lambda s, x: s + x), lambda n: F.transform(y, lambda x: x / n)))

    return T.let(F.transform(xs, lambda x: x.cast("double")), lambda v: T.let(F.array_max(v), lambda most: of(v, most)))


def relevance(q: Column, a: Column, model: Column | None = None) -> Column:
    """Share of the question's terms that the answer has; 0.3 of that and 0.7 of a
    model's probability if there is one."""
    said = T.let(question_terms(q), lambda terms: F.least(F.lit(1.0), T.matching_terms(terms, F.lower(a)) / F.greatest(F.lit(1), F.size(terms))))
    return said if model is None else F.lit(0.7) * model + F.lit(0.3) * said


def factuality(a: Column, context: Column, model: Column | None = None) -> Column:
    """By the answer's pairs of words that the context has, or by a model's
    probability if there is one; 0.5 without context."""
    if model is not None:
        return F.when(context.isNull(), 0.5).otherwise(model)
    theirs = T.ngrams(T.words(F.lower(context)), 2)

    def of(mine):
        share = F.try_divide(F.size(F.array_intersect(mine, theirs)), F.size(mine))
        return F.when(F.size(mine) == 0, 0.0).otherwise(F.lit(0.2) + F.lit(0.8) * share)

    return F.when(context.isNull(), 0.5).otherwise(T.let(T.ngrams(T.words(F.lower(a)), 2), of))


_UNENDED = r"[.!?]\z"


def completeness(q: Column, a: Column) -> Column:
    """By length, ending, artifacts and what the kind of question asks for."""
    n, ql, al = T.n_words(a), F.lower(q), F.lower(a)
    score = F.lit(0.5) + F.when(n < 15, -0.3).when(n > 50, 0.1).otherwise(0.0)
    score = score + when(~a.rlike(_UNENDED) & (F.length(a) > 20), -0.15) + when(a.rlike(r"\brn\b|\.{3,}|\.s\.|\s{3,}"), -0.1)
    score = score + F.when(F.startswith(a, F.lit("I don't have enough information")), F.when(F.length(a) < 70, -0.2).otherwise(-0.1)).otherwise(0.0)
    what = F.left(ql, F.lit(15)).rlike("is|are|was|were") & F.left(al, F.lit(50)).rlike("is|are|refers to|defined as|means")
    kinds = F.when(F.startswith(ql, F.lit("what")), when(what, 0.2))
    for start, said in (("how", "first|second|then|next|finally|by|through"), ("where", "located|at|in|on|near|building|room|floor|campus"), ("who", "staff|faculty|office|center|department|director|coordinator")):
        kinds = kinds.when(F.startswith(ql, F.lit(start)), when(al.rlike(said), 0.2))
    return clamp(score + kinds.otherwise(0.0))


def formatting(a: Column) -> Column:
    """1 less a factor for each fault of form."""
    score = F.when((F.length(a) > 20) & ~a.rlike(_UNENDED), 0.7).otherwise(1.0)
    score = score * F.when(F.contains(a, F.lit("I don't have enough information")) & (F.length(a) > 70), 0.8).otherwise(1.0)
    for pattern in (r"\.{3,}", r"\brn\b", r"\.s\.", r"\n{3,}", r"\s{3,}"):
        score = score * F.when(a.rlike(pattern), 0.85).otherwise(1.0)
    return score


def evaluation(q: Column, a: Column, context: Column, n_context: Column, judged: Column | None = None, checked: Column | None = None) -> Column:
    """All scores of an answer as a struct; all 0 for one of fewer than 15 characters."""
    few = n_context <= 1
    rel, fact, comp, form = relevance(q, a, judged), factuality(a, context, checked), completeness(q, a), formatting(a)
    rel = F.when(few, F.least(F.lit(1.0), rel * 1.2)).otherwise(rel)
    fact = F.when(few, F.greatest(F.lit(0.5), fact)).otherwise(fact)
    comp = comp * F.when((F.length(a) > 20) & ~a.rlike(_UNENDED), 0.8).otherwise(1.0)
    comp = comp * F.when(F.contains(a, F.lit("I don't have enough information")) & (F.length(a) > 70), 0.9).otherwise(1.0)
    comp = F.when(few, F.least(F.lit(1.0), comp * 1.2)).otherwise(comp)
    overall = F.when(few, rel * 0.35 + fact * 0.25).otherwise(rel * 0.25 + fact * 0.35) + comp * 0.25 + form * 0.15
    none = F.coalesce(F.length(a), F.lit(0)) < 15
    zero = lambda c: F.when(none, 0.0).otherwise(c)
    return F.struct(zero(rel).alias("relevance"), zero(fact).alias("factuality"), zero(comp).alias("completeness"), zero(form).alias("formatting"), zero(overall).alias("overall"))
