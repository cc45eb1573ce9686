"""Column functions over texts: cleaning, words, sentences, n-grams, URLs, answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists as L

WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, also where lambdas use it many times."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def replaced(c: Column, *steps: tuple[str, str]) -> Column:
    """A chain of global regular-expression replacements."""
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """What white space leaves; none for the empty text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens, joined by spaces."""

    def of(t):
        runs = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)]))
        return F.when(F.size(t) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return let(tokens, of)


def any_of(c: Column, values: list[str]) -> Column:
    """Whether any of the values is a part of the text."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(v)) for v in values])


def count_of(c: Column, values: list[str]) -> Column:
    """How many of the values are parts of the text."""
    return sum((F.contains(c, F.lit(v)).cast("int") for v in values), F.lit(0)).cast("long")


def matching_terms(terms: Column, text: Column) -> Column:
    """How many of an array's terms are parts of the text."""
    return let(text, lambda x: F.size(F.filter(terms, lambda t: F.contains(x, t)))).cast("long")


# --- cleaning -----------------------------------------------------------------


def clean_text(c: Column) -> Column:
    """Ingested page text: white space, broken quotes, entities, headers. White
    space goes first, so paragraph breaks don't outlive it."""
    c = F.regexp_replace(c, r"\s+", " ")
    for old, new in (("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"')):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = replaced(c, (r"\.([A-Z])", ". $1"), ("HEADING: ", "\n## "), ("TITLE: ", "# "), ("CONTENT: ", "\n"))
    return strip(c)


def clean_chunk(c: Column) -> Column:
    """Text for a context."""
    return strip(replaced(c, ("&nbsp;|&amp;|&lt;|&gt;|&quot;", " "), (r"\.{2,}", ". "), (r"\s+", " "), (r"rn\s", " "), (r"\.s\.", "."), (r"#\s+", "## ")))


def title_of(c: Column) -> Column:
    """The title that the marker of a page's text gives."""
    return F.regexp_extract(c, r"TITLE: (.*?)(\n|$)", 1)


def clean_question(c: Column) -> Column:
    """A question without prompt leftovers, with a capital and a question mark."""
    c = strip(F.regexp_replace(c, r"^(Question:|Q:|Step \d+:)", ""))
    c = F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))
    c = F.when((c != "") & ~F.endswith(c, F.lit("?")), F.concat(c, F.lit("?"))).otherwise(c)
    return F.regexp_replace(c, r"(?i)^(What|How|Why|Where|When|Who)\s+(is|are|can|does|do|did)\s+\1\s+", "$1 $2 ")


def fix_structure(c: Column) -> Column:
    """An answer without instruction leftovers and a repeated beginning."""
    c = strip(F.regexp_replace(c, r"^(Answer:|ANSWER:|Step \d+:|To answer this question:)", ""))
    for start in ("Based on", "According to"):
        c = strip(F.regexp_replace(c, start + r" the (provided|given|available) (context|information),?\s*", ""))

    def unrepeated(w):
        low = F.transform(w, lambda x: F.lower(x))
        first = F.slice(low, 1, 5)
        again = F.filter(F.sequence(F.lit(1), F.least(F.lit(10), F.size(w) - 5) - 1), lambda i: F.slice(low, i + 1, 5) == first)
        return F.when(F.size(w) > 10, F.when(F.size(again) > 0, F.array_join(F.slice(w, F.get(again, F.lit(0)) + 1, F.size(w)), " ")))

    return F.coalesce(let(words(c), unrepeated), c)


def clean_artifacts(c: Column) -> Column:
    """An answer without formatting artifacts (this also deletes "rn" inside words)."""
    steps = [(r"\r\n|\r", "\n"), (r"\n{2,}", "\n\n"), (r"[ \t]+", " "), (r"\.{2,}", ". "), (r'"{2,}', '"'), (r"'{2,}", "'"), (r"\.s\.", "."), (r"(?<![\p{L}\p{N}_])n\s", " "), ("rn", ""), (r"(\d+)\)\s*", "$1. ")]
    return strip(replaced(c, *steps))


def fix_ending(c: Column) -> Column:
    """A whole sentence at the end: cut behind the last one if that keeps more
    than 0.7 of the text, else closed by a period."""
    last = F.length(c) - F.length(F.substring_index(F.translate(c, "!?", ".."), ".", -1)) - 1
    cut = F.when(last > F.lit(0.7) * F.length(c), F.left(c, last + 1)).otherwise(F.concat(c, F.lit(".")))
    return F.when((c == "") | c.rlike(r"[.!?]$"), c).otherwise(cut)


def fix_capital(c: Column) -> Column:
    """A capital at the start, and no filler at the end."""
    c = F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))
    return replaced(c, *[(p, ".") for p in L.FILLERS])


def format_answer(c: Column) -> Column:
    """All steps of an answer's format."""
    after = strip(F.substr(c, F.locate(".", c) + 1))
    declined = F.startswith(c, F.lit("I don't have enough information"))
    goes_on = (F.locate(".", c) > 0) & (F.length(after) > 30)
    body = fix_capital(fix_ending(clean_artifacts(fix_structure(F.when(declined, after).otherwise(c)))))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(L.NO_ANSWER)).when(declined & ~goes_on, F.lit(L.NOT_COMPLETE)).otherwise(body)


def answer_after_steps(c: Column) -> Column:
    """Text behind the last numbered step, else behind "Answer:", else all."""
    step = F.regexp_extract(c, r"(?s).*Step \d+:(.*)$", 1)
    said = F.regexp_extract(c, r"(?s)Answer:(.*)$", 1)
    return F.when(c.rlike(r"Step \d+:"), strip(step)).when(F.contains(c, F.lit("Answer:")), strip(said)).otherwise(c)


def signature(c: Column) -> Column:
    """First ten of an answer's sorted words but stop words."""
    kept = F.filter(words(F.lower(c)), lambda w: ~w.isin(L.STOP_WORDS))
    return F.array_join(F.slice(F.array_sort(kept), 1, 10), " ")


def is_disclaimer(c: Column) -> Column:
    """Whether an answer only declines."""
    said = reduce(lambda a, b: a | b, [strip(c).rlike(p) for p in L.DISCLAIMERS])
    return said | ((n_words(c) < 20) & F.contains(F.lower(c), F.lit("don't have")))


def is_valid_content(c: Column) -> Column:
    """Long enough, with enough words, and not what turns robots away."""
    return (F.length(c) >= 50) & ~c.rlike("(?i)" + "|".join(L.BOT_PATTERNS)) & (F.regexp_count(c, F.lit(WORD)) >= 10)


# --- sentences ----------------------------------------------------------------

_ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Co|Sr|Jr"
# Ph.D., M.D., B.A., M.A., i.e. and e.g., of which none overlap but i.e. before e.g.
_DOTTED = r"\b(?=Ph\.D\.|M\.D\.|B\.A\.|M\.A\.|i\.e\.|e\.g\.)([A-Za-z]+)\.([A-Za-z])\."


def sentences(c: Column) -> Column:
    """Sentences by rule: abbreviations, decimals and hosts don't end one."""
    c = F.regexp_replace(c, rf"\b({_ABBREVIATIONS})\.", "$1<PERIOD>")
    c = replaced(c, (_DOTTED, "$1<PERIOD>$2<PERIOD>"), (r"(\d+)\.(\d+)", "$1<PERIOD>$2"), (r"(www\.)|(http\.)", "$1<PERIOD>"))
    parts = F.split(c, r"(?<=[.!?])\s+(?=[A-Z])")
    parts = F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"([.!?])\n$", "$1")), lambda s: s.rlike(r"\S"))
    parts = F.transform(parts, lambda s: F.replace(s, F.lit("<PERIOD>"), F.lit(".")))
    return F.transform(parts, lambda s: F.when(s.rlike(r"[.!?]\n?$"), s).otherwise(F.concat(s, F.lit("."))))


def groups_of(items: Column, n: int) -> Column:
    """Runs of n items, joined by spaces; the last may be shorter."""

    def of(x):
        at = F.sequence(F.lit(1), F.size(x), F.lit(n))
        return F.when(F.size(x) > 0, F.transform(at, lambda i: F.array_join(F.slice(x, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(items, of)


def windows_of(items: Column, size: int = 10, stride: int = 8, least: int = 3) -> Column:
    """Sliding windows of items, joined by spaces, while they hold enough."""

    def of(x):
        at = F.filter(F.sequence(F.lit(1), F.size(x), F.lit(stride)), lambda i: F.size(x) - i + 1 >= least)
        return F.when(F.size(x) > 0, F.transform(at, lambda i: F.array_join(F.slice(x, i, size), " "))).otherwise(F.array().cast("array<string>"))

    return let(items, of)


# --- URLs ----------------------------------------------------------------------


def url_scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def _without_dots(path: Column) -> Column:
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    end = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise("")
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.array_join(kept, "/"), end)).otherwise(path)


def join_url(base: Column, href: Column) -> Column:
    """A reference made absolute, cut to scheme, host and path."""
    site = F.concat(url_scheme(base), F.lit("://"), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    folder = F.regexp_extract(url_path(base), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    absolute = F.concat(url_scheme(href), F.lit("://"), F.regexp_extract(href, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), _without_dots(url_path(href)))
    other_host = F.concat(url_scheme(base), F.lit(":"), path)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), absolute)
        .when(href.startswith("//"), other_host)
        .when(path == "", F.concat(site, url_path(base)))
        .when(href.startswith("/"), F.concat(site, _without_dots(path)))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, path))))
    )
