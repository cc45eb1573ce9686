"""Operator 9: secret scans with a random forest against false positives.

Native throughout: candidates, features and the forest's votes are SQL
expressions. A candidate is a run of 16 or more token characters with a digit
and a letter, or any value of four or more characters without white space or
quotes that is assigned to a word of secrets, whatever its signs. Its features are
length, character transitions, distinct
characters, share of digits and of hexadecimal characters, dictionary coverage,
words of secrets and of examples near it and in the row's path, a word for
other hashes near it, whether it is assigned and quoted, and known forms.

The forest is trained on the driver from labelled findings (``labelled``: at
most ``FINDINGS`` rows, built by rule with the kinds of secrets and of false
positives that scanners report), then written out as CASE expressions, so the
scan needs no Python on the executors, no shuffle and no broadcast.

Null and empty texts have no candidates; a null path counts as no path. Repeated
rows are scanned alike, null ids stay null, an empty table has no candidates, other
columns aren't read. Offsets count code points from 0. The starts of a text's
candidates are running sums in blocks, so a text with very many takes no quadratic time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled findings, trees, their depth, the least leaf and the vote that keeps a finding.
FINDINGS, TREES, DEPTH, LEAF, KEEP = 2400, 15, 5, 8, 0.5
#: Characters before and after a candidate that are its neighbourhood.
BEFORE, AFTER = 40, 24

CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}"
#: Candidates whose starts are summed up at once.
STARTS = 256
# Words that tell secrets, examples and other hashes; forms of known tokens.
SECRET_WORDS = "secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
EXAMPLE_WORDS = "example|sample|dummy|placeholder|changeme|your[_-]|test|fake|docs?/|xxxx|fixture"
HASH_WORDS = "commit|sha1|sha256|md5|digest|checksum|etag|integrity|uuid|guid|revision|version|href|http|src="
KNOWN_FORMS = "^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abp]-|^sk[-_](?:live|test|proj)?|^eyJ[A-Za-z0-9_-]+|^glpat-|^AIza"
#: What stands before an assigned value, and the value.
ASSIGNMENT = rf"(?<![A-Za-z])(?i:[a-z_-]{{0,20}}(?:{SECRET_WORDS})s?)[\"']?\s{{0,3}}(?:=>|:=|[:=])\s{{0,3}}[\"'`]?"
ASSIGNED = rf"{ASSIGNMENT}[^\s\"'`]{{3,}}[^\s\"'`,;.)\]}}>]"
#: Both forms; an assigned value is found with what stands before it.
EITHER = f"{ASSIGNED}|{CANDIDATE}"
#: Values that stand for others: variables, calls, placeholders.
STANDS_IN = r"^[$%<{*]|\(|\[|(?i)environ|getenv|^(?:none|null|true|false|required|optional|string|\*+|x+)$"
DICTIONARY = "about|account|admin|after|archive|assets|backup|class|client|config|content|count|data|default|delete|field|file|first|from|handler|header|image|index|input|internal|item|list|local|main|manager|message|model|module|name|number|object|order|output|page|part|path|process|product|public|query|record|report|request|response|result|script|server|service|session|static|status|string|style|system|table|template|text|title|type|update|user|value|version|widget|window|world"

FEATURES = ["length", "transitions", "distinct", "digits", "hexadecimal", "upper", "dictionary", "secret_near", "example_near", "hash_near", "path_example", "assigned", "quoted", "known", "signs", "stands_in"]


def features(candidate: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """The numbers the forest looks at."""
    n = F.length(candidate).cast("double")
    count = lambda pattern: F.regexp_count(candidate, F.lit(pattern)).cast("double")
    flag = lambda text, pattern: F.when(F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}"), 1.0).otherwise(0.0)
    change = "(?<=[a-z])(?=[A-Z0-9+/_-])|(?<=[A-Z])(?=[a-z0-9+/_-])|(?<=[0-9])(?=[A-Za-z+/_-])|(?<=[+/_-])(?=[A-Za-z0-9])"
    rest = F.length(F.regexp_replace(F.lower(candidate), DICTIONARY, "")).cast("double")
    return {
        "length": n,
        "transitions": count(change) / n,
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))).cast("double") / n,
        "digits": count("[0-9]") / n,
        "hexadecimal": count("[0-9a-fA-F]") / n,
        "upper": count("[A-Z]") / n,
        "dictionary": 1.0 - rest / n,
        "secret_near": flag(before, SECRET_WORDS),
        "example_near": flag(F.concat(before, candidate, after), EXAMPLE_WORDS),
        "hash_near": flag(before, HASH_WORDS),
        "path_example": flag(path, EXAMPLE_WORDS),
        "assigned": flag(before, r"[:=]\s*[\"']?$"),
        "quoted": F.when(before.rlike("[\"']$") & after.rlike("^[\"']"), 1.0).otherwise(0.0),
        "known": F.when(candidate.rlike(KNOWN_FORMS), 1.0).otherwise(0.0),
        "signs": count("[^0-9A-Za-z]") / n,
        "stands_in": F.when(candidate.rlike(STANDS_IN), 1.0).otherwise(0.0),
    }


def labelled(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings by rule: (candidate, before, after, path, label)."""
    h = lambda salt: F.md5(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")))
    pick = lambda salt, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(values))) + 1).cast("int"))
    b64 = F.translate(F.base64(F.unhex(F.concat(h("a"), h("b")))), "=", "")
    word = lambda salt: pick(salt, ["user", "config", "service", "template", "archive", "static", "widget", "report", "assets", "session"])
    key, other = pick("k", ["token", "secret", "api_key", "password", "access_key", "auth_token"]), pick("o", ["commit", "sha256", "etag", "md5", "revision", "checksum", "uuid"])
    equal, quote = pick("e", [" = ", ": ", "=", ":"]), pick("q", ['"', "'", "", '"'])
    prose, none = pick("p", ["the thing of and ", "on a page in ", "und die der ", "see also ", ""]), F.lit("")
    letters, digits, sign = F.regexp_replace(b64, "[0-9+/]", "q"), F.regexp_replace(h("r"), "[a-f]", ""), pick("s", ["!", "&", "#", "$9", "%", "@", "_", ""])
    secret_key = pick("k8", ["password", "passwd", "pwd", "secret", "token", "DB_PASSWORD", "api_key"])
    # (candidate, before, label)
    kinds = [
        (h("hex"), F.concat(prose, key, equal, quote), 1),
        (F.concat(h("x"), F.substring(h("y"), 1, 8)), F.concat(prose, key, equal, quote), 1),
        (b64, F.concat(prose, key, equal, quote), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(h("c"), 1, 16))), F.concat(prose, pick("k2", ["id ", "key = ", ""])), 1),
        (F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(prose, pick("k3", ["token: ", "", "use "])), 1),
        (F.substring(b64, 1, 24), F.concat(prose, key, equal, quote), 1),
        (h("d"), F.concat(prose, other, pick("e2", [" ", ": ", "="])), 0),
        (F.concat(h("f"), F.substring(h("g"), 1, 8)), F.concat(prose, other, pick("e3", [" ", ": ", "="])), 0),
        (F.concat_ws("_", word("w1"), word("w2"), word("w3"), F.substring(h("i"), 1, 2), F.lit("7")), F.concat(prose, pick("k4", ["file ", "key = ", "name: ", "token = "])), 0),
        (F.concat_ws("/", word("w4"), word("w5"), word("w6"), F.lit("v2")), F.concat(prose, pick("k5", ["src=", "path: ", "see "])), 0),
        (F.concat(F.lit("example_"), F.substring(h("j"), 1, 16)), F.concat(prose, key, equal, quote), 0),
        (F.concat(F.lit("xxxxxxxxxxxx"), F.substring(h("l"), 1, 6)), F.concat(prose, key, equal, quote), 0),
        (F.regexp_replace(h("m"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.concat(prose, pick("k6", ["id ", "uuid: ", "guid=", "request "])), 0),
        # passwords of words, digits and signs, and letters only
        (F.concat(word("v1"), F.substring(digits, 1, 3), sign), F.concat(prose, secret_key, equal, quote), 1),
        (F.concat(F.upper(F.substring(b64, 3, 1)), F.substring(b64, 5, 6), sign, F.substring(digits, 1, 2), F.substring(h("t"), 1, 3)), F.concat(prose, secret_key, equal, quote), 1),
        (F.lower(F.concat(F.substring(letters, 1, 6), F.substring(digits, 1, 1), F.substring(letters, 7, 6), sign)), F.concat(prose, secret_key, equal, quote), 1),
        (F.substring(letters, 1, 30), F.concat(prose, secret_key, equal, quote), 1),
        # what is assigned to such words without being one
        (pick("n1", ["required", "optional", "string", "None", "null", "true", "false", "changed", "reset", "expired", "invalid", "missing", "generation", "management"]), F.concat(prose, secret_key, equal, quote), 0),
        (F.concat(pick("n2", ["${", "os.environ[", "getenv(", "$", "<your-", "{{"]), F.upper(word("v2")), pick("n3", ["}", "]", ")", "", ">", "}}"])), F.concat(prose, secret_key, equal, quote), 0),
        (pick("n4", ["********", "xxxxxxxx", "changeme", "example", "your_password", "placeholder", "dummy", "test"]), F.concat(prose, secret_key, equal, quote), 0),
        (h("n"), F.concat(prose, pick("k7", ["https://a.example.net/", "href=", "image "])), 0),
    ]
    k = F.pmod(F.col("id"), F.lit(len(kinds)))
    choose = lambda at: F.coalesce(*[F.when(k == i, F.lit(x[at]) if at == 2 else x[at]) for i, x in enumerate(kinds)])
    return spark.range(n).select(choose(0).alias("candidate"), choose(1).alias("before"), F.when(quote == "", none).otherwise(quote).alias("after"), pick("path", ["src1", "web", "src7", "app/main"]).alias("path"), choose(2).alias("label"))


# --- the forest -------------------------------------------------------------


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
    """A node: a share of positives, or (feature, cut, left, right)."""
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAF or p in (0.0, 1.0):
        return p
    best = None
    for f in rng.choice(x.shape[1], size=max(2, round(x.shape[1] ** 0.5)), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= LEAF) & (at <= len(y) - LEAF)]
        if not len(at):
            continue
        left, right = s[at - 1] / at, (s[-1] - s[at - 1]) / (len(y) - at)
        gini = at * left * (1 - left) + (len(y) - at) * right * (1 - right)
        i = int(np.argmin(gini))
        if best is None or gini[i] < best[0]:
            best = (gini[i], int(f), float((v[at[i]] + v[at[i] - 1]) / 2))
    if best is None:
        return p
    below = x[:, best[1]] < best[2]
    return best[1], best[2], _grow(x[below], y[below], depth - 1, rng), _grow(x[~below], y[~below], depth - 1, rng)


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 9) -> list:
    """A random forest: bootstrap rows, a random few features a split."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(len(y), size=len(y))
        out.append(_grow(x[rows], y[rows], depth, rng))
    return out


def vote(forest: list, x: np.ndarray) -> np.ndarray:
    """The forest's mean vote for rows of features."""

    def walk(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] < node[1] else node[3]
        return node

    return np.array([sum(walk(t, r) for t in forest) / len(forest) for r in x])


def as_sql(node) -> str:
    """A tree as a CASE expression over the feature columns."""
    if not isinstance(node, tuple):
        return f"{node!r}D"
    return f"CASE WHEN {FEATURES[node[0]]} < {node[1]!r}D THEN {as_sql(node[2])} ELSE {as_sql(node[3])} END"


def fit(findings: DataFrame) -> list:
    """The forest of labelled findings (bounded; a few numbers a row go to the driver)."""
    f = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    rows = findings.orderBy(F.xxhash64("candidate", "before", "after", "path", "label"), "candidate").limit(4 * FINDINGS)
    rows = rows.select(*[f[k].alias(k) for k in FEATURES], "label").collect()
    x = np.array([[r[k] for k in FEATURES] for r in rows], float)
    return train(x, np.array([r.label for r in rows], float))


def _running(lengths: Column) -> Column:
    """Running sums of an array of numbers, block by block."""
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / STARTS).cast("int") - 1, F.lit(0)))
    block = lambda b: F.slice(lengths, b * STARTS + 1, F.lit(STARTS))
    none = F.array().cast("array<int>")
    add = lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))))
    before = F.aggregate(F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda x, y: x + y)), none, add)
    # the sums before the blocks are made once and handed in
    return F.flatten(F.flatten(F.transform(F.array(before), lambda sums: F.transform(blocks, lambda b: F.transform(F.aggregate(block(b), none, add), lambda x: x + F.coalesce(F.get(sums, b - 1), F.lit(0)))))))


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """(id, start, candidate, before, after, path) for every candidate."""
    text = F.col(text_col)
    hit = docs.where(text.rlike(EITHER)).select(F.col(id_col), text.alias("_t"), F.col(path_col).alias("path"))
    found = F.regexp_extract_all("_t", F.lit(EITHER), F.lit(0))
    gaps = F.split("_t", EITHER, -1)
    hit = hit.withColumns({"_found": found, "_gaps": gaps})
    # the start of match i: all gaps up to i and all matches before it
    lengths = F.transform("_gaps", lambda g, i: F.length(g) + F.when(i == 0, 0).otherwise(F.length(F.get(F.col("_found"), i - 1))))
    hit = hit.withColumn("_lengths", lengths).withColumn("_starts", _running(F.col("_lengths")))
    part = lambda array, i: F.coalesce(F.get(array, i), F.lit(""))
    # a match has 8 characters or more, so that these few cover its neighbourhood
    before = lambda i: F.concat(*[part(a, i - k + int(a == "_gaps")) for k in range(6, 0, -1) for a in ("_found", "_gaps")])
    after = lambda i: F.concat(*[part(a, i + k) for k in range(1, 5) for a in ("_gaps", "_found")])
    item = lambda start, i: F.struct(start.cast("long").alias("at"), F.get("_found", i).alias("match"), F.right(before(i), F.lit(BEFORE)).alias("before"), F.left(after(i), F.lit(AFTER)).alias("after"))
    hit = hit.select(id_col, "path", F.explode(F.transform(F.slice("_starts", 1, F.size("_found")), item)).alias("_c"))
    # an assigned value begins behind what assigns it
    lead = F.regexp_extract("_c.match", "^" + ASSIGNMENT, 0)
    hit = hit.withColumn("_lead", F.when(F.col("_c.match").rlike(f"^(?:{ASSIGNED})"), lead).otherwise(""))
    return hit.select(id_col, (F.col("_c.at") + F.length("_lead")).alias("start"), F.substr("_c.match", F.length("_lead") + 1).alias("candidate"), F.right(F.concat("_c.before", "_lead"), F.lit(BEFORE)).alias("before"), F.col("_c.after").alias("after"), F.coalesce("path", F.lit("")).alias("path"))


def scan(docs: DataFrame, forest: list | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """All candidates with the forest's vote: id, start, length, candidate_sha256,
    score, is_secret."""
    forest = fit(labelled(docs.sparkSession)) if forest is None else forest
    found = candidates(docs, id_col, text_col, path_col)
    f = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    told = found.select(id_col, "start", F.length("candidate").cast("long").alias("_n"), F.sha2("candidate", 256).alias("candidate_sha256"), *[f[k].alias(k) for k in FEATURES])
    score = sum((F.expr(as_sql(t)) for t in forest), F.lit(0.0)) / len(forest)
    told = told.withColumn("score", F.round(score, 6))
    return told.select(id_col, "start", F.col("_n").alias("length"), "candidate_sha256", "score", (F.col("score") >= KEEP).alias("is_secret"))
