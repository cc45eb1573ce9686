"""DuckDB SQL that the registered queries must agree with."""

from __future__ import annotations

from ..functions import lists as L


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _array(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


STOP = _array(L.STOP_WORDS)
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def any_of(x: str, values) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(v)})" for v in values) + ")"


def count_of(x: str, values) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {_q(v)}) AS INTEGER)" for v in values) + ")"


def ngrams(w: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - {n - 2}, 1)), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')))"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"coalesce({both}::DOUBLE / nullif(len({a}) + len({b}) - {both}, 0), 0)"


def clean(x: str) -> str:
    x = rf"regexp_replace({x}, '\s+', ' ', 'g')"
    for old, new in (("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"')):
        x = f"replace({x}, {_q(old)}, {_q(new)})"
    x = rf"regexp_replace({x}, '\.([A-Z])', '. \1', 'g')"
    for old, new in (("HEADING: ", "chr(10) || '## '"), ("TITLE: ", "'# '"), ("CONTENT: ", "chr(10)")):
        x = f"replace({x}, {_q(old)}, {new})"
    return strip(x)


def sentences(x: str) -> str:
    x = rf"regexp_replace({x}, '\b(Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Co|Sr|Jr)\.', '\1<PERIOD>', 'g')"
    for d in ("Ph.D.", "M.D.", "B.A.", "M.A.", "i.e.", "e.g."):
        x = rf"regexp_replace({x}, '\b{d.replace('.', chr(92) + '.')}', '{d.replace('.', '<PERIOD>')}', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '(\d+)\.(\d+)', '\1<PERIOD>\2', 'g'), '(www\.)|(http\.)', '\1<PERIOD>', 'g')"
    x = rf"string_split(regexp_replace({x}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    x = rf"list_filter(list_transform({x}, lambda s: regexp_replace(s, '([.!?])\n$', '\1')), lambda s: {strip('s')} <> '')"
    x = f"list_transform({x}, lambda s: replace(s, '<PERIOD>', '.'))"
    return rf"list_transform({x}, lambda s: CASE WHEN regexp_matches(s, '[.!?]\n?$') THEN s ELSE s || '.' END)"


def pages_main(x: str = "html") -> str:
    t = rf"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "svg", "iframe", "form", "nav", "footer"):
        t = rf"regexp_replace({t}, '(?is)<{tag}\b.*?</{tag}\s*>', '', 'g')"
    return t


def decode(x: str) -> str:
    for name, ch in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {_q(name)}, {_q(ch)})"
    return x


PAGE_TEXT = rf"""
  SELECT page_id, url, title, CASE WHEN title <> '' THEN 'TITLE: ' || title || chr(10) || chr(10) ELSE '' END
    || regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(body, '<[^>]+>', chr(1), 'g'), chr(1)), lambda x: {strip(decode('x'))}), lambda x: x <> ''), chr(10) || chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g') AS text
  FROM (SELECT page_id, url, {strip(decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title,
      CASE WHEN regexp_extract(t, '(?is)<article\b[^>]*>(.*)</article>', 1) <> '' THEN regexp_extract(t, '(?is)<article\b[^>]*>(.*)</article>', 1)
        ELSE regexp_extract(t, '(?is)<body\b[^>]*>(.*)</body>', 1) END AS body
    FROM (SELECT page_id, url, html, {pages_main()} AS t FROM pages))"""

LINKS = rf"""
  SELECT page_id, u AS dst_url FROM (
    SELECT page_id, unnest(list_distinct(list_transform(
      list_filter(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']', 1), lambda h: h <> '' AND NOT regexp_matches(h, '^(javascript:|#|mailto:|tel:)')),
      lambda h: CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || regexp_extract({decode('h')}, '^([^?#]*)', 1)
        ELSE regexp_extract({decode('h')}, '^([^?#]*)', 1) END))) AS u
    FROM pages)"""

PAIRS = r"""
  SELECT q.conv_id * 2147483648 + q.turn AS pos, q.conv_id, q.turn, q.text AS question, a.text AS answer, 'conv://' || q.conv_id AS source_url,
    (SELECT string_agg(c.text, ' ' ORDER BY c.turn) FROM conversations c WHERE c.conv_id = q.conv_id AND c.turn NOT IN (q.turn, q.turn + 1)) AS context,
    (SELECT count(*) FROM conversations c WHERE c.conv_id = q.conv_id AND c.turn NOT IN (q.turn, q.turn + 1)) AS n_context
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant'"""

_TERMS = f"list_filter(list_distinct({words('lower(question)')}), lambda w: NOT list_contains({STOP}, w))"
_REL = f"least(1.0::DOUBLE, len(list_filter({_TERMS}, lambda t: contains(lower(answer), t)))::DOUBLE / greatest(1, len({_TERMS})))"
_MINE, _THEIRS = ngrams(words("lower(answer)"), 2), ngrams(words("lower(context)"), 2)
_FACT = f"CASE WHEN context IS NULL THEN 0.5::DOUBLE WHEN len({_MINE}) = 0 THEN 0.0::DOUBLE ELSE 0.2::DOUBLE + 0.8::DOUBLE * len(list_intersect({_MINE}, {_THEIRS})) / len({_MINE}) END"
_END = r"regexp_matches(answer, '[.!?]\z')"
_BAD_FORM = r"regexp_matches(answer, '\brn\b|\.{3,}|\.s\.|\s{3,}')"
_DECLINES = _q("I don't have enough information")


def _score(x: str) -> str:
    return f"{x}::DOUBLE"


_COMP = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE
    + CASE WHEN len({words('answer')}) < 15 THEN -0.3 WHEN len({words('answer')}) > 50 THEN 0.1 ELSE 0.0 END::DOUBLE
    + CASE WHEN NOT {_END} AND length(answer) > 20 THEN -0.15 ELSE 0.0 END::DOUBLE + CASE WHEN {_BAD_FORM} THEN -0.1 ELSE 0.0 END::DOUBLE
    + CASE WHEN starts_with(answer, {_DECLINES}) THEN CASE WHEN length(answer) < 70 THEN -0.2 ELSE -0.1 END ELSE 0.0 END::DOUBLE
    + CASE WHEN starts_with(lower(question), 'what') THEN CASE WHEN regexp_matches(left(lower(question), 15), 'is|are|was|were') AND regexp_matches(left(lower(answer), 50), 'is|are|refers to|defined as|means') THEN 0.2 ELSE 0.0 END
        WHEN starts_with(lower(question), 'how') THEN CASE WHEN regexp_matches(lower(answer), 'first|second|then|next|finally|by|through') THEN 0.2 ELSE 0.0 END
        WHEN starts_with(lower(question), 'where') THEN CASE WHEN regexp_matches(lower(answer), 'located|at|in|on|near|building|room|floor|campus') THEN 0.2 ELSE 0.0 END
        WHEN starts_with(lower(question), 'who') THEN CASE WHEN regexp_matches(lower(answer), 'staff|faculty|office|center|department|director|coordinator') THEN 0.2 ELSE 0.0 END
        ELSE 0.0 END::DOUBLE))"""
_FORM = f"(CASE WHEN length(answer) > 20 AND NOT {_END} THEN 0.7 ELSE 1.0 END::DOUBLE * CASE WHEN contains(answer, {_DECLINES}) AND length(answer) > 70 THEN 0.8 ELSE 1.0 END::DOUBLE" + "".join(
    f" * CASE WHEN regexp_matches(answer, '{p}') THEN 0.85 ELSE 1.0 END::DOUBLE" for p in (r"\.{3,}", r"\brn\b", r"\.s\.", r"\n{3,}", r"\s{3,}")
) + ")"

EVALUATED = f"""
  SELECT pos, conv_id, turn, question, answer, source_url, context, n_context,
    CASE WHEN length(answer) < 15 THEN 0.0 ELSE round(rel, 6) END AS relevance, CASE WHEN length(answer) < 15 THEN 0.0 ELSE round(fact, 6) END AS factuality,
    CASE WHEN length(answer) < 15 THEN 0.0 ELSE round(comp, 6) END AS completeness, CASE WHEN length(answer) < 15 THEN 0.0 ELSE round(form, 6) END AS formatting,
    CASE WHEN length(answer) < 15 THEN 0.0 ELSE round(CASE WHEN n_context <= 1 THEN rel * 0.35::DOUBLE + fact * 0.25::DOUBLE ELSE rel * 0.25::DOUBLE + fact * 0.35::DOUBLE END + comp * 0.25::DOUBLE + form * 0.15::DOUBLE, 6) END AS overall
  FROM (SELECT *, CASE WHEN n_context <= 1 THEN least(1.0::DOUBLE, rel0 * 1.2::DOUBLE) ELSE rel0 END AS rel, CASE WHEN n_context <= 1 THEN greatest(0.5::DOUBLE, fact0) ELSE fact0 END AS fact,
      CASE WHEN n_context <= 1 THEN least(1.0::DOUBLE, comp1 * 1.2::DOUBLE) ELSE comp1 END AS comp
    FROM (SELECT *, comp0 * CASE WHEN length(answer) > 20 AND NOT {_END} THEN 0.8 ELSE 1.0 END::DOUBLE * CASE WHEN contains(answer, {_DECLINES}) AND length(answer) > 70 THEN 0.9 ELSE 1.0 END::DOUBLE AS comp1
      FROM (SELECT *, {_REL} AS rel0, {_FACT} AS fact0, {_COMP} AS comp0, {_FORM} AS form FROM ({PAIRS}))))"""

SIGNATURE = f"array_to_string(list_sort(list_filter({words('lower(answer)')}, lambda w: NOT list_contains({STOP}, w)))[1:10], ' ')"

_MATCH = f"SELECT b.item_id, d.doc_id, d.source, b.terms, len(list_filter(b.terms, lambda t: contains(d.low, t))) AS matches, d.low, b.phrases FROM b CROSS JOIN d"
_RUNS = " || ".join(f"list_transform(range(1, greatest(len(terms) - {n - 2}, 1)), lambda i: array_to_string(terms[i:i + {n - 1}], ' '))" for n in (2, 3, 4))

_HITS = "SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0"


def topk(hits: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ({hits})) WHERE rank <= {k}"


_TYPE = "CASE " + " ".join(f"WHEN {any_of('lower(text)', ws)} THEN {_q(t)}" for t, ws in L.FIXTURE_TYPES.items()) + " ELSE 'GENERAL' END"
_QUALITY_URL = "'https://site.example/' || source"
_N = f"len({words('text')})"

def type_of(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(f'lower({x})', ws)} THEN {_q(t)}" for t, ws in L.FIXTURE_TYPES.items()) + " ELSE 'GENERAL' END"


_NL2 = "chr(10) || chr(10)"
_GROUPS = "list_transform(range(0, (len(s) + 4) // 5), lambda i: array_to_string(s[i * 5 + 1:i * 5 + 5], ' '))"
_PACKED = """list_reduce(list_transform(p, lambda x: {'chunks': []::VARCHAR[], 'cur': [x], 'len': length(x)}),
    lambda a, x: CASE WHEN a.len > 0 AND a.len + x.len > 1000 THEN {'chunks': a.chunks || [array_to_string(a.cur, ' ')], 'cur': [a.cur[-1], x.cur[1]], 'len': 2 * x.len}
      ELSE {'chunks': a.chunks, 'cur': a.cur || x.cur, 'len': a.len + x.len} END)"""


def packed(source: str) -> str:
    """(doc_id, doc_url, t, c): the packed paragraphs c of texts t of ``source``."""
    return f"""SELECT doc_id, doc_url, t, r.chunks || [array_to_string(r.cur, ' ')] AS c FROM (SELECT doc_id, doc_url, t, {_PACKED} AS r FROM (
      SELECT doc_id, doc_url, t, CASE WHEN contains(t, {_NL2}) THEN list_filter(list_transform(string_split(t, {_NL2}), lambda x: {strip('x')}), lambda x: x <> '') ELSE {_GROUPS} END AS p
      FROM (SELECT *, {sentences('t')} AS s FROM ({source}))) WHERE len(p) > 0)"""


_URL = "'doc://' || source || '/' || doc_id"
#: CTEs with the chunks of all documents: (doc_url, chunk_ord, idx, text).
CHUNKS = f"""WITH texts AS MATERIALIZED (SELECT doc_id, {_URL} AS doc_url, {clean('text')} AS t FROM documents),
whole AS (SELECT doc_url, [t] AS c FROM texts WHERE contains(t, '#') UNION ALL SELECT doc_url, c FROM ({packed("SELECT * FROM texts WHERE length(t) > 0 AND NOT contains(t, '#')")})),
base AS MATERIALIZED (SELECT doc_url, j - 1 AS i, c[j] AS c FROM (SELECT doc_url, c, unnest(range(1, len(c) + 1)) AS j FROM whole)),
chunks AS MATERIALIZED (
  SELECT doc_url, CAST(row_number() OVER (PARTITION BY doc_url ORDER BY i, k) - 1 AS INTEGER) AS chunk_ord, CAST(CASE WHEN k < 0 THEN i ELSE i * 100 + k END AS INTEGER) AS idx, text FROM (
    SELECT doc_url, i, -1 AS k, c AS text FROM base WHERE length(c) <= 1500
    UNION ALL SELECT doc_url, i, k, array_to_string(s[k * 8 + 1:k * 8 + 10], ' ') FROM (SELECT doc_url, i, s, unnest(range(0, (len(s) + 7) // 8)) AS k FROM (SELECT doc_url, i, {sentences('c')} AS s FROM base WHERE length(c) > 1500)) WHERE len(s) - k * 8 >= 3)),
topics AS MATERIALIZED (SELECT doc_url, topic, {type_of('topic')} AS topic_type FROM (
  SELECT doc_url, topic, row_number() OVER (PARTITION BY doc_url ORDER BY count(*) DESC, topic) AS r FROM (
    SELECT {_URL} AS doc_url, unnest(list_filter({words('lower(text)')}, lambda w: length(w) > 5 AND regexp_matches(w, '^[a-z]+$'))) AS topic FROM documents) GROUP BY doc_url, topic) WHERE r = 1)"""
CONTENT = f"""{CHUNKS},
met AS (SELECT t.doc_url, t.topic, t.topic_type, c.chunk_ord, c.text, coalesce(sum(length(c.text)) OVER (PARTITION BY t.doc_url, t.topic ORDER BY c.chunk_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM topics t JOIN chunks c ON c.doc_url = t.doc_url AND contains(lower(c.text), t.topic)),
content AS MATERIALIZED (SELECT doc_url, topic, topic_type, string_agg(piece, ' ' ORDER BY chunk_ord) AS content, count(*) AS n_chunks FROM (
  SELECT *, CASE WHEN before + length(text) <= 1000 THEN text WHEN before <= 1000 AND 1000 - before > 100 THEN left(text, CAST(1000 - before AS INTEGER)) END AS piece FROM met) WHERE piece IS NOT NULL GROUP BY doc_url, topic, topic_type)"""
RULES = f"""{CHUNKS},
said AS (SELECT doc_url, topic, topic_type, chunk_ord, i, m[i] AS s FROM (SELECT doc_url, topic, topic_type, chunk_ord, m, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT t.doc_url, t.topic, t.topic_type, c.chunk_ord, list_filter({sentences('c.text')}, lambda s: contains(lower(s), t.topic)) AS m FROM topics t JOIN chunks c ON c.doc_url = t.doc_url AND contains(lower(c.text), t.topic)))),
first3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_url, topic ORDER BY chunk_ord, i) AS pos FROM said) WHERE pos <= 3),
rules AS MATERIALIZED (
  SELECT doc_url, topic, topic_type, pos, CASE WHEN regexp_matches(lower(s), 'is|are|was|were|will be') THEN 'What is ' || topic || ' and what does it offer?'
      WHEN regexp_matches(lower(s), 'can|could|may|might|should') THEN 'How can students use ' || topic || '?' WHEN regexp_matches(lower(s), 'located|found|available|offered|provided') THEN 'Where can students access ' || topic || '?'
      WHEN regexp_matches(lower(s), 'eligible|qualify|qualifies|requirement') THEN 'Who is eligible for ' || topic || '?' END AS text, 0.65::DOUBLE AS quality_score FROM first3
  UNION ALL SELECT doc_url, topic, topic_type, 1, CASE topic_type WHEN 'SERVICE' THEN 'What services does ' || topic || ' provide?' WHEN 'LOCATION' THEN 'Where is ' || topic || ' located on campus?'
      WHEN 'PROGRAM' THEN 'What is the purpose of the ' || topic || ' program?' ELSE 'What information is available about ' || topic || '?' END, 0.6::DOUBLE
    FROM topics t WHERE NOT EXISTS (SELECT 1 FROM first3 f WHERE f.doc_url = t.doc_url AND f.topic = t.topic)),
asked AS (SELECT * FROM rules WHERE text IS NOT NULL)"""


def entity_sql(pattern: str, label: str) -> str:
    # signs of words beyond ASCII stand as "_" here, so that \b means the same
    p = _q(pattern)
    return f"""SELECT doc_id, ms[i] AS text, '{label}' AS label, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS INTEGER) AS from_pos
  FROM (SELECT doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS gaps FROM plain))"""


_ENTITIES = " UNION ALL ".join(entity_sql(p, label) for p, label in L.ENTITY_PATTERNS)
_LENGTH = "CASE WHEN length(c) < 20 THEN length(c) / 20.0::DOUBLE WHEN length(c) < 50 THEN 0.5::DOUBLE + (length(c) - 20) / 60.0::DOUBLE WHEN length(c) <= 200 THEN 1.0::DOUBLE ELSE greatest(0.5::DOUBLE, 1.0::DOUBLE - (length(c) - 200) / 800.0::DOUBLE) END"
_CAND = ngrams(words("lower(c)"), 2)
_CTX = ngrams(words("lower(coalesce(context, ''))"), 2)
_MARK = f"0.3::DOUBLE * ({_LENGTH}) + 0.7::DOUBLE * coalesce(len(list_intersect({_CAND}, theirs))::DOUBLE / nullif(len({_CAND}), 0), 0)"
_ROOT = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_SITE = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_SCHEME = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_SEEDS = "[url, " + ", ".join(f"root || {_q(p)}" for p in [*L.PRIORITY_PATHS, *L.SEED_PATHS]) + ", scheme || '://' || CASE WHEN starts_with(host, 'www.') THEN substring(host, 5) ELSE 'www.' || host END || path] || CASE WHEN scheme = 'http' THEN ['https://' || host || path] ELSE [] END"
_KEYS = sorted(L.FIXTURE_KEYWORDS)
_PROMPT = lambda p: _q(p.split("%s")[0]) + " || topic || " + _q(p.split("%s")[1]) + " || tail"
_PROMPTS = ", ".join(
    [_PROMPT(L.TOPIC_PROMPT)]
    + [f"CASE WHEN topic_type = '{t}' THEN {_PROMPT(p)} END" for t, ps in L.TYPE_PROMPTS.items() for p in ps]
    + ["'Based on this content, create a thoughtful question about ' || topic || ':' || chr(10) || chr(10) || 'Content: ' || content || chr(10) || chr(10) || 'Step 1: Identify the most important information about ' || topic || '.' || chr(10) || 'Step 2: Consider what students would want to know about ' || topic || '.' || chr(10) || 'Step 3: Formulate a clear, specific question.' || chr(10) || 'Question:'"]
    + [f"CASE WHEN {any_of('lower(content)', ws)} THEN {_PROMPT(p)} END" for ws, p in L.WORD_PROMPTS]
)
_SUMMARY = f"""{CHUNKS},
kept AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_url ORDER BY chunk_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks),
summary AS (SELECT doc_url, left(c, 1000) AS head, substring(c, 501, 1000) AS rest FROM (SELECT doc_url, string_agg(text, ' ' ORDER BY chunk_ord) AS c FROM kept WHERE before <= 1500 GROUP BY doc_url))"""
_CLEAN_CHUNK = strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '&nbsp;|&amp;|&lt;|&gt;|&quot;', ' ', 'g'), '\.{2,}', '. ', 'g'), '\s+', ' ', 'g'), 'rn\s', ' ', 'g'), '\.s\.', '.', 'g'), '#\s+', '## ', 'g')")

_ART = "text"
for _a, _b in ((r"\r\n|\r", "\n"), (r"\n{2,}", "\n\n"), (r"[ \t]+", " "), (r"\.{2,}", ". "), (r'"{2,}', '"'), (r"'{2,}", "'"), (r"\.s\.", "."), (r"(^|[^\p{L}\p{N}_])n\s", r"\1 "), ("rn", ""), (r"(\d+)\)\s*", r"\1. ")):
    _ART = f"regexp_replace({_ART}, {_q(_a)}, {_q(_b)}, 'g')"
_ART = strip(_ART)
ORACLES = {
    "page_url_parts": r"SELECT page_id, split_part(regexp_replace(url, 'https?://', '', 'g'), '/', 1) AS domain, split_part(url, '/', -1) AS last_segment FROM pages",
    "page_url_priority": rf"""
SELECT page_id, round(0.5::DOUBLE + CASE WHEN {any_of('p', L.HIGH_PATHS)} THEN 0.4 WHEN {any_of('p', L.MEDIUM_PATHS)} THEN 0.3 WHEN {any_of('p', L.LOW_PATHS)} THEN 0.2 ELSE 0.0 END::DOUBLE
  + CASE WHEN regexp_matches(p, '/(page|p)/\d+') OR regexp_matches(p, '/\d{{4}}/(0\d|1[0-2])') THEN -0.2 ELSE 0.0 END::DOUBLE
  + CASE WHEN length(p) - length(replace(p, '/', '')) <= 1 THEN 0.1 WHEN length(p) - length(replace(p, '/', '')) >= 4 THEN -0.1 ELSE 0.0 END::DOUBLE
  + CASE WHEN {QUERY} <> '' THEN -0.1 ELSE 0.0 END::DOUBLE, 6) AS priority
FROM (SELECT *, lower({PATH}) AS p FROM pages)""",
    "page_url_valid": rf"""
SELECT page_id, (starts_with(lower(url), 'http://') OR starts_with(lower(url), 'https://')) AND {HOST} <> '' AND ({HOST} = 'example.net' OR ends_with({HOST}, '.example.net'))
  AND NOT regexp_matches(lower({PATH}), '\.({L.BLOCKED_EXTENSIONS})$') AND NOT regexp_matches(lower({PATH}), '/({L.BLOCKED_PATHS})') AND NOT starts_with(lower({PATH}), '/en/1') AS is_valid
FROM pages""",
    "robots_prefix_anti_join": f"SELECT page_id, url FROM pages WHERE NOT starts_with(lower({PATH}), '/en') AND NOT starts_with(lower({PATH}), '/p/')",
    "page_main_text": f"SELECT page_id, text FROM ({PAGE_TEXT})",
    "page_title_extract": f"SELECT page_id, title FROM ({PAGE_TEXT})",
    "page_links_distinct": LINKS,
    "frontier_anti_join": f"SELECT DISTINCT dst_url AS url FROM ({LINKS}) WHERE dst_url NOT IN (SELECT url FROM pages)",
    "page_quality_score": f"""
SELECT doc_id, CASE WHEN text = '' THEN 0.0 ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN {_N} < 100 THEN -0.2 WHEN {_N} < 300 THEN -0.1 WHEN {_N} > 500 THEN 0.1 ELSE 0.0 END::DOUBLE + 0.15::DOUBLE
  + least(0.2::DOUBLE, {count_of('lower(text)', L.FIXTURE_PHRASES)} * 0.02::DOUBLE)
  + CASE WHEN contains(text, 'HEADING:') THEN 0.05 ELSE 0.0 END::DOUBLE + CASE WHEN contains(text, 'TITLE:') THEN 0.05 ELSE 0.0 END::DOUBLE)), 6) END AS quality
FROM documents""",
    "valid_content_filter": rf"SELECT doc_id FROM documents WHERE length(text) >= 50 AND NOT regexp_matches(text, {_q('(?i)' + '|'.join(L.BOT_PATTERNS))}) AND len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) >= 10",
    "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    "sentences": f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
    "paragraph_groups": f"SELECT doc_id, CAST(i AS INTEGER) AS pos, array_to_string(s[i * 5 + 1:i * 5 + 5], ' ') AS paragraph FROM (SELECT doc_id, s, unnest(range(0, (len(s) + 4) // 5)) AS i FROM (SELECT doc_id, {sentences('text')} AS s FROM documents))",
    "chunk_sliding_windows": f"SELECT doc_id, CAST(i AS INTEGER) AS pos, array_to_string(s[i * 8 + 1:i * 8 + 10], ' ') AS chunk FROM (SELECT doc_id, s, unnest(range(0, (len(s) + 7) // 8)) AS i FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)) WHERE len(s) - i * 8 >= 3",
    "key_phrases_tfidf": rf"""
WITH said AS (SELECT doc_id, s, len(s) AS n FROM (SELECT doc_id, {sentences('text')} AS s FROM documents WHERE length(text) >= 20)),
toks AS (SELECT doc_id, n, i AS sent, list_filter(regexp_extract_all(lower(s[i]), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({STOP}, t)) AS t FROM (SELECT doc_id, s, n, unnest(range(1, n + 1)) AS i FROM said)),
terms AS (SELECT doc_id, n, sent, unnest(t || list_transform(range(1, greatest(len(t), 1)), lambda i: array_to_string(t[i:i + 1], ' ')) || list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(t[i:i + 2], ' '))) AS phrase FROM toks),
tf AS (SELECT doc_id, n, sent, phrase, count(*) AS tf FROM terms GROUP BY ALL),
per AS (SELECT doc_id, n, phrase, sum(tf) AS times, count(*) AS df FROM tf GROUP BY ALL),
best AS (SELECT doc_id, phrase, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, phrase) AS r FROM per) WHERE r <= 100),
w AS (SELECT doc_id, sent, phrase, tf * idf AS w FROM tf JOIN best USING (doc_id, phrase)),
u AS (SELECT doc_id, phrase, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, sent)) AS u FROM w),
scored AS (SELECT doc_id, phrase, round(sum(u), 6) AS score FROM u GROUP BY ALL)
SELECT doc_id, phrase, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS rank FROM scored) WHERE rank <= 10 AND length(phrase) > 3""",
    "inverted_index": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({words('lower(text)')})) AS term FROM documents) WHERE length(term) > 3 GROUP BY term",
    "kb_stats": f"""{CHUNKS}
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings) AS indexed, (SELECT max(len(embedding)) FROM embeddings) AS dimension,
  (SELECT count(DISTINCT term) FROM (SELECT unnest({words('lower(text)')}) AS term FROM documents) WHERE length(term) > 3) AS terms""",
    "text_search_topk": f"""
WITH w AS (SELECT item_id, {words('lower(text)')} AS w FROM benchmark),
o AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS terms FROM w),
b AS (SELECT item_id, terms, list_distinct({_RUNS}) AS phrases FROM o),
d AS (SELECT doc_id, source, lower(text) AS low FROM documents),
m AS (SELECT item_id, doc_id, matches, len(list_filter(phrases, lambda p: contains(low, p))) AS phrases FROM ({_MATCH}) WHERE matches > 0)
SELECT item_id, doc_id, matches, phrases, score, rank FROM (SELECT *, matches + 2 * phrases AS score, row_number() OVER (PARTITION BY item_id ORDER BY matches + 2 * phrases DESC, doc_id) AS rank FROM m) WHERE rank <= 5""",
    "fallback_search_topk": f"""
WITH b AS (SELECT item_id, {words('lower(text)')} AS terms, [] AS phrases FROM benchmark), d AS (SELECT doc_id, source, lower(text) AS low FROM documents),
m AS (SELECT item_id, doc_id, round(matches::DOUBLE / len(terms) * CASE WHEN source = 'src' || (item_id % 20) THEN 2.0 ELSE 1.0 END::DOUBLE, 6) AS score FROM ({_MATCH}) WHERE matches > 0)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 10""",
    "vector_topk": topk(_HITS, 5),
    "hybrid_topk_boost": f"""
WITH h AS ({topk(_HITS, 20)}),
t AS (SELECT h.*, d.text, list_distinct({words('lower(q.text)')}) AS terms FROM h JOIN documents d ON d.doc_id = h.vec_id JOIN documents q ON q.doc_id = h.query_id),
s AS (SELECT query_id, vec_id, round(score + 0.05::DOUBLE * len(list_filter(terms, lambda x: contains(lower(text), x))), 6) AS score, rank AS first_rank FROM t)
SELECT query_id, vec_id, score, first_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS rank FROM s""",
    "rerank_blend": f"""
SELECT query_id, vec_id, score, final_score, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, vec_id) AS rank FROM (
  SELECT query_id, vec_id, score, round(0.3::DOUBLE * score + 0.7::DOUBLE * (((vec_id * 7 + query_id * 13) % 100)::DOUBLE / 100), 5) AS final_score FROM ({topk(_HITS, 20)}))""",
    "diverse_select": f"""
WITH h AS (SELECT t.*, d.source AS url, d.source = q.source AS is_source FROM ({topk(_HITS, 30)}) t JOIN documents d ON d.doc_id = t.vec_id JOIN documents q ON q.doc_id = t.query_id),
a AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, first(url) OVER (PARTITION BY query_id ORDER BY rank) AS best_url, min(CASE WHEN is_source AND rank > 1 THEN rank END) OVER (PARTITION BY query_id) AS own FROM h),
b AS (SELECT *, CASE WHEN rank = 1 THEN 0 WHEN rank = own THEN 1 ELSE 2 END AS stage FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, url, stage ORDER BY rank) AS ur FROM b),
k AS (SELECT *, CASE WHEN stage = 2 AND ur = 1 AND url <> best_url THEN score + 0.3::DOUBLE ELSE score END AS key FROM c)
SELECT query_id, vec_id, pick FROM (SELECT *, CASE WHEN n <= 12 THEN rank ELSE row_number() OVER (PARTITION BY query_id ORDER BY stage, key DESC, rank) END AS pick FROM k) WHERE pick <= 12""",
    "topic_type": f"SELECT doc_id, {_TYPE} AS topic_type FROM documents",
    "conversation_qa_pairs": f"SELECT pos, question, answer, source_url, n_context FROM ({PAIRS})",
    "score_relevance": f"SELECT pos, round({_REL}, 6) AS relevance FROM ({PAIRS})",
    "score_factuality": f"SELECT pos, round({_FACT}, 6) AS factuality FROM ({PAIRS})",
    "score_completeness": f"SELECT pos, round({_COMP}, 6) AS completeness FROM ({PAIRS})",
    "evaluate_answers": f"SELECT pos, relevance, factuality, completeness, formatting, overall FROM ({EVALUATED})",
    "answer_signature_dedupe": f"SELECT pos, signature, overall FROM (SELECT *, row_number() OVER (PARTITION BY source_url, signature ORDER BY overall DESC, pos) AS r FROM (SELECT *, {SIGNATURE} AS signature FROM ({EVALUATED}))) WHERE r = 1",
    "filter_qa_pairs": f"""
WITH e AS (SELECT *, {SIGNATURE} AS signature FROM ({EVALUATED})), n AS (SELECT count(*) AS n FROM e),
p AS (SELECT e.*, overall >= CASE WHEN n < 5 THEN 0.32 ELSE 0.5 END AS passes, row_number() OVER (ORDER BY overall DESC, pos) AS r, n FROM e, n),
f AS (SELECT * FROM p WHERE CASE WHEN (SELECT count(*) FROM p WHERE passes) < 3 AND n > 3 THEN r <= 3 ELSE passes END),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_url, signature ORDER BY overall DESC, pos) AS s FROM f) WHERE s = 1)
SELECT pos, overall FROM o WHERE (SELECT count(*) FROM o) >= 3 UNION ALL SELECT pos, overall FROM p WHERE r <= 5 AND (SELECT count(*) FROM o) < 3""",
    "metrics_avg_scores": f"SELECT count(*) AS total_pairs, round(avg(relevance), 3) AS avg_relevance, round(avg(factuality), 3) AS avg_factuality, round(avg(completeness), 3) AS avg_completeness, round(avg(formatting), 3) AS avg_formatting, round(avg(overall), 3) AS avg_overall FROM ({EVALUATED})",
    "metrics_distribution": f"SELECT CASE WHEN overall >= 0.8 THEN 'excellent' WHEN overall >= 0.7 THEN 'good' WHEN overall >= 0.6 THEN 'average' ELSE 'below_avg' END AS bucket, count(*) AS n FROM ({EVALUATED}) GROUP BY bucket",
    "topic_coverage_top10": "SELECT lower(source) AS topic, count(*) AS n FROM documents WHERE lower(source) NOT IN ('', 'general') GROUP BY 1 ORDER BY n DESC, topic LIMIT 10",
    "url_coverage": f"SELECT {HOST} AS url, count(*) AS n FROM pages GROUP BY 1",
    "disclaimer_filter": f"SELECT conv_id, turn FROM conversations WHERE {' OR '.join(f'regexp_matches({strip(chr(116) + chr(101) + chr(120) + chr(116))}, {_q(p)})' for p in L.DISCLAIMERS)} OR (len({words('text')}) < 20 AND contains(lower(text), 'don''t have'))",
    "clean_question": rf"SELECT conv_id, turn, CASE WHEN q <> '' AND NOT ends_with(q, '?') THEN q || '?' ELSE q END AS question FROM (SELECT conv_id, turn, upper(left(t, 1)) || substring(t, 2) AS q FROM (SELECT conv_id, turn, {strip(r'''regexp_replace(text, '^(Question:|Q:|Step \d+:)', '')''')} AS t FROM conversations WHERE role = 'user'))",
    "stream_ingest_dedupe": "SELECT DISTINCT user_id FROM events",
    "chunk_pack": f"SELECT doc_id, CAST(j - 1 AS INTEGER) AS pos, c[j] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS j FROM ({packed('SELECT doc_id, doc_id AS doc_url, text AS t FROM documents')}))",
    "chunk_documents": f"{CHUNKS} SELECT doc_url, chunk_ord, idx, text FROM chunks",
    "entities_regex": rf"""WITH plain AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{{L}}\p{{N}}\p{{M}}]', '#', 'g'), '[^\x00-\x7F]', '_', 'g') AS t FROM documents) SELECT doc_id, text, label, from_pos AS start, CAST(from_pos + length(text) AS INTEGER) AS "end" FROM ({_ENTITIES})""",
    "topic_content_budget": f"{CONTENT} SELECT doc_url, topic, content, n_chunks FROM content",
    "rule_questions": f"{RULES} SELECT doc_url, topic, pos, text, quality_score FROM asked",
    "question_cap_per_url": f"""{RULES} SELECT source, text, quality_score, rank FROM (SELECT split_part(doc_url, '/', 3) AS source, text, quality_score,
  row_number() OVER (PARTITION BY split_part(doc_url, '/', 3) ORDER BY quality_score DESC, doc_url || '#' || pos) AS rank FROM asked) WHERE rank <= 10""",
    "candidate_select": f"""SELECT pos, cs[list_position(marks, list_max(marks))] AS answer FROM (SELECT pos, cs, list_transform(cs, lambda c: {_MARK}) AS marks
  FROM (SELECT pos, [answer, array_to_string(string_split(answer, '.')[1:2], '.'), question] AS cs, {_CTX} AS theirs FROM ({PAIRS})))""",
    "substantive_answer": f"""SELECT pos, CASE WHEN len(real) = 0 THEN cs[1] ELSE real[list_position(marks, list_max(marks))] END AS answer FROM (
  SELECT pos, cs, real, list_transform(real, lambda c: length(c) - 10 * ((length(c) - length(replace(c, 'I don''t have', ''))) // 12)) AS marks FROM (
    SELECT pos, cs, list_filter(cs, lambda c: NOT ({' OR '.join(f'regexp_matches({strip("c")}, {_q(p)})' for p in L.DISCLAIMERS)} OR (len({words('c')}) < 20 AND contains(lower(c), 'don''t have')))) AS real
    FROM (SELECT pos, [split_part(answer, '.', 1), {_q(L.DECLINED)}, answer, question] AS cs FROM ({PAIRS}))))""",
    # of the questions about keywords only the first outlasts the test for near-repeats: two share eight words of ten
    "adaptive_questions": f"""WITH s AS (SELECT source, arg_min({_URL}, doc_id) AS source_url, list_filter([{', '.join(f"CASE WHEN bool_or(contains(lower(text), {_q(k)})) THEN {_q(k)} END" for k in _KEYS)}], lambda k: k IS NOT NULL) AS ks FROM documents GROUP BY source)
{' UNION ALL '.join(f"SELECT source_url, CAST({i} AS BIGINT) AS pos, {_q(q)} AS text, {_q(t)} AS topic, {_q(k)} AS topic_type, 0.6::DOUBLE AS quality_score FROM s" for i, (q, t, k) in enumerate(L.FALLBACK_QUESTIONS))}
UNION ALL SELECT source_url, 3, 'What information is provided about ' || ks[1] || ' resources or services?', upper(left(ks[1], 1)) || substring(ks[1], 2), 'KEYWORD', 0.65::DOUBLE FROM s WHERE len(ks) > 0""",
    "topic_prompts": f"{CONTENT} SELECT doc_url, topic, CAST(j - 1 AS INTEGER) AS pos, ps[j] AS prompt FROM (SELECT doc_url, topic, ps, unnest(range(1, len(ps) + 1)) AS j FROM (SELECT doc_url, topic, list_filter([{_PROMPTS}], lambda x: x IS NOT NULL) AS ps FROM (SELECT *, chr(10) || chr(10) || 'Content: ' || content || chr(10) || chr(10) || 'Question:' AS tail FROM content WHERE content <> '')))",
    "general_prompts": f"{_SUMMARY} " + " UNION ALL ".join(f"SELECT doc_url, {i} AS pos, {_q(p)} || chr(10) || chr(10) || 'Content: ' || {('head', 'rest')[i % 2]} || chr(10) || chr(10) || 'Question:' AS prompt FROM summary" for i, p in enumerate(L.GENERAL_PROMPTS)),
    "summary_context": f"{_SUMMARY} SELECT doc_url, head, rest FROM summary",
    # equal texts are the only near-repeats among the few questions of one topic
    "document_questions": f"""{RULES} SELECT doc_url, row_number() OVER (PARTITION BY doc_url ORDER BY quality_score DESC, topic, pos) AS pos, text, topic, topic_type, quality_score
FROM (SELECT doc_url, topic, topic_type, text, quality_score, min(pos) AS pos FROM asked GROUP BY ALL)""",
    "seed_urls": f"SELECT url, CAST(j - 1 AS INTEGER) AS pos, u[j] AS seed FROM (SELECT url, u, unnest(range(1, len(u) + 1)) AS j FROM (SELECT url, list_filter(us, lambda x, i: list_position(us, x) = i) AS u FROM (SELECT url, {_SEEDS} AS us FROM (SELECT url, {_ROOT} AS root, {_SITE} AS host, {_SCHEME} AS scheme, {PATH} AS path FROM pages))))",
    "quality_lookup": "SELECT page_id, url, CASE WHEN page_id % 3 <> 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS quality FROM pages",
    "search_index": "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x1, 1.0::DOUBLE AS norm FROM embeddings WHERE vec_id % 7 <> 0",
    "embedding_input": f"SELECT page_id, title || '. ' || left(text, 1000) AS text FROM ({PAGE_TEXT})",
    "document_summary": f"{CHUNKS} SELECT {_URL} AS url, length(d.text) AS length, (SELECT count(*) FROM chunks c WHERE c.doc_url = {_URL}) AS chunks, coalesce(t.topic, '') AS topics FROM documents d LEFT JOIN topics t ON t.doc_url = {_URL}",
    "context_clean": f"SELECT doc_id, {_CLEAN_CHUNK} AS text FROM documents",
    "answer_artifacts": f"SELECT doc_id, {_ART} AS text FROM documents",
    "capital_phrases": r"SELECT doc_id, CAST(j - 1 AS INTEGER) AS pos, u[j] AS phrase FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS j FROM (SELECT doc_id, (list_filter(m, lambda x, i: list_position(m, x) = i))[1:10] AS u FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+') AS m FROM documents)))",
    "bigram_similarity": f"SELECT pos, round({jaccard(ngrams(words('lower(question)'), 2), ngrams(words('lower(answer)'), 2))}, 6) AS similarity FROM ({PAIRS})",
    "answer_ending": r"SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN t WHEN last > 0.7::DOUBLE * length(t) THEN left(t, last + 1) ELSE t || '.' END AS text FROM (SELECT doc_id, t, length(t) - length(regexp_extract(t, '([^.!?]*)$', 1)) - 1 AS last FROM (SELECT doc_id, rtrim(regexp_replace(text, '[.!?\s]+$', '')) AS t FROM documents))",
    # no fixture text has a blank line, so all go by groups of four sentences
    "semantic_units": f"SELECT doc_id, CAST(i AS INTEGER) AS pos, array_to_string(s[i * 4 + 1:i * 4 + 4], ' ') AS unit FROM (SELECT doc_id, s, unnest(range(0, (len(s) + 3) // 4)) AS i FROM (SELECT doc_id, {sentences('text')} AS s FROM documents))",
    "retrieve_context": f"""
WITH w AS (SELECT item_id, {words('lower(text)')} AS w FROM benchmark),
o AS (SELECT item_id, w, list_filter(w, lambda x, i: list_position(w, x) = i) AS terms FROM w),
b AS (SELECT item_id, w, terms, list_distinct({_RUNS}) AS phrases FROM o),
d AS (SELECT doc_id, source, lower(text) AS low FROM documents),
m AS MATERIALIZED (SELECT item_id, doc_id, source, matches + 2 * len(list_filter(phrases, lambda p: contains(low, p))) AS score FROM ({_MATCH}) WHERE matches > 0),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM m) WHERE r <= 60),
f AS (SELECT b.item_id, d.doc_id, d.source, round(len(list_filter(b.w, lambda t: contains(d.low, t)))::DOUBLE / len(b.w) * CASE WHEN d.source = 'src' || (b.item_id % 20) THEN 2.0 ELSE 1.0 END::DOUBLE, 6) AS score
  FROM b CROSS JOIN d WHERE (SELECT count(*) FROM h WHERE h.item_id = b.item_id) < 3 AND len(list_filter(b.w, lambda t: contains(d.low, t))) > 0),
f10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM f) WHERE r <= 10),
e AS (SELECT item_id, doc_id, source, score::DOUBLE AS score, 0 AS stage, r FROM h UNION ALL SELECT item_id, doc_id, source, score, 1, r FROM f10 WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.item_id = f10.item_id AND h.doc_id = f10.doc_id)),
g AS (SELECT *, source = 'src' || (item_id % 20) AS is_source, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, stage, r) AS rank FROM e),
a AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n, first(source) OVER (PARTITION BY item_id ORDER BY rank) AS best, min(CASE WHEN is_source AND rank > 1 THEN rank END) OVER (PARTITION BY item_id) AS own FROM g),
z AS (SELECT *, CASE WHEN rank = 1 THEN 0 WHEN rank = own THEN 1 ELSE 2 END AS st FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY item_id, source, st ORDER BY rank) AS ur FROM z),
k AS (SELECT *, CASE WHEN st = 2 AND ur = 1 AND source <> best THEN score + 0.3::DOUBLE ELSE score END AS key FROM c)
SELECT item_id, doc_id, source, score, pick FROM (SELECT *, CASE WHEN n <= 30 THEN rank ELSE row_number() OVER (PARTITION BY item_id ORDER BY st, key DESC, rank) END AS pick FROM k) WHERE pick <= 30""",
    "assembled_context": f"""
WITH h AS (SELECT t.*, d.source, d.text FROM ({topk(_HITS, 10)}) t JOIN documents d ON d.doc_id = t.vec_id JOIN documents q ON q.doc_id = t.query_id),
u AS (SELECT query_id, source, min(rank) AS f, string_agg(text, ' ' ORDER BY rank) AS text FROM h GROUP BY ALL)
SELECT query_id, CASE WHEN count(*) > 1 THEN string_agg('[From: ' || source || '] ' || text, chr(10) || chr(10) ORDER BY f) ELSE first(text) END AS context FROM u GROUP BY query_id""",
    "csv_lines": f"""SELECT concat_ws(',', '"' || replace(question, '"', '""') || '"', '"' || replace(answer, '"', '""') || '"', '"' || source_url || '"', '"t"', '"GENERAL"', CAST(overall AS VARCHAR)) AS value FROM ({EVALUATED})""",
    "markdown_sections": f"""SELECT min(pos) AS group_pos, source_url, '## ' || source_url || chr(10) || chr(10) || string_agg('### Q' || n || ': ' || question || chr(10) || chr(10) || answer || chr(10) || chr(10) || '*Topic: t | Type: GENERAL | Score: ' || printf('%.2f', round(CAST(overall AS DECIMAL(10, 6)), 2)::DOUBLE) || '*' || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY pos) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY pos) AS n FROM ({EVALUATED})) GROUP BY source_url""",
}
ORACLES["url_priority_order"] = f"SELECT page_id, priority, row_number() OVER (PARTITION BY host ORDER BY priority DESC, page_id) AS rank FROM (SELECT p.page_id, p.priority, {HOST} AS host FROM ({ORACLES['page_url_priority']}) p JOIN pages USING (page_id))"
