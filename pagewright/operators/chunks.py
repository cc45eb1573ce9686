"""Documents to chunks, entities and topics."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists as L
from ..functions import text as T

MAX_CHUNK, TARGET = 1500, 1000


def paragraphs(c: Column) -> Column:
    """Paragraphs at blank lines, or else groups of five sentences."""
    cut = F.filter(F.transform(F.split(c, "\n\n"), T.strip), lambda p: p != "")
    return F.when(F.contains(c, F.lit("\n\n")), cut).otherwise(T.groups_of(T.sentences(c), 5))


def pack(paras: Column, target: int = TARGET, fixed_overlap: bool = False) -> Column:
    """Paragraphs packed to about ``target`` characters; a chunk begins with the
    last paragraph of the one before. After that its length counts the new
    paragraph twice, unless ``fixed_overlap``."""
    state = F.struct(F.array().cast("array<string>").alias("chunks"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("len"))

    def step(s, p):
        full = (s["len"] > 0) & (s["len"] + F.length(p) > target)
        last = F.element_at(s["cur"], -1)
        started = F.length(last) + F.length(p) if fixed_overlap else F.length(p) * 2
        return F.struct(
            F.when(full, F.concat(s["chunks"], F.array(F.array_join(s["cur"], " ")))).otherwise(s["chunks"]).alias("chunks"),
            F.when(full, F.array(last, p)).otherwise(F.concat(s["cur"], F.array(p))).alias("cur"),
            F.when(full, started).otherwise(s["len"] + F.length(p)).alias("len"),
        )

    return F.aggregate(paras, state, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["chunks"], F.array(F.array_join(s["cur"], " ")))).otherwise(s["chunks"]))


def character_windows(c: Column, size: int = 1000, overlap: int = 100, least: int = 200) -> Column:
    """Windows of characters, for text that no sentence can be found in."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(size - overlap)), lambda i: F.least(i + size, F.length(c)) - i >= least)
    return F.transform(at, lambda i: F.substr(c, i + 1, F.lit(size)))


def sections(c: Column, by_header: bool = False) -> Column:
    """Text with headers: one chunk, the whole; with ``by_header`` one a header."""
    return F.filter(F.transform(F.split(c, r"(?m)(?=^#+\s)"), T.strip), lambda s: s != "") if by_header else F.array(c)


def chunks_of(c: Column, by_header: bool = False, fixed_overlap: bool = False) -> Column:
    """array<struct<idx, text>>: by sections or paragraphs, long ones split into
    windows of sentences. A long chunk of one or two sentences gives none."""

    def split(x, i):
        parts = T.let(T.sentences(x), lambda s: F.when(F.size(s) > 0, T.windows_of(s)).otherwise(character_windows(x)))
        many = F.transform(parts, lambda t, k: F.struct((i * 100 + k).cast("int").alias("idx"), t.alias("text")))
        return F.when(F.length(x) > MAX_CHUNK, many).otherwise(F.array(F.struct(i.cast("int").alias("idx"), x.alias("text"))))

    def of(c):
        base = F.when(F.contains(c, F.lit("#")), sections(c, by_header)).otherwise(pack(paragraphs(c), fixed_overlap=fixed_overlap))
        return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.flatten(F.transform(base, split))).otherwise(F.array().cast("array<struct<idx:int,text:string>>"))

    return T.let(c, of)  # cleaning, which the text often is, is done once


def chunk_documents(docs: DataFrame, url: Column, text: Column) -> DataFrame:
    """(chunk_id, doc_url, chunk_ord, idx, text), a row per chunk; no shuffle."""
    out = docs.select(url.alias("doc_url"), F.posexplode(chunks_of(text)).alias("chunk_ord", "c"))
    return out.select(F.xxhash64("doc_url", "chunk_ord").alias("chunk_id"), "doc_url", "chunk_ord", F.col("c.idx").alias("idx"), F.col("c.text").alias("text"))


def entities(c: Column) -> Column:
    """array<struct<text, label, start, end>>: all matches, pattern by pattern.

    Starts are one fold over the gaps between matches."""

    def of(pattern, label):
        pattern = "(?U)" + pattern
        found, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
        sizes = F.zip_with(F.transform(found, lambda m: F.length(m)), F.transform(gaps, lambda g: F.length(g)), lambda m, g: F.struct(F.coalesce(m, F.lit(0)).alias("m"), g.alias("g")))
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(sizes, state, lambda s, x: F.struct((s["at"] + x["g"] + x["m"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["g"])).alias("starts")), lambda s: s["starts"])
        told = F.zip_with(found, starts, lambda m, at: F.struct(m.alias("text"), F.lit(label).alias("label"), at.alias("start"), (at + F.length(m)).alias("end")))
        return F.filter(told, lambda e: e["text"].isNotNull())

    return F.concat(*[of(p, label) for p, label in L.ENTITY_PATTERNS])


TOKEN = r"[\p{L}\p{N}_]{2,}"


def _weighed(sentences: list[list[str]], top_n: int, most: int) -> list[tuple[str, float]]:
    """The first ``top_n`` runs of one to three tokens with their rounded scores."""
    runs = [t + [f"{a} {b}" for a, b in zip(t, t[1:])] + [f"{a} {b} {c}" for a, b, c in zip(t, t[1:], t[2:])] for t in sentences]
    by_times: dict[int, list[str]] = {}
    for p, n in Counter(chain.from_iterable(runs)).items():
        by_times.setdefault(n, []).append(p)
    first: list[str] = []
    for n in sorted(by_times, reverse=True):
        if len(first) < most:
            first += heapq.nsmallest(most - len(first), by_times[n])
    known = set(first)
    counts = [Counter([p for p in r if p in known]) for r in runs]
    df = Counter(chain.from_iterable(counts))
    idf = {p: math.log((1 + len(sentences)) / (1 + df[p])) + 1 for p in first}
    score = dict.fromkeys(idf, 0.0)
    for c in counts:
        w = {p: n * idf[p] for p, n in c.items() if p in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for p, x in w.items():
            score[p] += x / norm
    # only what the rounding could bring into the first is rounded, as Spark rounds
    bar = min(heapq.nlargest(top_n, score.values()), default=0.0) - 2e-6
    near = [(p, float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))) for p, x in score.items() if x >= bar]
    return sorted(near, key=lambda x: (-x[1], x[0]))[:top_n]


def key_phrases(docs: DataFrame, id_col: str, text: Column, top_n: int = 10, most: int = 100) -> DataFrame:
    """(id, phrase, score, rank): TF-IDF of runs of one to three tokens over each
    document's own sentences; every sentence's weights have unit length.

    All is known from one document, so rows are weighed where they lie and nothing
    is shuffled; documents have different ids."""
    tokens = lambda s: F.filter(F.regexp_extract_all(F.lower(s), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(L.STOP_WORDS))
    # a token has no white space: a line a sentence
    lines = F.array_join(F.transform(T.sentences(text), lambda s: F.array_join(tokens(s), " ")), "\n")
    said = docs.where((F.length(text) >= 20) & F.col(id_col).isNotNull()).select(F.col(id_col), lines.alias("lines"))

    def weigh(batches):
        for batch in batches:
            at: list[int] = []
            out: list[tuple[str, float, int]] = []
            for i, t in enumerate(batch.column(1)):
                best = _weighed([s.split(" ") if s else [] for s in t.as_py().split("\n")], top_n, most)
                kept = [(p, score, rank) for rank, (p, score) in enumerate(best, 1) if len(p) > 3]
                at += [i] * len(kept)
                out += kept
            cols = list(zip(*out)) if out else [[], [], []]
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], names=[id_col, "phrase", "score", "rank"])

    kind = said.schema[id_col].dataType.simpleString()
    return said.mapInArrow(weigh, f"`{id_col}` {kind}, phrase string, score double, rank long")


def capital_phrases(c: Column, n: int = 10) -> Column:
    """Distinct capitalised phrases in order of appearance, the fallback of key phrases."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"), F.lit(0))), 1, n)


def semantic_units(c: Column, n: int = 4, short: int = 50) -> Column:
    """Paragraphs, short ones joined to the one before, or else groups of four sentences."""
    paras = F.filter(F.transform(F.split(c, "\n\n"), T.strip), lambda p: p != "")
    empty = F.array().cast("array<string>")
    merged = F.aggregate(paras, empty, lambda acc, p: F.when((F.size(acc) > 0) & (F.length(p) < short), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), p)))).otherwise(F.concat(acc, F.array(p))))
    return F.when(F.contains(c, F.lit("\n\n")), merged).otherwise(T.groups_of(T.sentences(c), n))


def summaries(documents: DataFrame) -> DataFrame:
    """(url, length, chunks, topics): numbers of each document (url, text, chunks,
    topics array), and its first five topics."""
    return documents.select("url", F.length("text").cast("long").alias("length"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.array_join(F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 5), "|").alias("topics"))


def embedding_input(title: Column, text: Column, most: int = 1000) -> Column:
    """What a document's vector is made from: its title and the start of its text."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.left(text, F.lit(most)))
