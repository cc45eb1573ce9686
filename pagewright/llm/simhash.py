"""Operator 4: document fingerprints by SimHash.

Terms are words (A-Z in lower case) and pairs of adjacent words; a term weighs
1 + log2 of its count, so frequent words don't drown the rest. Each term's hash
votes with its weight for or against each of 128 bits. The likeness of two
fingerprints is the cosine that their Hamming distance d stands for,
cos(pi d / 128), at least 0.

``within_radius`` finds all fingerprints within a Hamming radius r of queries:
the bits are cut into r + 2 blocks, of which at least two agree for any pair
within r; so there is one table for each two blocks, sorted (hashed) by these.
Equal fingerprints are one entry with a count.

``with_edited`` pairs every document with the next in descending id without a
global sort in one task: rows are dealt into ranges of (id, hash of the text), so
that neither equal nor null ids gather in one, and sorted there. Texts are
shuffled once, into as many ranges as their bytes ask for. The last row of a range
is finished when the heads of all ranges are known; these are two rows a range.

Null text is empty; its fingerprint has no bit set. Null ids come last; of equal
ids the order is by the text's hash. The only document is next to itself. Repeated
rows are next to each other; an empty table gives an empty result. Other columns
aren't read.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, mix, releasing, small_batches, text_bytes, word_hashes

BITS, RADIUS = 128, 3
#: Bytes of text that a range aims at.
RANGE_BYTES = 64 << 20
_PAIR, _SECOND = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct terms of a text, and their weights."""
    w = word_hashes(text_bytes(text).translate(LOWER))
    both = np.concatenate([w, mix(w[:-1] * _PAIR + w[1:])]) if len(w) else w
    hashes, counts = np.unique(both, return_counts=True)
    return hashes, (1 + np.log2(counts)).astype(np.float32)


def fingerprint(hashes: np.ndarray, weights: np.ndarray) -> bytes:
    """16 bytes: the signs of the weighted votes."""
    votes = np.zeros(BITS, np.float64)
    for i in range(0, len(hashes), 1 << 15):
        h, w = hashes[i : i + (1 << 15)], weights[i : i + (1 << 15)]
        for half, x in enumerate((h, mix(h ^ _SECOND))):
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            votes[64 * half : 64 * half + 64] += 2 * (w @ bits) - w.sum()
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    d = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, math.cos(math.pi * d / BITS))


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as much of the start of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "edited")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size) // RANGE_BYTES + 1)
    order = [F.desc_nulls_last("id"), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    kind = docs.schema[id_col].dataType.simpleString()
    told = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finished(doc, text, print_, next_text, next_print) -> tuple:
        new = edited(text, next_text)
        new_print = fingerprint(*terms(new)) if new != text else print_
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, len(text), sha, print_.hex(), new_print.hex(), likeness(print_, new_print), likeness(print_, next_print)

    def as_batch(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        cols = zip(*out) if out else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[*names, "at", "end", "text"])

    @releasing
    def run(batches):
        # end: 0 a row that is done, 1 the head of the range, 2 its last row
        at, held, id_type = TaskContext.get().partitionId(), None, None  # held: (id, text, fingerprint)
        for batch in batches:
            out, id_type = [], batch.column(0).type
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc, text = doc.as_py(), text.as_py()
                print_ = fingerprint(*terms(text))
                if held is None:
                    out.append((doc, None, None, print_.hex(), None, None, None, at, 1, text))
                else:
                    out.append((*finished(*held, text, print_), at, 0, None))
                held = doc, text, print_
            yield as_batch(out, id_type)
        if held is not None:
            yield as_batch([(held[0], None, None, held[2].hex(), None, None, None, at, 2, held[1])], id_type)

    first = scratch.put(dealt.mapInArrow(run, f"{told}, at int, end int, text string"), "first")
    heads = first.where("end = 1").select("at", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    # the ranges that have rows: a number for each
    have = sorted(r["at"] for r in heads.select("at").collect())
    after = spark.createDataFrame(list(zip(have, have[1:] + have[:1])), "last int, at int")
    lasts = first.where("end = 2").select(F.col(id_col).alias("id"), "text", "fingerprint", F.col("at").alias("last"))
    ends = lasts.join(F.broadcast(after), "last").join(heads, "at").select("id", "text", "fingerprint", "next_text", "next_print")

    def finish(batches):
        for batch in batches:
            out = [finished(d, t, bytes.fromhex(p), n, bytes.fromhex(q)) for d, t, p, n, q in zip(*(c.to_pylist() for c in batch.columns))]
            yield as_batch([(*r, 0, 0, None) for r in out], batch.column(0).type)

    done = first.where("end = 0").unionByName(ends.mapInArrow(finish, f"{told}, at int, end int, text string"))
    return done.select(names)


def _blocks(hex_print: Column, radius: int) -> list[Column]:
    """The bits of a fingerprint as radius + 2 blocks."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_print, i, 8), 16, 2), 32, "0") for i in range(1, BITS // 4, 8)])
    cut = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    return [F.substring(bits, a + 1, b - a) for a, b in zip(cut, cut[1:])]


def _halves(hex_print: Column) -> list[Column]:
    return [F.conv(F.substring(hex_print, i, 8), 16, 10).cast("long") for i in range(1, BITS // 4, 8)]


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n): for each distinct fingerprint of ``queries``, how many rows
    of ``prints`` lie within ``radius`` of it, rows that have it included."""
    every = prints.groupBy("fingerprint").agg(F.count("*").alias("times"))
    asked = queries.select("fingerprint").distinct()

    def tables(df: DataFrame) -> DataFrame:
        b = _blocks(F.col("fingerprint"), radius)
        keys = [F.concat_ws(":", F.lit(i), b[x], b[y]) for i, (x, y) in enumerate(combinations(range(len(b)), 2))]
        return df.withColumn("key", F.explode(F.transform(F.array(*keys), lambda k: F.xxhash64(k))))

    one = tables(asked.select(F.col("fingerprint"))).select(F.col("fingerprint").alias("q"), "key")
    two = tables(every).select(F.col("fingerprint").alias("p"), "times", "key")
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_halves(F.col("q")), _halves(F.col("p")))), F.lit(0))
    near = one.join(two, "key").where(apart <= radius).select("q", "p", "times").distinct()
    return near.groupBy(F.col("q").alias("fingerprint")).agg(F.sum("times").alias("n"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 50, radius: int = RADIUS) -> DataFrame:
    """``with_edited`` and, for rows whose id is divisible by ``every``, how many
    other rows lie within ``radius`` of the row's own fingerprint (``n_within``;
    null for other rows)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.put(with_edited(docs, id_col, text_col), "prints")
    is_asked = F.coalesce(F.col(id_col) % every == 0, F.lit(False))
    asked = prints.where(is_asked)
    counted = asked.join(within_radius(prints, asked, radius), "fingerprint").select(*prints.columns, (F.col("n") - 1).alias("n_within"))
    return counted.unionByName(prints.where(~is_asked).withColumn("n_within", F.lit(None).cast("long")))
