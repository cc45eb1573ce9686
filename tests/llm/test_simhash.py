import hashlib
import random

import pytest

from pagewright.llm import simhash


def brute(spark, docs):
    """What each row should give, in the order of the contract."""
    hashes = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in docs], "t string").selectExpr("t", "xxhash64(t) h").distinct().collect()}
    rows = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1] or ""]))
    out = []
    prints = [simhash.fingerprint(*simhash.terms(t or "")) for _, t in rows]
    for i, (d, t) in enumerate(rows):
        j = (i + 1) % len(rows)
        t, n = t or "", rows[j][1] or ""
        k = len(t) // 3
        new = t[: len(t) - k] + n[:k]
        near = sum((int.from_bytes(prints[i]) ^ int.from_bytes(p)).bit_count() <= 3 for p in prints) - 1
        e = simhash.fingerprint(*simhash.terms(new))
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), prints[i].hex(), e.hex(), simhash.likeness(prints[i], e), simhash.likeness(prints[i], prints[j]), near if d is not None and d % 50 == 0 else None))
    return out


def result(df):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_within"]
    return [tuple(r) for r in simhash.fingerprints(df).select(names).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_of_every_kind_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    base = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(25)]
    docs = [(rng.choice([None, 50, 50, 100, 7, rng.randint(0, 400)]), rng.choice([None, "", *base, rng.choice(base) + " " + word()])) for _ in range(160)]
    docs += [(50, "two rows of one id"), (50, "with texts that differ"), (50, "two rows of one id"), (3, "long é " * 50_000)]
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, fingerprint string")
    key = lambda r: tuple(map(str, r))
    assert sorted(result(df), key=key) == sorted(brute(spark, docs), key=key)


def test_few_rows(spark):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert simhash.with_edited(one).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert simhash.fingerprints(one.limit(0)).count() == 0
