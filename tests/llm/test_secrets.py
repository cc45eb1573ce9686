import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import secrets


def direct(text):
    """(start, candidate, before, after) by one walk over the text."""
    out = []
    for m in re.finditer(f"(?P<assigned>{secrets.ASSIGNED})|{secrets.CANDIDATE}", text):
        start = m.start() + (re.match(secrets.ASSIGNMENT, m[0]).end() if m["assigned"] else 0)
        out.append((start, text[start : m.end()], text[max(0, start - secrets.BEFORE) : start], text[m.end() : m.end() + secrets.AFTER]))
    return out


TEXTS = [
    'password = "hunter2secret" and pwd=\'Tr0ub4dor&3!xyz\', done',
    "DB_PASSWORD: s3cr3t!, api_key => abcDEFghiJKL; token:=x1;y2",
    "the password: required. Author: Smith, secret agent = no",
    "token = abcdefgh12345678 next 0123456789abcdefXYZ " * 700,
    "auth=a " * 900 + "漢 pwd: éü1234!",
    "",
]


def test_candidates_of_both_forms_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    got = sorted(map(tuple, secrets.candidates(df, "doc_id", "text", "source").collect()))
    assert got == sorted((i, *c, "") for i, t in enumerate(TEXTS) for c in direct(t))
    assert {c[2] for c in got} >= {"hunter2secret", "Tr0ub4dor&3!xyz", "s3cr3t!", "abcDEFghiJKL", "required"}


def test_case_expressions_vote_as_the_forest_does(spark):
    found = secrets.labelled(spark)
    f = secrets.features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    forest = secrets.fit(found)
    told = found.select(*[f[k].alias(k) for k in secrets.FEATURES], "label")
    score = sum((F.expr(secrets.as_sql(t)) for t in forest), F.lit(0.0)) / len(forest)
    rows = told.withColumn("score", score).collect()
    x = np.array([[r[k] for k in secrets.FEATURES] for r in rows])
    assert np.allclose(secrets.vote(forest, x), [r.score for r in rows])
    assert secrets.fit(found.repartition(7)) == forest


@pytest.mark.parametrize(
    "text,secret",
    [
        ('password = "hunter2secret"', True),
        ("pwd='Tr0ub4dor&3!xyz'", True),
        ("DB_PASSWORD: w1dg3t!77", True),
        ("password: required", False),
        ("token = ${TOKEN}", False),
        ("secret = changeme", False),
        ("password: ********", False),
    ],
)
def test_what_the_forest_says_of_assigned_values(spark, text, secret):
    df = spark.createDataFrame([(1, text, "src1")], "doc_id long, text string, source string")
    assert [r.is_secret for r in secrets.scan(df).collect()] == [secret]


def test_rows_of_every_kind(spark):
    t = 'a token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" b'
    rows = [(1, t, "s"), (1, t, "s"), (None, t, None), (2, None, "s"), (3, "", "s"), (4, "key1 " + "abcdefgh12345678 " * 20_000, "s")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, score double")
    got = secrets.scan(df).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("start").alias("last")).collect()
    assert {r.doc_id: (r.n, r.last) for r in got} == {1: (2, 11), None: (1, 11), 4: (20_000, 5 + 17 * 19_999)}
    assert secrets.scan(df.limit(0)).count() == 0
