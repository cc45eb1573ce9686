import random
from collections import Counter

import duckdb
import pytest

from pagewright.llm import mixing


def rows():
    rng = random.Random(2)
    sizes = {"hot": 900, "b": 300, "c": 300, "d": 150, None: 120}
    return [(i if rng.random() < 0.9 else None, "w " * rng.randint(0, 90) + str(i), s) for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]


def frame(spark, docs):
    return spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, source string, _rate int, _source string")


def test_taken_comes_near_the_targets(spark):
    docs = rows()
    got = mixing.rates(frame(spark, docs)).collect()
    taken, target, source = Counter(), {}, {r[0]: r[2] for r in docs if r[0] is not None}
    for r in got:
        assert r.taken == r.size * r.copies <= 3 * r.size
        if r.doc_id is not None:
            taken[source[r.doc_id]] += r.taken
            target[source[r.doc_id]] = r.target
    known = Counter()
    for i, t, s in docs:
        known[s] += len(t.split()) * (i is not None)
    every = Counter()
    for _, t, s in docs:
        every[s] += len(t.split())
    for s, t in target.items():  # within 8 % of the share that rows with an id have
        assert taken[s] == pytest.approx(t * known[s] / every[s], rel=0.08)
    assert sum(target.values()) == pytest.approx(sum(every.values()))


def test_null_ids_have_coins_of_their_own(spark):
    df = spark.createDataFrame([(None, f"some words {i}", "ab"[i % 4 == 0]) for i in range(400)], "doc_id long, text string, source string")
    copies = {r.copies for r in mixing.rates(df).where("source_size > 500").collect()}
    assert len(copies) > 1


@pytest.mark.parametrize("most", [100_000, 0])
def test_mix_is_what_the_rates_say_and_agrees_with_sql(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    docs = [*rows(), (7, "twice the same", "b"), (7, "twice the same", "b"), (8, None, "b"), (9, "", None), (10, "long " * 100_000, "d")]
    df = frame(spark, docs)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    per = mixing.rates(df)
    assert sorted(map(str, mixing.rates(df).collect())) == sorted(map(str, per.collect()))
    assert out.count() == sum(r.copies for r in per.collect())
    duck = duckdb.connect()
    table = df.select("doc_id", "text", "source").toPandas()
    duck.register("frame", table)
    duck.execute("create view documents as select cast(doc_id as bigint) doc_id, text, source from frame")
    want = duck.execute(mixing.ORACLE).df()
    have = per.toPandas()
    for c in ("taken", "copies", "size"):
        assert sorted(want[c]) == sorted(have[c])
    assert mixing.mixed(df.limit(0)).count() == mixing.rates(df.limit(0)).count() == 0
