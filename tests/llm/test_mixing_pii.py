import duckdb
import pytest

from pagewright.llm import mixing, pii


def test_targets_by_repeated_sharing(spark):
    docs = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (5, "a"), (100, "b"), (7, None), (400, "c"), (0, "d")])] + [(9, None, "b"), (None, "x y", "c"), (9, None, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.rates(df).collect()}
    size = {"a": 15, "b": 100, "c": 402, "d": 0, None: 7}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    total, left, target, open_ = sum(size.values()), float(sum(size.values())), {}, list(size)
    while True:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w >= 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
        left, open_ = total - sum(target.values()), [s for s in open_ if s not in over]
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    for i, _, s in docs:
        assert got[i].target == pytest.approx(target[s]) and got[i].taken <= 3 * got[i].size
    assert mixing.rates(df.limit(0)).count() == 0
    duck = duckdb.connect()
    frame = df.toPandas()
    duck.register("frame", frame)
    duck.execute("create view documents as select cast(doc_id as bigint) doc_id, text, source from frame")
    want = duck.execute(mixing.ORACLE).df()
    assert sorted(want.taken) == sorted(r.taken for r in mixing.rates(df).collect())


def test_mixed_repeats_rows(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i % 4 else "b", i) for i in range(40)], "doc_id long, text string, source string, _x int")
    copies = {r.doc_id: r.copies for r in mixing.rates(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n == {k: v for k, v in copies.items() if v}


@pytest.mark.parametrize(
    "text,base,found",
    [
        ("mail bob@x.example.com now", ["bob@x.example.com"], []),
        ("bob [at] mail [dot] example [dot] com ok", [], ["bob [at] mail [dot] example [dot] com"]),
        ("write jane dot doe at site dot org", [], ["jane dot doe at site dot org"]),
        ("plus one five five five one two three four five six seven", [], ["plus one five five five one two three four five six seven"]),
        ("ip one nine two dot one six eight dot zero dot one end", [], ["one nine two dot one six eight dot zero dot one"]),
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ yes", [], ["ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"]),
        ("a​b@c​d.com", [], ["a​b@c​d.com"]),
        ("card 4111 1111 1111 1111, ip 10.0.0.256", ["4111 1111 1111 1111"], []),
        ("+1 (017) 555-7713", ["+1 (017) 555-7713"], []),
        ("look at this.Then go. one two three steps at home. dot com", [], []),
        ("", [], []),
    ],
)
def test_spans(text, base, found):
    b = pii.base_spans(text)
    assert [text[s:e] for s, e, _ in b] == base
    assert [text[s:e] for s, e, k in pii.all_spans(text) if (s, e, k) not in b] == found


@pytest.mark.parametrize(
    "text,found",
    [
        ("call +1 555 one two three 4567 now", ["+1 555 one two three 4567"]),
        ("call +1 555 123 456 seven now", ["+1 555 123 456 seven"]),
        ("plus 1 555 123 4567 ok", ["plus 1 555 123 4567"]),
        ("host 10 [dot] 0 [dot] 0 [dot] 7 up", ["10 [dot] 0 [dot] 0 [dot] 7"]),
        ("host 10(dot)0(dot)0(dot)7 up", ["10(dot)0(dot)0(dot)7"]),
        ("host 192 dot 168 dot 1 dot 20 up", ["192 dot 168 dot 1 dot 20"]),
        ("host one ninety, 192[.]168[.]one[.]20 up", ["192[.]168[.]one[.]20"]),
        ("host 192 dot 168 dot 1 dot 256 up", []),
        ("bob1 [dot] 2 at site dot one dot com", ["bob1 [dot] 2 at site dot one dot com"]),
        ("one or two of the 3 points, one dot", []),
    ],
)
def test_mixed_disguises(text, found):
    base = pii.base_spans(text)
    assert [text[s:e] for s, e, k in pii.all_spans(text) if (s, e, k) not in base] == found


def test_mask(spark):
    df = spark.createDataFrame([(1, "a b@c.de f", 10), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.mask_pii(df).orderBy("doc_id").collect()] == [(1, "a [EMAIL] f", 11), (2, None, None), (3, "clean", 5)]
    assert [r.n_email for r in pii.find_pii(df).orderBy("doc_id").collect()] == [1, 0, 0]
