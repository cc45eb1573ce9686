import hashlib
import json
import re

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm import chat, langid, secrets, warc


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ x", "é" * 5000), (2, "u", "é" * 5000), (3, None, None), (4, "v", ""), (5, "w", "a" * 999), (6, "w", "a" * 999), (None, "q", "zz\r\n\r\nWARC/1.1\r\n" * 300), (7, "q", "zz\r\n\r\nWARC/1.1\r\n" * 300), (9, "k", "x漢" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df, chunk=700, most_records=3).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert (got[1].record_type, got[1].refers_to, got[None].refers_to) == ("revisit", 2, 7)
    assert got[5].record_type == got[6].record_type == "response"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_language_gradients_and_accuracy(spark):
    net = langid.Network(["a", "b"], hidden=3)
    x, y = np.frombuffer(b"abcdefgh", np.uint8).reshape(2, 4), np.array([0, 1])
    _, grads = net.gradients(x, y)
    for ws, gs in zip(net.weights(), grads):
        for k, w in ws.items():
            at = tuple(np.argwhere(np.abs(gs[k]) == np.abs(gs[k]).max())[0])
            keep, eps = w[at], np.float32(1e-2)
            w[at] = keep + eps
            up = net.gradients(x, y)[0]
            w[at] = keep - eps
            down = net.gradients(x, y)[0]
            w[at] = keep
            assert abs((up - down) / (2 * eps) - gs[k][at]) < 5e-3
    docs = [(i, ("the of and to " if i % 2 else "der und die das ") * 8 + str(i), "en" if i % 2 else "de") for i in range(200)] + [(900, None, "en"), (901, "123 !!", "de"), (902, "und der", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(df.select("doc_id", "text"), fit_on=df).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in docs[:200])
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[902].lang_pred == "de"
    assert langid.identify(df.limit(0)).count() == 0


def test_chat_links_and_order(spark):
    tag = lambda k, v: f"<{k}>{json.dumps(v)}</{k}>"
    schema = tag("tool_schema", {"name": "f", "parameters": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 0}}}})
    rows = [
        (1, 0, "system", schema),
        (1, 1, "assistant", "go" + tag("tool_call", {"name": "f", "id": "b", "arguments": {"x": 1.0, "y": {"$result": "a"}}})),
        (1, 2, "tool", tag("tool_result", {"id": "a", "content": 1})),
        (1, 3, "assistant", tag("tool_call", {"id": "a", "name": "f", "arguments": {"x": -1}})),
        (1, 4, "tool", tag("tool_result", {"id": "zz", "content": 1}) + "<tool_call>{bad</tool_call>"),
        (2, 0, None, None),
        (None, 0, "user", "plain"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).collect()
    by = {(r.kind, r.call_id): r for r in got if r.kind in ("call", "result")}
    assert by["call", "a"].linked and by["call", "a"].problems == "$.x: range"
    assert not by["call", "b"].linked and by["call", "b"].problems == ""
    assert by["result", "zz"].problems == "no call"
    place = lambda r: (r.at_turn, r.at_level, r.turn, r.seq)
    assert place(by["call", "a"]) < place(by["result", "a"]) < place(by["call", "b"])
    assert json.loads(by["call", "b"].json)["arguments"]["x"] == 1 and '"x":1,' in by["call", "b"].json
    assert [r.json for r in got if r.conv_id == 2] == ['{"content":null,"role":null,"turn":0}']
    assert chat.format_chats(df.limit(0)).count() == 0


def test_secrets(spark):
    found = secrets.labelled(spark)
    f = secrets.features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    rows = found.select(*[f[k].alias(k) for k in secrets.FEATURES], "label").collect()
    x, y = np.array([[r[k] for k in secrets.FEATURES] for r in rows]), np.array([r.label for r in rows], float)
    half = np.random.default_rng(0).random(len(y)) < 0.5
    forest = secrets.train(x[half], y[half])
    assert ((secrets.vote(forest, x[~half]) >= 0.5) == y[~half]).mean() > 0.95
    texts = [(1, 'a token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" b', "s"), (2, "commit cb1a9fee807a05366fcb8b6c95c7c565ede51a72", None), (3, None, "s"), (4, "", "s"), (5, "é plain words only", "s")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert set(got) == {1, 2} and got[1].is_secret and not got[2].is_secret
    assert texts[0][1][got[1].start : got[1].start + got[1].length] == "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"
    assert secrets.scan(df.limit(0)).count() == 0


def test_candidates_against_brute_force(spark):
    word = "abcdefgh12345678"
    texts = [f"key={word} {word}={word}== {word},{word}x é " * 5, word, f"{word}=={word}", "none here", f"漢 {word} " + "y" * 60 + f" {word}" * 4]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    want = [(i, m.start(), m[0], t[max(m.start() - secrets.BEFORE, 0) : m.start()], t[m.end() : m.end() + secrets.AFTER], "") for i, t in enumerate(texts) for m in re.finditer(secrets.CANDIDATE, t)]
    assert sorted(map(tuple, secrets.candidates(df, "doc_id", "text", "source").collect())) == sorted(want)
