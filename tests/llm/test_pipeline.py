"""The five stages against a brute-force version of each, one after the other."""

import hashlib
import random

import duckdb
import pandas as pd
import public_tokenizers
import regex
import tokenizers

import corpus_pipeline
from pagewright.llm import jaccard, langid, mixing, pii
from pagewright.llm.common import Scratch

WORDS = {"en": "the of and to in is that for it with as was on be by this are from", "de": "der die und den von das mit sich des auf für ist im dem nicht ein"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _source string, lang_pred int"


def documents():
    rng, rows = random.Random(12), []
    for i in range(90):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "er", "n"]) for _ in range(rng.randint(8, 120)))
        rows.append((i, text + rng.choice(["", " write to bob@x.example.com", " call +1 555 one two three 4567", "<|endoftext|>"]), lang, rng.choice(["hot", "hot", "hot", "b", None])))
    for i in range(25):  # copies, exact and near
        text = rows[i][1]
        rows.append((200 + i, text if i % 2 else text + " und", rows[i][2], "b"))
    rows += [(400, None, "en", "hot"), (401, "", "de", "b"), (402, "1234 !! ??", "en", "hot"), (403, "the of and " * 9000, None, "b"), (None, "der die und den von das mit sich", "de", "b"), (5, rows[5][1], rows[5][2], rows[5][3])]
    return rows


def same_component(rows):
    """The rows that stay: of each component the one of the least id, once an id."""
    ids = [i for i, *_ in rows if i is not None]
    sets = {i: frozenset(jaccard.shingle_set(t).tolist()) for i, t, *_ in rows if i is not None}
    root = {i: i for i in ids}
    while True:
        new = {a: min([root[a], *(root[b] for b in sets if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))]) for a in sets}
        if new == root:
            break
        root = new
    out, seen = [], set()
    for r in rows:
        if r[0] is None:
            out.append(r)
        elif root[r[0]] == r[0] and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def test_five_stages_against_brute_force(spark, tmp_path):
    rows = documents()
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0.5, "x", 7) for i, t, lang, s in rows], SCHEMA)
    df.coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    net = langid.train(langid.sample(df, "doc_id", "text", "lang"))
    known = [r for r in rows if r[1] and regex.search(r"\p{L}", r[1]) and net.label(langid.read_bytes(r[1])).mean(axis=0).max() >= corpus_pipeline.LEAST_SCORE]
    assert len(known) < len(rows)
    kept = same_component(known)
    assert len(kept) < len(known) - 20
    clean = [(i, pii.masked(t, pii.all_spans(t)), s) for i, t, _, s in kept]
    assert any("[EMAIL]" in t for _, t, _ in clean) and any("[PHONE]" in t for _, t, _ in clean)
    duck = duckdb.connect()
    duck.register("frame", pd.DataFrame(clean, columns=["doc_id", "text", "source"]))
    duck.execute("create view documents as select cast(doc_id as bigint) doc_id, text, source from frame")
    copies = duck.execute(f"select doc_id, copies from ({mixing.ORACLE})").fetchall()
    times = {None if i is None else int(i): n for i, n in copies}
    lib, want = tokenizers.Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER)), []
    for i, t, _ in clean:
        ids = lib.encode(t, add_special_tokens=False).ids
        row = (str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        want += [row] * times[i]
    assert got == sorted(want)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.count() == 0, name
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_write_no_pairs_of_a_group_outside_the_radius(spark, monkeypatch):
    rng, rows, put = random.Random(9), {}, Scratch.put
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    base, docs = words(600), []
    for i in range(60):
        text = list(base)
        for k in rng.sample(range(120), 11):
            text[5 * k + 2] = words(1)[0]
        docs.append((i, " ".join(text)))
    docs.append((100, docs[0][1] + " end"))

    def counted(self, df, name):
        out = put(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept == [r[0] for r in same_component(docs)]
    assert max(v for k, v in rows.items() if not k.startswith(("regions-0", "open-"))) <= 3 * len(docs), rows


def test_near_duplicates_never_move_texts_to_pick_some(spark, monkeypatch):
    # more classes than are broadcast; before, texts went through a shuffled join
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.choice([3, 30, 90]))) for _ in range(60)]
    docs = [*enumerate(texts), (None, "of no id"), (300, None), (301, ""), (3, "another text of this id")]
    sets = {i: jaccard.shingle_set(t) for i, t in docs[:61]}
    picked = [i for i in sets if i is None or i % 3 == 0]
    want = {jaccard.digest(sets[i]): (len(sets[i]), sets[i].tobytes()) for i in picked}
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 2)
    for kind, name in (("long", lambda i: i), ("string", lambda i: None if i is None else f"{i:04d}")):
        df = spark.createDataFrame([(name(i), t) for i, t in docs], f"doc_id {kind}, text string")
        wanted = spark.createDataFrame([(jaccard.digest(sets[i]), name(i)) for i in picked], f"digest long, rep {kind}")
        # as many bits as are asked for; few, which many ids share; so few that all are set
        for most in (1 << 27, 64, 8):
            monkeypatch.setattr(jaccard, "ID_BITS", most)
            out = jaccard._sets(df, wanted, "doc_id", "text", jaccard.WIDTH, "members")
            plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
            at = next(k for k, line in enumerate(plan) if "MapInArrow" in line)
            depth = plan[at].index("MapInArrow")
            for line in plan[at + 1 :]:  # what stands below the function that reads texts
                if line.index("- ") + 2 <= depth:
                    break
                assert "Exchange" not in line, plan
            assert {r.digest: (r.n, bytes(r.members)) for r in out.collect()} == want


def test_near_duplicates_of_more_classes_than_are_broadcast(spark, monkeypatch):
    docs = [r[:2] for r in documents() if r[0] is not None]
    want = [r[0] for r in sorted(same_component(docs), key=lambda r: r[0])]
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == want
