import random

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import common, jaccard, neardup, simhash
from pagewright.llm.common import Scratch
from pagewright.llm.components import components


def brute(docs):
    sets = {d: set(jaccard.shingle_set(t).tolist()) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_jaccard_join_is_exact(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(40)]
    docs = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 4, 6, 30, 120]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            docs.append((len(docs), " ".join(w)))
    docs += [(1000, ""), (1001, None), (1002, "One\ttwo"), (1003, "one TWO")]
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute(docs)
    kept = sorted(r.doc_id for r in jaccard.keep_one(df).collect())
    assert kept == sorted(d for d, (_, c) in got.items() if c == d)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_last_round_joins_windows_of_every_size(spark, monkeypatch):
    # pairs that meet over one shingle only: 12 members, 8 are left in the last round
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = min((" ".join(word() for _ in range(5)) for _ in range(3000)), key=lambda x: int(jaccard.shingle_set(x)[0]))
    texts = [f"{word()} {common} {word()}" for _ in range(6)]
    docs = list(enumerate(texts + [f"{t} {word()}" for t in texts]))
    least = jaccard.shingle_set(common)[0]
    assert all(jaccard.shingle_set(t)[0] == least for _, t in docs)
    monkeypatch.setattr(jaccard, "WHOLE_REGION", 9)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "HEAVY", 1000)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute(docs) and len({c for _, c in got.values()}) == 6


def test_a_shingle_shared_by_chance_makes_no_region(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = min((" ".join(word() for _ in range(5)) for _ in range(3000)), key=lambda x: int(jaccard.shingle_set(x)[0]))
    texts = [" ".join([common] + [word() for _ in range(n)]) for n in (5, 12, 30, 70, 160)]
    docs = list(enumerate(texts + [f"{texts[-1]} {word()}"]))
    rows, put = {}, Scratch.put

    def counted(self, df, name):
        out = put(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute(docs) and got[5][1] == 4
    # the one pair near enough in size is the one region
    assert rows["regions-0"] == 2 and rows["sketches"] == 2


def test_regions_hold_every_pair_within_the_radius():
    rng = np.random.default_rng(8)
    for num, den in ((75, 100), (1, 2), (9, 10), (1, 1)) * 6:
        sets = []
        for n in rng.choice([1, 2, 3, 4, 7, 8, 20, 50, 200], 12):
            base = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            for _ in range(5):
                k, m = rng.integers(0, n // 3 + 1, 2)
                sets.append(np.unique(np.concatenate([rng.permutation(base)[k:], rng.integers(0, 1 << 62, m, dtype=np.uint64)])))
        heavy = np.unique(np.concatenate([x[rng.random(len(x)) < 0.2] for x in sets]))
        heavy = np.stack([heavy, rng.permutation(len(heavy)).astype(np.uint64)])
        keys = [jaccard._ordered_prefix(x, heavy, num, den) for x in sets]
        column = lambda f, kind: [np.concatenate([np.asarray(f(x, k)).astype(kind) for x, k in zip(sets, keys)]).tobytes()]
        packed = pa.table(
            {
                "keys": column(lambda x, k: k >> np.uint64(32), np.uint32),
                "owners": column(lambda x, k: np.full(len(k), jaccard.digest(x)), np.int64),
                "sizes": column(lambda x, k: np.full(len(k), jaccard.size_code(len(x))), np.uint16),
                "places": column(lambda x, k: np.arange(len(k)) * 256 // len(x), np.uint8),
            }
        )
        members = {}
        for r in jaccard._regions(packed, num, den).to_pylist():
            members.setdefault(r["region"], set()).add(r["member"])
        for x in sets:
            for y in sets:
                both = len(np.intersect1d(x, y))
                a, b = jaccard.digest(x), jaccard.digest(y)
                if a < b and both * den >= num * (len(x) + len(y) - both):
                    assert any(a in m and b in m for m in members.values())


def test_a_group_just_outside_the_radius_writes_no_pairs(spark, monkeypatch):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]
    base, docs = words(600), []
    for i in range(80):  # a word in 11 of 120 stretches is the text's own, so that two share about 73 %
        text = list(base)
        for k in rng.sample(range(120), 11):
            text[5 * k + 2] = words(1)[0]
        docs.append((i, " ".join(text)))
    docs += [(100 + i, f"{docs[i][1]} {words(1)[0]}") for i in range(5)]
    rows, put = {}, Scratch.put

    def counted(self, df, name):
        out = put(self, df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute(docs) and len({c for _, c in got.values()}) > 50
    assert max(v for k, v in rows.items() if not k.startswith(("regions-0", "open-"))) <= 3 * len(docs), rows


def test_links_that_unite_are_those_of_brute_force(monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 50)
    rng = np.random.default_rng(4)
    for entries in (1 << 21, 300, 40):
        monkeypatch.setattr(jaccard, "PART_ENTRIES", entries)
        sets = []
        for n in (1, 3, 8, 20, 60, 60):
            base = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            for _ in range(5):
                k, m = rng.integers(0, n // 4 + 1, 2)
                sets.append(np.unique(np.concatenate([rng.permutation(base)[k:], rng.integers(0, 1 << 62, m, dtype=np.uint64)])))
        size = np.array([len(x) for x in sets])
        root = np.where(rng.random(len(sets)) < 0.8, np.arange(len(sets)), 0)  # some are united already
        found, times = list(enumerate(root)), 0
        for some in jaccard.parts(size):
            a, b = jaccard.uniting_links(some, root[some], [sets[i] for i in some])
            assert len(a) < len(some)
            found, times = found + list(zip(a, b)), times + 1
        assert (times == 1) == (entries == 1 << 21)
        links = [(x, y) for x in range(len(sets)) for y in range(x) if 175 * len(np.intersect1d(sets[x], sets[y])) >= 75 * (size[x] + size[y])]

        def classes(links):
            part = np.arange(len(sets))
            for x, y in links:
                part[part == part[x]] = part[y]
            return {tuple(np.flatnonzero(part == k)) for k in part}

        assert classes(found) == classes(links + list(enumerate(root))) and all((max(x, y), min(x, y)) in links for x, y in found[len(sets) :])


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400), dtype=np.uint64) * np.uint64(4))
        y = np.unique(np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 1 << 62, rng.integers(1, 300), dtype=np.uint64)]))
        assert jaccard.sketch_apart(jaccard.sketch(x), jaccard.sketch(y)) <= len(np.setxor1d(x, y))


def test_sketches_of_large_sets_are_smaller_than_the_set():
    # the pipeline's second stage moves one for each member of a region
    for n in (200, 1000, 20_000):
        x = np.unique(np.random.default_rng(n).integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(4))
        y = np.unique(np.random.default_rng(n + 1).integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(4))
        assert 2 * len(jaccard.sketch(x)) <= n
        # still enough to tell unrelated sets apart
        assert jaccard.sketch_apart(jaccard.sketch(x), jaccard.sketch(y)) * 175 > 2 * n * 25


def test_simhash(spark):
    docs = [(i, f"doc {i} " + " ".join(f"w{(i * 7 + k) % 90}" for k in range(60))) for i in range(30)] + [(50, None), (100, "same text here"), (150, "same text here"), (None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.fingerprints(df).collect()}
    order = sorted((d for d, _ in docs if d is not None), reverse=True) + [None]
    text = {d: t or "" for d, t in docs}
    for a, b in zip(order, order[1:] + order[:1]):
        new = simhash.edited(text[a], text[b])
        assert got[a].edited_sha256 == simhash.hashlib.sha256(new.encode()).hexdigest() and got[a].n_chars == len(text[a])
    assert got[100].fingerprint == got[150].fingerprint and got[150].near_next == 1.0
    for d, r in got.items():
        if d is not None and d % 50 == 0:
            near = sum((int(r.fingerprint, 16) ^ int(o.fingerprint, 16)).bit_count() <= 3 for o in got.values()) - 1
            assert r.n_within == near


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.12 * rng.standard_normal((30, 16)), base[:5]])
    rows = [(i, v.astype("float32").tolist(), i % 2 if i < 60 else (i - 60) % 2) for i, v in enumerate(x)]
    rows = [(i, v, (i if i < 60 else (i - 60) if i < 90 else i - 90) % 2) for i, v, _ in rows]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[0][1], None), (204, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    for i, v, label in rows:
        if i >= 200:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
            continue
        a = np.asarray(v, float)
        n = sum(j != i and j < 200 and o == label and a @ np.asarray(w, float) / np.linalg.norm(a) / np.linalg.norm(w) >= 0.93 for j, w, o in rows if w)
        assert got[i].n_links == n
    assert neardup.audit(df.where("vec_id < 200"), neardup.near_duplicates(df))[0] >= 0.9


def test_words_of_any_length_hash_alike_in_pieces(monkeypatch):
    rng = random.Random(6)
    data = [b"", b" ", b"x" * 5000, b" " * 3000 + b"y" * 4000 + b"\t" + b"z" * 999, " ".join("é" * rng.randint(1, 700) for _ in range(40)).encode(), bytes(rng.choice(b"ab \n") for _ in range(9000))]
    whole = [common.word_hashes(d) for d in data]
    assert [len(w) for w in whole] == [len(d.split()) for d in data]
    monkeypatch.setattr(common, "PIECE", 64)
    for d, want in zip(data, whole):
        assert np.array_equal(common.word_hashes(d), want)
        assert np.array_equal(np.concatenate([common.word_hashes(w) for w in d.split()] or [want]), want)


def test_components_that_do_not_settle_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    scratch = common.Scratch(spark, "cc-test")
    assert {r.root for r in components(links, scratch).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(links, scratch, "again", rounds=2)


def test_jaccard_rows_of_every_kind(spark):
    rows = [(1, "a b c d e f g h", "x"), (1, "a b c d e f g h", "x"), (None, "a b c d e f g h", None), (None, "q r s t u v", None), (2, None, "y"), (3, "", "z"), (4, "w" * 300_000, "z"), (5, "W" * 300_000, "z"), (6, "a b c d e f g h i", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.jaccard_components(df).collect())
    assert got == [(0, 2, 0), (0, 4, 1), (1, 4, 1), (1, 4, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 5, 1)]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    # rows with a null id stay, a repeated id keeps one row
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4]
    assert jaccard.keep_one(df.limit(0)).count() == 0
