import hashlib
import random

import public_tokenizers
import pytest
import tokenizers

from pagewright.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Encoder(bpe.MergeList.load(PATH)), tokenizers.Tokenizer.from_file(PATH)


def test_list_is_proper_and_lookahead_is_finite(both):
    assert both[0].m.proper and 1 < both[0].m.lookahead < 10_000


def test_matches_library_on_random_texts(both):
    enc, lib = both
    rng = random.Random(1)
    letters = "ab'sStTreEvelLdD 019_-<|endoftext|>ééΣσİ \u0085 가中€\U0001f600\x1c٣²Ⅰ\n\t"
    for _ in range(400):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>x"])
        want = lib.encode(s, add_special_tokens=False).ids
        assert enc.encode(s) == want
        assert bpe.Decoder(enc.m, "tokens").feed(want) == lib.decode(want, skip_special_tokens=False)


def test_small_pieces_and_long_words(both, monkeypatch):
    enc, lib = both
    rng = random.Random(2)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 64)
    for _ in range(150):
        letters = rng.choice(["abcthein", "abcéàthe'", "!?-.", "ab12", "中文字abc", "aé e"])
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 900)))
        assert enc.encode(s) == lib.encode(s, add_special_tokens=False).ids
    s = "theinanre" * 3000
    assert enc.encode(s) == lib.encode(s, add_special_tokens=False).ids


def test_decoder_holds_split_characters(both):
    enc, _ = both
    d = bpe.Decoder(enc.m)
    assert "".join([*(d.feed([i]) for i in enc.encode("é中 ok")), d.close()]) == "é中 ok "


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Hi there", 5), (3, "Hi there", 5), (None, "x", 5)], "doc_id long, text string, n_tokens int")
    got = bpe.encode_documents(df, PATH, with_text=True).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 1, 2, 2]
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


HOSTILE = ["'" * 70000, "<|" * 40000, "<|endoftext|>" * 6000, "a" * 70000 + "'s'" * 30000, "<|endoftext" * 9000 + "|>", "é" * 50000 + "é" * 30000, "!" * 65535 + "'ll" + "x" * 70000, "中文" * 40000 + "<|startoftext|>'re"]


@pytest.mark.parametrize("i", range(len(HOSTILE)))
def test_long_texts_without_white_space(both, i):
    enc, lib = both
    rng = random.Random(i)
    noise = "".join(rng.choice(["'", "<|", "<|endoftext|>", "'s", "re", "é", "é", "x", "th", "1", "."]) for _ in range(60_000))
    for s in (HOSTILE[i], HOSTILE[i] + noise, noise + HOSTILE[i] + " " + noise):
        want = lib.encode(s, add_special_tokens=False).ids
        assert enc.encode(s) == want


def test_cuts_anywhere(both):
    enc, lib = both
    rng = random.Random(9)
    for _ in range(300):
        s = "".join(rng.choice(["'", "<|", "<|endoftext|>", "'s", "'r", "e", "é", "é", "̧", "x", "1", ".", "Σ", "\u0085", "가", "ᄀ", "ᅡ"]) for _ in range(rng.randint(1, 60)))
        run, at, got = bpe._Run(enc), 0, []
        while at < len(s):
            k = rng.randint(1, 9)
            got += run.feed(s[at : at + k], False)
            at += k
        got += run.feed("", True)
        assert [i for ids, _ in got for i in ids] == lib.encode(s, add_special_tokens=False).ids


def test_transducer_gives_what_the_rules_give(both):
    m, rng = both[0].m, random.Random(4)
    for _ in range(1500):
        word = "".join(rng.choice(rng.choice(["ab", "etaoin", "thinre", "aaab", "x1"])) for _ in range(rng.randint(1, 400)))
        t, out, at, most = bpe.WordTransducer(m), [], 0, 0
        while at < len(word):
            k = rng.randint(1, 90)
            out += t.feed(word[at : at + k])
            at, most = at + k, max(most, len(t.held))
        out += t.close()
        want = m.apply(list(word[:-1]) + [bpe.end_of_word(word[-1])])
        assert [m.inside[i] for i in out] == want
        assert most <= m.lookahead + m.longest + t.BLOCK


def test_tables(spark):
    lib = tokenizers.Tokenizer.from_file(PATH)
    texts = ["Hi <|endoftext|> it's", None, "", "x" * 70_000 + "'s", "日本 " * 20_000]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)] + [(0, texts[0], "n", 1)], "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = bpe.encode_documents(df, PATH).collect()
    assert len(got) == 6
    for r in got:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
