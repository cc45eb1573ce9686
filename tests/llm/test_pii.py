import random
import re
import time

import pytest

from pagewright.llm import pii

# the contract, read directly
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def direct(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = [int(c) for c in m[0] if c.isdigit()]
        doubled = [x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])]
        if 14 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(PHONE, text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_against_the_contract_read_directly():
    rng, found = random.Random(8), 0
    for letters in ("ab.@-_", "0123456789. ", "+1 ().-9", "a1@.+ -", "04 -", "é1.2@\n+3", "255.0 1"):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
            want = direct(text)
            found += len(want)
            assert pii.base_spans(text) == want, text
    assert found > 1500


@pytest.mark.parametrize(
    "text",
    [
        "zero one " + "1" * 500_000 + "a",
        "a [dot] " + "b dot " * 170_000,
        "one two " + "1" * 30 + "a " + "9f" * 400_000,
        "at " + "a." * 500_000,
        "x at " + "b dot " * 100_000 + "at y dot org",
        "one two [" + " " * 1_000_000 + "]",
        "1." * 500_000,
        "1" * 1_000_000,
        "+1 " * 300_000,
        "one " * 250_000,
        "ab@cd.ef " * 50_000 + "x [at] y [dot] com",
        "( [ { " * 150_000 + "one two [dot]",
    ],
    ids=range(12),
)
def test_time_is_in_proportion(text):
    start = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - start < 8


def test_rows_of_every_kind(spark):
    rows = [(1, "a b@c.de f", "x", 1.0), (1, "a b@c.de f", "x", 1.0), (None, "call +1 555 one two three 4567", None, None), (2, None, "y", 0.0), (3, "", "z", 2.0), (4, "b@c.de " * 40_000, "z", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email double")
    got = pii.find_pii(df).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_phone, r.n_added) for r in got) == [(0, 0, 0, 1), (1, 1, 0, 0), (1, 1, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 40_000, 0, 0)]
    out = pii.mask_pii(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.spans) for r in out.collect() if r.doc_id != 4) == [(0, "call [PHONE]", None), (1, "a [EMAIL] f", "x"), (1, "a [EMAIL] f", "x"), (2, None, "y"), (3, "", "z")]
    assert pii.find_pii(df.limit(0)).count() == pii.mask_pii(df.limit(0)).count() == 0
