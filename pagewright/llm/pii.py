"""Operator 5: personal data with offset-preserving deobfuscation.

``base_spans`` finds plain e-mail addresses, IP addresses, card and phone
numbers. ``deobfuscate`` runs transducers over the text: one maps homoglyphs
(wide forms, mathematical letters, digits of other scripts, lookalikes, hidden
characters), one maps spelled digits and the words for plus and dot, one maps
at/dot disguises. Each keeps, for every stretch that it changes, where the
stretch lies in its input, so that a span found in the normal form is carried
back to the characters of the source. ``all_spans`` is base plus what only the
normal form shows; base spans always stay.

Every scanner takes one pass: no pattern can try the same characters in two
ways, so time grows in proportion to the text, whatever is in it.

Null text is empty and has no spans. Offsets count code points, ends exclusive.
Rows are by themselves: repeated rows get equal results, null ids stay null, an
empty table gives an empty one, other columns aren't read by ``find_pii`` and are
carried along as they are by ``mask_pii``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, place in KINDS

# --- base ---------------------------------------------------------------

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a start inside a run of digits can't match where the run's start didn't, so no digit is tried twice
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    # '@' is in no local part, so each match is the run before one '@' and the
    # domain after it.
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, without those that fail their test."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGITS.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


# --- transducers ----------------------------------------------------------


class Mapped:
    """A text made from another by replacing stretches of it."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        """``edits``: (start, end, replacement) in order, not overlapping."""
        parts: list[str] = []
        self.at: list[int] = []  # starts of the pieces in the new text
        self.piece: list[tuple[int, int, bool]] = []  # (start, end, kept as it is)
        n = pos = 0
        for start, end, new in edits:
            if start > pos:
                n = self._add(parts, n, source[pos:start], pos, start, True)
            if new:
                n = self._add(parts, n, new, start, end, False)
            pos = end
        if pos < len(source):
            n = self._add(parts, n, source[pos:], pos, len(source), True)
        self.text = "".join(parts)

    def _add(self, parts, n, new, start, end, kept):
        self.at.append(n)
        self.piece.append((start, end, kept))
        parts.append(new)
        return n + len(new)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the source that [start, end) of the new text stands for."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a, b = self.piece[i], self.piece[j]
        return (a[0] + start - self.at[i] if a[2] else a[0]), (b[0] + end - self.at[j] if b[2] else b[1])


# Characters that look like ASCII ones.
_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ⅼ": "l", "ǃ": "!",
    "\u3002": ".", "\u2024": ".", "\ufe52": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-", "\ufe63": "-", "\ufe6b": "@",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
    "\u00ad": "", "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "",
}


def _homoglyphs() -> dict[str, str]:
    """The lookalikes, the wide forms, the mathematical letters and digits, and
    the decimal digits of all scripts."""
    table = dict(_LOOKALIKES)
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in [*range(0x1D400, 0x1D800), *range(0x2460, 0x2469), 0x24EA, *range(0x24B6, 0x24EA)]:
        n = unicodedata.normalize("NFKC", chr(c))
        if len(n) == 1 and n.isascii():
            table[chr(c)] = n
    for c in range(0x660, 0x1FBFA):
        if unicodedata.category(chr(c)) == "Nd":
            table[chr(c)] = str(unicodedata.digit(chr(c)))
    return table


HOMOGLYPHS = _homoglyphs()
#: What is neither ASCII nor a common Latin letter or sign; only texts with such are looked at closely.
_UNUSUAL = re.compile("[^\x00-\x9f\xa1-\xac\xae-\u0130\u0132-\u0250]")


def homoglyphs(text: str) -> Mapped | None:
    """ASCII for characters that look like it."""
    edits = [(m.start(), m.end(), HOMOGLYPHS[m[0]]) for m in _UNUSUAL.finditer(text) if m[0] in HOMOGLYPHS]
    return Mapped(text, edits) if edits else None


# Spelled digits from zero to nine.
_SPELLED = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_WORD_DIGIT = {w: str(d) for line in _SPELLED.values() for d, w in enumerate(line.split())} | {"oh": "0"}
_DOT_WORDS = {"dot", "punkt", "point", "punto"}
_BRACKETED = r"[\[({<]\s*+(?:dot|punkt|point|punto|\.)\s*+[\])}>]"
_WORDS = "|".join(sorted([*_WORD_DIGIT, *_DOT_WORDS, "plus"], key=len, reverse=True))
#: A spelled digit or disguised dot beside another part of a number, in lower-case text.
_SOME_SPELLED = re.compile(rf"(?<!\w)(?:{_WORDS})(?!\w)[\s,.()-]{{0,3}}(?:(?:{_WORDS})(?!\w)|{_BRACKETED}|[0-9+.])|[0-9+][\s,.()-]{{0,3}}(?:(?<!\w)(?:{_WORDS})(?!\w)|{_BRACKETED})")
#: Parts of a number: words, digits that aren't part of a word, a plus sign, and a
#: dot behind a digit or what isn't part of a word. No part can be cut in two ways.
_PART = re.compile(rf"(?P<bracket>{_BRACKETED})|(?<!\w)(?:(?P<word>{_WORDS})(?!\w)|[0-9]++(?!\w)|\+|\.)|(?<=[0-9])\.", re.I)
#: What may stand between two parts, at most three characters of it.
_BETWEEN = re.compile(r"[\s,()-]{0,3}")


def _runs(text: str) -> Iterator[list[re.Match]]:
    """Runs of parts of numbers, in one pass."""
    run: list[re.Match] = []
    for part in _PART.finditer(text):
        if run and not _BETWEEN.fullmatch(text, run[-1].end(), part.start()):
            yield run
            run = []
        if run or part["bracket"] is None:  # a run doesn't begin with a bracket
            run.append(part)
    yield run


def spelled(text: str, least: int = 4) -> Mapped | None:
    """Digits for spelled digits in runs with ``least`` or more of them, spelled
    plus signs and disguised dots (0: in all runs)."""
    edits: list[tuple[int, int, str]] = []
    for run in _runs(text):
        words = [(t["word"] or "").lower() for t in run]
        if len(run) < 2 or sum(w in _WORD_DIGIT for w in words) < least or not (any(words) or any(t["bracket"] for t in run)):
            continue
        last, was_word = run[0].start(), True
        for t, w in zip(run, words):
            new = _WORD_DIGIT.get(w) or ("." if w in _DOT_WORDS or t["bracket"] else "+" if w == "plus" else None)
            if t.start() > last and (new is not None or was_word):  # what parts spelled digits goes
                edits.append((last, t.start(), ""))
            if new is not None:
                edits.append((t.start(), t.end(), new))
            last, was_word = t.end(), new is not None
    return Mapped(text, edits) if edits else None


# Ends of domain names that tell a bare "at" from a preposition.
_ENDINGS = "com|org|net|edu|gov|info|biz|io|co|de|fr|es|uk|eu|example|test|invalid"
_AT_WORDS = {"at", "ät", "arroba", "arobase"}
_DISGUISE_HINT = re.compile(r"[\[({<]\s*+(?:at|ät|arroba|arobase|@|dot|punkt|point|punto|\.)\s*+[\])}>]|\s(?:dot|punkt|punto|point)\s++[a-z]|\s(?:at|ät|arroba|arobase)\s++[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:%s)\b" % _ENDINGS)
#: Parts of an address: bracketed signs, names, plain signs.
_ADDRESS_PART = re.compile(r"(?P<bracket>[\[({<]\s*+(?P<said>at|ät|arroba|arobase|@|dot|punkt|point|punto|\.)\s*+[\])}>])|(?P<name>[A-Za-z0-9_%+-]+|(?<!\w)ät(?!\w))|(?P<sign>[@.])", re.I)
_DOMAIN_NAME = re.compile(r"[A-Za-z0-9-]*")
_KNOWN_END = re.compile(rf"(?:{_ENDINGS})\Z", re.I)


class _Chain:
    """Names of a text with the links between them: names[i] links[i] names[i + 1].
    A link is (kind, start, end, whether it is a bare word); white space around it is its own."""

    def __init__(self, first: tuple[int, int]):
        self.names, self.links = [first], []


def _chains(text: str) -> Iterator[_Chain]:
    """The chains of names and links, in one pass over the parts of addresses.

    A word for a sign is a link between two names that white space parts it
    from; elsewhere it is a name. Signs and brackets link over white space, but
    a plain dot touches both names."""
    chain: _Chain | None = None
    link: tuple[str, int, bool] | None = None  # kind, end, bare word
    for m in _ADDRESS_PART.finditer(text):
        start, end = m.span()
        if m["name"] is None:
            kind = "@" if (m["said"] or m["sign"]).lower() in _AT_WORDS or "@" in m[0] else "."
            tight = m["sign"] == "."
            gap = text[chain.names[-1][1] : start] if chain else "-"
            if chain and link is None and (not gap or not tight and gap.isspace()):
                link = (kind, end, False, tight)
            else:
                if chain:
                    yield chain
                chain = link = None
            continue
        if chain and link:
            gap = text[link[1] : start]
            if gap.isspace() and not link[3] or not gap and not link[2]:
                chain.links.append((link[0], chain.names[-1][1], start, link[2]))
                chain.names.append((start, end))
                link = None
                continue
            yield chain
            chain = link = None
        elif chain:
            word = m["name"].lower()
            if text[chain.names[-1][1] : start].isspace() and (word in _AT_WORDS or word in _DOT_WORDS):
                link = ("@" if word in _AT_WORDS else ".", end, True, False)
                continue
            yield chain
        chain, link = _Chain((start, end)), None
    if chain:
        yield chain


def disguised(text: str) -> Mapped | None:
    """'@' and '.' for the words and brackets that stand for them in an address.

    A bare word for "at" counts only with a disguised dot in the domain, or
    with a known ending after a plain one."""
    edits: list[tuple[int, int, str]] = []
    for chain in _chains(text):
        names, links, free = chain.names, chain.links, 0  # names before ``free`` are taken
        for at, (kind, a0, a1, bare) in enumerate(links):
            if kind != "@" or at < free:
                continue
            first = at
            while first > free and links[first - 1][0] == ".":
                first -= 1
            last, stop = at + 1, None
            while True:  # the domain goes on while whole names and dots do
                size = _DOMAIN_NAME.match(text, *names[last]).end() - names[last][0]
                if size < names[last][1] - names[last][0] or last == len(links) or links[last][0] != "." or not _DOMAIN_NAME.match(text, *names[last + 1])[0]:
                    stop = names[last][0] + size
                    break
                last += 1
            if last == at + 1 or names[first][0] and text[names[first][0] - 1] in _LOCAL_CHARS:
                continue
            dots = [x for x in links[first:last] if x[0] == "." and text[x[1] : x[2]] != "."]
            if bare and not any(x[1] > a0 for x in dots) and not _KNOWN_END.match(text[names[last][0] : stop]):
                continue
            edits += [(x[1], x[2], ".") for x in dots if x[1] < a0]
            if text[a0:a1] != "@":
                edits.append((a0, a1, "@"))
            edits += [(x[1], x[2], ".") for x in dots if x[1] > a0]
            free = last + 1
    return Mapped(text, edits) if edits else None


def deobfuscate(text: str) -> list[list[Mapped]]:
    """The transducers that changed something, in the order they ran: once for
    addresses, where a few spelled digits are words, and once with all runs of
    numbers made plain."""
    first: list[Mapped] = []
    if not text.isascii() and (m := homoglyphs(text)):
        first.append(m)
    now = first[-1].text if first else text
    chains, layers = [], list(first)
    low = now.lower()
    if _SOME_SPELLED.search(low):
        if m := spelled(now, 0):
            chains.append([*first, m])
        if m := spelled(now):
            layers.append(m)
            now = m.text
    if _DISGUISE_HINT.search(f" {now.lower()}") and (m := disguised(now)):
        layers.append(m)
    return [layers, *chains] if layers else chains


def all_spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """Base spans and those that only a normal form shows."""
    base = base_spans(text) if base is None else base
    chains = deobfuscate(text)
    if not chains:
        return base
    more = set()
    for layers in chains:
        for start, end, kind in base_spans(layers[-1].text):
            for layer in reversed(layers):
                start, end = layer.back(start, end)
            more.add((start, end, kind))
    # one sweep: what lies in another span of its kind adds nothing
    out, known, reach = list(base), set(base), [-1] * len(KINDS)
    for start, end, kind in sorted(known | more, key=lambda s: (s[0], -s[1])):
        if (start, end, kind) not in known and reach[kind] < end:
            out.append((start, end, kind))
        reach[kind] = max(reach[kind], end)
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def show(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, e, k in spans])


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the name of its first kind."""
    out, pos, i = [], 0, 0
    spans = sorted(spans)
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[pos:start], f"[{KINDS[kind].upper()}]"]
        pos = end
    return "".join([*out, text[pos:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base spans per kind, base_sha256, spans (all), and
    n_added (spans that only the normal form shows). Row by row, no shuffle."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts, sha, spans, added = [[] for _ in KINDS], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                every = all_spans(text, base)
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[2] == k for s in base))
                sha.append(hashlib.sha256(show(base).encode()).hexdigest())
                spans.append(show(every))
                added.append(len(every) - len(base))
            cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = f"{id_col} {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind in brackets,
    and the length column, where there is one, brought up to date. Null text stays null."""
    small_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    long_at = names.index(length_col) if length_col in names else None

    def run(batches):
        for batch in batches:
            texts = []
            for text in batch.column(at):
                text = text.as_py()
                spans = all_spans(text) if text else []
                texts.append(masked(text, spans) if spans else text)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.column(at).type)
            if long_at is not None:
                cols[long_at] = pa.array([None if t is None else len(t) for t in texts], cols[long_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)
