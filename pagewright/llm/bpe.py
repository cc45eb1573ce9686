"""Operator 1: BPE encoding and decoding as bounded-lookahead transducers.

Encoding. Applying merge rules in rank order has one result for each string, and
the results of the prefixes of a string hang together: the last token of a
prefix is the one token that ends there and can follow the last token of what
stands before it, and two tokens can follow each other if the rules, applied to
both alone, give them back. ``WordTransducer`` reads a word symbol by symbol and
notes the last token of each prefix. Whatever comes next, the tokens of the whole
begin with those of one of the last few prefixes, so what all of these agree on
is stable and is emitted at once; only the rest is held. ``MergeList`` computes
the list's sufficient lookahead, by which a boundary is settled at the latest: what
happens at a place depends on symbols to its right only through a chain of
overlapping rules of falling rank, and one pass over the rules follows all chains.

``Encoder`` puts special tokens, normalisation and word splitting before it. A
text is cut at white space; a stretch without any goes through ``_Run`` in pieces,
which holds only the start of what may become a special token, what may compose
with the next character, and an apostrophe that may begin a contraction. No
result depends on where a text is cut.

Decoding. ``Decoder`` is a state machine over token ids. In ``tokens`` form it
emits what a tokenizer without a decoder gives (token strings joined by one
space); in ``text`` form it turns byte symbols into bytes, ends of words into
spaces, and bytes into text by an incremental UTF-8 decoder, so that a
character split over tokens is held until it is complete.

Null text is the empty text, which has no tokens.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import releasing, small_batches

#: Longest text piece that is looked at as a whole.
PIECE_CHARS = 1 << 16
#: Words with their tokens in each of two generations, and pairs of tokens that were
#: tried, kept by a worker. A full generation becomes the older one, whose words come
#: back when they are met again, so that frequent words stay.
MEMO_WORDS, MEMO_PAIRS = 150_000, 200_000
#: Longer words aren't kept.
MEMO_LEN = 48


def byte_symbols() -> list[str]:
    """The printable symbol of each byte, as byte-level BPE writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


SYMBOLS = byte_symbols()
_TO_SYMBOLS = {b: s for b, s in enumerate(SYMBOLS)}
_TO_BYTES = {s: b for b, s in enumerate(SYMBOLS)}


#: Stands for the token before the first one.
START = 1 << 31


def end_of_word(symbol: str) -> str:
    """The character for a symbol at the end of a word."""
    return chr(0x10000 + ord(symbol))


class MergeList:
    """Vocabulary and merge rules of a tokenizer file with ends of words.

    Inside, a token is a string with one character for each of its symbols; a
    symbol at the end of a word is another one than the same symbol within."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, special: dict[str, int]):
        self.suffix, self.special = suffix, special
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.ids = {self.symbols(t): i for t, i in vocab.items()}
        rules = [(self.symbols(a), self.symbols(b)) for a, b in merges]
        self.rank = {rule: r for r, rule in enumerate(rules)}
        made = {self.symbols(s) for b in SYMBOLS for s in (b, b + suffix)}
        self.proper = True
        for a, b in rules:
            self.proper &= a in made and b in made
            made.add(a + b)
        self.longest = max(map(len, self.ids))
        self.inside = {i: t for t, i in self.ids.items()}
        #: finds all tokens that end at a place, in one pass
        self.endings = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.endings.add_word(t, (i, len(t)))
        self.endings.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.lookahead = self._sufficient_lookahead(rules)

    def symbols(self, token: str) -> str:
        """A token with its last symbol and the end of word as one character."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + end_of_word(token[-1])
        return token

    def follows(self, before: int, token: int) -> bool:
        """Whether a token can come after another (START: at the start of a word)."""
        first, second = self.inside.get(before, ""), self.inside[token]
        got = self.apply(list(first + second)) == ([first, second] if first else [second])
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[before << 32 | token] = got
        return got

    def _sufficient_lookahead(self, merges: list[tuple[str, str]]) -> int:
        """The most symbols behind a boundary that can decide about it.

        reach(r): how far to the right of an application of rule r the symbols
        lie that can decide whether it takes place. A rule of lower rank does so
        if it starts inside r's span and ends behind it."""
        best: dict[str, int] = {}  # start of a rule's string -> most (length + reach)
        most = 1
        for a, b in merges:
            s = a + b
            reach = 0
            for k in range(1, len(s) + 1):
                far = best.get(s[-k:])
                if far is not None and far - k > reach:
                    reach = far - k
            for k in range(1, len(s)):
                if best.get(s[:k], 0) < len(s) + reach:
                    best[s[:k]] = len(s) + reach
            most = max(most, len(s) - 1 + reach)
        return most

    @classmethod
    def load(cls, path: str) -> MergeList:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        return cls(model["vocab"], merges, model.get("end_of_word_suffix") or "", special)

    def apply(self, symbols: list[str]) -> list[str]:
        """The tokens of a sequence of symbols, all rules applied."""
        rank = self.rank
        if len(symbols) <= 64 or not self.proper:
            return self._apply_short(symbols)
        while True:
            ranks = [rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            r = min(ranks)
            if r == 1 << 60:
                break
            i = ranks.index(r)
            a, b = symbols[i], symbols[i + 1]
            out, n = symbols[:i], len(symbols)
            while i < n:
                if symbols[i] == a and i + 1 < n and symbols[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
            if len(symbols) <= 64:
                return self._apply_short(symbols)
        return symbols

    def _apply_short(self, symbols: list[str]) -> list[str]:
        """One application at a time, the leftmost of the lowest rank."""
        get, none = self.rank.get, 1 << 60
        ranks = [get(p, none) for p in zip(symbols, symbols[1:])]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            made = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], made), none)
            if i < len(ranks):
                ranks[i] = get((made, symbols[i + 1]), none)
        return symbols


class WordTransducer:
    """Ids of one word, fed in pieces; ``feed`` returns what has become stable."""

    #: Symbols read, over the longest token, before it is looked what is stable.
    BLOCK = 64

    def __init__(self, merges: MergeList):
        self.m, self.pending = merges, ""
        # the symbols since the last boundary that came out, and of each of their
        # prefixes the last token and its length
        self.held, self.last, self.lens = "", [START], [0]

    def _read(self, symbols: str) -> None:
        m, last, lens, n = self.m, self.last, self.lens, len(self.held)
        self.held += symbols
        last += [0] * len(symbols)
        lens += [0] * len(symbols)
        pairs, back = m.pairs, max(0, n - m.longest)
        for at, (token, size) in m.endings.iter(self.held, back):
            at += 1
            if at <= n or lens[at] or at - size < back:
                continue
            before = last[at - size]
            fits = pairs.get(before << 32 | token)
            if fits is None:
                fits = m.follows(before, token)
            if fits:
                last[at], lens[at] = token, size
        if 0 in lens[1:]:
            raise ValueError("the merge list isn't proper: a prefix has no last token")

    def _take(self, end: int) -> list[int]:
        """The tokens up to a position that is a boundary for sure."""
        out, at = [], end
        while at:
            out.append(self.last[at])
            at -= self.lens[at]
        if end:
            self.held, self.last, self.lens = self.held[end:], self.last[end:], [0, *self.lens[end + 1 :]]
        return out[::-1]

    def stable(self) -> int:
        """The last position that the tokens of every continuation have as a boundary."""
        n = len(self.held)
        first = max(0, n - self.m.longest + 1)
        live, left = bytearray(n + 1), n + 1 - first
        live[first:] = b"\1" * left
        for at in range(n, 0, -1):
            if live[at]:
                if left == 1:
                    return at
                back = at - self.lens[at]
                left -= live[back]
                live[back] = 1
        return 0

    def feed(self, symbols: str) -> list[int]:
        symbols = self.pending + symbols  # the last symbol waits: it may end the word
        self.pending = symbols[-1:]
        out: list[int] = []
        for i in range(0, len(symbols) - 1, self.BLOCK):
            self._read(symbols[i : min(i + self.BLOCK, len(symbols) - 1)])
            if len(self.held) > self.m.longest + self.BLOCK:
                out += self._take(self.stable())
        return out

    def close(self) -> list[int]:
        """End of the word: the rest."""
        if self.pending:
            self._read(end_of_word(self.pending) if self.m.suffix else self.pending)
            self.pending = ""
        return self._take(len(self.held))

    def whole(self, symbols: str) -> list[int]:
        """All ids of a word at once."""
        if len(symbols) > self.BLOCK or not self.m.suffix:
            return [*self.feed(symbols), *self.close()]
        self._read(symbols[:-1] + end_of_word(symbols[-1]))
        return self._take(len(symbols))


_WIDE = re.compile("[^\x00-ɏ]")
#: Words by the tokenizer's rule, for texts of Latin letters up to U+024F and for all.
_LATIN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+"
)
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def _lower(text: str) -> str:
    """Lower case of each character by itself (no rule for a final sigma)."""
    if "Σ" in text:
        text = text.replace("Σ", "σ")
    return text.lower()


def words_of(text: str) -> list[str]:
    """The words of a text without special tokens."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = _lower(text)
    return _ANY.findall(text) if not text.isascii() and _WIDE.search(text) else _LATIN.findall(text)


def _joins_left(c: str) -> bool:
    """Whether a character can compose with what stands before it."""
    return not c.isascii() and (unicodedata.combining(c) != 0 or unicodedata.normalize("NFC", "a" + c) != "a" + c or 0x1100 <= ord(c) < 0x1200 or unicodedata.category(c)[0] == "M")


def _symbols_of(word: str) -> str:
    """The byte symbols of a word."""
    return word if word.isascii() and word.isalnum() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TO_SYMBOLS)


#: Ids, and the same as text joined by spaces.
Entry = tuple[tuple[int, ...], str]


class Encoder:
    """Encodes texts fed in pieces of any size; entries come out word by word, or
    for a long word in stable parts."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.memo: dict[str, Entry] = {}
        self.older: dict[str, Entry] = {}
        self.buffer, self.run = "", None
        specials = sorted(merges.special, key=len, reverse=True)
        if any(re.search(r"\s", t) for t in specials):
            raise ValueError("special tokens with white space aren't supported")
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.starts = {t[:k] for t in specials for k in range(1, len(t))}
        self.longest_special = max(map(len, specials), default=0)

    def entry(self, ids: list[int]) -> Entry:
        return tuple(ids), " ".join(map(str, ids))

    def of_word(self, word: str) -> Entry:
        got = self.memo.get(word) or self.older.get(word) or self.entry(WordTransducer(self.m).whole(_symbols_of(word)))
        if len(word) <= MEMO_LEN:
            if len(self.memo) >= MEMO_WORDS:
                self.older, self.memo = self.memo, {}
            self.memo[word] = got
        return got

    def of_special(self, token: str) -> Entry:
        return (self.m.special[token],), str(self.m.special[token])

    def _of_words(self, words: list[str]) -> list[Entry]:
        known, new = self.memo.get, self.of_word
        return [known(w) or new(w) for w in words]

    def _of_piece(self, text: str) -> list[Entry]:
        """Of a piece that begins and ends at white space or at an end of the text."""
        if self.special is None or not self.special.search(text):
            return self._of_words(words_of(text))
        out: list[Entry] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(self.of_special(part))
            elif part:
                out += self._of_words(words_of(part))
        return out

    def feed(self, text: str) -> list[Entry]:
        """More of the text; what has become certain comes out."""
        out: list[Entry] = []
        if self.run is not None:
            m = _CUT.search(text)
            out += self.run.feed(text[: m.start()] if m else text, m is not None)
            if m is None:
                return out
            self.run, text = None, text[m.start() :]
        self.buffer += text
        cut = max(self.buffer.rfind(" "), self.buffer.rfind("\n"))
        if cut > 0:
            piece, self.buffer = self.buffer[:cut], self.buffer[cut:]
            out += self._of_piece(piece)
        if len(self.buffer) > PIECE_CHARS:  # a long stretch without white space
            self.run = _Run(self)
            piece, self.buffer = self.buffer, ""
            out += self.run.feed(piece[1:] if piece[0] in " \n" else piece, False)
        return out

    def close(self) -> list[Entry]:
        """End of the text."""
        if self.run is not None:
            run, self.run = self.run, None
            return run.feed("", True)
        piece, self.buffer = self.buffer, ""
        return self._of_piece(piece)

    def entries(self, pieces: Iterable[str]) -> Iterator[list[Entry]]:
        for piece in pieces:
            if piece:
                yield self.feed(piece)
        yield self.close()

    def encode(self, text: str) -> list[int]:
        """All ids of one text."""
        return [i for es in self.entries(text[k : k + PIECE_CHARS] for k in range(0, len(text), PIECE_CHARS)) for ids, _ in es for i in ids]


_CUT = re.compile("[ \n]")
_SPACES = regex.compile(r"\p{White_Space}*")
_OPEN = {"L": regex.compile(r"\p{L}*"), "S": regex.compile(r"[^\p{White_Space}\p{L}\p{N}]*")}


class _Run:
    """Encodes a stretch without blanks or line ends, fed in pieces of any size.

    Three stages follow each other; each holds only what the next characters
    could still change: ``raw`` what may begin a special token, ``tail`` what may
    compose with the next character, ``text`` what may be a contraction. The last
    word stays open in its transducer."""

    def __init__(self, encoder: Encoder):
        self.e = encoder
        self.raw = self.tail = self.text = ""
        self.word: WordTransducer | None = None
        self.kind = ""

    def feed(self, text: str, last: bool) -> list[Entry]:
        raw, out, at, special = self.raw + text, [], 0, self.e.special
        keep = len(raw)
        if special is not None:
            # a match that more characters could make longer waits
            sure = len(raw) if last else len(raw) - self.e.longest_special + 1
            while (m := special.search(raw, at)) and m.start() < sure:
                out += self._plain(raw[at : m.start()], True)
                out.append(self.e.of_special(m[0]))
                at = m.end()
            if not last:
                starts = (k for k in range(max(at, len(raw) - self.e.longest_special), len(raw)) if raw[k:] in self.e.starts)
                keep = m.start() if m else next(starts, len(raw))
        self.raw = raw[keep:]
        return out + self._plain(raw[at:keep], last)

    def _plain(self, piece: str, last: bool) -> list[Entry]:
        """Text between special tokens; ``last`` if it ends here."""
        self.tail += piece
        cut = len(self.tail)
        if not last:
            cut -= 1
            while cut > 0 and _joins_left(self.tail[cut]):
                cut -= 1
            cut = max(cut, 0)
        ready, self.tail = self.tail[:cut], self.tail[cut:]
        self.text += _lower(ready if ready.isascii() else unicodedata.normalize("NFC", ready))
        return self._words(last)

    def _words(self, last: bool) -> list[Entry]:
        out, at, text = [], 0, self.text
        while True:
            if self.word is not None:
                end = _OPEN[self.kind].match(text, at).end()
                tokens = self.word.feed(_symbols_of(text[at:end])) if end > at else []
                at = end
                if at < len(text) or last:
                    tokens += self.word.close()
                    self.word = None
                if tokens:
                    out.append(self.e.entry(tokens))
                if self.word is not None:
                    break
            at = _SPACES.match(text, at).end()
            if at == len(text) or text[at] == "'" and len(text) - at < 3 and not last:
                break
            m = _ANY.match(text, at)
            if m.end() == len(text) and not last and (kind := "L" if text[m.end() - 1] != "'" and _LETTER.match(m[0]) else "S" if _SIGN.match(m[0]) and not _CONTRACTED.fullmatch(m[0]) else ""):
                self.word, self.kind = WordTransducer(self.e.m), kind
            else:
                out.append(self.e.of_word(m[0]))
                at = m.end()
        self.text = text[at:]
        return out


_LETTER, _SIGN = regex.compile(r"\p{L}"), regex.compile(r"[^\p{White_Space}\p{L}\p{N}]")
_CONTRACTED = re.compile("'s|'t|'re|'ve|'m|'ll|'d")


class Decoder:
    """Token ids to text, fed in pieces."""

    def __init__(self, merges: MergeList, form: str = "text"):
        if form not in ("text", "tokens"):
            raise ValueError("form is text or tokens")
        self.m, self.form, self.first = merges, form, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        tokens = self.m.tokens
        if self.form == "tokens":
            said = " ".join([tokens[i] for i in ids if i in tokens])
            first, self.first = self.first, self.first and not said
            return said if first or not said else " " + said
        out: list[str] = []
        for i in ids:
            token = tokens.get(i)
            if token is None:
                continue
            if token in self.m.special:
                out.append(self.utf8.decode(b"", True) + token)
                self.utf8.reset()
            else:
                end = bool(self.m.suffix) and token.endswith(self.m.suffix)
                body = token[: -len(self.m.suffix)] if end else token
                out.append(self.utf8.decode(bytes(_TO_BYTES[s] for s in body)))
                if end:
                    out.append(self.utf8.decode(b" "))
        return "".join(out)

    def close(self) -> str:
        """What an unfinished character leaves."""
        return "" if self.form == "tokens" else self.utf8.decode(b"", True)


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = Encoder(MergeList.load(path))
    _loaded[path].buffer, _loaded[path].run = "", None  # a task may have ended within a text
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Encode and decode every text: the id, ``n_tokens``, ``ids_sha256`` (of
    the decimal ids joined by one space), ``decoded_sha256`` (of what ``Decoder``
    makes of the ids in ``tokens`` form, as a tokenizer without a decoder does),
    and with ``with_text`` the ids and the text they decode to.

    Null text counts as empty. Rows stay as they are, repeated ones and null ids
    too; an empty table gives an empty one; other columns aren't read. No
    shuffle: each row is by itself."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if with_text else ""

    @releasing
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            counts, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n, h_ids, h_text, kept, sep = 0, hashlib.sha256(), hashlib.sha256(), [], ""
                dec = Decoder(enc.m, "tokens")
                for es in enc.entries(text[i : i + PIECE_CHARS] for i in range(0, len(text), PIECE_CHARS)):
                    if not es:
                        continue
                    ids = list(chain.from_iterable([e[0] for e in es]))
                    n += len(ids)
                    h_ids.update((sep + " ".join([e[1] for e in es])).encode())
                    h_text.update(dec.feed(ids).encode())
                    sep = " "
                    if with_text:
                        kept += ids
                counts.append(n)
                ids_sha.append(h_ids.hexdigest())
                text_sha.append(h_text.hexdigest())
                if with_text:
                    dec = Decoder(enc.m)
                    all_ids.append(kept)
                    all_text.append(dec.feed(kept) + dec.close())
            cols = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
