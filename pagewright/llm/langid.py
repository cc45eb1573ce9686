"""Operator 7: language identification by a bidirectional gated recurrent network.

The network reads the bytes of a whole text, white space and signs included (A-Z
in lower case). One
layer reads forwards and one backwards; their states are carried from byte to
byte over the text. Every byte position gets probabilities of all languages from
the two states there, and a document's probabilities are the mean over all its
positions. Trained in numpy by backpropagation through time with Adam.

A text longer than ``SEGMENT`` bytes is run as several lanes side by side, each a
segment with the ``CONTEXT`` bytes before and behind it. These bytes bring the
states to where reading the text from its ends would have brought them (the
gates forget what lies further back) and count for the neighbour's positions
only; a test compares both ways of reading. So a task holds a bounded number of
lanes of bounded length, whatever the length of a text.

Learning takes a bounded sample: of every language the labelled document of the
least hash in each of ``SAMPLE_BUCKETS`` buckets, that isn't held out, and of each
``WINDOWS`` windows of ``WINDOW`` characters at hash-seeded places in its whole
text. The hash is of id and text, so reruns take the same rows.

Null text and text without a letter are ``und`` with score 0, as is everything
when no labelled row can be learned from. Null ids are never learned from and
not held out. Repeated rows get equal results, an empty table gives an empty one.
Other columns aren't read; columns named ``lang_pred`` or ``score`` are replaced
by ``identify`` and kept as they are by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, releasing, small_batches, text_bytes

#: Positions of a lane, and the bytes on each side that only warm its states up.
SEGMENT, CONTEXT = 2048, 256
#: Lanes run side by side at most.
LANES = 2048
#: Labelled documents learned from, at most so many a language; windows of each, and their characters.
SAMPLE_BUCKETS, WINDOWS, WINDOW = 400, 12, 96
#: The code of no byte; its gates keep the state as it is.
PAD = 256
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """The held-out fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def read_bytes(text: str) -> bytes:
    """What the network reads of a text: its UTF-8 bytes, A-Z in lower case."""
    return text_bytes(text).translate(LOWER)


class Direction:
    """One gated recurrent layer. All arrays have a column per lane."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.w = {
            "E": (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32),
            "U": (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
        }
        self.w["E"][PAD] = [100.0] * hidden + [0.0] * (2 * hidden)

    def run(self, codes: np.ndarray, widths: np.ndarray, backwards: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(position, states there) from end to end. codes: (length, lanes), longer
        lanes first; at position t the first widths[t] lanes are worked on."""
        H, E, U = self.h, np.ascontiguousarray(self.w["E"].T), np.ascontiguousarray(self.w["U"].T)
        width, h = 0, np.zeros((H, 0), np.float32)
        for t in range(len(codes) - 1, -1, -1) if backwards else range(len(codes)):
            if widths[t] != width:
                was, width = h, int(widths[t])
                both = min(was.shape[1], width)
                h = np.zeros((H, width), np.float32)
                h[:, :both] = was[:, :both]
                a, u, c = (np.empty((k, width), np.float32) for k in (3 * H, 3 * H, H))
            np.take(E, codes[t, :width], axis=1, out=a)
            np.dot(U, h, out=u)
            gates = u[: 2 * H]
            gates += a[: 2 * H]
            gates *= 0.5
            np.tanh(gates, out=gates)  # the logistic function by way of tanh
            gates *= 0.5
            gates += 0.5
            np.multiply(u[H : 2 * H], u[2 * H :], out=c)
            c += a[2 * H :]
            np.tanh(c, out=c)
            h -= c
            h *= u[:H]
            h += c
            yield t, h

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """States (length, hidden, lanes) and what the way back needs."""
        H, E, U = self.h, self.w["E"].T, self.w["U"].T
        h, states, tape = np.zeros((H, codes.shape[1]), np.float32), [], []
        for code in codes:
            a, u = E[:, code], U @ h
            gates = 0.5 * np.tanh(0.5 * (a[: 2 * H] + u[: 2 * H])) + np.float32(0.5)
            z, r = gates[:H], gates[H:]
            c = np.tanh(a[2 * H :] + r * u[2 * H :])
            tape.append((h, z, r, c, u[2 * H :]))
            h = c + z * (h - c)
            states.append(h)
        return np.array(states), tape

    def backward(self, codes: np.ndarray, tape: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weights from those of the states."""
        U, carry, g_u = self.w["U"], np.zeros_like(grad[0]), np.zeros_like(self.w["U"])
        inputs = np.empty((len(tape), 3 * self.h, codes.shape[1]), np.float32)
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, c, u = tape[t]
            d = grad[t] + carry
            da = d * (1 - z) * (1 - c * c)
            dz, dr = d * (h - c) * z * (1 - z), da * u * r * (1 - r)
            du = np.concatenate([dz, dr, da * r])
            inputs[t] = np.concatenate([dz, dr, da])
            g_u += h @ du.T
            carry = d * z + U @ du
        flat, at = inputs.transpose(1, 0, 2).reshape(3 * self.h, -1), codes.ravel()
        g_e = np.stack([np.bincount(at, row, 257) for row in flat], axis=1).astype(np.float32)
        g_e[PAD] = 0
        return {"E": g_e, "U": g_u}


class Network:
    """Both directions and the output layer."""

    def __init__(self, languages: list[str], hidden: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.on, self.back = languages, Direction(hidden, rng), Direction(hidden, rng)
        self.out = {"V": (rng.standard_normal((2 * hidden, len(languages))) * 0.1).astype(np.float32), "b": np.zeros(len(languages), np.float32)}

    def pooled(self, codes: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sums of the probabilities over the positions that count: (languages, lanes).

        codes: (length, lanes) with PAD behind a lane's length, lengths falling;
        counts: the positions [from, to) of each lane that count, (2, lanes)."""
        H, total = self.on.h, np.zeros((len(self.languages), codes.shape[1]), np.float32)
        steps = np.arange(len(codes))
        active = len(lengths) - np.searchsorted(lengths[::-1], steps, side="right")
        grain = max(16, codes.shape[1] // 16)
        widths = np.minimum(-(-active // grain) * grain, codes.shape[1])
        V, W = (np.ascontiguousarray(v.T) for v in (self.out["V"][:H], self.out["V"][H:]))
        said = [None] * len(codes)
        for t, h in self.on.run(codes, widths, False):
            said[t] = V @ h + self.out["b"][:, None]
        for t, h in self.back.run(codes, widths, True):
            e = W @ h
            e += said[t]
            said[t] = None
            e -= e.max(axis=0)
            np.exp(e, out=e)
            e *= ((counts[0, : e.shape[1]] <= t) & (t < counts[1, : e.shape[1]])) / e.sum(axis=0)
            total[:, : e.shape[1]] += e
        return total

    def label(self, text: bytes) -> np.ndarray:
        """Probabilities of each language at every byte of one text, read from end
        to end: (positions, languages)."""
        codes = np.frombuffer(text, np.uint8).astype(np.int64)[:, None]
        one = np.ones(len(codes), np.int64)
        states = np.zeros((len(codes), 2 * self.on.h), np.float32)
        for t, h in self.on.run(codes, one, False):
            states[t, : self.on.h] = h[:, 0]
        for t, h in self.back.run(codes, one, True):
            states[t, self.on.h :] = h[:, 0]
        e = states @ self.out["V"] + self.out["b"]
        e = np.exp(e - e.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[dict[str, np.ndarray]]]:
        """Mean cross-entropy over all bytes of the texts x (lanes, length), padded
        at their ends, of languages y, and the gradients of all weights."""
        codes, H = np.ascontiguousarray(x.T).astype(np.int64), self.on.h
        f, tape_f = self.on.forward(codes)
        b, tape_b = self.back.forward(codes[::-1])
        s = np.concatenate([f, b[::-1]], axis=1)  # (length, 2 hidden, lanes)
        flat = s.transpose(1, 0, 2).reshape(2 * H, -1)
        e = self.out["V"].T @ flat + self.out["b"][:, None]
        e = np.exp(e - e.max(axis=0))
        p = e / e.sum(axis=0)
        there, at = (codes != PAD).ravel(), (np.tile(y, len(codes)), np.arange(codes.size))
        n = int(there.sum())
        loss = float(-(np.log(p[at] + 1e-12) * there).sum() / n)
        p[at] -= 1
        p *= there / np.float32(n)
        ds = (self.out["V"] @ p).reshape(2 * H, len(codes), -1).transpose(1, 0, 2)
        return loss, [
            self.on.backward(codes, tape_f, ds[:, :H]),
            self.back.backward(codes[::-1], tape_b, ds[::-1, H:]),
            {"V": flat @ p.T, "b": p.sum(axis=1)},
        ]

    def weights(self) -> list[dict[str, np.ndarray]]:
        return [self.on.w, self.back.w, self.out]


def train(texts: list[tuple[str, str]], hidden: int = 12, steps: int = 220, batch: int = 160, rate: float = 0.015, seed: int = 7) -> Network | None:
    """Fit a network to (text, language) pairs; languages get equal shares of a batch."""
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    net, rng = Network(languages, hidden, seed), np.random.default_rng(seed)
    by = [[b for t, lang in texts if lang == name and (b := read_bytes(t)[:WINDOW])] for name in languages]
    have = [i for i, some in enumerate(by) if some]
    if not have:
        return net
    mean = {id(w): (np.zeros_like(w), np.zeros_like(w)) for ws in net.weights() for w in ws.values()}
    for step in range(1, steps + 1):
        y = rng.choice(have, size=batch)
        x = np.full((batch, WINDOW), PAD, np.uint16)
        for row, c in zip(x, y):
            some = by[c][rng.integers(len(by[c]))]
            row[: len(some)] = np.frombuffer(some, np.uint8)
        _, grads = net.gradients(x, y)
        now = rate * min(1.0, 2.0 * (1 - (step - 1) / steps))
        for ws, gs in zip(net.weights(), grads):
            for name, w in ws.items():
                g = np.clip(gs[name], -1, 1)
                m, v = mean[id(w)]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _lanes(texts: list[bytes], segment: int, context: int) -> list[tuple[int, int, int, int]]:
    """(text, from, to, first counting position) of every lane; what counts are
    ``segment`` positions from there, or fewer at the text's end."""
    return [(i, max(0, at - context), min(len(t), at + segment + context), at) for i, t in enumerate(texts) for at in range(0, len(t), segment)]


def probabilities(net: Network, texts: list[bytes], segment: int = SEGMENT, context: int = CONTEXT) -> np.ndarray:
    """Mean probabilities over the positions of each text, (texts, languages); 0 for an empty one."""
    out = np.zeros((len(texts), len(net.languages)))
    lanes = sorted(_lanes(texts, segment, context), key=lambda x: x[1] - x[2])
    for i in range(0, len(lanes), LANES):
        part = lanes[i : i + LANES]
        lengths = np.array([b - a for _, a, b, _ in part])
        codes = np.full((len(part), lengths[0]), PAD, np.int16)
        for row, (k, a, b, _) in zip(codes, part):
            row[: b - a] = np.frombuffer(texts[k], np.uint8, b - a, a)
        counts = np.array([(at - a, min(at + segment, len(texts[k])) - a) for k, a, _, at in part]).T
        np.add.at(out, [k for k, *_ in part], net.pooled(np.ascontiguousarray(codes.T), lengths, counts).T)
    return out / np.maximum([[len(t)] for t in texts], 1)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, buckets: int = SAMPLE_BUCKETS, windows: int = WINDOWS) -> list[tuple[str, str]]:
    """(window of a text, language): what is learned from; at most languages
    times buckets times windows, of ``WINDOW`` characters each."""
    usable = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    told = usable.select(F.col(text_col).alias("t"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.xxhash64(F.col(text_col)).alias("h2"))
    least = told.groupBy("lang", F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.min(F.struct("h", "h2")).alias("m"))
    # a handful of hashes a language; equal rows are one
    chosen = least.select("lang", "m.h", "m.h2").collect()
    if not chosen:
        return []
    picked = told.where(F.col("h").isin([r.h for r in chosen])).join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, h long, h2 long")), ["lang", "h", "h2"], "left_semi")
    at = lambda j: F.pmod(F.xxhash64("h", "h2", j), F.greatest(F.length("t") - WINDOW + 1, F.lit(1))) + 1
    cut = F.transform(F.sequence(F.lit(1), F.lit(windows)), lambda j: F.substr("t", at(j).cast("int"), F.lit(WINDOW)))
    rows = picked.select("lang", "h", "h2", cut.alias("w")).dropDuplicates(["lang", "h", "h2"]).collect()
    return [(w, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.h, r.h2)) for w in r.w]


def _told(net: Network | None, column) -> tuple[list[str], list[float]]:
    """Languages and scores of a column of texts."""
    texts = [t if t is not None and _LETTER.search(t) else None for t in column.to_pylist()]
    if net is None:
        return ["und"] * len(texts), [0.0] * len(texts)
    p = probabilities(net, [b"" if t is None else read_bytes(t) for t in texts])
    best = p.argmax(axis=1)
    langs = ["und" if t is None else net.languages[i] for t, i in zip(texts, best)]
    return langs, [0.0 if t is None else round(min(1.0, float(row[i])), 5) for t, row, i in zip(texts, p, best)]


def identify(docs: DataFrame, fit_on: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; learned from ``fit_on`` (else ``docs``)."""
    small_batches(docs.sparkSession)
    net = train(sample(docs if fit_on is None else fit_on, id_col, text_col, lang_col))
    docs = docs.drop("lang_pred", "score")
    names, at = docs.columns, docs.columns.index(text_col)

    @releasing
    def run(batches):
        for batch in batches:
            langs, scores = _told(net, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string", "score double"])
    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least_score: float, fit_on: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``least_score``, as they are."""
    small_batches(docs.sparkSession)
    net = train(sample(docs if fit_on is None else fit_on, id_col, text_col, lang_col))
    at = docs.columns.index(text_col)

    @releasing
    def run(batches):
        for batch in batches:
            langs, scores = _told(net, batch.column(at))
            yield batch.filter(pa.array([x != "und" and s >= least_score for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
