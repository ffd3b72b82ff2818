"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, bound_batches, crc_fold, text_slices, whole_rows

UNDETERMINED = "und"
STEPS = 64  # bytes of a training piece
CORE, CONTEXT = 224, 32  # bytes that a segment labels, and those read before (or, backwards, after) them
PAD = 256  # stands for what is outside a text: it leaves the state as it is
SPANS = "array<struct<start:int,end:int,lang:string>>"


@dataclass
class BiGru:
    """One layer in each direction. w: the input weights of each byte (with the bias), u: recurrent, v: output."""

    langs: list[str]
    w: np.ndarray  # (2 directions, 256, 3 * hidden), gates in the order update, reset, candidate
    u: np.ndarray  # (2, hidden, 3 * hidden)
    v: np.ndarray  # (2, hidden, languages)
    b: np.ndarray  # (languages,)

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> BiGru:
        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(langs, draw(2, 256, 3 * hidden, scale=0.3), draw(2, hidden, 3 * hidden, scale=0.4), draw(2, hidden, len(langs), scale=0.3), np.zeros(len(langs), np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.w, self.u, self.v, self.b]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(net: BiGru, data: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of data (batch, steps), and its gradient for each parameter."""
    n, steps = data.shape
    hidden = net.u.shape[1]
    grads = [np.zeros_like(p) for p in net.params()]
    logits, kept = np.zeros((steps, n, len(net.langs)), np.float32) + net.b, []
    for d in range(2):
        h, tape = np.zeros((n, hidden), np.float32), []
        for t in range(steps) if d == 0 else reversed(range(steps)):
            x = net.w[d][data[:, t]]
            a = h @ net.u[d]
            z, r = _sigmoid(x[:, :hidden] + a[:, :hidden]), _sigmoid(x[:, hidden : 2 * hidden] + a[:, hidden : 2 * hidden])
            c = np.tanh(x[:, 2 * hidden :] + r * a[:, 2 * hidden :])
            tape.append((t, h, z, r, c, a[:, 2 * hidden :]))
            h = c + z * (h - c)
            logits[t] += h @ net.v[d]
            tape[-1] += (h,)
        kept.append(tape)
    p = _softmax(logits)
    loss = -float(np.log(p[:, np.arange(n), labels] + 1e-9).mean())
    p[:, np.arange(n), labels] -= 1
    p /= n * steps
    grads[3] += p.sum((0, 1))
    for d, tape in enumerate(kept):
        dh = np.zeros((n, hidden), np.float32)
        for t, before, z, r, c, ac, after in reversed(tape):
            grads[2][d] += after.T @ p[t]
            dh = dh + p[t] @ net.v[d].T
            dc = dh * (1 - z) * (1 - c * c)
            dz, dr = dh * (before - c) * z * (1 - z), dc * ac * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r], 1)
            dx = np.concatenate([dz, dr, dc], 1)
            grads[1][d] += before.T @ da
            np.add.at(grads[0][d], data[:, t], dx)
            dh = dh * z + da @ net.u[d].T
    return loss, grads


def train(windows: list[bytes], labels: list[int], langs: list[str], hidden: int = 8, rounds: int = 180, batch: int = 192, rate: float = 0.02, seed: int = 7) -> BiGru:
    """Fit by Adam on pieces of STEPS bytes (shorter ones are repeated); batches hold the languages in equal parts."""
    rng = np.random.default_rng(seed)
    net = BiGru.fresh(langs, hidden, rng)
    data = np.frombuffer(b"".join((w * -(-STEPS // len(w)))[:STEPS] for w in windows), np.uint8).reshape(len(windows), STEPS)
    y = np.array(labels)
    of = [np.flatnonzero(y == i) for i in range(len(langs))]
    m, s = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for k in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(rows, max(1, batch // len(langs))) for rows in of])
        _, grads = gradients(net, data[pick], y[pick])
        step = rate * (1 - k / (rounds + 1)) * np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        for p, g, a, b in zip(net.params(), grads, m, s, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= step * a / (np.sqrt(b) + 1e-8)
    return net


class Labeller:
    """Probabilities of every byte of whole texts. A text is cut into segments of CORE bytes, which run side by side; the state of each is
    carried in over the CONTEXT bytes before it (in the other direction, after it), and starts afresh at the ends of the text."""

    def __init__(self, net: BiGru, side_by_side: int = 2048) -> None:
        self.net, self.wide, self.hidden = net, max(64, min(side_by_side, (4 << 20) // (CORE * len(net.langs)))), net.u.shape[1]
        # the three gates apart, so that all arithmetic is on whole arrays; the first two halved, since sigmoid(x) = 0.5 + 0.5 tanh(x / 2)
        half = np.array([0.5, 0.5, 1.0], np.float32)
        w = net.w.reshape(2, 256, 3, self.hidden).transpose(0, 2, 1, 3) * half[:, None, None]
        pad = np.zeros((2, 3, 1, self.hidden), np.float32)
        pad[:, 0] = 50  # an update gate of 1 keeps the state
        self.table = np.ascontiguousarray(np.concatenate([w, pad], 2))  # (directions, gates, bytes, hidden)
        self.u = np.ascontiguousarray(net.u.reshape(2, self.hidden, 3, self.hidden).transpose(0, 2, 1, 3) * half[:, None, None])

    def run(self, segments: np.ndarray) -> np.ndarray:
        """segments (n, CONTEXT + CORE + CONTEXT) of bytes or PAD -> probabilities (CORE, n, languages)."""
        n, k = segments.shape[0], self.hidden
        columns = np.ascontiguousarray(segments.T)
        logits = np.empty((CORE, n, len(self.net.langs)), np.float32)
        gates, mixed = np.empty((2, n, k), np.float32), np.empty((n, k), np.float32)
        for d in range(2):
            (update, reset, candidate), u = self.table[d], self.u[d]
            h = np.zeros((n, k), np.float32)
            for t in range(CONTEXT + CORE) if d == 0 else range(CORE + 2 * CONTEXT - 1, CONTEXT - 1, -1):
                np.matmul(h, u[0], out=gates[0])
                np.matmul(h, u[1], out=gates[1])
                gates[0] += update.take(columns[t], axis=0)
                gates[1] += reset.take(columns[t], axis=0)
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                c = np.matmul(h, u[2], out=mixed)
                c *= gates[1]
                c += candidate.take(columns[t], axis=0)
                np.tanh(c, out=c)
                h -= c
                h *= gates[0]
                h += c
                if CONTEXT <= t < CONTEXT + CORE:
                    if d == 0:
                        np.matmul(h, self.net.v[0], out=logits[t - CONTEXT])
                    else:
                        logits[t - CONTEXT] += h @ self.net.v[1]
        logits += self.net.b
        np.exp(np.clip(logits, -30, 30, out=logits), out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def __call__(self, texts: list[bytes | None], spans: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
        """Mean probabilities (texts, languages), and the runs of equal labels (start byte, end byte, language)."""
        lengths = np.array([len(t) if t else 0 for t in texts], dtype=np.int64)
        count = -(-lengths // CORE)
        first = np.concatenate([[0], count.cumsum()])
        # texts with CONTEXT of padding before and after each, so that no segment reads a neighbour
        gap = 2 * CONTEXT
        data = np.full(int(first[-1]) * CORE + gap * (len(texts) + 1), PAD, np.uint16)
        begins = first[:-1] * CORE + gap * np.arange(len(texts)) + CONTEXT
        for t, at, n in zip(texts, begins.tolist(), lengths.tolist(), strict=True):
            if n:
                data[at : at + n] = np.frombuffer(t, np.uint8)
        of = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(first[-1]) - first[of]
        starts, filled = begins[of] - CONTEXT + nth * CORE, np.minimum(CORE, lengths[of] - nth * CORE)
        sums = np.zeros((len(starts), len(self.net.langs)))
        best = np.zeros((len(starts), CORE), np.uint8) if spans else None
        for s in range(0, len(starts), self.wide):
            p = self.run(data[starts[s : s + self.wide, None] + np.arange(CORE + gap)])
            p *= (np.arange(CORE)[:, None] < filled[s : s + self.wide])[..., None]
            sums[s : s + self.wide] = p.sum(0)
            if spans:
                best[s : s + self.wide] = p.argmax(-1).T
        padded = np.concatenate([[np.zeros(sums.shape[1])], sums.cumsum(0)])
        pooled = (padded[first[1:]] - padded[first[:-1]]) / np.maximum(1, lengths)[:, None]
        runs = []
        for i, n in enumerate(lengths.tolist() if spans else []):
            labels = best[first[i] : first[i + 1]].ravel()[:n]
            cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            runs.append([(a, b, int(labels[a])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a])
        return pooled, runs


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (re.search(rb"[A-Za-z]", text) is not None or any(c.isalpha() for c in text.decode("utf-8", "ignore")))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample_docs: int = 320, windows: int = 64, hidden: int = 8, rounds: int = 180) -> BiGru | None:
    """A network for the languages of labelled rows, or None without any.

    It is fitted on a bounded sample: of each language sample_docs rows, those of least hash of `order` and text in each of 64 classes of the hash, and of
    each of these up to `windows` pieces of STEPS bytes at evenly spread places of the whole text (all of it, up to 4 KB; repeated rows are one).
    Rows with a null label, or no letter, teach nothing.
    """
    bound_batches(docs)
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{order}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).filter("lang IS NOT NULL")
    rows = rows.select("lang", F.xxhash64("id", "text").alias("rank"), "text")
    rows = rows.withColumn("part", F.pmod("rank", F.lit(64)))
    nth = F.row_number().over(Window.partitionBy("lang", "part").orderBy("rank"))
    bounds = rows.select("lang", "part", "rank").withColumn("n", nth).filter(F.col("n") <= -(-sample_docs // 64)).groupBy("lang", "part").agg(F.max("rank").alias("most"))
    langs_seen = [r.lang for r in bounds.select("lang").distinct().collect()]
    if not langs_seen:
        return None
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            langs, pieces = [], []
            for code, t in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                for k in range(min(windows, -(-len(t) // STEPS)) if has_letter(t) else 0):
                    at = k * max(0, len(t) - STEPS) // max(1, min(windows, -(-len(t) // STEPS)) - 1)
                    langs.append(code)
                    pieces.append(t[at : at + STEPS])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], ["lang", "piece"])

    # 64 rows a language; pieces of equal rows fall together, so what is collected has a bound
    sample = rows.join(F.broadcast(bounds), ["lang", "part"]).filter("rank <= most").select("lang", "text").mapInArrow(cut, "lang string, piece binary").distinct()
    got = sample.collect()
    langs = sorted({r.lang for r in got})
    got.sort(key=lambda r: (r.lang, bytes(r.piece)))
    return train([bytes(r.piece) for r in got], [langs.index(r.lang) for r in got], langs, hidden, rounds=rounds) if langs else None


def predict(docs: DataFrame, net: BiGru | None, text: str = "text", spans: bool = False) -> DataFrame:
    """Rows (row, lang_pred, score[, spans]), one per input row; row is the whole input row as a struct.

    Every byte of the text is read and has a label; probabilities of all positions are averaged, score is that of lang_pred. spans are the runs of
    bytes with one label (byte offsets). A text that is null or has no letter (so also an empty one) is `und` with score
    0, and so is every text without a network. Ties go to the lesser name. An empty table gives an empty result.
    """
    bound_batches(docs)
    frame = whole_rows(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        label = Labeller(model) if model else None
        for part in text_slices(batches, 1, 1 << 20):
            texts = [t if has_letter(t) else None for t in as_bytes(part.column(1))]
            pooled, runs = label(texts, spans) if label else (np.zeros((len(texts), 1)), [[]] * len(texts))
            names = model.langs if model else [UNDETERMINED]
            best = pooled.argmax(1).tolist()
            known = [bool(t) and label is not None for t in texts]
            columns = [part.column(0), pa.array([names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]), pa.array([min(1.0, float(pooled[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))])]
            if spans:
                columns.append(pa.array([[{"start": a, "end": e, "lang": names[x]} for a, e, x in r] for r in runs], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score", *["spans"] * spans])

    return frame.mapInArrow(run, f"row {frame.schema['row'].dataType.simpleString()}, lang_pred string, score double" + f", spans {SPANS}" * spans)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options: int) -> DataFrame:
    """Fit on the rows whose id is not held out (crc32 of the id modulo 4 is 2) and predict all: (row, held_out, lang_pred, score).

    A row with a null id is not held out and teaches nothing.
    """
    fold = crc_fold(F.col(f"`{doc_id}`"), 4)
    net = fit(docs.filter(fold != 2), text, lang, doc_id, **options)
    found = predict(docs, net, text)
    return found.select("row", F.coalesce(crc_fold(F.col(f"row.`{doc_id}`"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
