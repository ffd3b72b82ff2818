"""Toxic passages: maximum-scoring segments of token log-odds with Dirichlet priors, and a document score by their extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_fold, materialise, text_slices, whole_rows

WORD = re.compile(r"[^\W\d_]+")
#: Texts are cut into words in pieces of about so many characters, between words.
PIECE = 1 << 20
PASSAGES = "array<struct<start: int, end: int, score: double, e_value: double>>"
PASSAGE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """Places and pieces of a text, cut where no word is cut."""
    start = 0
    while start < len(text):
        end = min(len(text), start + PIECE)
        while end < len(text) and WORD.match(text, end):
            end = WORD.match(text, end).end()
        yield start, text[start:end]
        start = end


def words(text: str) -> Iterator[str]:
    """The runs of letters of a text, lower-cased."""
    for _, piece in pieces(text):
        yield from map(str.lower, WORD.findall(piece))


def maximal_segments(before: np.ndarray, after: np.ndarray, at: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time, given its positive items: running sums before and after each, and places.

    Each new item joins the segments to its left while that makes a larger sum (Ruzzo and Tompa 1999); links lead past segments that cannot join.
    """
    low: list[float] = []
    top: list[float] = []
    link: list[int] = []
    span: list[tuple[int, int]] = []
    for left, right, place in zip(before.tolist(), after.tolist(), at.tolist(), strict=True):
        start, j = place, len(low) - 1
        while True:
            while j >= 0 and low[j] >= left:
                j = link[j]
            if j < 0 or top[j] >= right:
                break
            left, start = low[j], span[j][0]
            del low[j:], top[j:], link[j:], span[j:]
            j -= 1
        low.append(left)
        top.append(right)
        link.append(j)
        span.append((start, place + 1))
    return [(a, b, t - s) for (a, b), s, t in zip(span, low, top, strict=True)]


@dataclass
class Model:
    """Log-odds by token, that of all others, the extreme-value rate and factor (lambda and K), and the logistic curve from evidence to probability."""

    odds: dict[str, float] = field(default_factory=dict)
    other: float = -0.01
    rate: float = 1.0
    factor: float = 1.0
    intercept: float = -20.0
    slope: float = 0.0

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal segments of their log-odds (in words)."""
        n, places, values = 0, [], []
        for _, piece in pieces(text or ""):
            found = list(map(self.odds.get, map(str.lower, WORD.findall(piece))))
            hits = [i for i, v in enumerate(found) if v is not None]
            places += [n + i for i in hits]
            values += [found[i] for i in hits]
            n += len(found)
        if not places:
            return n, []
        at, value = np.array(places), np.array(values)
        before = self.other * at + np.concatenate([[0.0], np.cumsum(value - self.other)[:-1]])
        up = value > 0
        return n, maximal_segments(before[up], (before + value)[up], at[up])

    def evidence(self, n: int, scores: np.ndarray) -> float:
        """-ln of the chance that so many words of clean text hold segments that score as high: the best of the sum statistics of the r highest (Karlin and Altschul 1993).

        The choice of r is charged for by a factor of 2 to the r.
        """
        if not len(scores) or not n:
            return 0.0
        high = self.rate * np.sort(scores)[::-1] - math.log(max(self.factor * n, 1e-300))
        one = -math.log(max(-math.expm1(-math.exp(min(700.0, -high[0]))), 1e-300)) if high[0] < 600 else float(high[0])
        r = np.arange(1, len(high) + 1)
        total = np.cumsum(high)
        factorials = np.cumsum(np.log(r))
        with np.errstate(invalid="ignore", divide="ignore"):
            many = total - (r - 1) * np.log(total) + factorials + (factorials - np.log(r)) - r * math.log(2)
        return max(0.0, one - math.log(2), *many[(total > r) & (r > 1)].tolist())

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.intercept + self.slope * math.log1p(evidence)))))

    def passages(self, text: str, n: int, segments: list[tuple[int, int, float]], most: float) -> list[dict]:
        """Segments of an E-value of `most` or less, in characters of the text."""
        told = [(a, b, s, self.factor * n * math.exp(-min(700.0, self.rate * s))) for a, b, s in segments]
        told = [x for x in told if x[3] <= most]
        wanted, places, k = {w for a, b, _, _ in told for w in (a, b - 1)}, {}, 0
        for start, piece in pieces(text) if told else ():
            for m in WORD.finditer(piece):
                if k in wanted:
                    places[k] = (start + m.start(), start + m.end())
                k += 1
        return [{"start": places[a][0], "end": places[b - 1][1], "score": s, "e_value": e} for a, b, s, e in told]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, last, toxic, clean): in how many texts of each kind a token is, in the last fold and the others, summed over runs of texts."""
    counts = {last: (Counter(), Counter()) for last in (False, True)}

    def out() -> Iterator[pa.RecordBatch]:
        for last, (clean, toxic) in counts.items():
            tokens = list(clean | toxic)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array([last] * len(tokens), pa.bool_()), *(pa.array([k[t] for t in tokens], pa.int64()) for k in (toxic, clean))], ["token", "last", "toxic", "clean"])
            clean.clear()
            toxic.clear()

    for batch in batches:
        for piece in text_slices(iter([batch])):
            for last, toxic, text in zip(*(piece.column(c).to_pylist() for c in ("last", "toxic", "text")), strict=True):
                counts[last][toxic].update(set(words(text or "")))
            if sum(map(len, (k for pair in counts.values() for k in pair))) > 400_000:
                yield from out()
    yield from out()


def log_odds(counts: DataFrame, prior: float, deviations: float, least: float, features: int) -> tuple[dict[str, float], float, float]:
    """Log-odds of the tokens that surely mark toxic texts, that of all others together, and the decay rate of high segment scores in clean text.

    The Dirichlet prior gives each token `prior` times its count over both kinds (Monroe et al. 2008). A token's odds are lowered by so many `deviations`, so that rare ones say
    little; tokens of `least` or more are kept, at most `features`, the highest first. The rate is the positive root of sum(p * exp(rate * odds)) = 1 over clean text.
    """
    nt, nc = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not nt or not nc:
        return {}, -0.01, 1.0
    whole = prior * (nt + nc)
    t, c = (F.col(k) + prior * (F.col("toxic") + F.col("clean")) for k in ("toxic", "clean"))
    odds = F.ln(t / (nt + whole - t)) - F.ln(c / (nc + whole - c)) - deviations * F.sqrt(1 / t + 1 / c)
    kept = counts.select("token", t.alias("t"), c.alias("c"), odds.alias("odds")).filter(F.col("odds") >= least).orderBy(F.desc("odds"), "token").limit(features).collect()  # bounded by `features`
    rest = [max(n + whole - sum(r[k] for r in kept), 1e-9) for n, k in ((nt, "t"), (nc, "c"))]
    other = min(math.log(rest[0] / (nt + whole)) - math.log(rest[1] / (nc + whole)), -0.01)
    share, value = np.array([r.c for r in kept] + [rest[1]]) / (nc + whole), np.array([r.odds for r in kept] + [other])
    low, high = 0.0, 1.0
    while high < 64 and (share * np.exp(np.minimum(high * value, 700))).sum() < 1:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(np.minimum(middle * value, 700))).sum() < 1 else (low, middle)
    return {r.token: r.odds for r in kept}, other, high


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a weak prior on both that keeps them finite on separable rows."""
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (y - p) - 0.01 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", folds: int = 5, sample_docs: int = 20_000, prior: float = 0.02, deviations: float = 1.64, least: float = 1.0, features: int = 50_000) -> Model:
    """A model of labelled documents whose crc32 of the id modulo `folds` is not 0.

    It is fitted on a bounded sample: of each label the sample_docs ids of least hash (64 more at most). Documents of the last fold set K and the curve, by log-odds of the others; where
    a label is in only one of the two, all do both. In the end all give the log-odds. Labels but 0 and 1 and null ids teach nothing, an id labelled both ways counts as toxic, equal texts
    of one label count once. Without toxic rows every score is near 0, without clean ones near 1.
    """
    given = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    given = given.withColumns({"fold": crc_fold(F.col("id"), folds), "rank": F.xxhash64("id")}).filter("fold <> 0")
    nth = F.row_number().over(Window.partitionBy("toxic", F.pmod("rank", F.lit(64))).orderBy("rank", "id"))
    sample = given.withColumn("n", nth).filter(F.col("n") <= -(-sample_docs // 64)).select("id", "toxic", "fold")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(sample), "id")  # bounded by sample_docs
    rows = materialise(rows.groupBy("toxic", F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("fold", "text")).alias("r")).select("toxic", "r.fold", "r.text"), "labelled")
    last = F.col("fold") == folds - 1
    seen = {(r.toxic, r.held): r.n for r in rows.groupBy("toxic", last.alias("held")).agg(F.count("*").alias("n")).collect()}
    if not all(any(t == k for t, _ in seen) for k in (0, 1)):
        return Model(intercept=20.0 if seen and all(t for t, _ in seen) else -20.0)
    apart = all((k, h) in seen for k in (0, 1) for h in (False, True))
    tried = rows.filter(last) if apart else rows
    counts = rows.select(last.alias("last"), "toxic", "text").mapInArrow(_count, "token string, last boolean, toxic long, clean long").groupBy("token", "last").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialise(counts, "token-counts")

    def odds(some: DataFrame) -> tuple[dict[str, float], float, float]:
        return log_odds(some.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), prior, deviations, least, features)

    model = Model(*odds(counts.filter(~F.col("last")) if apart else counts))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.segments(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for n, _ in found], pa.int64()), pa.array([sorted((s for _, _, s in x), reverse=True) for _, x in found], pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    measured = tried.select("toxic", "text").mapInArrow(measure, "toxic int, n long, scores array<double>").collect()  # a row a sampled document
    lowest = min((r.scores[-1] for r in measured if r.scores), default=1.0)
    clean = [(r.n, r.scores[0] if r.scores else None) for r in measured if not r.toxic]
    hits = max(0.5, sum(s is not None for _, s in clean))
    # the likeliest K for the highest score of each clean text; a text without one says that it lies below the least
    model.factor = hits / max(1e-9, sum(n * math.exp(-min(700.0, model.rate * (lowest if s is None else s))) for n, s in clean))
    x = np.log1p([model.evidence(r.n, np.array(r.scores)) for r in measured])
    model.intercept, model.slope = _logistic(x, np.array([r.toxic for r in measured], float))
    model.odds, model.other, model.rate = odds(counts)
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text", most: float = 0.05) -> DataFrame:
    """Rows (row, score, passages): the chance that a whole text is toxic, and its significant passages (start, end in characters, score, e_value of at most `most`).

    `row` holds all columns of docs. Null and empty texts, and texts without letters, have the score of no evidence and no passages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the model's number of features

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in text_slices(iter([batch])):
                scores, told = [], []
                for t in piece.column("text").to_pylist():
                    n, segments = model.segments(t)
                    scores.append(model.score(model.evidence(n, np.array([s for _, _, s in segments]))))
                    told.append(model.passages(t, n, segments, most) if segments else [])
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(scores, pa.float64()), pa.array(told, PASSAGE_TYPE)], ["row", "score", "passages"])

    rows = whole_rows(docs, text)
    return rows.mapInArrow(scored, f"row {rows.schema['row'].dataType.simpleString()}, score double, passages {PASSAGES}")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", folds: int = 5) -> DataFrame:
    """Rows (row, held_out, score, predicted, passages) for every document, by a model of the labels of those that are not held out.

    An empty table gives an empty result; a null id is not held out.
    """
    scored = score_documents(docs, fit(docs, labels, text, doc_id, label, folds), text)
    held = F.coalesce(crc_fold(F.col(f"row.`{doc_id}`"), folds) == 0, F.lit(False))
    return scored.select("row", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
