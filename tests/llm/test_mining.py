"""Hard negatives, toxic passages and spelling variants against brute-force versions on small rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import rtree, spelling, toxicity

VECTORS = "vec_id long, embedding array<float>, label int, q string, query int"


def vectors(seed: int = 5, n: int = 260, dim: int = 6) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, dim)) * 2).astype(np.float32)
    rows = [(i, x[i].tolist(), int(rng.integers(4)), "clash", 1) for i in range(n)]
    rows += [(n + i, x[7].tolist(), 1 + i % 2, "copy", 1) for i in range(40)]  # a common vector
    rows += [(400 + i, [1.0] * dim, 3, None, None) for i in range(3)]
    rows += [(403, None, 1, "a", 1), (404, [float("nan")] * dim, 1, "a", 1), (405, [float("inf")] * dim, 1, "a", 1), (406, [None] * dim, 1, "a", 1), (407, x[0].tolist(), None, "a", 1), (None, x[1].tolist(), 1, "a", 1)]
    rows += [(500 + i, x[i, :3].tolist(), i % 2, "short", 1) for i in range(24)]
    return [*rows, rows[3], rows[3]]


def brute_negatives(rows, every, positives=5, negatives=3):
    usable = {(i, lab, tuple(int(np.floor(256 * float(v))) for v in e)) for i, e, lab, *_ in rows if i is not None and lab is not None and e is not None and all(v is not None and np.isfinite(v) for v in e)}
    out = set()
    for i, lab, e in usable:
        if i % every:
            continue
        near = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), j, m) for j, m, f in usable if len(f) == len(e))
        for s, j, _ in [x for x in near if x[2] == lab and x[1] != i][:positives]:
            fit = [(-t, k) for t, k, m in near if m != lab and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out |= {(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(fit)}
    return out


@pytest.mark.parametrize(("tile", "scale"), [(4096, 1), (16, 1)])
def test_hard_negatives(spark, tile, scale):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS)
    got = [tuple(r) for r in rtree.hard_negatives(df, F.pmod("vec_id", F.lit(5)) == 0, tile=tile).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, 5)
    assert any(r[0] >= 500 for r in got)  # short vectors among themselves


def test_hard_negatives_of_nothing_and_of_large_components(spark):
    assert rtree.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).isEmpty()
    rows = [(i, [float((i + 1) << 17), float((3 * i % 7) << 18), 1.0 + i], i % 2, "", 1) for i in range(30)]
    got = {tuple(r) for r in rtree.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, q string, query int"), F.col("vec_id") % 5 == 0).collect()}
    limit = (1 << 63) - 1
    assert got and all(abs(r[4]) <= limit for r in got)
    assert got == {r for r in brute_negatives(rows, 5) if max(abs(r[4]), abs(r[5])) <= limit}


def test_boxes_bound_and_order():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 5))
    order = rtree.str_order(x, 16)
    assert sorted(order.tolist()) == list(range(500))
    tree = rtree.Tree(np.arange(500), np.zeros(500, int), x, leaf=16, fanout=4)
    for q in rng.standard_normal((20, 5)):
        for lo, hi in tree.levels:
            most = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
            assert most.max() >= (x @ q).max() - 1e-9


def documents(seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    parts = ["ing", "er", "stone", "marl", "éle", "Ñan", "tion", "ed", "ly", "un"]
    base = ["".join(rng.choices(parts, k=rng.randint(2, 4))) for _ in range(120)]
    words = [w for w in base for _ in range(rng.choice([1, 2, 30]))] + [w[:k] + "x" + w[k + 1 :] for w in base for k in (1, 4)] * 2 + [w[:3] + w[4:] for w in base[:60]] * 2
    rng.shuffle(words)
    texts = [" ".join(words[i::40]) for i in range(40)] + [None, "", "12 -- 34", "a" * 300 + " " + "a" * 301 + " " + "a" * 300 + "-" + "a" * 301, "marlstone" * 40]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[3]]


def brute_words(rows, every):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("max_block", [1024, 6])
def test_spelling_variants(spark, max_block):
    rows = documents()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string")
    words = spelling.corpus_words(docs, drop_every=5)
    n = brute_words(rows, 5)
    assert {r.word: r.n for r in words.collect()} == n
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}
    want = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        want.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    got = [tuple(r) for r in spelling.group_variants(words, max_block=max_block).collect()]
    assert len(got) == len(want) and set(got) == want and any(w[1] for w in want)


def test_spelling_pairs_come_once_and_nothing_gives_nothing(spark):
    # runs of one letter can be lengthened in many places, and a common stem makes blocks that are cut to single places
    words = ["b" * k for k in range(7, 14)] + [f"stem{a}{b}{c}" for a in "abcd" for b in "abcdé" for c in "abcdef"]
    got = Counter((r.word, r.near) for r in spelling.near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), max_block=3).collect())
    assert set(got.values()) == {1} and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).isEmpty()


def test_maximal_segments_against_definition():
    rng = random.Random(4)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, 1, 2, 4]) for _ in range(rng.randint(1, 24))]
        left = [(0, len(scores))]
        want = []
        while left:  # the segment of largest sum (the shortest of these), then the same on either side
            a, b = left.pop()
            spans = [(sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if spans and max(spans)[0] > 0:
                best = max(spans)
                want.append((best[3], best[4], best[0]))
                left += [(a, best[3]), (best[4], b)]
        sums = np.concatenate([[0], np.cumsum(scores)]).astype(float)
        up = np.array([i for i, s in enumerate(scores) if s > 0], int)
        got = toxicity.maximal_segments(sums[up], sums[up + 1], up)
        assert sorted(got) == sorted(want)


def toxic_corpus(n: int = 400) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(8)
    plain, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}o" for i in range(300)], ["scoundrel", "wretch", "Fool"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(3, 200))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, rng.randint(0, 1), int(toxic)))
    docs += [(n, None, None), (n + 1, "", "x"), (n + 2, "1 2 3 ...", "x"), (None, "wretch fool", "x"), (n + 3, "wao " * 300_000 + "the wretch and fool " * 6 + " wao" * 10, "x"), docs[4], docs[4]]
    return docs, [*labels, (n, 1, None), (None, 0, 1), (3, 0, 2), labels[4], labels[8]]


def test_toxic_documents_and_passages(spark):
    rows, labels = toxic_corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, marks).select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "held_out", F.col("score").alias("p"), "predicted", "passages")
    found = got.collect()
    assert len(found) == len(rows)
    wrong = [r for r in found if r.doc_id is not None and r.doc_id < 400 and r.predicted != int(r.doc_id % 4 == 0)]
    assert len(wrong) <= 4
    for r in found:
        assert 0 <= r.p <= 1 and r.predicted == int(r.p >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        for s in r.passages:
            assert re.search("scoundrel|wretch|fool", r.text[s.start : s.end].lower())
    assert {r.predicted for r in found if r.doc_id in (400, 401, 402)} == {0}
    assert next(r for r in found if r.doc_id == 403).passages[0].start >= 1_200_000
    # labels of held-out documents change nothing
    other = marks.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.classify(docs, other).select("row.doc_id", "score").collect()}
    assert again == {r.doc_id: r.p for r in found}


def test_toxicity_without_labels_or_rows(spark):
    rows, labels = toxic_corpus(20)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.classify(docs, marks.filter("toxic = 0")).collect()} == {0}
    assert {r.predicted for r in toxicity.classify(docs, marks.filter("toxic = 1")).collect()} == {1}
    assert {r.predicted for r in toxicity.classify(docs, marks.limit(0)).collect()} == {0}
    assert toxicity.classify(docs.limit(0), marks).isEmpty()


def test_pieces_keep_words_whole():
    text = "ab " * 700_000 + "c" * 1_500_000 + " d"
    assert "".join(p for _, p in toxicity.pieces(text)) == text
    assert Counter(toxicity.words(text)) == Counter(toxicity.WORD.findall(text))
