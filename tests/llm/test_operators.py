"""Each operator against a brute-force version on small rows with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import ann, common, decontam, langid, lines, lm, mixing, simhash, suffix, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sample(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "on", "and", "tion", "er", "Éle", "des", "ing", "of", "in", "stone", "marl", "x."]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(n)]
    texts = [*base, *base[:8], *(b + " tail" for b in base[:8]), None, "", "   ", "a b", "\n\n", base[3] * 60]
    texts += ["\n".join(rng.choices(["l one", "l two", "l three", "", "l four"], k=9)) for _ in range(12)]
    return [(i, t, rng.choice(["en", "fr", None]), f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).withColumns({"fp": F.lit(1), "row": F.lit("clash"), "n_words": F.lit(0), "score": F.lit("s"), "text_": F.lit(1)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def find(parent: dict, x: int) -> int:
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.mark.parametrize("max_block", [64, 1])
def test_simhash_groups(spark, docs, max_block):
    rows = [(i, t) for i, t, *_ in sample()]
    fps = {i: simhash.fingerprint(t.encode() if t is not None else None, 3) for i, t in rows}
    parent = {i: i for i, _ in rows}
    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs, max_block=max_block).collect()}
    assert got == {i: (fps[i], find(parent, i)) for i, _ in rows}


def test_fingerprint_rule():
    assert simhash.fingerprint(None, 3) == simhash.fingerprint(b" \t\n", 3) == 0
    assert simhash.fingerprint(b"One Two", 3) == xxhash.xxh64_intdigest(b"one two", 42)
    text = b"A b\tc d\x0be A b c"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint(text, 3) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_hot_blocks_lose_no_link(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(63)
    values = {centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(120)} | {rng.getrandbits(63) for _ in range(100)}
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for most in (4, 1000):
        pairs = [(r.a, r.b) for r in simhash.close_pairs(frame, max_block=most).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
        parent = {v: v for v in values}
        for a, b in pairs:
            parent[find(parent, a)] = find(parent, b)
        classes = {frozenset(v for v in values if find(parent, v) == find(parent, u)) for u in values}
        brute = {v: v for v in values}
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 2:
                    brute[find(brute, a)] = find(brute, b)
        assert classes == {frozenset(v for v in values if find(brute, v) == find(brute, u)) for u in values}


@pytest.mark.parametrize("grouped", [simhash.near_duplicates, simhash.similar_documents])
def test_keep_one(spark, docs, grouped):
    groups = grouped(docs)
    kept = simhash.keep_one(docs, groups)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in groups.collect()}
    # unlike texts of one id, repeated rows, and rows without an id
    long = " ".join(f"a{i}" for i in range(40))
    rows = [(0, long), (3, long), (3, "a text of its own"), (4, "twice the same row"), (4, "twice the same row"), (None, long), (None, "alone without an id"), (None, "alone without an id")]
    few = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "key", "row", "kept", "n")})
    kept = simhash.keep_one(few, grouped(few))
    assert kept.columns == few.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(0, long), (3, "a text of its own"), (4, "twice the same row"), (None, "alone without an id")], key=repr)


def test_groups_of_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == simhash.similar_documents(empty).count() == 0
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert simhash.keep_one(empty, simhash.similar_documents(empty)).count() == 0
    assert lines.line_dedup(empty).count() == 0


def test_components_on_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100}


@pytest.mark.parametrize("most_broadcast", [200_000, 0])
def test_warc_round_trip(spark, most_broadcast):
    big, rows = "é" * 700, [(1, "http://a/x y\r\nz", "<p>one</p>"), (2, None, None), (3, "u", ""), (7, "http://d", "x" * 999), (8, "http://e", "x" * 999), (9, "http://f", "long " * 50000)]
    rows += [(i, "http://b", big) for i in (4, 5, 6)] + [(6, "http://b2", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write_warc(pages, most_broadcast=most_broadcast)
    got = sorted((int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_warc(index).collect())
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == big and i != 6
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", "6" if again else None, None if again else data))
    assert got == sorted(want, key=lambda x: x[:4])
    one = index.filter("page_id = 9")
    assert [bytes(r.payload) for r in warc.read_warc(one).collect()] == [("long " * 50000).encode()]
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def brute_repeats(rows: list[tuple[int | None, bytes]], length: int) -> dict:
    first: dict[bytes, int] = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        for a in range(len(t) - length + 1):
            first.setdefault(t[a : a + length], i)
    out = defaultdict(list)
    for i, t in rows:
        gone = bytearray(len(t) + 1)
        for a in range(len(t) - length + 1):
            if i is not None and first[t[a : a + length]] < i:
                gone[a : a + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out[i].append((len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("group_bytes", "hot"), [(1 << 23, 512), (4000, 512), (4000, 1)])
def test_suffix_dedup(spark, docs, group_bytes, hot):
    extra = spark.createDataFrame([(None, "q" * 120, None, None, 0), (500, "a" * 400 + "b" * 60, None, None, 0), (501, "b" * 60 + "a" * 300, None, None, 0), (501, "b" * 60 + "a" * 301, None, None, 0), (502, "q" * 120, None, None, 0)], SCHEMA)
    rng = random.Random(5)
    edges = [(600 + i, "".join(rng.choices("xyz", k=40)) + "a passage that many documents share, word for word" + "".join(rng.choices("uvw", k=40)), None, None, 0) for i in range(12)]
    both = docs.unionByName(extra.unionByName(spark.createDataFrame(edges, SCHEMA)), allowMissingColumns=True)
    both = both.withColumns({c: F.lit("clash") for c in ("g", "bucket", "data", "kind", "ids", "n_bytes")})
    rows = [(r.doc_id, (r.text or "").encode()) for r in both.collect()]
    got = defaultdict(list)
    for r in suffix.remove_repeats(both, 50, group_bytes=group_bytes, hot=hot).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed
    assert {k: sorted(v) for k, v in got.items()} == brute_repeats(rows, 50)


@pytest.mark.parametrize(("length", "hot"), [(16, 1), (17, 512), (33, 1), (48, 512), (50, 1), (80, 1)])
def test_suffix_dedup_at_other_lengths(spark, length, hot):
    rng = random.Random(length)
    passages = ["".join(rng.choices("abcdefgh ", k=rng.randrange(length, length + 40))) for _ in range(4)]
    rows = [(i, "".join(rng.choices("ij ", k=rng.randrange(60))).join(rng.choice(passages)[rng.randrange(12) :] for _ in range(4))) for i in range(60)]
    got = defaultdict(list)
    for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, group_bytes=2000, content=False, hot=hot).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert got == brute_repeats([(i, t.encode()) for i, t in rows], length)


@pytest.mark.parametrize("hot", [512, 1])
def test_suffix_dedup_sends_only_what_shares_a_side(spark, hot):
    """A phrase of 22 bytes is in every document, so grams are, but no window of 50 bytes is twice: no bytes are sent. One passage of 60 bytes is."""
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("abcdefghijklmnop", k=80)) + " words all texts have " + "".join(rng.choices("abcdefghijklmnop", k=80))) for i in range(200)]
    path, sent = Path(common.shared_dir(spark).removeprefix("file://")), []
    for extra in ([], [(i, "".join(rng.choices("qrst", k=40)) + "this passage of sixty bytes is in two of the documents only!" + "".join(rng.choices("uvwx", k=40))) for i in (300, 301)]):
        before = set(path.glob("suffix-contexts-*"))
        found = suffix.remove_repeats(spark.createDataFrame(rows + extra, "doc_id long, text string"), 50, group_bytes=4000, content=False, hot=hot)
        assert {r.doc_id: r.n_removed for r in found.filter("n_removed > 0").collect()} == ({301: 60} if extra else {})
        (new,) = set(path.glob("suffix-contexts-*")) - before
        sent.append(spark.read.parquet(str(new)).filter(F.col("kind") == suffix.CONTEXTS).agg(F.sum("n")).first()[0] or 0)
    assert sent[0] == 0 and 0 < sent[1] <= 80


def test_suffix_dedup_of_an_empty_table(spark, empty):
    assert suffix.remove_repeats(empty).count() == 0


def test_radix_sort_of_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 600, dtype=np.uint8)
    for length in (1, 4, 6, 11):
        starts = np.arange(len(data) - length + 1, dtype=np.int32)
        rows, groups = suffix.equal_groups(data, starts, length)
        got = defaultdict(set)
        for r, g in zip(rows.tolist(), groups.tolist(), strict=True):
            got[g].add(r)
        want = defaultdict(set)
        for a in starts.tolist():
            want[data[a : a + length].tobytes()].add(a)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
    assert len(suffix.equal_groups(np.zeros(0, np.uint8), np.zeros(0, np.int32), 5)[0]) == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files(spark, docs, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    assert tokens.wordwise(path) == (name == "word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["Hello <|endoftext|> World'S <|ENDOFTEXT|>x", "it's. It'S, they're!! H̱. Àb, ΣΣ. x.y ... 12.5, a1. <|endoftext|>.  nbsp em.", "K. İ. ﬁ. 're,", "Straße ÉCOLE naïve œuvre"]
    more = spark.createDataFrame([(1000 + i, t, None, None, 0) for i, t in enumerate(odd)], SCHEMA)
    both = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    index = tokens.write_tokens(both, path, frame_bytes=1000)
    start = 0
    got = sorted(tokens.read_tokens(tokens.starts(index)).collect(), key=lambda r: r.doc_id)
    for r, d in zip(got, sorted(both.collect(), key=lambda r: r.doc_id), strict=True):
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids), r.ids_crc32) == (d.doc_id, start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    reader = tokens.FrameReader(got[0].file)
    reader.read(0, 4)
    assert reader.frames_read == 1
    assert tokens.write_tokens(both.limit(0), path).count() == 0


def test_seek_table_and_checksum(tmp_path):
    import zstandard

    path = tmp_path / "a.zst"
    writer, data = tokens.FrameWriter(f"file://{path}", 100), bytes(range(256)) * 3
    writer.write(data)
    writer.close()
    raw = path.read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == data
    reader = tokens.FrameReader(f"file://{path}")
    assert reader.read(150, 300) == data[150:450] and reader.frames_read == 4
    table = raw[-9 - 12 * 8 : -9]
    path.write_bytes(raw[: -9 - 12 * 8] + table[:8] + b"\0\0\0\0" + table[12:] + raw[-9:])
    with pytest.raises(ValueError, match="checksum"):
        tokens.FrameReader(f"file://{path}").read(0, 10)


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = langid.BiGru.fresh(["a", "b", "c"], 4, rng)
    net.w, net.u, net.v, net.b = (p.astype(np.float64) for p in net.params())
    frames, labels = rng.integers(0, 256, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = langid.gradients(net, frames, labels)
    for p, g in zip(net.params(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[i] += 1e-3
        up = langid.gradients(net, frames, labels)[0]
        p[i] -= 2e-3
        down = langid.gradients(net, frames, labels)[0]
        p[i] += 1e-3
        assert abs((up - down) / 2e-3 - g[i]) < 1e-4


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").withColumn("lang_pred", F.lit("clash"))
    odd = spark.createDataFrame([(5001, None, "en"), (5002, "", "en"), (5003, "12 .,; 3", "en"), (None, "the and of", "en")], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    got = langid.identify(docs.unionByName(odd), rounds=120).select("row.doc_id", "row.lang", "held_out", "lang_pred", "score").collect()
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert {r.doc_id for r in held} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 == 2}
    und = {r.doc_id: r for r in got if r.lang_pred == "und"}
    assert set(und) == {5001, 5002, 5003} and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(docs.limit(0)).count() == 0


def test_language_spans(spark):
    docs = spark.createDataFrame([(i, w * 40, l) for i in range(80) for w, l in (("abab cdcd ", "x"), ("wyxz zyzx ", "y"))], "doc_id long, text string, lang string")
    net = langid.fit(docs, rounds=60)
    out = langid.predict(spark.createDataFrame([(1, "abab cdcd " * 30 + "wyxz zyzx " * 31 + "w")], "doc_id long, text string"), net, spans=True).first()
    assert out.spans[0].start == 0 and out.spans[-1].end == 611  # every byte has a label, the odd last one too
    labels = "".join(s.lang * (s.end - s.start) for s in out.spans)
    assert sum(a == b for a, b in zip(labels, "x" * 300 + "y" * 311, strict=True)) > 0.95 * 611


def test_language_segments_carry_the_state():
    rng = np.random.default_rng(4)
    net = langid.BiGru.fresh(["a", "b", "c"], 8, rng)
    net.u *= 0.5
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (1, 223, 224, 225, 700)] + [None]
    got, runs = langid.Labeller(net)(texts, spans=True)
    for t, p, spans in zip(texts, got, runs, strict=True):
        if t is None:
            assert (p == 0).all() and not spans
            continue
        # one run over the whole text, without segments
        logits = np.zeros((len(t), 3)) + net.b
        for d in range(2):
            h = np.zeros(8)
            for i in range(len(t)) if d == 0 else reversed(range(len(t))):
                x, a = net.w[d][t[i]], h @ net.u[d]
                z, r = 1 / (1 + np.exp(-(x[:8] + a[:8]))), 1 / (1 + np.exp(-(x[8:16] + a[8:16])))
                c = np.tanh(x[16:] + r * a[16:])
                h = c + z * (h - c)
                logits[i] += h @ net.v[d]
        e = np.exp(logits)
        assert np.abs((e / e.sum(1, keepdims=True)).mean(0) - p).max() < 1e-3
        assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_language_sample_is_bounded_under_ties(spark):
    docs = spark.createDataFrame([(1, "the same row again and again", "x")] * 500 + [(None, "die andere", "y")] * 3, "doc_id long, text string, lang string")
    assert set(langid.fit(docs, rounds=2).langs) == {"x", "y"}
    assert langid.predict(docs, langid.fit(docs, rounds=2)).count() == 503


def test_mixing(spark, docs):
    shares = mixing.tempered_shares(docs, slots=20)
    assert shares.agg(F.sum("share")).first()[0] == 20
    pattern = mixing.pfair_pattern(shares).collect()
    assert sorted(r.slot for r in pattern) == list(range(20)) and all(r.release <= r.slot < r.deadline for r in pattern)
    for t in range(1, 21):
        done = Counter(r.key for r in pattern if r.slot < t)
        assert all(abs(done[r.key] - t * r.share / r.slots) < 1 for r in pattern)
    got = mixing.mix_sources(docs, block=2, slots=20, chunks=4).collect()
    assert sorted((r.doc_id, r.source or "") for r in got) == sorted((i, s or "") for i, _, _, s, _ in sample())
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.release <= r.slot < r.deadline
    for rows in by.values():
        rows.sort(key=lambda r: (r.slot, r.place))
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        assert [(r.block, r.place) for r in rows] == [divmod(i, 2) for i in range(len(rows))]
    many = spark.createDataFrame([(i, f"s{i % 60}") for i in range(200)], "doc_id long, source string")
    assert mixing.mix_sources(many, slots=20).count() == 200 and mixing.tempered_shares(many, slots=20).agg(F.sum("share"), F.count("*")).first() == (240, 60)
    with pytest.raises(Exception, match="no share"):
        mixing.mix_sources(many, mixing.tempered_shares(many.filter("source = 's1'"))).collect()
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def brute_matches(text: str | None, items: list[tuple], window: int = 13) -> tuple:
    import re

    def words(t):
        return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())

    mine, hit, names = words(text), set(), set()
    for i, t in items:
        ws = words(t)
        for j in range(max(1, len(ws) - window + 1) if ws else 0):
            w = ws[j : j + window]
            for a in range(len(mine) - len(w) + 1):
                if mine[a : a + len(w)] == w:
                    hit |= set(range(a, a + len(w)))
                    names.add(str(i))
    return len(mine), len(hit), sorted(names)


def test_matches_are_longest_and_verbatim():
    rng = random.Random(8)
    words = [b"a", b"b", b"c"]
    docs = [rng.choices(words, k=n) for n in (0, 3, 40, 90, 90)]
    items = [(f"i{k}", b" ".join(rng.choices(words, k=n))) for k, n in enumerate((2, 4, 9, 30, 60))]
    items.append(("copy", b" ".join(docs[3][20:50])))
    tests = decontam.TestSet.of(items, 4)
    got = decontam.shard_matches([[tests.vocab.get(w, 0) for w in d] for d in docs], tests, 4)
    for d, found in zip(docs, got, strict=True):
        covered = defaultdict(set)
        for name, at, start, n in found:
            ws = dict(items)[name].split()
            assert d[at : at + n] == ws[start : start + n] and n >= min(4, len(ws))
            assert not any(d[at : at + n + 1] == ws[j : j + n + 1] for j in range(len(ws) - n)) or at + n == len(d)
            covered[name] |= set(range(at, at + n))
        for name, text in items:
            ws = text.split()
            least = min(4, len(ws))
            want = {a + x for j in range(len(ws) - least + 1) for a in range(len(d) - least + 1) if d[a : a + least] == ws[j : j + least] for x in range(least)}
            assert covered[name] == want


def test_matches_of_repetitive_texts_are_linear():
    tests = decontam.TestSet.of([("a", b"ha " * 20_000), ("b", b"ha " * 15 + b"ho")], 13)
    began = time.perf_counter()
    got = decontam.shard_matches([[tests.vocab[b"ha"]] * 20_000], tests, 13)[0]
    assert ("a", 0, 0, 20_000) in got and sum(m[3] for m in got if m[0] == "b") >= 20_000
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_decontamination(spark, docs, block_bytes):
    rows = sample()
    items = [(1, rows[2][1]), (2, "stone marl"), (3, None), (4, "..."), (11, (rows[5][1] or "") + " extra words here"), (5, rows[60][1]), (5, "x X x")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    got = decontam.benchmark_matches(docs, bench, block_bytes=block_bytes).withColumn("bad", decontam.contaminated()).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, names = brute_matches(r.row.text, items)
        assert (r.n_words, r.n_hit, sorted({m.item_id for m in r.matches})) == (n, hit, names)
        assert r.bad == (hit > 0 and 20 * hit >= n)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r.bad for r in got)
    assert decontam.benchmark_matches(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_line_dedup(spark, docs):
    more = spark.createDataFrame([(900, "l one\nl two\nl three", None, None, 0), (900, "l one\nl two\nl three", None, None, 0), (None, "l one\nl two\nl three\nq", None, None, 0), (901, "z\nz\nz\nz\nz", None, None, 0)], SCHEMA)
    long = spark.createDataFrame([(950 + i, "\n".join(f"{i * (k % 70 == 0)} line {k}" for k in range(200)), None, None, 0) for i in range(2)], SCHEMA)
    both = docs.unionByName(more.unionByName(long), allowMissingColumns=True).withColumns({c: F.lit("clash") for c in ("lines", "removed", "digest", "n", "line", "h1")})
    rows = [(r.doc_id, r.text) for r in both.collect()]
    digest = {t: d for t, d in both.select("text", F.xxhash64("text")).collect()}
    first = {}
    place = lambda i, t, k: (i is not None, i or 0, digest[t], k)
    for i, t in rows:
        ls = [x.strip(" ") for x in t.split("\n")] if t is not None else []
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            first[w] = min(first.get(w, place(i, t, k)), place(i, t, k))
    want = []
    for i, t in rows:
        raw = t.split("\n") if t is not None else []
        ls = [x.strip(" ") for x in raw]
        gone = {k + d for k in range(len(ls) - 2) if first[tuple(ls[k : k + 3])] != place(i, t, k) for d in range(3)}
        want.append((i, len(raw), len(gone), None if t is None else "\n".join(x for k, x in enumerate(raw) if k not in gone)))
    assert sorted(map(tuple, lines.line_dedup(both).collect()), key=repr) == sorted(want, key=repr)


def lm_brute_force(rows: list[tuple], weight: float = 0.7) -> dict:
    """n_tokens, n_known, train_tokens, base_score and score of each (doc_id, text), by dictionaries of whole words and exact levels."""
    split = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    trained = [ws for i, ws in split if i is None or zlib.crc32(str(i).encode()) % 10]
    one = Counter(w for ws in trained for w in ws)
    two = Counter(pair for ws in trained for pair in zip([b"", *ws], ws, strict=False))
    n, v = sum(one.values()), len(one)

    def middle(count: int) -> float:
        if not count:
            return 0.0
        low = 2.0 ** math.floor(math.log2(count))
        return (low + max(2 * low - 1, low)) / 2

    out = defaultdict(list)
    for i, ws in split:
        score = 0.0
        for before, w in zip([b"", *ws], ws, strict=False):
            p = (middle(one[w]) + 0.1) / (n + 0.1 * (v + 1))
            pair, history = middle(two[before, w]), middle(one[None if before == b"" else before])
            score += math.log10(weight * pair / max(history, pair, 1) + (1 - weight) * p)
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out[i].append((len(ws), sum(one[w] > 0 for w in ws), n, base, score))
    return out


def test_lm_scores_by_shuffle_hold_little(spark):
    """Packs of some MB are rows that hold a text once, and what is asked for in one part is gone from the disk before the next."""
    docs = spark.range(0, 1500, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 2000), F.col("id")).alias("text"))
    path = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(path.glob("lm-packs-*"))
    assert lm.score_documents(docs, max_broadcast=0).filter("n_tokens = 2002 AND score IS NOT NULL").count() == 1500
    (new,) = set(path.glob("lm-packs-*")) - before
    packs = spark.read.parquet(str(new))
    assert packs.columns == ["pack", "row"] and packs.select("row.*").columns == docs.columns
    sizes = [r.n for r in packs.groupBy("pack").agg(F.sum(F.octet_length("row.text")).alias("n")).collect()]
    assert sum(sizes) > 15_000_000 and max(sizes) <= 6 << 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_lm_scores_of_other_texts(spark):
    """Both ways score what a text column of another type or case says, and keep the rows as they are."""
    numbers = spark.createDataFrame([(i, i % 7 if i % 5 else None) for i in range(40)], "doc_id long, Text int")
    both = [sorted(tuple(r) for r in lm.score_documents(numbers, text="text", max_broadcast=m, pack_bytes=20).select("row.doc_id", "row.Text", *lm.MEASURES).fillna(-1).collect()) for m in (0, 1 << 20)]
    assert len(both[0]) == 40 and [r[:5] for r in both[0]] == [r[:5] for r in both[1]] and np.allclose([r[5:] for r in both[0]], [r[5:] for r in both[1]])
    words = numbers.select("doc_id", F.col("Text").cast("string").alias("Text"))
    again = sorted(tuple(r) for r in lm.score_documents(words, text="text", max_broadcast=0, pack_bytes=20).select("row.doc_id", "n_tokens", "n_known").collect())
    assert again == [(r[0], *r[2:4]) for r in both[0]]


@pytest.mark.parametrize("max_broadcast", [0, 1 << 20])
def test_lm_scores(spark, docs, max_broadcast):
    rows = [(i, t) for i, t, *_ in sample()] + [(None, "the marl of stone"), (None, None), (3, "the marl of marl"), (3, "the marl of marl")]
    both = docs.unionByName(spark.createDataFrame(rows[-4:], "doc_id long, text string"), allowMissingColumns=True)
    # so many bits that no probe is wrong: then the scores are those of exact levels
    got = lm.score_held_out(both, max_broadcast=max_broadcast, pack_bytes=2000, bits_per_entry=400, segment_bytes=500).select("row.doc_id", "row.score", "held_out", *[f"`{m}`" for m in lm.MEASURES])
    assert got.columns == ["doc_id", "score", "held_out", *lm.MEASURES] and got.count() == len(rows)
    want, seen = lm_brute_force(rows), defaultdict(list)
    for r in got.collect():
        assert r[2] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0)
        seen[r[0]].append(tuple(r[3:]))
    assert seen.keys() == want.keys()
    for i, values in seen.items():
        for x, y in zip(sorted(values), sorted(want[i]), strict=True):
            assert x == pytest.approx(y, rel=1e-9)


def test_lm_errors_are_those_of_the_filter(spark, docs):
    want = {i: v[0][-1] / v[0][0] for i, v in lm_brute_force([(i, t) for i, t, *_ in sample()]).items()}
    got = {r.doc_id: r.s for r in lm.score_held_out(docs).select("row.doc_id", (F.col("`score`") / F.col("n_tokens")).alias("s")).collect()}
    assert got.keys() == want.keys() and np.median([abs(got[i] - want[i]) for i in want]) < 0.05


def test_lm_of_empty_tables(spark, empty):
    assert lm.score_held_out(empty).count() == 0
    assert lm.score_held_out(empty, max_broadcast=-1).count() == 0
    got = lm.score_held_out(spark.createDataFrame([(2, "never trained")], SCHEMA.split(", lang")[0]).filter(F.lit(True)), folds=1).first()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0)


def test_lm_beats_unigrams_when_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score_held_out(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_log_frequency_filter():
    rng = np.random.default_rng(0)
    keys, counts = rng.integers(0, 1 << 63, 4000, dtype=np.uint64), rng.integers(1, 500, 4000)
    data = lm.filter_segment(keys, lm.level(counts, 2.0), 10, 5)
    held = lm.LogFrequencyFilter.of(np.frombuffer(data, np.uint8), np.array([len(data)]), 5)
    levels = held.levels(keys)
    assert (levels >= lm.level(counts, 2.0)).all() and (levels == lm.level(counts, 2.0)).mean() > 0.95
    assert (held.levels(rng.integers(0, 1 << 63, 4000, dtype=np.uint64)) > 0).mean() < 0.05
    packed = np.unique(keys)
    back, n = lm.unpack(lm.pack(packed, np.arange(len(packed))), len(packed))
    assert (back == packed).all() and (n == np.arange(len(packed))).all()


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_nearest(spark, broadcast_bytes):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(1000 + i, [float(v) for v in x[0]]) for i in range(60)]
    bad = [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [float("nan")] + [1.0] * 7), (2080, [None] + [1.0] * 7), (2100, [1.0] * 5), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.nearest(table, F.pmod("vec_id", F.lit(20)) == 0, k=20, broadcast_bytes=broadcast_bytes, block=60).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ids, full = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    hits = []
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        scores = full @ full[ids.tolist().index(q)]
        scores[ids == q] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits.append(len({v for _, v, _ in found} & set(ids[best].tolist())) / 20)
        assert all(abs(scores[ids.tolist().index(v)] - s) < 1e-9 for _, v, s in found)
    assert np.mean(hits) >= 0.95
    few = ann.nearest(table.filter("vec_id < 4"), F.col("vec_id") == 0, k=20).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3]
    assert ann.nearest(table.limit(0), F.lit(True)).count() == 0


def test_nearest_scores_doubles_as_they_are(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 5))
    x[:, 0] += 1e-9 * np.arange(60)  # lost in single precision
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(7, [float(v) for v in x[8]]), (7, [float(v) for v in x[8]])]  # one id with two vectors, and a repeat
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    for q in (0, 20, 40):
        near = sorted(((-float(np.einsum("i,i->", x[q], np.array(v))), i) for i, v in {(i, tuple(v)) for i, v in rows if i != q}))[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, pytest.approx(-s, rel=1e-13)) for s, i in near]


def test_repeated_rows_and_null_ids(spark):
    text = "the marl of stone and clay is the marl of stone"
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (None, None, None, None, None), (2, None, "fr", "b", 1)], SCHEMA)
    scored = decontam.benchmark_matches(docs, spark.createDataFrame([("i", text), ("i", text), (None, text)], "item_id string, text string")).collect()
    assert sorted((r.n_words, r.n_hit, len(r.matches)) for r in scored) == [(0, 0, 0), (0, 0, 0), *[(11, 11, 3)] * 3]
    assert sorted((r.doc_id is None, r.lang_pred) for r in langid.identify(docs, rounds=2).select("row.doc_id", "lang_pred").collect()) == [(False, "en"), (False, "en"), (False, "und"), (True, "en"), (True, "und")]
    pages = spark.createDataFrame([(None, "u", "x" * 1200), (None, "v", "x" * 1200), (3, "w", "x" * 1200)], "page_id long, url string, html string")
    assert sorted(r.record_type for r in warc.read_warc(warc.write_warc(pages)).collect()) == ["response", "revisit", "revisit"]
    assert mixing.mix_sources(docs).count() == 5


def test_similar_documents(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]

    def edited(text: list[str], changes: int) -> list[str]:
        out = list(text)
        for _ in range(changes):
            out[rng.randrange(len(out))] = rng.choice(words)
        return out

    texts: list[list[str]] = []
    for size in (12, 30, 80, 200, 500, 900):
        for _ in range(12):
            base = rng.choices(words, k=size)
            texts += [base, list(base), edited(base, max(1, size // 60)), edited(base, max(1, size // 25)), edited(base, size // 8)]
    crowd = rng.choices(words, k=150)
    texts += [crowd, *[edited(crowd, 2) for _ in range(80)], [], [], ["one"]]
    docs = spark.createDataFrame([(i, " ".join(t), None, None, 0) for i, t in enumerate(texts)] + [(None, None, None, None, 0)], SCHEMA)
    sets = [set(simhash.shingle_hashes(" ".join(t).encode(), 5).tolist()) for t in texts]
    parent = {i: i for i in range(len(texts))}
    for a in range(len(texts)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) / union if union else 1) >= 0.8:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect() if r.doc_id is not None}
    wrong = [i for i in got if got[i] != find(parent, i)]
    assert len(got) == len(texts) and not wrong


def similar_by_brute_force(texts: list[str]) -> list[int]:
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    parent = {i: i for i in range(len(texts))}
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return [find(parent, i) for i in range(len(texts))]


def test_similar_in_hot_blocks(spark):
    rng = random.Random(1)
    spread, base = [], [f"c{i}" for i in range(200)]
    for _ in range(120):  # edits of one text, many near each other and not near it
        copy = list(base)
        for p in rng.sample(range(0, 200, 5), rng.randint(0, 6)):
            copy[p] = f"x{rng.randrange(2)}.{p}"
        spread.append(" ".join(copy))
    rng = random.Random(2)
    tree = [[f"t{i}" for i in range(200)]]
    for i in range(120):  # revisions of revisions
        copy = list(rng.choice(tree))
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(200)] = f"y{i}.{rng.random()}"
        tree.append(copy)
    texts = [*spread, *map(" ".join, tree)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    want = similar_by_brute_force(texts)
    for options in ({}, {"max_block": 4, "chunk": 3000}):
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, **options).collect()}
        assert [got[i] for i in range(len(texts))] == want, options


def test_prefixes_are_exact_in_any_order():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, simhash.SHORT + 1))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, max(1, n // 12)).astype(np.uint64)]))
        marks = rng.integers(0, 256, 1 << (simhash.COMMON_BITS - 3)).astype(np.uint8) if _ % 20 == 0 else marks
        common = len(np.intersect1d(a, b))
        if common / (len(a) + len(b) - common) >= 0.8 and max(len(a), len(b)) <= simhash.SHORT:
            assert len(np.intersect1d(simhash.prefix(a, 0.8, marks), simhash.prefix(b, 0.8, marks)))
            assert len(np.intersect1d(simhash.prefix(a, 0.8), simhash.prefix(b, 0.8)))


def test_common_shingles_stand_last(spark):
    passage = " ".join(f"shared{i}" for i in range(14))
    texts = [f"{passage} " + " ".join(f"own{k}x{i}" for i in range(10)) for k in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    marks = simhash.common_shingles(docs, "text", 5, 0.8)
    assert 0 < np.unpackbits(marks).sum() <= 10  # shingles of the passage that stand in prefixes, and nothing else
    # marks that would exceed the bound are left out whole, and an empty table has none
    assert not simhash.common_shingles(docs, "text", 5, 0.8, most=0).any() and not simhash.common_shingles(docs.limit(0), "text", 5, 0.8).any()
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    for s in sets:
        bits = s & np.uint64((1 << simhash.COMMON_BITS) - 1)
        marked = {h for h, b in zip(s.tolist(), bits.tolist(), strict=True) if marks[b >> 3] >> (b & 7) & 1}
        # over a fifth of the set is unmarked, so no marked shingle is in the prefix
        assert len(s) - len(marked) >= len(simhash.prefix(s, 0.8, marks)) and not marked & {*simhash.prefix(s, 0.8, marks).tolist()}


def test_similar_at_the_edge(spark):
    rng = random.Random(3)
    texts = []
    for i in range(40):  # 4 of 5 shingles in common
        words = [f"s{i}.{j}" for j in range(9)]
        texts += [" ".join(words), " ".join(words[:-1])]
    for i in range(30):  # long texts, a little above and a little below
        words = [f"l{i}.{j}" for j in range(904)]
        copy = list(words)
        for j in rng.sample(range(0, 900, 5), 20 if i % 2 else 21):
            copy[j + 4] = f"e{i}.{j}"
        texts += [" ".join(words), " ".join(copy)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    want = similar_by_brute_force(texts)
    assert 0 < sum(want[i] != i for i in range(80, len(texts))) < 30
    assert [got[i] for i in range(len(texts))] == want


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://host:7077"))
    assert common.shared_dir(session("yarn", "/shared")) == "file:///shared"
