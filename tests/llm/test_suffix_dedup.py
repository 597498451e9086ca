import hashlib
import random

import numpy as np
import pyarrow as pa

from shelfspark.llm import bitmaps, suffix_dedup
from shelfspark.llm import suffix_array as suffix_array_module
from shelfspark.llm.suffix_array import common_prefixes, suffix_array
from tests.llm.test_near_duplicates import twisted
from tests.llm.util import docs

L = suffix_dedup.LENGTH


def brute(texts):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = {}
    for _, b in data:
        for k in range(len(b) - L + 1):
            seen[b[k : k + L]] = seen.get(b[k : k + L], 0) + 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - L + 1):
            if seen[b[k : k + L]] > 1:
                gone[k : k + L] = b"\1" * L
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n))
    shared = [prose(n) for n in (199, 210, 260, 700)]
    texts = [(k, prose(rng.randint(0, 900))) for k in range(30)]
    for k in range(30, 70):
        texts.append((k, prose(rng.randint(0, 300)) + rng.choice(shared) + prose(rng.randint(0, 300)) + rng.choice(shared)[5:]))
    return texts + [(70, None), (71, ""), (72, "x" * 199), (73, "y" * 201), (30, texts[40][1]), (None, shared[3]), (None, shared[3]), (74, shared[0]), (75, shared[2] * 3)]


def run(spark, tmp_path, texts):
    got = suffix_dedup.dedup_substrings(docs(spark, tmp_path, texts)).collect()
    return sorted(map(tuple, got), key=str)


def test_against_brute_force(spark, tmp_path):
    assert run(spark, tmp_path, corpus()) == brute(corpus())


def test_crowded_anchors_and_small_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 2)
    monkeypatch.setattr(suffix_dedup, "CROWDED_IN_BLOCK", 0)
    monkeypatch.setattr(suffix_dedup, "SCAN_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    assert run(spark, tmp_path, corpus()) == brute(corpus())


def test_patterns_nul_bytes_and_many_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_TEXT", 50)
    monkeypatch.setattr(suffix_dedup, "SHARD_TEXT", 20)
    one, two = twisted(4096)
    rng = random.Random(3)
    nul = "".join(rng.choice("\0\1a") for _ in range(350))
    texts = [(1, one), (2, two), (3, "x" + one[:300]), (4, nul), (5, "b" + nul[40:330] + "\0\0"), (6, "\0" * 250), (None, nul[:260]), (6, "\0" * 250)]
    assert run(spark, tmp_path, texts) == brute(texts)


def test_rows_that_share_an_id_and_a_very_long_text(spark, tmp_path):
    rng = random.Random(5)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long, other = say(60_000), say(500)
    texts = [(1, long), (1, other), (1, say(400)), (2, other[100:400] + say(200)), *[(3, long[1000:2000])] * 5]
    assert run(spark, tmp_path, texts) == brute(texts)


def test_clashing_names(spark, tmp_path):
    path = str(tmp_path / "clash")
    rows = [(k, "same text " * 40, "r", "s", 1, 2) for k in (1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, row string, spans string, span_id long, n_bytes long").write.parquet(path)
    assert [(r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_substrings(spark.read.parquet(path)).collect()] == [(400, 400)] * 2


def test_kept_text_is_text(spark, tmp_path):
    got = suffix_dedup.dedup_substrings(docs(spark, tmp_path, [(1, "é" * 150 + "tail"), (2, "é" * 150)]), whole=True).collect()
    assert {r.doc_id: r.kept_text for r in got} == {1: "tail", 2: ""}


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_induced_scans_in_short_and_long_blocks(monkeypatch):
    """Every block length, steps only, runs, periods, and names of more than 16 bits in the recursion."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, k, n) for k in (2, 5, 200) for n in (40, 300)]
    texts += [np.full(200, 3), np.tile([1, 2], 100), np.tile(rng.integers(0, 9, 37), 8), np.arange(150)[::-1]]
    for few in (1, 8, 10**6):
        monkeypatch.setattr(suffix_array_module, "FEW", few)
        for s in texts:
            data = s.tolist()
            assert list(suffix_array(s, 256)) == sorted(range(len(s)), key=lambda i: data[i:])
        for n in (60, 400):  # a large alphabet: most symbols, and most names, stand once
            s = rng.integers(0, n, n)
            s = np.concatenate([s, s[n // 3 : n // 2], s[:9]])
            data = s.tolist()
            assert list(suffix_array(s, n)) == sorted(range(len(s)), key=lambda i: data[i:])
    monkeypatch.undo()
    s = rng.integers(0, 256, 300_000)
    sa = suffix_array(s, 256)
    data = s.astype(np.uint8).tobytes()
    assert np.array_equal(np.sort(sa), np.arange(len(s))) and all(data[a : a + 50] < data[b : b + 50] for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()))
    periodic = np.tile(rng.integers(0, 256, 1000), 300)
    sa = suffix_array(periodic, 256)
    assert np.array_equal(np.sort(sa), np.arange(300_000)) and np.array_equal(np.diff(sa[:300]), np.full(299, -1000))


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(400):
        s = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(0, 40))]
        s = s + s if rng.random() < 0.3 else s
        for symbols in (256, 10**6):
            sa = suffix_array(np.array(s, np.int64), symbols)
            assert list(sa) == sorted(range(len(s)), key=lambda i: s[i:])
        if not s:
            continue
        p = common_prefixes(np.array(s, np.uint16), sa, 11)
        assert len(p) == len(s)
        for r, i in enumerate(sa):
            n, j = 0, sa[r - 1]
            while r and i + n < len(s) and j + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            assert p[i] == min(n, 11)


def test_bitmap_follows_the_anchors_that_it_holds(monkeypatch):
    """A full bitmap would send every segment of the table to be sorted."""
    monkeypatch.setattr(bitmaps, "FILTER_POWER", 12)
    rng = np.random.default_rng(8)
    anchors, slices, maps = np.sort(rng.integers(0, 2**64, 20_000, np.uint64)), 64, []
    several = rng.random(len(anchors)) < 0.5
    for k in range(slices):
        rows = []
        for n, block in enumerate((anchors, anchors[several])):  # with a segment of their own in each block
            short = ((block[(block >> np.uint64(58)) == k]) >> np.uint64(26)).astype(np.uint32)
            planes = np.diff(short, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            rows.append({"slice": k, "anchors": planes, "segments": np.full(len(short), n, np.uint64).tobytes(), "twice": bytes(len(short))})
        maps.append(suffix_dedup._add_anchors(slices)(pa.Table.from_pylist(rows))["several"][0].as_py())
    bits = np.frombuffer(bitmaps.joined(maps), np.uint8)
    assert bitmaps.has(bits, anchors[several]).all() and bitmaps.has(bits, anchors[~several]).mean() < 1 / 20
