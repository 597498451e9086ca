import hashlib
import random
import zlib

import numpy as np
import pytest

from shelfspark.llm import merkle, periodic_runs
from shelfspark.llm.square_catchers import Catchers
from tests.llm.util import FOLD, table, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank int, `Digest` string, r string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = (doc_id, source, lang, n_chars, text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def climb(tree, k):
    """(digests before, digests after) of each level."""
    for level in tree[:-1]:
        run = k - k % 8
        yield level[run:k], level[k + 1 : run + 8]
        k //= 8


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: levels([x[2] for x in sorted(by[name], key=lambda x: x[:3])]) for name in names}
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for t, name in enumerate(names):
        for k, (_, _, own, r) in enumerate(sorted(by[name], key=lambda x: x[:3])):
            steps = [*climb(trees[name], k), *climb(top, t)]
            doc_id, text = r[0], r[1]
            struck = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            at = leaf(doc_id, text.translate(FOLD), *r[2:5]) if struck else own
            for before, after in steps:
                at = sha(*before, at, *after)
            out.append((doc_id, own, trees[name][-1][0], top[-1][0], sha(*(x for b, a in steps for x in (*b, *a))), at, at == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [0, 1, 2, 130])
def test_manifest_against_plain_levels(spark, tmp_path, size):
    rng = random.Random(size)
    rows = [(k, f"Text Ä {k}" * (k % 3), ["en", "de", None, "-", "é", ""][rng.randrange(6) if k % 3 else 0], "s", k) for k in range(size)]
    if size > 2:
        rows += [(None, "NOBODY", "en", None, None), (None, None, "en", None, None), (3, None, "en", "s", 3), (3, "", "en", "s", 3), (7, "x" * 300_000, "only", None, None)]
        rows += [(5, "Copy", "en", "s", 4)] * 70  # whole runs that are alike
    d = table(spark, tmp_path, [(*r, "clash", 1, "clash", "clash") for r in rows], DOCS)
    got = sorted((tuple(r) for r in merkle.verify(d).collect()), key=str)
    assert got == plain_manifest(rows)
    if size > 2:
        assert {r[-1] for r in got} == {True, False} and all(r[-1] for r in got if r[0] is None)


def test_proofs_of_some_leaves(spark, tmp_path):
    rows = [(k, f"T{k}", "en" if k < 600 else "de", "s", k, "", 0, "", "") for k in range(700)]
    m = merkle.manifest(merkle.leaves(table(spark, tmp_path, rows, DOCS)), "doc_id", "digest")
    wanted = m.nodes.where("doc_id IN (0, 599, 611)").select("tree", "rank", m.nodes.doc_id.alias("r"))
    found = {r.r: r for r in merkle.prove(m, wanted).withColumn("folded", merkle.fold(merkle.shown(merkle.F.col("digest")), merkle.F.col("path"))).collect()}
    assert set(found) == {0, 599, 611}
    assert all(r.folded == r.root.hex() for r in found.values()) and len(found[0].path) == 5 and len(found[611].path) == 4
    assert m.nodes.count() == 700 and {r.n for r in m.nodes.select("n").distinct().collect()} == {600, 100}
    # records are found by what they hold: equal subtrees are stored once
    copies = merkle.manifest(merkle.leaves(table(spark, tmp_path, [(1, "same", "en", "s", 4, "", 0, "", "")] * 512, DOCS)), "doc_id", "digest")
    assert [r.count() for r in copies.records] == [1, 1, 1]


def plain_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, q, e) for (s, e), q in found.items())


def repetitive(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 4:
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
            for i in range(a, min(n, a + p * rng.randrange(2, 6))):
                w[i] = w[a + (i - a) % p]
    return w


def test_catchers_against_all_pairs():
    rng = random.Random(7)
    for _ in range(300):
        w = repetitive(rng, rng.choice([0, 1, 5, 13, 40, 100, 257]), rng.choice([1, 2, 3, 5]))
        least, step = rng.choice([2, 4, 9, 10, 12, 15]), rng.choice([1, 2, 7, 50, 1000])
        c = Catchers(least)
        for at in range(0, len(w), step):
            c.append(np.array(w[at : at + step]))
        assert [(s, q, e) for s, e, q in c.runs().tolist()] == plain_runs(w, least)
    fib, last = [0, 1], [0]
    while len(fib) < 400:
        fib, last = fib + last, fib
    c = Catchers(2)
    c.append(np.array(fib))
    assert [(s, q, e) for s, e, q in c.runs().tolist()] == plain_runs(fib, 2)
    thue = [k.bit_count() % 2 for k in range(512)]
    c = Catchers(2)
    c.append(np.array(thue))
    assert [(s, q, e) for s, e, q in c.runs().tolist()] == plain_runs(thue, 2)


def test_runs_with_hashes_that_collide(monkeypatch):
    """Runs are checked word by word: equal hashes of different words lose and add nothing."""
    rng = random.Random(3)
    monkeypatch.setattr("shelfspark.llm.square_catchers.mix", lambda x: x & np.uint64(3))
    for _ in range(100):
        w = repetitive(rng, 120, 9)
        c = Catchers(4)
        c.append(np.array(w))
        assert {(s, q, e) for s, e, q in c.runs().tolist()} <= set(plain_runs(w, 4))


def plain_document(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = [(s, e - s, q) for s, q, e in plain_runs(w, 12)]
    runs.sort(key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_documents(spark, tmp_path):
    rng = random.Random(11)
    texts = [None, "", " \t\n", "a " * 500, "é\x1cb c\x85d " * 40, "one two three", " lead and trail ", "x" * 200_000, "p q r " * 3 + "s " + "p q r " * 9]
    texts += [" ".join(f"w{x}" for x in repetitive(rng, rng.randrange(600), rng.choice([2, 4, 50]))) for _ in range(120)]
    rows = [(k, t, "clash", 1, 2) for k, t in enumerate(texts)] + [(None, "a b " * 20, None, None, None), (None, None, None, None, None), (9, texts[9], None, None, None)]
    schema = "doc_id long, text string, runs string, start int, `Length` int"
    d = table(spark, tmp_path, rows, schema)
    got = sorted((tuple(r) for r in periodic_runs.detect_runs(d, change=periodic_runs.periodic).collect()), key=str)
    assert got == sorted((plain_document(i, t) for i, t, *_ in rows), key=str)
    assert periodic_runs.detect_runs(d.limit(0)).count() == 0
    whole = {r.doc_id: r for r in periodic_runs.detect_runs(d.where("doc_id IN (3, 8)"), texts=True).collect()}
    assert whole[3].collapsed == "a" and [tuple(x) for x in whole[3].runs] == [(0, 500, 1)]
    assert whole[8].collapsed == "p q r p q r p q r s p q r" and [tuple(x) for x in whole[8].runs] == [(10, 27, 3)]


def test_long_text_in_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic_runs, "STRETCH", 37)
    w = repetitive(random.Random(2), 900, 3)
    runs = periodic_runs.sequence_runs(np.array(w + w[:50], np.int64), np.array([0, 900, 950]), 12)
    assert [(s, q, e) for t, s, e, q in runs.tolist() if t == 0] == plain_runs(w, 12)
    assert [(s, q, e) for t, s, e, q in runs.tolist() if t == 1] == plain_runs(w[:50], 12)
