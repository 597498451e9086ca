import random

import numpy as np
import pyarrow as pa

from shelfspark.llm import bitmaps, ngram_join
from shelfspark.llm import text_arrays as ta
from shelfspark.llm.components import components
from tests.llm.util import FOLD, docs, words


def brute(texts):
    sets = []
    for _, t in texts:
        w = words((t or "").translate(FOLD))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(texts):
        own = [texts[j][0] for j in range(len(texts)) if find(j) == find(i) and texts[j][0] is not None]
        out.append((d, len(sets[i]), min(own) if own else None))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    hot = [rng.choice(vocabulary) for _ in range(60)]
    texts, n = [], 0
    base = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(160):
        kind = k % 5
        if kind == 0:  # near copies around the threshold
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind == 1:  # a passage that many share
            w = hot + [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 100]))]
        elif kind == 2:
            w = ["A", "b", "C"][: rng.randint(0, 3)]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        texts.append((n, " ".join(w)))
        n += 1
    return texts + [(n, None), (n + 1, ""), (n + 2, "  \n"), (3, texts[3][1]), (None, texts[4][1]), (None, "only here and nowhere else at all"), (n + 3, texts[0][1].upper())]


def check(spark, tmp_path, texts):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs(spark, tmp_path, texts)).collect()]
    assert sorted(got, key=str) == brute(texts)


def test_against_brute_force(spark, tmp_path):
    check(spark, tmp_path, corpus())


def test_several_blocks_and_long_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(ngram_join, "LONG_LIST", 3)
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    check(spark, tmp_path, corpus(2))


def twisted(n):
    """The Thue-Morse word of n letters and its complement: polynomials modulo powers of two take them for equal."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_modulo_powers_of_two(spark, tmp_path):
    one, two = twisted(4096)
    check(spark, tmp_path, [(1, one), (2, two), (3, f"x {one} y z v w"), (4, f"x {two} y z v w"), (5, one)])


def test_hashes_of_ranges():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3_000_000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 1_500_000, 5000))
    ends = starts + 12
    by = {}
    for s, h in zip(starts.tolist(), ta.range_hashes(data, starts, ends).tolist(), strict=True):
        by.setdefault(bytes(data[s : s + 12]), set()).add(h)
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)
    long = np.concatenate([data[:1_200_000], data[:1_200_000], data[:600_000]])
    bounds = np.array([0, 1_200_000, 2_400_000, 3_000_000])
    got = ta.range_hashes(long, bounds[:-1], bounds[1:])
    assert got[0] == got[1] != got[2] and ta.range_hashes(data, bounds[2:3], bounds[3:4]) != ta.range_hashes(long, bounds[2:3], bounds[3:4])
    upper = np.frombuffer(b"ABCabc", np.uint8)
    a, b = np.array([0, 3]), np.array([3, 6])
    assert len(set(ta.range_hashes(upper, a, b, folded=True))) == 1 and len(set(ta.range_hashes(upper, a, b))) == 2


def test_merging_and_skipping():
    """The overlap search alone, against all pairs."""
    rng = random.Random(6)
    for bound in (0, 1, 3, 100):
        base = rng.sample(range(60), 40)
        sets = [sorted({x if rng.random() < 0.93 else rng.randrange(60, 99) for x in base[: rng.choice([5, 30, 36, 40])]}) for _ in range(40)]
        flat, n = np.array([x for s in sets for x in s], np.uint64), np.array([len(s) for s in sets])
        was, ngram_join.LONG_LIST = ngram_join.LONG_LIST, bound
        label = ngram_join.connect(n, flat, np.arange(40), n, flat, np.arange(40), 40)
        ngram_join.LONG_LIST = was
        links = [(i, j) for i in range(40) for j in range(i) if 4 * len(set(sets[i]) & set(sets[j])) >= 3 * len(set(sets[i]) | set(sets[j]))]
        want = ta.forest(40, *(np.array(x, np.int64) for x in zip(*links, strict=True)))
        assert len(links) > 20 and all((label[i] == label[j]) == (want[i] == want[j]) for i in range(40) for j in range(40))
    found, count = ngram_join.merge([np.array([1, 4, 9]), np.array([4]), np.array([0, 9])])
    assert found.tolist() == [0, 1, 4, 9] and count.tolist() == [1, 1, 2, 2]


def test_clashing_names_and_long_texts(spark, tmp_path):
    rows = [(k, t, "t", "s", 1, 2, 3, "p") for k, t in [(1, "a b c d e f " * 20_000), (2, "a b c d e f " * 20_001), (3, "z " * 9)]]
    path = str(tmp_path / "clash")
    spark.createDataFrame(rows, "doc_id long, text string, tokens string, sig string, n_shingles long, component_id long, row long, part string").write.parquet(path)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.read.parquet(path)).collect()}
    assert got == {1: (6, 1), 2: (6, 1), 3: (1, 3)}


def test_empty_table(spark, tmp_path):
    assert ngram_join.near_duplicates(docs(spark, tmp_path, [])).count() == 0


def test_components_by_contraction(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    frame = spark.createDataFrame(links, "a long, b long")
    groups = []
    for bound in (1000, 5):
        by = {}
        for r in components(frame, bound).collect():
            by.setdefault(r.component, set()).add(r.node)
        groups.append(sorted(map(sorted, by.values())))
    assert groups[0] == groups[1]


def test_sets_are_taken_from_their_block():
    """Each asked block gets the sets that ask for it, once, and no others."""
    sets = {30: [1, 2, 3], 10: [4], 20: [5, 6], 40: [7, 8]}
    row = {"cluster": 5, "chunk": 2, "asking": [10, 20, 10, 30, 10], "asked": [7, 7, 7, 9, 9]}
    row["sigs"], row["sizes"] = np.array(list(sets), np.int64).tobytes(), np.array([len(x) for x in sets.values()], np.int64).tobytes()
    row["tokens"] = np.array([t for x in sets.values() for t in x], np.uint64).tobytes()
    got = {}
    for b in ngram_join._parts_for(iter([pa.RecordBatch.from_pylist([row])])):
        (r,) = b.to_pylist()
        sigs, sizes, tokens = (np.frombuffer(r[c], t).tolist() for c, t in (("sigs", np.int64), ("sizes", np.int64), ("tokens", np.uint64)))
        ends = np.cumsum(sizes).tolist()
        got[r["cluster"], r["chunk"], r["chunk_2"]] = {s: tokens[e - n : e] for s, n, e in zip(sigs, sizes, ends, strict=True)}
    assert got == {(5, 2, 7): {10: [4], 20: [5, 6]}, (5, 2, 9): {30: [1, 2, 3], 10: [4]}}


def test_bitmap_follows_the_shingles_that_it_holds(monkeypatch):
    """A full bitmap would let every set pass and join them all to one cluster."""
    monkeypatch.setattr(bitmaps, "FILTER_POWER", 12)
    tokens = np.sort(np.random.default_rng(5).integers(0, 2**64, 20_000, np.uint64))
    twice = np.random.default_rng(7).random(len(tokens)) < 0.5
    several, slices, maps = tokens[twice], 64, []
    for k in range(slices):
        packed = []
        for block in (tokens, several):
            own = ngram_join._shifted(block[(block >> np.uint64(58)) == k], slices)
            packed.append(np.diff(own, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
        maps.append(ngram_join._list_lengths(slices)(pa.table({"slice": pa.array([k] * 2, pa.int32()), "tokens": packed}))["shared"][0].as_py())
    bitmap = np.frombuffer(bitmaps.joined(maps), np.uint8)
    assert bitmaps.has(bitmap, several).all() and bitmaps.has(bitmap, tokens[~twice]).mean() < 1 / 3
    assert bitmaps.size_for(10**9, 64) == 2**24 and bitmaps.size_for(0, 64) == 2**6  # bounds: 2^30 and 2^12 bits


def test_sets_ask_only_for_those_they_may_be_linked_with():
    """Sets 1 and 2 differ in one shingle of 40, set 3 shares one shingle with both: each has a component and a block of its own."""
    rng = np.random.default_rng(6)
    one, three = np.sort(rng.integers(0, 2**63, 40, np.uint64)), rng.integers(0, 2**63, 40, np.uint64)
    sets = [one, np.sort(np.append(one[:-1], three[0])), np.sort(np.append(three[:-1], one[0]))]
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(3), 40)
    facts = np.concatenate([np.array([[1, 1, 40], [2, 2, 40], [3, 3, 40]]), ngram_join._parities(owner, tokens, 3)], axis=1)
    row = {"tokens": tokens.tobytes(), "owners": owner.astype(np.int32).tobytes(), "sigs": np.array([11, 12, 13]).tobytes(), "facts": facts.tobytes()}
    asks = lambda: {(r["sig"], r["chunk_2"]) for r in ngram_join._meet_apart(pa.Table.from_pylist([row])).to_pylist()}
    assert asks() in ({(11, 2)}, {(12, 1)}, {(11, 2), (12, 1)})
    common, ngram_join.COMMON = ngram_join.COMMON, 1  # all lists are long: whoever is there is asked for
    try:
        assert {x for x, _ in asks()} | {c + 10 for _, c in asks()} == {11, 12, 13}
    finally:
        ngram_join.COMMON = common
