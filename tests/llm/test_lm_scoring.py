import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from shelfspark.llm import lm_scoring, log_bilinear
from shelfspark.llm.log_bilinear import GROUP, HEAD, WIDTH, LogBilinear, contexts_of
from tests.llm.util import FOLD, table, words

DOCS = "doc_id long, text string, block string, units string, `Score` double, group int"


def tokens(text):
    return [*words((text or "").translate(FOLD)), "\n"]


def plain(rows):
    """What is counted: of each row held_out, n_tokens, n_known, train_tokens and base_score."""
    learned = Counter()
    for i, text in rows:
        if not lm_scoring.held_out(i):
            learned.update(tokens(text))
    n, v = sum(learned.values()), len(learned)
    out = []
    for i, text in rows:
        t = tokens(text)
        base = sum(math.log10((learned[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        out.append((i, lm_scoring.held_out(i), len(t), sum(learned[x] > 0 for x in t), n, round(base, 6)))
    return sorted(out, key=str)


def two_tongues(n, seed=1):
    """Texts of one of two languages whose words follow one another in a fixed way, mostly."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        tongue = rng.choice("xy")
        at, out = 0, []
        for _ in range(rng.randrange(30, 120)):
            at = (2 * at + 1) % 11 if rng.random() < 0.8 else rng.randrange(11)
            out.append(f"{tongue}{at}w" if rng.random() < 0.9 else f"{rng.randrange(10**6)}{tongue}")
        texts.append(" ".join(out))
    return texts


def test_counts_and_scores(spark, tmp_path):
    texts = [None, "", "   ", "The THE the Ünïcode É", "a\x1cb c\x85d \n", "x" * 100_000, "w " * 50_000, *two_tongues(200)]
    rows = list(enumerate(texts)) + [(None, "nobody's words"), (None, None), (3, texts[3]), (205, texts[-1])]
    d = table(spark, tmp_path, [(*r, "clash", "clash", 0.5, 1) for r in rows], DOCS)
    got = lm_scoring.score_texts(d).collect()
    assert got[0].__fields__ == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=str) == plain(rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert len(held) > 10
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held) and sum(r.score > r.base_score for r in held) > 0.9 * len(held)


def test_probabilities_add_up(spark, tmp_path):
    d = table(spark, tmp_path, [(k, t, None, None, None, None) for k, t in enumerate([*two_tongues(120), "rare1 rare2, rare2, rare3."])], DOCS)
    encoded, v = lm_scoring.encode(d)
    model = LogBilinear(v.inputs, v.outputs, lm_scoring.train(encoded, v))
    context = np.array([[3 + k * v.inputs] for k in range(WIDTH)], np.int32)
    units = np.flatnonzero(v.possible)
    assert abs(sum(10 ** model.log10(context, np.array([u]), v.possible)[0] for u in units) - 1) < 1e-4
    learned = Counter(x for r in d.collect() if not lm_scoring.held_out(r.doc_id) for x in tokens(r.text))
    assert v.tokens == sum(learned.values()) and v.words == len(learned)
    shares = Counter()
    for w, c in learned.items():
        if w.encode() not in v.unit:
            kind = int(lm_scoring.word_class([w.encode()])[0])
            shares[kind] += (c - v.discount) / v.mass[kind]
    assert shares and all(abs(x - 1) < 1e-9 for x in shares.values()) and {k for k in range(lm_scoring.CLASSES) if v.rest_words[k] > 0} == set(shares)


def test_nothing_to_learn_and_empty(spark, tmp_path):
    held = next(k for k in range(1000) if lm_scoring.held_out(k))
    alone = lm_scoring.score_texts(table(spark, tmp_path, [(held, "some words", "", "", 0.0, 0)], DOCS)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in alone] == [(3, 0, 0, 0.0)] and abs(alone[0].score) < 1e-5
    assert lm_scoring.score_texts(table(spark, tmp_path, [], DOCS)).count() == 0


def test_groups_and_blocks_of_any_size(spark, tmp_path, monkeypatch):
    """Many small blocks and groups count what one counts, and a text longer than a block is taken whole."""
    rows = list(enumerate(two_tongues(60)))
    d = table(spark, tmp_path, [(*r, "", "", 0.0, 0) for r in rows], DOCS)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 300)
    monkeypatch.setattr(lm_scoring, "GROUP_BYTES", 500)
    got = lm_scoring.encode(d)[0].collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == [(*x[:4], x[5]) for x in sorted(plain(rows))]


def test_estimation_follows_the_risk():
    """The gradient that a step takes is that of the noise-contrastive risk, by differences."""
    rng = np.random.default_rng(0)
    inputs, outputs, n = 7, 5, 6
    units, noise = rng.integers(0, outputs, n), np.array([0.4, 0.3, 0.1, 0.1, 0.1])
    contexts = contexts_of(rng.integers(0, inputs - 1, n), np.array([0, 4, n]), inputs)
    start = LogBilinear(inputs, outputs, rng.normal(0, 0.5, (WIDTH * inputs + outputs) * 16 + outputs))

    class Drawn:
        def random(self, k):
            return np.random.default_rng(5).random(k)

    from shelfspark.llm.log_bilinear import DRAWN, NOISE

    drawn = np.minimum(np.searchsorted(np.cumsum(noise), Drawn().random(DRAWN), side="right"), outputs - 1)

    def risk(parameters):
        m = LogBilinear(inputs, outputs)
        p = parameters.astype(np.float64)
        vectors, targets, bias = (x.reshape(s) for x, s in zip(np.split(p, np.cumsum([np.prod(s) for s in m.shapes])[:-1]), m.shapes, strict=True))
        h = sum(vectors[row] for row in contexts)
        expected = np.log(NOISE * noise)
        own = (h * targets[units]).sum(1) + bias[units] - expected[units]
        other = h @ targets[drawn].T + bias[drawn] - expected[drawn]
        return np.log1p(np.exp(-own)).mean() + NOISE / DRAWN * np.log1p(np.exp(other)).sum() / n

    taken = {}
    start._step = lambda part, gradient, rate: taken.__setitem__(part, gradient.copy())
    start.learn(contexts, units, noise, Drawn(), 0.1)
    gradient = np.concatenate([taken[k].ravel() for k in range(3)])
    for k in rng.choice(len(gradient), 60, replace=False):
        step = np.zeros(len(gradient))
        step[k] = 1e-5
        p = start.parameters.astype(np.float64)
        assert abs((risk(p + step) - risk(p - step)) / 2e-5 - gradient[k]) < 1e-4


def test_contexts_stay_in_their_text():
    got = contexts_of(np.array([0, 1, 2, 0, 1]), np.array([0, 3, 5]), 9)
    assert got.shape == (WIDTH, 5)
    assert got[0].tolist() == [8, 0, 1, 8, 0] and (got[1] - 9).tolist() == [8, 8, 0, 8, 8] and (got[3] - 27).tolist() == [8] * 5


def test_words_beyond_the_first_are_units_of_their_own(spark, tmp_path):
    """600 words that the word before tells: each is a unit, and the model learns which follows."""
    rng = random.Random(4)
    texts = []
    for _ in range(400):
        at, out = rng.randrange(600), []
        for _ in range(120):
            at = (at * 7 + 1) % 600
            out.append(f"w{at}e")
        texts.append(" ".join(out))
    d = table(spark, tmp_path, [(k, t, "", "", 0.0, 0) for k, t in enumerate(texts)], DOCS)
    v = lm_scoring.encode(d)[1]
    learned = Counter(x for k, t in enumerate(texts) if not lm_scoring.held_out(k) for x in tokens(t))
    assert {w for w, n in learned.items() if n >= lm_scoring.LEAST} == {w.decode() for w in v.unit} and len(v.unit) == 601
    assert LogBilinear(v.inputs, v.outputs).groups > 0
    held = [r for r in lm_scoring.score_texts(d).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.93 * sum(r.base_score for r in held)


def test_groups_add_up_and_are_learned():
    rng = np.random.default_rng(3)
    inputs, outputs = 1001, 1000
    model = LogBilinear(inputs, outputs)
    assert model.groups == (outputs - HEAD) // GROUP and model.stop < outputs
    offsets = np.array([0, 5000, 20_000])
    units = np.cumsum(np.ones(20_000, np.int64) * 7) % outputs
    contexts, noise = contexts_of(units, offsets, inputs), np.full(outputs, 1 / outputs)
    possible = rng.random(outputs) < 0.9
    one = np.repeat(contexts[:, 100:101], possible.sum(), axis=1)
    assert abs((10 ** model.log10(one, np.flatnonzero(possible), possible)).sum() - 1) < 1e-4
    before = model.log10(contexts, units, np.ones(outputs, bool)).mean()
    for _ in range(8):
        order = rng.permutation(len(units))
        model.learn(contexts[:, order], units[order], noise, rng, 0.2)
    assert model.log10(contexts, units, np.ones(outputs, bool)).mean() > before + 0.5
    assert abs((10 ** model.log10(one, np.flatnonzero(possible), possible)).sum() - 1) < 1e-4


def test_steps_of_the_rows_that_a_batch_meets(monkeypatch):
    """A step for some rows is the step for all of them."""
    rng = np.random.default_rng(5)
    contexts, d_h = contexts_of(rng.integers(0, 600, 900), np.array([0, 900]), 601), rng.normal(size=(900, 16)).astype(np.float32)
    made = []
    for bound in (0, 10**9):
        monkeypatch.setattr(log_bilinear, "DENSE", bound)
        model = LogBilinear(601, 40)
        model._learn_vectors(contexts, d_h, 0.1)
        model._learn_vectors(contexts[:, ::-1], d_h, 0.1)
        made.append(model.parameters)
    assert np.allclose(*made, atol=1e-5)


def test_changes_are_averaged_by_the_places_of_their_units():
    rows = [(2.0, 1.0, 4.0), (6.0, 0.0, 8.0)]  # weights of two rows, and what changes
    made = pa.table({"slice": [3, 3], "weights": [np.array([w, u], "<f4").tobytes() for w, u, _ in rows], "change": [np.full((2, 17), c, "<f2").tobytes() for *_, c in rows]}, schema=pa.schema([("slice", pa.int32()), ("weights", pa.binary()), ("change", pa.binary())]))
    got = np.frombuffer(lm_scoring._merge(made)["change"][0].as_py(), "<f4").reshape(2, 17)
    assert got[0].tolist() == [7.0] * 17 and got[1].tolist() == [4.0] * 17


def test_groups_leave_few_single_units():
    """Groups take all but the head and the classes, so a first choice is among no more than it needs."""
    for outputs in (513, 1000, 5000, 32_801):
        model = LogBilinear(outputs + 32, outputs)
        assert model.groups == (outputs - HEAD) // GROUP and log_bilinear.TAIL <= outputs - model.stop < log_bilinear.TAIL + model.groups
        assert len(model.first) < HEAD + log_bilinear.TAIL + 2 * model.groups
        assert sorted(set(model.choice.tolist())) == list(range(len(model.first)))


def test_scores_far_out_are_normalised():
    """Near scores go to exp as they are, far ones less their largest; both are what plain sums say."""
    rng = np.random.default_rng(6)
    model = LogBilinear(701, 700, rng.normal(0, 1, (WIDTH * 701 + 702) * 16 + 702))
    model.vectors[:300] *= 40
    contexts, units = contexts_of(rng.integers(0, 700, 2000), np.array([0, 2000]), 701), rng.integers(0, 700, 2000)
    possible = np.ones(700, bool)
    got = model.log10(contexts, units, possible)
    h = sum(model.vectors.astype(np.float64)[row] for row in contexts)
    lengths = np.sqrt((h**2).sum(1))
    assert lengths.min() < 20 and lengths.max() > 200
    for at in (*np.argsort(lengths)[:20], *np.argsort(lengths)[-20:]):
        want = 0.0
        rows = [(model.first, model.choice[units[at]])]
        if model.start <= units[at] < model.stop:
            first = model.start + (units[at] - model.start) // model.size * model.size
            rows.append((np.arange(first, first + model.size), units[at] - first))
        for of, own in rows:
            scores = model.targets[of].astype(np.float64) @ h[at] + model.bias[of]
            want += scores[own] - scores.max() - np.log(np.exp(scores - scores.max()).sum())
        assert abs(got[at] * np.log(10) - want) < 1e-3 * max(1, abs(want))
