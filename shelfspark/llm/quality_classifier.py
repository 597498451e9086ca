"""Quality scores by positive-unlabelled learning.

A small network is fitted with the non-negative unbiased risk: trusted positives give the positive part, unlabelled
web text minus the positives' share (the class prior) gives the negative part, and where that part turns negative its
gradient is reversed instead of being over-fitted.  Negative labels are used nowhere.  The class prior is estimated from
positives and unlabelled text alone: a network told to tell the two apart is fitted on half of each, and on the other
half the share of unlabelled text above a score, divided by that of positives, bounds the prior for every score; the
score with the best bound by its confidence gives the estimate (``class_prior``).

Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1.  Fitting takes the FIT_ROWS trusted positives
and the FIT_ROWS other documents whose doc_id has the smallest hashes: a bound on what the driver gathers (features,
not texts), whatever the table's size; a doc_id that repeats counts once there, with its smallest text.  Every document
is then scored where it lies, without a shuffle.  Scores depend on the text alone: shares of character classes, of
word and line shapes, and of words by the bucket that their hash falls into, so which words tell is learned.

Defined results: a null text is empty, an empty text has features of its own and so a score; without any trusted
positive all scores are 0.5; a row with a null doc_id is scored and not held out; repeated rows give repeated results;
documents whose ids' hashes are equal are taken in the order of doc_id; empty tables give no rows; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import text_arrays as ta
from shelfspark.llm.storage import small_batches

FIT_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 512, 0.01, 1e-4
#: The negative part may fall this far below 0 before its gradient is reversed.
SLACK = 0.0
#: Buckets of words, and epochs and confidence of the estimate of the class prior.
BUCKETS, PRIOR_EPOCHS, DOUBT = 64, 30, 0.1

_CLASSES = np.zeros(256, np.int64)  # 0: small letters and all else
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"()-", b"!?", b"#*$%&<>", b"|"), start=1):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 8
N_CLASSES = 9
JUNK = np.isin(np.arange(N_CLASSES), (1, 2, 5, 6, 7))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kind = _CLASSES[data]
    text = np.repeat(np.arange(n), size)
    shares = np.bincount(text * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(size, 1)[:, None]
    starts, ends, bounds = ta.words(data, offsets)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(n), count)
    per_word = lambda x: np.bincount(owner, weights=x, minlength=n) / np.maximum(count, 1)
    h = ta.range_hashes(data, starts, ends, folded=True)
    place = owner * BUCKETS + (h % ta.U64(BUCKETS)).astype(np.int64)
    buckets = np.bincount(place, minlength=n * BUCKETS).reshape(n, BUCKETS) / np.maximum(count, 1)[:, None]
    length = ends - starts
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    last = kind[ends - 1] if len(ends) else np.empty(0, np.int64)
    whole, values, _ = ta.distinct(owner, h, n)
    kinds = np.bincount(whole, minlength=n) / np.maximum(count, 1)
    s_text, s_hash = ta.shingles(data, offsets)
    fresh = np.bincount(ta.distinct(s_text, s_hash, n)[0], minlength=n) / np.maximum(np.bincount(s_text, minlength=n), 1)
    # lines: the share of bytes in lines which are junk for the most part, and the share of lines seen before
    breaks = np.flatnonzero(data == 10) + 1
    line_at = np.unique(np.concatenate([offsets[:-1][size > 0], breaks[breaks < len(data)]])) if len(data) else np.empty(0, np.int64)
    line_size = np.diff(np.append(line_at, len(data)))
    line_text = np.searchsorted(offsets, line_at, side="right") - 1
    junk = np.add.reduceat(JUNK[kind].astype(np.int64), line_at) / np.maximum(line_size, 1) if len(line_at) else np.empty(0)
    bad_lines = np.bincount(line_text, weights=line_size * (junk > 0.2), minlength=n) / np.maximum(size, 1)
    worst = np.zeros(n)
    np.maximum.at(worst, line_text, np.where(line_size > 20, junk, 0))
    columns = [
        shares[:, 1:], np.log1p(1000 * shares[:, 1:]),
        per_word(length)[:, None] / 10, per_word(length > 15)[:, None], per_word(length <= 2)[:, None], per_word(again)[:, None],
        per_word(np.isin(last, (5, 6, 7)))[:, None], kinds[:, None], fresh[:, None], np.sqrt(buckets),
        bad_lines[:, None], worst[:, None], np.log1p(count)[:, None] / 10, (count < 10)[:, None], (size == 0)[:, None],
    ]
    return np.concatenate(columns, axis=1).astype(np.float64)


class Network:
    """One hidden layer; the output is a log-odds."""

    def __init__(self, width: int, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, scale
        self.weights = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
        self.moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        self.steps = 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        hidden = np.tanh(z @ self.weights[0] + self.weights[1])
        return z, hidden, hidden @ self.weights[2] + self.weights[3][0]

    def step(self, z: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> None:
        """One step of Adam; slope: of the risk by each output."""
        inner = slope[:, None] * self.weights[2] * (1 - hidden**2)
        gradients = [z.T @ inner, inner.sum(0), hidden.T @ slope, np.array([slope.sum()])]
        self.steps += 1
        for w, g, (m, v) in zip(self.weights, gradients, self.moments, strict=True):
            g = g + DECAY * w
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss(x: np.ndarray) -> np.ndarray:
    """The logistic loss of a log-odds for the class that it speaks for."""
    return np.logaddexp(0, -x)


def risk_slope(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]), and what descent follows for
    each output (positives first): its gradient, or where the second part is negative, the reverse of that part's."""
    positive, negative = prior * loss(g_p).mean(), loss(-g_u).mean() - prior * loss(-g_p).mean()
    slope = np.concatenate([-prior * sigmoid(g_p) / len(g_p), sigmoid(g_u) / len(g_u)])
    if negative < -SLACK:
        return float(positive), -slope
    slope[: len(g_p)] -= prior * sigmoid(-g_p) / len(g_p)
    return float(positive + max(negative, 0)), slope


def _descend(positive: np.ndarray, unlabelled: np.ndarray, epochs: int, slope_of) -> Network:
    scale = unlabelled.std(0)
    net = Network(positive.shape[1], unlabelled.mean(0), np.where(scale > 1e-9, scale, 1))
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for at in range(0, len(u_order), BATCH):
            u = unlabelled[u_order[at : at + BATCH]]
            p = positive[np.take(p_order, range(at, at + BATCH), mode="wrap")]
            z, hidden, out = net.forward(np.concatenate([p, u]))
            net.step(z, hidden, slope_of(out[: len(p)], out[len(p) :]))
    return net


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
    """Minimises the non-negative unbiased risk."""
    return _descend(positive, unlabelled, EPOCHS, lambda g_p, g_u: risk_slope(g_p, g_u, prior)[1])


def prior_from_scores(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The best bound on the positives' share among the unlabelled, from scores of both.

    Above a score stand q_p of the positives and q_u of the unlabelled; as all positives among the latter count in q_u,
    the share is q_u / q_p at most.  The score is taken where that bound plus its error (with probability 1 - DOUBT, by
    the deviation of empirical shares) is least.
    """
    steps = np.unique(positive)
    q_p = 1 - np.searchsorted(np.sort(positive), steps) / len(positive)
    q_u = 1 - np.searchsorted(np.sort(unlabelled), steps) / len(unlabelled)
    error = sum(np.sqrt(np.log(4 / DOUBT) / (2 * len(x))) for x in (positive, unlabelled))
    return float((q_u / q_p)[np.argmin((q_u + error) / q_p)])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The estimated share of positives among the unlabelled, between 0.01 and 0.99."""
    def plain(g_p: np.ndarray, g_u: np.ndarray) -> np.ndarray:
        return np.concatenate([-sigmoid(-g_p) / len(g_p), sigmoid(g_u) / len(g_u)])

    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    net = _descend(positive[::2], unlabelled[::2], PRIOR_EPOCHS, plain)
    return min(max(prior_from_scores(net.forward(positive[1::2])[2], net.forward(unlabelled[1::2])[2]), 0.01), 0.99)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches):
        for rows, data, offsets in ta.pieces(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "x": pa.array(list(features(data, offsets)), pa.list_(pa.float64()))})

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def _gather(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the FIT_ROWS documents of ``ids`` with the smallest hashes, in the order of doc_id."""
    chosen = ids.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    once = docs.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = _featured(once).collect()  # FIT_ROWS at most
    return np.array([x.x for x in sorted(rows, key=lambda x: x.doc_id)], np.float64)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = labels.where(~held_out(F.col("doc_id"))).where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    positive, net = _gather(docs, trusted), None
    if len(positive):
        unlabelled = _gather(docs, docs.where(~held_out(F.col("doc_id"))).select("doc_id"))
        net = fit(positive, unlabelled, class_prior(positive, unlabelled))

    def run(batches):
        for rows, data, offsets in ta.pieces(batches, "text"):
            made = sigmoid(net.forward(features(data, offsets))[2]) if net else np.full(len(offsets) - 1, 0.5)
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "score": made, "predicted": pa.array((made >= 0.5).astype(np.int32))})

    scored = docs.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: A fitted network has no counterpart in SQL; the tests compare risk, gradient and prior with plain ones, and measure held-out accuracy.
ORACLE_SQL = None
