r"""Texts scored by a log-bilinear neural model over an open vocabulary, and by word counts.

Tokens are the words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, and one end for each text.

1. Blocks of about eight megabytes of text are split into numbered words, and written.
2. Each block's distinct words, with their counts in training texts, are shuffled by word; the counts of the whole corpus
   go back to the blocks.  A word meets once for each block, however often it stands there.
3. Every token gets a *unit*: its word, if this stands in ``LEAST`` places or more and is one of the ``FREQUENT`` most
   frequent, or, for all others, the class of words with its last letter, in three kinds: known from several places, from
   one, or unknown.  Words beyond the first are numbered by their ends, so that a group of the model has like words.
4. The model learns units from the units before them: in each round every task goes over the training texts of its own
   partition, starting from the last average.  What it changed is shuffled by slices of the model, and averaged row by
   row, each task's change having the weight of the places where that unit stood in its texts (or was drawn as noise).
5. A token's probability is its unit's (normalised over all units) times, for a rare word, its share of its class by
   counts, less a discount estimated from the words that stand once and twice.  While learning, a word of one place counts
   as unknown, so unknown words have the probability that they have in new texts.  Known words and the one event "unknown"
   have probabilities that add up to 1 after every context.

Counts, units and training cover all texts whose crc32(doc_id) modulo 10 is not 0; nothing of the others is learned.
What is shuffled grows with the corpus, as do the groups, whose number follows the bytes of text; a group has about 24
megabytes of text's share of words.  The model has a size of its own, up to some 20 megabytes.  The scores depend a little on how rows are
partitioned (averages), the counts and the base score do not.

Defined results: a null or empty text has one token, its end; a null doc_id counts as training text; rows that repeat count
and are scored as often as they stand; an empty table gives an empty result; where nothing may be learned every token is
unknown, with probability 1, and train_tokens is 0; further columns are ignored.
"""

from __future__ import annotations

import copy
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.log_bilinear import HEAD, LogBilinear, contexts_of
from shelfspark.llm.periodic_runs import numbered, pieces
from shelfspark.llm.storage import cut, release, small_batches

#: Bytes of text in a block and a group; words that are units, and the places where they stand at least; classes of other
#: words; rounds of training, and their rates; slices in which models are averaged; tokens that are learned or scored at a time.
BLOCK_BYTES, GROUP_BYTES = 8 << 20, 24 << 20
FREQUENT, LEAST, CLASSES = 1 << 15, 3, 32
ROUNDS = (0.2, 0.1)
SLICES, TOKENS = 1024, 1 << 18
#: The end of a text as a word, which no word is.
END = "\n"
SPACE = pa.scalar(b" ", pa.large_binary())


def _pack(data: bytes | np.ndarray) -> bytes:
    return zstandard.compress(data if isinstance(data, bytes) else data.tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(b"%d" % doc_id) % 10 == 0


def word_class(words: list[bytes]) -> np.ndarray:
    """By the last byte: a letter, a digit, one of four signs, another, or a part of a longer character."""
    last = np.array([w[-1] for w in words], np.uint8) if words else np.empty(0, np.uint8)
    of = np.full(256, 30, np.int64)
    of[ord("a") : ord("z") + 1] = np.arange(26)
    for k, signs in enumerate((b"0123456789", b",", b".", b";:!?")):
        of[list(signs)] = 26 + k
    of[128:] = 31
    return of[last]


def _blocks(groups: int):
    """A block's rows, the numbers of their tokens, and its distinct words by group, in the order of their numbers."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(pieces(batches, BLOCK_BYTES)):
            codes, offsets, names = numbered(pc.ascii_lower(texts))
            n = len(ids)
            names = pa.concat_arrays([names.cast(pa.large_binary()), pa.array([END.encode()], pa.large_binary())])
            sizes = np.diff(offsets) + 1  # with the ends
            offsets = offsets + np.arange(n + 1)
            tokens, inside = np.full(len(codes) + n, len(names) - 1), np.ones(len(codes) + n, bool)
            inside[offsets[1:] - 1] = False
            tokens[inside] = codes
            there = np.bincount(tokens, minlength=len(names))
            counts = there - np.bincount(tokens[np.repeat([held_out(i) for i in ids.to_pylist()], sizes)], minlength=len(names))
            group = np.fromiter(map(zlib.crc32, names.to_pylist()), np.int64, len(names)) % groups
            order = np.argsort((group << 32) - there, kind="stable")
            order = order[there[order] > 0]  # without the empty words at the edges of texts
            number = np.empty(len(names), "<u4")
            number[order] = np.arange(len(order))
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), names.take(pa.array(order))), SPACE)
            own = [(g, a, b) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            planes = np.ascontiguousarray(number[tokens].view(np.uint8).reshape(-1, 4).T)
            words = [{"group": g, "words": _pack(joined[g].as_py()), "counts": _pack(counts[order[a:b]].astype("<u4"))} for g, a, b in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{k}"]), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([_pack(offsets.astype("<i8"))], pa.binary()), pa.array([_pack(planes)], pa.binary()), pa.array([words], WORDS)],
                ["block", "doc_ids", "offsets", "numbers", "words"],
            )

    return run


WORDS = pa.list_(pa.struct([("group", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))
BLOCKS = "block string, doc_ids array<long>, offsets binary, numbers binary, words array<struct<group:int,words:binary,counts:binary>>"
#: Of a group: tokens, words, words of one place and of two, of each class tokens and words; the most frequent words.
COUNTED = "block string, group int, counts binary, codes binary, sums array<long>, top array<struct<word:binary,count:long>>"


def _count(table: pa.Table) -> pa.Table:
    """The corpus counts and classes of a group's words for each block, and one more row with what the group sums up to."""
    lists = pc.split_pattern(pa.array([zstandard.decompress(x) for x in table["words"].to_pylist()], pa.large_binary()), b" ")
    flat = lists.flatten().dictionary_encode()
    own = np.concatenate([_unpack(x, "<u4") for x in table["counts"].to_pylist()]).astype(np.float64)
    codes, words = flat.indices.to_numpy(), flat.dictionary.to_pylist()
    total = np.bincount(codes, own, len(words)).astype(np.int64)
    kind = word_class(words)
    known = total > 0
    sums = [total.sum(), known.sum(), (total == 1).sum(), (total == 2).sum(), *np.bincount(kind[known], total[known], CLASSES).astype(np.int64), *np.bincount(kind[known], minlength=CLASSES)]
    order = sorted(np.flatnonzero(total >= LEAST).tolist(), key=lambda i: (-total[i], words[i]))[:FREQUENT]
    ends = lists.offsets.to_numpy()
    spans = list(zip(ends[:-1], ends[1:], strict=True))
    n, group = len(lists), table["group"][0].as_py()
    release()
    return pa.table(
        {
            "block": pa.array([*table["block"].to_pylist(), None]), "group": pa.array([group] * (n + 1), pa.int32()),
            "counts": pa.array([*(_pack(total[codes[a:b]].astype("<i8")) for a, b in spans), None], pa.binary()),
            "codes": pa.array([*(_pack(kind[codes[a:b]].astype("u1")) for a, b in spans), None], pa.binary()),
            "sums": pa.array([*[None] * n, [int(x) for x in sums]], pa.list_(pa.int64())),
            "top": pa.array([*[None] * n, [{"word": words[i], "count": int(total[i])} for i in order]], pa.list_(pa.struct([("word", pa.binary()), ("count", pa.int64())]))),
        }
    )


class Vocabulary:
    """What the counts of the whole corpus say: tokens, words, the frequent words, and the shares of rare words.

    Units of tokens: frequent words; then of each class the words known from several places, from one, and unknown ones.
    Inputs of the model: frequent words, known and unknown words of each class, and the start of a text.
    Outputs: frequent words, known words of each class, and the one event of an unknown word.
    """

    def __init__(self, sums: np.ndarray, top: list[tuple[bytes, int]]):
        self.tokens, self.words, once, twice = (int(x) for x in sums[:4])
        top = top[:HEAD] + sorted(top[HEAD:], key=lambda x: x[0][::-1])
        self.k = len(top)
        self.unit = {w: i for i, (w, _) in enumerate(top)}
        self.discount = once / (once + 2 * twice) if once else 0.5
        self.discount = min(0.9, max(0.1, self.discount))
        rest, words = sums[4 : 4 + CLASSES].astype(np.float64), sums[4 + CLASSES :].astype(np.float64)
        kinds = word_class([w for w, _ in top])
        self.rest = rest - np.bincount(kinds, [c for _, c in top], CLASSES)
        self.rest_words = words - np.bincount(kinds, minlength=CLASSES)
        self.mass = self.rest - self.discount * self.rest_words
        self.inputs, self.outputs = self.k + 2 * CLASSES + 1, self.k + CLASSES + 1
        self.possible = np.concatenate([np.ones(self.k, bool), self.rest_words > 0, [True]])
        # what stands in training texts while a word of one place counts as unknown
        several = np.maximum(self.rest - once * self.rest_words / max(1.0, self.rest_words.sum()), 0)
        weight = np.where(self.possible, np.concatenate([[c for _, c in top], several, [once]]) + 0.5, 0.0)
        self.noise = weight / weight.sum()

    def small(self) -> Vocabulary:
        """What learning and scoring need: without the words."""
        made = copy.copy(self)
        made.unit = {}
        return made

    def inputs_of(self, units: np.ndarray, learning: bool) -> np.ndarray:
        one = (units >= self.k + CLASSES) & (units < self.k + 2 * CLASSES)
        unknown = units >= self.k + 2 * CLASSES
        return units - CLASSES * np.where(learning, unknown, one | unknown)

    def outputs_of(self, units: np.ndarray, learning: bool) -> np.ndarray:
        unknown = units >= self.k + (1 if learning else 2) * CLASSES
        known = np.where(units >= self.k + CLASSES, units - CLASSES, units)
        return np.where(unknown, self.k + CLASSES, known)


def _encode(shared):
    """Each row's token numbers, its base score, what its rare words' shares come to, and its units."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        release()
        v = shared.value
        row = docs.to_pylist()[0]
        words = words.sort_by("group")
        counts = np.concatenate([_unpack(x, "<i8") for x in words["counts"].to_pylist()])
        kinds = np.concatenate([_unpack(x, "u1") for x in words["codes"].to_pylist()]).astype(np.int64)
        unit = v.k + kinds + CLASSES * ((counts < 2).astype(np.int64) + (counts < 1))
        at = 0
        names = (x["words"] for x in sorted(row["words"], key=lambda x: x["group"]))
        for packed in names:
            own = zstandard.decompress(packed).split(b" ")
            for i, w in enumerate(own):
                if w in v.unit:
                    unit[at + i] = v.unit[w]
            at += len(own)
        if at != len(counts):
            raise ValueError("a block's words and counts are not as many")
        base = np.log10((counts + 0.1) / (v.tokens + 0.1 * (v.words + 1)))
        rare = (unit >= v.k) & (counts > 0)
        share = np.zeros(len(counts))
        share[rare] = np.log10((counts[rare] - v.discount) / v.mass[kinds[rare]])
        offsets = _unpack(row["offsets"], "<i8")
        numbers = np.ascontiguousarray(_unpack(row["numbers"], "u1").reshape(4, -1).T).view("<u4").ravel()
        start = offsets[:-1]
        units = unit.astype("<u2")[numbers].tobytes()
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array([held_out(i) for i in row["doc_ids"]]),
                "n_tokens": pa.array(np.diff(offsets)), "n_known": pa.array(np.add.reduceat((counts > 0)[numbers].astype(np.int64), start)),
                "base_score": np.add.reduceat(base[numbers], start), "share": np.add.reduceat(share[numbers], start),
                "units": pa.array([units[2 * a : 2 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
            }
        )

    return run


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, share double, units binary"


def _stretches(batches, learning: bool, v: Vocabulary):
    """(rows, contexts, outputs, offsets) of runs of whole texts with about TOKENS tokens; a longer text is alone."""
    for batch in batches:
        sizes = pc.binary_length(batch["units"]).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TOKENS, side="right")))
            units = np.frombuffer(b"".join(batch["units"].slice(start, stop - start).to_pylist()), "<u2").astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes[start:stop])])
            yield batch.slice(start, stop - start), contexts_of(v.inputs_of(units, learning), offsets, v.inputs), v.outputs_of(units, learning), offsets
            start = stop
        release()


def _by_rows(model: LogBilinear) -> np.ndarray:
    """The parameters, a row for each unit in each place; the last number of a row is its bias, if there is one."""
    return np.concatenate([np.pad(model.vectors, ((0, 0), (0, 1))), np.column_stack([model.targets, model.bias])])


def _slices(rows: int) -> list[slice]:
    ends = np.linspace(0, rows, min(rows, SLICES) + 1).astype(np.int64).tolist()
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _learn(shared, rate: float, seed: int):
    """What a task's texts change in each slice of the model, and the weights of its rows."""

    def run(batches):
        v, parameters = shared.value
        model, rng, tokens = LogBilinear(v.inputs, v.outputs, parameters), np.random.default_rng([seed, TaskContext.get().partitionId()]), 0
        stood, said = np.zeros(len(model.vectors)), np.zeros(v.outputs)
        for _, contexts, outputs, _ in _stretches(batches, True, v):
            order = rng.permutation(len(outputs))
            model.learn(contexts.take(order, 1), outputs.take(order), v.noise, rng, rate)
            stood += np.bincount(contexts.ravel(), minlength=len(stood))
            said += np.bincount(outputs, minlength=v.outputs)
            tokens += len(outputs)
        if tokens:
            said += v.noise * tokens
            weights = np.concatenate([stood, said, np.bincount(model.choice, said, len(model.first))[len(model.first) - model.groups :]]).astype("<f4")
            change = (_by_rows(model) - _by_rows(LogBilinear(v.inputs, v.outputs, parameters))).astype("<f2")
            slices = _slices(len(change))
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(len(slices)), pa.int32()), "weights": [weights[x].tobytes() for x in slices], "change": [change[x].tobytes() for x in slices]})
        del model
        release()

    return run


def _merge(table: pa.Table) -> pa.Table:
    total = weight = 0.0
    for w, change in zip(table["weights"], table["change"], strict=True):
        w = np.frombuffer(w.as_buffer(), "<f4").astype(np.float64)
        total = total + w[:, None] * np.frombuffer(change.as_buffer(), "<f2").reshape(len(w), -1)
        weight = weight + w
    return pa.table({"slice": table["slice"][:1], "change": pa.array([(total / np.maximum(weight, 1e-9)[:, None]).astype("<f4").tobytes()], pa.binary())})


def train(encoded: DataFrame, v: Vocabulary) -> np.ndarray:
    """The parameters after all rounds; one model reaches the driver in each."""
    model = LogBilinear(v.inputs, v.outputs)
    noise = np.maximum(v.noise, 1e-12)
    model.bias[:] = np.log(np.concatenate([noise, np.bincount(model.choice, noise, len(model.first))[len(model.first) - model.groups :]]))
    rows = encoded.where(~F.col("held_out")).select("units")
    slices = _slices(len(model.vectors) + len(model.targets))
    for turn, rate in enumerate(ROUNDS):
        shared = encoded.sparkSession.sparkContext.broadcast((v.small(), model.parameters))
        changes = rows.mapInArrow(_learn(shared, rate, turn), "slice int, weights binary, change binary")
        merged = changes.groupBy("slice").applyInArrow(_merge, "slice int, change binary").toArrow()
        for k, change in zip(merged["slice"].to_pylist(), merged["change"], strict=True):
            change = np.frombuffer(change.as_buffer(), "<f4").reshape(slices[k].stop - slices[k].start, -1)
            at = np.arange(slices[k].start, slices[k].stop)
            vectors = at < len(model.vectors)
            model.vectors[at[vectors]] += change[vectors, :-1]
            model.targets[at[~vectors] - len(model.vectors)] += change[~vectors, :-1]
            model.bias[at[~vectors] - len(model.vectors)] += change[~vectors, -1]
    return model.parameters


def _score(shared):
    def run(batches):
        v, parameters = shared.value
        model = LogBilinear(v.inputs, v.outputs, parameters)
        for rows, contexts, outputs, offsets in _stretches(batches, False, v):
            said = np.add.reduceat(model.log10(contexts, outputs, v.possible), offsets[:-1])
            columns = {c: rows[c] for c in ("doc_id", "held_out", "n_tokens", "n_known")}
            yield pa.RecordBatch.from_pydict(columns | {"train_tokens": pa.array([v.tokens] * len(said), pa.int64()), "base_score": rows["base_score"], "score": pa.array(said + rows["share"].to_numpy())})

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def encode(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Rows with counts, base score and units, and the vocabulary of the training texts."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = cut(docs.mapInArrow(_blocks(max(8, -(-size // GROUP_BYTES))), BLOCKS))
    words = blocks.select("block", F.explode("words").alias("w")).select("block", "w.*")
    counted = cut(words.groupBy("group").applyInArrow(_count, COUNTED))
    sums = counted.where("block IS NULL")
    places = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(4 + 2 * CLASSES)]
    total = np.array([x or 0 for x in sums.agg(*places).first()], np.int64)
    top = sums.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("count"), "word").limit(FREQUENT).toArrow()
    v = Vocabulary(total, list(zip(top["word"].to_pylist(), top["count"].to_pylist(), strict=True)))
    counts = counted.where("block IS NOT NULL").select("block", "group", "counts", "codes")
    return cut(blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_encode(docs.sparkSession.sparkContext.broadcast(v)), ENCODED)), v


def score_texts(docs: DataFrame) -> DataFrame:
    encoded, v = encode(docs)
    shared = docs.sparkSession.sparkContext.broadcast((v.small(), train(encoded, v)))
    return encoded.mapInArrow(_score(shared), SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: A trained model has no counterpart in SQL; the tests compare counts and base scores with plain code, add up the
#: probabilities after a context, and hold the scores of held-out texts against the base.
ORACLE_SQL = None
