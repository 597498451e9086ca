r"""Stretches of words that repeat themselves in a text, and the texts without the repeats.

The words ``[^\x20\x09-\x0D]+`` of the texts of about two megabytes are numbered, ended by numbers that stand nowhere
else, and appended to one sequence, whose runs the catchers of ``square_catchers`` report (no run crosses an end).  A run
is at least 12 words and at least twice its smallest period.  A word is dropped if a run holds it after its first period.

Nothing is shuffled: rows stay where they are read, and a task holds the words of two megabytes, or of one longer text,
with some hundred bytes a word.

Defined results: a null or empty text has no words, no runs, and collapses to an empty text; with a null doc_id no words
are made periodic; repeated rows give repeated results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.square_catchers import Catchers
from shelfspark.llm.storage import release, small_batches

#: Words of the shortest run, bytes of text in a sequence, and words that are appended at a time.
LEAST, PIECE_BYTES, STRETCH = 12, 2 << 20, 1 << 18
SPACE = pa.scalar(" ", pa.large_string())


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_id, text) of runs of rows with about ``size`` bytes of text; a longer text is alone."""
    for batch in batches:
        ids, texts = batch.column(0), pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ids):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
            yield ids.slice(start, stop - start), texts.slice(start, stop - start)
            start = stop
            release()


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The texts' words as numbers, the offsets of texts in them, and the word of each number."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    there = pc.not_equal(pc.binary_length(flat.dictionary), 0).to_numpy(zero_copy_only=False)  # edges of texts give empty words
    codes = flat.indices.to_numpy()
    kept = there[codes]
    offsets = np.concatenate([[0], np.cumsum(kept)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return codes[kept].astype(np.int64), offsets, flat.dictionary


def periodic(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """The query's own change: one document in ten goes on periodically from some word."""
    h, n = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def sequence_runs(words: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """text, start, end and period of all runs, in that order; no run crosses from one text to the next."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    sequence = np.empty(len(words) + n, np.int64)
    sequence[np.arange(len(words)) + np.repeat(np.arange(n), sizes)] = words
    sequence[offsets[1:] + np.arange(n)] = (words.max(initial=-1) + 1) + np.arange(n)
    catchers = Catchers(least, int(sizes.max(initial=0)))
    for at in range(0, len(sequence), STRETCH):
        catchers.append(sequence[at : at + STRETCH])
    runs = catchers.runs()
    starts = offsets[:-1] + np.arange(n)
    text = np.searchsorted(starts, runs[:, 0], side="right") - 1
    return np.column_stack([text, runs[:, 0] - starts[text], runs[:, 1] - starts[text], runs[:, 2]])


def collapse(words: np.ndarray, offsets: np.ndarray, names: pa.Array, runs: np.ndarray) -> pa.Array:
    """The texts' words joined by spaces, without those behind the first period of a run."""
    marks = np.zeros(len(words) + 1, np.int64)
    base = offsets[runs[:, 0]]
    np.add.at(marks, base + runs[:, 1] + runs[:, 3], 1)
    np.add.at(marks, base + runs[:, 2], -1)
    kept = np.cumsum(marks[:-1]) == 0
    bounds = np.concatenate([[0], np.cumsum(kept)])[offsets]
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), names.cast(pa.large_string()).take(pa.array(words[kept]))), SPACE)


def _digests(texts: pa.Array) -> list[str]:
    return [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in texts.cast(pa.large_binary())]


def _detect(least: int, change, texts_too: bool):
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for ids, texts in pieces(batches, PIECE_BYTES):
            words, offsets, names = numbered(texts)
            if change:
                doc_ids = ids.to_pylist()
                words = np.concatenate([change(i, words[a:b]) for i, a, b in zip(doc_ids, offsets[:-1], offsets[1:], strict=True)])
            runs = sequence_runs(words, offsets, least)
            n = len(ids)
            told, count = [none] * n, np.bincount(runs[:, 0], minlength=n)
            best: list[tuple | None] = [None] * n
            for own in np.split(runs, np.flatnonzero(np.diff(runs[:, 0])) + 1) if len(runs) else []:
                k, rows = int(own[0, 0]), [(s, e - s, q) for _, s, e, q in own.tolist()]
                told[k] = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in rows).encode()).hexdigest()
                best[k] = min(rows, key=lambda r: (-r[1], r[0], r[2]))
            collapsed = collapse(words, offsets, names, runs)
            column = lambda f: pa.array([None if x is None else f(x) for x in best], pa.int64())
            out = {
                "doc_id": ids, "n_runs": pa.array(count, pa.int64()), "start": column(lambda x: x[0]), "length": column(lambda x: x[1]), "period": column(lambda x: x[2]),
                "exponent_milli": column(lambda x: 1000 * x[1] // x[2]), "runs_sha256": pa.array(told), "collapsed_sha256": pa.array(_digests(collapsed)),
            }
            if texts_too:
                lists = np.concatenate([[0], np.cumsum(count)])
                spans = pa.StructArray.from_arrays([pa.array(runs[:, 1]), pa.array(runs[:, 2] - runs[:, 1]), pa.array(runs[:, 3])], ["start", "length", "period"])
                out |= {"runs": pa.ListArray.from_arrays(pa.array(lists, pa.int32()), spans), "collapsed": collapsed.cast(pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return run


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def detect_runs(docs: DataFrame, least: int = LEAST, change=None, texts: bool = False) -> DataFrame:
    """Of each row its runs' number, the longest run (of ties the first, then the one with the smallest period), and
    digests of all runs and of the collapsed text; with ``texts`` also these themselves: runs (an array of start, length,
    period) and collapsed.  ``change``: a function of doc_id and word numbers to word numbers, applied first."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    more = ", runs array<struct<start:long,length:long,period:long>>, collapsed string" if texts else ""
    return rows.mapInArrow(_detect(least, change, texts), DIGESTS + more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=periodic)


#: Runs have no counterpart in SQL that whole texts allow; the tests compare with all pairs of words.
ORACLE_SQL = None
