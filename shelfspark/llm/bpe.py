"""BPE encoding and decoding through a distinct-word table.

1. Texts are split at ASCII white space in blocks of bounded size (Arrow kernels).  No rule of the tokenizer file
   reaches across white space, so a text's ids are its words' ids one after the other.
2. The distinct words of every block are shuffled by word, each distinct word is encoded once by the tokenizers
   library (which applies the file's normalizer, special tokens and pattern to it), and the ids go back to the blocks.
3. Each block joins ids to its texts by position.  Decoding joins each id to its piece in the vocabulary (a table of
   fixed size), and joins the pieces by one space, as the library's decode does for a file without a decoder.

What moves, compressed, is each block's distinct words and their ids, and the numbers of the words of its texts (the
most frequent words of a block have the smallest numbers); texts themselves are not shuffled.
The two passes over the input must see the same blocks, so the input must be a table that is read (``storage.cut``
makes one of any other DataFrame); a block's key has a checksum of its rows, and a mismatch fails the job.

Defined results: a null text is empty, an empty text has no tokens and decodes to an empty text; repeated rows give
repeated results, also with a null doc_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.storage import release, small_batches

#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Words that are handed to the library at a time, which bounds what its results take.
ENCODED_AT_ONCE = 5_000
SPACE = pa.scalar(" ", pa.large_string())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, pa.Array]]:
    """(key, doc_id, text) of runs of rows with about BLOCK_BYTES; a longer text is a block of its own."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, texts = batch.column(0), pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ids):
            below = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, below + BLOCK_BYTES, side="right")))
            own = texts.slice(start, stop - start)
            offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
            mark = zlib.crc32(memoryview(own.buffers()[2] or b"")[offsets[0] : offsets[-1]])
            yield f"{part}-{number}-{mark}", ids.slice(start, stop - start), own
            start, number = stop, number + 1
            release()


def _pack(data: bytes | np.ndarray) -> bytes:
    return zstandard.compress(data if isinstance(data, bytes) else data.tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _split(texts: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """The numbers of the texts' words, the offsets of texts in them, the distinct words by number, and their parts."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    at, words = flat.indices.to_numpy(), flat.dictionary
    order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
    number = np.empty(len(words), np.uint32)
    number[order] = np.arange(len(words), dtype=np.uint32)
    words = words.take(pa.array(order))
    part = np.fromiter((zlib.crc32(w) % parts for w in words.cast(pa.large_binary()).to_pylist()), np.uint16, len(words))
    return number[at], offsets, words, part


def _words(parts: int):
    """A block's distinct words by part, in the order of their numbers, separated by spaces."""

    def run(batches):
        for key, _, texts in _blocks(batches):
            _, _, words, part = _split(texts, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            packed = [_pack(" ".join(words.take(pa.array(o)).to_pylist()).encode()) for _, o in rows]
            yield pa.RecordBatch.from_pydict(
                {"block": [key] * len(rows), "part": pa.array([k for k, _ in rows], pa.int32()), "words": pa.array(packed, pa.binary())}
            )

    return run


def _sequences(parts: int):
    """A block's rows and their words' numbers, as planes of bytes."""

    def run(batches):
        for key, ids, texts in _blocks(batches):
            numbers, offsets, _, part = _split(texts, parts)
            planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": [key],
                    "doc_ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                    "offsets": pa.array([_pack(offsets.astype("<i8"))], pa.binary()),
                    "numbers": pa.array([_pack(planes)], pa.binary()),
                    "parts": pa.array([_pack(part.astype("<u2"))], pa.binary()),
                }
            )

    return run


@lru_cache(1)
def _tokenizer(path: str):
    """One for each worker, without threads of its own: Spark's tasks are the parallelism, and threads hold memory."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _encode(path: str):
    """Each distinct word of a part once; then the ids of every block's words, as lengths and 16-bit ids."""

    def run(table: pa.Table) -> pa.Table:
        lists = pa.array([zstandard.decompress(x).decode().split(" ") for x in table["words"].to_pylist()], pa.list_(pa.string()))
        flat = lists.flatten().dictionary_encode()
        tokenizer, distinct, ids = _tokenizer(path), flat.dictionary, []
        for at in range(0, len(distinct), ENCODED_AT_ONCE):
            made = tokenizer.encode_batch(distinct.slice(at, ENCODED_AT_ONCE).to_pylist(), add_special_tokens=False)
            ids += [np.array(x.ids, "<u2").tobytes() for x in made]
        lengths = np.array([len(x) // 2 for x in ids], "<u4")
        packed = np.array(ids, object)
        release()
        at, offsets = flat.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        spans = list(zip(offsets[:-1], offsets[1:], strict=True))
        return pa.table(
            {
                "block": table["block"],
                "part": table["part"],
                "lengths": pa.array([_pack(lengths[at[a:b]]) for a, b in spans], pa.binary()),
                "ids": pa.array([_pack(b"".join(packed[at[a:b]])) for a, b in spans], pa.binary()),
            }
        )

    return run


@lru_cache(1)
def _vocabulary(path: str) -> pa.Array:
    """Piece by id."""
    known = _tokenizer(path).get_vocab(with_added_tokens=True)
    pieces: list[str | None] = [None] * (max(known.values()) + 1)
    for piece, k in known.items():
        pieces[k] = piece
    return pa.array(pieces, pa.large_string())


def _assemble(path: str, texts: bool):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        release()
        if docs.num_rows != 1:
            raise ValueError("the input changed between two reads of it")
        row = docs.to_pylist()[0]
        part, offsets = _unpack(row["parts"], "<u2"), _unpack(row["offsets"], "<i8")
        planes = _unpack(row["numbers"], "u1").reshape(4, -1)
        numbers = np.ascontiguousarray(planes.T).view("<u4").ravel()
        words = words.sort_by("part")
        lengths = np.concatenate([np.empty(0, "<u4"), *(_unpack(x, "<u4") for x in words["lengths"].to_pylist())]).astype(np.int64)
        ids = np.concatenate([np.empty(0, "<u2"), *(_unpack(x, "<u2") for x in words["ids"].to_pylist())])
        if len(lengths) != len(part):
            raise ValueError("the input changed between two reads of it")
        # the ids stand by part; a word's place among them
        place = np.empty(len(part), np.int64)
        place[np.argsort(part, kind="stable")] = np.arange(len(part))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        wide = pa.py_buffer(ids.astype("<u4").tobytes())
        word_ids = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer((4 * ends).astype(np.int64).tobytes()), wide])
        pieces = pa.LargeListArray.from_arrays(pa.array(ends), _vocabulary(path).take(pa.array(ids.astype(np.int64))))
        word_texts = pc.binary_join(pieces, SPACE)

        numbers = place[numbers]
        there = lengths[numbers] > 0
        bounds = pa.array(np.concatenate([[0], np.cumsum(there)])[offsets])
        at = pa.array(numbers[there])
        doc_ids = pc.binary_join(pa.LargeListArray.from_arrays(bounds, word_ids.take(at)), pa.scalar(b"", pa.large_binary()))
        decoded = pc.binary_join(pa.LargeListArray.from_arrays(bounds, word_texts.take(at)), SPACE).cast(pa.large_binary())
        out = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": pc.cast(pc.divide(pc.binary_length(doc_ids), 4), pa.int64())}
        if texts:
            return pa.table(out | {"ids": doc_ids.cast(pa.binary()), "decoded": decoded.cast(pa.string())})
        return pa.table(
            out
            | {
                "ids_sha256": [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in doc_ids],
                "decoded_sha256": [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in decoded],
            }
        )

    return run


def encode_decode(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and the decoded text; or, with ``texts``, themselves:
    ids (little-endian unsigned 32-bit integers) and decoded."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = 2 * max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = docs.mapInArrow(_words(parts), "block string, part int, words binary")
    ids = words.groupBy("part").applyInArrow(_encode(path), "block string, part int, lengths binary, ids binary")
    sequences = docs.mapInArrow(_sequences(parts), "block string, doc_ids array<long>, offsets binary, numbers binary, parts binary")
    result = "ids binary, decoded string" if texts else "ids_sha256 string, decoded_sha256 string"
    return (
        sequences.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_assemble(path, texts), f"doc_id long, n_tokens long, {result}")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


#: A tokenizer's merges have no counterpart in SQL; the tests compare with the library itself.
ORACLE_SQL = None
