"""Token counts by a linear longest-match automaton.

Greedy longest-match-first word pieces (each word starts with the mark of the vocabulary's word starts) are counted,
not built.  The vocabulary is a trie whose nodes carry a failure link and the number of pieces that are complete when
it is taken; a word is then read once from left to right.  A character that the vocabulary lacks counts as one token
for each of its UTF-8 bytes, as in a vocabulary with byte fallback.

Words are separated by white space.  Each block of rows counts each of its distinct words once; documents are not
shuffled.  Defined results: a null or empty text has no words and no tokens; repeated rows give repeated results; empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.storage import small_batches

MARK = "▁"


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)
    return [model.id_to_piece(k) for k in range(model.get_piece_size()) if not special(k)]


def count_greedily(word: str, pieces: set[str]) -> int:
    """The plain definition: the longest piece at each place, bytes where there is none."""
    at, n = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        n += 1 if end else len(word[at].encode())
        at = end or at + 1
    return n


class Automaton:
    """Nodes are numbers; 0 is the root. failure is -1 where no prefix of what was read can be completed."""

    def __init__(self, pieces: list[str]):
        self.pieces = set(pieces)
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = self.next[node][c]
            ends[node] = True
        self.failure, self.popped = [-1] * len(self.next), [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    if ends[v]:
                        self.failure[v], self.popped[v] = 0, 1
                    else:
                        z, n = self.failure[u], self.popped[u]
                        while z >= 0 and c not in self.next[z]:
                            n += self.popped[z]
                            z = self.failure[z]
                        if z >= 0:
                            self.failure[v], self.popped[v] = self.next[z][c], n
                    below.append(v)
            level = below

    def count(self, word: str) -> int:
        """Pieces of ``word``, in one pass."""
        step, failure, popped = self.next, self.failure, self.popped
        node, n = 0, 0
        for c in word:
            while c not in step[node]:
                if node == 0:
                    break
                if failure[node] < 0:
                    return count_greedily(word, self.pieces)
                n += popped[node]
                node = failure[node]
            if c in step[node]:
                node = step[node][c]
            else:
                n += len(c.encode())
        while node:
            if failure[node] < 0:
                return count_greedily(word, self.pieces)
            n += popped[node]
            node = failure[node]
        return n


_built: dict[int, Automaton] = {}


def _automaton(pieces: list[str]) -> Automaton:
    """The last one built in this worker, if the pieces are the same."""
    key = hash(tuple(pieces))
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(pieces)
    return _built[key]


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """doc_id, n_words and n_tokens of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary: of fixed size

    def run(batches):
        automaton = _automaton(shared.value)
        for batch in batches:
            lists = pc.ascii_split_whitespace(pc.fill_null(batch.column(1).cast(pa.large_string()), ""))
            flat = lists.flatten().dictionary_encode()
            each = np.fromiter((automaton.count(MARK + w) if w else 0 for w in flat.dictionary.to_pylist()), np.int64, len(flat.dictionary))
            at = flat.indices.to_numpy()
            real = pc.not_equal(flat.dictionary, "").to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = lambda x: np.concatenate([[0], np.cumsum(x[at])])[offsets]  # noqa: B023, E731
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": np.diff(sums(real.astype(np.int64))), "n_tokens": np.diff(sums(each))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


#: Greedy matching has no counterpart in SQL; the tests compare with the plain definition.
ORACLE_SQL = None
