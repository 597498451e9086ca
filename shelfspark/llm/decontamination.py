"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces; a passage within k edits of the item holds one
of them unchanged.  An automaton of all pieces (Aho-Corasick) finds the exact piece hits of each text in one scan; the
window around a hit is then verified with Myers' bit-parallel distance.  Items and texts are compared in lower case
with white space as one space.

Items are a stated query set: they are sent to the tasks in blocks of at most BLOCK_CHARS characters on average, one
scan of the documents for each block, so no list of items has to fit anywhere whole.  Documents are not shuffled.

Defined results: a null or empty item matches nothing; an item shorter than 1 / ERROR_RATE characters has no budget
and matches exactly; a null text has no matches; repeated items and rows give repeated results; empty tables give no
rows; further columns are ignored (``clean_rows`` keeps all columns as they are).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.storage import small_batches

#: Edits allowed for each character of an item.
ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return int(len(item) * ERROR_RATE)


def cut_pieces(item: str, k: int) -> Iterator[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    bounds = [len(item) * j // (k + 1) for j in range(k + 2)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield a, item[a:b]


class Pattern:
    """An item's bit masks for Myers' search: one bit for each character, in one Python integer."""

    def __init__(self, item: str):
        self.text, self.k, self.size = item, budget(item), len(item)
        self.all, self.top = (1 << self.size) - 1, 1 << (self.size - 1)
        self.masks: dict[str, int] = {}
        for j, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << j

    def nearest(self, window: str) -> tuple[int, int]:
        """The smallest distance of the item to a substring of ``window``, and the first place where such a one ends."""
        at = window.find(self.text)
        if at >= 0:
            return 0, at + self.size
        up, down, score, best, end = self.all, 0, self.size, self.size, 0
        masks, full, top = self.masks, self.all, self.top
        for j, c in enumerate(window):
            x = masks.get(c, 0) | down
            diagonal = (((x & up) + up) ^ up) | x
            less = up & diagonal
            more = down | ~(up | diagonal)
            if more & top:
                score += 1
            elif less & top:
                score -= 1
                if score < best:
                    best, end = score, j + 1
            more <<= 1
            down = more & diagonal & full
            up = ((less << 1) | ~(more | diagonal)) & full
        return best, end


class Matcher:
    """The automaton of a block of items; one for each task."""

    def __init__(self, items: list[tuple[int | None, str]]):
        import ahocorasick

        self.ids = [i for i, _ in items]
        self.patterns = [Pattern(x) for _, x in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            for at, piece in cut_pieces(p.text, p.k):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.some = bool(places)

    def matches(self, text: str) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end) of each item within its budget, at its nearest place in the normalised text."""
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, set[int]] = {}
        if not self.some or not text:
            return []
        for last, (size, found) in self.automaton.iter(text):
            for n, at in found:
                p = self.patterns[n]
                diagonal = last + 1 - size - at
                # a window covers the places of a whole cell of diagonals, so each cell is verified once
                cell = diagonal // (p.k + 1)
                if cell in tried.setdefault(n, set()) or best.get(n, (1,))[0] == 0:
                    continue
                tried[n].add(cell)
                low = max(0, cell * (p.k + 1) - p.k)
                d, end = p.nearest(text[low : (cell + 1) * (p.k + 1) + p.size + p.k])
                if d <= p.k and (d, low + end) < best.get(n, (p.k + 1, 0)):
                    best[n] = d, low + end
        return [(self.ids[n], d, end) for n, (d, end) in sorted(best.items())]


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Blocks of (item_id, normalised text), each of a bounded size on average."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield sorted(((x.item_id, t) for x in block if (t := normal(x.text))), key=str)


def find_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance and end (code points of the normalised text) of every document and item that match."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance int, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items):

        def scan(batches, block=block):
            matcher = Matcher(block)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matcher.matches(normal(t))]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "end"])

        out = out.unionByName(docs.mapInArrow(scan, schema))
    return out


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    small_batches(docs.sparkSession)
    for block in item_blocks(items):

        def scan(batches, block=block):
            matcher = Matcher(block)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(normal(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Edit distances of all windows are too slow in SQL; the tests compare with brute force.
ORACLE_SQL = None
