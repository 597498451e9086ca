"""Removal of long repeated substrings, by suffix arrays over shards of candidate text.

A byte goes when a LENGTH-byte string that covers it starts anywhere else in the table too.  Suffix arrays are built
where such strings can be, and equal strings always meet in one shard:

1. The anchor of a LENGTH-byte string is its ANCHOR-byte substring with the smallest hash, so equal strings have equal
   anchors.  Neighbouring strings with the same anchor make a segment of text.  Places are aggregated by anchor first:
   an anchor with one place rules its segment out, and where all places of an anchor have one and the same segment
   the copies are whole and need no sorting.  Anchors with several segments become a bitmap whose size follows them up
   to a bound (false hits cost time only).
2. The segments of these anchors go to shards by anchor, each distinct segment of a block of rows once.  A shard's
   segments are made distinct, joined with separators, and their suffixes sorted by induced sorting
   (``suffix_array``); the permuted common prefixes say which strings stand elsewhere too.
3. The verdicts return to all places of a segment by a join, and the spans to their documents by another.  Places whose
   segment has no verdict stay out of the join by a bitmap of the verdicts' keys, sized alike.

An anchor with very many different segments (the edges of a passage that a large share of documents holds) would
gather in one shard; its strings are sent one by one and spread by their own hashes (exact as well, and dearer, as each
byte is then sent LENGTH times).  Anchors only choose places, so their collisions cost time.  Segments and single
strings are matched by 64-bit hashes whose collisions are as rare for patterned texts as for others (``text_arrays``);
the suffix arrays compare the bytes themselves.

Slices of the anchors and shards of the segments are as many as the bytes of text call for, so the largest group stays
the same size as the table grows.  The bitmaps grow with what they hold up to 128 MB each (a bound for driver and
broadcast); beyond that they fill up and rule out less, which costs shuffle and time and no results.

Defined results: a null text is empty; texts under LENGTH bytes keep all; repeated rows are places like any other, so
rows with one text of LENGTH bytes or more lose all of it; a null doc_id is kept as such; empty tables give no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm import text_arrays as ta
from shelfspark.llm.bitmaps import bitmap, has, joined, size_for
from shelfspark.llm.storage import cut, release, small_batches
from shelfspark.llm.suffix_array import common_prefixes, suffix_array

LENGTH, ANCHOR = 200, 100
#: Bits of the bitmaps for each anchor with several segments (a false hit has a segment sorted), and for each verdict.
SEVERAL_BITS, KEY_BITS = 24, 8
#: Fixed value: bits of one bitmap that Spark's bitmap_construct_agg makes.
PAGE_BITS = 1 << 15
#: An anchor is crowded with so many different segments, and so many in a block on average.
CROWDED, CROWDED_IN_BLOCK = 4096, 4
#: Bytes of text in a block of rows, and those that are hashed at a time.
BLOCK_BYTES, SCAN_BYTES = 8 << 20, 1 << 18
#: Bytes of text for each slice of the anchors and each shard of the segments.
SLICE_TEXT, SHARD_TEXT = 32 << 20, 4 << 20
U64 = ta.U64


def _runs(data: np.ndarray, offsets: np.ndarray):
    """(first, last, anchor hash, segment hash) of the runs of string starts that have one anchor, by pieces of a bounded size."""
    for base in range(0, max(0, len(data) - LENGTH + 1), SCAN_BYTES):
        part = data[base : base + SCAN_BYTES + LENGTH - 1]
        n, width = len(part) - ANCHOR + 1, LENGTH - ANCHOR + 1
        grams = ta.window_hashes(part, ANCHOR)
        low = U64((1 << int(n).bit_length()) - 1)
        keys = (grams & ~low) | np.arange(n, dtype=U64)  # the leftmost of equal hashes
        padded = np.full(-(-n // width) * width, ~U64(0))
        padded[:n] = keys
        blocks = padded.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - width + 1
        anchor = (np.minimum(after[:starts], before[width - 1 : width - 1 + starts]) & low).astype(np.int64)
        own = np.searchsorted(offsets, base + np.arange(starts), side="right")
        inside = base + np.arange(starts) + LENGTH <= offsets[np.minimum(own, len(offsets) - 1)]
        begins = inside.copy()
        begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        yield base + first, base + last, grams[anchor[first]], ta.range_hashes(part, first, last + LENGTH)


def _all_runs(data: np.ndarray, offsets: np.ndarray):
    made = list(_runs(data, offsets))
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64), np.empty(0, U64))
    return tuple(np.concatenate(x) for x in zip(none, *made, strict=True))


def _count_anchors(slices: int):
    """Each block's distinct (anchor, segment), and whether they stand there twice, by slice of the anchors' range.

    Anchors are sorted and given as differences of the 32 bits behind the slice, low bytes first, which packs well; two
    anchors that agree in all of these bits are taken for one with several segments, which is on the safe side.
    """
    shift = U64(32 - (slices.bit_length() - 1))

    def run(batches):
        for _, data, offsets in ta.pieces(batches, "text", BLOCK_BYTES):
            _, _, anchors, segments = _all_runs(data, offsets)
            order = np.lexsort((segments, anchors))
            anchors, segments = anchors[order], segments[order]
            new = np.ones(len(anchors), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (segments[1:] != segments[:-1])
            first = np.flatnonzero(new)
            twice = (np.diff(np.append(first, len(anchors))) > 1).astype(np.uint8)
            anchors, segments = anchors[first], segments[first]
            edges = np.arange(1, slices, dtype=U64) << U64(64 - (slices.bit_length() - 1))
            cuts = np.concatenate([[0], np.searchsorted(anchors, edges), [len(anchors)]])
            short = (anchors >> shift).astype(np.uint32)
            rows = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            planes = [np.diff(short[o], prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for _, o in rows]
            yield pa.RecordBatch.from_pydict(
                {
                    "slice": pa.array([k for k, _ in rows], pa.int32()),
                    "anchors": pa.array(planes, pa.binary()),
                    "segments": pa.array([segments[o].tobytes() for _, o in rows], pa.binary()),
                    "twice": pa.array([twice[o].tobytes() for _, o in rows], pa.binary()),
                }
            )

    return run


MAPS = ("several", "crowded", "copied")
COUNTED = "slice int, several binary, crowded binary, copied binary, copies binary"


def _add_anchors(slices: int):
    """A slice's bitmaps, and the segments which are all that stands around their anchor, twice or more."""

    def run(table: pa.Table) -> pa.Table:
        made = [np.frombuffer(x, np.uint8).reshape(4, -1) for x in table["anchors"].to_pylist()]
        anchors = np.concatenate([np.cumsum(np.ascontiguousarray(x.T).view("<u4").ravel(), dtype=np.uint32) for x in made])
        segments = np.frombuffer(b"".join(table["segments"].to_pylist()), U64)
        twice = np.frombuffer(b"".join(table["twice"].to_pylist()), np.uint8)
        order = np.argsort(anchors, kind="stable")
        anchors, segments, twice = anchors[order], segments[order], twice[order]
        first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        number = np.diff(np.append(first, len(anchors)))
        low, high = np.minimum.reduceat(segments, first), np.maximum.reduceat(segments, first)
        several = low != high
        copies = ~several & ((number > 1) | (np.maximum.reduceat(twice, first) > 0))
        crowded = several & (number > CROWDED) & (number > CROWDED_IN_BLOCK * len(made))
        return pa.table(
            {
                "slice": table["slice"][:1],
                "several": pa.array([bitmap(anchors[first[several]], slices, SEVERAL_BITS)], pa.binary()),
                "crowded": pa.array([bitmap(anchors[first[crowded]], slices)], pa.binary()),
                "copied": pa.array([bitmap(anchors[first[copies]], slices)], pa.binary()),
                "copies": pa.array([low[copies].tobytes()], pa.binary()),
            }
        )

    return run


def _unpack(batches):
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
        # -1: to the end of the segment
        yield pa.RecordBatch.from_pydict({"key": keys, "first": np.zeros(len(keys), np.int64), "last": np.full(len(keys), -1)})


def _candidates(data: np.ndarray, offsets: np.ndarray, bitmaps, copies: bool):
    """(first, last, shard hash, segment hash) of the runs whose anchors have several segments, of crowded ones string by
    string; with ``copies`` also of those whose anchors have one segment in several places."""
    first, last, anchors, segments = _all_runs(data, offsets)
    several, crowded, copied = (np.frombuffer(x, np.uint8) for x in bitmaps.value)
    use = has(several, anchors)
    if copies:
        use |= has(copied, anchors)
    first, last, anchors, segments = first[use], last[use], anchors[use], segments[use]
    split = has(crowded, anchors)
    if split.any():
        single = ta.ragged(first[split], last[split] - first[split] + 1)
        own = np.array([U64(int.from_bytes(hashlib.blake2b(data[x : x + LENGTH].tobytes(), digest_size=8).digest(), "little")) for x in single], U64)
        keep = ~split
        first, last = np.concatenate([first[keep], single]), np.concatenate([last[keep], single])
        anchors, segments = np.concatenate([anchors[keep], own]), np.concatenate([segments[keep], own])
    return first, last, anchors, segments


def _segments(bitmaps, shards: int):
    """Each distinct segment of a block once, with the number of its places there, packed by shard."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for _, data, offsets in ta.pieces(batches, "text", BLOCK_BYTES):
            first, last, anchors, segments = _candidates(data, offsets, bitmaps, False)
            keys, at, places = np.unique(segments, return_index=True, return_counts=True)
            shard = (ta.mix(anchors[at]) % U64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(k, order[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            spans = [(first[at[o]], last[at[o]] + LENGTH - first[at[o]]) for _, o in rows]
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([k for k, _ in rows], pa.int32()),
                    "keys": pa.array([keys[o].tobytes() for _, o in rows], pa.binary()),
                    "places": pa.array([places[o].astype(np.int64).tobytes() for _, o in rows], pa.binary()),
                    "lengths": pa.array([n.tobytes() for _, n in spans], pa.binary()),
                    "bytes": pa.array([packer.compress(data[ta.ragged(s, n)].tobytes()) for s, n in spans], pa.binary()),
                }
            )

    return run


def repeated_strings(data: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the LENGTH-byte string at each start of the distinct segments (one after the other) stands elsewhere too."""
    starts_in = lengths - LENGTH + 1
    begin = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int((lengths + 1).sum()), np.uint16)  # symbol 0 separates, bytes are 1 to 256
    text[ta.ragged(begin, lengths)] = data.astype(np.uint16) + np.uint16(1)
    del data
    sa = suffix_array(text, 257)
    prefix = (common_prefixes(text, sa, LENGTH) >= LENGTH)[sa]
    shared = np.zeros(len(text), bool)
    shared[sa[prefix]] = True
    shared[sa[:-1][prefix[1:]]] = True
    del sa, prefix
    # only strings that fit into their segment: LENGTH symbols of another suffix then have no separator either
    return shared[ta.ragged(begin, starts_in)] | np.repeat(places > 1, starts_in)


def _verdicts(table: pa.Table) -> pa.Table:
    """(key, first, last) of the runs of repeated strings in each segment of a shard."""
    release()
    columns = {c: np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("keys", "places", "lengths")}
    columns["bytes"] = np.frombuffer(b"".join(zstandard.decompress(x) for x in table["bytes"].to_pylist()), np.uint8)
    keys, at, number = np.unique(columns["keys"], return_index=True, return_inverse=True)
    places = np.bincount(number, weights=columns["places"]).astype(np.int64)
    lengths = columns["lengths"][at]
    begin = np.cumsum(columns["lengths"]) - columns["lengths"]
    data = columns.pop("bytes")
    data = data[ta.ragged(begin[at], lengths)]
    hit = repeated_strings(data, lengths, places)
    del data
    starts_in = lengths - LENGTH + 1
    base = np.cumsum(starts_in) - starts_in
    edge = np.zeros(len(hit) + 1, bool)
    edge[base] = True
    edge[-1] = True
    begins, ends = hit.copy(), hit.copy()
    begins[1:] &= ~hit[:-1] | edge[1:-1]
    ends[:-1] &= ~hit[1:] | edge[1:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    owner = np.searchsorted(base, begins, side="right") - 1
    return pa.table({"key": keys[owner], "first": begins - base[owner], "last": ends - base[owner]})


def _verdict_keys(verdicts: DataFrame) -> bytes:
    """A bitmap of the keys that have a verdict, by as many of their first bits as it has places."""
    size = size_for(verdicts.count(), each=KEY_BITS)
    place = F.shiftrightunsigned("key", 64 - (size.bit_length() - 1))
    page = verdicts.groupBy(F.floor(place / PAGE_BITS).cast("int").alias("page")).agg(F.bitmap_construct_agg(place % PAGE_BITS).alias("bits"))
    bits = bytearray(size // 8)
    for x in page.collect():
        bits[x["page"] * PAGE_BITS // 8 : (x["page"] + 1) * PAGE_BITS // 8] = x["bits"]
    return bytes(bits)


def _places(bitmaps, judged):
    """Where each segment stands that may have a verdict: of its anchor by the bitmaps, of its key by ``judged``."""

    def run(batches):
        keys = np.frombuffer(judged.value, np.uint8)
        for rows, data, offsets in ta.pieces(batches, "text", BLOCK_BYTES):
            first, last, _, segments = _candidates(data, offsets, bitmaps, True)
            place = (segments >> U64(64 - ((8 * len(keys)).bit_length() - 1))).astype(np.int64)
            use = (keys[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            first, last, segments = first[use], last[use], segments[use]
            own = np.searchsorted(offsets, first, side="right") - 1
            take = pa.array(own)
            yield pa.RecordBatch.from_pydict(
                {
                    "key": segments.view(np.int64), "doc_id": rows.column("doc_id").take(take), "row": rows.column("row").take(take),
                    "at": first - offsets[own], "size": (last - first).astype(np.int32),
                }
            )

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, separate spans from (begin, end) rows."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], np.maximum.reduceat(spans[:, 1], first)], axis=1)


def remove(data: bytes, spans: np.ndarray) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept)


def _apply(whole: bool, carried: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()
            out = []
            for data, spans in zip(texts, batch.column("spans").to_pylist(), strict=True):
                found = merged(np.array([(x["a"], x["b"]) for x in spans], np.int64)) if spans else np.empty((0, 2), np.int64)
                kept = remove(data, found)
                out.append((len(data), len(data) - len(kept), len(found), kept))
            made = {k: pa.array([x[i] for x in out], pa.int64()) for i, k in enumerate(("n_bytes", "n_removed", "n_spans"))}
            if whole:
                # a character that a span cuts through goes with it
                made["kept_text"] = pa.array([x[3].decode("utf-8", "ignore") for x in out], pa.string())
            else:
                made["kept_sha256"] = pa.array([hashlib.sha256(x[3]).hexdigest() for x in out], pa.string())
            others = {f"_{k}": batch.column(f"_{k}") for k in carried}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **made, **others})

    return run


def _power_of_two(n: int) -> int:
    return 1 << max(6, (n - 1).bit_length())


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row, spans (array of begin, end in bytes, not merged) of the rows of ``docs`` (doc_id, row, text) that have any."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, shards = (min(_power_of_two(-(-size // each)), 1 << 20) for each in (SLICE_TEXT, SHARD_TEXT))
    counted = docs.select("text").mapInArrow(_count_anchors(slices), "slice int, anchors binary, segments binary, twice binary")
    counted = cut(counted.groupBy("slice").applyInArrow(_add_anchors(slices), COUNTED))
    by_slice = {x["slice"]: x for x in counted.select("slice", *MAPS).collect()}  # bitmaps: of a bounded size together
    bitmaps = spark.sparkContext.broadcast(tuple(joined([bytes(by_slice[k][c]) if k in by_slice else None for k in range(slices)]) for c in MAPS))
    verdict = "key long, first long, last long"
    segments = docs.select("text").mapInArrow(_segments(bitmaps, shards), "shard int, keys binary, places binary, lengths binary, bytes binary")
    verdicts = segments.groupBy("shard").applyInArrow(_verdicts, verdict)
    verdicts = cut(verdicts.union(counted.select("copies").mapInArrow(_unpack, verdict)))
    judged = spark.sparkContext.broadcast(_verdict_keys(verdicts))
    places = docs.mapInArrow(_places(bitmaps, judged), "key long, doc_id long, row long, at long, size int")
    last = F.when(F.col("last") < 0, F.col("size")).otherwise(F.col("last"))
    spans = places.join(verdicts, "key").select("doc_id", "row", (F.col("at") + F.col("first")).alias("a"), (F.col("at") + last + LENGTH).alias("b"))
    # rows that are alike in id and text give the same spans: once is enough, however many they are
    spans = spans.groupBy("doc_id", "row", "a").agg(F.max("b").alias("b"))
    return cut(spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("a", "b")).alias("spans")))


def row_of(docs: DataFrame) -> Column:
    """Tells rows with one doc_id apart by their texts."""
    return F.xxhash64(docs["text"])


def dedup_substrings(docs: DataFrame, whole: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, or with ``whole`` kept_text; and other columns of
    ``docs`` as they are, with a _ in front of their names."""
    small_batches(docs.sparkSession)
    others = [F.col(c).alias(f"_{c}") for c in carried]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_of(docs).alias("row"), "text", *others)
    spans = repeated_spans(docs.select("doc_id", "row", "text")).withColumnsRenamed({"doc_id": "span_id", "row": "span_row"})
    joined = docs.join(spans, (F.col("row") == F.col("span_row")) & F.col("doc_id").eqNullSafe(F.col("span_id")), "left")
    result = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")])
    result = result.add("kept_text" if whole else "kept_sha256", T.StringType())
    for c in carried:
        result = result.add(f"_{c}", docs.schema[f"_{c}"].dataType)
    return joined.drop("span_id", "span_row", "row").mapInArrow(_apply(whole, carried), result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every 200-byte string of whole tables is too slow in SQL; the tests compare with brute force.
ORACLE_SQL = None
