r"""Near-duplicate documents by a Jaccard join on word shingles, as T-occurrence search (DivideSkip).

Two sets with a Jaccard similarity of 0.75 share at least T shingles, T being three quarters of the larger set at
least.  DivideSkip sets a query's longest inverted lists aside, merges the short ones, and probes the long ones for
what the merge leaves.  With T - 1 lists set aside the merge is a scan for one common shingle among each set's
rarest quarter, which is how the table is cut to candidates; within candidates the T-occurrence count is made whole.

1. Every shingle's inverted list is measured: the blocks' distinct shingles are shuffled by shingle (32 bits each, as
   differences), and the lengths become two bitmaps, "in two sets or more" and "in very many", whose size follows the
   shingles in them up to a bound.  A false hit makes a list seem longer, which costs time and loses nothing.
2. A set of which fewer than T shingles stand in another set has no partner.  The others keep their shingles, and the
   shortest lists that T - 1 longer ones leave are packed and shuffled by shingle, with a bitmap of each set's parities.
   Bitmaps that differ in more places than the sets may differ in rule a pair out; long lists join all their classes
   unseen.  A task returns a spanning forest, so its rows grow with classes and not with pairs.
3. Candidate classes' sets are gathered by cluster in blocks of bounded size.  Blocks are compared with themselves and
   with the cluster's first block.  Of what is then still apart, sets that share one of their short lists with a set of
   another component are compared with that set's block, unless sizes and bitmaps rule the pair out; in lists longer than
   COMMON all ask, unseen.  Each comparison counts overlaps by DivideSkip (``connect``) and returns a spanning forest of
   its links.

Texts with equal sets are one class from the first step on.  Shingles are 64-bit hashes of five words with A-Z
lower-cased (``text_arrays`` says how sure they are).  Lists longer than COMMON join their classes to one cluster without
a look at the pairs, which costs comparisons of blocks later and changes no result.

Defined results: a text without words has no shingles and is its own component; one with fewer than five words has its whole sequence as one shingle; rows with the same
text are linked, repeated doc_ids included; a null doc_id is linked but never a component's name unless all of it are
null; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import text_arrays as ta
from shelfspark.llm.bitmaps import bitmap, has, joined
from shelfspark.llm.components import components
from shelfspark.llm.storage import cut, small_batches

PERCENT = 75
#: A shingle in more sets than this goes to the end of the order, and its classes are joined to one cluster unseen.
COMMON = 64
#: Bits of the bitmap that holds, for each residue of the shingles, whether their number is odd.
PARITIES = 512
#: Shingles in a block of candidate sets, and how long a list within a block counts as long.
BLOCK_SHINGLES, LONG_LIST = 100_000, 24
#: Blocks that the sets of a block are taken out for at a time.
ASKED = 64
U64 = ta.U64


def _sets(data: np.ndarray, offsets: np.ndarray):
    """Distinct (text, shingle), offsets, and each set's 64-bit signature."""
    text, tokens, bounds = ta.distinct(*ta.shingles(data, offsets), len(offsets) - 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(ta.mix(tokens ^ U64(0xA0761D6478BD642F)))])
    n = np.diff(bounds)
    return text, tokens, bounds, ta.mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(U64) * U64(0xE7037ED1A0B428DB)).view(np.int64)


def _first_of_equal(sigs: np.ndarray) -> np.ndarray:
    first = np.zeros(len(sigs), bool)
    first[np.unique(sigs, return_index=True)[1]] = True
    return first


def _shifted(tokens: np.ndarray, slices: int) -> np.ndarray:
    """The 32 bits behind those that name the slice."""
    return (tokens >> U64(32 - (slices.bit_length() - 1))).astype(np.uint32)


def _lists(slices: int):
    """Each block's shingles (equal sets once) by slice: sorted, as differences, low bytes first, which packs well."""

    def run(batches):
        for _, data, offsets in ta.pieces(batches, "text", 4 * ta.PIECE_BYTES):
            text, tokens, _, sigs = _sets(data, offsets)
            tokens = np.sort(tokens[_first_of_equal(sigs)[text]])
            edges = np.arange(1, slices, dtype=U64) << U64(64 - (slices.bit_length() - 1))
            cuts = np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])
            short = _shifted(tokens, slices)
            rows = [(k, short[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            packed = [np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for _, x in rows]
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k for k, _ in rows], pa.int32()), "tokens": pa.array(packed, pa.binary())})

    return run


def _list_lengths(slices: int):
    def run(table: pa.Table) -> pa.Table:
        made = []
        for x in table["tokens"].to_pylist():
            planes = np.frombuffer(x, np.uint8).reshape(4, -1)
            made.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32))
        tokens = np.sort(np.concatenate(made))
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        length = np.diff(np.append(first, len(tokens)))
        maps = {"shared": bitmap(tokens[first[length > 1]], slices), "common": bitmap(tokens[first[length > COMMON]], slices)}
        return pa.table({"slice": table["slice"][:1], **{k: pa.array([v], pa.binary()) for k, v in maps.items()}})

    return run


SETS = "doc_id long, n_shingles long, sig long, tokens binary"


def _measure(bitmaps):
    """Each row's set: size and signature, and the shingles if the set may have a partner (for equal sets of a block once)."""

    def run(batches):
        shared = np.frombuffer(bitmaps.value[0], np.uint8)
        for rows, data, offsets in ta.pieces(batches, "text", 4 * ta.PIECE_BYTES):
            _, tokens, bounds, sigs = _sets(data, offsets)
            n = np.diff(bounds)
            sums = np.concatenate([[0], np.cumsum(has(shared, tokens))])
            may = (100 * (sums[bounds[1:]] - sums[bounds[:-1]]) >= PERCENT * n) & (n > 0) & _first_of_equal(sigs)
            sets = [tokens[a:b].tobytes() if k else None for k, a, b in zip(may, bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": rows.column("doc_id"), "n_shingles": n, "sig": pa.array(sigs, mask=n == 0), "tokens": pa.array(sets, pa.binary())}
            )

    return run


def _parities(owner: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """One row of PARITIES bits, as 64-bit numbers, for each of n sets."""
    bit = ((tokens >> U64(20)) % U64(PARITIES)).astype(np.int64)
    odd = np.bincount(owner * PARITIES + bit, minlength=n * PARITIES).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, PARITIES), axis=1).view(np.int64)


def _short_lists(bitmaps, parts: int):
    """The shingles with the shortest lists of each set, but for those in no other set, packed by part."""

    def run(batches):
        shared, common = (np.frombuffer(x, np.uint8) for x in bitmaps.value)
        for batch in batches:
            sigs, n, component, chunk = (batch.column(c).to_numpy().astype(np.int64) for c in ("sig", "n", "component", "chunk"))
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), U64)
            bounds = np.concatenate([[0], np.cumsum(n)])
            owner = np.repeat(np.arange(len(n)), n)
            facts = np.concatenate([np.stack([component, chunk, n], axis=1), _parities(owner, tokens, len(n))], axis=1)
            rarity = has(shared, tokens).astype(np.int8) + has(common, tokens)
            order = np.lexsort((rarity, owner))  # ties stay in the order of shingles
            rank = np.arange(len(owner)) - bounds[owner]  # owner is sorted, so its order is unchanged
            least = n - -(-PERCENT * n // 100) + 1
            use = (rank < least[owner]) & (rarity[order] > 0)
            token, owner = tokens[order][use], owner[use].astype(np.int32)
            part = (token % U64(parts)).astype(np.int64)
            order = np.lexsort((token, part))
            token, owner = token[order], owner[order]
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            owners = [np.unique(owner[a:b], return_inverse=True) for _, a, b in rows]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([p for p, _, _ in rows], pa.int32()),
                    "tokens": pa.array([token[a:b].tobytes() for _, a, b in rows], pa.binary()),
                    "owners": pa.array([i.astype(np.int32).tobytes() for _, i in owners], pa.binary()),
                    "sigs": pa.array([sigs[u].tobytes() for u, _ in owners], pa.binary()),
                    "facts": pa.array([facts[u].tobytes() for u, _ in owners], pa.binary()),
                }
            )

    return run


def _edges(nodes: np.ndarray, label: np.ndarray) -> pa.Table:
    own = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": pa.array(nodes[label[own]], pa.int64()), "b": pa.array(nodes[own], pa.int64())})


def _postings(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The classes of a part, (token, class number) sorted by token and each class once, and the classes' facts by column:
    component, chunk, size and parities."""
    tokens, owners, sigs, facts, base = [], [], [], [], 0
    for t, o, s, f in zip(*(table[c].to_pylist() for c in ("tokens", "owners", "sigs", "facts")), strict=True):
        tokens.append(np.frombuffer(t, U64))
        owners.append(np.frombuffer(o, np.int32).astype(np.int64) + base)
        sigs.append(np.frombuffer(s, np.int64))
        facts.append(np.frombuffer(f, np.int64).reshape(len(sigs[-1]), -1))
        base += len(sigs[-1])
    nodes, at, number = np.unique(np.concatenate(sigs), return_index=True, return_inverse=True)
    token, owner = np.concatenate(tokens), number[np.concatenate(owners)]
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
    return nodes, token[fresh], owner[fresh], np.concatenate(facts)[at].T


def _may_link(facts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes and parities allow the similarity: sets that differ in d shingles differ in d parities at most."""
    n, parities = facts[2], np.ascontiguousarray(facts[3:].T).view(U64)
    most = ((100 - PERCENT) * (n[a] + n[b])) // (100 + PERCENT)  # of the symmetric difference
    return (np.abs(n[a] - n[b]) <= most) & (np.bitwise_count(parities[a] ^ parities[b]).sum(axis=1) <= most)


def _short(token: np.ndarray) -> np.ndarray:
    """Whether the list of each place is no longer than COMMON."""
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(first, len(token)))
    return np.repeat(size <= COMMON, size)


def _pairs(token: np.ndarray, owner: np.ndarray, facts: np.ndarray, step: np.ndarray, choose) -> tuple[np.ndarray, np.ndarray]:
    """Classes that stand together in a list and may be linked; ``choose`` takes some of the places and gives them an order."""
    n, links = facts.shape[1], np.empty(0, np.int64)
    for apart in range(1, COMMON):  # classes so many places apart in a list
        near = np.flatnonzero(token[apart:] == token[:-apart])
        near = near[step[near]]
        if not len(near):
            break
        x, y = choose(near, near + apart)
        links = np.union1d(links, owner[x] * n + owner[y])
    a, b = links // n, links % n
    may = np.concatenate([np.empty(0, bool), *(_may_link(facts, x, y) for x, y in zip(*(np.array_split(v, 1 + len(a) // 100_000) for v in (a, b)), strict=True))])
    return a[may], b[may]


def _meet(table: pa.Table) -> pa.Table:
    """Joins the classes of each shingle of a part that may be linked; those of a very common shingle all."""
    nodes, token, owner, facts = _postings(table)
    step = _short(token)
    a, b = _pairs(token, owner, facts, step, lambda x, y: (x, y))
    long = np.flatnonzero(~step[1:] & (token[1:] == token[:-1]))
    return _edges(nodes, ta.forest(len(nodes), np.concatenate([a, owner[long]]), np.concatenate([b, owner[long + 1]])))


def _meet_apart(table: pa.Table) -> pa.Table:
    """(sig, chunk_2): classes of a part, and the chunks where a class of another component has the same shingle and may be
    linked (with a very common shingle: any). Of two components the smaller one of a shingle asks, so the largest one's
    classes never do."""
    nodes, token, owner, facts = _postings(table)
    component, chunk = facts[:2]
    run = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
    group = np.unique(np.stack([run, component[owner]]), axis=1, return_inverse=True, return_counts=True)
    (run_of, _), which, size = group
    order = np.lexsort((-size, run_of))
    largest = np.zeros(len(size), bool)
    largest[order[np.concatenate([[True], run_of[order][1:] != run_of[order][:-1]])]] = True
    asks = ~largest[which.ravel()]
    step = _short(token)

    def apart(x, y):  # blocks within themselves and with block 0 are done
        a, b = owner[x], owner[y]
        use = (component[a] != component[b]) & (chunk[a] != chunk[b]) & (chunk[a] != 0) & (chunk[b] != 0)
        x, y = x[use], y[use]
        return np.where(asks[x], x, y), np.where(asks[x], y, x)

    one, other = _pairs(token, owner, facts, step, apart)
    # in long lists: the chunks of each run, with the smallest and the largest component there
    order = np.lexsort((chunk[owner], run))
    r, c, m = run[order], chunk[owner][order], component[owner][order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])]))
    low, high, r, c = np.minimum.reduceat(m, first), np.maximum.reduceat(m, first), r[first], c[first]
    asking, at = owner[asks & ~step], run[asks & ~step]
    begin, end = np.searchsorted(r, at, side="left"), np.searchsorted(r, at, side="right")
    place = ta.ragged(begin, end - begin)
    asking = np.repeat(asking, end - begin)
    use = ((low[place] != component[asking]) | (high[place] != component[asking])) & (c[place] != chunk[asking]) & (c[place] != 0) & (chunk[asking] != 0)
    pairs = np.unique(np.stack([np.concatenate([asking[use], one]), np.concatenate([c[place][use], chunk[other]])]), axis=1)
    return pa.table({"sig": nodes[pairs[0]], "chunk_2": pairs[1].astype(np.int32)})


def _pack(table: pa.Table) -> pa.Table:
    """The sets of a block in one row, each class once."""
    table = table.take(pa.array(np.unique(table["sig"].to_numpy(), return_index=True)[1]))
    tokens = b"".join(table["tokens"].to_pylist())
    return pa.table(
        {
            "cluster": table["cluster"][:1], "chunk": table["chunk"][:1],
            "sigs": pa.array([table["sig"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "sizes": pa.array([table["n"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "tokens": pa.array([tokens], pa.binary()),
        }
    )


def _parts_for(batches):
    """Of each block the sets that ask for another block, in a row for each of these."""
    for batch in batches:
        for row in batch.to_pylist():
            sigs, sizes, tokens = _read(row, "")
            ends, order = np.cumsum(sizes), np.argsort(sigs)
            at = order[np.searchsorted(sigs, np.array(row["asking"], np.int64), sorter=order)]
            asked = np.array(row["asked"], np.int32)
            for chunk in np.unique(asked):
                own = np.unique(at[asked == chunk])
                yield pa.RecordBatch.from_pydict(
                    {
                        "cluster": pa.array([row["cluster"]], pa.int64()), "chunk": pa.array([row["chunk"]], pa.int32()),
                        "sigs": [sigs[own].tobytes()], "sizes": [sizes[own].tobytes()],
                        "tokens": [tokens[ta.ragged(ends[own] - sizes[own], sizes[own])].tobytes()], "chunk_2": pa.array([chunk], pa.int32()),
                    }
                )


class Forest:
    """Labels of nodes that links have joined; the smaller side takes the other one's label."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, a: int, b: int) -> None:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return
        x, y = self.members.pop(a, [a]), self.members.pop(b, [b])
        if len(x) < len(y):
            a, x, y = b, y, x
        self.label[y] = a
        self.members[a] = x + y


def merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in sorted lists, merged by a heap of their heads, and how many lists each stands in."""
    found, count = [], []
    for number in heapq.merge(*(x.tolist() for x in lists)):
        if found and found[-1] == number:
            count[-1] += 1
        else:
            found.append(number)
            count.append(1)
    return np.array(found, np.int64), np.array(count, np.int64)


def connect(n_a: np.ndarray, a: np.ndarray, node_a: np.ndarray, n_b: np.ndarray, b: np.ndarray, node_b: np.ndarray, nodes: int) -> np.ndarray:
    """A label for each node, the same for those that similarities of PERCENT or more join, by DivideSkip.

    a, b: the sets' shingles, set after set; node_a, node_b: the sets' nodes.  Of a set's inverted lists in b the longest
    ones (longer than LONG_LIST, fewer than the overlap T that is needed) are set aside; the others are merged by a heap,
    and the sets that stand in T less the number of long lists are looked up in the long ones by binary search.  Sets
    that are joined already are not searched for again.
    """
    forest = Forest(nodes)
    owner = np.repeat(np.arange(len(n_b)), n_b)
    order = np.argsort(b, kind="stable")
    lists, owner = b[order], owner[order]
    low, high = np.searchsorted(lists, a, side="left"), np.searchsorted(lists, a, side="right")
    begins = np.searchsorted(lists, lists, side="left")
    keys = begins * len(n_b) + owner  # in order: where a list begins, and whose the shingle is
    ends = np.cumsum(n_a)
    for k in range(len(n_a)):
        at, size = low[ends[k] - n_a[k] : ends[k]], (high - low)[ends[k] - n_a[k] : ends[k]]
        at, size = at[size > 0], size[size > 0]
        least = -(-PERCENT * n_a[k] // 100)
        if len(at) < least:
            continue
        apart = (forest.label[node_b] != forest.label[node_a[k]]) & (100 * n_b >= PERCENT * n_a[k]) & (PERCENT * n_b <= 100 * n_a[k])
        if not apart.any():
            continue
        by_size = np.argsort(-size, kind="stable")
        n_long = min(int((size > LONG_LIST).sum()), int(least) - 1)
        long, short = at[by_size[:n_long]], by_size[n_long:]
        postings = (owner[at[s] : at[s] + size[s]] for s in short)
        found, count = merge([x for x in (p[apart[p]] for p in postings) if len(x)])
        if not len(found):
            continue
        needed = -(-PERCENT * np.maximum(n_a[k], n_b[found]) // 100)
        near = count + n_long >= needed
        found, count = found[near], count[near]
        if n_long and len(found):
            probes = long * len(n_b) + found[:, None]
            place = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
            count = count + (keys[place] == probes).sum(axis=1)
        for other in found[100 * count >= PERCENT * (n_a[k] + n_b[found] - count)]:
            forest.join(node_a[k], node_b[other])
    return forest.label


def _read(row: dict, side: str):
    return tuple(np.frombuffer(row[f"{x}{side}"], t) for x, t in (("sigs", np.int64), ("sizes", np.int64), ("tokens", U64)))


def _compare(batches):
    """A spanning forest of the links between two blocks, or within one if no second is given."""
    for batch in batches:
        for row in batch.to_pylist():
            sig, n, tokens = _read(row, "")
            other = _read(row, "_2") if row.get("sigs_2") is not None else (sig, n, tokens)
            nodes, number = np.unique(np.concatenate([sig, other[0]]), return_inverse=True)
            yield from _edges(nodes, connect(n, tokens, number[: len(sig)], other[1], other[2], number[len(sig) :], len(nodes))).to_batches()


PACKED = "cluster long, chunk int, sigs binary, sizes binary, tokens binary"


def _second(blocks: DataFrame) -> DataFrame:
    return blocks.select("cluster", F.col("chunk").alias("chunk_2"), *[F.col(c).alias(f"{c}_2") for c in ("sigs", "sizes", "tokens")])


def links_of(sets: DataFrame, clusters: DataFrame, postings) -> DataFrame:
    """Links (a, b) that join exactly the classes which similarities join. sets: sig, n, tokens (a class may stand there
    several times); clusters: node, component; postings: makes the short lists of sets with component and chunk."""
    sizes = sets.select("sig", "n").distinct().join(clusters.select(F.col("node").alias("sig"), F.col("component").alias("cluster")), "sig")
    chunks = cut(sizes.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("chunks")))
    placed = cut(sizes.join(chunks, "cluster").select("sig", "cluster", "chunks", F.pmod(F.xxhash64("sig"), F.col("chunks")).cast("int").alias("chunk")))
    blocks = cut(sets.join(placed.drop("chunks"), "sig").groupBy("cluster", "chunk").applyInArrow(_pack, PACKED))
    edges = blocks.mapInArrow(_compare, "a long, b long")
    several = chunks.where("chunks > 1").select("cluster")  # few, so that the others' blocks stay where they are
    first = blocks.where("chunk > 0").join(_second(blocks.where("chunk = 0").join(several, "cluster", "left_semi")), "cluster")
    edges = cut(edges.union(first.mapInArrow(_compare, "a long, b long")))

    large = placed.where("chunks > 1").drop("chunks")
    if large.isEmpty():
        return edges
    found = components(edges)
    large = large.join(found.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    told = sets.join(cut(large), "sig").select("sig", "n", "tokens", "component", "chunk")
    apart = postings(told).groupBy("part").applyInArrow(_meet_apart, "sig long, chunk_2 int")
    apart = cut(apart.distinct().join(placed.select("sig", "cluster", "chunk"), "sig"))
    # the sets are taken from their blocks; a row asks for a bounded number of blocks
    asks = apart.groupBy("cluster", "chunk", F.floor(F.col("chunk_2") / ASKED)).agg(*[F.collect_list(c).alias(d) for c, d in (("sig", "asking"), ("chunk_2", "asked"))])
    own = blocks.join(asks.select("cluster", "chunk", "asking", "asked"), ["cluster", "chunk"]).mapInArrow(_parts_for, f"{PACKED}, chunk_2 int")
    rest = own.join(_second(blocks), ["cluster", "chunk_2"])
    return edges.union(rest.mapInArrow(_compare, "a long, b long"))


def list_bitmaps(docs: DataFrame):
    """The broadcast bitmaps (shared, common) of all shingles' inverted lists."""
    spark = docs.sparkSession
    slices = min(1 << max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()), 1 << 16)
    lists = docs.select("text").mapInArrow(_lists(slices), "slice int, tokens binary")
    made = lists.groupBy("slice").applyInArrow(_list_lengths(slices), "slice int, shared binary, common binary").collect()
    by_slice = {x["slice"]: x for x in made}
    whole = (joined([bytes(by_slice[k][c]) if k in by_slice else None for k in range(slices)]) for c in ("shared", "common"))
    return spark.sparkContext.broadcast(tuple(whole))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bitmaps = list_bitmaps(docs)
    measured = cut(docs.mapInArrow(_measure(bitmaps), SETS))
    rows = measured.select("doc_id", "n_shingles", "sig")
    # a set that stands in several blocks is given by each; what follows takes it once
    sets = measured.where("tokens IS NOT NULL").select("sig", F.col("n_shingles").alias("n"), "tokens")

    lists = "part int, tokens binary, owners binary, sigs binary, facts binary"
    postings = lambda told: told.mapInArrow(_short_lists(bitmaps, parts), lists)
    nothing = F.lit(0).cast("long")
    all_sets = sets.select("sig", "n", "tokens", nothing.alias("component"), nothing.alias("chunk"))
    clusters = components(postings(all_sets).groupBy("part").applyInArrow(_meet, "a long, b long"))
    found = components(links_of(sets, clusters, postings))

    classes = cut(rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("first_id")))
    names = classes.join(found.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    smallest = names.groupBy("component").agg(F.min("first_id").alias("component_id"))
    # written, so that Spark can split a class which very many documents share
    named = cut(names.join(smallest, "component").select("sig", "component_id"))
    return rows.join(named, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs in SQL are too slow on whole tables; the tests compare with brute force.
ORACLE_SQL = None
