"""A Merkle manifest of a dataset: a content-addressed DAG, and proofs read from it by descent.

*Store.*  Rows become leaves (digests of their fields).  The leaves of each tree (one for each language) are ranked, and
every eight consecutive nodes become a record: the digest of their digests, and the digests themselves.  A record is
found by its digest alone, so equal subtrees are stored once.  The roots of the trees, in order, are the leaves of one
more tree of the same make, whose root stands for the dataset.

*Descent.*  A request is a leaf's tree and rank.  The digits of the rank, base 8, say which child to take from the
root down.  Requests with the same first digits travel as one row: at each height the rows that are under way meet the
records by digest, take the children that any request below wants, and add the digests of the unselected ones to their
path.  The last step hands each leaf its request; the segments of its path, read in reverse, are its proof.

*Scale.*  Ranks come from one range shuffle and the counts of its partitions, so a language with all rows is spread
like any other; copies of a row are dealt by their place in the input.  What is under way at a height has at most an
eighth of the rows below it, so all heights together move little more than the last.  A digest that many rows want
(copies of a subtree) is a plain inner join's hot key, which Spark splits.  Digests are kept as 32 bytes.

Defined results: every null field is written as ``-``; a null language is a tree of its own, before all others; null
doc_ids come first in their tree and are never tampered with; rows that share a doc_id are ordered by their leaf (and
copies are interchangeable); an empty table has no rows and no root; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.storage import cut

FAN, WIDTH = 8, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<digit:int,siblings:binary>>"


@dataclass
class Manifest:
    """nodes: the ranked leaves; trees: tree, n, digest (its root) and rank; root: the dataset's (one row, or none).
    records[h] and top[h]: digest and children of the nodes of height h + 1, of the trees and of the tree above them."""

    nodes: DataFrame
    trees: DataFrame
    root: DataFrame
    records: list[DataFrame]
    top: list[DataFrame]


def field(c: Column) -> Column:
    """``-`` for null, else the bytes of the text and the text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def shown(c: Column) -> Column:
    """Digests as lowercase hexadecimal text, as they are hashed and reported."""
    return F.lower(F.hex(c))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, and tampered: the leaf after tampering, where that is done."""
    told = {c: field(F.col(c)) for c in FIELDS}
    struck = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & F.col("text").isNotNull()
    changed = told | {"text": field(F.translate(F.col("text"), UPPER, LOWER))}
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        digest(*told.values()).alias("digest"), F.when(struck, digest(*changed.values())).alias("tampered"),
    )


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank (from 0) and n (how many) in their tree; rows alike in ``order`` are ranked as they stand."""
    keys = ["tree", *order, "_copy"]
    spread = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_copy")
    placed = cut(spread.withColumn("_at", F.monotonically_increasing_id()))  # the partition's number in the upper bits
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part"), "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("_n").over(by_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = cut(counts.select("tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(by_tree).alias("n")))
    return placed.withColumn("_part", part).join(counts, ["tree", "_part"]).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "n")


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(records by height, roots) of nodes (tree, rank, n, digest): every eight become one until one is left."""
    level, records, roots = nodes.select("tree", "rank", "n", "digest"), [], None
    most = level.agg(F.max("n")).first()[0] or 0
    while True:
        done = level.where("n = 1").select("tree", "digest", F.lit(len(records)).alias("depth"))
        roots = done if roots is None else roots.unionByName(done)
        if most <= 1:
            return records, cut(roots)
        runs = level.where("n > 1").groupBy("tree", F.expr(f"rank div {FAN}").alias("rank"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))
        joined = F.aggregate(F.array_sort(F.collect_list(F.struct("rank", "digest"))), F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
        level = cut(runs.agg(joined.alias("children")).withColumn("digest", digest(shown(F.col("children")))))
        records.append(cut(level.select("digest", "children").dropDuplicates(["digest"])))
        level, most = level.drop("children"), (most + FAN - 1) // FAN


def manifest(rows: DataFrame, *order: str) -> Manifest:
    """Of rows (tree, digest and more) in the order of ``order`` in their tree."""
    nodes = ranked(rows, *order)
    records, roots = grow(nodes)
    sizes = roots.withColumns({"name": F.col("tree"), "tree": F.lit("")})
    trees = cut(ranked(sizes, "name"))
    top, root = grow(trees)
    return Manifest(nodes, trees, root, records, top)


def descend(records: list[DataFrame], starts: DataFrame, requests: DataFrame) -> DataFrame:
    """From each tree's root (starts: tree, digest, depth, path) to the leaves that are asked for (requests: tree, rank
    and r, whatever is to come back): r, the leaf's digest, the tree's (origin), and the path with what was passed by."""
    step = lambda c: F.expr(f"{c} div {FAN}").alias("prefix")
    digit = lambda c: (F.col(c) % FAN).cast("int")
    wanted = [cut(requests.groupBy("tree", step("rank")).agg(F.collect_list(F.struct(digit("rank").alias("digit"), "r")).alias("next")))]
    for _ in records[1:]:
        wanted.append(cut(wanted[-1].groupBy("tree", step("prefix")).agg(F.collect_list(F.struct(digit("prefix").alias("digit"))).alias("next"))))
    starts, under_way = starts.withColumn("origin", F.col("digest")), None
    for height in range(len(records), 0, -1):
        own = starts.where(F.col("depth") == height).select("tree", F.lit(0).cast("long").alias("prefix"), "digest", "origin", "path")
        under_way = own if under_way is None else under_way.unionByName(own)
        met = under_way.join(wanted[height - 1], ["tree", "prefix"]).join(records[height - 1], "digest")
        met = met.select("tree", "prefix", "origin", "path", "children", F.explode("next").alias("go"))
        left, right = F.substring("children", F.lit(1), WIDTH * F.col("go.digit")), F.expr(f"substring(children, {WIDTH} * (go.digit + 1) + 1)")
        passed = F.concat("path", F.array(F.struct(F.col("go.digit").alias("digit"), F.concat(left, right).alias("siblings"))))
        child = F.substring("children", WIDTH * F.col("go.digit") + 1, F.lit(WIDTH))
        named = [F.col("go.r").alias("r")] if height == 1 else ["tree", (F.col("prefix") * FAN + F.col("go.digit")).alias("prefix")]
        under_way = cut(met.select(*named, child.alias("digest"), "origin", passed.alias("path")))
    alone = starts.where("depth = 0").join(requests.where("rank = 0"), "tree").select("r", "digest", "origin", "path")
    return alone if under_way is None else under_way.unionByName(alone)


def prove(m: Manifest, requests: DataFrame) -> DataFrame:
    """r, digest (the leaf's), subroot, root and path (root first) of each request (tree, rank, r)."""
    whole = m.root.select("tree", "digest", "depth", F.array().cast(PATH).alias("path"))
    named = m.trees.select("tree", "rank", F.struct("name", "depth").alias("r"))
    starts = descend(m.top, whole, named).select(F.col("r.name").alias("tree"), "digest", F.col("r.depth").alias("depth"), "path")
    root = m.root.first()  # one digest
    found = descend(m.records, cut(starts), requests)
    return found.select("r", "digest", F.col("origin").alias("subroot"), F.lit(bytes(root["digest"]) if root else None).cast("binary").alias("root"), "path")


def proof(path: Column) -> Column:
    """The siblings' digests from the leaf up, as text."""
    return F.array_join(F.transform(F.reverse(path), lambda p: shown(p["siblings"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root's digest (text) that a leaf (text) and a path give."""
    up = lambda at, p: F.sha2(F.concat(shown(F.substring(p["siblings"], F.lit(1), WIDTH * p["digit"])), at, F.substring(shown(p["siblings"]), 2 * WIDTH * p["digit"] + 1, F.lit(2 * WIDTH * FAN))), 256)
    return F.aggregate(F.reverse(path), leaf, up)


def verify(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root and proof_sha256 of every row, and what its root is after tampering."""
    m = manifest(cut(leaves(docs)), "doc_id", "digest")
    requests = m.nodes.select("tree", "rank", F.struct("doc_id", "tampered").alias("r"))
    found = prove(m, requests)
    now = shown(F.coalesce("r.tampered", "digest"))
    out = found.select(
        F.col("r.doc_id").alias("doc_id"), shown(F.col("digest")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(F.col("root")).alias("root"),
        F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(now, F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_TOLD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_TOLD.format(c) for c in FIELDS) + ")"
_STRUCK = "sha256(" + " || ".join(_TOLD.format(f"translate(text, '{UPPER}', '{LOWER}')" if c == "text" else c) for c in FIELDS) + ")"
ORACLE_SQL = f"""WITH RECURSIVE
crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM range(256) r(i))),
given AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295::BIGINT)) AS crc FROM documents, crc_table),
leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_LEAF} AS leaf, CASE WHEN crc % 3 = 0 AND text IS NOT NULL THEN {_STRUCK} ELSE {_LEAF} END AS now FROM given),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes(tree, level, rank, digest, n) AS (SELECT tree, 0, rank, leaf, n FROM placed
  UNION ALL SELECT tree, level + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, rank // 8, n),
subroots AS (SELECT tree, level AS depth, digest, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, rank, digest, n) AS (SELECT 0, rank, digest, n FROM subroots
  UNION ALL SELECT level + 1, rank // 8, sha256(string_agg(digest, '' ORDER BY rank)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, rank // 8, n),
steps AS (SELECT p.tree, p.rank, a.level AS step, coalesce(string_agg(s.digest, '' ORDER BY s.rank) FILTER (s.rank < a.rank), '') AS l, coalesce(string_agg(s.digest, '' ORDER BY s.rank) FILTER (s.rank > a.rank), '') AS r
    FROM placed p JOIN nodes a ON a.tree = p.tree AND a.rank = p.rank >> (3 * a.level) AND a.n > 1
    JOIN nodes s ON s.tree = a.tree AND s.level = a.level AND s.rank // 8 = a.rank // 8 GROUP BY ALL
  UNION ALL SELECT p.tree, p.rank, u.depth + a.level, coalesce(string_agg(s.digest, '' ORDER BY s.rank) FILTER (s.rank < a.rank), ''), coalesce(string_agg(s.digest, '' ORDER BY s.rank) FILTER (s.rank > a.rank), '')
    FROM placed p JOIN subroots u ON u.tree = p.tree JOIN tops a ON a.rank = u.rank >> (3 * a.level) AND a.n > 1
    JOIN tops s ON s.level = a.level AND s.rank // 8 = a.rank // 8 GROUP BY p.tree, p.rank, u.depth, a.level),
proofs AS (SELECT tree, rank, string_agg(l || r, '' ORDER BY step) AS proof FROM steps GROUP BY ALL),
folds(tree, rank, step, digest) AS (SELECT tree, rank, 0, now FROM placed
  UNION ALL SELECT f.tree, f.rank, f.step + 1, sha256(s.l || f.digest || s.r) FROM folds f JOIN steps s ON s.tree = f.tree AND s.rank = f.rank AND s.step = f.step),
folded AS (SELECT tree, rank, arg_max(digest, step) AS folded_root FROM folds GROUP BY ALL)
SELECT doc_id, leaf, u.digest AS subroot, t.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = t.digest AS verified
FROM placed p JOIN subroots u USING (tree) JOIN tops t ON t.n = 1 JOIN folded f ON f.tree = p.tree AND f.rank = p.rank LEFT JOIN proofs q ON q.tree = p.tree AND q.rank = p.rank"""
