"""Main text of web pages by wrapper induction.

Pages of one host that have one outline share a template.  Of each such layout two pages are taken as references (two
different ones, if there are two), and every page of the layout is aligned with them by simple tree matching.  Each
slot (a text node of a reference) is counted over all pages of the layout: how many characters stand there, how many of
them in links, and in how many pages each of the reference's own texts stands there again.  From these counts:

* Texts that stand in their slot in CONSTANT_SHARE of the pages are template.
* Of the varying rest, the region that holds most is the article: from the root down, the one container that has
  REGION_SHARE of what varies, as long as there is one and it is no record of a list.  Characters in links do not count,
  so menus and lists of teasers do not win.
* Elements and roles that cannot be an article (nav, footer, aside, script, ...) are left out.  Class and id words only
  break ties: what they mark is left out unless it holds most of what varies.  An article or main element that holds
  MARKED_SHARE of the region is the region.

A page whose layout has fewer than MIN_PAGES pages is judged by its own counts, with nothing constant.  Nodes of a
page that the reference lacks go with the nearest node around them that it has.

Pages are parsed once; the parsed form is written to the shared folder.  References and wrappers are as many as layouts
(each as large as two pages' outlines); counts are aggregated in the tasks before they are shuffled; a layout that a
large share of pages has is split by Spark's skew handling, or its wrapper is broadcast, whichever the sizes give.  All
pages vote, and nothing depends on a page's size.

Defined results: a null html is empty and has no text; a null url belongs to the host ""; a page all of whose text
would go as template is judged by its own counts; repeated rows are pages like any other; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.dom import COMMENTS, CONTAINERS, HARD, HEADINGS, SOFT, Page, Tree, mark_of, match
from shelfspark.llm.storage import cut, small_batches
from shelfspark.llm.url_filters import host_of

#: Pages that a layout needs, and the share of them in which a slot says the same, for it to be constant.
MIN_PAGES, CONSTANT_SHARE = 5, 0.8
#: Shares of the varying text: of a region in the one around it, of marked articles in a region.
REGION_SHARE, MARKED_SHARE = 0.6, 0.5
#: A part that is noise by words only stays if it holds so much of the text, with articles inside and without.
MOST_WITH_ARTICLE, MOST = 0.5, 0.75
#: The same for comments, outside of which there is then next to nothing.
MOST_COMMENTS = 0.9
#: Lists with so many of their characters in links are left out of an unmarked region.
LINK_SHARE = 0.6
FLUSHED_AT = 100_000
MARKED = ("article", "main")

PARSED = "page_id long, url string, host string, layout long, picked long, body binary"
KEY = ["host", "layout"]


def _pack(value: object) -> bytes:
    return zstandard.compress(pickle.dumps(value, 5), 1)


def _unpack(data: bytes):
    return pickle.loads(zstandard.decompress(data))


def _parse(batches):
    for batch in batches:
        pages = [Page(x or "") for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {
                **{c: batch.column(c) for c in ("page_id", "url", "host")},
                "layout": pa.array([p.layout() for p in pages], pa.int64()),
                "picked": batch.column("picked"),
                "body": pa.array([_pack((p.packed(), p.leaves)) for p in pages], pa.binary()),
            }
        )


def parse(pages: DataFrame) -> DataFrame:
    """Pages as trees and leaves. picked orders the pages of a layout, in a way that has nothing to do with their content."""
    host = F.coalesce(host_of(F.col("url")), F.lit("")).alias("host")
    picked = F.xxhash64("url", "html", "page_id").alias("picked")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host, picked, "html").mapInArrow(_parse, PARSED)


def _outline(batches):
    """A reference's tree and the texts of its slots."""
    for batch in batches:
        out = []
        for body in batch.column("body").to_pylist():
            packed, leaves = _unpack(body)
            out.append(_pack((packed, sorted({(node, mark_of(text)) for node, text, _ in leaves}))))
        yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("host", "layout", "reference")}, "outline": pa.array(out, pa.binary())})


def references(parsed: DataFrame) -> DataFrame:
    """host, layout, reference (0 or 1) and outline: the pages with the smallest and the largest ``picked``."""
    ends = cut(parsed.groupBy(*KEY).agg(F.count("*").alias("pages"), F.min("picked").alias("low"), F.max("picked").alias("high")))
    ends = ends.where(F.col("pages") >= MIN_PAGES)
    both = ends.select(*KEY, F.explode(F.array_distinct(F.array("low", "high"))).alias("picked"), "low")
    chosen = parsed.join(both, [*KEY, "picked"]).select(*KEY, (F.col("picked") != F.col("low")).cast("int").alias("reference"), "body")
    return chosen.groupBy(*KEY, "reference").agg(F.min("body").alias("body")).mapInArrow(_outline, "host string, layout long, reference int, outline binary")


class Outlines:
    """Unpacked outlines, so that a task unpacks each but once; a bounded number of them."""

    def __init__(self, size: int = 1000):
        self.size, self.known = size, {}

    def __call__(self, outline: bytes) -> tuple[Tree, set]:
        if outline not in self.known:
            if len(self.known) >= self.size:
                self.known.clear()
            packed, marks = _unpack(outline)
            self.known[outline] = Tree.unpack(packed), set(marks)
        return self.known[outline]


VOTES = "host string, layout long, reference int, slot int, mark long, pages long, chars long, linked long"


def _votes(batches):
    """Of each reference's slots: characters, and those in links (mark 0); and the pages that say the same (by mark).

    Slot -1 counts the pages.
    """
    counts: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])
    known = Outlines()

    def rows():
        columns = list(zip(*((*key, *n) for key, n in counts.items()), strict=True)) or [[]] * 8
        counts.clear()
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in VOTES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for host, layout, body, outlines in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "body", "outlines")), strict=True):
            packed, leaves = _unpack(body)
            page = Tree.unpack(packed)
            for reference in outlines:
                other, marks = known(reference["outline"])
                base = host, layout, reference["reference"]
                partner = match(page, other)
                counts[*base, -1, 0][0] += 1
                said = set()
                for node, text, linked in leaves:
                    slot = partner.get(node)
                    if slot is None:
                        continue
                    own = counts[*base, slot, 0]
                    own[1] += len(text)
                    own[2] += linked
                    mark = mark_of(text)
                    if (slot, mark) in marks:
                        same = counts[*base, slot, mark]
                        same[0] += (slot, mark) not in said
                        same[1] += len(text)
                        same[2] += linked
                        said.add((slot, mark))
        if len(counts) > FLUSHED_AT:
            yield rows()
    yield rows()


def induce(parsed: DataFrame) -> DataFrame:
    """host, layout and wrapper: array of (reference, outline, slots), slots being (slot, mark, chars, linked) with mark 0
    for all that stands in a slot, and otherwise for its constant texts."""
    outlines = cut(references(parsed))
    listed = cut(outlines.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("reference", "outline"))).alias("outlines")))
    votes = parsed.select(*KEY, "body").join(listed, KEY).mapInArrow(_votes, VOTES)
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "linked")]
    votes = cut(votes.groupBy(*KEY, "reference", "slot", "mark").agg(*sums))
    total = votes.where("slot = -1").select(*KEY, "reference", F.col("pages").alias("all_pages"))
    told = votes.where("slot >= 0").join(total, [*KEY, "reference"]).where((F.col("mark") == 0) | (F.col("pages") >= CONSTANT_SHARE * F.col("all_pages")))
    slots = told.groupBy(*KEY, "reference").agg(F.sort_array(F.collect_list(F.struct("slot", "mark", "chars", "linked"))).alias("slots"))
    whole = outlines.join(slots, [*KEY, "reference"])
    return cut(whole.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("reference", "outline", "slots"))).alias("wrapper")))


def region(tree: Tree, chars: dict[int, int], linked: dict[int, int]) -> list[bool]:
    """Whether each node belongs to the article. chars, linked: of the varying text of text nodes, and of it in links."""
    n = len(tree.signature)
    inner = lambda x: (k for k in tree.kids[x].values() if tree.tag[k])
    hard = [False] * n
    for x in range(1, n):
        hard[x] = hard[tree.parent[x]] or tree.kind[x] == HARD
    # sums over what is below each node (parents have smaller numbers), in the second round without what is noise by words
    quiet = hard

    def below(own) -> list[int]:
        out = [0 if quiet[x] else own(x) for x in range(n)]
        for x in range(n - 1, 0, -1):
            out[tree.parent[x]] += out[x]
        return out

    free = lambda x: chars.get(x, 0) - linked.get(x, 0)
    weight = below(free)
    # main parts and articles inside, without those in what is noise by words
    mains, articles, ignored = [0] * n, [0] * n, [True] * n
    for x in range(n - 1, 0, -1):  # from the inside
        mains[x] += tree.members[x] if tree.tag[x] == "main" and not hard[x] else 0
        articles[x] += tree.members[x] if tree.tag[x] == "article" and not hard[x] else 0
        if tree.kind[x]:
            holds = mains[x] > 0 or weight[x] > (MOST_WITH_ARTICLE if articles[x] else MOST) * weight[0]
            one = mains[x] > 0 or articles[x] == 1 or (articles[x] == 0 and weight[x] > MOST_COMMENTS * weight[0])
            ignored[x] = holds and (tree.kind[x] == SOFT or (tree.kind[x] == COMMENTS and one))
        if ignored[x]:
            mains[tree.parent[x]] += mains[x]
            articles[tree.parent[x]] += articles[x]
    quiet = list(hard)
    for x in range(1, n):
        quiet[x] = quiet[x] or quiet[tree.parent[x]] or not ignored[x]

    weight, every = below(free), below(lambda x: chars.get(x, 0))
    root = 0
    while True:
        parts = [k for k in inner(root) if weight[k]]
        best = max(parts, key=weight.__getitem__, default=None)
        if best is None or tree.members[best] > tree.members[root] or tree.tag[best] not in CONTAINERS or weight[best] < REGION_SHARE * weight[root]:
            break
        if tree.tag[root] in MARKED or any(tree.tag[k] in HEADINGS and not quiet[k] for k in parts):
            break  # what a heading stands beside is whole
        root = best
    within = [False] * n
    within[root] = True
    for x in range(root + 1, n):
        within[x] = within[tree.parent[x]] and not quiet[x]
    marks = [x for x in range(n) if within[x] and tree.tag[x] in MARKED]
    outer = [x for x in marks if not any(tree.tag[y] in MARKED for y in _above(tree, x, root))]
    if outer and sum(weight[x] for x in outer) >= MARKED_SHARE * weight[root]:
        chosen = set(outer)
        closer = [x for x in marks if tree.tag[x] == "article" and x not in chosen]
        if closer and sum(weight[x] for x in closer) >= MARKED_SHARE * sum(weight[x] for x in outer):
            chosen = set(closer)  # an article within a main part
        keep = [False] * n
        for x in range(1, n):
            keep[x] = within[x] and (x in chosen or keep[tree.parent[x]])
        return keep
    for x in range(root + 1, n):
        many = max((tree.members[k] for k in inner(x)), default=0) > 1
        teasers = many and not weight[x] >= MARKED_SHARE * weight[root] and every[x] - weight[x] > LINK_SHARE * every[x]
        within[x] = within[x] and within[tree.parent[x]] and not teasers
    return within


def _above(tree: Tree, x: int, top: int):
    while x > top:
        x = tree.parent[x]
        yield x


class Wrapper:
    """What one reference tells of its layout: the nodes of the article, and the constant texts of slots."""

    def __init__(self, tree: Tree, slots: list[dict]):
        self.tree = tree
        self.constant = {(s["slot"], s["mark"]) for s in slots if s["mark"]}
        chars, linked = defaultdict(int), defaultdict(int)
        for s in slots:
            sign = -1 if s["mark"] else 1
            chars[s["slot"]] += sign * s["chars"]
            linked[s["slot"]] += sign * s["linked"]
        self.within = region(tree, chars, linked)


def own_text(page: Tree, leaves: list) -> str:
    """The text of the region that the page's own counts give."""
    chars, linked = defaultdict(int), defaultdict(int)
    for node, text, links in leaves:
        chars[node] += len(text)
        linked[node] += links
    within = region(page, chars, linked)
    return " ".join(text for node, text, _ in leaves if within[node])


def main_text(page: Tree, leaves: list, wrappers: list[Wrapper]) -> str:
    """The content slots' texts in page order."""
    if not wrappers:
        return own_text(page, leaves)
    partners = [match(page, w.tree) for w in wrappers]
    within = [False] * len(page.signature)
    for x in range(len(page.signature)):
        known = [w.within[p[x]] for w, p in zip(wrappers, partners, strict=True) if x in p]
        within[x] = known[0] if known else within[page.parent[x]] and page.kind[x] == 0
    constant = lambda node, text: any((p.get(node), mark_of(text)) in w.constant for w, p in zip(wrappers, partners, strict=True))
    kept = [text for node, text, _ in leaves if within[node] and not constant(node, text)]
    return " ".join(kept) if kept else own_text(page, leaves)


def _extract(batches):
    outlines, known = Outlines(), {}

    def wrapper_of(packed: list[dict]) -> list[Wrapper]:
        key = tuple(w["outline"] for w in packed)
        slots = [w["slots"] for w in packed]
        if key not in known or known[key][0] != slots:
            if len(known) >= outlines.size:
                known.clear()
            known[key] = slots, [Wrapper(outlines(w["outline"])[0], w["slots"]) for w in packed]
        return known[key][1]

    for batch in batches:
        texts = []
        for body, wrapper in zip(batch.column("body").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            packed, leaves = _unpack(body)
            texts.append(main_text(Tree.unpack(packed), leaves, wrapper_of(wrapper) if wrapper else []))
        lengths = pa.array([len(x) for x in texts], pa.int64())
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": lengths})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    parsed = cut(parse(pages))
    return parsed.join(induce(parsed), KEY, "left").select("page_id", "url", "body", "wrapper").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Trees have no counterpart in SQL; the tests compare the matching with a plain one, and the texts with known articles.
ORACLE_SQL = None
