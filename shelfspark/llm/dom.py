"""A page as a small tree of blocks and text runs, and simple tree matching of two such trees.

Siblings of one signature (element, first class word, kind of noise) are one node, a list of records; so a tree has a
node for each distinct path, and no node has two children that could be matched with the same one.  Simple tree
matching then has one candidate for each child, and its best order-preserving choice is a heaviest increasing
sequence: exact in n log n for trees of any depth and lists of any length.

Reading a page takes time in proportion to its length, whatever its markup.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements by what they do to the text around and inside them.
BLOCKS = set("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe li main menu nav noscript object ol option p pre script section select style summary svg table tbody td template textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript xmp".split())
CLOSES_P = BLOCKS - set("body button head html iframe noscript object option script select style svg template textarea title".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
ROWS = ("tr", "thead", "tbody", "tfoot")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold an article rather than a piece of it.
CONTAINERS = set("html body div section main article center form fieldset table tbody tr td figure blockquote details ul ol dl li".split())
#: Elements, roles and words of class or id that mark what is not the article.
NOISE_TAGS = set("nav footer aside form script style noscript template iframe svg button select textarea object dialog menu head title audio video canvas".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NOISE_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion widget widgets pagination pager footer skip".split())
#: Words are weaker signs than elements and roles, but for comments.
SOFT_ROLES, COMMENT_WORDS = {"form", "search", "alert"}, set("comment comments commentlist disqus reply replies respond discussion".split())
HARD, SOFT, COMMENTS = 1, 2, 3
KEPT_WHOLE = set("html body article main".split())
TEXT = zlib.crc32(b"#text")


def _open_tag(tag: str, attributes: str) -> tuple[int, int, bool]:
    """Signature, kind of noise (0: none), and whether it is noise only outside an article (a header)."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), value.strip("\"'"))
    words = found.get("class", "").split()
    role = found.get("role", "").lower()
    marks = {t.lower() for t in TOKENS.findall(found.get("class", "") + " " + found.get("id", ""))}
    kind = 0
    if tag not in KEPT_WHOLE:
        noise = (tag in NOISE_TAGS and tag != "form") or (role in NOISE_ROLES and role not in SOFT_ROLES) or "hidden" in found or found.get("aria-hidden") == "true"
        noise |= "display:none" in found.get("style", "").replace(" ", "").lower()
        soft = tag == "form" or role in SOFT_ROLES or marks & NOISE_WORDS
        kind = HARD if noise else COMMENTS if marks & COMMENT_WORDS else SOFT if soft else 0
    signature = zlib.crc32(f"{tag}.{words[0] if words else ''}.{kind}".encode("utf-8", "surrogatepass"))
    return signature, kind, tag not in KEPT_WHOLE and (tag == "header" or "header" in marks)


_cached = lru_cache(50_000)(_open_tag)


def mark_of(text: str) -> int:
    """A number for a text, by which texts of one slot are compared; never 0."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) | (len(text) + 1) << 32


class Tree:
    """Nodes in the order of their first member: signature, parent, tag, kind of noise and number of members."""

    def __init__(self) -> None:
        self.signature, self.parent, self.tag, self.kind, self.members = [0], [-1], [""], [0], [1]
        self.kids: list[dict[int, int]] = [{}]

    def child(self, parent: int, signature: int, tag: str, kind: int) -> int:
        node = self.kids[parent].get(signature)
        if node is None:
            node = self.kids[parent][signature] = len(self.signature)
            self.signature.append(signature)
            self.parent.append(parent)
            self.tag.append(tag)
            self.kind.append(kind)
            self.members.append(0)
            self.kids.append({})
        self.members[node] += 1
        return node

    def packed(self) -> tuple:
        return self.signature, self.parent, self.tag, self.kind, self.members

    @classmethod
    def unpack(cls, packed: tuple) -> Tree:
        tree = cls()
        tree.signature, tree.parent, tree.tag, tree.kind, tree.members = packed
        tree.kids = [{} for _ in tree.signature]
        for node in range(1, len(tree.signature)):
            tree.kids[tree.parent[node]][tree.signature[node]] = node
        return tree

    def layout(self) -> int:
        """The page's outline: the signatures of the first level that has several elements."""
        node = 0
        while True:
            inner = [k for k in self.kids[node].values() if self.tag[k] not in ("", "head")]
            if len(inner) != 1:
                names = sorted(self.signature[k] for k in inner)
                return zlib.crc32(",".join(map(str, names)).encode())
            node = inner[0]


def _tag_end(source: str, at: int, last: dict[str, int]) -> int:
    """Where the tag's ``>`` stands, outside quoted values; -1 if it has none. last: the last place of each quote."""
    while True:
        m = STOP.search(source, at)
        if m is None:
            return -1
        at = m.end()
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while before >= 0 and source[before].isspace():
            before -= 1
        if source[before] == "=" and at <= last[m[0]]:
            at = source.find(m[0], at) + 1


class Page(Tree):
    """A tree, and leaves: (node, text, characters of it that are links) of each text run, in page order."""

    def __init__(self, source: str):
        super().__init__()
        self.leaves: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int, bool, bool]] = []  # tag, node inside, in a link, in an article or a main part
        opened: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        blocks: list[int] = []  # places in the stack of elements with a node of their own
        buffer: list[str] = []
        linked = at = 0
        n = len(source)
        last = {q: source.rfind(q) for q in "\"'"}

        def state() -> tuple[int, bool, bool]:
            return stack[-1][1:] if stack else (0, False, False)

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join(html.unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    self.leaves.append((self.child(state()[0], TEXT, "", 0), text, min(linked, len(text))))
            linked = 0

        def pop(k: int) -> None:
            if blocks and blocks[-1] >= k:
                flush()
            for tag, *_ in stack[k:]:
                opened[tag].pop()
            while blocks and blocks[-1] >= k:
                blocks.pop()
            del stack[k:]

        def nearest(tags: tuple[str, ...]) -> int:
            return max((opened[t][-1] for t in tags if opened[t]), default=-1)

        while at < n:
            start = source.find("<", at)
            upto = start if start >= 0 else n
            if upto > at:
                buffer.append(source[at:upto])
                if state()[1]:
                    linked += upto - at
            if start < 0:
                break
            if source.startswith(("<!", "<?"), start):
                comment = source.startswith("<!--", start)
                end = source.find("-->" if comment else ">", start + (2 if comment else 1))
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            closing = source.startswith("/", start + 1)
            name = NAME.match(source, start + 1 + closing)
            if name is None:
                buffer.append("<")
                at = start + 1
                continue
            tag = name[0].lower()
            end = _tag_end(source, name.end(), last)
            if end < 0:
                break  # the page ends inside a tag
            at = end + 1
            if closing:
                if opened[tag]:
                    pop(opened[tag][-1])
                continue
            if tag in VOID:
                if tag == "br":
                    buffer.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in RAW:
                flush()
                inner = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                close = source.find(">", inner.end()) if inner else -1
                at = close + 1 if close >= 0 else n
                continue
            attributes = source[name.end() : end]
            signature, kind, header = (_cached if len(attributes) < 500 else _open_tag)(tag, attributes)
            if tag in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
                pop(blocks[-1])
            if tag in CLOSES:
                k = nearest(CLOSES[tag])
                while k > nearest(SCOPES[tag]):
                    pop(k)
                    k = nearest(CLOSES[tag]) if tag in ROWS else -1
            node, link, inside = state()
            if header and not inside:
                kind = HARD
            if tag in BLOCKS or kind:
                flush()
                node = self.child(node, zlib.crc32(b"%d" % kind, signature), tag, kind)
                blocks.append(len(stack))
            opened[tag].append(len(stack))
            stack.append((tag, node, link or tag == "a", inside or tag in ("article", "main")))
        flush()


def heaviest(places: list[int], weights: list[int]) -> list[int]:
    """Which of ``places`` make the heaviest increasing sequence."""
    if all(a < b for a, b in zip(places, places[1:], strict=False)):
        return list(range(len(places)))
    # ends: sums in increasing order, each with the smallest place that a sequence of that weight or more can end at
    ends: list[int] = []
    total: list[int] = []
    member: list[int] = []
    before = [-1] * len(places)
    for k, (place, weight) in enumerate(zip(places, weights, strict=True)):
        i = bisect_left(ends, place)
        own = weight + (total[i - 1] if i else 0)
        before[k] = member[i - 1] if i else -1
        j = i
        while j < len(ends) and total[j] <= own:
            j += 1
        ends[i:j], total[i:j], member[i:j] = [place], [own], [k]
    out, k = [], member[-1] if member else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def match(a: Tree, b: Tree) -> dict[int, int]:
    """The largest simple tree matching: nodes of ``b`` by nodes of ``a``, roots matched with each other."""
    pairs, place = [(0, 0)], {0: 0}
    for x, y in pairs:  # grows: all nodes with equal paths
        for signature, u in a.kids[x].items():
            v = b.kids[y].get(signature)
            if v is not None:
                pairs.append((u, v))
    for _, y in pairs:
        for k, v in enumerate(b.kids[y].values()):
            place[v] = k
    partner = dict(pairs)
    weight: dict[int, int] = {}
    chosen: dict[int, list[int]] = {}
    for x, _ in reversed(pairs):
        inner = [u for u in a.kids[x].values() if u in partner]
        chosen[x] = [inner[k] for k in heaviest([place[partner[u]] for u in inner], [weight[u] for u in inner])]
        weight[x] = 1 + sum(weight[u] for u in chosen[x])
    out, todo = {}, [0]
    while todo:
        x = todo.pop()
        out[x] = partner[x]
        todo += chosen[x]
    return out
