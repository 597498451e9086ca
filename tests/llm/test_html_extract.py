import random
import time

import pytest

from shelfspark.llm import html_extract
from shelfspark.llm.dom import Page, Tree, heaviest, match

PAGE = "page_id long, url string, html string, host string"


def run(spark, rows):
    got = html_extract.extract(spark.createDataFrame([(*r, "clash") for r in rows], PAGE)).collect()
    return {r.page_id: r.text for r in got}, got


def own(source):
    page = Page(source)
    return html_extract.own_text(page, page.leaves)


def test_roles_and_markup(spark):
    html = (
        '<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>'
        '<div id="cookie-notice">We use</div><div class=content><h2>A &amp; B</h2><ul><li>one<li>two</ul><p>x<b>y</b>\n z'
        '<form><p>q</form><section class="commentList"><p>nice</section></div><aside>s</aside><script>var a="</p>";</script></body>'
    )
    texts, got = run(spark, [(1, "http://a.b/c", html), (2, None, None), (3, "http://a.b/d", ""), (3, "http://a.b/d", "")])
    assert texts == {1: "A & B one two xy z", 2: "", 3: ""}
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)


def test_constant_slots_become_template(spark):
    page = "<body><div><p>Follow our channel</p></div><div><p>{}</p></div><div><p>All prices include tax</p></div></body>"
    rows = [(k, f"http://shop.example/{k}", page.format(f"story number {k}")) for k in range(12)]
    rows += [(100, "http://other.example/", page.format("alone"))]
    texts, _ = run(spark, rows)
    assert all(texts[k] == f"story number {k}" for k in range(12))
    assert texts[100] == "Follow our channel alone All prices include tax"


def test_article_wins_and_long_lists_align(spark):
    one = "<nav>m</nav><article><h1>H</h1>" + "".join(f"<p>p{k}</p>" for k in range(300)) + "<footer>f</footer></article><p>outside</p>"
    texts, _ = run(spark, [(1, "http://a.b/", one)])
    assert texts[1] == "H " + " ".join(f"p{k}" for k in range(300))


def test_wrappers_of_the_whole_page_are_no_noise():
    body, related = "<h1>H</h1><p>" + "long enough " * 20 + "</p>", '<div class="related"><article>teaser</article></div>'
    whole = "H " + ("long enough " * 20).strip()
    for tag in ("<form>", "<div class='layout has-sidebar'>", "<div id='with-comments'>", "<div class='social'>", "<div class='share'>", "<div class='widget'>"):
        page = f"{tag}<article>{body}</article>{related}<aside>a</aside></{tag[1:].split()[0].rstrip('>')}>"
        assert own(page) == whole, tag
    assert own(f"<form><div>{body}</div></form>") == whole
    comments = "<ol class='comment-list'>" + f"<li><article>{body}</article>" * 2 + "</ol>"
    assert own(f"<div><p>own</p></div>{comments}") == "own"


@pytest.mark.parametrize("name", ["content share", "post widget", "article-discussion", "content notice", "main skip"])
def test_words_do_not_silence_the_text(name):
    text = "A long enough sentence of the story. " * 5
    assert own(f"<nav><a>m</a></nav><div class='{name}'><h1>H</h1><p>{text}</p></div><footer>f</footer>") == "H " + text.strip()
    assert own(f"<div><h1>H</h1><p>{text}</p></div><div class='comments'><p>{text}</p></div>") == "H " + text.strip()


def test_region_by_induction_without_marks(spark):
    """No element, role or word says which part is the article: what varies most is."""
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["river", "stone", "walked", "house", "evening", "light"]) for _ in range(n))
    page = "<body><div class=a><p>Welcome to our site</p><p>{}</p></div><div class=b><h1>{}</h1><div><p>{}</p><p>{}</p></div></div><div class=c><p>{}</p><p>All rights</p></div></body>"
    rows, want = [], {}
    for k in range(12):
        parts = [say(3), f"title {k} {say(3)}", say(60), say(40), say(4)]
        rows.append((k, f"http://a.b/{k}", page.format(*parts)))
        want[k] = " ".join(parts[1:4])
    # another layout of the same host, with its own constant texts
    for k in range(20, 28):
        story = f"{k} {say(50)}"
        rows.append((k, f"http://a.b/{k}", f"<body><table><tr><td>Forum rules</td></tr></table><div class=z><p>{story}</p><p>Posted by us</p></div></body>"))
        want[k] = story
    texts, _ = run(spark, rows)
    assert texts == want


def plain_score(a, x, b, y):
    """Simple tree matching by its definition, over all pairs of children."""
    if a.signature[x] != b.signature[y]:
        return 0
    left, right = list(a.kids[x].values()), list(b.kids[y].values())
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, u in enumerate(left):
        for j, v in enumerate(right):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_score(a, u, b, v))
    return best[-1][-1] + 1


def test_matching_against_a_plain_one():
    rng = random.Random(4)

    def markup(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice("xyz")
        return "".join(f"<div class={rng.choice('abcd')}>{markup(depth - 1)}</div>" for _ in range(rng.randint(0, 5)))

    for _ in range(150):
        a, b = Page(markup(3)), Page(markup(3))
        pairs = match(a, b)
        assert len(pairs) == plain_score(a, 0, b, 0)
        assert all(a.signature[x] == b.signature[y] and (x == 0 or pairs[a.parent[x]] == b.parent[y]) for x, y in pairs.items())
        for x in pairs:
            inner = [pairs[u] for u in a.kids[x].values() if u in pairs]
            assert inner == sorted(inner, key=list(b.kids[pairs[x]].values()).index)
    for _ in range(200):
        places, weights = rng.sample(range(12), 8), [rng.randint(1, 4) for _ in range(8)]
        rising = lambda s: all(places[i] < places[j] for i, j in zip(s, s[1:], strict=False))  # noqa: B023, E731
        subsets = ([k for k in range(8) if m >> k & 1] for m in range(256))
        got = heaviest(places, weights)
        assert rising(got) and sum(weights[k] for k in got) == max(sum(weights[k] for k in s) for s in subsets if rising(s))


def test_long_lists_align():
    paragraphs = "".join(f"<p>{k}</p>" for k in range(2001))
    a, b = Page(f"<div>{paragraphs}</div>"), Page(f"<div>{'<h2>x</h2>' * 100}{paragraphs}</div>")
    pairs = match(a, b)
    assert sum(node in pairs for node, *_ in a.leaves) == 2001


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<p title="', "<b>", "</b>", "<li>", "<p><b>", "<ul><li>", "<div class=x>", "<!", "<!--", "<script>", "</", "<p>x", "<table><tr><td>", "<a href=x>y"])
def test_hard_markup_takes_time_by_its_length(piece):
    began = time.perf_counter()
    page = Page(piece * (600_000 // len(piece)))
    html_extract.own_text(page, page.leaves)
    assert time.perf_counter() - began < 10  # hours if it grew with the square


def test_lists_of_any_length():
    began = time.perf_counter()
    a = Page("".join(f"<div class=c{k}>{k}</div>" for k in range(20_000)))
    b = Page("".join(f"<div class=c{k}>{k}</div>" for k in reversed(range(20_000))))
    assert len(match(a, a)) == 40_001 and len(match(a, b)) == 3
    assert time.perf_counter() - began < 10


def test_defined_cases(spark):
    """Repeated rows, ties of the order, null ids and urls, a very long page."""
    long = "<div>" * 3000 + "".join(f"<p>w{k}</p>" for k in range(50_000)) + "</div>" * 3000
    rows = [(1, None, "<p>a</p>")] * 7 + [(None, "x", "<p>n</p>"), (5, "http://l.o/", long)]
    _, got = run(spark, rows)
    assert sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in got) == sorted([(1, "a", 1)] * 7 + [(0, "n", 1), (5, "w0 w1 w2 ", 338889)])


def test_empty_table(spark):
    assert html_extract.extract(spark.createDataFrame([], PAGE)).count() == 0
