"""Page jobs and text expressions on inline markup."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text as t
from shelfspark.operators import consolidate, pages

CARD = """<html><div class="x jsfb-filterable"><a href="/p/1"><img src="/logo.png"><img src="/uploads/FB-1812-300x300.jpg"></a><h3>Tomatodo</h3>
<p>FB-1812 Muestra: S/ 6.50 Ciento: S/ 520.00 Millar: S/ 5,000.00</p><p>Colores: Dorado, Plateado</p><p>Stock Disponible 6646 7942</p></div>
<div class="jsfb-filterable"><h3>Solo</h3><p>FB-2 Stock Disponible 9409</p></div><div class="jsfb-filterable"><span></span></div></html>"""
DETAIL = """<h1>Jarro</h1><p>FB-77 S/ 1,100.50</p><select name="attribute_color"><option value="amarillo-x">Amarillo</option><option value="azul-x">Azul</option></select>
<form data-product_variations='[{"attributes":{"attribute_pa_color":"amarillo-x"},"max_qty":1520},{"attributes":{"attribute_pa_color":"azul-x"},"max_qty":0},{"attributes":{"attribute_pa_color":"Blanco"},"max_qty":20}]'></form>"""


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expression.alias("x")).first().x


def web(spark, *htmls, url="https://shop.example/c/"):
    return spark.createDataFrame([(k, url, h) for k, h in enumerate(htmls)], "page_id long, url string, html string")


def test_cards(spark):
    got = pages.cards(web(spark, CARD)).orderBy("pos").collect()
    assert len(got) == 2
    a, b = got
    assert (a.code, a.name, a.url) == ("FB-1812", "Tomatodo", "https://shop.example/p/1")
    assert (a.price_sample, a.price_hundred, a.price_thousand) == (6.5, 520.0, 5000.0)
    assert a.color_stock == {"Dorado": 6646, "Plateado": 7942} and a.stock == 14588
    assert a.image_url == "/uploads/FB-1812.jpg"
    assert b.color_stock == {} and b.stock == 9409


def test_detail_and_variations(spark):
    got = pages.details(web(spark, DETAIL, "<h1>Plain</h1>")).orderBy("page_id").collect()
    assert got[0].color_stock == {"Amarillo": 1520, "Azul": 0, "Blanco": 20} and got[0].stock == 1540
    assert (got[0].code, got[0].name, got[0].price) == ("FB-77", "Jarro", 1100.5)
    assert got[1].color_stock == {} and got[1].stock == 0


def test_links(spark):
    html = '<a href="/categoria-producto/jarros-mug/"></a><a href="/categoria-producto/b/">B</a><a href="/categoria-producto/nuevos-productos/">N</a><a href="/categoria-producto/b/">again</a><a class="page-numbers" href="/c/page/2/">2</a><a class="next page-numbers" href="/c/page/2/">›</a>'
    found = web(spark, html)
    assert {(r.name, r.url) for r in pages.categories(found).collect()} == {("Jarros Mug", "/categoria-producto/jarros-mug/"), ("B", "/categoria-producto/b/")}
    assert pages.distinct_links(pages.links(found)).count() == 4
    assert [r.page for r in pages.page_links(found).orderBy("pos").collect()] == ["https://shop.example/c/", "https://shop.example/c/page/2/"]
    assert pages.next_page(found).first().next == "https://shop.example/c/page/2/"


def test_exploration(spark):
    found = web(spark, "aXbxc the nav", "none")
    hits = pages.keyword_in_context(found, ["x"], most=5, before=1, size=3).orderBy("n").collect()
    assert [(r.place, r.context) for r in hits] == [(1, "aXb"), (3, "bxc")]
    assert {r.keyword: r.pages for r in pages.keyword_matrix(found, ["nav", "zz"]).collect()} == {"nav": 1, "zz": 0}
    assert [r.capture for r in pages.distinct_captures(web(spark, "k=b k=a k=b"), "k=(.)").collect()] == ["a", "b"]
    rows = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":3}',), ("bad",)], "props string")
    assert {r.key: r.n for r in pages.json_keys(rows, "props").collect()} == {"a": 2, "b": 1}


@pytest.mark.parametrize(
    ("expression", "value", "want"),
    [
        (t.clean_price, "S/ 1,100.00", 1100.0), (t.clean_price, "gratis", 0.0), (t.numbers_after, "Stock Disponible 1520 0 20", [1520, 0, 20]),
        (t.numbers_after, "stock: 1,200", [1200]), (t.color_list, "Colores: Rojo, Negro, Azul, Gris Gun, y Silver.", ["Rojo", "Negro", "Azul", "Gris Gun", "Silver"]),
        (t.collapse, "  a   b :", "a b"), (t.slug_title, "https://x/y/jarros-mug/", "Jarros Mug"), (t.full_size_image, "/a-300x300.jpg", "/a.jpg"),
        (t.extension, "http://x/a.PNG?v=1", ".png"), (t.extension, "http://x/a", ".jpg"), (t.safe_file_name, "FB/12 é", "FB_12_é"), (t.money, 1234.5, "S/ 1,234.50"),
        (t.or_dash, " ", "—"), (t.elapsed, 3725, "01:02:05"), (t.to_count, "12.9", 12), (t.to_count, "x", 0), (t.to_number, None, 0.0), (t.forward_slashes, "a\\b", "a/b"),
        (t.strip_tags, "<p>a &amp;lt; <b>b</b></p><script>x</script>", "a &lt; b"), (t.all_numbers, "1,200 and 7", [1200.0, 7.0]),
    ],
)
def test_expressions(spark, expression, value, want):
    kind = "double" if isinstance(value, float) else "long" if isinstance(value, int) else "string"
    row = spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("x")).first()
    assert row.x == want


def test_maps_names_and_urls(spark):
    m = spark.createDataFrame([({" Rojo ": 5, "": 1, "Azul": -3, "Rojo": 7},)], "m map<string,int>")
    assert m.select(t.clean_map(F.col("m")).alias("x")).first().x == {"Rojo": 7, "Azul": 0}
    assert m.select(t.map_text(t.clean_map(F.col("m"))).alias("x")).first().x == "Azul=0,Rojo=7"
    j = spark.createDataFrame([('{" Rojo. ": "12", "var acss=1": 3, "Azul": "bad", "Verde": "12.5", "Gris": 12.7, "Negro": -3}',), ("{oops",)], "j string")
    assert [r.x for r in j.select(t.map_from_json(F.col("j")).alias("x")).collect()] == [{"Rojo": 12, "Gris": 12, "Negro": 0}, {}]
    names = {"Rojo": True, "stock": True, "12": False, "12-13": False, "a" * 81: False, "javascript x": False, "color_mode": False, "Choose an option": False, "a=b": True, "a<b": True, "a//b": False, "a,b": True, "a{b": False, "": False}
    d = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.x for r in d.select("n", t.is_color_name(F.col("n")).alias("x")).collect()} == names
    hrefs = {"/a": "https://h/a", "//c/d": "https://c/d", "http://e": "http://e", "f": "https://h/x/f"}
    d = spark.createDataFrame([(k,) for k in hrefs], "h string")
    assert {r.h: r.x for r in d.select("h", t.resolve_url(F.lit("https://h/x/y"), F.col("h")).alias("x")).collect()} == hrefs
    zipped = spark.createDataFrame([(["a", "b"], [1, 2]), (["a", "b", "c"], [1])], "n array<string>, v array<int>")
    assert [r.x for r in zipped.select(consolidate.zip_by_position(F.col("n"), F.col("v")).alias("x")).collect()] == [{"a": 1, "b": 2}, {}]


def variations(spark, json):
    rows = spark.createDataFrame([(1, 0, json)], "page_id long, n int, json string")
    return {(r.color, r.stock) for r in pages.nested_variations(rows).collect()}


def test_variations_at_any_depth(spark):
    assert variations(spark, '{"stock":5,"v":[{"color":"a"},{"color":"b","stock":2}]}') == {("a", 5), ("b", 2)}
    assert variations(spark, '[[{"quantity":"7","x":{"y":{"attribute_Colour":"deep"}}},{"color":{"color":"in"},"max_qty":-4}],{"color":null,"stock":1}]') == {("deep", 7), ("in", 0)}
    assert variations(spark, '{"stock":9,"inner":{"color":"a","stock":2},"list":[{"color":"a","stock":3}]}') == {("a", 9), ("a", 3)}
    assert variations(spark, "{bad") == set() and variations(spark, None) == set() and variations(spark, '"color"') == set()
    assert variations(spark, '{"s":"\\"[{","color":"[]"}') == set()


def test_elements_nest(spark):
    html = '<!-- <p> --><p>a <b>b</b><ul><li>one<ul><li>two</li></ul></li></ul></p></li><script>"<p>"</script><p>open<br/>end'
    found = {(r.tag, r.text) for r in pages.text_blocks(web(spark, html), least=0).collect()}
    assert found == {("p", "a b one two"), ("li", "one two"), ("li", "two"), ("p", "open end")}
    assert {r.text for r in pages.text_blocks(web(spark, html), 100, "TWO", ("ul", "b")).collect()} == {"one two", "two"}
    nested = '<div class="jsfb-filterable"><h3>Outer</h3><div class="jsfb-filterable"><h3>Inner</h3><p>FB-9</p></div><p>FB-8 Stock 4</p></div>'
    got = {(r.code, r.name, r.stock) for r in pages.cards(web(spark, nested)).collect()}
    assert got == {("FB-8", "Outer", 4), ("FB-9", "Inner", 0)}


def test_colors_of_pages(spark):
    swatches = '<div class="product-color" title="Rojo" data-stock="4"></div><span id="color-b">Azul</span><div class="colors"><select name="pa_color"><option value="v" data-quantity="2.9">Verde</option><option value="">Choose an option</option></select></div>'
    order = '<p>Colores: Rojo, Negro</p><p>Stock Disponible 5</p><form data-product_variations="{&quot;stock&quot;:3,&quot;v&quot;:[{&quot;color&quot;:&quot;V&quot;}]}"></form>'
    got = {r.page_id: (r.colors, r.color_stock) for r in pages.colors_of(web(spark, swatches, order + swatches, "<p>Colores: Rojo, Negro</p>", "none")).collect()}
    assert got[0] == (["Verde", "Rojo", "Azul"], {"Verde": 2, "Rojo": 4, "Azul": 0})
    assert got[1] == (["Rojo", "Negro", "Verde", "Azul"], {"Rojo": 4, "Negro": 0, "Verde": 3, "Azul": 0})
    assert got[2] == (["Rojo", "Negro"], {"Rojo": 0, "Negro": 0}) and 3 not in got


SHOP = "https://shop.example"


def shop_page(*cards, links=""):
    return "<html>" + "".join(f'<article class="jsfb-filterable">{c}</article>' for c in cards) + links + "</html>"


def card(code, path, text=""):
    return f'<a href="/producto/{path}/"><h2>{code} name</h2></a><p>{code}</p><div>{text}</div>'


def test_page_pipeline(spark):
    """Pages of categories to product rows: pagination, shared pages, one detail for each code, precedence by field."""
    web_ = [
        ("/c/a/", shop_page(card("FB-1", "one", "Stock Disponible 6646 7942"), card("FB-2", "two", "Stock Disponible 5364"), links='<a class="page-numbers" href="/c/a/2/">2</a><a class="page-numbers" href="/c/a/9/">9</a>')),
        ("/c/a/2/", shop_page(card("FB-3", "three"), "<p>FB-4</p>")),
        ("/c/b/", shop_page(card("fb", "other"), card("FB-1", "another-one", "Stock Disponible 1 2"))),
        ("/producto/one/", "<h1>One</h1><p>FB-1</p><div>Colores: Dorado, Plateado</div>"),
        ("/producto/two/", "<h1>Two</h1><div>Colores: A, B, C, D y E</div>"),
        ("/producto/three/", '<h1>Three</h1><form data-product_variations=\'{"stock":5,"v":[{"color":"a"},{"color":"b","stock":2}]}\'></form>'),
        ("/c/empty/", "<html></html>"),
    ]
    rows = spark.createDataFrame([(k, SHOP + u, h) for k, (u, h) in enumerate(web_)], "page_id long, url string, html string")
    names = ["/c/a/", "/c/b/", "/c/missing/", "/c/empty/"]
    categories = spark.createDataFrame([(n, SHOP + n, k) for k, n in enumerate(names)], "name string, url string, at int")
    made = pages.page_rows(categories, rows)
    got = [(r.category, r.code, r.stock, r.color_stock, r.url.removeprefix(SHOP)) for r in made.orderBy("at", "page_no", "pos").collect()]
    assert got == [
        ("/c/a/", "FB-1", 14588, {"Dorado": 6646, "Plateado": 7942}, "/producto/one/"), ("/c/a/", "FB-2", 5364, {}, "/producto/two/"),
        ("/c/a/", "FB-3", 7, {"a": 5, "b": 2}, "/producto/three/"), ("/c/a/", "FB-4", 0, {}, "/c/a/2/"),
        ("/c/b/", "", 0, {}, "/producto/other/"), ("/c/b/", "FB-1", 3, {"Dorado": 1, "Plateado": 2}, "/producto/another-one/"),
    ]
    told = {r.category: (r.pages, r.cards, r.products, r.error) for r in pages.with_sum(pages.outcomes(categories, rows, made)).collect()}
    assert told == {
        "/c/a/": (2, 4, 4, "pages are missing"), "/c/b/": (1, 2, 1, "cards without a code"), "/c/missing/": (0, 0, 0, "no page"), "/c/empty/": (1, 0, 0, "no cards"), None: (4, 6, 5, "4"),
    }


def test_times_as_text(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05.123456",), ("2024-01-02 03:04:05",), ("2024-01-02T03:04:05+02:00",), ("2024-01-02",), ("x",), (None,)], "v string")
    got = [r.x for r in rows.select(t.iso_text(t.iso_time(F.col("v"))).alias("x")).collect()]
    assert got == ["2024-01-02T03:04:05.123456", "2024-01-02T03:04:05.000000", "2024-01-02T01:04:05.000000", "2024-01-02T00:00:00.000000", None, None]
