"""Jobs over tables of pages: links, categories, cards, details, and keyword reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text as t
from shelfspark.operators.audit import detail_key
from shelfspark.operators.elements import attribute, by_page, elements, outer_html, own_html, tasks_for
from shelfspark.sources.tables import kept

ANCHOR = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
CARD_MARK = "(?i)jsfb-filterable"
#: Keys of a stock in variation data and attributes with one, elements that are no colors.
STOCK_KEYS = ("max_qty", "max_quantity", "stock", "quantity", "stock_quantity")
STOCK_ATTRIBUTES = ("data-stock", "data-quantity", "data-max-qty", "data-max_quantity")
NO_COLOR_TAGS = ("select", "option", "script", "style", "noscript", "template")
#: Links that are no categories, and images that are no products.
EXCLUDED = "nuevos-productos"
NO_PRODUCT = ("logo", "placeholder")


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href and label of every anchor, in document order."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), 2).alias("label"))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "a"))
    return rows.select("page_id", "url", "pos", F.col("a.href").alias("href"), t.strip_tags(F.col("a.label")).alias("label"))


def distinct_links(found: DataFrame) -> DataFrame:
    """Each page's links once, at their first place."""
    return found.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))


def link_counts(found: DataFrame) -> DataFrame:
    return distinct_links(found).groupBy("href").agg(F.count("*").alias("pages"))


def categories(pages: DataFrame, pattern: str = "/categoria-producto/") -> DataFrame:
    """name and url of the links under a path; the first place of a url wins, an empty label is made from the url."""
    found = links(pages).where(F.contains("href", F.lit(pattern)) & ~F.contains("href", F.lit(EXCLUDED)) & (F.col("href") != ""))
    first = found.groupBy("href").agg(F.min(F.struct("page_id", "pos", "label")).alias("f"))
    name = F.when(F.col("f.label") != "", F.col("f.label")).otherwise(t.slug_title(F.col("href")))
    return first.select(name.alias("name"), F.col("href").alias("url"))


def page_links(pages: DataFrame, marker: str = "page-numbers") -> DataFrame:
    """url and page of a category's own address first, then its pagination links, resolved, each once (one hop)."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*>)"), 1)
    rows = pages.select("url", F.posexplode_outer(F.filter(anchors, lambda a: F.contains(a, F.lit(marker)))).alias("pos", "a"))
    href = F.regexp_extract("a", r'href="([^"]*)"', 1)
    linked = rows.where(href != "").select("url", (F.col("pos") + 1).alias("pos"), t.resolve_url(F.col("url"), href).alias("page"))
    own = pages.select("url", F.lit(0).alias("pos"), F.col("url").alias("page"))
    return own.unionByName(linked).groupBy("url", "page").agg(F.min("pos").alias("pos"))


def next_page(pages: DataFrame) -> DataFrame:
    tag = F.regexp_extract("html", r'(?is)(<a\s[^>]*class="[^"]*next[^"]*"[^>]*>)', 1)
    href = F.regexp_extract(tag, r'href="([^"]*)"', 1)
    return pages.where(href != "").select("url", t.resolve_url(F.col("url"), href).alias("next"))


def best_image(images: Column, code: Column) -> Column:
    """Of candidate addresses: no inline data, logos or placeholders; one with the code, then an upload, then the first."""
    usable = F.filter(images, lambda u: (u != "") & ~u.startswith("data:") & ~F.lower(u).rlike("|".join(NO_PRODUCT)))
    with_code = F.filter(usable, lambda u: (code != "") & F.contains(F.lower(u), F.lower(code)))
    uploaded = F.filter(usable, lambda u: F.contains(u, F.lit("/uploads/")))
    return t.full_size_image(F.coalesce(F.get(with_code, F.lit(0)), F.get(uploaded, F.lit(0)), F.get(usable, F.lit(0)), F.lit("")))


def _images(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<img\s[^>]*?src="([^"]*)"'), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def card_numbers(card: Column, said: Column) -> Column:
    """The stock numbers that a card shows: those of its block of variations, or else of its text."""
    block = F.regexp_extract(card, r"(?is)variaciones-producto[^>]*>(.*?)</div>", 1)
    listed = F.transform(F.regexp_extract_all(block, F.lit(r">\s*(\d+)\s*<"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.when(F.size(listed) > 0, listed).otherwise(t.numbers_after(said))


def cards(pages: DataFrame) -> DataFrame:
    """One row for each product card of a page, without the cards inside it; cards with neither code nor name go."""
    pages = by_page(pages)
    marked = elements(pages, "div", "article").where(F.col("tag").rlike(CARD_MARK))
    rows = own_html(pages, marked).select("page_id", F.col("url").alias("page_url"), "pos", F.col("html").alias("card"))
    said = t.strip_tags(F.col("card"))
    link = F.regexp_extract("card", r"""(?is)<a\s[^>]*href=["']([^"']*/producto/[^"']*)["']""", 1)
    rows = rows.withColumns(
        {
            "text": said, "code": F.regexp_extract(said, r"\b(FB-[A-Za-z0-9-]+)", 1), "name": t.element_text(F.col("card"), "h1", "h2", "h3", "h4"),
            "url": t.resolve_url(F.col("page_url"), F.regexp_extract("card", r'(?is)<a\s[^>]*href="([^"]*)"', 1)),
            "detail_url": F.when(link != "", t.resolve_url(F.col("page_url"), link)),
        }
    )
    numbers, colors = card_numbers(F.col("card"), F.col("text")), t.color_list(F.regexp_replace(t.element_lines(F.col("card")), "[ \t]+", " "))
    rows = rows.withColumns({"numbers": numbers, "colors": colors})
    zipped = F.when((F.size("colors") > 0) & (F.size("colors") == F.size("numbers")), F.map_from_arrays("colors", "numbers"))
    empty = F.create_map().cast("map<string,int>")
    price = {k: t.price_by_label(F.col("text"), w) for k, w in (("price_sample", "Muestra"), ("price_hundred", "Ciento"), ("price_thousand", "Millar"))}
    described = t.description_lines(t.element_lines(F.col("card")), F.col("name"), F.col("code"))
    return rows.where((F.col("code") != "") | (F.col("name") != "")).select(
        "page_id", "pos", "code", "name", "url", "detail_url", described.alias("description"), *[v.alias(k) for k, v in price.items()],
        total(F.col("numbers")).alias("stock"), "numbers", F.coalesce(zipped, empty).alias("color_stock"), best_image(_images(F.col("card")), F.col("code")).alias("image_url"),
    )


def _unquoted(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))


def variation_data(pages: DataFrame) -> DataFrame:
    """page_id, n and json: what pages say of variations, in attributes and in scripts that are JSON as a whole."""
    double, single = (F.regexp_extract_all("html", F.lit(rf"(?is)data-product_variations={q}([^{q}]*){q}"), F.lit(1)) for q in ('"', "'"))
    scripts = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>(.*?)</script"), F.lit(1)), lambda x: F.contains(F.lower(x), F.lit("variation")))
    said = F.concat(F.transform(F.concat(double, single), _unquoted), scripts)
    return pages.select("page_id", F.posexplode(said).alias("n", "json"))


def nesting(json: Column) -> Column:
    """How deep objects and lists lie in one another."""
    bare = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + 1).alias("most"))
    return F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def nested_variations(data: DataFrame) -> DataFrame:
    """page_id, path, color and stock of every object with a color, at any depth, in data (page_id, n, json).

    An object's stock is its own or that of the nearest object above it; an object right inside another one (not in a
    list) also shows that one's stock, and the larger counts.  One step descends one level for all pages, and there are
    as many as the deepest data has levels.
    """
    level = data.select(
        "page_id", F.array("n").alias("path"), F.try_parse_json("json").alias("v"), F.lit(None).cast("int").alias("above"), F.lit(None).cast("int").alias("shown")
    ).where("v IS NOT NULL")
    deepest = data.where(F.try_parse_json("json").isNotNull()).agg(F.max(nesting(F.col("json")))).first()[0] or 0
    found = None
    for _ in range(deepest):
        entries = F.map_entries(F.from_json(F.to_json("v"), "map<string,string>"))
        is_object = F.schema_of_variant("v").startswith("OBJECT")
        stocks = F.filter(F.transform(F.filter("entries", lambda e: F.lower(e["key"]).isin(*STOCK_KEYS)), lambda e: e["value"].try_cast("double").try_cast("int")), lambda x: x.isNotNull())
        colors = F.filter("entries", lambda e: F.lower(e["key"]).rlike("colou?r") & e["value"].isNotNull() & ~e["value"].rlike(r"^[\[{]"))
        rows = level.withColumn("entries", F.when(is_object, entries))
        rows = rows.withColumn("own", F.when(F.col("entries").isNotNull(), F.coalesce(F.get(stocks, F.lit(0)), F.col("above"))).otherwise(F.col("above")))
        rows = rows.withColumn("shown", F.when(F.col("entries").isNotNull(), F.greatest("own", "shown")))
        here = rows.where(F.size(colors) > 0).select("page_id", "path", F.get(colors, F.lit(0))["value"].alias("color"), F.greatest(F.coalesce("shown", F.lit(0)), F.lit(0)).alias("stock"))
        found = here if found is None else found.unionByName(here)
        inside = data.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("p"), F.col("value").alias("w"))
        in_object = F.col("entries").isNotNull() & F.schema_of_variant("w").startswith("OBJECT")
        level = rows.lateralJoin(inside).select("page_id", F.concat("path", F.array("p")).alias("path"), F.col("w").alias("v"), F.col("own").alias("above"), F.when(in_object, F.col("shown")).alias("shown"))
        level = level.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
    return found if found is not None else data.select("page_id", F.array("n").alias("path"), F.lit("").alias("color"), F.lit(0).alias("stock")).limit(0)


_COLORED = r"""(?i)\s(?:name|id|class|data-attribute_name)\s*=\s*["'][^"']*colou?r"""


def _tag_stock(tag: Column) -> Column:
    return F.coalesce(*[F.btrim(attribute(tag, k)).try_cast("double").try_cast("int") for k in STOCK_ATTRIBUTES])


def _options(pages: DataFrame) -> DataFrame:
    """page_id, pos, k, value, label and stock of the options of selects of colors."""
    selects = outer_html(pages, elements(pages, "select").where(F.col("tag").rlike(_COLORED)))
    option = r"(?is)(<option\b[^>]*>)(.*?)(?=</option|<option|</select|$)"
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(option), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(option), F.lit(2)).alias("said"))
    rows = selects.select("page_id", "pos", F.posexplode(both).alias("k", "o"))
    value, said = F.btrim(F.coalesce(attribute(F.col("o.tag"), "value"), F.lit(""))), t.strip_tags(F.col("o.said"))
    return rows.select("page_id", "pos", "k", value.alias("value"), F.when(said != "", said).otherwise(value).alias("label"), _tag_stock(F.col("o.tag")).alias("stock"))


def _swatches(pages: DataFrame) -> DataFrame:
    """page_id, pos, color and stock of other elements whose names speak of colors."""
    colored = elements(pages).where(F.col("tag").rlike(_COLORED) & ~F.col("name").isin(*NO_COLOR_TAGS))
    rows = outer_html(pages, colored).where(~F.col("html").rlike(rf"(?i)<({'|'.join(NO_COLOR_TAGS)})\b"))
    direct = t.strip_tags(F.regexp_replace(F.regexp_replace("html", r"(?s)^<[^>]*>", ""), r"(?is)<([a-z][a-z0-9]*)\b[^>]*>.*?</\1\s*>", " "))
    color = F.coalesce(*[F.nullif(attribute(F.col("tag"), k), F.lit("")) for k in ("data-value", "data-color", "title")], direct)
    return rows.select("page_id", "pos", color.alias("color"), _tag_stock(F.col("tag")).alias("stock")).where("color <> ''")


def colors_of(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """page_id, colors (in the order in which they are met) and color_stock of pages that name any.

    A list of colors in the text counts alone if the text has as many stock numbers, or none.  Otherwise colors come from
    the text, selects, other elements and variation data, with the largest stock that any of them says; if the text has as
    many numbers as there are colors, these are the stocks.
    """
    said = t.strip_tags(F.col("html"))
    texts = pages.select("page_id", t.color_list(F.regexp_replace(t.element_lines(F.col("html")), "[ \t]+", " ")).alias("listed"), t.numbers_after(said).alias("numbers"))
    texts = texts.withColumn("exact", (F.size("listed") > 0) & ((F.size("listed") == F.size("numbers")) | (F.size("numbers") == 0)))
    place = lambda *c: F.array(*[F.col(x).cast("int") if isinstance(x, str) else x for x in c]).alias("place")
    options = _options(pages)
    sources = [
        texts.select("page_id", "listed", "numbers", F.posexplode("listed").alias("k", "color")).select("page_id", place(F.lit(0), "k"), "color", F.when(F.size("listed") == F.size("numbers"), F.get("numbers", F.col("k"))).alias("stock")),
        options.select("page_id", place(F.lit(1), "pos", "k"), F.col("label").alias("color"), "stock"),
        _swatches(pages).select("page_id", place(F.lit(2), "pos"), "color", "stock"),
        nested_variations(variation_data(pages)).select("page_id", F.concat(F.array(F.lit(3)), "path").alias("place"), "color", "stock"),
    ]
    rows = sources[0]
    for x in sources[1:]:
        rows = rows.unionByName(x)
    rows = rows.repartition(tasks or tasks_for(pages), "page_id")
    labels = options.where("value <> '' AND label <> ''").groupBy("page_id", F.lower("value").alias("low")).agg(F.max_by("label", place("pos", "k")).alias("label"))
    rows = rows.withColumn("color", t.collapse(F.col("color"))).where(t.is_color_name(F.col("color"), commas=False)).withColumn("low", F.lower("color"))
    rows = rows.join(labels.hint("merge"), ["page_id", "low"], "left").withColumn("color", F.coalesce("label", "color"))
    rows = rows.join(texts.select("page_id", "numbers", "exact"), "page_id").where(~F.col("exact") | (F.col("place")[0] == 0))
    best = rows.groupBy("page_id", "color").agg(F.min("place").alias("place"), F.max(F.greatest(F.coalesce("stock", F.lit(0)), F.lit(0))).alias("stock"), F.first("numbers").alias("numbers"), F.first("exact").alias("exact"))
    by_page = best.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "color", "stock"))).alias("c"), F.first("numbers").alias("numbers"), F.first("exact").alias("exact"))
    colors, stocks = F.transform("c", lambda x: x["color"]), F.transform("c", lambda x: x["stock"])
    shown = ~F.col("exact") & (F.size("numbers") == F.size("c"))
    return by_page.select("page_id", colors.alias("colors"), F.map_from_arrays(colors, F.when(shown, F.col("numbers")).otherwise(stocks)).alias("color_stock"))


def details(pages: DataFrame, prefix: str = "FB-") -> DataFrame:
    """One record for each product page; its stock is that of its colors, or else of the text."""
    tasks = tasks_for(pages)
    pages = by_page(pages, tasks=tasks)
    said = t.strip_tags(F.col("html"))
    own = pages.select(
        "page_id", "url", F.regexp_extract(said, rf"\b({prefix}[A-Za-z0-9-]+)", 1).alias("code"), t.element_text(F.col("html"), "h1", "title").alias("name"),
        t.element_text(F.col("html"), "p").alias("description"), t.first_price(F.regexp_extract(said, r"S/\s*[\d.,]+", 0)).alias("price"),
        total(t.numbers_after(said)).alias("text_stock"), _images(F.col("html")).alias("_images"),
    )
    rows = own.join(colors_of(pages, tasks), "page_id", "left")
    sum_ = t.map_total(F.col("color_stock")).cast("int")
    return rows.select(
        "page_id", "url", "code", "name", "description", F.coalesce("price", F.lit(0.0)).alias("price"), F.coalesce(F.when(F.size("colors") > 0, sum_), F.col("text_stock")).alias("stock"),
        F.coalesce("color_stock", F.create_map().cast("map<string,int>")).alias("color_stock"), F.coalesce("colors", F.array().cast("array<string>")).alias("colors"),
        best_image(F.col("_images"), F.col("code")).alias("image_url"),
    )


def category_pages(categories: DataFrame, pages: DataFrame) -> DataFrame:
    """category, at (place of the category), page_no and page of every category's own page and those that it links to;
    a category whose own page is missing has none."""
    own = categories.join(pages.select("page_id", "url", "html").hint("merge"), "url")
    linked = page_links(own.select("page_id", "url", "html").dropDuplicates(["url"]))
    return categories.join(linked.hint("merge"), "url").select(F.col("name").alias("category"), "at", F.col("pos").alias("page_no"), "page")


def enriched(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Card rows with the colors and stock of their detail record (``found``: url, colors, color_stock), field by field.

    As many numbers on the card as colors there: the card's numbers in their order; else what the details say if that is
    more than nothing; else, without numbers on the card, no colors.  The row takes the details' address if there are
    colors.  Each key (code, or else address) has one detail record, that of its first card.
    """
    key = detail_key(F.col("code"), F.col("detail_url"))
    linked = rows.withColumn("_key", F.when(F.col("detail_url").isNotNull(), key))
    first = linked.where("_key IS NOT NULL").groupBy("_key").agg(F.min_by("detail_url", F.struct("at", "page_no", "pos")).alias("_from"))
    told = first.hint("merge").join(found.select(F.col("url").alias("_from"), F.col("colors").alias("_colors"), F.col("color_stock").alias("_stocks")), "_from")
    rows = linked.join(told.drop("_from").hint("merge"), "_key", "left")
    any_, sum_ = F.size("_colors") > 0, t.map_total(F.col("_stocks"))
    colors = (
        F.when(any_ & (F.size("numbers") == F.size("_colors")), F.map_from_arrays("_colors", "numbers")).when(any_ & (sum_ > 0), F.col("_stocks"))
        .when(any_ & (F.size("numbers") == 0), F.create_map().cast("map<string,int>")).otherwise(F.col("color_stock"))
    )
    counted = any_ & ((F.size("numbers") == F.size("_colors")) | (sum_ > 0))
    moved = F.col("_colors").isNotNull() & (any_ | (F.size("color_stock") > 0))
    out = {"color_stock": colors, "stock": F.when(counted, t.map_total(colors).cast("int")).otherwise(F.col("stock")), "url": F.when(moved, F.col("detail_url")).otherwise(F.col("url"))}
    return rows.withColumns(out).drop("_key", "_colors", "_stocks", "detail_url", "numbers")


def page_rows(categories: DataFrame, pages: DataFrame) -> DataFrame:
    """Product rows of categories (name, url, at): their pages' cards, with the details that these link to.

    A page that several categories share is read once; the rows of each category stand by at, page_no and pos.  Cards and
    details are kept in the folder of ``spark.checkpoint.dir``, as several steps read them.
    """
    pages = by_page(pages, "url")
    listed = kept(category_pages(categories, pages)).hint("merge")
    wanted = kept(pages.join(listed.select(F.col("page").alias("url")).distinct(), "url", "left_semi")).hint("merge")
    found = kept(cards(wanted).join(wanted.select("page_id", F.col("url").alias("page")), "page_id").drop("page_id")).hint("merge")
    asked = kept(pages.join(found.select(F.col("detail_url").alias("url")).distinct(), "url", "left_semi"))
    return enriched(listed.join(found, "page"), kept(details(asked)).hint("merge")).drop("page")


def outcomes(categories: DataFrame, pages: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each category: pages, cards, products (distinct codes) and error, an empty text if all went well.

    A category that fails is a row like the others; it neither stops them nor hides what they gave.
    """
    listed = category_pages(categories, pages).groupBy("at").agg(F.count("*").alias("listed"))
    there = category_pages(categories, pages).join(pages.select(F.col("url").alias("page")).hint("merge"), "page").groupBy("at").agg(F.count("*").alias("pages"))
    code = F.when(F.col("code") != "", F.col("code"))
    made = rows.groupBy("at").agg(F.count("*").alias("cards"), F.countDistinct(code).alias("products"), F.count_if(code.isNull()).alias("uncoded"))
    out = categories.join(listed, "at", "left").join(there, "at", "left").join(made, "at", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("listed", "pages", "cards", "products", "uncoded")}
    error = (
        F.when(n["pages"] == 0, "no page").when(n["pages"] < n["listed"], "pages are missing").when(n["cards"] == 0, "no cards")
        .when(n["uncoded"] > 0, "cards without a code").otherwise("")
    )
    return out.select(F.col("name").alias("category"), "at", n["pages"].alias("pages"), n["cards"].alias("cards"), n["products"].alias("products"), error.alias("error"))


def with_sum(by_category: DataFrame) -> DataFrame:
    """The outcomes and one more row, category null, with their sums and the number of errors as text."""
    failed = F.count_if(F.col("error") != "")
    sums = by_category.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "cards", "products")], failed.cast("string").alias("error"))
    return by_category.unionByName(sums.withColumns({"category": F.lit(None).cast("string"), "at": F.lit(None).cast("int")}))


def keyword_in_context(pages: DataFrame, keywords: list[str], most: int = 3, before: int = 150, size: int = 450) -> DataFrame:
    """page_id, keyword, n, place (0-based) and context of each match, the first ``most`` of a keyword and page."""
    keys = F.explode(F.array(*[F.lit(k) for k in keywords]))
    rows = pages.select("page_id", "html", keys.alias("keyword"))
    sizes = F.transform(F.split(F.lower("html"), F.concat(F.lit(r"\Q"), F.lower("keyword"), F.lit(r"\E")), -1), lambda p: F.length(p))
    # a match stands behind each piece but the last; of the first ``most`` places are sums of what stands before
    first = F.slice(sizes, F.lit(1), F.least(F.size(sizes) - 1, F.lit(most)))
    sums = F.transform(first, lambda x, k: F.aggregate(F.slice(first, F.lit(1), k + 1), F.lit(0), lambda a, n: a + n) + k * F.length("keyword"))
    hits = rows.select("page_id", "html", "keyword", F.posexplode(sums).alias("n", "place"))
    return hits.select("page_id", "keyword", (F.col("n") + 1).alias("n"), "place", F.substr("html", F.greatest(F.col("place") - before, F.lit(0)) + 1, F.lit(size)).alias("context"))


def keyword_matrix(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """keyword and the number of pages that have it."""
    low = F.lower("html")
    counts = pages.agg(*[F.count_if(F.contains(low, F.lit(k.lower()))).alias(f"k{n}") for n, k in enumerate(keywords)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.col(f"k{n}").alias("pages")) for n, k in enumerate(keywords)])).alias("r")).select("r.*")


def keyword_pages(pages: DataFrame, keywords: list[str]) -> DataFrame:
    """page_id, keyword and whether the page has it, for every page and keyword."""
    low = F.lower("html")
    found = F.array(*[F.struct(F.lit(k).alias("keyword"), F.coalesce(F.contains(low, F.lit(k.lower())), F.lit(False)).alias("found")) for k in keywords])
    return pages.select("page_id", F.explode(found).alias("r")).select("page_id", "r.*")


def distinct_captures(pages: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(group))).alias("capture"))
    return found.distinct().orderBy("capture")


def token_frequency(pages: DataFrame, pattern: str = r"<([a-z][a-z0-9]*)") -> DataFrame:
    found = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("tokens"))
    return found.select(F.explode(F.split("tokens", " ")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def text_blocks(pages: DataFrame, least: int = 100, token: str | None = None, tags: tuple[str, ...] = ("p", "h1", "li")) -> DataFrame:
    """page_id, pos, tag and text (that of elements inside it too) of elements that are long enough or have a token."""
    pages = by_page(pages)
    rows = outer_html(pages, elements(pages, *tags)).select("page_id", "pos", F.col("name").alias("tag"), t.strip_tags(F.col("html")).alias("text"))
    keep = F.length("text") > least
    return rows.where(keep | F.contains(F.lower("text"), F.lit(token.lower())) if token else keep)


def json_keys(df: DataFrame, column: str, pattern: str = "") -> DataFrame:
    keys = df.select(F.explode(F.json_object_keys(column)).alias("key"))
    return keys.where(F.col("key").rlike(pattern)).groupBy("key").agg(F.count("*").alias("n"))
