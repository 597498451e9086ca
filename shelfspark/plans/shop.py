"""Queries over a shop's pages that Spark writes from the part table: a page of cards for each brand and 500 keys, linked
from the brand's own page, and a page for each of four parts in five.  The SQL works the rows out from the table itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text as t
from shelfspark.operators import sync
from shelfspark.operators import pages as pg
from shelfspark.plans.catalog import query
from shelfspark.sources.tables import kept, spread, table

S = SparkSession
SITE, PER_PAGE = "https://shop.example", 500


def _slug() -> F.Column:
    return F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))


def categories(s: S, d: str) -> DataFrame:
    """name, url and at of every brand, and of one that has no pages."""
    brands = table(s, d, "part").select("p_brand").distinct()
    known = brands.select(F.col("p_brand").alias("name"), F.concat(F.lit(f"{SITE}/categoria-producto/"), _slug(), F.lit("/")).alias("url"), F.regexp_extract("p_brand", r"\d+", 0).cast("int").alias("at"))
    return known.unionByName(s.range(1).select(F.lit("Nowhere").alias("name"), F.lit(f"{SITE}/categoria-producto/nowhere/").alias("url"), F.lit(999).alias("at")))


def shop_pages(s: S, d: str) -> DataFrame:
    k, text = F.col("p_partkey"), lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    part = table(s, d, "part")
    n = 10 * part.count()  # a part's markup is as much as ten rows of other tables
    part = spread(part, n, "p_partkey")
    stock = F.when(k % 4 < 2, text("<p>Stock Disponible ", F.col("p_size"), " ", k % 97, "</p>")).when(k % 4 == 2, text("<p>Stock Disponible ", F.col("p_size"), "</p>")).otherwise("")
    inner = F.when(k % 10 == 0, text('<div class="jsfb-filterable"><h3>Pack ', k, "</h3><p>FB-P", k, "</p></div>")).otherwise("")
    card = text('<div class="item jsfb-filterable"><a href="/producto/', k, '/"><h2>', F.col("p_name"), "</h2></a><div><p>FB-", k, "</p></div>", inner, "<p>Muestra: S/ ", F.format_number("p_retailprice", 2), "</p>", stock, "</div>")
    cards = part.select(_slug().alias("slug"), F.floor(k / PER_PAGE).cast("int").alias("n"), F.struct(k, card.alias("card")).alias("c"))
    shown = spread(cards, n, "slug", "n").groupBy("slug", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["card"]), "\n").alias("body"))
    last = cards.groupBy("slug").agg(F.max("n").alias("last"))
    link = lambda n: text('<a class="page-numbers" href="/categoria-producto/', F.col("slug"), "/page/", n, '/">', n, "</a>")
    numbers = F.filter(F.sequence(F.lit(0), "last"), lambda n: n > 0)
    links = F.when(F.col("n") == 0, F.array_join(F.transform(numbers, link), " ")).otherwise("")
    place = F.when(F.col("n") == 0, "").otherwise(text("page/", F.col("n"), "/"))
    listed = shown.join(last, "slug").select(
        F.xxhash64("slug", "n").alias("page_id"), text(f"{SITE}/categoria-producto/", F.col("slug"), "/", place).alias("url"), text("<html><body><div class=list>", F.col("body"), "</div><nav>", links, "</nav></body></html>").alias("html")
    )
    options = '<select name="attribute_pa_color"><option value="">Choose an option</option><option value="rojo-x">Rojo</option><option value="azul-x">Azul</option></select>'
    data = text('{"stock":', F.col("p_size"), ',"v":[{"attributes":{"attribute_pa_color":"rojo-x"}},{"attributes":{"attribute_pa_color":"azul-x"},"max_qty":', F.col("p_size") + k % 7, "}]}")
    colors = F.when(k % 3 != 2, text(options, '<form data-product_variations="', F.replace(data, F.lit('"'), F.lit("&quot;")), '"></form>')).otherwise("")
    told = part.where("p_partkey % 5 <> 4").select(F.xxhash64(k).alias("page_id"), text(f"{SITE}/producto/", k, "/").alias("url"), text("<html><h1>", F.col("p_name"), "</h1><p>FB-", k, "</p>", colors, "</html>").alias("html"))
    return kept(listed.unionByName(told)).hint("merge")


_SLUG = "replace(lower(p_brand), '#', '-')"
_ROWS = f"""card AS (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 4 < 2 THEN [p_size, (p_partkey % 97)::INT] WHEN p_partkey % 4 = 2 THEN [p_size] ELSE [] END AS numbers,
    p_partkey % 5 <> 4 AND p_partkey % 3 <> 2 AS told, '{SITE}/categoria-producto/' || {_SLUG} || '/' || CASE WHEN p_partkey < 500 THEN '' ELSE 'page/' || (p_partkey // 500) || '/' END AS page FROM part),
  made AS (SELECT p_brand AS category, (k // 500)::INT AS page_no, 'FB-' || k AS code, p_name AS name, round(p_retailprice, 2) AS price_sample,
      CASE WHEN told AND len(numbers) < 2 THEN 2 * p_size + (k % 7)::INT ELSE coalesce(list_sum(numbers), 0)::INT END AS stock,
      CASE WHEN NOT told THEN '' WHEN len(numbers) = 2 THEN 'Azul=' || numbers[2] || ',Rojo=' || numbers[1] ELSE 'Azul=' || (p_size + k % 7) || ',Rojo=' || p_size END AS colors, '{SITE}/producto/' || k || '/' AS url FROM card
    UNION ALL SELECT p_brand, (k // 500)::INT, 'FB-P' || k, 'Pack ' || k, 0.0, 0, '', page FROM card WHERE k % 10 = 0)"""


@query(f"WITH {_ROWS} SELECT * FROM made")
def page_rows(s: S, d: str) -> DataFrame:
    rows = pg.page_rows(categories(s, d), shop_pages(s, d))
    return rows.select("category", "page_no", "code", "name", "price_sample", "stock", t.map_text(F.col("color_stock")).alias("colors"), "url")


@query(f"WITH {_ROWS} SELECT page AS url, 'FB-' || k AS code, p_name AS name, round(p_retailprice, 2) AS price_sample, array_to_string(numbers, ' ') AS numbers, 'Muestra: S/ ' || format('{{:,.2f}}', p_retailprice) AS description FROM card UNION ALL SELECT page, 'FB-P' || k, 'Pack ' || k, 0.0, '', '' FROM card WHERE k % 10 = 0")
def page_cards(s: S, d: str) -> DataFrame:
    pages = shop_pages(s, d).where(F.contains("url", F.lit("/categoria-producto/")))
    found = pg.cards(pages).join(pages.select("page_id", F.col("url").alias("page")), "page_id")
    return found.select(F.col("page").alias("url"), "code", "name", "price_sample", "description", F.array_join(F.transform("numbers", lambda n: n.cast("string")), " ").alias("numbers"))


@query("SELECT 'FB-' || p_partkey AS code, p_name AS name, CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE 2 * p_size + (p_partkey % 7)::INT END AS stock, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE 'Rojo,Azul' END AS colors FROM part WHERE p_partkey % 5 <> 4")
def page_details(s: S, d: str) -> DataFrame:
    found = pg.details(shop_pages(s, d).where(F.contains("url", F.lit("/producto/"))))
    return found.select("code", "name", "stock", F.array_join("colors", ",").alias("colors"))


@query(f"""WITH m AS (SELECT '{SITE}/categoria-producto/' || {_SLUG} || '/' AS url, max(p_partkey) // 500 AS last FROM part GROUP BY 1)
  SELECT url, url AS page, 0 AS pos FROM m UNION ALL SELECT url, url || 'page/' || i || '/', i::INT FROM m, LATERAL (SELECT unnest(range(1, last + 1)) AS i)""")
def category_page_list(s: S, d: str) -> DataFrame:
    named = categories(s, d)
    own = shop_pages(s, d).join(named.select("url"), "url", "left_semi")
    return pg.page_links(own.select("page_id", "url", "html"))


@query(f"""WITH {_ROWS}, o AS (SELECT category, count(DISTINCT page_no) AS pages, count(*) AS cards, count(DISTINCT code) AS products, CASE WHEN count(DISTINCT page_no) < 1 + max(page_no) THEN 'pages are missing' ELSE '' END AS error FROM made GROUP BY 1
    UNION ALL SELECT 'Nowhere', 0, 0, 0, 'no page')
  SELECT * FROM o UNION ALL SELECT NULL, sum(pages)::BIGINT, sum(cards)::BIGINT, sum(products)::BIGINT, (count(*) FILTER (error <> ''))::VARCHAR FROM o""")
def run_outcomes(s: S, d: str) -> DataFrame:
    named, pages = categories(s, d), shop_pages(s, d)
    return pg.with_sum(pg.outcomes(named, pages, pg.page_rows(named, pages))).drop("at")


@query(f"""WITH {_ROWS}, old AS (SELECT 'FB-' || p_partkey AS code, p_size AS stock FROM part WHERE p_partkey % 2 = 0)
  SELECT count(*) AS processed, count(*) FILTER (o.code IS NULL) AS created, count(*) FILTER (o.stock <> made.stock) AS updated, 0::BIGINT AS image_changed,
    count(*) FILTER (o.stock = made.stock) AS unchanged, 0::BIGINT AS removed, true AS consistent FROM made LEFT JOIN old o USING (code)""")
def run_sync(s: S, d: str) -> DataFrame:
    """Categories to pages, cards, details, one record for each code, and the catalog's sync."""
    stored = table(s, d, "part").where("p_partkey % 2 = 0")
    catalog = stored.select(F.concat(F.lit("FB-"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_size").alias("stock"))
    rows = pg.page_rows(categories(s, d), shop_pages(s, d))
    occurrences = rows.select("code", "name", "category", "stock", F.struct("at", "page_no", "pos").alias("pos"))
    return sync.sync(catalog, occurrences)[2]


_TOKENS = r"'(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^>]*>|<[^a-z/][^<]*|[^<]+|<'"
_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(rf"""WITH p AS (SELECT page_id, html, regexp_extract_all(html, {_TOKENS}) AS ts FROM pages),
  t AS (SELECT page_id, unnest(ts) AS tok, unnest(range(len(ts)))::INT AS pos FROM p),
  a AS (SELECT page_id, pos, tok, lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, length(tok) AS size,
    (coalesce(sum(length(tok)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offs, (sum(length(tok)) OVER (PARTITION BY page_id))::BIGINT AS whole FROM t),
  b AS (SELECT *, starts_with(tok, '</') AS closes, sum(CASE WHEN starts_with(tok, '</') THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) AS s FROM a WHERE tag IN ('article', 'p', 'h1', 'li', 'nav') AND NOT ends_with(tok, '/>')),
  c AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY page_id, tag ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM b),
  e AS (SELECT *, s - low + closes::INT AS level FROM c WHERE NOT closes OR s >= low),
  f AS (SELECT *, lead(CASE WHEN closes THEN offs + size END) OVER (PARTITION BY page_id, tag, level ORDER BY pos) AS stop FROM e),
  g AS (SELECT page_id, pos, tag, substr(html, offs + 1, coalesce(stop, whole) - offs) AS x FROM f JOIN p USING (page_id) WHERE NOT closes),
  h AS (SELECT page_id, pos, tag, {_PLAIN} AS text FROM g) SELECT page_id, pos, tag, text FROM h WHERE length(text) > 100""")
def text_blocks(s: S, d: str) -> DataFrame:
    return pg.text_blocks(table(s, d, "pages"), tags=("article", "p", "h1", "li", "nav"))


@query("SELECT page_id, keyword, coalesce(contains(lower(html), keyword), false) AS found FROM pages, (SELECT unnest(['benchmark', 'the', 'licensed', 'nav']) AS keyword)")
def keyword_pages(s: S, d: str) -> DataFrame:
    return pg.keyword_pages(table(s, d, "pages"), ["benchmark", "the", "licensed", "nav"])


