"""Registered queries on pages, documents and events, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text as t
from shelfspark.operators import pages as pg
from shelfspark.plans.catalog import query
from shelfspark.sources.tables import table

S = SparkSession
_LINKS = r"""links AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS label,
  unnest(range(len(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)))) AS pos FROM pages)"""


@query(f"WITH {_LINKS} SELECT page_id, href, min(pos)::INT AS pos FROM links GROUP BY ALL")
def link_inventory(s: S, d: str) -> DataFrame:
    return pg.distinct_links(pg.links(table(s, d, "pages")))


@query(f"WITH {_LINKS} SELECT href, count(DISTINCT page_id) AS pages FROM links GROUP BY href")
def link_counts(s: S, d: str) -> DataFrame:
    return pg.link_counts(pg.links(table(s, d, "pages")))


@query(rf"""WITH {_LINKS} SELECT arg_min(trim(regexp_replace(regexp_replace(label, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), page_id * 100000 + pos) AS name, href AS url
  FROM links WHERE contains(href, '/e') AND NOT contains(href, 'nuevos-productos') GROUP BY href""")
def category_discovery(s: S, d: str) -> DataFrame:
    return pg.categories(table(s, d, "pages"), "/e")


@query(rf"""WITH {_LINKS} SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || href AS target FROM links WHERE starts_with(href, '/')""")
def link_resolve(s: S, d: str) -> DataFrame:
    found = pg.links(table(s, d, "pages")).where(F.col("href").startswith("/"))
    return found.select("page_id", t.resolve_url(F.col("url"), F.col("href")).alias("target")).distinct()


@query(r"""WITH raw AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1,
    regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS html FROM pages),
  clean AS (SELECT page_id, list_transform([title, h1, html], lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS v FROM raw)
  SELECT page_id, v[1] AS title, v[2] AS heading, length(v[3])::INT AS chars FROM clean""")
def page_fields(s: S, d: str) -> DataFrame:
    html = F.col("html")
    return table(s, d, "pages").select("page_id", t.element_text(html, "title").alias("title"), t.element_text(html, "h1").alias("heading"), F.length(t.strip_tags(html)).alias("chars"))


@query(r"""WITH n AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(replace(text, ',', ''), '\d+'), lambda x: try_cast(x AS DOUBLE)), lambda x: x IS NOT NULL) AS v FROM documents)
  SELECT doc_id, len(v)::INT AS numbers, round(list_sum(v), 0) AS total FROM n WHERE len(v) > 0""")
def number_extract(s: S, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", t.all_numbers(F.col("text")).alias("v")).where(F.size("v") > 0)
    return rows.select("doc_id", F.size("v").alias("numbers"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 0).alias("total"))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def json_keys(s: S, d: str) -> DataFrame:
    return pg.json_keys(table(s, d, "events"), "props")


WORDS = ["benchmark", "the", "licensed", "nav"]


@query(r"""WITH k AS (SELECT unnest(['track(', 'article', '<title>']) AS keyword), p AS (SELECT page_id, html, keyword, string_split(lower(html), keyword) AS x FROM pages, k),
  m AS (SELECT page_id, html, keyword, unnest(range(1, least(len(x), 4)))::INT AS n, x FROM p),
  a AS (SELECT page_id, html, keyword, n, (list_sum(list_transform(x[1:n], lambda y: length(y))) + (n - 1) * length(keyword))::INT AS place FROM m)
  SELECT page_id, keyword, n, place, substr(html, greatest(place - 150, 0) + 1, 450) AS context FROM a""")
def kwic(s: S, d: str) -> DataFrame:
    return pg.keyword_in_context(table(s, d, "pages"), ["track(", "article", "<title>"])


@query("SELECT keyword, count(*) FILTER (contains(lower(html), keyword)) AS pages FROM pages, (SELECT unnest(['benchmark', 'the', 'licensed', 'nav']) AS keyword) GROUP BY keyword")
def keyword_matrix(s: S, d: str) -> DataFrame:
    return pg.keyword_matrix(table(s, d, "pages"), WORDS)


@query(r"SELECT DISTINCT unnest(regexp_extract_all(html, 'lang=\"([a-z]+)\"', 1)) AS capture FROM pages ORDER BY capture".replace('\\"', '"'))
def regex_distinct(s: S, d: str) -> DataFrame:
    return pg.distinct_captures(table(s, d, "pages"), 'lang="([a-z]+)"')


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS token FROM pages) GROUP BY token")
def token_frequency(s: S, d: str) -> DataFrame:
    return pg.token_frequency(table(s, d, "pages"))
