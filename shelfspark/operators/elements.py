"""Balanced elements of markup: where each begins and ends, however elements nest, found in columns.

Markup is cut into tokens (tags, texts, comments, scripts and styles whole) whose lengths add up to places in the page.
Tags of one name open and close levels; a start belongs to the next end on its level.  Of pages that lie by page_id
(``by_page``) nothing is shuffled; of others only places are, and the markup itself meets them once.  An end without a start is ignored, an element without an end reaches to the page's
end, and elements that cannot hold others are their own tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^>]*>|<[^a-z/][^<]*|[^<]+|<"
#: Elements that hold nothing.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


#: Characters of markup that a task takes; its tokens take some ten times as much memory.
TASK_CHARS = 4 << 20


def tasks_for(pages: DataFrame) -> int:
    return max(1, -(-(pages.agg(F.sum(F.length("html"))).first()[0] or 0) // TASK_CHARS))


def by_page(pages: DataFrame, key: str = "page_id", tasks: int | None = None) -> DataFrame:
    """Pages by a key in as many partitions as their markup asks for.  Their markup is read for its size first, so pages
    that are costly to make should be kept.  They are never broadcast: what Spark expects of their size says little about
    their markup."""
    return pages.select("page_id", "url", "html").repartition(tasks or tasks_for(pages), key).hint("merge")


def elements(pages: DataFrame, *names: str) -> DataFrame:
    """page_id, pos (the start's place among the tokens), name, tag (the start itself), level, begin and stop (places of
    its first and last character, from 1) of the elements with these names, or of all."""
    name = lambda x: F.lower(F.regexp_extract(x, r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    wanted = lambda n: n.isin(*names) if names else n != ""
    cut = F.transform(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0)), lambda x: F.struct(F.length(x).alias("size"), name(x).alias("name"), F.when(wanted(name(x)), x).alias("tag")))
    rows = pages.select("page_id", F.posexplode(cut).alias("pos", "t")).select("page_id", "pos", "t.*")
    page = Window.partitionBy("page_id")
    before = F.coalesce(F.sum("size").over(page.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"at": before.cast("int"), "whole": F.sum("size").over(page).cast("int")}).where(F.col("tag").isNotNull())
    alone = F.col("name").isin(*VOID) | F.col("tag").endswith("/>") | (F.col("name").isin("script", "style") & F.col("tag").rlike(r"(?i)</(script|style)\s*>$"))
    rows = rows.withColumns({"alone": alone, "closes": F.col("tag").startswith("</")}).where(~F.col("alone") | ~F.col("closes"))
    same = Window.partitionBy("page_id", "alone", "name").orderBy("pos")
    rows = rows.withColumn("sum", F.sum(F.when(F.col("closes"), -1).otherwise(1)).over(same))
    lowest = F.least(F.lit(0), F.coalesce(F.min("sum").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("low", lowest).where(~F.col("closes") | (F.col("sum") >= F.col("low")))
    level = F.col("sum") - F.col("low") + F.when(F.col("closes"), 1).otherwise(0)
    rows = rows.withColumn("level", F.when(F.col("alone"), 1).otherwise(level).cast("int"))
    ahead = Window.partitionBy("page_id", "alone", "name", "level").orderBy("pos")
    rows = rows.withColumn("end", F.lead(F.when(F.col("closes"), F.col("at") + F.col("size"))).over(ahead))
    stop = F.when(F.col("alone"), F.col("at") + F.col("size")).otherwise(F.coalesce("end", "whole"))
    return rows.where(~F.col("closes")).select("page_id", "pos", "name", "tag", "level", (F.col("at") + 1).alias("begin"), stop.alias("stop"))


def outer_html(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with the page's url and html, the markup of the element with all that it holds."""
    return spans.join(pages.select("page_id", "url", "html"), "page_id").withColumn("html", F.substring("html", F.col("begin"), F.col("stop") - F.col("begin") + 1))


def own_html(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with the page's url and html, the markup of the element without the elements among ``spans`` inside it."""
    ends = F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("turn")), F.struct((F.col("stop") + 1).alias("at"), F.lit(-1).alias("turn")))
    events = spans.select("page_id", F.explode(ends).alias("e")).select("page_id", "e.*")
    page = Window.partitionBy("page_id").orderBy("at", "turn")
    events = events.withColumns({"depth": F.sum("turn").over(page), "next": F.lead("at").over(page)}).where("depth > 0 AND next > at")
    owner = F.last(F.when(F.col("turn") == 1, F.col("at")), ignorenulls=True).over(Window.partitionBy("page_id", "depth").orderBy("at", "turn"))
    pieces = events.withColumn("begin", owner).groupBy("page_id", "begin").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("next") - F.col("at")).alias("n")))).alias("pieces"))
    met = spans.join(pieces, ["page_id", "begin"]).join(pages.select("page_id", "url", "html"), "page_id")
    return met.withColumn("html", F.array_join(F.transform("pieces", lambda p: F.substring("html", p["at"], p["n"])), "")).drop("pieces")


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a start tag, or null."""
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.when(found != "", F.regexp_replace(found, r"""^["']|["']$""", ""))
