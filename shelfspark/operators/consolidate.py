"""Occurrences of a product in several categories made one record each.

Order is data here: every function takes ``pos``, the column of a total order made at the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import map_total
from shelfspark.sources.tables import kept, spread

#: What an occurrence comes apart into.
ROW, CATEGORY, STOCK, COLOR = range(4)
#: A code with more rows is reduced by many tasks.
HOT_ROWS = 100_000


def first_per_key(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """The row with the smallest position of each key; an aggregation, so it combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def last_per_key(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def with_key(df: DataFrame, key: str = "code") -> DataFrame:
    """Rows whose key is not blank."""
    return df.where(F.btrim(key) != "")


def ordered_union(df: DataFrame, key: str, value: str, pos: str = "pos", fold: bool = True, name: str = "values") -> DataFrame:
    """key and the distinct items of comma-separated ``value`` by first position; case aside, the first spelling stays.

    Items are reduced to one row for each (key, item) before they are gathered.
    """
    items = df.select(key, pos, F.posexplode(F.split(value, ",")).alias("k", "item")).withColumn("item", F.btrim("item")).where("item <> ''")
    same = F.lower("item") if fold else F.col("item")
    firsts = items.withColumn("same", same).groupBy(key, "same").agg(F.min(F.struct(F.col(pos).alias("at"), "k", "item")).alias("f"))
    listed = F.transform(F.array_sort(F.collect_list("f")), lambda f: f["item"])
    return firsts.groupBy(key).agg(F.array_join(listed, ", ").alias(name))


def max_by_entry(df: DataFrame, key: str, entry: str, value: str) -> DataFrame:
    """key, entry and the largest value, at least 0; values that are no numbers are skipped."""
    return df.groupBy(key, entry).agg(F.max(F.greatest(F.col(value).try_cast("double").try_cast("int"), F.lit(0))).alias(value)).where(F.col(value).isNotNull())


def merge_maps(df: DataFrame, key: str, column: str) -> DataFrame:
    """key and one map of all rows' maps: the largest value of each entry, and the total."""
    entries = df.select(key, F.explode(column).alias("entry", "value"))
    best = max_by_entry(entries, key, "entry", "value")
    merged = best.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entry", "value")))).alias(column))
    return merged.withColumn("total", map_total(F.col(column)))


def first_filled(column: str, pos: str = "pos") -> Column:
    """Aggregate: the first value that is not blank."""
    return F.min_by(F.when(F.btrim(column) != "", F.col(column)), F.when(F.btrim(column) != "", F.col(pos)))


def consolidate(occurrences: DataFrame) -> DataFrame:
    """One record for each code: the first occurrence, its blanks filled from later ones, all categories, merged colors.

    The rows of each code are counted first.  Occurrences are shuffled once, as they are, by code; only the rows of codes
    with more than HOT_ROWS go the way of ``_reduced`` that spreads them.  Missing columns are left out; colors are a map
    column ``color_stock`` or, if ``colors`` is there, an array of names as well (each once, by first place).
    """
    rows = with_key(occurrences)
    counts = rows.groupBy("code").agg(F.count("*").alias("n"))
    n, hot = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > HOT_ROWS)).first()
    if not hot:
        return _reduced(spread(rows, n, "code"))
    many = kept(counts.where(F.col("n") > HOT_ROWS).select("code"))
    cold = _reduced(spread(rows.join(many, "code", "left_anti"), n, "code"))
    return cold.unionByName(_reduced(rows.join(many, "code", "left_semi")))


def _reduced(rows: DataFrame) -> DataFrame:
    """``consolidate`` of rows that all have a code.

    Each is read as a row of its own and one for each category and color it names.  Those are reduced to one row for each
    code and item: where the rows lie, if they lie by code, else before and after a shuffle by both, so a code with many
    occurrences is spread like any other.  What is gathered by code is its distinct items.
    """
    have = rows.columns
    filled = [c for c in ("description", "image_url") if c in have]
    base = [c for c in have if c not in ("code", "pos", "category", "color_stock", "colors", *filled)]
    no_map, own = F.create_map().cast("map<string,int>"), F.struct(*base, *filled)
    no_row = F.lit(None).cast(rows.select(own.alias("r")).schema["r"].dataType)
    item = lambda kind, same, k, text, value=F.lit(None), row=no_row: F.struct(F.lit(kind).alias("kind"), same.alias("same"), k.alias("k"), text.alias("text"), value.cast("int").alias("value"), row.alias("row"))
    none = F.lit(None).cast("string")
    parts = [F.array(item(ROW, F.lit(""), F.lit(0), none, row=own))]
    if "category" in have:
        listed = F.filter(F.transform(F.split(F.coalesce("category", F.lit("")), ","), lambda x, k: F.struct(F.btrim(x).alias("x"), k.alias("k"))), lambda x: x["x"] != "")
        parts.append(F.transform(listed, lambda x: item(CATEGORY, F.lower(x["x"]), x["k"], x["x"])))
    if "color_stock" in have:
        parts.append(F.transform(F.map_entries(F.coalesce("color_stock", no_map)), lambda e: item(STOCK, e["key"], F.lit(0), e["key"], F.greatest(e["value"].try_cast("int"), F.lit(0)))))
    if "colors" in have:
        names = F.filter(F.transform(F.coalesce("colors", F.array().cast("array<string>")), lambda x, k: F.struct(F.btrim(x).alias("x"), k.alias("k"))), lambda x: x["x"] != "")
        parts.append(F.transform(names, lambda x: item(COLOR, x["x"], x["k"], x["x"])))
    items = rows.select("code", "pos", F.explode(F.concat(*parts)).alias("i"))
    payload = F.struct(F.struct(F.col("pos"), F.col("i.k").alias("k")).alias("at"), F.col("i.text").alias("text"), F.col("i.row").alias("row"))
    items = items.select("code", F.col("i.kind").alias("kind"), F.col("i.same").alias("same"), F.col("i.value").alias("value"), payload.alias("p"))
    # one row for each code and item, then one for each code
    told = lambda c: F.btrim(F.coalesce(F.col(f"p.row.{c}"), F.lit(""))) != ""
    firsts = {c: F.min(F.when(told(c), F.struct(F.col("p.at"), F.col(f"p.row.{c}").alias("x")))) for c in filled}
    reduced = items.groupBy("code", "kind", "same").agg(F.min_by("p", "p.at").alias("p"), F.max("value").alias("value"), *[v.alias(f"_{c}") for c, v in firsts.items()])
    found = F.struct("kind", "p", "value", *[f"_{c}" for c in filled])
    by_code = reduced.groupBy("code").agg(F.collect_list(found).alias("all"))
    of = lambda kind: F.filter("all", lambda x: x["kind"] == kind)
    by_code = by_code.select("code", F.get(of(ROW), F.lit(0)).alias("r"), of(CATEGORY).alias("categories"), of(STOCK).alias("stocks"), of(COLOR).alias("names"))
    texts = lambda c: F.transform(F.array_sort(F.transform(c, lambda x: F.struct(x["p"]["at"].alias("at"), x["p"]["text"].alias("text")))), lambda x: x["text"])
    out = {c: F.col(f"r.p.row.{c}") for c in base} | {c: F.coalesce(F.col(f"r._{c}.x"), F.lit("")) for c in filled} | {"pos": F.col("r.p.at.pos")}
    if "category" in have:
        out["category"] = F.array_join(texts(F.col("categories")), ", ")
    if "color_stock" in have:
        counted = F.filter(F.transform("stocks", lambda x: F.struct(x["p"]["text"].alias("key"), x["value"].alias("value"))), lambda e: e["value"].isNotNull())
        out["color_stock"] = F.map_from_entries(F.array_sort(counted))
    if "colors" in have:
        out["colors"] = texts(F.col("names"))
    return by_code.select("code", *[c.alias(n) for n, c in out.items()])


def zip_by_position(names: Column, numbers: Column) -> Column:
    """A map of names to numbers when both are as many, else an empty one; names count once."""
    unique = F.array_distinct(names)
    return F.when(F.size(unique) == F.size(numbers), F.map_from_arrays(unique, numbers)).otherwise(F.create_map().cast("map<string,int>"))


def position(df: DataFrame, partition: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
