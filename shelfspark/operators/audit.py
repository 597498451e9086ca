"""Duplicates, integrity, coverage and frequency reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import BLANKS, clean_map, is_image_name, safe_file_name


def duplicate_groups(files: DataFrame, content: Column, path: str = "path") -> DataFrame:
    """hash, files and keep (the smallest path) of each content; no list of paths is gathered."""
    return files.select(F.sha2(content, 256).alias("hash"), path).groupBy("hash").agg(F.count("*").alias("files"), F.min(path).alias("keep"))


def duplicate_audit(files: DataFrame, content: Column, path: str = "path") -> DataFrame:
    """One row: files, distinct hashes, groups with more than one file, and the files beyond the first of each."""
    return duplicate_groups(files, content, path).agg(
        F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("files"), F.count("*").alias("hashes"),
        F.count_if(F.col("files") > 1).alias("groups"), F.coalesce(F.sum(F.col("files") - 1), F.lit(0)).cast("long").alias("duplicates"),
    )


def duplicates_to_drop(files: DataFrame, content: Column, path: str = "path") -> DataFrame:
    """All but the smallest path of each content."""
    keep = duplicate_groups(files, content, path).where("files > 1").select("hash", "keep")
    return files.withColumn("hash", F.sha2(content, 256)).join(keep, "hash").where(F.col(path) != F.col("keep")).select(path, "keep")


def multi_category(df: DataFrame, key: str = "code", category: str = "category") -> DataFrame:
    """Keys in more than one category, with their number and the sorted list."""
    pairs = df.select(key, category).distinct()
    many = pairs.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(category)), ",").alias("categories"))
    return many.where("n > 1").orderBy(key)


def category_counts(df: DataFrame, key: str = "code", category: str = "category") -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("appearances"), F.countDistinct(key).alias("codes"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def uniqueness(df: DataFrame, *columns: str) -> DataFrame:
    """One row: all rows, and the distinct values of each column."""
    return df.agg(F.count("*").alias("rows"), *[F.countDistinct(c).alias(c) for c in columns])


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def without_price(df: DataFrame, *prices: str) -> DataFrame:
    """Rows all of whose prices are zero or missing."""
    none = F.lit(True)
    for p in prices:
        none = none & (F.coalesce(p, F.lit(0.0)) == 0)
    return df.where(none)


def without_text(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.btrim(F.coalesce(column, F.lit(""))) == "")


def coverage(df: DataFrame, expected: DataFrame, key: str = "code", category: str = "category") -> DataFrame:
    """Found, unique and multi-category counts against the expected count of each category."""
    found = df.agg(F.count("*").alias("found"), F.countDistinct(key).alias("unique"))
    multi = df.select(key, category).distinct().groupBy(key).count().agg(F.count_if(F.col("count") > 1).alias("multi"))
    per = expected.join(df.groupBy(category).agg(F.count("*").alias("have")), category, "left")
    total = per.agg(F.sum("expected").alias("expected"), F.bool_and(F.coalesce("have", F.lit(0)) >= F.col("expected")).alias("complete"))
    one = F.lit(1).alias("_one")  # three frames of one row each
    return found.select("*", one).join(multi.select("*", one), "_one").join(total.select("*", one), "_one").drop("_one")


def lookup_metrics(df: DataFrame, key: Column) -> DataFrame:
    """Lookups by key when each key is fetched once."""
    return df.agg(F.count(key).alias("lookups"), F.countDistinct(key).alias("fetched")).withColumn("reused", F.col("lookups") - F.col("fetched"))


def enrich_once(cards: DataFrame, details: DataFrame, key: Column, pos: str = "pos") -> DataFrame:
    """Cards with the first detail record of their key; keys meet once, by code or else by url."""
    first = details.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*[c for c in details.columns if c != pos]), F.col(pos)).alias("detail"))
    return cards.withColumn("_k", key).join(first, "_k", "left").drop("_k")


def detail_key(code: Column, url: Column) -> Column:
    return F.when(F.btrim(F.coalesce(code, F.lit(""))) != "", F.concat(F.lit("code:"), F.lower(code))).otherwise(F.concat(F.lit("url:"), url))


def image_counts(df: DataFrame) -> DataFrame:
    filled = lambda c: F.count_if(F.coalesce(F.btrim(c), F.lit("")) != "")
    return df.agg(filled("image_path").alias("processed"), filled("image_error").alias("failed"))


def validate(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """errors: the messages of all broken rules. rules: (condition that must hold, message)."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in rules])
    return df.withColumn("errors", F.filter(broken, lambda x: x.isNotNull()))


def product_rules() -> list[tuple[Column, str]]:
    prices = [(F.coalesce(p, F.lit(0.0)) >= 0, f"{p} is negative") for p in ("price", "price_sample", "price_hundred", "price_thousand")]
    named = [(F.btrim(F.coalesce(c, F.lit(""))) != "", f"{c} is required") for c in ("code", "name")]
    return [*named, *prices, (F.coalesce("stock", F.lit(0)) >= 0, "stock is negative")]


def gate(df: DataFrame, rules: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) of rows that are normalised first."""
    checked = validate(normalise(df), rules)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def normalise(df: DataFrame) -> DataFrame:
    """Records with texts trimmed, and maps with trimmed keys, none blank, and counts of at least 0; null texts stay."""
    whole = {}
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            whole[f.name] = F.btrim(f.name, F.lit(BLANKS))
        elif isinstance(f.dataType, T.MapType) and isinstance(f.dataType.valueType, T.IntegerType):
            whole[f.name] = clean_map(F.col(f.name))
    return df.withColumns(whole) if whole else df


def without_image(df: DataFrame, column: str = "image_url") -> DataFrame:
    return without_text(df, column)


def image_index(paths: DataFrame) -> DataFrame:
    """code (as it is in file names) and the first path of each code's image files."""
    named = paths.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("code")).where(is_image_name(F.col("path")) & (F.col("code") != ""))
    return named.groupBy("code").agg(F.min("path").alias("image_path"))


def with_images(df: DataFrame, index: DataFrame) -> DataFrame:
    """Records with the image file of their code, or null."""
    own = df.drop("image_path").withColumn("_file", safe_file_name(F.col("code")))
    return own.join(index.withColumnRenamed("code", "_file"), "_file", "left").drop("_file")
