"""Comparison of two snapshots, and the change log in long format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import map_text

#: Fields of a record that are compared and logged.
CONTENT_FIELDS = ("name", "category", "description", "price", "price_sample", "price_hundred", "price_thousand", "stock", "color_stock")
CONTENT_FIELDS_WITH_CODE = ("code", *CONTENT_FIELDS)
IMAGE_FIELDS = ("image_url", "image_path")
LOGGED_FIELDS = ("code", "name", "category", "description", "price", "price_sample", "price_hundred", "price_thousand", "stock", "color_stock", "image_url", "image_path", "image_hash")
NEW, UPDATED, IMAGE_CHANGED, UNCHANGED, REMOVED = "NEW", "UPDATED", "IMAGE_CHANGED", "UNCHANGED", "REMOVED"


def comparable(df: DataFrame, c: str, value: Column) -> Column:
    return map_text(value) if isinstance(df.schema[c].dataType, T.MapType) else value


def differing(old: DataFrame, new: DataFrame, fields: tuple[str, ...]) -> Column:
    """Names of the fields that differ, null-safe, between sides aliased o and n."""
    changed = [F.when(~comparable(old, f, F.col(f"o.{f}")).eqNullSafe(comparable(new, f, F.col(f"n.{f}"))), F.lit(f)) for f in fields]
    return F.filter(F.array(*changed), lambda x: x.isNotNull())


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "code", content: tuple[str, ...] | None = None, images: tuple[str, ...] = IMAGE_FIELDS) -> DataFrame:
    """key, status and changed (field names) of every key of either side; one full outer join. Rows with a blank key go."""
    old, new = (x.where(F.btrim(key) != "") for x in (old, new))
    both = set(old.columns) & set(new.columns)
    content = tuple(f for f in (content or CONTENT_FIELDS) if f in both)
    images = tuple(f for f in images if f in both)
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    in_both = F.col("o._o").isNotNull() & F.col("n._n").isNotNull()
    none = F.array().cast("array<string>")
    texts = F.when(in_both, differing(old, new, content)).otherwise(none)
    pictures = F.when(in_both, differing(old, new, images)).otherwise(none) if images else none
    rows = joined.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key), F.col("o._o").alias("_o"), F.col("n._n").alias("_n"), texts.alias("_texts"), pictures.alias("_images")
    )
    status = (
        F.when(F.col("_o").isNull(), NEW).when(F.col("_n").isNull(), REMOVED).when(F.size("_texts") > 0, UPDATED)
        .when(F.size("_images") > 0, IMAGE_CHANGED).otherwise(UNCHANGED)
    )
    return rows.select(key, status.alias("status"), F.array_join(F.concat("_texts", "_images"), ",").alias("changed"))


def diff_flags(diff: DataFrame, key: str = "code", images: tuple[str, ...] = IMAGE_FIELDS) -> DataFrame:
    """key and whether content, images or anything differs, of the keys of both sides."""
    fields = F.filter(F.split("changed", ","), lambda f: f != "")
    pictures = F.filter(fields, lambda f: f.isin(*images))
    both = diff.where(~F.col("status").isin(NEW, REMOVED))
    return both.select(key, (F.size(fields) > F.size(pictures)).alias("content_changed"), (F.size(pictures) > 0).alias("image_changed"), (F.size(fields) > 0).alias("any_changed"))


def only_in(left: DataFrame, right: DataFrame, key: str = "code") -> DataFrame:
    """Keys of ``left`` that ``right`` lacks: new or removed ones."""
    return left.join(right.select(key), key, "left_anti").select(key)


def changed_keys(diff: DataFrame, key: str = "code") -> DataFrame:
    return diff.where(F.col("status").isin(NEW, UPDATED)).select(key)


def status_counts(diff: DataFrame) -> DataFrame:
    """One row: a count for each status, and whether what was processed is what was classified."""
    one = lambda s: F.count_if(F.col("status") == s)
    counts = diff.agg(
        F.count_if(F.col("status") != REMOVED).alias("processed"), one(NEW).alias("created"), one(UPDATED).alias("updated"),
        one(IMAGE_CHANGED).alias("image_changed"), one(UNCHANGED).alias("unchanged"), one(REMOVED).alias("removed"),
    )
    return counts.withColumn("consistent", F.col("processed") == F.col("created") + F.col("updated") + F.col("image_changed") + F.col("unchanged"))


def kind_text(kind: T.DataType, c: Column) -> Column:
    if isinstance(kind, T.MapType):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    return F.format_string("%.2f", c) if isinstance(kind, T.DoubleType) else c.cast("string")


def value_text(df: DataFrame, f: str, c: Column) -> Column:
    return kind_text(df.schema[f].dataType, c)


def change_log(old: DataFrame, new: DataFrame, key: str = "code", fields: tuple[str, ...] = LOGGED_FIELDS) -> DataFrame:
    """Long rows (change_type, code, product_name, field_name, old_value, new_value): every field of a new record, and the
    differing ones of an updated record. One join and one explode."""
    fields = tuple(f for f in fields if f in new.columns)
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.alias("n")
    joined = n.join(o, F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    is_new = F.col("o._o").isNull()
    entries = []
    for f in fields:
        before = F.when(~is_new, value_text(old, f, F.col(f"o.{f}")))
        after = value_text(new, f, F.col(f"n.{f}"))
        entry = F.struct(F.lit(f).alias("field_name"), before.alias("old_value"), after.alias("new_value"))
        entries.append(F.when(is_new | ~before.eqNullSafe(after), entry))
    rows = joined.select(
        F.when(is_new, NEW).otherwise(UPDATED).alias("change_type"), F.col(f"n.{key}").alias(key), F.col("n.name").alias("product_name"),
        F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"),
    )
    return rows.select("change_type", key, "product_name", "e.field_name", "e.old_value", "e.new_value")


def result_rows(log: DataFrame, key: str = "code") -> DataFrame:
    """Detail rows of a run's result: one "Alta" row for each new record, one row for each changed field."""
    new = log.where(F.col("change_type") == NEW).select(key, "product_name").distinct()
    empty = F.lit(None).cast("string")
    new = new.select(key, "product_name", F.lit("Alta").alias("field_name"), empty.alias("old_value"), empty.alias("new_value"))
    return new.unionByName(log.where(F.col("change_type") == UPDATED).select(key, "product_name", "field_name", "old_value", "new_value"))
