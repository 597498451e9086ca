"""The catalog rebuilt from the change log: the last value of each (code, field), null values too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import map_from_json, to_count, to_number
from shelfspark.sources.commits import Publication
from shelfspark.sources.tables import METADATA, conform, is_ready, set_value, spread

#: Fields of the log by type.
TEXTS = ("category", "description", "image_url", "image_path", "image_hash")
PRICES = ("price", "price_sample", "price_hundred", "price_thousand")


def latest_values(log: DataFrame, code: str = "code", field: str = "field_name", value: str = "new_value", order: str = "id") -> DataFrame:
    """code, field and the value with the highest order, which may be null; combined before the shuffle."""
    return log.groupBy(code, field).agg(F.max_by(value, order).alias(value))


def replay(log: DataFrame, rows: int | None = None) -> DataFrame:
    """One typed catalog row for each code with a name. The name is the last of product_name and ``name`` values.

    rows: about how many the log has, to be counted if not given; its tasks follow from it. All rows of a code
    meet in one task, which sorts them, on disk if they do not fit.
    """
    fields = [*TEXTS, *PRICES, "stock", "color_stock"]
    last = {f: F.max_by(F.when(F.col("field_name") == f, F.col("new_value")), F.when(F.col("field_name") == f, F.col("id"))) for f in fields}
    events = F.array(
        F.struct(F.col("id"), F.lit(0).alias("seq"), F.col("product_name").alias("v")),
        F.when(F.col("field_name") == "name", F.struct(F.col("id"), F.lit(1).alias("seq"), F.col("new_value").alias("v"))),
    )
    named = F.array_max(F.filter(events, lambda e: e.isNotNull() & (F.coalesce(F.btrim(e["v"]), F.lit("")) != "")))
    log = spread(log.select("id", "code", "product_name", "field_name", "new_value"), log.count() if rows is None else rows, "code")
    rows = log.withColumn("_name", named).groupBy("code").agg(F.max("_name").alias("_name"), *[c.alias(f) for f, c in last.items()])
    return rows.where(F.col("_name.v").isNotNull()).select(
        "code", F.col("_name.v").alias("name"), *[F.coalesce(f, F.lit("")).alias(f) for f in TEXTS],
        *[to_number(F.col(f)).alias(f) for f in PRICES], to_count(F.col("stock")).alias("stock"),
        map_from_json(F.col("color_stock")).alias("color_stock"),
    )


def bootstrap(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """The replayed log if the catalog is empty, else the catalog."""
    return replay(log) if catalog.isEmpty() and not log.isEmpty() else catalog


def restore(tables: Publication, catalog: T.StructType, changes: T.StructType) -> int:
    """Rebuilds an empty catalog from the published changes and marks it initialised, in one commit; the number restored.

    A catalog that is ready (marked, or with rows) is left as it is, so running this again changes nothing.
    """
    state = tables.state()
    metadata = tables.read("metadata", METADATA, state)
    if is_ready(metadata, tables.read("catalog", catalog, state)):
        return 0
    log = tables.read("changes", changes, state)
    if log.isEmpty():
        return 0
    rows = conform(replay(log.withColumn("id", F.col("history_id"))), catalog)
    parts = {"catalog": tables.stage("catalog", rows, "code"), "metadata": tables.stage("metadata", set_value(metadata, "initialized", "1"))}
    state = tables.commit(state, replace=parts)
    return tables.read("catalog", catalog, state).count()
