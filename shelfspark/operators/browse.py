"""Reading the catalog: search, facets, filters, order, counters, history views and report projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import forward_slashes, map_text, money, or_dash


def search_like(df: DataFrame, text: str, columns: tuple[str, ...] = ("code", "name", "category"), newest: str = "id") -> DataFrame:
    """Case-insensitive LIKE on any of the columns (% and _ are wildcards), newest first."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return df.where(hit).orderBy(F.desc(newest))


def text_matches(columns: list[Column], text: str) -> Column:
    """Literal substring, case aside, in any column by itself; an empty text matches all."""
    low = text.strip().lower()
    hit = F.lit(low == "")
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
    return hit


def search_text(df: DataFrame, text: str) -> DataFrame:
    """Over code, name, description, category and color names."""
    columns = [F.col(c) for c in ("code", "name", "description", "category") if c in df.columns]
    if "color_stock" in df.columns:
        columns.append(F.array_join(F.map_keys("color_stock"), ", "))
    return df.where(text_matches(columns, text))


def categories_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.btrim(x)), lambda x: x != "")


def in_categories(c: Column, selected: list[str]) -> Column:
    """Any of the row's categories is selected; an empty selection takes all."""
    return F.arrays_overlap(categories_of(c), F.array(*[F.lit(x) for x in selected])) if selected else F.lit(True)


def allowed(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(*names)) if names else df


def browse(df: DataFrame, text: str = "", selected: list[str] | None = None, stock_only: bool = False) -> Column:
    """The predicate of the browse pipeline: search, then categories, then stock."""
    columns = [F.col(c) for c in ("code", "name", "description", "category") if c in df.columns]
    keep = text_matches(columns, text) & in_categories(F.col("category"), selected or [])
    return keep & (F.col("stock") > 0) if stock_only else keep


def counter(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg(F.count_if(predicate).alias("shown"), F.count("*").alias("total"))


def facets(df: DataFrame, column: str = "category") -> DataFrame:
    """Each category and how many rows have it, in case-folded order."""
    items = df.select(F.explode(categories_of(F.col(column))).alias(column))
    return items.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.lower(column), column)


def sort_by(df: DataFrame, keys: list[tuple[str, bool]], tie: str) -> DataFrame:
    """Several keys, the first is primary; (column, descending); texts are folded; ties keep the order of ``tie``."""
    kinds = dict(df.dtypes)
    order = []
    for c, down in keys:
        k = F.lower(c) if kinds[c] == "string" else F.col(c)
        order.append(k.desc() if down else k.asc())
    return df.orderBy(*order, F.col(tie).asc())


def newest(df: DataFrame, n: int = 100, *by: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in by or ("id",)]).limit(n)


def changes_of_run(log: DataFrame, run_id: int) -> DataFrame:
    return log.where(F.col("history_id") == run_id).orderBy(F.lower("code"), "id")


def history_view(runs: DataFrame, n: int = 100) -> DataFrame:
    return newest(runs, n).withColumn("label", F.when(F.col("status") == "SUCCESS", "APLICADO").otherwise("ERROR"))


def change_view(log: DataFrame) -> DataFrame:
    label = F.when(F.col("change_type") == "NEW", "NUEVO").otherwise("ACTUALIZADO")
    return log.select("code", label.alias("label"), "field_label", or_dash(F.col("old_value")).alias("old_value"), or_dash(F.col("new_value")).alias("new_value"))


def report(df: DataFrame) -> DataFrame:
    """The six columns of the report, headed as users know them."""
    return df.select(F.col("code").alias("Código"), F.col("name").alias("Nombre"), F.col("category").alias("Categoría"), F.col("description").alias("Descripción"), F.col("price").alias("Precio"), F.col("stock").alias("Stock"))


def write_report(df: DataFrame, path: str) -> None:
    report(df).write.csv(path, header=True, mode="overwrite")


def printed_report(df: DataFrame) -> DataFrame:
    """The second projection: everything as text, the image path with forward slashes or empty."""
    return df.select(
        F.coalesce(forward_slashes(F.col("image_path")), F.lit("")).alias("image"), "code", "name", "category",
        money(F.col("price")).alias("price"), F.col("stock").cast("string").alias("stock"),
    )


def first_rows(df: DataFrame, k: int, pos: str = "pos") -> DataFrame:
    """A sample: the first k records."""
    return df.orderBy(pos).limit(k)


def still_there(selected: DataFrame, facets: DataFrame, column: str = "category") -> DataFrame:
    """The selected facets that the catalog still has."""
    return selected.join(facets, column, "left_semi").select(column).distinct()


def bag_union(*frames: DataFrame) -> DataFrame:
    """All rows of several lists one after the other: ``list_no`` and the lists' own ``pos`` keep the order."""
    out = None
    for k, df in enumerate(frames):
        own = df.withColumn("list_no", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out
