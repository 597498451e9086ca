"""Writing to the catalog: upsert, delete, landing, and the whole sync as one plan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import clean_map, content_hash, is_blank, map_text, number_text, resolve_price, trimmed
from shelfspark.operators import consolidate as co
from shelfspark.operators import diff as d
from shelfspark.sources.commits import Publication


def upsert(old: DataFrame, new: DataFrame, key: str = "code", now: Column | None = None) -> DataFrame:
    """All columns of a new row replace those of the old one; columns that the new side lacks are kept.

    With ``now``, updated_at is set to it in every row that the new side writes.
    """
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    there = F.col("n._n").isNotNull()
    picked = [
        F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c == key
        else F.when(there, now).otherwise(F.col(f"o.{c}")).alias(c) if c == "updated_at" and now is not None
        else (F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in new.columns else F.col(f"o.{c}")).alias(c)
        for c in old.columns
    ]
    return joined.select(*picked)


def insert(old: DataFrame, new: DataFrame, key: str = "code") -> DataFrame:
    """Appends; an existing or repeated key is an error and nothing is returned."""
    if not new.join(old.select(key), key, "left_semi").isEmpty() or not new.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"duplicate {key}")
    return old.unionByName(new)


def delete(df: DataFrame, keys: DataFrame, key: str = "code") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def to_catalog(landed: DataFrame) -> DataFrame:
    """Landing records as catalog records: the price is the sample price if there is one."""
    return landed.withColumn("price", resolve_price(F.col("price_sample"), F.col("price"))) if "price_sample" in landed.columns else landed


#: What a landing record has where nothing is said, and the fields of its content hash.
LANDING = {"source": "importacionesfacundo", **dict.fromkeys(("url", "code", "name", "category", "description", "image_url", "image_path", "image_hash", "image_error"), "")}
LANDING_NUMBERS = ("price", "price_sample", "price_hundred", "price_thousand")


def record_hash(df: DataFrame) -> Column:
    """SHA-256 over the content fields of a record."""
    text = {"color_stock": lambda c: map_text(c), "stock": lambda c: c.cast("string")} | dict.fromkeys(LANDING_NUMBERS, number_text)
    return content_hash([text.get(f, trimmed)(F.col(f)) for f in d.CONTENT_FIELDS_WITH_CODE])


def landing_record(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Landing records from whatever fields there are: defaults for the others and for nulls, the scrape time where it is
    missing, maps with clean keys and counts, and the content hash."""
    have = set(df.columns)
    field = lambda f, default: (F.coalesce(F.col(f), default) if f in have else default).alias(f)
    no_map = F.create_map().cast("map<string,int>")
    made = df.select(
        *[field(f, F.lit(x)) for f, x in LANDING.items()], *[field(f, F.lit(0.0)) for f in LANDING_NUMBERS], field("stock", F.lit(0)),
        clean_map(F.coalesce(F.col("color_stock"), no_map) if "color_stock" in have else no_map).alias("color_stock"), field("scraped_at", now if now is not None else F.current_timestamp()),
    )
    return made.withColumn("content_hash", record_hash(made))


def union_text(a: Column, b: Column) -> Column:
    """Comma lists as one: a's items first, case aside each once."""
    from shelfspark.functions.text import distinct_folded

    items = F.transform(F.split(F.concat_ws(",", a, b), ","), lambda x: F.btrim(x))
    return F.array_join(distinct_folded(F.filter(items, lambda x: x != "")), ", ")


def grow_categories(catalog: DataFrame, incoming: DataFrame, key: str = "code") -> DataFrame:
    """Incoming rows with the stored categories in front of theirs: the list only grows."""
    stored = catalog.select(key, F.col("category").alias("_stored"))
    return incoming.join(stored, key, "left").withColumn("category", union_text(F.col("_stored"), F.col("category"))).drop("_stored")


def kept_image(same: Column, own: Column, stored: Column) -> Column:
    """A record's own value, or the stored one while the image's address is the same."""
    return F.when(~is_blank(own), own).when(same, F.coalesce(stored, own)).otherwise(own)


def carry_images(catalog: DataFrame, incoming: DataFrame, key: str = "code") -> DataFrame:
    """image_path of the record itself, or of the stored one while the address is the same, and needs_image: there is an
    address and no path, so the image has to be fetched."""
    stored = catalog.select(key, F.col("image_url").alias("_url"), F.col("image_path").alias("_path"))
    own = F.col("image_path") if "image_path" in incoming.columns else F.lit("")
    joined = incoming.join(stored, key, "left").withColumn("image_path", F.coalesce(kept_image(F.col("image_url").eqNullSafe(F.col("_url")), own, F.col("_path")), F.lit("")))
    return joined.withColumn("needs_image", ~is_blank(F.col("image_url")) & is_blank(F.col("image_path"))).drop("_url", "_path")


def classify(catalog: DataFrame, occurrences: DataFrame, now: Column | None = None) -> DataFrame:
    """One row for each code of the catalog or of the occurrences, from one aggregation of these and one join: code, status
    (null where nothing came in), changed (names of fields), old and next (structs of the catalog's columns).

    What comes in is consolidated; its categories stand behind the stored ones, its images are kept as in ``kept_image``;
    columns that it lacks keep their stored values.  With ``now``, updated_at of new and changed rows is set to it.
    """
    columns = [c for c in catalog.columns if c != "code"]
    incoming = to_catalog(co.consolidate(occurrences))
    incoming = incoming.select("code", F.struct(*[c for c in incoming.columns if c in columns]).alias("n"))
    fields = {f.name for f in incoming.schema["n"].dataType}
    joined = catalog.select("code", F.struct(*columns).alias("old")).join(incoming, "code", "full")
    stored, came = F.col("old").isNotNull(), F.col("n").isNotNull()
    value = {c: F.col(f"n.{c}") if c in fields else F.col(f"old.{c}") for c in columns}
    if "category" in fields:
        value["category"] = F.when(stored, union_text(F.col("old.category"), F.col("n.category"))).otherwise(F.col("n.category"))
    same = F.col("old.image_url").eqNullSafe(F.col("n.image_url")) if "image_url" in fields else F.lit(True)
    for c in {"image_path", "image_hash"} & fields:
        value[c] = F.when(stored, kept_image(same, F.col(f"n.{c}"), F.col(f"old.{c}"))).otherwise(F.col(f"n.{c}"))
    rows = joined.select("code", "old", came.alias("came"), stored.alias("stored"), F.struct(*[value[c].alias(c) for c in columns]).alias("new"))
    differs = lambda c: F.when(~d.comparable(catalog, c, F.col(f"old.{c}")).eqNullSafe(d.comparable(catalog, c, F.col(f"new.{c}"))), F.lit(c))
    listed = lambda names: F.filter(F.array(*[differs(c) for c in names if c in fields]).cast("array<string>"), lambda x: x.isNotNull())
    rows = rows.withColumns({"_texts": listed(d.CONTENT_FIELDS), "_images": listed(d.IMAGE_FIELDS)})
    status = (
        F.when(~F.col("came"), F.lit(None)).when(~F.col("stored"), d.NEW).when(F.size("_texts") > 0, d.UPDATED)
        .when(F.size("_images") > 0, d.IMAGE_CHANGED).otherwise(d.UNCHANGED)
    )
    rows = rows.withColumns({"status": status, "changed": F.when(F.col("came") & F.col("stored"), F.concat("_texts", "_images")).otherwise(F.array().cast("array<string>"))})
    after = F.when(F.col("came"), F.col("new")).otherwise(F.col("old"))
    if now is not None and "updated_at" in columns:
        after = F.when(F.col("status").isin(d.NEW, d.UPDATED, d.IMAGE_CHANGED), F.col("new").withField("updated_at", now)).otherwise(after)
    return rows.select("code", "status", "changed", "old", after.alias("next"))


def next_catalog(classified: DataFrame) -> DataFrame:
    return classified.select("code", "next.*")


def change_rows(classified: DataFrame, fields: tuple[str, ...] = d.LOGGED_FIELDS) -> DataFrame:
    """The change log of a classified frame, as ``diff.change_log`` has it."""
    kinds = {f.name: f.dataType for f in classified.schema["next"].dataType} | {"code": classified.schema["code"].dataType}
    is_new, entries = F.col("status") == d.NEW, []
    for f in (f for f in fields if f in kinds):
        before = F.lit(None).cast("string") if f == "code" else F.when(~is_new, d.kind_text(kinds[f], F.col(f"old.{f}")))
        after = d.kind_text(kinds[f], F.col("code") if f == "code" else F.col(f"next.{f}"))
        differs = is_new if f == "code" else is_new | ~before.eqNullSafe(after)
        entries.append(F.when(differs, F.struct(F.lit(f).alias("field_name"), before.alias("old_value"), after.alias("new_value"))))
    name = F.col("next.name") if "name" in kinds else F.lit(None).cast("string")
    rows = classified.where(F.col("status").isNotNull() & (F.col("status") != d.UNCHANGED))
    rows = rows.select(F.when(is_new, d.NEW).otherwise(d.UPDATED).alias("change_type"), "code", name.alias("product_name"), F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
    return rows.select("change_type", "code", "product_name", "e.field_name", "e.old_value", "e.new_value")


def sync(catalog: DataFrame, occurrences: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next catalog, change log, counts) from the stored catalog and a run's occurrences: three views of one frame."""
    frame = classify(catalog, occurrences, now)
    return next_catalog(frame), change_rows(frame), d.status_counts(frame.where(F.col("status").isNotNull()))


def snapshot_sync(old: DataFrame, new: DataFrame, apply_removals: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, classified keys); the last of repeated keys counts, removed keys stay unless asked."""
    new = co.last_per_key(co.with_key(new), "code") if "pos" in new.columns else new
    classified = d.snapshot_diff(old, new)
    out = upsert(old, new)
    return (delete(out, classified.where(F.col("status") == d.REMOVED)) if apply_removals else out), classified


def upsert_landing(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Two-step match: by url, what is left by code; a matched row takes all incoming columns, its url too.

    id is the stored row's; unmatched incoming rows get null.
    """
    ids = stored.select("id", "url", "code")
    by_url = incoming.join(ids.select("id", "url"), "url")
    rest = incoming.join(by_url.select("url"), "url", "left_anti")
    open_ids = ids.join(by_url.select("id"), "id", "left_anti").where("code IS NOT NULL").groupBy("code").agg(F.min("id").alias("id"))
    by_code = rest.join(open_ids, "code", "left")
    arrived = by_url.unionByName(by_code).select(*stored.columns)
    kept = stored.join(arrived.select("id").where("id IS NOT NULL"), "id", "left_anti")
    return kept.unionByName(arrived)


def unknown_rows(incoming: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    return incoming.join(stored.select(key), key, "left_anti")


def run_row(counts: DataFrame, run_id: int, started: dt.datetime, finished: dt.datetime, errors: int) -> DataFrame:
    """A history row: SUCCESS, or ERROR when there were errors or the counts do not agree."""
    ok = F.col("consistent") & F.lit(errors == 0)
    return counts.select(
        F.lit(run_id).cast("long").alias("id"), F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at"),
        F.col("processed").cast("int"), F.col("created").cast("int"), (F.col("updated") + F.col("image_changed")).cast("int").alias("updated"),
        F.col("unchanged").cast("int"), F.lit(errors).alias("errors"), F.when(ok, "SUCCESS").otherwise("ERROR").alias("status"),
        F.when(ok, "").otherwise("not applied").alias("message"),
    )


def publish(tables: Publication, catalog: DataFrame, log: DataFrame, run: DataFrame, state: dict | None = None, buckets: list[int] | None = None, batch: tuple[str, int] | None = None) -> bool:
    """All or nothing, in one commit on top of ``state`` (the last one): catalog, changes and the run's row.

    A run with errors changes no catalog and logs no changes, but its row is written.  A failure at any point leaves
    readers the old state, and two runs that started from one state cannot both be published (``Conflict``).
    buckets: the catalog is kept by code, and only these buckets of it are given.
    """
    state = state or tables.state()
    row = run.first()
    ok = row["status"] == "SUCCESS"
    appended = {"runs": tables.stage("runs", run)}
    if not ok:
        tables.commit(state, append=appended, batch=batch)
        return ok
    appended["changes"] = tables.stage("changes", log.withColumn("history_id", F.lit(row["id"])))
    if buckets is None:
        tables.commit(state, replace={"catalog": tables.stage("catalog", catalog)}, append=appended, batch=batch)
    else:
        tables.commit(state, buckets={"catalog": (buckets, tables.stage("catalog", catalog, "code"))}, append=appended, batch=batch)
    return ok


def summary(runs: DataFrame) -> DataFrame:
    """Totals of several runs, and their duration in seconds."""
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return runs.agg(*[F.sum(c).alias(c) for c in ("processed", "created", "updated", "unchanged", "errors")], F.sum(seconds).alias("seconds"))
