"""Registered queries on records, images, runs and lists, each with the SQL that must agree."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text as t
from shelfspark.operators import audit, browse, replay, sync
from shelfspark.operators import consolidate as co
from shelfspark.operators import diff as df
from shelfspark.operators import pages as pg
from shelfspark.plans.catalog import _LOG, LOG_FIELDS, _published, query, snapshot_diff
from shelfspark.plans.inputs import DIFF, NEW, OCC, OLD, new_snapshot, occurrences, old_snapshot
from shelfspark.sources.commits import Publication
from shelfspark.sources.tables import RUNS, flags, in_order, lookup_one, schema, table
from shelfspark.streaming.jobs import scratch

S = SparkSession
KEY = "p_partkey"


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


@query(f"WITH {DIFF} SELECT code, len(list_filter(string_split(changed, ','), lambda x: x NOT IN ('', 'image_url'))) > 0 AS content_changed, contains(changed, 'image_url') AS image_changed, changed <> '' AS any_changed FROM diff WHERE status NOT IN ('NEW', 'REMOVED')")
def diff_flags(s: S, d: str) -> DataFrame:
    return df.diff_flags(snapshot_diff(s, d))


@query("""WITH r AS (SELECT 'https://shop.example/' || p_partkey AS url, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'FB-' || p_partkey END AS code, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS name,
    p_retailprice AS price, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END, 0) AS stock, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Rojo=' || greatest(p_size - 25, 0) END AS colors FROM part)
  SELECT 'importacionesfacundo' AS source, url, code, name, price, stock, colors, TIMESTAMP '2024-01-01 00:00:00' AS scraped_at,
    sha256(concat_ws('|', code, name, '', '', printf('%.2f', price), '0.00', '0.00', '0.00', stock::VARCHAR, colors)) AS content_hash FROM r""")
def landing_records(s: S, d: str) -> DataFrame:
    k = F.col(KEY)
    colors = F.create_map(F.lit(" Rojo "), F.col("p_size") - 25)
    rows = table(s, d, "part").select(
        _text("https://shop.example/", k).alias("url"), F.when(k % 5 != 0, _text("FB-", k)).alias("code"), F.when(k % 7 != 0, F.col("p_name")).alias("name"),
        F.col("p_retailprice").alias("price"), F.when(k % 3 != 0, F.col("p_size")).alias("stock"), F.when(k % 4 != 0, colors).alias("color_stock"),
    )
    made = sync.landing_record(rows, F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))
    return made.select("source", "url", "code", "name", "price", "stock", t.map_text(F.col("color_stock")).alias("colors"), "scraped_at", "content_hash")


@query("""SELECT p_partkey AS id, trim(p_name) AS name, array_to_string(list_filter(['A=' || greatest(p_size - 10, 0), CASE WHEN p_partkey % 2 = 0 THEN 'B=' || p_size END], lambda x: x IS NOT NULL), ',') AS colors FROM part""")
def normalised_records(s: S, d: str) -> DataFrame:
    k, size = F.col(KEY), F.col("p_size")
    colors = F.create_map(F.lit("\tA "), size - 10, F.when(k % 2 == 0, " B").otherwise("  "), size)
    rows = table(s, d, "part").select(k.alias("id"), _text(" \t", F.col("p_name"), "\n ").alias("name"), colors.alias("color_stock"))
    return audit.normalise(rows).select("id", "name", t.map_text(F.col("color_stock")).alias("colors"))


@query("""SELECT 'FB-' || p_partkey AS code, p_name AS name, p_retailprice AS price FROM part WHERE p_partkey % 11 <> 0 AND p_size - 3 >= 0""")
def accepted_records(s: S, d: str) -> DataFrame:
    k = F.col(KEY)
    rows = table(s, d, "part").select(F.when(k % 11 == 0, "  ").otherwise(_text(" FB-", k)).alias("code"), _text(F.col("p_name"), " ").alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_size") - 3).alias("stock"))
    rows = rows.withColumns({c: F.lit(0.0) for c in ("price_sample", "price_hundred", "price_thousand")})
    return audit.gate(rows, audit.product_rules())[0].select("code", "name", "price")


@query("""SELECT p_partkey AS code, 'no price' AS reason FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT p_partkey, 'no image' FROM part WHERE p_partkey % 4 = 0""")
def incomplete_records(s: S, d: str) -> DataFrame:
    k = F.col(KEY)
    rows = table(s, d, "part").select(k.alias("code"), F.when(k % 2 != 0, F.col("p_retailprice")).alias("price"), F.when(k % 3 != 0, F.col("p_retailprice")).otherwise(0.0).alias("price_sample"), F.when(k % 4 != 0, "x.jpg").otherwise(" ").alias("image_url"))
    priced, shown = audit.without_price(rows, "price", "price_sample"), audit.without_image(rows)
    return priced.select("code", F.lit("no price").alias("reason")).unionByName(shown.select("code", F.lit("no image").alias("reason")))


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'Fb-' || (p_partkey // 2) END AS code, 'u' || (p_partkey % 50) AS url, p_partkey AS pos, p_name AS name FROM part),
  k AS (SELECT *, CASE WHEN code <> '' THEN 'code:' || lower(code) ELSE 'url:' || url END AS key FROM p), f AS (SELECT key, arg_min(name, pos) AS detail FROM k WHERE pos % 3 <> 1 GROUP BY key)
  SELECT pos AS id, detail FROM k LEFT JOIN f USING (key)""")
def enriched_once(s: S, d: str) -> DataFrame:
    k = F.col(KEY)
    rows = table(s, d, "part").select(F.when(k % 9 == 0, "").otherwise(_text("Fb-", F.floor(k / 2))).alias("code"), _text("u", k % 50).alias("url"), k.alias("pos"), F.col("p_name").alias("name"))
    found = audit.enrich_once(rows, rows.where("pos % 3 <> 1"), audit.detail_key(F.col("code"), F.col("url")))
    return found.select(F.col("pos").alias("id"), F.col("detail.name").alias("detail"))


@query(f"WITH {OCC} SELECT code, string_agg(color, ',' ORDER BY pos) AS colors FROM (SELECT code, color, min(pos) AS pos FROM occ GROUP BY ALL) GROUP BY code")
def colors_union(s: S, d: str) -> DataFrame:
    rows = occurrences(s, d).select("code", "pos", F.array(_text(" ", F.col("color")), F.lit(" ")).alias("colors"))
    return co.consolidate(rows).select("code", F.array_join("colors", ",").alias("colors"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'a/FB_' || p_partkey || '.PNG' ELSE 'b/FB_' || p_partkey || '.jpg' END AS image_path FROM part""")
def image_lookup(s: S, d: str) -> DataFrame:
    k = F.col(KEY)
    part = table(s, d, "part")
    stem = lambda folder, end: _text(f"{folder}/FB_", k, end)
    paths = part.where("p_partkey % 3 <> 0").select(F.explode(F.array(stem("b", ".jpg"), F.when(k % 2 == 0, stem("a", ".PNG")), stem("a", ".txt"))).alias("path")).where("path IS NOT NULL")
    return audit.with_images(part.select(k.alias("id"), _text("FB/", k).alias("code")), audit.image_index(paths)).select("id", "image_path")


@query("SELECT count(*) FILTER (p_partkey % 3 <> 0) AS processed, count(*) FILTER (p_partkey % 5 = 0) AS failed FROM part")
def image_counters(s: S, d: str) -> DataFrame:
    k = F.col(KEY)
    return audit.image_counts(table(s, d, "part").select(F.when(k % 3 != 0, "x.jpg").otherwise(" ").alias("image_path"), F.when(k % 5 == 0, "HTTP 404").alias("image_error")))


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def allowed_rows(s: S, d: str) -> DataFrame:
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return browse.allowed(browse.allowed(rows, "segment", []), "segment", ["BUILDING", "MACHINERY"])


@query("SELECT DISTINCT p_brand AS category FROM part WHERE p_brand IN ('Brand#1', 'Brand#3', 'Brand#11', 'Brand#13')")
def selected_facets(s: S, d: str) -> DataFrame:
    brands = table(s, d, "part").select(F.col("p_brand").alias("category"))
    selected = table(s, d, "nation").select(_text("Brand#", F.col("n_nationkey")).alias("category")).where("category IN ('Brand#1', 'Brand#3', 'Brand#11', 'Brand#13')")
    more = table(s, d, "region").select(_text("Brand#", F.col("r_regionkey") + 1000).alias("category"))
    return browse.still_there(selected.unionByName(more), browse.facets(brands))


@query("SELECT p_partkey AS pos, p_name AS name FROM part ORDER BY p_partkey LIMIT 5")
def first_records(s: S, d: str) -> DataFrame:
    return browse.first_rows(table(s, d, "part").select(F.col(KEY).alias("pos"), F.col("p_name").alias("name")), 5)


@query("SELECT n_name AS name, n_nationkey AS pos, 0 AS list_no FROM nation UNION ALL SELECT r_name, r_regionkey, 1 FROM region UNION ALL SELECT n_name, n_nationkey, 2 FROM nation")
def listed_rows(s: S, d: str) -> DataFrame:
    nations = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    regions = table(s, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("pos"))
    return browse.bag_union(nations, regions, nations)


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS text, date_trunc('second', o_orderdate) AS again FROM orders")
def iso_times(s: S, d: str) -> DataFrame:
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), t.iso_text(F.col("o_orderdate")).alias("text"))
    return rows.select("id", "text", F.date_trunc("second", t.iso_time(F.col("text"))).cast("timestamp_ntz").alias("again"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, least(100, CASE WHEN l_quantity > 25 THEN (l_linenumber * 100) // 5 ELSE 0 END)::INT AS done FROM lineitem")
def progress(s: S, d: str) -> DataFrame:
    whole = F.when(F.col("l_quantity") > 25, 5).otherwise(0)
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), t.percent(F.col("l_linenumber"), whole).alias("done"))


@query("SELECT s_nationkey AS nation, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS pos FROM supplier")
def item_positions(s: S, d: str) -> DataFrame:
    return co.position(table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id")), ["nation"], [F.col("id")])


@query("SELECT o_orderkey AS id, 'u' || (o_orderkey % 1000) AS url FROM orders WHERE o_orderkey % 1000 = 7 ORDER BY id")
def landing_scan(s: S, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return in_order(lookup_one(table(s, d, "orders").select(k.alias("id"), _text("u", k % 1000).alias("url")), "u7", "url"))


_CHANGES = "history_id long, change_type string, code string, product_name string, field_name string, old_value string, new_value string"


def _changes(s: S, d: str) -> DataFrame:
    """The published changes, with texts as codes and an order."""
    kind = schema(_CHANGES.replace("code string", "code long"))
    rows = _published(s, d).read("changes", kind).withColumn("code", _text("FB-", F.col("code")))
    return rows.withColumns({"id": F.xxhash64("code", "field_name"), "field_label": F.initcap("field_name")})


@query(f"""{_LOG} SELECT 'FB-' || code AS code, CASE change_type WHEN 'NEW' THEN 'NUEVO' ELSE 'ACTUALIZADO' END AS label,
  CASE field_name WHEN 'image_url' THEN 'Image_url' ELSE upper(field_name[1]) || field_name[2:] END AS field_label, coalesce(nullif(trim(old_value), ''), '—') AS old_value, coalesce(nullif(trim(new_value), ''), '—') AS new_value FROM log""")
def run_detail(s: S, d: str) -> DataFrame:
    return browse.change_view(browse.changes_of_run(_changes(s, d), 1))


@query("SELECT 2::BIGINT AS id, 'ERROR' AS status, 'ERROR' AS label UNION ALL SELECT 1, 'SUCCESS', 'APLICADO'")
def run_history(s: S, d: str) -> DataFrame:
    return browse.history_view(_published(s, d).read("runs", RUNS)).select("id", "status", "label")


@query(f"""WITH {DIFF} SELECT 1::BIGINT AS id, count(*) FILTER (status <> 'REMOVED')::INT AS processed, 'SUCCESS' AS status FROM diff""")
def one_run(s: S, d: str) -> DataFrame:
    return lookup_one(_published(s, d).read("runs", RUNS), 1, "id").select("id", "processed", "status")




@query(f"WITH {NEW} SELECT code, name, category, round(price, 2) AS price, stock, image_url FROM new")
def restored_catalog(s: S, d: str) -> DataFrame:
    """An empty catalog filled from the published log of (nothing to old to new), and marked in the same commit."""
    tables, old, new = Publication(s, f"{scratch(s)}/tables"), old_snapshot(s, d), new_snapshot(s, d)
    gone = df.only_in(old, new)
    first = df.change_log(old.limit(0), sync.delete(old, gone), fields=LOG_FIELDS).withColumn("history_id", F.lit(1).cast("long"))
    then = df.change_log(old, new, fields=LOG_FIELDS).withColumn("history_id", F.lit(2).cast("long"))
    tables.commit(tables.state(), append={"changes": tables.stage("changes", first.unionByName(then))})
    changes = schema(_CHANGES.replace("code string", "code long"))
    kind = schema("code long, name string, category string, price double, stock int, image_url string")
    again = [replay.restore(tables, kind, changes) for _ in range(2)]
    if again[1] != 0:
        raise AssertionError("a catalog that is ready was restored again")
    return tables.read("catalog", kind)


@query(f"WITH {NEW} SELECT * FROM new")
def snapshot_sync(s: S, d: str) -> DataFrame:
    return sync.snapshot_sync(old_snapshot(s, d), new_snapshot(s, d), apply_removals=True)[0]


@query(f"WITH {OLD}, {NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE code NOT IN (SELECT code FROM old)")
def inserted_rows(s: S, d: str) -> DataFrame:
    old, new = old_snapshot(s, d), new_snapshot(s, d)
    return sync.insert(old, sync.delete(new, old))


@query(f"WITH {OCC} SELECT code, coalesce(arg_min(color || '!', pos) FILTER (stock > 40), '') AS description FROM occ GROUP BY code")
def filled_blanks(s: S, d: str) -> DataFrame:
    rows = occurrences(s, d).withColumn("description", F.when(F.col("stock") > 40, _text(F.col("color"), "!")).when(F.col("stock") > 20, "  "))
    return co.consolidate(rows.select("code", "pos", "description")).select("code", "description")


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '/img/fb-' || p_partkey || '.jpg' WHEN 1 THEN '/uploads/x.jpg' WHEN 2 THEN '/other.png' ELSE '' END AS image_url FROM part""")
def image_choice(s: S, d: str) -> DataFrame:
    k = F.col(KEY)
    named, upload, other = F.when(k % 4 == 0, _text("/img/fb-", k, "-300x300.jpg")), F.when(k % 4 < 2, "/uploads/x-150x150.jpg"), F.when(k % 4 < 3, "/other.png")
    listed = F.array_compact(F.array(F.lit("data:image/png;base64,x"), F.lit("/Logo.png"), F.lit("/img/placeholder-600x600.jpg"), other, upload, named))
    return table(s, d, "part").select(k.alias("id"), pg.best_image(listed, _text("FB-", k)).alias("image_url"))


@query("""SELECT p_partkey AS id, p_partkey % 5 < 3 AS content_ok, p_partkey % 3 <> 2 AS name_ok, CASE p_partkey % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.webp' ELSE '.jpg' END AS extension FROM part""")
def image_checks(s: S, d: str) -> DataFrame:
    k = F.col(KEY)
    content = F.unhex(F.get(F.array(F.lit("FFD8FFE0"), F.lit("89504E470D0A"), F.lit("52494646AA"), F.lit("47494638"), F.lit("")), (k % 5).cast("int")))
    name = F.when(k % 3 == 0, _text("http://x/", k, ".PNG?v=1")).when(k % 3 == 1, _text("http://x/", k, ".webp")).otherwise(_text("http://x/", k))
    return table(s, d, "part").select(k.alias("id"), t.is_image_content(content).alias("content_ok"), t.is_image_name(F.regexp_replace(name, r"\?.*$", "")).alias("name_ok"), t.extension(name).alias("extension"))


@query("""SELECT p_partkey AS id, p_size || ' ' || (p_partkey % 1000) AS stocks, 'Rojo|Gris Gun|Azul' AS colors, p_retailprice AS price, 6.5 AS sample, 1234.0 AS hundred, 0.0 AS thousand FROM part""")
def said_in_texts(s: S, d: str) -> DataFrame:
    """Numbers behind a marker, lists of colors and prices by label, as cards say them."""
    k = F.col(KEY)
    stock = _text("Precio: 9 STOCK  Disponible: ", F.col("p_size"), " ", F.format_number(k % 1000, 0), " unidades")
    colors = F.lit("Colores: Rojo, Gris Gun, rojo y Azul (varios)")
    prices = F.lit("Muestra: S/ 6.50 Ciento S/ 1,234.00 Millar: consultar")
    return table(s, d, "part").select(
        k.alias("id"), F.array_join(F.transform(t.numbers_after(stock), lambda n: n.cast("string")), " ").alias("stocks"), F.array_join(t.color_list(colors), "|").alias("colors"),
        t.first_price(F.lit("gratis"), _text("S/. ", F.format_number("p_retailprice", 2), " soles")).alias("price"),
        *[t.price_by_label(prices, w).alias(n) for n, w in (("sample", "Muestra"), ("hundred", "Ciento"), ("thousand", "Millar"))],
    )


@query("SELECT r_name AS key, r_regionkey % 2 = 1 AS set FROM region")
def metadata_flags(s: S, d: str) -> DataFrame:
    value = F.when(F.col("r_regionkey") % 2 == 1, "1").otherwise("0")
    return flags(table(s, d, "region").select(F.col("r_name").alias("key"), value.alias("value")))
