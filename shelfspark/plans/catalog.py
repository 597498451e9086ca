"""Registered queries on snapshots, occurrences, logs and catalogs, each with the SQL that must agree."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import text as t
from shelfspark.operators import audit, browse, replay, sync
from shelfspark.operators import consolidate as co
from shelfspark.operators import diff as df
from shelfspark.plans.inputs import DIFF, NEW, OCC, OLD, colored, event_log, new_snapshot, occurrences, old_snapshot
from shelfspark.sources.commits import Publication
from shelfspark.sources.tables import conform, lookup, newest_first, schema, spread, table
from shelfspark.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


S = SparkSession
LOG_FIELDS = ("name", "category", "price", "stock", "image_url")


@query(f"WITH {DIFF} SELECT * FROM diff")
def snapshot_diff(s: S, d: str) -> DataFrame:
    return df.snapshot_diff(old_snapshot(s, d), new_snapshot(s, d))


@query(f"""WITH {DIFF} SELECT count(*) FILTER (status <> 'REMOVED') AS processed, count(*) FILTER (status = 'NEW') AS created,
  count(*) FILTER (status = 'UPDATED') AS updated, count(*) FILTER (status = 'IMAGE_CHANGED') AS image_changed,
  count(*) FILTER (status = 'UNCHANGED') AS unchanged, count(*) FILTER (status = 'REMOVED') AS removed, true AS consistent FROM diff""")
def snapshot_counts(s: S, d: str) -> DataFrame:
    return df.status_counts(snapshot_diff(s, d))


@query(f"WITH {OLD}, {NEW} SELECT code FROM old WHERE code NOT IN (SELECT code FROM new)")
def removed_keys(s: S, d: str) -> DataFrame:
    return df.only_in(old_snapshot(s, d), new_snapshot(s, d))


@query(f"WITH {OLD}, {NEW} SELECT code FROM new WHERE code NOT IN (SELECT code FROM old)")
def new_keys(s: S, d: str) -> DataFrame:
    return df.only_in(new_snapshot(s, d), old_snapshot(s, d))


@query(f"WITH {DIFF} SELECT code FROM diff WHERE status IN ('NEW', 'UPDATED')")
def changed_keys(s: S, d: str) -> DataFrame:
    return df.changed_keys(snapshot_diff(s, d))


def _text(f: str, side: str) -> str:
    return f"printf('%.2f', {side}.price)" if f == "price" else f"{side}.{f}::VARCHAR"


_LOG = "WITH " + OLD + ", " + NEW + ", log AS (" + " UNION ALL ".join(
    f"SELECT CASE WHEN o.code IS NULL THEN 'NEW' ELSE 'UPDATED' END AS change_type, n.code, n.name AS product_name, '{f}' AS field_name, "
    f"CASE WHEN o.code IS NOT NULL THEN {_text(f, 'o')} END AS old_value, {_text(f, 'n')} AS new_value FROM new n LEFT JOIN old o ON o.code = n.code "
    f"WHERE o.code IS NULL OR {_text(f, 'o')} <> {_text(f, 'n')}" for f in LOG_FIELDS) + ")"  # fmt: skip


@query(f"{_LOG} SELECT * FROM log")
def change_log(s: S, d: str) -> DataFrame:
    return df.change_log(old_snapshot(s, d), new_snapshot(s, d), fields=LOG_FIELDS)


@query(f"""{_LOG} SELECT DISTINCT code, product_name, 'Alta' AS field_name, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM log WHERE change_type = 'NEW'
  UNION ALL SELECT code, product_name, field_name, old_value, new_value FROM log WHERE change_type = 'UPDATED'""")
def result_rows(s: S, d: str) -> DataFrame:
    return df.result_rows(change_log(s, d))


_UPSERT = f"WITH {OLD}, {NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE code NOT IN (SELECT code FROM new)"


@query(_UPSERT)
def upsert_merge(s: S, d: str) -> DataFrame:
    return sync.upsert(old_snapshot(s, d), new_snapshot(s, d))


@query(f"WITH {OLD}, {NEW} SELECT * FROM old WHERE code NOT IN (SELECT code FROM new)")
def delete_keys(s: S, d: str) -> DataFrame:
    return sync.delete(old_snapshot(s, d), new_snapshot(s, d))


@query(f"WITH {OLD}, {NEW} SELECT * FROM old WHERE code IN (SELECT code FROM new)")
def key_lookup(s: S, d: str) -> DataFrame:
    return lookup(old_snapshot(s, d), new_snapshot(s, d))


@query(f"WITH {OLD} SELECT * FROM old ORDER BY code DESC")
def catalog_scan(s: S, d: str) -> DataFrame:
    return newest_first(old_snapshot(s, d), "code")


@query("SELECT p_partkey AS code, p_name AS name, 'none' AS category, 0.0::DOUBLE AS price_sample, p_size::BIGINT AS stock FROM part")
def conform_schema(s: S, d: str) -> DataFrame:
    part = table(s, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_size").alias("stock"), F.col("p_type").alias("colors"))
    return conform(part, schema("code long, name string, category string, price_sample double, stock long"), {"category": "none", "price_sample": 0.0})


def _merged(s: S, d: str, colors: bool = False) -> DataFrame:
    """OCC made one record for each code: the first row's stock and price, categories by first place, and colors if asked for."""
    rows = co.consolidate(colored(occurrences(s, d)) if colors else occurrences(s, d).drop("color"))
    return rows.select("code", "stock", "price", F.col("category").alias("categories"), *["color_stock"] * colors)


_UNION = """u AS (SELECT code, string_agg(category, ', ' ORDER BY pos) AS categories FROM
  (SELECT code, category, min(pos) AS pos FROM occ GROUP BY code, category) GROUP BY code)"""
_COLORS = "c AS (SELECT code, color, max(stock) AS stock FROM occ GROUP BY code, color)"


@query(f"""WITH {OCC}, {_UNION}, {_COLORS}, f AS (SELECT code, arg_min(stock, pos) AS stock, arg_min(price, pos) AS price FROM occ GROUP BY code),
  m AS (SELECT code, string_agg(color || '=' || stock, ',' ORDER BY color) AS colors FROM c GROUP BY code)
  SELECT code, f.stock, f.price, categories, colors FROM f JOIN u USING (code) JOIN m USING (code)""")
def consolidate(s: S, d: str) -> DataFrame:
    rows = co.consolidate(colored(occurrences(s, d)))
    return rows.select("code", "stock", "price", F.col("category").alias("categories"), t.map_text(F.col("color_stock")).alias("colors"))


@query(f"WITH {OCC}, {_UNION} SELECT * FROM u")
def category_union(s: S, d: str) -> DataFrame:
    return co.ordered_union(occurrences(s, d), "code", "category", name="categories")


@query(f"WITH {OCC}, {_COLORS} SELECT code, color, stock, sum(stock) OVER (PARTITION BY code)::BIGINT AS total FROM c")
def map_max_merge(s: S, d: str) -> DataFrame:
    colors = co.max_by_entry(occurrences(s, d), "code", "color", "stock")
    total = colors.groupBy("code").agg(F.sum("stock").alias("total"))
    return colors.join(total, "code").select("code", "color", "stock", "total")


@query(f"WITH {OCC} SELECT code, category, color, stock, price FROM occ QUALIFY row_number() OVER (PARTITION BY code ORDER BY pos DESC) = 1")
def last_wins(s: S, d: str) -> DataFrame:
    return co.last_per_key(occurrences(s, d), "code").drop("pos")


@query(f"""WITH {OCC} SELECT code, count(DISTINCT category) AS n, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories
  FROM occ GROUP BY code HAVING count(DISTINCT category) > 1""")
def multi_category(s: S, d: str) -> DataFrame:
    return audit.multi_category(occurrences(s, d))


@query(f"WITH {OCC} SELECT category, count(*) AS appearances, count(DISTINCT code) AS codes FROM occ GROUP BY category")
def category_counts(s: S, d: str) -> DataFrame:
    return audit.category_counts(occurrences(s, d))


_SYNC = f"""WITH {OCC}, {_UNION}, {OLD}, f AS (SELECT code, arg_min(stock, pos) AS stock FROM occ GROUP BY code),
  inc AS (SELECT f.code, f.stock, CASE WHEN o.category IS NULL THEN u.categories ELSE o.category || ', ' || u.categories END AS category
    FROM f JOIN u USING (code) LEFT JOIN old o ON o.code = f.code)"""


@query(f"""{_SYNC} SELECT count(*) AS processed, count(*) FILTER (o.code IS NULL) AS created,
  count(*) FILTER (o.code IS NOT NULL AND (o.stock <> inc.stock OR o.category <> inc.category)) AS updated, 0::BIGINT AS image_changed,
  count(*) FILTER (o.stock = inc.stock AND o.category = inc.category) AS unchanged, 0::BIGINT AS removed, true AS consistent
  FROM inc LEFT JOIN old o ON o.code = inc.code""")
def catalog_sync(s: S, d: str) -> DataFrame:
    catalog = old_snapshot(s, d).select("code", "category", "stock")
    return sync.sync(catalog, colored(occurrences(s, d)))[2]


def _after(n: int, before: str, occ: str) -> str:
    """SQL: the catalog c{n} (code, category, stock) and the run r{n} after the occurrences ``occ`` on the catalog ``before``."""
    return f"""u{n} AS (SELECT code, list(category ORDER BY pos) AS cs FROM (SELECT code, category, min(pos) AS pos FROM {occ} GROUP BY ALL) GROUP BY code),
  f{n} AS (SELECT code, arg_min(stock, pos) AS stock FROM {occ} GROUP BY code),
  i{n} AS (SELECT f.code, f.stock, o.code IS NOT NULL AS stored, o.stock AS old_stock, o.category AS old_category, CASE WHEN o.code IS NULL THEN array_to_string(cs, ', ') ELSE
    concat_ws(', ', o.category, nullif(array_to_string(list_filter(cs, lambda x: NOT list_contains(string_split(lower(o.category), ', '), lower(x))), ', '), '')) END AS category
    FROM f{n} f JOIN u{n} u USING (code) LEFT JOIN {before} o ON o.code = f.code),
  c{n} AS (SELECT code, category, stock FROM i{n} UNION ALL SELECT code, category, stock FROM {before} WHERE code NOT IN (SELECT code FROM i{n})),
  r{n} AS (SELECT {n}::BIGINT AS id, count(*)::INT AS processed, count(*) FILTER (NOT stored)::INT AS created, count(*) FILTER (stored AND (stock <> old_stock OR category <> old_category))::INT AS updated,
    count(*) FILTER (stock = old_stock AND category = old_category)::INT AS unchanged, 0::INT AS errors, 'SUCCESS' AS status FROM i{n})"""


_TWO = f"""WITH {OCC}, {OLD}, o1 AS (SELECT * FROM occ WHERE line <= 3), o2 AS (SELECT * FROM occ WHERE line > 3), {_after(1, 'old', 'o1')}, {_after(2, 'c1', 'o2')}"""


@query(f"{_TWO} SELECT * FROM c2")
def stream_catalog(s: S, d: str) -> DataFrame:
    tables, kind = jobs.sync_occurrences(s, d)
    return tables.read("catalog", kind)


@query(f"{_TWO} SELECT * FROM r1 UNION ALL SELECT * FROM r2")
def stream_runs(s: S, d: str) -> DataFrame:
    return jobs.published_runs(jobs.sync_occurrences(s, d)[0])


_RUN = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 1)


def _published(s: S, d: str) -> Publication:
    """The old snapshot published, then the new one by a run without errors, and nothing by a run with errors."""
    tables = Publication(s, f"{jobs.scratch(s)}/tables")
    old, new = old_snapshot(s, d), new_snapshot(s, d)
    tables.commit(tables.state(), replace={"catalog": tables.stage("catalog", old, "code")})
    for number, errors in ((1, 0), (2, 3)):
        stored = tables.read("catalog", old.schema)
        incoming = new if number == 1 else new.withColumn("stock", F.col("stock") + 1)
        after, found = sync.snapshot_sync(stored, incoming)
        run = sync.run_row(df.status_counts(found.where(F.col("status") != df.REMOVED)), number, *_RUN, errors)
        sync.publish(tables, after, df.change_log(stored, incoming, fields=LOG_FIELDS), run)
    return tables


@query(_UPSERT)
def publish_catalog(s: S, d: str) -> DataFrame:
    return _published(s, d).read("catalog", old_snapshot(s, d).schema)


@query(f"{_LOG} SELECT 1::BIGINT AS history_id, * FROM log")
def publish_changes(s: S, d: str) -> DataFrame:
    kind = schema("history_id long, change_type string, code long, product_name string, field_name string, old_value string, new_value string")
    return _published(s, d).read("changes", kind)


@query(f"""WITH {DIFF}, n AS (SELECT count(*) FILTER (status <> 'REMOVED')::INT AS processed, count(*) FILTER (status = 'NEW')::INT AS created,
    count(*) FILTER (status IN ('UPDATED', 'IMAGE_CHANGED'))::INT AS updated, count(*) FILTER (status = 'UNCHANGED')::INT AS unchanged FROM diff), m AS (SELECT count(*)::INT AS k FROM new)
  SELECT 1::BIGINT AS id, processed, created, updated, unchanged, 0 AS errors, 'SUCCESS' AS status FROM n UNION ALL SELECT 2, k, 0, k, 0, 3, 'ERROR' FROM m""")
def publish_runs(s: S, d: str) -> DataFrame:
    return jobs.published_runs(_published(s, d))


_REPLAY = "SELECT user_id AS code, event_type AS field_name, arg_max_null(value, event_id) AS new_value FROM events GROUP BY ALL"


@query(_REPLAY)
def replay_log(s: S, d: str) -> DataFrame:
    return replay.latest_values(event_log(s, d))


@query(_REPLAY)
def stream_replay(s: S, d: str) -> DataFrame:
    return jobs.replay_events(s, f"{d}/events.parquet")


@query(_UPSERT)
def stream_sync(s: S, d: str) -> DataFrame:
    return jobs.upsert_parts(s, d)


@query(f"WITH {NEW} SELECT count(*) AS rows, 0::BIGINT AS differing FROM new")
def replay_roundtrip(s: S, d: str) -> DataFrame:
    """What the log of (old to new) on top of (nothing to old) rebuilds is new, for all codes of new."""
    old, new = old_snapshot(s, d), new_snapshot(s, d)
    whole = df.change_log(old.limit(0), old, fields=LOG_FIELDS).withColumn("id", F.lit(1))
    log = whole.unionByName(df.change_log(old, new, fields=LOG_FIELDS).withColumn("id", F.lit(2)))
    made = replay.replay(log, 8 * table(s, d, "part").count()).select("code", "name", "category", F.round("price", 2).alias("price"), "stock", "image_url")
    wanted = new.withColumn("price", t.number_text(F.col("price")).cast("double"))
    found = df.snapshot_diff(made.join(wanted.select("code").hint("merge"), "code", "left_semi"), wanted)
    return found.agg(F.count("*").alias("rows"), F.count_if(F.col("status") != "UNCHANGED").alias("differing"))


@query("SELECT c_custkey AS code, trim(regexp_replace(replace(c_name, '#', ' '), '\\s+', ' ', 'g'), ' .:-|') AS name, upper(trim(c_mktsegment)) AS segment FROM customer")
def record_normalise(s: S, d: str) -> DataFrame:
    return table(s, d, "customer").select(
        F.col("c_custkey").alias("code"), t.collapse(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("name"), F.upper(t.trimmed(F.col("c_mktsegment"))).alias("segment")
    )


@query("""SELECT c_custkey AS code, concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'balance is negative' END,
  CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 1000 THEN 'balance is low' END) AS errors FROM customer
  WHERE c_acctbal < 0 OR (c_mktsegment = 'BUILDING' AND c_acctbal < 1000)""")
def validate_rows(s: S, d: str) -> DataFrame:
    rules = [(F.col("c_acctbal") >= 0, "balance is negative"), ((F.col("c_mktsegment") != "BUILDING") | (F.col("c_acctbal") >= 1000), "balance is low")]
    return audit.gate(table(s, d, "customer"), rules)[1].select(F.col("c_custkey").alias("code"), F.array_join("errors", "; ").alias("errors"))


@query("""SELECT p_partkey AS code, CASE WHEN coalesce(m, 0) > 0 THEN m ELSE p_retailprice END AS price FROM part
  LEFT JOIN (SELECT l_partkey, min(l_extendedprice) FILTER (l_quantity = 1) AS m FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def price_resolve(s: S, d: str) -> DataFrame:
    sample = table(s, d, "lineitem").where("l_quantity = 1").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_extendedprice").alias("price_sample"))
    rows = table(s, d, "part").join(sample, "p_partkey", "left").select(F.col("p_partkey").alias("code"), "price_sample", F.col("p_retailprice").alias("price"))
    return sync.to_catalog(rows).select("code", "price")


@query("SELECT p_partkey AS id, p_name AS name, p_brand AS category FROM part WHERE p_name ILIKE '%a%1%' OR p_brand ILIKE '%a%1%'")
def search_sql(s: S, d: str) -> DataFrame:
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"))
    return browse.search_like(rows, "a%1", ("name", "category"))


def _browsed(s: S, d: str, colors: bool = False) -> DataFrame:
    part = table(s, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return part.hint("merge").join(_merged(s, d, colors).withColumnRenamed("categories", "category"), "code")


_BROWSED = f"""WITH {OCC}, {_UNION}, f AS (SELECT code, arg_min(stock, pos) AS stock, arg_min(price, pos) AS price FROM occ GROUP BY code),
  b AS (SELECT p_partkey AS code, p_name AS name, p_type AS description, categories AS category, stock, price
    FROM part JOIN f ON f.code = p_partkey JOIN u ON u.code = p_partkey)"""
_KEPT = "len(list_intersect(string_split(category, ', '), ['FRANCE', 'PERU', 'JAPAN', 'NATION_3', 'NATION_7'])) > 0 AND stock > 25"


@query(f"""{_BROWSED}, k AS (SELECT code, string_agg(DISTINCT color, ', ') AS colors FROM occ GROUP BY code)
  SELECT code, name, category FROM b JOIN k USING (code) WHERE contains(lower(code::VARCHAR), 'n') OR contains(lower(name), 'n') OR contains(lower(description), 'n')
    OR contains(lower(category), 'n') OR contains(lower(colors), 'n')""")
def search_text(s: S, d: str) -> DataFrame:
    rows = _browsed(s, d, colors=True).withColumn("code", F.col("code").cast("string"))
    return browse.search_text(rows, "N").select(F.col("code").cast("long").alias("code"), "name", "category")


SELECTED = ["FRANCE", "PERU", "JAPAN", "NATION_3", "NATION_7"]


@query(f"{_BROWSED} SELECT code, name, category, stock, price FROM b WHERE {_KEPT} ORDER BY lower(name) DESC, stock, code")
def browse_filter(s: S, d: str) -> DataFrame:
    rows = _browsed(s, d)
    found = rows.where(browse.browse(rows, "", SELECTED, True) & (F.col("stock") > 25))
    return browse.sort_by(found.select("code", "name", "category", "stock", "price"), [("name", True), ("stock", False)], "code")


@query(f"{_BROWSED} SELECT count(*) FILTER ({_KEPT}) AS shown, count(*) AS total FROM b")
def browse_counter(s: S, d: str) -> DataFrame:
    rows = _browsed(s, d)
    return browse.counter(rows, browse.browse(rows, "", SELECTED, True) & (F.col("stock") > 25))


@query(f"WITH {OCC} SELECT category, count(*) AS n FROM occ GROUP BY category")
def facets(s: S, d: str) -> DataFrame:
    return browse.facets(occurrences(s, d).select("category"))


@query("SELECT o_orderkey AS id, o_orderdate AS finished_at, o_totalprice AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def top_runs(s: S, d: str) -> DataFrame:
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("finished_at"), F.col("o_totalprice").alias("total"))
    return browse.newest(rows, 100, "finished_at", "id")


@query("""SELECT o_orderkey AS id, l_linenumber AS line, l_partkey AS code, 'S/ ' || format('{:,.2f}', l_extendedprice) AS price,
  CASE WHEN o_orderstatus = 'F' THEN 'APLICADO' ELSE 'ERROR' END AS label, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS finished
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""")
def run_changes(s: S, d: str) -> DataFrame:
    runs = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderstatus")
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").join(runs, "l_orderkey")
    return rows.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("code"), t.money(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("o_orderstatus") == "F", "APLICADO").otherwise("ERROR").alias("label"), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("finished"),
    )


@query("""SELECT l_orderkey AS id, count(*) AS n, 'orphan' AS kind FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1
  UNION ALL SELECT l_orderkey, count(*), 'child' FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def orphan_children(s: S, d: str) -> DataFrame:
    lines, orders = table(s, d, "lineitem").select("l_orderkey"), table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    rows = lines.count()
    counted = spread(lines, rows, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    parents = spread(orders, rows, "o_orderkey").hint("merge")
    lost = audit.orphans(counted, parents.where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey").withColumn("kind", F.lit("orphan"))
    gone = audit.cascade(counted, parents.where("o_orderstatus = 'P'"), "l_orderkey", "o_orderkey").withColumn("kind", F.lit("child"))
    return lost.unionByName(gone).select(F.col("l_orderkey").alias("id"), "kind", "n")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_known(s: S, d: str) -> DataFrame:
    return sync.unknown_rows(table(s, d, "documents").select("doc_id", "source"), table(s, d, "labels"), "doc_id")


@query(f"""WITH {OLD}, {NEW} SELECT n.code, CASE WHEN o.image_url = n.image_url THEN 'files/' || o.code || '.jpg' ELSE '' END AS image_path,
  NOT coalesce(o.image_url = n.image_url, false) AS needs_image FROM new n LEFT JOIN old o ON o.code = n.code""")
def carry_forward(s: S, d: str) -> DataFrame:
    stored = old_snapshot(s, d).withColumn("image_path", F.concat(F.lit("files/"), F.col("code").cast("string"), F.lit(".jpg")))
    return sync.carry_images(stored, new_snapshot(s, d)).select("code", "image_path", "needs_image")


@query("""WITH k AS (SELECT CASE WHEN p_brand = 'Brand#1' THEN 'url:' || l_suppkey ELSE 'code:' || l_partkey END AS k FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
  SELECT count(k) AS lookups, count(DISTINCT k) AS fetched, count(k) - count(DISTINCT k) AS reused FROM k""")
def enrich_detail(s: S, d: str) -> DataFrame:
    parts = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = table(s, d, "lineitem").select("l_partkey", "l_suppkey").join(parts, "l_partkey", "left")
    code = F.when(F.col("p_brand").eqNullSafe("Brand#1"), "").otherwise(F.col("l_partkey").cast("string"))
    return audit.lookup_metrics(rows, audit.detail_key(code, F.col("l_suppkey").cast("string")))


@query("""WITH n AS (SELECT l_orderkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS names, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS numbers FROM lineitem GROUP BY 1)
  SELECT l_orderkey AS id, CASE WHEN len(names) = len(numbers) THEN array_to_string(list_transform(range(1, len(names) + 1), lambda i: names[i] || '=' || numbers[i]), ',') ELSE '' END AS zipped FROM n""")
def positional_zip(s: S, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("names"), F.array_sort(F.collect_set("l_linenumber")).alias("numbers"))
    return rows.select("id", t.map_text(co.zip_by_position(F.col("names"), F.col("numbers"))).alias("zipped"))


@query("SELECT p_partkey AS code, sha256(concat_ws('|', p_partkey::VARCHAR, coalesce(p_name, ''), coalesce(p_brand, ''), printf('%.2f', p_retailprice), p_size::VARCHAR)) AS hash FROM part")
def content_hash(s: S, d: str) -> DataFrame:
    columns = [F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), t.number_text(F.col("p_retailprice")), F.col("p_size").cast("string")]
    return table(s, d, "part").select(F.col("p_partkey").alias("code"), t.content_hash(columns).alias("hash"))


@query("""WITH g AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS files, count(*) AS hashes,
  count(*) FILTER (n > 1) AS groups, sum(n - 1)::BIGINT AS duplicates FROM g""")
def duplicate_audit(s: S, d: str) -> DataFrame:
    return audit.duplicate_audit(table(s, d, "documents"), F.col("text"), "doc_id")


@query("""SELECT doc_id, keep FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS keep FROM documents) WHERE doc_id <> keep""")
def duplicate_drop(s: S, d: str) -> DataFrame:
    return audit.duplicates_to_drop(table(s, d, "documents"), F.col("text"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(s: S, d: str) -> DataFrame:
    return audit.duplicate_keys(table(s, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS l_orderkey, count(DISTINCT l_partkey) AS l_partkey FROM lineitem")
def uniqueness(s: S, d: str) -> DataFrame:
    return audit.uniqueness(table(s, d, "lineitem"), "l_orderkey", "l_partkey")


_COVER = "SELECT n_name AS category, n_nationkey + 10 AS expected FROM nation"


@query(f"""WITH {OCC}, e AS ({_COVER}), h AS (SELECT category, count(*) AS have FROM occ GROUP BY 1)
  SELECT (SELECT count(*) FROM occ) AS found, (SELECT count(DISTINCT code) FROM occ) AS "unique",
  (SELECT count(*) FROM (SELECT code FROM occ GROUP BY 1 HAVING count(DISTINCT category) > 1)) AS multi,
  (SELECT sum(expected)::BIGINT FROM e) AS expected, (SELECT bool_and(coalesce(have, 0) >= expected) FROM e LEFT JOIN h USING (category)) AS complete""")
def coverage_report(s: S, d: str) -> DataFrame:
    expected = table(s, d, "nation").select(F.col("n_name").alias("category"), (F.col("n_nationkey") + 10).cast("long").alias("expected"))
    return audit.coverage(occurrences(s, d), expected)


@query("""SELECT doc_id, 'no label' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 'no text' FROM documents WHERE trim(coalesce(text, '')) = ''""")
def quality_lists(s: S, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    bare = audit.orphans(docs, table(s, d, "labels"), "doc_id", "doc_id").select("doc_id", F.lit("no label").alias("reason"))
    return bare.unionByName(audit.without_text(docs, "text").select("doc_id", F.lit("no text").alias("reason")))


@query("SELECT '' AS image, p_partkey AS code, p_name AS name, p_brand AS category, 'S/ ' || format('{:,.2f}', p_retailprice) AS price, p_size::VARCHAR AS stock FROM part")
def report_export(s: S, d: str) -> DataFrame:
    rows = table(s, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("stock"), F.lit(None).cast("string").alias("image_path"))
    return browse.printed_report(rows)


@query('SELECT p_partkey AS "Código", p_name AS "Nombre", p_brand AS "Categoría", p_type AS "Descripción", p_retailprice AS "Precio", p_size AS "Stock" FROM part')
def report_columns(s: S, d: str) -> DataFrame:
    part = table(s, d, "part")
    return browse.report(part.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_type").alias("description"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("stock")))


@query("""WITH o AS (SELECT p_partkey AS id, 'u' || (p_partkey % 97) || '-' || p_partkey AS url, p_partkey AS code, p_size AS stock FROM part WHERE p_partkey % 3 <> 0),
  i AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'moved-' || p_partkey ELSE 'u' || (p_partkey % 97) || '-' || p_partkey END AS url, p_partkey AS code, p_size + 1 AS stock FROM part WHERE p_partkey % 4 <> 1)
  SELECT o.id, i.url, i.code, i.stock FROM i LEFT JOIN o ON o.code = i.code UNION ALL SELECT * FROM o WHERE code NOT IN (SELECT code FROM i)""")
def upsert_landing(s: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    own = F.concat(F.lit("u"), (k % 97).cast("string"), F.lit("-"), k.cast("string"))
    part = table(s, d, "part")
    stored = part.where("p_partkey % 3 <> 0").select(k.alias("id"), own.alias("url"), k.alias("code"), F.col("p_size").alias("stock"))
    moved = F.when(k % 5 == 0, F.concat(F.lit("moved-"), k.cast("string"))).otherwise(own)
    incoming = part.where("p_partkey % 4 <> 1").select(moved.alias("url"), k.alias("code"), (F.col("p_size") + 1).alias("stock"))
    return sync.upsert_landing(stored, incoming)


@query("""SELECT count(*) AS processed, sum(c)::BIGINT AS created, sum(u)::BIGINT AS updated, sum(n)::BIGINT AS unchanged, 0::BIGINT AS errors, sum(sec)::BIGINT AS seconds FROM (
  SELECT (o_orderstatus = 'O')::INT AS c, (o_orderstatus = 'F')::INT AS u, (o_orderstatus NOT IN ('O', 'F'))::INT AS n, o_orderkey % 100 AS sec FROM orders)""")
def run_append(s: S, d: str) -> DataFrame:
    one = lambda c: c.cast("int")
    status = F.col("o_orderstatus")
    runs = table(s, d, "orders").select(
        F.lit(1).alias("processed"), one(status == "O").alias("created"), one(status == "F").alias("updated"), one(~status.isin("O", "F")).alias("unchanged"),
        F.lit(0).alias("errors"), F.col("o_orderdate").alias("started_at"), F.timestamp_seconds(F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 100).alias("finished_at"),
    )
    return sync.summary(runs)
