"""Records, images, lists and views on small cases."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from shelfspark.operators import audit, browse, consolidate, diff, sync
from shelfspark.sources.tables import CHANGES, RUNS, image_paths, in_order, lookup_one
from tests.test_catalog import frame, occurrences, product

NOW = dt.datetime(2024, 1, 1)


def test_landing_record_has_defaults_time_and_hash(spark):
    kind = "code string, name string, stock int, price double, color_stock map<string,int>, scraped_at timestamp"
    rows = spark.createDataFrame([(" A ", None, None, 2.5, {" Rojo ": -3, "": 4}, None), ("B", "N", 3, None, None, dt.datetime(2020, 5, 5))], kind)
    a, b = sync.landing_record(rows, F.lit(NOW)).orderBy("code").collect()
    assert (a.source, a.url, a.name, a.stock, a.price, a.price_sample, a.color_stock, a.scraped_at) == ("importacionesfacundo", "", "", 0, 2.5, 0.0, {"Rojo": 0}, NOW)
    assert (b.name, b.stock, b.price, b.scraped_at.year) == ("N", 3, 0.0, 2020)
    assert a.content_hash == hashlib.sha256(b"A||||2.50|0.00|0.00|0.00|0|Rojo=0").hexdigest() != b.content_hash
    again = sync.landing_record(rows.withColumn("image_url", F.lit("x")), F.lit(NOW)).where("code = 'B'").first()
    assert again.content_hash == b.content_hash and again.image_url == "x"
    assert sync.landing_record(rows.select("code")).where("scraped_at IS NULL").isEmpty()


def test_gate_normalises_first(spark):
    rows = frame(spark, product(" P001 ", "  Producto prueba ", colors={" Rojo ": -5, " ": 3}), product("  ", "N"))
    rows = rows.withColumns({"price_hundred": F.lit(0.0), "price_thousand": F.lit(0.0)})
    good, bad = audit.gate(rows, audit.product_rules())
    row = good.first()
    assert good.count() == 1 and (row.code, row.name, row.color_stock) == ("P001", "Producto prueba", {"Rojo": 0})
    assert bad.first().errors == ["code is required"]


def test_image_index_without_reading_files(spark, tmp_path):
    for name in ("b/FB_1.png", "a/FB_1.JPG", "a/FB_2.txt", "a/sub/FB_3.webp", "a/.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    paths = image_paths(spark, f"{tmp_path}")
    assert "content" not in paths.columns
    found = audit.with_images(frame(spark, product("FB/1"), product("FB_2"), product("FB_3")), audit.image_index(paths))
    got = {r.code: r.image_path and r.image_path.split(tmp_path.name)[1] for r in found.collect()}
    assert got == {"FB/1": "/a/FB_1.JPG", "FB_2": None, "FB_3": "/a/sub/FB_3.webp"}


def test_lists_views_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1), ("a", 0), ("c", 2)], "category string, pos int")
    assert [r.category for r in browse.first_rows(rows, 2).collect()] == ["a", "b"]
    assert [r.category for r in in_order(rows, "pos").collect()] == ["a", "b", "c"] and lookup_one(rows, "b", "category").first().pos == 1
    both = browse.bag_union(rows, rows.limit(0), rows).orderBy("list_no", "pos").collect()
    assert [(r.list_no, r.category) for r in both] == [(0, "a"), (0, "b"), (0, "c"), (2, "a"), (2, "b"), (2, "c")]
    selected = spark.createDataFrame([("a",), ("gone",)], "category string")
    assert [r.category for r in browse.still_there(selected, browse.facets(rows)).collect()] == ["a"]
    assert browse.allowed(rows, "category", []).count() == 3 and browse.allowed(rows, "category", ["c"]).count() == 1
    log = spark.createDataFrame([(2, 7, "UPDATED", "b", "B", "stock", "Stock", "1", ""), (1, 7, "UPDATED", "B", "B", "name", "Nombre", None, "x"), (3, 8, "NEW", "c", "C", "code", "Código", None, "c")], CHANGES)
    assert [r.id for r in browse.changes_of_run(log, 7).collect()] == [1, 2]
    assert [(r.label, r.field_label, r.old_value, r.new_value) for r in browse.change_view(browse.changes_of_run(log, 7)).collect()] == [("ACTUALIZADO", "Nombre", "—", "x"), ("ACTUALIZADO", "Stock", "1", "—")]
    runs = spark.createDataFrame([(k, NOW, NOW, 0, 0, 0, 0, 0, s, "") for k, s in ((1, "SUCCESS"), (2, "ERROR"))], RUNS)
    assert [(r.id, r.label) for r in browse.history_view(runs).collect()] == [(2, "ERROR"), (1, "APLICADO")]
    browse.write_report(frame(spark, product("A", "Ñandú")), f"{tmp_path}/report")
    assert spark.read.csv(f"{tmp_path}/report", header=True).first()["Nombre"] == "Ñandú"
    images = spark.createDataFrame([("x", None), (" ", "HTTP 404")], "image_path string, image_error string")
    assert tuple(audit.image_counts(images).first()) == (1, 1)
    priced = spark.createDataFrame([("A", 0.0, None), ("B", 0.0, 1.0)], "code string, price double, price_sample double")
    assert [r.code for r in audit.without_price(priced, "price", "price_sample").collect()] == ["A"]


def test_flags_and_blank_keys(spark):
    old = frame(spark, product("A", stock=1), product("B", path="x.jpg"), product("C"), product(" "))
    new = frame(spark, product("A", stock=2), product("B", path="y.jpg"), product("C"), product(None))
    found = diff.snapshot_diff(old, new)
    assert {r.code for r in found.collect()} == {"A", "B", "C"}
    assert {r.code: (r.content_changed, r.image_changed, r.any_changed) for r in diff.diff_flags(found).collect()} == {"A": (True, False, True), "B": (False, True, True), "C": (False, False, False)}


def test_consolidation_of_one_hot_code_and_odd_rows(spark):
    """Many occurrences of a code come down to its items; nulls, blanks, negative stocks and ties have their place."""
    hot = [product("H", category=f"c{k % 3}, C{k % 3} , d", colors={"r": k, "n": -1}, description="" if k < 40 else f"d{k}") for k in range(60)]
    rows = occurrences(spark, *hot, product("O", category=None, description=None)).withColumn("colors", F.when(F.col("code") == "H", F.array(F.lit(" x "), F.lit("X"), F.lit("x"), F.lit(""))))
    got = {r.code: r for r in consolidate.consolidate(rows).collect()}
    h, o = got["H"], got["O"]
    assert (h.category, h.color_stock, h.description, h.pos, h.colors) == ("c0, d, c1, c2", {"n": 0, "r": 59}, "d40", 0, ["x", "X"])
    assert (o.category, o.color_stock, o.description, o.colors) == ("", {}, "", [])
    assert consolidate.consolidate(rows.limit(0)).count() == 0
    bare = consolidate.consolidate(rows.select("code", "pos", "stock"))
    assert bare.columns == ["code", "stock", "pos"] and bare.count() == 2


def test_sync_reads_occurrences_once(spark, tmp_path):
    rows = occurrences(spark, product("A"), product("B"))
    rows.write.parquet(f"{tmp_path}/occ")
    catalog, log, counts = sync.sync(frame(spark, product("A")), spark.read.parquet(f"{tmp_path}/occ"))
    for view in (catalog, log, counts):
        plan = view._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1
    assert catalog.count() == 2 and counts.first().created == 1
