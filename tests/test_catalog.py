"""The toolkit's operators on small golden cases."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text as t
from shelfspark.operators import audit, browse, consolidate, diff, replay, sync
from shelfspark.sources.tables import CATALOG, METADATA, conform, html_files, image_files, is_ready

PRODUCT = "code string, name string, category string, description string, price double, price_sample double, stock int, color_stock map<string,int>, image_url string, image_path string"


def product(code="P001", name="N", category="", description="", price=0.0, sample=0.0, stock=0, colors=None, image="", path=""):
    return (code, name, category, description, price, sample, stock, colors or {}, image, path)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PRODUCT)


def occurrences(spark, *rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], PRODUCT + ", pos int")


def status(spark, old, new):
    return {r.code: (r.status, r.changed) for r in diff.snapshot_diff(old, new).collect()}


def test_diff(spark):
    old = frame(spark, product("A", price=20.0, stock=5), product("B", colors={"r": 1, "b": 2}), product("C", image="x"), product("D"))
    new = frame(spark, product("A", price=25.0, stock=10), product("B", colors={"b": 2, "r": 1}), product("C", image="y"), product("E"))
    assert status(spark, old, new) == {"A": ("UPDATED", "price,stock"), "B": ("UNCHANGED", ""), "C": ("IMAGE_CHANGED", "image_url"), "D": ("REMOVED", ""), "E": ("NEW", "")}
    counts = diff.status_counts(diff.snapshot_diff(old, new)).first()
    assert counts.consistent and counts.processed == 4 and counts.removed == 1
    assert diff.status_counts(diff.snapshot_diff(old.limit(0), new.limit(0))).first().processed == 0


def test_consolidate(spark):
    rows = occurrences(
        spark, product("P002", category="Jarros Mug", colors={"Rojo": 5}), product("P002", category="Promocionales", description="d", colors={"Azul": 7, "Rojo": 2}),
        product(" ", category="x"), product("P004", category="Jarros"), product("P004", category="jarros, B"),
    )
    got = {r.code: r for r in consolidate.consolidate(rows).collect()}
    assert set(got) == {"P002", "P004"}
    assert got["P002"].category == "Jarros Mug, Promocionales" and got["P002"].color_stock == {"Rojo": 5, "Azul": 7} and got["P002"].description == "d"
    assert got["P004"].category == "Jarros, B"
    again = consolidate.consolidate(consolidate.consolidate(rows))
    assert {r.code: r.category for r in again.collect()} == {c: r.category for c, r in got.items()}


def test_sync_twice(spark):
    catalog = frame(spark)
    catalog, log, counts = sync.sync(catalog, occurrences(spark, product("P003", category="Jarros", price=10.0)))
    assert counts.first().created == 1 and {r.change_type for r in log.collect()} == {"NEW"}
    catalog, log, counts = sync.sync(catalog, occurrences(spark, product("P003", category="Artículos", price=20.0, sample=30.0)))
    assert counts.first().updated == 1
    row = catalog.first()
    assert row.category == "Jarros, Artículos" and row.price == 30.0
    assert {(r.field_name, r.old_value, r.new_value) for r in log.collect()} >= {("price", "10.00", "30.00")}
    _, log, counts = sync.sync(catalog, occurrences(spark, product("P003", category="jarros", price=30.0, sample=30.0)))
    assert counts.first().unchanged == 1 and log.isEmpty()


def test_snapshot_sync_and_removals(spark):
    old, new = frame(spark, product("A", stock=10), product("B")), frame(spark, product("A", stock=20))
    kept, found = sync.snapshot_sync(old, new)
    assert {r.code: r.stock for r in kept.collect()} == {"A": 20, "B": 0} and found.count() == 2
    gone, _ = sync.snapshot_sync(old, new, apply_removals=True)
    assert [r.code for r in gone.collect()] == ["A"]


def test_replay(spark):
    log = "id long, code string, product_name string, field_name string, new_value string"
    rows = [
        (1, "BOOT001", "Taza", "category", "General"), (2, "BOOT001", "Taza", "stock", "5"), (3, "BOOT001", "Taza", "stock", "12"), (4, "BOOT001", "Taza", "price_sample", "4.50"),
        (5, "BOOT001", "Taza", "color_stock", '{"Rojo": 12, "function(){}": 370}'), (6, "BOOT001", "", "description", None), (7, "NAMELESS", None, "stock", "1"),
        (8, "R", "Old", "stock", "x"), (9, "R", "Old", "name", "Newer"),
    ]
    got = {r.code: r for r in replay.replay(spark.createDataFrame(rows, log)).collect()}
    assert set(got) == {"BOOT001", "R"} and got["R"].name == "Newer" and got["R"].stock == 0
    row = got["BOOT001"]
    assert (row.name, row.category, row.stock, row.price_sample, row.color_stock, row.description) == ("Taza", "General", 12, 4.5, {"Rojo": 12}, "")
    full = frame(spark, product())
    assert replay.bootstrap(full, spark.createDataFrame(rows, log)).count() == 1
    assert replay.bootstrap(full.limit(0), spark.createDataFrame(rows, log)).count() == 2


def test_validation_and_gate(spark):
    rules = audit.product_rules()
    rows = spark.createDataFrame([("", " ", -10.0, -5), ("P", "N", 1.0, 0)], "code string, name string, price double, stock int")
    rows = rows.withColumns({c: F.lit(0.0) for c in ("price_sample", "price_hundred", "price_thousand")})
    good, bad = audit.gate(rows, rules)
    assert good.count() == 1 and bad.first().errors == ["code is required", "name is required", "price is negative", "stock is negative"]


def test_insert_delete_landing(spark):
    stored = frame(spark, product("A"), product("B"))
    with pytest.raises(ValueError):
        sync.insert(stored, frame(spark, product("A")))
    assert sync.insert(stored, frame(spark, product("C"))).count() == 3
    assert [r.code for r in sync.delete(stored, frame(spark, product("A"))).collect()] == ["B"]
    landed = "id long, url string, code string, stock int"
    old = spark.createDataFrame([(1, "u1", "A", 1), (2, "u2", "B", 2)], landed)
    new = spark.createDataFrame([("u1", "A", 5), ("moved", "B", 6), ("u9", "Z", 7)], "url string, code string, stock int")
    got = {(r.id, r.url, r.code, r.stock) for r in sync.upsert_landing(old, new).collect()}
    assert got == {(1, "u1", "A", 5), (2, "moved", "B", 6), (None, "u9", "Z", 7)}


def test_images(spark):
    stored = frame(spark, product("A", image="x", path="a.jpg"), product("B", image="x", path="b.jpg"))
    got = {r.code: (r.image_path, r.needs_image) for r in sync.carry_images(stored, frame(spark, product("A", image="x"), product("B", image="y"), product("C"))).collect()}
    assert got == {"A": ("a.jpg", False), "B": ("", True), "C": ("", False)}


def test_sync_keeps_images(spark):
    stored = frame(spark, product("A", image="x", path="a.jpg"), product("B", image="x", path="b.jpg"))
    rows = occurrences(spark, product("A", image="x"), product("B", image="y"), product("C", image="z", path="c.jpg"))
    catalog, log, counts = sync.sync(stored, rows)
    assert {r.code: r.image_path for r in catalog.collect()} == {"A": "a.jpg", "B": "", "C": "c.jpg"}
    assert counts.first().image_changed == 1 and {r.code for r in log.where("field_name = 'image_path'").collect()} == {"B", "C"}


def test_browse(spark):
    rows = frame(spark, product("REP001", "Otro", "A, B", stock=1), product("REP002", "Producto Busqueda", "B", colors={"Rojo": 1}), product("REP003", "50%", "C", stock=2))
    named = lambda d: [r.code for r in d.collect()]
    assert named(browse.search_like(rows, "BUSQUEDA", newest="code")) == ["REP002"]
    assert named(browse.search_text(rows, "rojo")) == ["REP002"] and named(browse.search_text(rows, "%")) == ["REP003"]
    assert named(rows.where(browse.browse(rows, "", ["A", "C"], True))) == ["REP001", "REP003"]
    assert browse.counter(rows, browse.browse(rows, "rep00", [], False)).first().shown == 3
    assert [(r.category, r.n) for r in browse.facets(rows).collect()] == [("A", 1), ("B", 2), ("C", 1)]
    assert named(browse.sort_by(rows, [("category", True), ("code", False)], "code"))[0] == "REP003"
    assert browse.report(rows).columns == ["Código", "Nombre", "Categoría", "Descripción", "Precio", "Stock"]
    assert browse.printed_report(frame(spark, product(price=1234.5, path="a\\b.jpg"))).first()[:5] == ("a/b.jpg", "P001", "N", "", "S/ 1,234.50")


def test_text_search_finds_colors(spark, tmp_path):
    import duckdb

    from shelfspark.plans import catalog

    tables = {
        "nation": ([(0, "PERU"), (1, "ITALIA")], "n_nationkey long, n_name string"),
        "supplier": ([(0, 0), (1, 1)], "s_suppkey long, s_nationkey long"),
        "part": ([(1, "cold bolt", "PROMO"), (2, "cold bolt", "PROMO"), (3, "ring", "PROMO"), (4, "bolt", "STANDARD")], "p_partkey long, p_name string, p_type string"),
        "lineitem": (
            [(1, 1, 1, 0, "R"), (1, 2, 1, 1, "N"), (1, 3, 2, 0, "R"), (2, 1, 2, 0, "A"), (2, 2, 3, 0, "A"), (2, 3, 4, 1, "A")],
            "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string",
        ),
    }
    con = duckdb.connect()
    for name, (rows, kind) in tables.items():
        frame = spark.createDataFrame(rows, kind)
        if name == "lineitem":
            frame = frame.selectExpr("*", "date'2024-01-01' AS l_shipdate", "1.0D AS l_quantity", "2.0D AS l_extendedprice")
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = sorted(tuple(r) for r in catalog.search_text(spark, str(tmp_path)).collect())
    assert found == [(1, "cold bolt", "PERU, ITALIA"), (3, "ring", "PERU"), (4, "bolt", "ITALIA")]
    assert found == sorted(con.execute(catalog.SQL["search_text"]).fetchall())


def test_audit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.jpg", b"\xff\xd8same"), ("b.JPG", b"\xff\xd8same"), ("c.png", b"\x89PNGother"), ("d.txt", b"x")):
        (tmp_path / "in" / name).write_bytes(data)
    files = image_files(spark, f"{tmp_path}/in")
    assert tuple(audit.duplicate_audit(files, F.col("content")).first()) == (3, 2, 1, 1)
    dropped = audit.duplicates_to_drop(files, F.col("content")).collect()
    assert len(dropped) == 1 and dropped[0].path.endswith("b.JPG")
    assert files.where(t.is_image_content(F.col("content"))).count() == 3
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "a.html").write_text("<h1>x</h1>")
    assert html_files(spark, f"{tmp_path}/html").first().html == "<h1>x</h1>"
    found = spark.createDataFrame([("P001", "A"), ("P001", "B")], "code string, category string")
    expected = spark.createDataFrame([("A", 1), ("B", 1)], "category string, expected long")
    assert tuple(audit.coverage(found, expected).first()) == (2, 1, 1, 2, True)
    cards = spark.createDataFrame([("X", "u1", 0), ("x", "u2", 1), ("", "u3", 2)], "code string, url string, pos int")
    key = audit.detail_key(F.col("code"), F.col("url"))
    assert tuple(audit.lookup_metrics(cards, key).first()) == (3, 2, 1)
    assert {r.url: r.detail.url for r in audit.enrich_once(cards, cards, key).collect()} == {"u1": "u1", "u2": "u1", "u3": "u3"}


def test_schema_and_flags(spark):
    got = conform(frame(spark, product()), CATALOG, {"price_hundred": 0.0})
    assert got.schema.fieldNames() == CATALOG.fieldNames() and got.first().price_hundred == 0.0
    empty = spark.createDataFrame([], METADATA)
    assert not is_ready(empty, got.limit(0)) and is_ready(empty, got)
    assert is_ready(spark.createDataFrame([("initialized", "1")], METADATA), got.limit(0))
