"""Commits of several tables, runs that are published whole, streams that take each batch in once, and recovery."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import replay, sync
from shelfspark.sources.commits import Conflict, Publication
from shelfspark.sources.tables import RUNS, schema, shared_folder
from shelfspark.streaming import jobs
from tests.test_catalog import PRODUCT, frame, occurrences, product

NOW = dt.datetime(2024, 1, 1)
CHANGES = schema("history_id long, change_type string, code string, product_name string, field_name string, old_value string, new_value string")


def tables(spark, tmp_path, buckets=4):
    return Publication(spark, f"file://{tmp_path}/tables", buckets)


def run_once(spark, t, number, *rows, errors=0):
    kind = frame(spark).schema
    catalog, log, counts = sync.sync(t.read("catalog", kind), occurrences(spark, *rows))
    return sync.publish(t, catalog, log, sync.run_row(counts, number, NOW, NOW, errors))


def seen(spark, t):
    rows = sorted((r.code, r.price) for r in t.read("catalog", frame(spark).schema).collect())
    runs = sorted((r.id, r.status) for r in t.read("runs", RUNS).collect())
    return rows, sorted({(r.history_id, r.code) for r in t.read("changes", CHANGES).collect()}), runs


def test_a_run_is_published_whole_or_not_at_all(spark, tmp_path):
    t = tables(spark, tmp_path)
    assert run_once(spark, t, 1, product("A", price=1.0))
    assert not run_once(spark, t, 2, product("B"), errors=3)
    assert seen(spark, t) == ([("A", 1.0)], [(1, "A")], [(1, "SUCCESS"), (2, "ERROR")])


@pytest.mark.parametrize("broken", ["runs", "changes", "catalog", "commit"])
def test_a_failure_after_any_write_leaves_the_old_state(spark, tmp_path, monkeypatch, broken):
    t = tables(spark, tmp_path)
    run_once(spark, t, 1, product("A", price=1.0))
    before, stage = seen(spark, t), t.stage

    def fails(name, df, *keys):
        parts = stage(name, df, *keys)
        if name == broken:
            raise OSError("the writer died")
        return parts

    monkeypatch.setattr(t, "stage", fails)
    if broken == "commit":
        monkeypatch.setattr(t, "_publish", lambda state: (_ for _ in ()).throw(OSError("the writer died")))
    with pytest.raises(OSError, match="died"):
        run_once(spark, t, 2, product("A", price=2.0), product("B"))
    monkeypatch.undo()
    assert seen(spark, t) == before
    run_once(spark, t, 2, product("A", price=2.0), product("B"))
    assert seen(spark, t)[0] == [("A", 2.0), ("B", 0.0)]
    assert t.clean(keep=1, older_than_hours=0) > 0 and seen(spark, t)[0] == [("A", 2.0), ("B", 0.0)]


def test_of_two_writers_one_wins(spark, tmp_path):
    t = tables(spark, tmp_path)
    run_once(spark, t, 1, product("A", price=1.0))
    state, kind = t.state(), frame(spark).schema
    for number, price in ((2, 2.0), (3, 3.0)):
        catalog, log, counts = sync.sync(t.read("catalog", kind, state), occurrences(spark, product("A", price=price)))
        run = sync.run_row(counts, number, NOW, NOW, 0)
        if number == 2:
            assert sync.publish(t, catalog, log, run, state)
        else:
            with pytest.raises(Conflict):
                sync.publish(t, catalog, log, run, state)
    assert seen(spark, t) == ([("A", 2.0)], [(1, "A"), (2, "A")], [(1, "SUCCESS"), (2, "SUCCESS")])


def test_a_batch_writes_its_buckets_only(spark, tmp_path):
    t = tables(spark, tmp_path, 8)
    log = schema("id long, code string, field_name string, new_value string")
    step = jobs.keep_latest(t, "latest", ["code", "field_name"], "id", "replay")
    rows = [(k, f"c{k % 20}", f"f{k % 2}", None if k == 39 else str(k)) for k in range(40)]
    step(spark.createDataFrame(rows, log), 0)
    before = {p["bucket"]: p["path"] for p in t.state()["tables"]["latest"]}
    more = [(40, "c3", "f1", "new"), (1, "c3", "f1", "late")]
    step(spark.createDataFrame(more, log), 1)
    after = {p["bucket"]: p["path"] for p in t.state()["tables"]["latest"]}
    assert len(before) > 4 and set(before) == set(after) and sum(before[b] != after[b] for b in before) == 1
    got = {(r.code, r.field_name, r.new_value) for r in t.read("latest", log).collect()}
    assert got == {tuple(r) for r in replay.latest_values(spark.createDataFrame(rows + more, log)).collect()}
    assert ("c3", "f1", "new") in got and ("c19", "f1", None) in got


def test_streamed_replay_equals_batch(spark, tmp_path):
    log = schema("id long, code string, field_name string, new_value string")
    rows = [(k, f"c{k % 3}", f"f{k % 2}", None if k == 11 else str(k)) for k in range(12)]
    source, t = f"{tmp_path}/log", tables(spark, tmp_path)
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, log).write.mode("append").parquet(source)
        jobs.replay_stream(spark.readStream.schema(log).parquet(source), t, f"{tmp_path}/ck")
    got = {(r.code, r.field_name, r.new_value) for r in t.read("latest", log).collect()}
    assert got == {tuple(r) for r in replay.latest_values(spark.createDataFrame(rows, log)).collect()} and ("c2", "f1", None) in got


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path, monkeypatch):
    """The job dies between the commit and the checkpoint, and is started again."""
    source, t, kind = f"{tmp_path}/in", tables(spark, tmp_path), frame(spark).schema
    occurrences(spark, product("A", category="x", price=1.0), product("A", category="y"), product(" ")).write.parquet(source)
    stream = lambda: spark.readStream.schema(occurrences(spark).schema).parquet(source)
    whole = jobs.sync_step

    def dies(*args, **kw):
        step = whole(*args, **kw)

        def then(batch, number):
            step(batch, number)
            raise OSError("the job died")

        return then

    monkeypatch.setattr(jobs, "sync_step", dies)
    with pytest.raises(Exception, match="died"):
        jobs.sync_stream(stream(), t, kind, f"{tmp_path}/ck", now=lambda: NOW)
    after_crash = t.state()
    assert after_crash["batches"] == {"sync": 0}
    monkeypatch.undo()
    jobs.sync_stream(stream(), t, kind, f"{tmp_path}/ck", now=lambda: NOW)
    assert t.state() == after_crash
    occurrences(spark, product("A", category="z", price=2.0), product("B")).write.mode("append").parquet(source)
    jobs.sync_stream(stream(), t, kind, f"{tmp_path}/ck", now=lambda: NOW)
    got = {r.code: (r.category, r.price) for r in t.read("catalog", kind).collect()}
    assert got == {"A": ("x, y, z", 2.0), "B": ("", 0.0)}
    runs = [(r.id, r.processed, r.created, r.updated) for r in t.read("runs", RUNS).orderBy("id").collect()]
    assert runs == [(1, 1, 1, 0), (2, 2, 1, 1)]


def test_upserted_records_keep_the_last(spark, tmp_path):
    kind, t = "code string, pos long, stock int", tables(spark, tmp_path)
    spark.createDataFrame([("A", 1, 1), ("A", 3, 3), ("A", 2, 2), ("B", 1, 9)], kind).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    jobs.upsert_stream(rows, t, f"{tmp_path}/ck")
    assert {(r.code, r.stock) for r in t.read("records", rows.schema).collect()} == {("A", 3), ("B", 9)}


def test_restore_marks_and_fills_together(spark, tmp_path):
    t, kind = tables(spark, tmp_path), schema("code string, name string, category string, stock int, price_sample double, color_stock map<string,int>")
    rows = [(1, "NEW", "BOOT001", "Taza", f, None, v) for f, v in (("category", "General"), ("stock", "5"), ("price_sample", "4.50"), ("color_stock", '{"Rojo": 12}'))]
    assert replay.restore(t, kind, CHANGES) == 0 and t.state()["number"] == 0
    t.commit(t.state(), append={"changes": t.stage("changes", spark.createDataFrame([*rows, (2, "UPDATED", "BOOT001", "Taza", "stock", "5", "12")], CHANGES))})
    assert replay.restore(t, kind, CHANGES) == 1
    row = t.read("catalog", kind).first()
    assert (row.name, row.category, row.stock, row.price_sample, row.color_stock) == ("Taza", "General", 12, 4.5, {"Rojo": 12})
    state = t.state()
    assert replay.restore(t, kind, CHANGES) == 0 and t.state() == state
    # marked, a catalog that was emptied since is not filled again
    t.commit(state, replace={"catalog": []})
    assert replay.restore(t, kind, CHANGES) == 0


def test_updated_at_of_what_changes(spark):
    kind = PRODUCT + ", updated_at timestamp"
    old = spark.createDataFrame([(*product(c, stock=1), dt.datetime(2020, 1, 1)) for c in "ABC"], kind)
    catalog, _, _ = sync.sync(old, occurrences(spark, product("A", stock=1), product("B", stock=2), product("D")), F.lit(NOW))
    assert {r.code: r.updated_at.year for r in catalog.collect()} == {"A": 2020, "B": 2024, "C": 2020, "D": 2024}
    merged = sync.upsert(old, frame(spark, product("A")), now=F.lit(NOW))
    assert {r.code: r.updated_at.year for r in merged.collect()} == {"A": 2024, "B": 2020, "C": 2020}


def test_no_shared_folder_is_an_error_on_a_cluster():
    unset = SimpleNamespace(get=lambda key, default=None: default)
    session = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, getConf=lambda: unset))
    assert shared_folder(session("local[4]")).startswith("file://") and shared_folder(session("local")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            shared_folder(session(master))
