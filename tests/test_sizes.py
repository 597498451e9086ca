"""Tasks are as many as the rows ask for, and nothing passes through one task."""

from pyspark.sql import functions as F

from shelfspark.operators import consolidate as co
from shelfspark.operators import elements, replay
from shelfspark.plans import catalog, shop
from shelfspark.sources import tables
from shelfspark.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def test_tasks_of_orphans_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 1000)
    found = catalog.orphan_children(spark, SMALL)
    assert found.rdd.getNumPartitions() >= tables.table(spark, SMALL, "lineitem").count() // 1000


def test_arrivals_are_written_and_read_by_many_tasks(spark, monkeypatch):
    files = []
    monkeypatch.setattr(jobs, "arrivals", lambda s, d, early, own=jobs.arrivals: own(s, d, early).repartition(3))
    monkeypatch.setattr(jobs, "sync_stream", lambda rows, t, kind, checkpoint, own=jobs.sync_stream: (own(rows, t, kind, checkpoint), files.append(len(spark.read.parquet(checkpoint.replace("checkpoint", "arrivals")).inputFiles()))))
    runs = jobs.published_runs(jobs.sync_occurrences(spark, SMALL)[0]).orderBy("id").collect()
    assert files == [3, 6] and [r.id for r in runs] == [1, 2]


def test_occurrences_are_shuffled_once_and_hot_codes_apart(spark, monkeypatch):
    rows = catalog.colored(catalog.occurrences(spark, SMALL)).withColumn("code", F.col("code") % 7)
    monkeypatch.setattr(tables, "TASK_ROWS", 1000)
    whole = co.consolidate(rows)
    assert whole.rdd.getNumPartitions() == -(-rows.count() // 1000)
    monkeypatch.setattr(co, "HOT_ROWS", sorted(r["count"] for r in rows.groupBy("code").count().collect())[3])
    said = lambda df: sorted((r.code, r.category, r.stock, r.price, sorted(r.color_stock.items())) for r in df.collect())
    assert said(co.consolidate(rows)) == said(whole) and len(said(whole)) == 7


def test_pages_lie_by_page_in_as_many_tasks_as_they_need_and_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(elements, "TASK_CHARS", 5000)
    for found in (shop.page_details(spark, SMALL), shop.page_cards(spark, SMALL)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.rdd.getNumPartitions() > 4


def test_rows_of_pages_broadcast_no_markup(spark):
    plan = shop.page_rows(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Broadcast") <= 2  # the categories


def test_tasks_of_a_replay_follow_the_log(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    log = spark.range(100).select("id", (F.col("id") % 30).cast("string").alias("code"), F.lit("n").alias("product_name"), F.lit("stock").alias("field_name"), F.col("id").cast("string").alias("new_value"))
    made = replay.replay(log)
    assert made.rdd.getNumPartitions() == 10
    assert sorted((int(r.code), r.stock) for r in made.collect()) == [(k, k + (90 if k < 10 else 60)) for k in range(30)]
