"""Incremental jobs on Structured Streaming: file source, foreachBatch, available-now trigger, checkpoints.

A batch and the fact that it was taken in become visible in one commit, so a batch that is run again after a crash between
the commit and the checkpoint is skipped: every batch counts exactly once.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators import diff, sync
from shelfspark.plans.inputs import arrivals, new_snapshot, old_snapshot
from shelfspark.sources.commits import Publication
from shelfspark.sources.tables import RUNS, shared_folder
from shelfspark.sources.tables import schema as table_schema


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the place that all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of files, or one file, as a stream."""
    folder, _, name = path.rpartition("/")
    if name.endswith(".parquet") and not _is_folder(spark, path):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def run(stream: DataFrame, step, checkpoint: str) -> None:
    """Everything that is there, batch by batch; a restart goes on behind the last finished batch."""
    job = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def open_state(tables: Publication, stream: str, number: int) -> dict | None:
    """The state to build on, or none if the batch has been taken in before."""
    state = tables.state()
    return state if state["batches"].get(stream, -1) < number else None


def keep_latest(tables: Publication, name: str, keys: list[str], order: str, stream: str):
    """A step that keeps, of each key, the row with the highest order (of equal ones the greatest row). Only the buckets
    that a batch touches are read and written."""

    def step(batch: DataFrame, number: int) -> None:
        if (state := open_state(tables, stream, number)) is None:
            return
        touched = tables.touched(batch, *keys)
        rest = [c for c in batch.columns if c not in keys]
        rows = tables.read(name, batch.schema, state, touched).unionByName(batch)
        best = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r"))
        parts = tables.stage(name, best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]), *keys)
        tables.commit(state, buckets={name: (touched, parts)}, batch=(stream, number))

    return step


def replay_stream(log: DataFrame, tables: Publication, checkpoint: str) -> None:
    """Latest value of each (code, field) from a stream of log rows (id, code, field_name, new_value)."""
    run(log, keep_latest(tables, "latest", ["code", "field_name"], "id", "replay"), checkpoint)


def upsert_stream(rows: DataFrame, tables: Publication, checkpoint: str, pos: str = "pos") -> None:
    """Upserts arriving records into the table ``records`` by code: the last of a code counts, by ``pos``."""
    run(rows, keep_latest(tables, "records", ["code"], pos, "records"), checkpoint)


def sync_step(tables: Publication, catalog: T.StructType, stream: str = "sync", now=None):
    """A step that syncs a batch of occurrences as ``sync.sync`` does and publishes catalog, changes and run in one commit.

    now: a function to the time of a run, to be fixed in tests.  The run's id is the batch's number, from 1.
    """
    clock = now or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))

    def step(batch: DataFrame, number: int) -> None:
        if (state := open_state(tables, stream, number)) is None:
            return
        started, touched = clock(), tables.touched(batch, "code")
        frame = sync.classify(tables.read("catalog", catalog, state, touched), batch).persist()
        try:
            counts = diff.status_counts(frame.where(F.col("status").isNotNull()))
            finished = sync.run_row(counts, number + 1, started, clock(), 0)
            sync.publish(tables, sync.next_catalog(frame), sync.change_rows(frame), finished, state, touched, (stream, number))
        finally:
            frame.unpersist()

    return step


def sync_stream(occurrences: DataFrame, tables: Publication, catalog: T.StructType, checkpoint: str, now=None) -> None:
    """The whole sync for each batch of arriving occurrences."""
    run(occurrences, sync_step(tables, catalog, now=now), checkpoint)


def replay_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a log stream, replayed."""
    schema = spark.read.parquet(path).schema
    log = _read(spark, path, schema).select(F.col("event_id").alias("id"), F.col("user_id").alias("code"), F.col("event_type").alias("field_name"), F.col("value").alias("new_value"))
    folder = scratch(spark)
    tables = Publication(spark, f"{folder}/tables")
    replay_stream(log, tables, f"{folder}/checkpoint")
    return tables.read("latest", table_schema("code long, field_name string, id long, new_value double")).select("code", "field_name", "new_value")


def upsert_parts(spark: SparkSession, d: str) -> DataFrame:
    """The old snapshot stored, the new one arriving as a stream of part rows."""
    folder = scratch(spark)
    tables = Publication(spark, f"{folder}/tables")
    old, new = (f(spark, d).withColumn("pos", F.lit(k).cast("long")) for k, f in enumerate((old_snapshot, new_snapshot)))
    tables.commit(tables.state(), replace={"records": tables.stage("records", old, "code")})
    new.write.parquet(f"{folder}/arrivals")
    upsert_stream(spark.readStream.schema(new.schema).parquet(f"{folder}/arrivals"), tables, f"{folder}/checkpoint")
    return tables.read("records", old.schema).drop("pos")


def sync_occurrences(spark: SparkSession, d: str) -> tuple[Publication, T.StructType]:
    """The old snapshot's categories and stocks as the catalog, and lineitem's occurrences arriving in two batches."""
    folder = scratch(spark)
    tables = Publication(spark, f"{folder}/tables")
    old = old_snapshot(spark, d).select("code", "category", "stock")
    tables.commit(tables.state(), replace={"catalog": tables.stage("catalog", old, "code")})
    for early in (True, False):
        rows = arrivals(spark, d, early)
        rows.write.mode("append").parquet(f"{folder}/arrivals")
        sync_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/arrivals"), tables, old.schema, f"{folder}/checkpoint")
    return tables, old.schema


def published_runs(tables: Publication) -> DataFrame:
    return tables.read("runs", RUNS).select("id", "processed", "created", "updated", "unchanged", "errors", "status")
