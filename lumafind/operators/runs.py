"""Run logs, cycles and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import KST, has_photo
from .ingest import first_by


def business_date(started: str = "started_at", metadata: str = "metadata") -> F.Column:
    """The date in the metadata, else that of the start in Seoul."""
    return F.coalesce(F.get_json_object(metadata, "$.business_date").cast("date"), F.from_utc_timestamp(started, KST).cast("date"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each source and business date."""
    return first_by(runs.withColumn("business_date", business_date()), ["source", "business_date"], F.desc("started_at"), F.desc("id"))


def cycle_ready(runs: DataFrame, sources: int = 2) -> DataFrame:
    """Per business date and cycle: whether the latest run of each source in that cycle has ended, well or not, and no
    run of any date is running. Runs with cleanup (the metadata's cleanup_enabled, true if absent) make the morning,
    those without it the afternoon."""
    cleanup = F.coalesce(F.get_json_object("metadata", "$.cleanup_enabled"), F.lit("true"))
    cycle = F.when(cleanup == "true", "morning").when(cleanup == "false", "afternoon")
    rows = runs.withColumn("business_date", business_date()).withColumn("cycle", cycle).filter("cycle is not null")
    last = first_by(rows, ["source", "business_date", "cycle"], F.desc("started_at"), F.desc("id"))
    ended = F.col("status").isin("succeeded", "partial", "failed") & F.col("finished_at").isNotNull()
    busy = runs.agg(F.coalesce(F.bool_or(F.col("status") == "running"), F.lit(False)).alias("busy"))
    done = last.groupBy("business_date", "cycle").agg((F.count_if(ended) == sources).alias("all_done"))
    return done.join(F.broadcast(busy)).select("business_date", "cycle", (F.col("all_done") & ~F.col("busy")).alias("ready"))


def cycle_counts(items: DataFrame, vecs: DataFrame, start: str, end: str) -> DataFrame:
    """One row: largest id, empty inputs, items first seen in the day, items without a vector."""
    have = vecs.filter("is_current").select("id", F.lit(True).alias("__have"))
    day = (F.col("first_seen_at") >= F.lit(start).cast("timestamp")) & (F.col("first_seen_at") < F.lit(end).cast("timestamp"))
    empty = F.trim(F.coalesce("input", F.lit(""))) == ""
    return items.join(have, "id", "left").agg(F.max("id").alias("max_id"), F.count_if(empty).alias("empty_input"), F.count_if(day).alias("first_seen"), F.count_if(F.col("__have").isNull() & ~empty).alias("remaining"))


def repair_runs(runs: DataFrame, expected: DataFrame, now: str) -> DataFrame:
    """Runs that hang for over six minutes as failed, and a failed marker for each expected (source,
    business_date) without a run."""
    late = F.lit(now).cast("timestamp") - F.expr("interval 6 minutes")
    stuck = runs.filter((F.col("status") == "running") & (F.col("started_at") < late)).select("id", "source", business_date().alias("business_date"), F.lit("stuck").alias("reason"))
    seen = runs.select("source", business_date().alias("business_date"))
    missing = expected.join(seen, ["source", "business_date"], "left_anti").select(F.lit(None).cast("long").alias("id"), "source", "business_date", F.lit("missing").alias("reason"))
    return stuck.unionByName(missing).withColumn("status", F.lit("failed"))


def runs_overview(runs: DataFrame) -> DataFrame:
    """Each date's runs numbered by time and id, the hour by slot, local times. Numbers start anew each date."""
    rows = runs.withColumn("business_date", business_date())
    slot = F.when(F.col("run_slot") == "morning", 6).when(F.col("run_slot") == "afternoon", 18)
    return rows.select("id", "business_date", F.row_number().over(Window.partitionBy("business_date").orderBy("started_at", "id")).alias("number"), slot.alias("scheduled_hour"), F.from_utc_timestamp("started_at", KST).alias("started_local"))


def finish_status(runs: DataFrame) -> DataFrame:
    status = F.when(F.col("remaining") == 0, "succeeded").when(F.col("error").isNotNull(), "failed").when(F.col("attempts") >= F.col("most"), "partial").otherwise("pending")
    retry = F.when(F.col("status") == "pending", F.col("finished_at") + F.expr("interval 15 minutes"))
    return runs.withColumn("status", status).withColumn("retry_at", retry)


def audit_projection(items: DataFrame, docs: DataFrame, vecs: DataFrame, sources: DataFrame, sample: int = 100, tolerance: float = 0.0) -> DataFrame:
    """items(id, status, storage_location_id), docs(id, location_id, content_hash), vecs(id, location_id, content_hash, v: as
    kept for search), sources(id, content_hash, is_current, v: as embedded) -> one row of counts: documents, vectors,
    missing documents, documents out of scope, stale vectors, documents and vectors that differ in hash or scope, and, of
    the ``sample`` documents with the least and the largest hash of their id, how many have a vector and how many of
    these differ in any component by more than ``tolerance``. All but the sample are counts over all rows; the sample is
    the same on every run and at any partitioning."""
    one = lambda df, name: df.withColumn(name, F.lit(True))
    i = one(items.select("id", "status", "storage_location_id"), "has_item")
    d = one(docs.select("id", F.col("location_id").alias("doc_location"), F.col("content_hash").alias("doc_hash")), "has_doc")
    v = one(vecs.select("id", F.col("location_id").alias("vec_location"), F.col("content_hash").alias("vec_hash")), "has_vec")
    e = one(sources.select("id", "is_current", F.col("content_hash").alias("source_hash")), "has_source")
    rows = i.join(d, "id", "full_outer").join(v, "id", "full_outer").join(e, "id", "left")
    live = (F.col("status") == "matched") & F.col("storage_location_id").isNotNull()
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    counts = rows.agg(
        F.count("has_doc").alias("documents"), F.count("has_vec").alias("vectors"), F.count_if(live & F.col("has_doc").isNull()).alias("missing_documents"),
        F.count_if(F.col("has_doc") & F.col("has_item") & (differs("doc_location", "storage_location_id") | (F.col("status") != "matched"))).alias("scope_mismatch"),
        F.count_if(F.col("has_vec") & F.col("has_source") & (~F.col("is_current") | (F.col("vec_hash") != F.col("source_hash")))).alias("stale_vectors"),
        F.count_if(F.col("has_doc") & F.col("has_vec") & ((F.col("doc_hash") != F.col("vec_hash")) | differs("doc_location", "vec_location"))).alias("hash_mismatch"),
    )
    drawn = docs.select("id").distinct().withColumn("draw", F.md5(F.col("id").cast("string").cast("binary")))
    ends = drawn.orderBy("draw", "id").limit(sample).union(drawn.orderBy(F.desc("draw"), F.desc("id")).limit(sample)).select("id").distinct()
    pairs = ends.join(vecs.select("id", F.col("v").alias("a")), "id").join(sources.select("id", F.col("v").alias("b")), "id")
    apart = (F.size("a") != F.size("b")) | F.exists(F.zip_with("a", "b", lambda x, y: F.coalesce(F.abs(x.cast("double") - y.cast("double")) > tolerance, F.lit(True))), lambda x: x)
    sampled = pairs.agg(F.count("*").alias("sampled"), F.count_if(F.coalesce(apart, F.lit(True))).alias("vector_mismatch"))
    return counts.join(F.broadcast(sampled))


def thumbnail_tasks(items: DataFrame, tasks: DataFrame, now: str) -> DataFrame:
    """Tasks with an action: add for photos without one, delete for items that are gone, keep else; and when it is due."""
    want = items.filter(has_photo(F.col("image_url"))).select("id", F.concat(F.col("id").cast("string"), F.lit("/"), F.sha2("image_url", 256), F.lit(".jpg")).alias("object_key"))
    have = tasks.select("id", "object_key", "retry_after", F.lit(True).alias("__have"))
    alive = items.select("id", F.lit(True).alias("__alive"))
    joined = want.withColumn("__want", F.lit(True)).join(have, ["id", "object_key"], "full_outer").join(alive, "id", "left")
    action = F.when(F.col("__have").isNull(), "add").when(F.col("__alive").isNull(), "delete").otherwise("keep")
    due = F.coalesce(F.col("retry_after") <= F.lit(now).cast("timestamp"), F.lit(True))
    return joined.select("id", "object_key", action.alias("action"), due.alias("due"), "retry_after")


def next_tasks(tasks: DataFrame, limit: int) -> DataFrame:
    """Of thumbnail_tasks the next ones to work on: due additions and deletions, those without a time first, then by retry
    time, id and key; at most ``limit``."""
    return tasks.filter("due and action <> 'keep'").orderBy(F.asc_nulls_first("retry_after"), "id", "object_key").limit(limit)


def sessionize(events: DataFrame, gap: str = "30 minutes", most: int = 100) -> DataFrame:
    """Sessions of a user's events by idle gap, with their requests and whether they exceed the limit."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("requests"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", (F.col("requests") > most).alias("over"))
