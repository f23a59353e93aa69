"""Streams that keep a table: any order of batches, replays, removals; and merges that touch only their buckets."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumafind.operators import ingest
from lumafind.streaming import streams

COLUMNS = "item_source_code string, atc_id string, found_sequence string, page long, pos long, fetched_at timestamp, name string"


def run(spark, tmp_path, frames, writer):
    """Each frame is a batch of its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        for part in (tmp_path / f"in/{k}").glob("part-*"):
            os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = writer(source).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()


def fetched(day, page, name, atc="a"):
    return ("police", atc, "1", page, 1, f"2024-01-0{day} 00:00:00", name)


@pytest.mark.parametrize("order", [(0, 1, 2, 1), (2, 0, 1, 2)])
def test_ingest_in_any_order(spark, tmp_path, order):
    batches = [[fetched(1, 1, "old"), fetched(1, 2, "newer")], [fetched(2, 1, None), fetched(2, 1, "b", "b")], [fetched(3, 1, "last"), fetched(1, 9, "x", "c")]]
    frames = [spark.createDataFrame(batches[k], COLUMNS.replace("timestamp", "string")).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")) for k in order]
    run(spark, tmp_path, frames, lambda s: streams.stream_ingest(s, str(tmp_path / "table"), str(tmp_path / "out"), ["name"]))
    found = {r.atc_id: (r.name, r.first_seen_at.day, r.last_seen_at.day) for r in ingest.read_buckets(spark, str(tmp_path / "table")).collect()}
    assert found == {"a": ("last", 1, 3), "b": ("b", 2, 2), "c": ("x", 1, 1)}
    #: The last batch came before: it changes nothing.
    assert spark.read.parquet(str(tmp_path / "out")).filter("batch = 3").isEmpty()


def item(i, version, day, status, name):
    return (i, version, f"2024-01-0{day} 00:00:00", status, 7, name, None, None, "", None)


def test_documents_change_only_when_they_differ(spark, tmp_path):
    schema = "id long, version long, changed_at string, status string, storage_location_id long, item_name string, raw_category_name string, color_name string, description string, registered_on date"
    batches = [[item(1, 1, 1, "matched", "a"), item(2, 1, 1, "matched", "b"), item(3, 1, 1, "unmatched", "c")], [item(1, 2, 2, "matched", "A!"), item(2, 2, 2, "unmatched", "b")], [item(1, 1, 1, "matched", "a"), item(2, 3, 3, "matched", "b"), item(1, 3, 3, "matched", "A!")]]
    frames = [spark.createDataFrame(b, schema).withColumn("changed_at", F.col("changed_at").cast("timestamp")) for b in batches]
    codes = spark.createDataFrame([(1, [5])], "id long, code array<long>")
    run(spark, tmp_path, frames, lambda s: streams.stream_project(s, str(tmp_path / "table"), str(tmp_path / "out"), codes))
    found = {r.id: (r.search_text, r.code, r.visible_since.day) for r in ingest.read_buckets(spark, str(tmp_path / "table")).collect()}
    assert found == {1: ("a! ", [5], 1), 2: ("b ", None, 3)}
    told = sorted((r.batch, r.id, r.change) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert told == [(0, 1, "insert"), (0, 2, "insert"), (1, 1, "update"), (1, 2, "remove"), (2, 2, "insert")]


def test_merge_reads_and_replaces_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = [("police", str(k), "1", float(k)) for k in range(200)]
    time = F.lit("2020-01-01").cast("timestamp")
    table = spark.createDataFrame(rows, "item_source_code string, atc_id string, found_sequence string, price double").withColumn("first_seen_at", time).withColumn("last_seen_at", time)
    ingest.write_buckets(table, path, 16)
    before = {str(p) for p in Path(path).rglob("part-*")}
    incoming = spark.createDataFrame([("police", "5", "1", -1.0), ("police", "new", "1", 2.0)], "item_source_code string, atc_id string, found_sequence string, price double")
    n = ingest.merge_buckets(spark, path, incoming, "2021-01-01", 16)
    after = {str(p) for p in Path(path).rglob("part-*")}
    assert n <= 2 and len(before - after) <= 2 and len(before & after) >= 13
    plan = ingest.touched(spark, path, [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    got = {r.atc_id: (r.price, r.first_seen_at.year) for r in ingest.read_buckets(spark, path).collect()}
    assert len(got) == 201 and got["5"] == (-1.0, 2020) and got["new"] == (2.0, 2021) and got["7"] == (7.0, 2020)
    again = sorted(map(str, ingest.read_buckets(spark, path).collect()))
    ingest.merge_buckets(spark, path, incoming, "2021-01-01", 16)
    assert sorted(map(str, ingest.read_buckets(spark, path).collect())) == again
    assert ingest.merge_buckets(spark, path, incoming.limit(0), "2021-01-01", 16) == 0


def test_audit_and_evidence(spark):
    audit = ingest.Audit(["police", "partner"])
    rows = spark.createDataFrame([("police", "ambiguous"), ("police", "excluded_overseas"), ("partner", "matched"), ("other", "ambiguous")], "item_source_code string, status string")
    assert ingest.finalize_status(rows, audit).filter("status = 'ambiguous'").count() == 0
    assert {r.source: (r.unmatched, r.overseas, r.fetched) for r in audit.rows(spark).collect()} == {"police": (1, 1, 0), "partner": (0, 0, 0)}
    items = spark.createDataFrame([(k, "police", str(k), "1", "p", None, "ambiguous", None) for k in range(3)], "id long, item_source_code string, atc_id string, found_sequence string, place string, checked_at timestamp, status string, location_id long")
    evidence = items.select("id", *ingest.KEYS, "place", F.col("checked_at").alias("previous_checked_at"), F.lit(9).cast("long").alias("location_id"))
    moved = evidence.withColumn("atc_id", F.when(F.col("id") == 1, "else").otherwise(F.col("atc_id")))
    assert {r.id: (r.status, r.location_id) for r in ingest.apply_evidence(items, moved).collect()} == {0: ("matched", 9), 1: ("ambiguous", None), 2: ("matched", 9)}
    for bad in (evidence.limit(0), evidence.union(evidence), evidence.crossJoin(spark.range(60).select(F.col("id").alias("n"))).drop("n")):
        with pytest.raises(ValueError):
            ingest.apply_evidence(items, bad)
