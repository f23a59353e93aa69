"""Queries that once did less than their whole job, on small tables that go past the former cuts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lumafind.operators import ingest
from lumafind.plans import registry
from test_queries import rows


def agree(spark, name, sf):
    """Rows of a query, after comparing them with its twin's."""
    con = duckdb.connect()
    for f in sf.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(registry.SQL[name]).df()
    found = registry.QUERIES[name](spark, str(sf)).toPandas()[list(want.columns)]
    assert rows(found) == rows(want)
    return found


def test_all_unresolved_items_are_corrected(spark, tmp_path):
    duckdb.sql("SELECT range::BIGINT AS doc_id, 'text ' || range AS text, 'en' AS lang, 'src' || range % 20 AS source FROM range(3000)").write_parquet(str(tmp_path / "documents.parquet"))
    found = agree(spark, "C8_apply_evidence", tmp_path)
    due = {k for k in range(3000) if (k % 11 == 0 or k % 13 == 0) and k % 5 and k % 3}
    assert len(due) > ingest.EVIDENCE and set(found[found["location_id"].notna()]["id"]) == due


def test_corrections_in_order(spark):
    items = spark.range(250).select("id", F.lit("police").alias("item_source_code"), F.col("id").cast("string").alias("atc_id"), F.lit("1").alias("found_sequence"), F.lit("p").alias("place"), F.lit(None).cast("timestamp").alias("checked_at"), F.lit("ambiguous").alias("status"), F.lit(None).cast("long").alias("location_id"))
    evidence = items.select("id", *ingest.KEYS, "place", F.col("checked_at").alias("previous_checked_at"), F.col("id").alias("location_id"), F.expr("id div 100").alias("correction"))
    late = evidence.filter("id < 50").withColumn("location_id", F.lit(-1).cast("long")).withColumn("correction", F.lit(9).cast("long"))
    got = ingest.apply_evidence(items, evidence.union(late)).collect()
    assert len(got) == 250 and all(r.status == "matched" and r.location_id == r.id for r in got)
    none = ingest.apply_evidence(items, evidence.limit(0)).filter("status = 'matched'")
    assert none.isEmpty()
    for bad in (evidence.withColumn("correction", F.lit(1)), evidence.union(evidence)):
        with pytest.raises(ValueError):
            ingest.apply_evidence(items, bad)


def test_every_item_of_a_scope_is_ranked(spark, tmp_path):
    n = 300
    duckdb.sql(f"SELECT range::BIGINT AS doc_id, CASE WHEN range % 10 = 0 THEN 'hot zzz' ELSE 'zzz' END AS text, 'en' AS lang, 'src3' AS source FROM range({n})").write_parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"SELECT range::BIGINT AS vec_id, [CAST(1 + sin(range * 64 + k) AS FLOAT) FOR k IN range(64)] AS embedding FROM range({n})").write_parquet(str(tmp_path / "embeddings.parquet"))
    duckdb.sql("SELECT k::BIGINT AS p_partkey, p_name FROM (VALUES (1, 'hot pot'), (5, 'pot')) t(k, p_name)").write_parquet(str(tmp_path / "part.parquet"))
    found = agree(spark, "F12_hybrid_rank", tmp_path)
    live = [k for k in range(n) if k % 11 and k % 13 and k % 17]
    assert sorted(found[found["query_id"] == 1]["id"]) == live
    #: A query without a vector keeps its lexical hits.
    assert sorted(found[found["query_id"] == 5]["id"]) == [k for k in live if k % 10 == 0]
