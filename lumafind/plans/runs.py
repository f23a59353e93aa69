"""Queries of run logs and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as J
from .adapt import ITEMS, frame, tables
from .registry import query

#: Events as runs: the user's parity is the source, the type its outcome.
RUNS = "SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'police' ELSE 'partner' END AS source, ts AS started_at, CASE event_type WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN CASE WHEN user_id = 3 THEN 'running' ELSE 'succeeded' END ELSE 'failed' END AS status, CASE WHEN event_id % 10 = 0 THEN '{\"business_date\": \"2024-01-15\"}' END AS metadata, CASE event_id % 3 WHEN 0 THEN 'morning' WHEN 1 THEN 'afternoon' ELSE 'manual' END AS run_slot FROM events"
LOCAL = "(started_at + INTERVAL 9 HOUR)"
DATED = f"r AS (SELECT *, coalesce(CAST(json_extract_string(metadata, '$.business_date') AS DATE), CAST({LOCAL} AS DATE)) AS business_date FROM ({RUNS}) x)"


def runs(spark, sf):
    return frame(spark, sf, RUNS).withColumn("started_at", F.col("started_at").cast("timestamp"))


@query("J1_latest_runs", f"WITH {DATED} SELECT source, business_date, id, status FROM r QUALIFY row_number() OVER (PARTITION BY source, business_date ORDER BY started_at DESC, id DESC) = 1")
def latest_runs(spark, sf):
    return J.latest_runs(runs(spark, sf)).select("source", "business_date", "id", "status")


#: The same runs after all of them ended, but for every 40th user's; purchases ran without cleanup.
ENDED = f"SELECT id, source, started_at, CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, CASE WHEN user_id % 40 <> 7 THEN started_at + INTERVAL '20' MINUTE END AS finished_at, CASE WHEN event_type = 'purchase' THEN '{{\"cleanup_enabled\": false}}' ELSE metadata END AS metadata FROM (SELECT x.*, user_id, event_type FROM ({RUNS}) x JOIN events ON event_id = id) y"


@query("J2_cycle_ready", f"WITH r AS (SELECT *, coalesce(CAST(json_extract_string(metadata, '$.business_date') AS DATE), CAST({LOCAL} AS DATE)) AS business_date, CASE coalesce(json_extract_string(metadata, '$.cleanup_enabled'), 'true') WHEN 'true' THEN 'morning' WHEN 'false' THEN 'afternoon' END AS cycle FROM ({ENDED}) x), l AS (SELECT * FROM r WHERE cycle IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, business_date, cycle ORDER BY started_at DESC, id DESC) = 1) SELECT business_date, cycle, count(*) FILTER (status IN ('succeeded', 'partial', 'failed') AND finished_at IS NOT NULL) = 2 AND NOT EXISTS (FROM r WHERE status = 'running') AS ready FROM l GROUP BY 1, 2")
def cycle_ready(spark, sf):
    return J.cycle_ready(frame(spark, sf, ENDED).withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")}))


@query("J3_cycle_counts", "SELECT max(doc_id) AS max_id, count(*) FILTER (doc_id % 13 = 0) AS empty_input, count(*) FILTER (doc_id % 5 = 2) AS first_seen, count(*) FILTER (doc_id % 13 <> 0 AND doc_id % 4 <> 0) AS remaining FROM documents")
def cycle_counts(spark, sf):
    (d,) = tables(spark, sf, "documents")
    items = d.select(F.col("doc_id").alias("id"), F.expr("if(doc_id % 13 = 0, ' ', 'x')").alias("input"), F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 5 as int))").alias("first_seen_at"))
    return J.cycle_counts(items, items.filter("id % 4 = 0").select("id", F.lit(True).alias("is_current")), "2024-01-03", "2024-01-04")


@query("J4_repair_runs", f"WITH {DATED}, e AS (SELECT s AS source, CAST(d AS DATE) AS business_date FROM (SELECT unnest(['police', 'partner', 'other']) AS s) a, (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12', INTERVAL 1 DAY)) AS d) b) SELECT id, source, business_date, 'stuck' AS reason, 'failed' AS status FROM r WHERE status = 'running' AND started_at < TIMESTAMP '2024-01-19 23:54:00' UNION ALL SELECT NULL, source, business_date, 'missing', 'failed' FROM e WHERE (source, business_date) NOT IN (SELECT source, business_date FROM r)")
def repair_runs(spark, sf):
    expected = spark.sql("SELECT source, day AS business_date FROM VALUES ('police'), ('partner'), ('other') AS s(source) CROSS JOIN (SELECT explode(sequence(DATE '2024-01-10', DATE '2024-01-12')) AS day)")
    return J.repair_runs(runs(spark, sf), expected, "2024-01-20 00:00:00")


@query("J5_runs_overview", f"WITH {DATED} SELECT id, business_date, row_number() OVER (PARTITION BY business_date ORDER BY started_at, id) AS number, CASE run_slot WHEN 'morning' THEN 6 WHEN 'afternoon' THEN 18 END AS scheduled_hour, hour({LOCAL}) AS local_hour FROM r")
def runs_overview(spark, sf):
    return J.runs_overview(runs(spark, sf)).select("id", "business_date", "number", "scheduled_hour", F.hour("started_local").alias("local_hour"))


@query("J6_finish_status", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'succeeded' WHEN event_type = 'error' THEN 'failed' WHEN user_id % 5 >= 3 THEN 'partial' ELSE 'pending' END AS status, CASE WHEN event_id % 3 <> 0 AND event_type <> 'error' AND user_id % 5 < 3 THEN ts + INTERVAL 15 MINUTE END AS retry_at FROM events")
def finish_status(spark, sf):
    (e,) = tables(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("remaining"), F.expr("if(event_type = 'error', 'x', null)").alias("error"), (F.col("user_id") % 5).alias("attempts"), F.lit(3).alias("most"), F.col("ts").cast("timestamp").alias("finished_at"))
    return J.finish_status(rows).select("id", "status", "retry_at")


#: Items with a document and a vector each, some of them out of step: where, the hash, the flag or a component.
KEPT = f"SELECT x.id, status, storage_location_id, CASE WHEN x.id % 10 = 1 THEN storage_location_id + 1 ELSE storage_location_id END AS location_id, CASE WHEN x.id % 14 = 3 THEN 'old' ELSE item_name END AS hash, x.id % 10 <> 0 AS has_doc, e.vec_id IS NOT NULL AND x.id % 9 <> 0 AS has_vec, CASE WHEN x.id % 15 = 2 THEN 'older' ELSE item_name END AS vec_hash, x.id % 8 <> 5 AS is_current, e.embedding, item_name AS source_hash FROM ({ITEMS}) x LEFT JOIN embeddings e ON e.vec_id = x.id"


@query("J7_audit_projection", f"""WITH k AS ({KEPT}), h AS (SELECT id, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) AS up, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)) DESC, id DESC) AS down FROM k WHERE has_doc)
 SELECT count(*) FILTER (has_doc) AS documents, count(*) FILTER (has_vec) AS vectors, count(*) FILTER (status = 'matched' AND NOT has_doc) AS missing_documents, count(*) FILTER (has_doc AND (location_id <> storage_location_id OR status <> 'matched')) AS scope_mismatch, count(*) FILTER (has_vec AND (NOT is_current OR vec_hash <> source_hash)) AS stale_vectors,
 count(*) FILTER (has_doc AND has_vec AND (hash <> vec_hash OR location_id <> storage_location_id)) AS hash_mismatch, (SELECT count(*) FROM h JOIN k USING (id) WHERE has_vec AND (up <= 100 OR down <= 100)) AS sampled, (SELECT count(*) FROM h JOIN k USING (id) WHERE has_vec AND (up <= 100 OR down <= 100) AND id % 6 = 1) AS vector_mismatch FROM k""")
def audit_projection(spark, sf):
    k = frame(spark, sf, KEPT)
    docs = k.filter("has_doc").select("id", "location_id", F.col("hash").alias("content_hash"))
    vecs = k.filter("has_vec").select("id", F.col("storage_location_id").alias("location_id"), F.col("vec_hash").alias("content_hash"), F.expr("if(id % 6 = 1, transform(embedding, (x, i) -> if(i = 40, x + 0.5, x)), embedding)").alias("v"))
    return J.audit_projection(k, docs, vecs, k.filter("embedding is not null").select("id", F.col("source_hash").alias("content_hash"), "is_current", F.col("embedding").alias("v")))


@query("J8_thumbnail_tasks", "SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'keep' ELSE 'add' END AS action, page_id % 2 = 1 OR page_id % 3 = 0 AS due FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT page_id + 1000000, 'delete', page_id % 3 = 0 FROM pages WHERE page_id % 2 = 0")
def thumbnail_tasks(spark, sf):
    return thumbnails(spark, sf).select("id", "action", "due")


@query("J8_next_tasks", "SELECT id, action FROM (SELECT page_id AS id, 'add' AS action, NULL::TIMESTAMP AS retry FROM pages WHERE page_id % 5 <> 0 AND page_id % 2 = 1 UNION ALL SELECT page_id + 1000000, 'delete', TIMESTAMP '2024-01-01' + page_id % 7 * INTERVAL 1 DAY FROM pages WHERE page_id % 2 = 0 AND page_id % 3 = 0) x ORDER BY retry NULLS FIRST, id LIMIT 150")
def next_tasks(spark, sf):
    return J.next_tasks(thumbnails(spark, sf), 150).select("id", "action")


def thumbnails(spark, sf):
    (p,) = tables(spark, sf, "pages")
    items = p.select(F.col("page_id").alias("id"), F.expr("if(page_id % 5 = 0, '', url)").alias("image_url"))
    key = F.concat(F.col("page_id").cast("string"), F.lit("/"), F.sha2("url", 256), F.lit(".jpg")).alias("object_key")
    retry = F.expr("if(page_id % 3 = 0, timestamp '2024-01-01' + make_dt_interval(cast(page_id % 7 as int)), timestamp '2026-01-01')").alias("retry_after")
    have = p.filter("page_id % 2 = 0 and page_id % 5 <> 0").select(F.col("page_id").alias("id"), key, retry)
    gone = p.filter("page_id % 2 = 0").select((F.col("page_id") + 1000000).alias("id"), key, retry)
    return J.thumbnail_tasks(items, have.union(gone), "2025-01-01")


SESSIONS = "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)"


@query("J9_sessionize", SESSIONS + " SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS requests, count(*) > 3 AS over FROM g GROUP BY user_id, k")
def sessionize(spark, sf):
    (e,) = tables(spark, sf, "events")
    return J.sessionize(e.withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes", 3)


