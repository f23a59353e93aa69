"""Queries of matching and geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import places as P
from .adapt import INSTITUTIONS, ITEMS, PLACES, frame, tables
from .registry import query

#: Names to resolve: whole names, suffixes, shared suffixes, notes, unknown ones.
NAMES = "SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN concat('Supplier#', lpad(CAST(1 + doc_id % 120 AS STRING), 9, '0')) WHEN 1 THEN lpad(CAST(1 + doc_id % 120 AS STRING), 9, '0') WHEN 2 THEN concat('Supplier#', lpad(CAST(1 + doc_id % 120 AS STRING), 9, '0'), ' (desk)') WHEN 3 THEN '00' WHEN 4 THEN concat('alias ', CAST(doc_id % 50 AS STRING)) ELSE ' ' END AS raw_storage_name FROM documents"
ALIASES = "SELECT concat('alias', CAST(s_suppkey AS STRING)) AS normalized_alias, CAST(s_suppkey AS BIGINT) AS location_id, s_suppkey % 4 <> 0 AS verified, 'manual' AS match_method, CAST(NULL AS STRING) AS region FROM supplier"
KEY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"
STAGES = f"""WITH items AS ({NAMES}), loc AS ({INSTITUTIONS}), al AS ({ALIASES}), nm AS (SELECT DISTINCT raw_storage_name AS name, {KEY.format('raw_storage_name')} AS key, {KEY.format("regexp_replace(raw_storage_name, '\\([^)]*\\)', '', 'g')")} AS base FROM items WHERE trim(raw_storage_name) <> ''),
 k AS (SELECT id, {KEY.format('name')} AS key FROM loc WHERE is_active),
 a1 AS (SELECT nm.name, 1 AS stage, count(DISTINCT id) AS n, min(id) AS id FROM nm JOIN al ON normalized_alias = key JOIN loc ON loc.id = al.location_id AND is_active WHERE verified GROUP BY 1),
 a2 AS (SELECT name, 2 AS stage, count(DISTINCT id) AS n, min(id) AS id FROM nm JOIN k USING (key) GROUP BY 1),
 a3 AS (SELECT name, 3 AS stage, count(DISTINCT id) AS n, min(id) AS id FROM nm JOIN k ON k.key = nm.base GROUP BY 1),
 a4 AS (SELECT name, 4 AS stage, count(DISTINCT id) AS n, min(id) AS id FROM nm JOIN k ON suffix(k.key, nm.key) OR suffix(nm.key, k.key) GROUP BY 1)"""


def inputs(spark, sf):
    items, loc, al = (frame(spark, sf, s) for s in (NAMES, INSTITUTIONS, ALIASES))
    names = items.select(F.col("raw_storage_name").alias("name")).distinct().withColumn("key", P.match_key(F.col("name"))).filter("key <> ''")
    return items, loc, al, names


@query("D1_match_alias", STAGES + " SELECT * FROM a1")
def match_alias(spark, sf):
    _, loc, al, names = inputs(spark, sf)
    return P.match_alias(names, al, loc)


@query("D2_match_exact", STAGES + " SELECT * FROM a2")
def match_exact(spark, sf):
    _, loc, _, names = inputs(spark, sf)
    return P.match_exact(names, P.keyed(loc))


@query("D3_match_base", STAGES + " SELECT * FROM a3")
def match_base(spark, sf):
    _, loc, _, names = inputs(spark, sf)
    return P.match_base(names.select("name", P.base_name(F.col("name")).alias("key")), P.keyed(loc))


@query("D4_match_suffix", STAGES + " SELECT * FROM a4")
def match_suffix(spark, sf):
    _, loc, _, names = inputs(spark, sf)
    return P.match_suffix(names, P.keyed(loc))


@query("D5_resolve_locations", STAGES + ", u AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4), b AS (SELECT name, arg_min(n, stage) AS n, arg_min(id, stage) AS id FROM u GROUP BY 1) SELECT items.id, raw_storage_name, CASE WHEN n = 1 THEN b.id END AS location_id, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS match_status FROM items LEFT JOIN b ON b.name = raw_storage_name")
def resolve_locations(spark, sf):
    items, loc, al, _ = inputs(spark, sf)
    return P.resolve_locations(items, al, loc)


DETAIL = f"SELECT id, item_source_code, status, CAST(CASE WHEN status = 'matched' THEN storage_location_id END AS BIGINT) AS location_id, concat('Dep. ', color_name) AS detail_department, CAST(id % 5 AS STRING) AS detail_org, id % 9 = 0 AS newer FROM ({ITEMS}) x"
RULES = "SELECT 'police_api' AS item_source_code, 'depen' AS normalized_place, CAST(s_suppkey % 5 AS STRING) AS detail_org, CAST(s_suppkey AS BIGINT) AS location_id FROM supplier WHERE s_suppkey < 5 UNION ALL SELECT 'partner_api', 'depde', CAST(s_suppkey % 5 AS STRING), CAST(s_suppkey AS BIGINT) FROM supplier WHERE s_suppkey BETWEEN 10 AND 13"


@query("D6_match_detail", f"WITH i AS ({DETAIL}), r AS ({RULES}), l AS (SELECT id AS lid FROM ({INSTITUTIONS}) y WHERE is_active) SELECT i.id, CASE WHEN status = 'ambiguous' OR newer THEN l.lid ELSE i.location_id END AS location_id, CASE WHEN status = 'ambiguous' OR newer THEN CASE WHEN l.lid IS NULL THEN 'unmatched' ELSE 'matched' END ELSE status END AS status FROM i LEFT JOIN (r JOIN l ON lid = location_id) ON r.item_source_code = i.item_source_code AND normalized_place = regexp_replace(lower(CASE WHEN i.detail_department = 'Dep. ' THEN NULL ELSE i.detail_department END), '[^a-z]', '', 'g') AND r.detail_org = i.detail_org")
def match_detail(spark, sf):
    return P.match_detail(frame(spark, sf, DETAIL), frame(spark, sf, RULES), frame(spark, sf, INSTITUTIONS)).select("id", "location_id", "status")


@query("D7_apply_lookups", f"WITH i AS ({ITEMS}) SELECT id, CASE WHEN status = 'ambiguous' THEN CASE WHEN id % 2 = 0 THEN 5 END ELSE storage_location_id END AS location_id, CASE WHEN status = 'ambiguous' THEN CASE WHEN id % 2 = 0 THEN 'matched' ELSE 'unmatched' END ELSE status END AS status FROM i")
def apply_lookups(spark, sf):
    items = frame(spark, sf, ITEMS).withColumnRenamed("storage_location_id", "location_id")
    lookups = items.filter("id % 2 = 0").select("atc_id", "found_sequence", F.lit(5).cast("long").alias("location_id"))
    return P.apply_lookups(items, lookups, ["atc_id", "found_sequence"]).select("id", "location_id", "status")


@query("D8_lookup_stats", "WITH e AS (SELECT user_id, count(*) AS n, bool_or(event_type = 'purchase') AS ok, count(*) FILTER (event_type <> 'purchase') AS bad FROM events GROUP BY 1) SELECT (SELECT count(*) FROM customer) AS eligible, count(*) AS requested, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM e)) AS deferred, count(*) FILTER (n > 1) AS retried, CAST(sum(bad) AS BIGINT) AS failed_attempts FROM e")
def lookup_stats(spark, sf):
    """Every customer is eligible; events are the attempts of those who have any."""
    e, c = tables(spark, sf, "events", "customer")
    return P.lookup_stats(e.select("user_id", (F.col("event_type") == "purchase").alias("ok")), ["user_id"], c.select(F.col("c_custkey").alias("user_id")))


@query("D8_lookup_failures", "SELECT event_type AS reason, count(*) AS attempts FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def lookup_failures(spark, sf):
    (e,) = tables(spark, sf, "events")
    return P.lookup_failures(e.select((F.col("event_type") == "purchase").alias("ok"), F.col("event_type").alias("reason")))


#: Checked departments abroad, at home with a rule (the language, at the item's own institution) and without one.
CUSTODY = f"SELECT id, item_source_code, status, storage_location_id AS location_id, '주독일 대사관' AS raw_storage_name, CASE WHEN id % 4 <> 0 THEN DATE '2024-02-01' END AS detail_checked_at, CASE WHEN id % 3 = 0 THEN '주독일 대사관' WHEN id % 3 = 1 THEN color_name ELSE '' END AS detail_department, CAST(storage_location_id AS STRING) AS detail_org FROM ({ITEMS}) x"


@query("D9_apply_overseas", f"""WITH i AS ({CUSTODY}), r AS (SELECT DISTINCT item_source_code, color_name AS place, CAST(storage_location_id AS VARCHAR) AS org, storage_location_id AS rule FROM ({ITEMS}) y JOIN ({INSTITUTIONS}) l ON l.id = storage_location_id AND is_active WHERE color_name IS NOT NULL AND color_name <> 'es'),
 w AS (SELECT i.*, item_source_code = 'partner_api' AND CASE WHEN detail_checked_at IS NULL THEN true ELSE coalesce(nullif(trim(detail_department), ''), raw_storage_name) = '주독일 대사관' END AS away FROM i)
 SELECT id, CASE WHEN away THEN 'excluded_overseas' WHEN w.status = 'excluded_overseas' THEN CASE WHEN detail_checked_at IS NOT NULL AND rule IS NOT NULL THEN 'matched' ELSE 'unmatched' END ELSE w.status END AS status, CASE WHEN away THEN NULL WHEN w.status = 'excluded_overseas' THEN CASE WHEN detail_checked_at IS NOT NULL THEN rule END ELSE location_id END AS location_id
 FROM w LEFT JOIN r ON r.item_source_code = w.item_source_code AND r.place = detail_department AND r.org = detail_org""")
def apply_overseas(spark, sf):
    items = frame(spark, sf, ITEMS)
    rules = items.filter("color_name is not null and color_name <> 'es'").select("item_source_code", F.col("color_name").alias("normalized_place"), F.col("storage_location_id").cast("string").alias("detail_org"), F.col("storage_location_id").alias("location_id")).distinct()
    return P.apply_overseas(frame(spark, sf, CUSTODY), rules, frame(spark, sf, INSTITUTIONS)).select("id", "status", "location_id")


@query("D10_category_links", "SELECT doc_id, CASE WHEN source <> 'src3' THEN CAST(substr(source, 4) AS INT) END AS subcategory FROM documents")
def category_links(spark, sf):
    (d,) = tables(spark, sf, "documents")
    items = d.select("doc_id", F.col("lang").alias("category"), F.col("source").alias("child"))
    dim = items.filter("child <> 'src3'").select("category", "child", F.expr("cast(substr(child, 4) as int)").alias("subcategory")).distinct()
    return P.category_links(items, dim).select("doc_id", "subcategory")


R = 20000.0
DIST = "2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))".format(a="p", b="l")
SCOPE = f"WITH p AS ({PLACES}), l AS ({INSTITUTIONS}), w AS (SELECT p.query_id, p.position, p.place_name, l.id AS location_id, {DIST} AS distance FROM p JOIN l ON abs(l.latitude - p.latitude) < 1.1), m AS (SELECT query_id, location_id, min(distance) AS distance FROM w WHERE distance <= {{}} GROUP BY 1, 2)"


def places(spark, sf):
    return frame(spark, sf, PLACES), frame(spark, sf, INSTITUTIONS)


@query("E1_haversine", f"WITH p AS ({PLACES}), l AS ({INSTITUTIONS}) SELECT p.query_id, l.id, round({DIST}, 3) AS distance FROM p JOIN l ON l.id = p.query_id % 100 WHERE p.position = 1")
def haversine(spark, sf):
    p, l = places(spark, sf)
    pairs = p.filter("position = 1").join(l.withColumnsRenamed({"latitude": "lat", "longitude": "lon"}), F.expr("id = query_id % 100"))
    return pairs.select("query_id", "id", F.round(P.haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")), 3).alias("distance"))


@query("E2_within_radius", SCOPE.format(R) + f" SELECT query_id, position, location_id, round(distance, 3) AS distance FROM w WHERE distance <= {R}")
def within_radius(spark, sf):
    p, l = places(spark, sf)
    return P.within_radius(p, l, R).select("query_id", "position", "location_id", F.round("distance", 3).alias("distance"))


@query("E3_multi_scope", SCOPE.format(R) + " SELECT query_id, location_id, round(distance, 3) AS distance FROM m")
def multi_scope(spark, sf):
    p, l = places(spark, sf)
    return P.multi_scope(p, l, R).select("query_id", "location_id", F.round("distance", 3).alias("distance"))


@query("E4_expand_radius", SCOPE.format(100000.0) + " SELECT query_id, min(CASE WHEN distance <= 20000 AND query_id % 4 <> 3 THEN 20000.0 WHEN distance <= 50000 THEN 50000.0 ELSE 100000.0 END)::DOUBLE AS radius FROM m GROUP BY 1")
def expand_radius(spark, sf):
    p, l = places(spark, sf)
    return P.expand_radius(p.withColumn("requested", F.expr("if(query_id % 4 = 3, 50000, 20000)")), l, [20000.0, 50000.0, 100000.0])


@query("E5_radius_added", SCOPE.format(50000.0) + " SELECT query_id, location_id FROM m WHERE distance > 20000")
def radius_added(spark, sf):
    p, l = places(spark, sf)
    around = P.circles(p)
    return around.expand(P.radius_added(P.leading_scope(around, l, 50000.0), 20000.0, 50000.0))


@query("E6_nearest_place", SCOPE.format(50000.0) + " SELECT query_id, location_id AS item_id, arg_min(place_name, (round(w.distance, 6), position)) AS place_name FROM w JOIN m USING (query_id, location_id) GROUP BY 1, 2")
def nearest_place(spark, sf):
    p, l = places(spark, sf)
    return P.nearest_in_scope(p, l, 50000.0)


COUNTS = f"l AS ({INSTITUTIONS}), i AS ({ITEMS}), c AS (SELECT l.id, source_code, name, (SELECT count(*) FROM i WHERE storage_location_id = l.id AND status = 'matched') AS item_count FROM l WHERE is_active AND source_code = 'police')"
GROUPS = "SELECT 'police' AS code, true AS enabled UNION ALL SELECT 'partner' AS code, false AS enabled"


def counts(spark, sf):
    return P.location_counts(frame(spark, sf, ITEMS), frame(spark, sf, INSTITUTIONS), spark.sql(GROUPS))


@query("E7_location_counts", f"WITH {COUNTS} SELECT * FROM c")
def location_counts(spark, sf):
    return counts(spark, sf)


@query("E8_scope_totals", SCOPE.format(50000.0) + f", i AS ({ITEMS}), c AS (SELECT id, (SELECT count(*) FROM i WHERE storage_location_id = l.id AND status = 'matched') AS item_count FROM l WHERE is_active AND source_code = 'police') SELECT query_id, CAST(sum(item_count) AS BIGINT) AS items, count(*) AS institutions FROM m JOIN c ON c.id = location_id GROUP BY 1")
def scope_totals(spark, sf):
    p, l = places(spark, sf)
    around = P.circles(p)
    return around.expand(P.scope_totals(P.leading_scope(around, l, 50000.0), counts(spark, sf)))


@query("E8_coordinate_groups", "SELECT s_nationkey + 0.5 AS latitude, 127.5 AS longitude, list_sort(list(s_suppkey)) AS ids FROM supplier GROUP BY 1")
def coordinate_groups(spark, sf):
    (s,) = tables(spark, sf, "supplier")
    return P.coordinate_groups(s.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + F.lit(0.5).cast("decimal(2,1)")).cast("double").alias("latitude"), F.lit(127.5).alias("longitude")))


@query("E9_apply_counts", f"WITH {COUNTS} SELECT l.source_code, l.name, coalesce(c.item_count, 0) AS item_count, c.id AS location_id FROM l LEFT JOIN c USING (source_code, name)")
def apply_counts(spark, sf):
    return P.apply_counts(frame(spark, sf, INSTITUTIONS).select("source_code", "name"), counts(spark, sf))
