"""Queries of alerts. Customers are reservations, orders their messages and commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.masks import has_identifier
from ..operators import alerts as A
from ..functions.terms import Dictionary
from ..operators import conditions as W
from ..operators import search as R
from ..sources.staged import staged
from .adapt import INSTITUTIONS, ITEMS, PLACES, frame, tables
from .search import DOCS, FOLDED, PAIRS, TOKENS
from .registry import query

NOW = "2024-06-15 06:00:00"
RES = f"SELECT CAST(c_custkey AS BIGINT) AS id, concat('u', CAST(c_custkey % 400 AS STRING), '@example.com') AS email, CASE WHEN c_custkey % 5 = 0 THEN 'pending' WHEN c_custkey % 7 = 0 THEN 'expired' ELSE 'active' END AS status, TIMESTAMP '2024-06-01 00:00:00' + (c_custkey % 400) * INTERVAL '1' HOUR AS created_at, TIMESTAMP '2024-06-08 15:00:00' + (c_custkey % 300) * INTERVAL '1' HOUR AS expires_at FROM customer"
MSG = "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS reservation_id, CASE o_orderkey % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'match' ELSE 'notice' END AS kind, CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'sent' WHEN 2 THEN 'sending' WHEN 3 THEN 'failed' ELSE 'pending' END AS status, CAST(o_orderkey % 4 AS INT) AS attempts, TIMESTAMP '2024-06-14 00:00:00' + (o_orderkey % 1800) * INTERVAL '1' MINUTE AS created_at, TIMESTAMP '2024-06-14 12:00:00' + (o_orderkey % 1200) * INTERVAL '1' MINUTE AS claimed_at, TIMESTAMP '2024-06-13 00:00:00' + (o_orderkey % 3000) * INTERVAL '1' MINUTE AS sent_at, TIMESTAMP '2024-06-08 15:00:00' + (o_custkey % 300) * INTERVAL '1' HOUR AS for_expiry FROM orders"
TIMES = ("created_at", "expires_at", "claimed_at", "sent_at", "for_expiry", "checked_until", "visible_since", "first_seen_at", "at")


def timed(spark, sf, statement):
    df = frame(spark, sf, statement)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in TIMES if c in df.columns})


def reservations(spark, sf):
    return timed(spark, sf, RES)


def messages(spark, sf):
    return timed(spark, sf, MSG)


@query("I1_validate_reservations", "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'email' WHEN c_custkey % 13 = 0 THEN 'query' WHEN c_custkey % 17 = 0 THEN 'identifier' WHEN c_custkey % 19 = 0 THEN 'places' WHEN c_custkey % 23 = 0 THEN 'bounds' WHEN c_custkey % 29 = 0 THEN 'radius' WHEN c_custkey % 31 = 0 THEN 'consent' END AS reason, CASE WHEN c_custkey % 19 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS n_places FROM customer")
def validate_reservations(spark, sf):
    (c,) = tables(spark, sf, "customer")
    place = "named_struct('name', 'a', 'lat', {}, 'lon', 127.0D)"
    one, two, far = place.format("37.5D"), place.format("36.5D"), place.format("50.5D")
    rows = c.select(F.col("c_custkey").alias("id"), F.expr("if(c_custkey % 11 = 0, 'no mail', 'a@b.kr')").alias("email"), F.expr("CASE WHEN c_custkey % 13 = 0 THEN ' ' WHEN c_custkey % 17 = 0 THEN '01012345678' ELSE '지갑' END").alias("query"), F.expr(f"CASE WHEN c_custkey % 19 = 0 THEN slice(array({one}), 1, 0) WHEN c_custkey % 23 = 0 AND c_custkey % 2 = 0 THEN array({far}) WHEN c_custkey % 23 = 0 THEN array({far}, {one}) WHEN c_custkey % 2 = 0 THEN array({one}, {one}) ELSE array({one}, {two}, {one}) END").alias("places"), F.expr("if(c_custkey % 29 = 0, 999, 1500)").alias("radius_m"), F.expr("c_custkey % 31 <> 0").alias("consent"))
    return A.validate_reservations(rows, has_identifier).select("id", "reason", F.size("places").alias("n_places"))


#: Orders as requests: a mail a customer; a third of all requests come from one address, others share it five by five.
REQUESTS = "SELECT CAST(o_orderkey AS BIGINT) AS id, concat('m', CAST(o_custkey AS STRING)) AS email, CASE WHEN o_custkey % 3 = 0 THEN 'hot' ELSE concat('a', CAST(o_custkey % 300 AS STRING)) END AS address, TIMESTAMP '2024-06-01 00:00:00' + (o_orderkey % 4000) * INTERVAL '1' MINUTE AS at FROM orders"
OPEN = "SELECT concat('m', CAST(c_custkey AS STRING)) AS email FROM customer CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) z WHERE k <= c_custkey % 5"


@query("I2_admit_reservations", f"""WITH RECURSIVE o AS (SELECT email, count(*) AS n FROM ({OPEN}) x GROUP BY 1), r AS (SELECT q.*, coalesce(n, 0) AS held, row_number() OVER (PARTITION BY address ORDER BY "at", id) AS k FROM ({REQUESTS}) q LEFT JOIN o USING (email)),
 s AS (SELECT DISTINCT address, 0::BIGINT AS k, 0::BIGINT AS id, '' AS email, NULL::VARCHAR AS refused, []::STRUCT(m VARCHAR, t TIMESTAMP)[] AS log FROM r
 UNION ALL SELECT address, k, id, email, refused, CASE WHEN refused IS NULL THEN list_append(log, {{'m': email, 't': "at"}}) ELSE log END FROM (SELECT r.address, r.k, r.id, r.email, r."at", log, CASE WHEN held + len(list_filter(log, lambda x: x.m = r.email)) >= 3 THEN 'mail' WHEN len(list_filter(log, lambda x: x.t > r."at" - INTERVAL 24 HOUR)) >= 5 THEN 'address' END AS refused FROM s JOIN r ON r.address = s.address AND r.k = s.k + 1) y)
 SELECT id, email, refused FROM s WHERE k > 0""")
def admit_reservations(spark, sf):
    return A.admit_reservations(timed(spark, sf, REQUESTS), frame(spark, sf, OPEN))


@query("I3_alert_period", f"SELECT id, CAST(CAST(created_at + INTERVAL 9 HOUR AS DATE) + 8 AS TIMESTAMP) - INTERVAL 9 HOUR AS expires_at, CAST(created_at + INTERVAL 9 HOUR AS DATE) + 1 AS first_day, CAST(created_at + INTERVAL 9 HOUR AS DATE) + 7 AS last_day FROM ({RES}) r")
def alert_period(spark, sf):
    return A.alert_period(reservations(spark, sf)).select("id", "expires_at", "first_day", "last_day")


QUEUE = f"r AS ({RES}), m AS ({MSG}), k AS (SELECT id AS reservation_id, TIMESTAMP '2024-06-10 00:00:00' AS checked_until FROM r WHERE id % 3 = 0), qu AS (SELECT r.*, checked_until FROM r LEFT JOIN k ON k.reservation_id = r.id WHERE status = 'active' AND expires_at > TIMESTAMP '{NOW}' AND CAST(created_at + INTERVAL 9 HOUR AS DATE) < DATE '2024-06-15' AND NOT EXISTS (FROM m WHERE kind = 'notice' AND m.reservation_id = r.id AND for_expiry = expires_at))"


def queue(spark, sf):
    r, m = reservations(spark, sf), messages(spark, sf)
    cursors = r.filter("id % 3 = 0").select(F.col("id").alias("reservation_id"), F.lit("police_api").alias("source"), F.lit("2024-06-10").cast("timestamp").alias("checked_until"))
    return A.match_queue(r, cursors, m, "police_api", NOW), cursors


@query("I4_match_queue", f"WITH {QUEUE} SELECT id, checked_until FROM qu")
def match_queue(spark, sf):
    return queue(spark, sf)[0].select("id", "checked_until")


METRES = 120000.0
ALERT_ITEMS = f"SELECT id, item_source_code, storage_location_id AS location_id, TIMESTAMP '2024-06-05 00:00:00' + (id % 240) * INTERVAL '1' HOUR AS visible_since, TIMESTAMP '2024-06-04 00:00:00' + (id % 240) * INTERVAL '1' HOUR AS first_seen_at FROM ({ITEMS}) x"
DIST = "2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(l.latitude - p.latitude) / 2), 2) + cos(radians(p.latitude)) * cos(radians(l.latitude)) * pow(sin(radians(l.longitude - p.longitude) / 2), 2))))"
CANDS = f"WITH {QUEUE}, p AS ({PLACES}), l AS ({INSTITUTIONS}), ai AS ({ALERT_ITEMS}), cand AS (SELECT DISTINCT qu.id AS reservation_id, ai.id AS item_id, visible_since FROM qu JOIN p ON p.query_id = qu.id JOIN l ON is_active AND abs(l.latitude - p.latitude) < 1.2 JOIN ai ON ai.location_id = l.id AND item_source_code = 'police_api' WHERE {DIST} <= {METRES} AND (checked_until IS NULL OR visible_since > checked_until) AND first_seen_at > created_at AND NOT (qu.id % 6 = 0 AND ai.id = qu.id))"


def candidates(spark, sf):
    q, _ = queue(spark, sf)
    items = timed(spark, sf, ALERT_ITEMS)
    notified = q.filter("id % 6 = 0").select(F.col("id").alias("reservation_id"), F.col("id").alias("item_id"))
    return A.alert_candidates(q, frame(spark, sf, PLACES), frame(spark, sf, INSTITUTIONS), items, notified, "police_api", METRES)


@query("I5_alert_candidates", CANDS + " SELECT * FROM cand")
def alert_candidates(spark, sf):
    return candidates(spark, sf)


#: A dictionary over the driver's words: the first words of parts as colours and brands, spelled as words of the documents.
JUDGED = Dictionary(
    [
        {"domain": "color", "canonical": "blue", "terms": ["that"], "scope": []}, {"domain": "color", "canonical": "red", "terms": ["tion"], "scope": []},
        {"domain": "brand", "canonical": "large", "terms": ["this"], "scope": []}, {"domain": "brand", "canonical": "small", "terms": ["from"], "scope": []}, {"domain": "brand", "canonical": "old", "terms": ["thon"], "scope": []},
    ],
    [],
    {},
)
#: A maker stands for its models, which stand for nothing else: small also for old, and this for a word of its own.
MAKERS = {"small": ("old",), "old": ("ther",)}
CONCEPTS = "(VALUES ('blue', 'color', 'that'), ('red', 'color', 'tion'), ('large', 'brand', 'this'), ('small', 'brand', 'from'), ('old', 'brand', 'thon')) v(canonical, domain, term)"
MET = "(VALUES ('blue', 'color', ['blue', 'that']), ('red', 'color', ['red', 'tion']), ('large', 'brand', ['large', 'this']), ('small', 'brand', ['small', 'from', 'old', 'thon', 'ther']), ('old', 'brand', ['old', 'thon', 'ther'])) f(canonical, domain, forms)"
#: Reservations ask for the name of the part of their number.
ASKED = "SELECT CAST(c_custkey AS BIGINT) AS reservation_id, p_name AS text FROM customer JOIN part ON p_partkey = c_custkey"
BRANDED = "array_to_string(list_transform(string_split({}, ' '), lambda w: CASE w WHEN 'this' THEN 'large' WHEN 'from' THEN 'small' WHEN 'thon' THEN 'old' ELSE w END), ' ')"
CONDITIONS = f"""fw AS (SELECT id, list_distinct(string_split({FOLDED.format('search_text')}, ' ')) AS ws FROM d), aq AS ({ASKED}),
 wq AS (SELECT DISTINCT reservation_id, domain, canonical FROM (SELECT reservation_id, unnest(string_split(text, ' ')) AS w FROM aq) x JOIN {CONCEPTS} ON w IN (canonical, term)),
 mn AS (SELECT id, domain, canonical FROM fw JOIN {MET} ON list_has_any(ws, forms)), dm AS (SELECT reservation_id, count(DISTINCT domain) AS n FROM wq GROUP BY 1)"""
MEETS = "coalesce((SELECT n FROM dm WHERE dm.reservation_id = {0}.reservation_id), 0) = (SELECT count(DISTINCT wq.domain) FROM wq WHERE wq.reservation_id = {0}.reservation_id AND (EXISTS (FROM mn WHERE mn.id = {0}.item_id AND mn.domain = wq.domain AND mn.canonical = wq.canonical) OR (wq.domain = 'color' AND NOT EXISTS (FROM mn WHERE mn.id = {0}.item_id AND mn.domain = 'color'))))"
JUDGE = CANDS + f""", {DOCS.replace('i AS (', 'it AS (', 1).replace('FROM i WHERE', 'FROM it WHERE', 1)}, {CONDITIONS},
 qt AS (SELECT reservation_id, text, list_concat({PAIRS}, list_transform(list_filter(string_split(text, ' '), lambda w: w IN ('blue', 'red', 'large', 'small', 'old')), lambda w: CASE w WHEN 'blue' THEN 'that' WHEN 'red' THEN 'tion' WHEN 'large' THEN 'this' WHEN 'small' THEN 'from' ELSE 'thon' END)) AS terms FROM aq),
 c AS (SELECT reservation_id, item_id, visible_since FROM cand JOIN qt USING (reservation_id) JOIN d ON d.id = item_id WHERE len(list_filter(terms, lambda t: contains(search_text, t))) > 0),
 y AS (SELECT id, {TOKENS.format(BRANDED.format(FOLDED.format('search_text')))} AS t FROM d), e AS (SELECT id, len(t) AS length, unnest(t) AS token FROM y), v AS (SELECT id, length, token, count(*) AS tf FROM e GROUP BY 1, 2, 3),
 z AS (SELECT reservation_id, count(*) AS n, avg(len(t)) AS mean FROM c JOIN y ON y.id = item_id GROUP BY 1),
 a AS (SELECT DISTINCT reservation_id, unnest({TOKENS.format('text')}) AS token FROM qt), h AS (SELECT reservation_id, item_id, length, a.token, tf FROM a JOIN c USING (reservation_id) JOIN v ON v.id = item_id AND v.token = a.token),
 df AS (SELECT reservation_id, token, count(*) AS df FROM h GROUP BY 1, 2), w AS (SELECT reservation_id, item_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS raw FROM h JOIN df USING (reservation_id, token) JOIN z USING (reservation_id) GROUP BY 1, 2),
 judged AS (SELECT w.reservation_id, w.item_id, visible_since, round(raw / (raw + 1), 6) AS score FROM w JOIN c USING (reservation_id, item_id) WHERE raw > 0 AND {MEETS.format('w')})"""


def judge_inputs(spark, sf):
    """Candidates, what their reservations ask for, and the search index of all items."""
    docs = R.build_documents(frame(spark, sf, ITEMS), None, NOW)
    return staged(candidates(spark, sf), "alert-candidates"), frame(spark, sf, ASKED), R.indexed(docs, JUDGED)


def judged(spark, sf):
    c, asked, index = judge_inputs(spark, sf)
    rules = W.Conditions(JUDGED, MAKERS)
    return staged(A.judge(c, asked, index, JUDGED, lambda *given: A.search_judge(*given, rules)), "judged")


@query("I6_judge", JUDGE + " SELECT reservation_id, item_id, score FROM judged")
def judge(spark, sf):
    return judged(spark, sf).select("reservation_id", "item_id", "score")


@query("I7_meets_conditions", CANDS + f", {DOCS.replace('i AS (', 'it AS (', 1).replace('FROM i WHERE', 'FROM it WHERE', 1)}, {CONDITIONS} SELECT reservation_id, item_id FROM cand c WHERE item_id IN (SELECT id FROM d) AND {MEETS.format('c')}")
def meets_conditions(spark, sf):
    """Conditions come from the reservations' texts and the dictionary, the words from the whole texts of the items."""
    docs = staged(R.build_documents(frame(spark, sf, ITEMS), None, NOW).select("id", "search_text"), "documents")
    pairs = candidates(spark, sf).select(F.col("reservation_id").alias("query_id"), F.col("item_id").alias("id")).join(docs.select("id"), "id", "left_semi")
    rules = W.Conditions(JUDGED, MAKERS)
    asked = W.wanted(frame(spark, sf, ASKED).withColumnRenamed("reservation_id", "query_id"), rules)
    return W.meets(pairs, staged(asked, "conditions"), staged(W.mentions(docs, rules), "mentions")).select(F.col("query_id").alias("reservation_id"), F.col("id").alias("item_id"))


@query("I8_record_matches", JUDGE + ", f AS (SELECT * FROM judged WHERE item_id % 16 <> 0) SELECT reservation_id, count(*) AS items, NOT EXISTS (FROM m WHERE kind = 'match' AND m.status = 'pending' AND m.reservation_id = f.reservation_id) AS message FROM f GROUP BY 1")
def record_matches(spark, sf):
    """What the judge found, less the pairs of every 16th item, which were notified before."""
    found = judged(spark, sf)
    fresh, need = A.record_matches(found, found.filter("item_id % 16 = 0").select("reservation_id", "item_id"), messages(spark, sf))
    return fresh.groupBy("reservation_id").agg(F.count("*").alias("items")).join(need.withColumn("need", F.lit(True)), "reservation_id", "left").select("reservation_id", "items", F.coalesce("need", F.lit(False)).alias("message"))


@query("I9_advance_cursors", CANDS + ", s AS (SELECT reservation_id, max(visible_since) AS seen FROM cand GROUP BY 1) SELECT reservation_id, 'police_api' AS source, CASE WHEN seen IS NULL THEN checked_until WHEN checked_until IS NULL THEN seen ELSE greatest(seen, checked_until) END AS checked_until FROM k FULL OUTER JOIN s USING (reservation_id)")
def advance_cursors(spark, sf):
    return A.advance_cursors(queue(spark, sf)[1], candidates(spark, sf), "police_api")


@query("I10_expiry_notices", f"WITH r AS ({RES}), m AS ({MSG}) SELECT r.id AS reservation_id, CASE WHEN w.message_id IS NULL THEN 'insert' ELSE 'convert' END AS action, w.message_id FROM r LEFT JOIN (SELECT reservation_id, min(id) AS message_id FROM m WHERE kind = 'match' AND status = 'pending' GROUP BY 1) w ON w.reservation_id = r.id WHERE status = 'active' AND expires_at > TIMESTAMP '{NOW}' AND expires_at <= TIMESTAMP '{NOW}' + INTERVAL 24 HOUR AND NOT EXISTS (FROM m WHERE kind = 'notice' AND m.reservation_id = r.id AND for_expiry = expires_at)")
def expiry_notices(spark, sf):
    m = messages(spark, sf)
    return A.expiry_notices(reservations(spark, sf), m, NOW).select("reservation_id", "action", "message_id")


@query("I11_claim_batch", f"WITH m AS ({MSG}), st AS (SELECT *, status = 'sending' AND claimed_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE AS stuck FROM m), sp AS (SELECT count(*) FILTER ((status = 'sent' AND sent_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) OR (status = 'sending' AND NOT stuck)) AS spent FROM st), w AS (SELECT id, kind, attempts + 1 AS attempts, row_number() OVER (ORDER BY CASE kind WHEN 'confirm' THEN 0 WHEN 'match' THEN 1 ELSE 2 END, created_at, id) AS place FROM st WHERE status = 'pending' OR stuck) SELECT id, kind, attempts, place FROM w, sp WHERE place <= 300 AND place <= 20000 - spent")
def claim_batch(spark, sf):
    return A.claim_batch(messages(spark, sf), NOW, 300, 20000)


#: Orders of an item's number notified it to their customer; of every fifth the score is unknown.
NOTIFIED = "SELECT CAST(o_custkey AS BIGINT) AS reservation_id, CAST(o_orderkey AS BIGINT) AS item_id, CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice / 1000000, 6) END AS score FROM orders JOIN documents ON doc_id = o_orderkey"
NEAR = DIST.replace("l.latitude", "g.latitude").replace("l.longitude", "g.longitude")


@query("I12_payloads", f"""WITH m AS ({MSG}), p AS ({PLACES}), l AS ({INSTITUTIONS}), i AS ({ITEMS}), n AS ({NOTIFIED}),
 g AS (SELECT n.*, item_name, registered_on, name, latitude, longitude FROM n JOIN i ON i.id = item_id LEFT JOIN l ON l.id = storage_location_id),
 w AS (SELECT g.reservation_id, g.item_id, g.score, g.registered_on, g.name, (SELECT place_name FROM p WHERE p.query_id = g.reservation_id AND g.latitude IS NOT NULL ORDER BY round({NEAR}, 6), position LIMIT 1) AS near FROM g)
 SELECT m.id, coalesce(string_agg(w.item_id || ':' || coalesce(w.name, '-') || ':' || coalesce(near, '-'), ',' ORDER BY w.score DESC NULLS LAST, w.registered_on DESC, w.item_id DESC), '') AS items, (SELECT string_agg(place_name, ',' ORDER BY position) FROM p WHERE p.query_id = m.reservation_id) AS places FROM m LEFT JOIN w USING (reservation_id) WHERE m.status = 'sending' GROUP BY m.id, m.reservation_id""")
def payloads(spark, sf):
    items = frame(spark, sf, ITEMS).withColumnRenamed("storage_location_id", "location_id")
    rows = A.payloads(messages(spark, sf).filter("status = 'sending'"), frame(spark, sf, NOTIFIED), items, frame(spark, sf, PLACES), frame(spark, sf, INSTITUTIONS))
    told = F.transform("items", lambda x: F.concat_ws(":", x["item_id"].cast("string"), F.coalesce(x["location_name"], F.lit("-")), F.coalesce(x["near_place_name"], F.lit("-"))))
    return rows.select("id", F.array_join(told, ",").alias("items"), F.array_join("places", ",").alias("places"))


@query("I13_apply_outcomes", f"WITH m AS ({MSG}) SELECT id, CASE WHEN status <> 'sending' THEN status WHEN id % 4 = 0 THEN 'sent' WHEN id % 4 = 1 THEN 'failed' WHEN id % 4 = 2 THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status FROM m")
def apply_outcomes(spark, sf):
    m = messages(spark, sf)
    out = m.filter("id % 4 <> 3").select("id", F.expr("CASE id % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'permanent' ELSE 'temporary' END").alias("outcome"))
    return A.apply_outcomes(m, out).select("id", "status")


@query("I13_sendable", f"WITH m AS ({MSG}), r AS ({RES}) SELECT m.id, coalesce(CASE WHEN kind = 'confirm' THEN r.status = 'pending' AND r.created_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR ELSE r.status = 'active' END, false) AS sendable FROM m LEFT JOIN r ON r.id = m.reservation_id")
def sendable(spark, sf):
    return A.sendable(messages(spark, sf), reservations(spark, sf), NOW).select("id", "sendable")


CLOSING = f"m AS ({MSG}), r AS ({RES}), g AS ({REQUESTS}), c AS (SELECT *, CASE WHEN status = 'active' AND expires_at <= TIMESTAMP '{NOW}' THEN 'expired' WHEN status = 'pending' AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR THEN 'unconfirmed' END AS ends FROM r)"
#: Request times are of the first days of June; the log is purged as of then.
LOGGED = "2024-06-03 00:00:00"


def closed(spark, sf):
    log = timed(spark, sf, REQUESTS).select("address", (F.col("at") + F.expr(f"timestamp '{NOW}' - timestamp '{LOGGED}'")).alias("at"))
    return A.close_ended(reservations(spark, sf), messages(spark, sf), log, NOW)


@query("I14_close_ended", f"WITH {CLOSING} SELECT coalesce(ends, c.status) AS status, count(*) AS n, count(CASE WHEN ends IS NULL THEN email END) AS mails, (SELECT count(*) FROM m LEFT JOIN c x ON x.id = m.reservation_id WHERE m.status <> 'pending' OR x.ends IS NULL) AS messages FROM c GROUP BY 1")
def close_ended(spark, sf):
    done = closed(spark, sf)
    return done.reservations.groupBy("status").agg(F.count("*").alias("n"), F.count("email").alias("mails")).crossJoin(done.messages.agg(F.count("*").alias("messages")))


@query("I14_close_counts", f"WITH {CLOSING} SELECT count(*) FILTER (ends = 'expired') AS expired, count(*) FILTER (ends = 'unconfirmed') AS unconfirmed_closed, (SELECT count(*) FROM m JOIN c x ON x.id = m.reservation_id WHERE m.status = 'pending' AND ends IS NOT NULL) AS messages_dropped, (SELECT count(*) FROM g WHERE \"at\" <= TIMESTAMP '{LOGGED}' - INTERVAL 24 HOUR) AS request_log_purged FROM c")
def close_counts(spark, sf):
    return closed(spark, sf).counts


COMMANDS = "SELECT CAST(o_custkey AS BIGINT) AS id, CASE o_orderkey % 5 WHEN 0 THEN 'confirm' WHEN 4 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'cancel' ELSE 'discard' END ELSE 'extend' END AS command, TIMESTAMP '2024-06-01 00:00:00' + (o_orderkey % 500) * INTERVAL '1' HOUR AS at, CAST(o_orderkey AS BIGINT) AS seq FROM orders"
#: Commands one by one: the k-th of each reservation on the state that the earlier ones left.
FOLD = """s AS (SELECT *, 0::BIGINT AS k, 0::BIGINT AS extension_count FROM r0
 UNION ALL SELECT id, CASE WHEN confirm THEN 'active' WHEN cancel THEN 'cancelled' WHEN discard THEN 'discarded' ELSE status END, CASE WHEN cancel OR discard THEN NULL ELSE email END, created_at, CASE WHEN extend THEN expires_at + INTERVAL 7 DAY ELSE expires_at END, k, extension_count + CASE WHEN extend THEN 1 ELSE 0 END FROM (
  SELECT s.id, status, email, created_at, expires_at, c.k, extension_count, command = 'confirm' AND status = 'pending' AND c."at" < created_at + INTERVAL 24 HOUR AS confirm, command = 'extend' AND status = 'active' AND c."at" < expires_at AND extension_count < 3 AS extend, command = 'cancel' AND ((status = 'active' AND c."at" < expires_at) OR status = 'pending') AS cancel, command = 'discard' AND status = 'pending' AS discard FROM s JOIN c ON c.id = s.id AND c.k = s.k + 1) x)"""


def commands(spark, sf):
    return timed(spark, sf, COMMANDS)


@query("I15_apply_commands", f"WITH RECURSIVE r0 AS (SELECT id, status, email, created_at, expires_at FROM ({RES}) x), c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY \"at\", seq) AS k FROM ({COMMANDS}) y), {FOLD} SELECT id, status, email, created_at, expires_at, extension_count FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1")
def apply_commands(spark, sf):
    rows = reservations(spark, sf).withColumn("extension_count", F.lit(0).cast("long"))
    return A.apply_commands(rows, commands(spark, sf))


@query("I16_alert_audit", JUDGE + " SELECT count(*) AS matched_items, count(DISTINCT reservation_id) AS reservations, (SELECT count(*) FROM m WHERE status = 'sent') AS sent, (SELECT count(*) FROM m WHERE status = 'failed') AS failed, (SELECT count(*) FROM m WHERE status = 'pending') AS waiting, 'partial' AS status FROM judged")
def alert_audit(spark, sf):
    return A.alert_audit(judged(spark, sf), messages(spark, sf))
