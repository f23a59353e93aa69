"""Retry search over radii and rewrites, admission of requests against a plain fold, and the cycle barrier."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumafind.functions import terms
from lumafind.operators import alerts, runs, search


def test_retry(spark):
    rows = [(1, 42, "검정 지갑"), (2, 42, "반지갑"), (3, 44, "백팩 가방"), (4, 43, "지갑")]
    docs = spark.createDataFrame([(i, c, t, (t, None, "")) for i, c, t in rows], "id long, location_id long, search_text string, detail struct<item_name: string, raw_category_name: string, description: string>")
    d = terms.Dictionary.load()
    metre = 1 / 111_194.93
    places = [42, 43, 44, 99]
    locations = spark.createDataFrame([(i, 37.0 + m * metre, 127.0) for i, m in zip(places, (0, 1200, 1800, 11_000))], "id long, latitude double, longitude double")
    asked = [(1, "지갑", None), (2, "없는말", None), (3, "가방", None), (4, "없는말", None), (5, "지갑", None), (6, "없는말", None), (7, " 지갑 ", 1500.0), (8, "지갑", None), (9, "지갑", 5000.0)]
    queries = spark.createDataFrame(asked, "query_id long, text string, requested double")
    where = spark.createDataFrame([(q, 37.0, 127.0) for q in (1, 2, 3, 4, 6, 7, 8, 9)] + [(5, 10.0, 10.0)], "query_id long, latitude double, longitude double")
    rewrites = spark.createDataFrame([(2, "지갑"), (4, "가방"), (6, " "), (8, "지갑")], "query_id long, rewritten string")
    found = search.search_with_retry(queries, where, locations, rewrites, search.indexed(docs, d), d)
    got = {r.query_id: (r.status, r.attempt, r.radius, r.text, r.total, r.ids) for r in found.collect()}
    assert {k: v[:5] for k, v in got.items()} == {
        1: ("results", 1, 1000.0, "지갑", 2), 2: ("results", 2, 1000.0, "지갑", 2), 3: ("results", 3, 2000.0, "가방", 1), 4: ("results", 4, 2000.0, "가방", 1),
        5: ("no_institutions", None, None, "지갑", 0), 6: ("no_matches", 3, 2000.0, "없는말", 0), 7: ("results", 1, 1500.0, "지갑", 3), 8: ("results", 1, 1000.0, "지갑", 2), 9: ("results", 1, 2000.0, "지갑", 3),
    }
    assert got[3][5] == [3] and set(got[1][5]) == {1, 2} and len(got[7][5]) == 3 and got[6][5] == []
    log = {(r.query_id, r.attempt): r.match_count for r in search.retry_log(found).collect()}
    assert [log.get((4, k)) for k in range(1, 6)] == [0, 0, 0, 1, None] and (5, 1) not in log


def plain(requests, held, earlier):
    mails, times, out = defaultdict(int, held), defaultdict(list), {}
    for a, t in earlier:
        times[a].append(t)
    for i, mail, address, at in sorted(requests, key=lambda r: (r[3], r[0])):
        recent = [t for t in times[address] if t <= at and at - t < timedelta(hours=24)]
        out[i] = "mail" if mails[mail] >= 3 else "address" if address and len(recent) >= 5 else None
        if not out[i]:
            mails[mail] += 1
            times[address].append(at)
    return out


def test_admission(spark):
    """A third of all requests come from one address, and mails and addresses mix."""
    rng = random.Random(4)
    start = datetime(2024, 6, 1)
    requests = [(i, f"m{rng.randrange(80)}", rng.choice(["hot", f"a{rng.randrange(40)}", rng.choice([None, "b"])]), start + timedelta(minutes=rng.randrange(6000))) for i in range(600)]
    held, earlier = {"m1": 3, "m2": 2}, [("hot", start - timedelta(hours=1)), ("b", start - timedelta(hours=23, minutes=30)), ("b", start - timedelta(hours=30))]
    frame = spark.createDataFrame(requests, "id long, email string, address string, at timestamp")
    open_now = spark.createDataFrame([(m,) for m, n in held.items() for _ in range(n)], "email string")
    log = spark.createDataFrame(earlier, "address string, at timestamp")
    got = {r.id: r.refused for r in alerts.admit_reservations(frame, open_now, log).collect()}
    assert got == plain(requests, held, earlier) and {"mail", "address", None} == set(got.values())
    assert alerts.admit_reservations(frame.limit(0), open_now).count() == 0


def test_cycle(spark):
    def ready(rows):
        df = spark.createDataFrame([(i, s, st, f"2024-01-01 {h:02}:00:00", f"2024-01-01 {h:02}:30:00" if st != "running" and done else None, m) for i, (s, st, h, done, m) in enumerate(rows)], "id long, source string, status string, started_at string, finished_at string, metadata string")
        df = df.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")})
        return {(str(r.business_date), r.cycle): r.ready for r in runs.cycle_ready(df).collect()}

    late = '{"cleanup_enabled": false}'
    morning = [("police", "failed", 1, True, None), ("partner", "succeeded", 2, True, '{"cleanup_enabled": true}')]
    assert ready(morning) == {("2024-01-01", "morning"): True}
    #: The morning's result doesn't open the afternoon's barrier; the later run of a source counts.
    assert ready([*morning, ("police", "partial", 12, True, late)]) == {("2024-01-01", "morning"): True, ("2024-01-01", "afternoon"): False}
    assert ready([*morning, ("police", "succeeded", 3, False, None)]) == {("2024-01-01", "morning"): False}
    #: A run of another date that still runs holds all of them back; a date in the metadata counts.
    assert ready([*morning, ("police", "running", 3, False, '{"business_date": "2023-12-31"}')]) == {("2024-01-01", "morning"): False, ("2023-12-31", "morning"): False}
