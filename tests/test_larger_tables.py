"""What larger tables hold and the given ones don't."""

import math

import duckdb
from pyspark.sql import functions as F

from lumafind.operators import alerts as A
from lumafind.operators import ingest
from lumafind.operators import places as P
from lumafind.operators import vectors as V
from lumafind.sources.staged import lean
from lumafind.streaming import streams
from test_whole_jobs import agree


def test_csv_tells_empty_texts_from_nulls(spark, tmp_path):
    duckdb.sql("SELECT * FROM (VALUES (1::BIGINT, '', 'en', 'src1'), (2, NULL, 'en', 'src1'), (3, ' ', '', 'src1'), (4, 'a \"quoted\" one,', 'en', 'src1'), (7, '\"\"', 'en', 'src1')) t(doc_id, text, lang, source)").write_parquet(str(tmp_path / "documents.parquet"))
    found = agree(spark, "A5_write_csv", tmp_path).set_index("atc_id")["item_name"]
    assert found["F1"] == "" and found["F2"] is None


def test_queries_with_the_same_places_are_answered_once(spark):
    places = [(q, k, f"{q}/{k}", 37.0 + (q % 2) * 0.3 + k * 0.2, 127.0) for q in range(40) for k in range(1, 3)] + [(99, 1, "far", 10.0, 10.0)]
    homes = [(i, 37.0 + (i % 5) * 0.11, 127.0 + (i % 5) * 0.05) for i in range(60)]
    p = spark.createDataFrame(places, "query_id long, position int, place_name string, latitude double, longitude double")
    loc = spark.createDataFrame(homes, "id long, latitude double, longitude double")

    def far(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371008.8 * math.asin(min(1, math.sqrt(h)))

    want, near = {}, {}
    for q, k, name, a, b in places:
        for i, c, d in homes:
            m = far(a, b, c, d)
            if m < want.get((q, i), 1e9):
                want[q, i], near[q, i] = m, name
    inside = {key for key, m in want.items() if m <= 25000}
    around = P.circles(p)
    assert around.asked.select("leader").distinct().count() == 3 and P.near_spots(around, loc, 25000.0).count() == len({(q % 2, i % 5) for q, i in inside})
    found = {(r.query_id, r.location_id): r.distance for r in P.multi_scope(p, loc, 25000.0).collect()}
    assert set(found) == inside and all(abs(found[k] - want[k]) < 1e-6 for k in found)
    assert {(r.query_id, r.item_id): r.place_name for r in P.nearest_in_scope(p, loc, 25000.0).collect()} == {k: near[k] for k in inside}
    steps = {r.query_id: r.radius for r in P.expand_radius(p.withColumn("requested", F.expr("if(query_id = 7, 9000, 1000)")), loc, [5000.0, 12000.0, 40000.0]).collect()}
    least = {q: max(min(m for (x, _), m in want.items() if x == q), 9000 if q == 7 else 1000) for q in {q for q, *_ in places}}
    assert steps == {q: min(r for r in (5000.0, 12000.0, 40000.0) if r >= m) for q, m in least.items() if m <= 40000}


def test_large_frames_are_never_gathered_to_be_broadcast(spark):
    rows = spark.range(100)
    few, many = lean(spark.range(5), "few", 5), lean(spark.range(6), "many", 5)
    assert "BroadcastHashJoin" in rows.join(few, "id")._jdf.queryExecution().executedPlan().toString()
    for how in ("inner", "left_semi", "left_anti"):
        joined = rows.join(many.select("id").filter("id < 3"), "id", how)
        joined.collect()
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_a_repeated_batch_tells_the_same_changes(spark, tmp_path):
    path, out = str(tmp_path / "table"), str(tmp_path / "out")
    schema = "item_source_code string, atc_id string, found_sequence string, payload string, since long, until long"
    shape = lambda rows: rows.select(*streams.KEYS, F.get_json_object("payload", "$.n").alias("n"), "since", "until", "change")
    sink = streams.compared_sink(path, out, streams.KEYS, shape)
    batch = lambda *rows: spark.createDataFrame([("p", a, "1", p, s, u) for a, p, s, u in rows], schema)
    told = lambda k: sorted((r.atc_id, r.change) for r in spark.read.parquet(f"{out}/batch={k}").collect())
    sink(batch(("a", '{"n":"1"}', 1, 1), ("b", '{"n":"1"}', 1, 1)), 0)
    second = batch(("a", '{"n":"2"}', 1, 2), ("b", '{"n":"1"}', 1, 1), ("c", '{"n":null}', 3, 3))
    for _ in range(2):
        sink(second, 1)
        assert told(0) == [("a", "insert"), ("b", "insert")] and told(1) == [("a", "update"), ("c", "insert")]
        assert sorted((r.atc_id, r.n, r.until) for r in ingest.read_buckets(spark, path).collect()) == [("a", "2", 2), ("b", "1", 1), ("c", None, 3)]


def test_pairs_of_many_blocks(spark, monkeypatch):
    """Blocks smaller than the tables give what all pairs at once give; vectors with nulls and other lengths meet none."""
    monkeypatch.setattr(V, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(V, "BLOCK_VECTORS", 7)
    made = [(k, k % 2, [float((k * j) % 5 - 2) + 0.5 for j in range(1, 5)]) for k in range(60)]
    rows = spark.createDataFrame(made + [(90, 0, [1.0, None, 1.0, 1.0]), (91, 0, [1.0]), (92, 1, None)], "id long, scope long, v array<double>")
    queries = rows.filter("id % 4 < 2 and id < 90").withColumnRenamed("id", "query_id")
    score = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)
    want = []
    for q, s, a in (m for m in made if m[0] % 4 < 2):
        near = sorted(((score(a, b), i) for i, t, b in made if t == s and score(a, b) >= 0.1), reverse=True)[:6]
        want += [(q, i, c, k + 1) for k, (c, i) in enumerate(near)]
    assert sorted((r.query_id, r.id, r.cos, r.rank) for r in V.exact_topk(queries, rows, 0.1, 6).collect()) == sorted(want)
    assert V.in_blocks(queries, rows, lambda a, b: a.select(["query_id"]).slice(0, 1), "query_id long").count() > 20
    judged = queries.select("query_id", "scope").join(rows.filter("id % 9 = 0").select("id", "scope"), "scope")
    code = lambda df: df.withColumn("code", V.binarize(F.col("v"), 4))
    pairs = code(queries).toDF("query_id", "scope", "a", "qc").join(code(rows.filter("size(v) = 4 and id < 90")), "scope")
    near, cos = pairs.select("query_id", "id", (1 - V.hamming(F.col("qc"), F.col("code")) / 4).alias("score")), pairs.select("query_id", "id", F.round(V.cosine(F.col("a"), F.col("v")), 6).alias("score"))
    swept = lambda df: sorted(map(tuple, df.select("weight", "recall_2", "recall_9").collect()))
    assert swept(V.scope_sweep(queries, rows, judged, [0.5, 0.7, 1.0], [2, 9])) == swept(V.weight_sweep(near, cos, judged, [0.5, 0.7, 1.0], [2, 9]))


def test_alerts_pair_places_with_institutions_of_items_only(spark, monkeypatch):
    sizes = {}
    monkeypatch.setattr(A, "staged", lambda df, name: sizes.setdefault(name, df.localCheckpoint()))
    time = F.lit("2024-06-01").cast("timestamp")
    queue = spark.range(30).select("id", time.alias("created_at"), F.lit(None).cast("timestamp").alias("checked_until"))
    places = spark.range(30).select(F.col("id").alias("query_id"), (F.lit(37.0) + F.col("id") % 2).alias("latitude"), F.lit(127.0).alias("longitude"))
    homes = spark.range(50).select("id", F.lit(37.0).alias("latitude"), F.lit(127.0).alias("longitude"), (F.col("id") != 3).alias("is_active"))
    items = spark.range(100, 104).select("id", F.lit("s").alias("item_source_code"), (F.col("id") - 98).alias("location_id"), (time + F.expr("interval 1 day")).alias("visible_since"), (time + F.expr("interval 1 day")).alias("first_seen_at"))
    told = queue.filter("id = 4").select(F.col("id").alias("reservation_id"), F.lit(100).cast("long").alias("item_id"))
    found = {(r.reservation_id, r.item_id) for r in A.alert_candidates(queue, places, homes, items, told, "s", 1000.0).collect()}
    assert found == {(q, i) for q in range(0, 30, 2) for i in (100, 102, 103)} - {(4, 100)}
    assert sizes["near"].count() == 3
