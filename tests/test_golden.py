"""Golden cases of normalisation, matching, masking, synonyms, windows and alerts."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumafind.functions import masks, scalars, terms
from lumafind.operators import alerts, ingest, places, privacy, search, vectors
from lumafind.sources import pages


MASKS = [
    ("5500-1111-2222-7788 paid", False, "5500-****-****-7788 paid"),
    ("5500111122227788", False, "5500********7788"),
    ("3411-222222-98765", False, "3411-******-*8765"),
    ("6011222233334444555", False, "6011***********4555"),
    ("5500-11**-****-7788", False, "5500-11**-****-7788".replace("11**", "****")),
    ("****-1111-2222-7788", False, "****-****-****-7788"),
    ("550011112222", False, "550011112222"),
    ("55001111222277889900", False, "55001111222277889900"),
    ("850412-2345678 and 8504122345678", False, "******-******* and ******-*******"),
    ("017.222.3333, 010 9999 8888", False, "017-****-3333, 010-****-8888"),
    ("통장(박보람 명의)", False, "통장(박*람 명의)"),
    ("성명 : 최하나\n이름 윤슬", False, "성명 : 최*나\n이름 윤*"),
    ("소유자 미상, 명의자: 법인", False, "소유자 미상, 명의자: 법인"),
    ("지갑 [ 황보가람 ]", True, "지갑 [ 황**람 ]"),
    ("카드 (정다운)", True, "카드 (정*운)"),
    ("카드 (정다운)", False, "카드 (정다운)"),
    ("카드 (정다운이) (면허증) (우리은) (카드홀더)", True, "카드 (정다운이) (면허증) (우리은) (카드홀더)"),
    ("", True, ""),
    (None, True, None),
]


def test_masks(spark):
    rows = spark.createDataFrame(MASKS, "text string, risky boolean, want string")
    once = rows.withColumn("got", masks.mask_text(F.col("text"), F.col("risky")))
    twice = once.withColumn("again", masks.mask_text(F.col("got"), F.col("risky"))).withColumn("found", masks.has_identifier(F.col("text")))
    for r in twice.collect():
        assert (r.got, r.again) == (r.want, r.want), r.text
        assert r.found == (r.text is not None and any(c in r.want for c in "*") and not any("가" <= c <= "힣" for c in r.text)), r.text


def test_dictionary_words_are_no_names(spark):
    text = spark.createDataFrame([("(마틴킴) (은하늘)",)], "t string")
    assert text.select(masks.mask_bracketed(F.col("t"))).first()[0] == "(마틴킴) (은*늘)"
    assert text.select(masks.mask_bracketed(F.col("t"), ("은하늘",))).first()[0] == "(마*킴) (은하늘)"


def test_masked_columns(spark):
    row = spark.createDataFrame([("5500111122227788",) * 6], "item_name string, description string, normalized_search_text string, search_text string, raw_category_name string, color_name string")
    got = privacy.mask_table(row).first()
    assert [c for c in row.columns if got[c] == "5500********7788"] == ["item_name", "description", "normalized_search_text", "search_text"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("하얀색 Matin Kim 파우치", "흰색 마뗑킴 파우치"),
        ("블랙백팩", "검정 백팩"),
        ("블루투스 이어폰 왼쪽 유닛", "무선이어폰 왼쪽유닛"),
        ("삼성 화이트 냉장고", "삼성 화이트 냉장고"),
        ("톰브라운", "톰브라운"),
        ("버즈프로2", "버즈 프로 2"),
        ("black brown", "검정 갈색"),
    ],
)
def test_synonyms(text, want):
    d = terms.Dictionary.load()
    assert d.canonicalize(text) == want
    assert d.canonicalize(want) == want


def test_query_colour_and_kinds(spark):
    d = terms.Dictionary.load()
    assert d.canonicalize("화이트 물건", query=True) == "흰색 물건"
    want = {"비니 하나": ["모자"], "머니클립": ["지갑"], "갤럭시 에어팟": ["이어폰"], "갤럭시 스마트폰 버즈": ["이어폰", "휴대폰"], "현금을 넣 는 것": ["지갑"], "책 한 권": ["책"], "책상": [], "": []}
    rows = spark.createDataFrame([(t,) for t in want], "t string").withColumn("kinds", terms.detect_kinds(F.col("t"), d))
    assert {r.t: r.kinds for r in rows.collect()} == want


def test_candidate_terms():
    d = terms.Dictionary.load()
    assert d.candidates("지갑", ["지갑"]) == (["돈을 넣", "돈을넣", "머니클립", "지갑", "카드홀더", "현금을 넣", "현금을넣"], [])
    assert d.candidates("ab 키", []) == (["ab"], ["키"])
    found, _ = d.candidates("마뗑킴", [])
    assert {"뗑킴", "마틴킴", "kim"} <= set(found)


def test_dictionary_tables(spark):
    kinds = pages.load_kinds(spark, str(terms.DATA / "kinds.json"))
    assert kinds.filter("kind = '지갑' and not hint").count() == 5
    synonyms = pages.load_synonyms(spark, str(terms.DATA / "synonyms.json"))
    assert {r.canonical for r in synonyms.filter("term = 'black'").collect()} == {"검정"}


def test_matching_cases(spark):
    loc = spark.createDataFrame([(1, "서울강남경찰서", True), (2, "부산강남경찰서", True), (3, "비발디파크", True), (4, "비발디파크(오크동)", True), (5, "서울테스트역(안내소)", True), (6, "폐쇄", False)], "id long, name string, is_active boolean")
    alias = spark.createDataFrame([("폐쇄지점", 6, True, "manual", None)], "normalized_alias string, location_id long, verified boolean, match_method string, region string")
    names = ["서울강남경찰서", "강남경찰서", "비발디파크", "비발디", "서울테스트역", "테스트역안내소", "폐쇄지점", " "]
    items = spark.createDataFrame([(n,) for n in names], "raw_storage_name string")
    got = {r.raw_storage_name: (r.location_id, r.match_status) for r in places.resolve_locations(items, alias, loc).collect()}
    assert got == {"서울강남경찰서": (1, "matched"), "강남경찰서": (None, "ambiguous"), "비발디파크": (3, "matched"), "비발디": (None, "unmatched"), "서울테스트역": (5, "matched"), "테스트역안내소": (5, "matched"), "폐쇄지점": (None, "unmatched"), " ": (None, "unmatched")}


def test_dates_and_windows(spark):
    days = spark.createDataFrame([("2026-09-26",), ("2026-08-31",), ("2028-08-31",)], "d string").select(scalars.retention_start(F.to_date("d"), F.lit(6)).alias("d"))
    assert [str(r.d) for r in days.collect()] == ["2026-03-26", "2026-02-28", "2028-02-29"]
    day = dt.date
    requests = spark.createDataFrame([(1, day(2026, 5, 20), day(2026, 6, 5), 7), (2, day(2026, 6, 5), day(2026, 5, 20), 7), (3, day(2026, 5, 20), day(2026, 6, 5), 0)], "id long, start date, end date, days int").withColumn("floor", F.lit("2026-01-01").cast("date"))
    got = sorted((r.id, r.error, str(r.window_start), str(r.window_end)) for r in ingest.backfill_windows(requests, "2026-06-30").collect() if r.id == 1 or r.error)
    assert got == [(1, None, "2026-05-20", "2026-05-26"), (1, None, "2026-05-27", "2026-06-02"), (1, None, "2026-06-03", "2026-06-05"), (2, "reversed", "None", "None"), (3, "days", "None", "None")]


def test_retention_cases(spark):
    rows = [("police", str(k), "1", d) for k, d in enumerate(["1900-01-01", "1900-01-02", "2026-05-30"])] + [("partner", "9", "1", "1900-01-03"), ("partner", "8", "1", "2026-05-30")]
    items = spark.createDataFrame(rows, "item_source_code string, atc_id string, found_sequence string, d string").withColumn("registered_on", F.to_date("d"))
    sources = spark.createDataFrame([("police", 6, True), ("partner", 6, True)], "code string, retention_months int, enabled boolean")
    gone = lambda **k: sorted(r.atc_id for r in ingest.expiry(items, sources, "2026-11-30", **k).filter("expired").collect())
    assert gone(limit=0) == []
    assert gone(limit=1, source="police") == ["0"]
    assert gone() == ["0", "1", "9"]


def test_embedding_inputs(spark):
    rows = [("블랙(검정)", "구찌 카드지갑", "검정 구찌 카드지갑"), (None, "  Nike  Air 2 ", "Nike Air 2"), ("기타", "", "기타"), ("unknown", "", "")]
    df = spark.createDataFrame(rows, "c string, n string, want string").select(scalars.embedding_input(F.col("c"), F.col("n")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def test_unicode_normalisation(spark):
    df = spark.createDataFrame([("ＡＢＣ　１ ß", "abc 1 ss", "abc1ss")], "t string, base string, key string")
    r = df.select(scalars.base_text(F.col("t")).alias("b"), scalars.match_key(F.col("t")).alias("k"), "base", "key").first()
    assert (r.b, r.k) == (r.base, r.key)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "1", "1", 5.0)], "item_source_code string, atc_id string, found_sequence string, price double").withColumn("first_seen_at", F.lit("2020-01-01").cast("timestamp")).withColumn("last_seen_at", F.col("first_seen_at"))
    new = spark.createDataFrame([("a", "1", "1", None), ("b", "2", "1", 2.0)], "item_source_code string, atc_id string, found_sequence string, price double")
    once = ingest.upsert_items(old, new, "2021-01-01")
    twice = ingest.upsert_items(once, new, "2021-01-01")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.atc_id: r.price for r in once.collect()} == {"1": None, "2": 2.0}


def test_rescore_of_all_equals_exact(spark):
    v = spark.createDataFrame([(k, 0, [float(k % 3), 1.0, float(k)]) for k in range(1, 20)], "id long, scope long, v array<double>")
    q = v.filter("id % 5 = 0").withColumnRenamed("id", "query_id")
    code = lambda d: d.withColumn("code", vectors.binarize(F.col("v"), 3))
    near = vectors.rescore(vectors.hamming_topk(code(q), code(v), 100), q, v, 0.0, 10)
    assert sorted(map(str, near.collect())) == sorted(map(str, vectors.exact_topk(q, v, 0.0, 10).select("query_id", "id", "cos", "rank").collect()))


def test_containment_and_gate(spark):
    rows = [(1, "검정 지갑"), (2, "머니클립"), (3, "무선이어폰")]
    d = terms.Dictionary.load()
    queries = search.prepared(spark.createDataFrame([(1, "지갑"), (2, "아이폰"), (3, "키")], "query_id long, text string"), d)
    items = spark.createDataFrame([(k, 7, t, t) for k, t in [*rows, (4, "갤럭시 휴대폰"), (5, "자동차 키."), (6, "키보드")]], "id long, location_id long, search_text string, name string")
    docs = items.select("id", "location_id", "search_text", F.struct(F.col("name").alias("item_name"), F.lit(None).cast("string").alias("raw_category_name"), F.lit("").alias("description")).alias("detail"))
    scope = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "query_id long, location_id long")
    index = search.indexed(docs, d)
    found = {(r.query_id, r.id) for r in search.candidates(queries, scope, index.docs, index.grams).collect()}
    assert found == {(1, 1), (1, 2), (2, 4), (3, 5)}
    scored = {(r.query_id, r.id) for r in search.lexical(queries, scope, index).collect()}
    #: A phone of another maker doesn't fit the query for an iPhone.
    assert scored == {(1, 1), (1, 2), (3, 5)}
    pool = scope.join(index.docs.select("id", "location_id"), "location_id")
    assert search.check_containment(search.lexical(queries, scope, index, pool), search.candidates(queries, scope, index.docs, index.grams)).isEmpty()


def test_radius_at_any_latitude(spark):
    """Every pair within the radius is found near the poles and across the date line."""
    import math

    import numpy as np

    rng = np.random.default_rng(6)
    spots = [(lat + float(a), (lon + float(b) + 180) % 360 - 180) for lat in (0, 45, 75, 88, -89.5, 64) for lon in (0, 179.9, -180, 90) for a, b in rng.uniform(-0.4, 0.4, (6, 2))]
    spots += [(90.0, 0.0), (-90.0, 55.0), (89.9, 170.0), (89.9, -100.0)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(spots)], "id long, latitude double, longitude double")

    def metres(a, b):
        (p, x), (q, y) = (map(math.radians, s) for s in (a, b))
        return 2 * 6_371_008.8 * math.asin(min(1, math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((y - x) / 2) ** 2)))

    for radius in (9_000.0, 60_000.0):
        got = sorted((r.query_id, r.location_id) for r in places.within_radius(points.withColumnRenamed("id", "query_id"), points, radius).select("query_id", "location_id").collect())
        assert got == sorted((a, b) for a in range(len(spots)) for b in range(len(spots)) if metres(spots[a], spots[b]) <= radius)


def test_reservation_steps():
    at = pd.Timestamp("2026-11-06 06:00")
    state = {"status": "pending", "email": "a@b.kr", "created_at": at, "expires_at": at + pd.Timedelta(days=7), "extension_count": 0}
    assert alerts.step(state, "confirm", at + pd.Timedelta(hours=25)) == state
    live = alerts.step(state, "confirm", at + pd.Timedelta(hours=1))
    assert live["status"] == "active"
    for _ in range(5):
        live = alerts.step(live, "extend", at + pd.Timedelta(hours=2))
    assert live["extension_count"] == 3
    assert alerts.step(live, "cancel", at + pd.Timedelta(days=1))["email"] is None


def test_alert_period(spark):
    r = alerts.alert_period(spark.createDataFrame([("2026-11-06 06:00:00",)], "t string").select(F.to_timestamp("t").alias("created_at"))).first()
    assert str(r.expires_at) == "2026-11-13 15:00:00" or r.expires_at == dt.datetime(2026, 11, 13, 15)
    assert (str(r.first_day), str(r.last_day)) == ("2026-11-07", "2026-11-13")


def test_import_without_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules.pop('corpus_pipeline')\nimport importlib.abc\nclass F(importlib.abc.MetaPathFinder):\n  def find_spec(self, n, p, t=None):\n    if n in ('corpus_pipeline', 'lumafind.llm'): raise ModuleNotFoundError(n, name=n)\nsys.meta_path.insert(0, F())\nimport __spark_entry__ as e\nassert 'F13_ranked_page' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1])
