"""The default judge: a search for the reservation's text, narrowed by its condition words."""

import pytest
from pyspark.sql import functions as F

from lumafind.functions import terms
from lumafind.operators import alerts, conditions, search

ITEMS = [
    (21, "반지갑", "지갑", "블랙", ""), (22, "반지갑", "지갑", "갈색", ""), (23, "반지갑", "지갑", "", ""), (24, "루이비통 장지갑", "지갑", "검정", ""), (25, "장지갑", "지갑", "흰색", "louis vuitton"),
    (26, "블랙야크 지갑", "지갑", "", ""), (27, "카드지갑", "지갑", "검정", "스누피 그림"),
    (31, "갤럭시 버즈", "무선이어폰", "흰색", ""), (32, "에어팟 프로", "무선이어폰", "흰색", "왼쪽"), (33, "에어팟 프로", "무선이어폰", "흰색", "오른쪽"), (34, "에어팟 왼쪽유닛", "무선이어폰", "", ""),
    (41, "삼성 갤럭시 S23", "휴대폰", "검정", ""), (42, "아이폰 14", "휴대폰", "검정", ""), (43, None, None, None, None),
]
WALLETS, EARPHONES = set(range(21, 28)), {31, 32, 33, 34}
CASES = {
    "지갑": WALLETS, "검정 지갑": {21, 23, 24, 26, 27}, "블랙 지갑": {21, 23, 24, 26, 27}, "검정 흰색 지갑": {21, 23, 24, 25, 26, 27}, "루이비통 지갑": {24, 25}, "검정 루이비통 지갑": {24}, "흰색 지갑": {23, 25, 26},
    "스누피 지갑": WALLETS, "에어팟 왼쪽": {32, 34}, "삼성 버즈": {31}, "아이폰": {42}, "없는말": set(),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, 7, " ".join(v for v in (n, c, k, d) if v).lower(), (n, c, d)) for i, n, c, k, d in ITEMS]
    docs = spark.createDataFrame(rows, "id long, location_id long, search_text string, detail struct<item_name: string, raw_category_name: string, description: string>")
    d = terms.Dictionary.load()
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(CASES)], "reservation_id long, text string")
    cands = asked.select("reservation_id").crossJoin(docs.select(F.col("id").alias("item_id")))
    return alerts.judge(cands, asked, search.indexed(docs, d), d).collect()


@pytest.mark.parametrize("number,query", list(enumerate(CASES)))
def test_judged(found, number, query):
    assert {r.item_id for r in found if r.reservation_id == number} == CASES[query]


def test_scores_are_positive(found):
    assert found and all(r.score > 0 for r in found)


def test_other_judges_fit_in(spark):
    cands = spark.createDataFrame([(1, 5), (1, 6)], "reservation_id long, item_id long")
    none = cands.select("reservation_id", F.lit("x").alias("text"))
    kept = alerts.judge(cands, none, None, None, lambda res, c, index, words: c.filter("item_id = 6").withColumn("score", F.lit(0.5)))
    assert [tuple(r) for r in kept.collect()] == [(1, 6, 0.5)]


def test_relations_are_closed(spark):
    d = terms.Dictionary([{"domain": "brand", "canonical": "a", "terms": ["a b"], "scope": []}, {"domain": "brand", "canonical": "c", "terms": ["d"], "scope": []}, {"domain": "attribute", "canonical": "e", "terms": [], "scope": []}], [], {})
    found = conditions.Conditions(d, {"a": ("c",), "c": ("x", "a")})
    assert {f for f, _, c in found.forms if c == "a"} == {"a", "ab", "c", "d", "x"} and not [f for f in found.forms if f[2] == "e"]
