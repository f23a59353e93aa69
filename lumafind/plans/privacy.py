"""Queries of masking. SQL twins restate a rule for the inputs at hand; name rules are held to golden cases in
the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masks as M
from ..operators import privacy as P
from ..operators.ingest import search_text as ingest_search_text
from .adapt import ITEMS, frame, masked_numbers, tables
from .registry import query

#: Phone book rows: each customer's number written as a registration, mobile or card number beside a name.
NUMBER = "lpad(CAST(c_custkey * 7919 % 1000000 AS STRING), 6, '0')"
TEXT = f"concat('id ', {NUMBER}, '-', CAST(1 + c_custkey % 9 AS STRING), {NUMBER}, ' tel 010-', substr({NUMBER}, 1, 4), '-', substr({NUMBER}, 3, 4), ' card ', substr({NUMBER}, 1, 4), '-1234-5678-', substr({NUMBER}, 2, 4), ' (홍길동) 성명: 김민수')"
ROWS = f"SELECT CAST(c_custkey AS BIGINT) AS id, {TEXT} AS description, CASE WHEN c_custkey % 3 = 0 THEN '지갑 > x' ELSE '가방 > y' END AS raw_category_name, c_mktsegment AS source FROM customer"
DASHED = r"regexp_replace({0}, '[0-9]{{6}}-[1-8][0-9]{{6}}', '******-*******', 'g')"
TEL = r"regexp_replace({0}, '(010)-[0-9]{{4}}-([0-9]{{4}})', '\1-****-\2', 'g')"
CARD = r"regexp_replace({0}, '([0-9]{{4}})-1234-5678-([0-9]{{4}})', '\1-****-****-\2', 'g')"
NINE = r"regexp_replace({0}, '([0-9]{{4}})[0-9]{{2}}-9[0-9]{{2}}([0-9]{{4}})', '\1**-***\2', 'g')"
NUMBERS = CARD.format(TEL.format(NINE.format(DASHED.format("{0}"))))
MASKED = "replace(replace(" + NUMBERS.replace("{0}", "description") + ", '김민수', '김*수'), '(홍길동)', CASE WHEN raw_category_name LIKE '지갑%' THEN '(홍*동)' ELSE '(홍길동)' END)"


def rows(spark, sf):
    return frame(spark, sf, ROWS)


@query("H1_mask_registration", f"SELECT id, {DASHED.format('description')} AS t FROM ({ROWS}) x")
def mask_registration(spark, sf):
    return rows(spark, sf).select("id", M.mask_registration(F.col("description")).alias("t"))


@query("H2_mask_mobile", f"SELECT id, {TEL.format('description')} AS t FROM ({ROWS}) x")
def mask_mobile(spark, sf):
    return rows(spark, sf).select("id", M.mask_mobile(F.col("description")).alias("t"))


@query("H3_mask_card", r"SELECT c_custkey AS id, concat('card ', substr(n, 1, 4), '********', substr(n, 3, 4), '.') AS t FROM (SELECT c_custkey, " + NUMBER + " AS n FROM customer) x")
def mask_card(spark, sf):
    (c,) = tables(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), M.mask_card(F.expr(f"concat('card ', substr({NUMBER}, 1, 4), '12345678', substr({NUMBER}, 3, 4), '.')")).alias("t"))


@query("H4_mask_owner", "SELECT c_custkey AS id, concat(CASE c_custkey % 4 WHEN 0 THEN '홍*동' WHEN 1 THEN '김*' WHEN 2 THEN '법인' ELSE '남**수' END, ' 명의 ', c_name) AS t FROM customer")
def mask_owner(spark, sf):
    (c,) = tables(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), M.mask_owner(F.expr("concat(CASE c_custkey % 4 WHEN 0 THEN '홍길동' WHEN 1 THEN '김민' WHEN 2 THEN '법인' ELSE '남궁민수' END, ' 명의 ', c_name)")).alias("t"))


@query("H5_mask_labelled", "SELECT c_custkey AS id, concat(CASE c_custkey % 3 WHEN 0 THEN '성명: 홍*동' WHEN 1 THEN '이름 김*' ELSE '이름 없음' END, ' ', c_name) AS t FROM customer")
def mask_labelled(spark, sf):
    (c,) = tables(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), M.mask_labelled(F.expr("concat(CASE c_custkey % 3 WHEN 0 THEN '성명: 홍길동' WHEN 1 THEN '이름 김민' ELSE '이름 없음' END, ' ', c_name)")).alias("t"))


@query("H6_mask_bracketed", "SELECT c_custkey AS id, concat(CASE c_custkey % 4 WHEN 0 THEN '(홍*동)' WHEN 1 THEN '[학생증]' WHEN 2 THEN '(남**수)' ELSE '(홍길동수)' END, c_name) AS t FROM customer")
def mask_bracketed(spark, sf):
    (c,) = tables(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), M.mask_bracketed(F.expr("concat(CASE c_custkey % 4 WHEN 0 THEN '(홍길동)' WHEN 1 THEN '[학생증]' WHEN 2 THEN '(남궁민수)' ELSE '(홍길동수)' END, c_name)")).alias("t"))


@query("H7_mask_text", f"SELECT id, {MASKED} AS t FROM ({ROWS}) x")
def mask_text(spark, sf):
    return rows(spark, sf).select("id", M.mask_text(F.col("description"), P.is_high_risk(F.col("raw_category_name"))).alias("t"))


#: The four texts that leave the system; category and colour stay as they are.
FOUR = "id, description AS item_name, description, description AS normalized_search_text, description AS search_text, raw_category_name, description AS color_name"


@query("H8_mask_table", f"SELECT id, {MASKED} AS item_name, {MASKED} AS description, {MASKED} AS normalized_search_text, {MASKED} AS search_text, raw_category_name, description AS color_name FROM ({ROWS}) x")
def mask_table(spark, sf):
    return P.mask_table(rows(spark, sf).selectExpr(*FOUR.split(", ")))


@query("H9_needs_masking", "SELECT count(*) AS scanned, count(*) FILTER (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AS to_mask FROM customer")
def needs_masking(spark, sf):
    stored = rows(spark, sf).selectExpr("raw_category_name", "if(id % 2 = 0, description, 'none') AS item_name", "if(id % 3 = 0, description, 'none') AS search_text", "description AS color_name")
    return P.needs_masking(stored)


@query("H10_has_identifier", "SELECT c_custkey AS id, c_custkey % 4 <> 3 AS found FROM customer")
def has_identifier(spark, sf):
    (c,) = tables(spark, sf, "customer")
    text = F.expr(f"CASE c_custkey % 4 WHEN 0 THEN concat('x 900101-1', {NUMBER}) WHEN 1 THEN concat('01012', {NUMBER}) WHEN 2 THEN concat('123456 789012 ', {NUMBER}) ELSE concat('no ', {NUMBER}) END")
    return c.select(F.col("c_custkey").alias("id"), M.has_identifier(text).alias("found"))


@query("H11_remask", "SELECT count(*) AS scanned, count(*) FILTER (c_custkey % 5 = 0) AS changed, CAST(max(c_custkey) AS BIGINT) AS last_id FROM customer")
def remask(spark, sf):
    stored = rows(spark, sf).withColumn("description", F.when(F.col("id") % 5 == 0, F.col("description")).otherwise("clean"))
    return P.remask(stored, "description", "id")[1]


@query("H12_reembed_plan", "SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 2 = 0 THEN '검정 (홍*동)' ELSE '성명: 김*수' END AS masked FROM customer WHERE c_custkey % 7 = 0 AND (c_custkey % 2 = 1 OR c_custkey % 3 <> 1)")
def reembed_plan(spark, sf):
    (c,) = tables(spark, sf, "customer")
    v = c.select(F.col("c_custkey").cast("long").alias("id"), F.expr("if(c_custkey % 2 = 0, '검정 (홍길동)', '성명: 김민수')").alias("embedded_input"), F.lit(2).alias("input_version"), F.lit(True).alias("is_current"), F.expr("if(c_custkey % 7 = 0, timestamp '2024-01-01', timestamp '2025-01-01')").alias("embedded_at"))
    items = v.filter("id % 3 <> 2").select("id", F.expr("if(id % 3 = 0, '지갑', '가방')").alias("raw_category_name"))
    return P.reembed_plan(v, items, "2024-06-01", 2).select("id", "masked")


@query("H13_masking_report", "SELECT c_mktsegment AS source, count(*) AS n_rows, count(*) FILTER (c_custkey % 9 < 8) AS registration, count(*) AS mobile, count(*) AS card, 0::BIGINT AS owner, count(*) AS labelled, count(*) AS bracketed FROM customer GROUP BY ROLLUP (c_mktsegment)")
def masking_report(spark, sf):
    return P.masking_report(rows(spark, sf), "description", "source")


SEARCH = masked_numbers(r"trim(regexp_replace(concat_ws(' ', item_name, description, color_name, raw_category_name), '\s+', ' ', 'g'))")


@query("B11_search_text", f"WITH i AS ({ITEMS}) SELECT id, length(t) AS n, md5(t) AS digest FROM (SELECT id, {SEARCH} AS t FROM i) x")
def search_text(spark, sf):
    items = frame(spark, sf, ITEMS)
    rows = items.select("id", ingest_search_text(items).alias("t"))
    return rows.select("id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))
