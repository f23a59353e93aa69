"""The driver's tables as model tables. Each statement is plain SQL that both engines run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ITEMS = """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'police_api' ELSE 'partner_api' END AS item_source_code,
 concat('F', CAST(doc_id AS STRING)) AS atc_id, '1' AS found_sequence, CAST(substr(source, 4) AS BIGINT) AS storage_location_id,
 concat(lang, ' > ', source) AS raw_category_name, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS color_name,
 substr(text, 1, 24) AS item_name, text AS description, DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS registered_on,
 CASE WHEN doc_id % 11 = 0 THEN 'unmatched' WHEN doc_id % 13 = 0 THEN 'ambiguous' WHEN doc_id % 17 = 0 THEN 'excluded_overseas' ELSE 'matched' END AS status
 FROM documents"""

#: Line items as landed pages: the identity (order, line) repeats, later pages win.
LANDED = """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'police_api' ELSE 'partner_api' END AS item_source_code, CAST(l_orderkey AS STRING) AS atc_id,
 CAST(l_linenumber AS STRING) AS found_sequence, CAST(l_suppkey AS BIGINT) AS page, CAST(l_partkey AS BIGINT) AS pos, concat(l_shipmode_, ' > ', l_returnflag) AS raw_category_name,
 CAST(l_shipdate AS DATE) AS registered_on, l_extendedprice AS price, l_quantity AS quantity FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem) x"""

#: Items already stored: every third order, first seen a year before.
STORED = """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'police_api' ELSE 'partner_api' END AS item_source_code, CAST(l_orderkey AS STRING) AS atc_id,
 CAST(l_linenumber AS STRING) AS found_sequence, min(CAST(l_shipdate AS DATE)) AS registered_on, min(l_extendedprice) AS price,
 TIMESTAMP '2000-01-01 00:00:00' AS first_seen_at, TIMESTAMP '2000-01-02 00:00:00' AS last_seen_at FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1, 2, 3"""

INSTITUTIONS = """SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'police' ELSE 'partner' END AS source_code, s_name AS name,
 33 + ((s_suppkey * 37) % 570) / CAST(100 AS DOUBLE) AS latitude, 124.5 + ((s_suppkey * 53) % 750) / CAST(100 AS DOUBLE) AS longitude,
 s_suppkey % 10 <> 0 AS is_active FROM supplier"""

PLACES = """SELECT CAST(c_custkey AS BIGINT) AS query_id, CAST(p AS INT) AS position, concat(c_name, '/', CAST(p AS STRING)) AS place_name,
 33 + ((c_custkey * 41 + p * 97) % 570) / CAST(100 AS DOUBLE) AS latitude, 124.5 + ((c_custkey * 59 + p * 31) % 750) / CAST(100 AS DOUBLE) AS longitude
 FROM customer CROSS JOIN (SELECT 1 AS p UNION ALL SELECT 2 UNION ALL SELECT 3) k WHERE p <= 1 + c_custkey % 3"""



def masked_numbers(x: str) -> str:
    """Number masking for DuckDB, whose patterns look neither back nor ahead: runs of digits with single blanks or
    dashes between are masked as wholes, longer runs by their groups of digits. This is the same as long as no
    run of more than 19 digits has a number across its groups."""
    digits = "regexp_replace({0}, '[^0-9]', '', 'g')"
    cell = "length(regexp_replace(substr({0}, 1, i), '[^0-9]', '', 'g'))"
    card = f"array_to_string(list_transform(range(1, length({{0}}) + 1), lambda i: CASE WHEN substr({{0}}, i, 1) NOT IN (' ', '-') AND {cell} BETWEEN 5 AND length({digits}) - 4 THEN '*' ELSE substr({{0}}, i, 1) END), '')"
    number = f"CASE WHEN regexp_full_match({{0}}, '[0-9]{{{{6}}}}[ -]?[1-8][0-9]{{{{6}}}}') THEN '******-*******' WHEN regexp_full_match({{0}}, '01[016789][ -]?[0-9]{{{{3,4}}}}[ -]?[0-9]{{{{4}}}}') THEN substr({{0}}, 1, 3) || '-****-' || right({{0}}, 4) WHEN length({digits}) BETWEEN 13 AND 19 THEN {card} ELSE {{0}} END"
    groups = f"array_to_string(list_transform(string_split(p, ' '), lambda g: {number.format('g')}), ' ')"
    one = f"CASE WHEN NOT regexp_matches(p, '^[0-9]') THEN p WHEN length({digits.format('p')}) > 19 THEN {groups} ELSE {number.format('p')} END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[0-9]+(?:[ -][0-9]+)*|[^0-9]+'), lambda p: {one}), '')"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def frame(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A statement over the driver's tables."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in statement}
    statement = statement.replace("{", "{{").replace("}", "}}")
    for t in used:
        statement = statement.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(statement, **used)
