"""Queries of sources, normalisation and ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ingest as I
from ..sources import pages as P
from ..functions.masks import mask_numbers
from ..sources.staged import shared_dir, staged

from .adapt import INSTITUTIONS, ITEMS, LANDED, STORED, frame, tables
from .registry import query

KEY = "item_source_code, atc_id, found_sequence"
SOURCES = "SELECT 'police_api' AS code, 6 AS retention_months, true AS enabled UNION ALL SELECT 'partner_api' AS code, 12 AS retention_months, true AS enabled"
TODAY = "1998-06-30"


def shared(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("A1_read_item_pages", """SELECT CAST(doc_id AS STRING) AS atcId, concat(lang, ' > ', source) AS prdtClNm, concat('page-', doc_id // 50) AS page_name, length(text) AS n, md5(trim(text)) AS digest FROM documents WHERE (doc_id // 50) % 10 <> 9""")
def read_item_pages(spark, sf):
    (docs,) = tables(spark, sf, "documents")
    xml = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    item = F.concat(F.lit("<item><atcId> "), F.col("doc_id").cast("string"), F.lit(" </atcId><prdtClNm>"), F.concat_ws(" > ", "lang", "source"), F.lit("</prdtClNm><fdPrdtNm>page-"), F.expr("doc_id div 50"), F.lit("</fdPrdtNm><fdSn>"), F.length("text"), F.lit("</fdSn><fdSbjt>"), xml(F.col("text")), F.lit("</fdSbjt></item>"))
    page = docs.select(F.expr("doc_id div 50").alias("page"), item.alias("item")).groupBy("page").agg(F.concat_ws("", F.collect_list("item")).alias("items"))
    body = F.concat(F.lit("<response><header><resultCode>"), F.when(F.col("page") % 10 == 9, "99").otherwise("00"), F.lit("</resultCode></header><body><items>"), F.col("items"), F.lit("</items></body></response>"))
    out = shared(spark, "pages")
    page.select(body.alias("value")).repartition(F.xxhash64("value")).write.option("maxRecordsPerFile", 1).text(out)
    return P.read_item_pages(spark, out).select("atcId", "prdtClNm", F.col("fdPrdtNm").alias("page_name"), F.col("fdSn").cast("int").alias("n"), F.md5(F.col("fdSbjt").cast("binary")).alias("digest"))


@query("A2_page_completeness", "SELECT l_suppkey, count(*) AS fetched, count(DISTINCT (l_orderkey, l_linenumber)) AS identities, max(l_partkey % 700) AS declared, count(*) >= max(l_partkey % 700) AS complete FROM lineitem GROUP BY 1")
def page_completeness(spark, sf):
    (lines,) = tables(spark, sf, "lineitem")
    return I.page_completeness(lines.withColumn("total", F.col("l_partkey") % 700), ["l_suppkey"], ["l_orderkey", "l_linenumber"], "total")


ORDER = "registered_on DESC, price DESC, quantity DESC, page DESC, pos DESC, atc_id DESC, found_sequence DESC"


def ordering():
    return [F.desc(c.split()[0]) for c in ORDER.split(", ")]


@query("A3_latest_unique", f"WITH landed AS ({LANDED}), u AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY {ORDER}) AS r FROM landed) SELECT {KEY}, registered_on, price FROM u WHERE r = 1 ORDER BY {ORDER} LIMIT 500")
def latest_unique(spark, sf):
    return I.latest_unique(frame(spark, sf, LANDED), I.KEYS, 500, *ordering()).select(*I.KEYS, "registered_on", "price")


@query("A4_write_jsonl", "SELECT doc_id, lang, text FROM documents")
def write_jsonl(spark, sf):
    (docs,) = tables(spark, sf, "documents")
    P.write_jsonl(docs.select("doc_id", "lang", "text"), out := shared(spark, "jsonl"))
    return spark.read.schema("doc_id long, lang string, text string").json(out)


@query("A5_write_csv", f"WITH items AS ({ITEMS}) SELECT {KEY}, raw_category_name, color_name, item_name, CAST(registered_on AS STRING) AS registered_on FROM items")
def write_csv(spark, sf):
    P.write_csv(I.to_item_rows(frame(spark, sf, ITEMS)), out := shared(spark, "csv"))
    return P.read_csv(spark, out).select(*I.KEYS, "raw_category_name", "color_name", "item_name", "registered_on")


@query("A6_tables", f"WITH items AS ({ITEMS}) SELECT id, registered_on, status, strftime(registered_on, '%Y-%m') AS month FROM items WHERE registered_on >= DATE '2024-03-01'")
def table_io(spark, sf):
    P.write_table(frame(spark, sf, ITEMS), out := shared(spark, "items"), "registered_on")
    return P.read_table(spark, out).filter("month >= '2024-03'").select("id", "registered_on", "status", F.col("month").cast("string").alias("month"))


@query("A7_load_dictionaries", "SELECT 'kind' AS source, p_type AS name, p_name AS term, false AS hint, '' AS scope FROM part GROUP BY ALL UNION ALL SELECT 'kind', p_type, p_brand, true, '' FROM part GROUP BY ALL UNION ALL SELECT 'synonym', p_brand, p_name, false, p_type FROM (SELECT p_brand, p_name, min(p_type) AS p_type FROM part GROUP BY ALL) x UNION ALL SELECT 'excluded', 'word', p_name, false, '' FROM part GROUP BY ALL")
def load_dictionaries(spark, sf):
    """Dictionaries written from the parts' names, as JSON documents, and loaded as flat tables."""
    (p,) = tables(spark, sf, "part")
    listed = lambda c: F.array_sort(F.collect_set(c))
    kinds = p.groupBy(F.col("p_type").alias("name")).agg(F.array().cast("array<string>").alias("categories"), listed("p_name").alias("terms"), listed("p_brand").alias("brands"))
    whole = kinds.agg(F.collect_list(F.struct("name", "categories", "terms")).alias("kinds"), F.map_from_entries(F.collect_list(F.struct("name", "brands"))).alias("hints"))
    named = p.groupBy("p_brand", "p_name").agg(F.min("p_type").alias("p_type"))
    concepts = named.agg(F.collect_list(F.struct(F.lit("item").alias("domain"), F.col("p_brand").alias("canonical"), F.array("p_name").alias("terms"), F.array("p_type").alias("scope"))).alias("concepts"))
    words = p.agg(F.map_from_arrays(F.array(F.lit("word")), F.array(listed("p_name"))).alias("exclusions"))
    paths = {}
    for name, df in (("kinds", whole), ("concepts", concepts), ("exclusions", words)):
        paths[name] = shared(spark, name)
        df.write.json(paths[name])
    kind = P.load_kinds(spark, paths["kinds"]).select(F.lit("kind").alias("source"), F.col("kind").alias("name"), "term", "hint", F.lit("").alias("scope"))
    synonym = P.load_synonyms(spark, paths["concepts"]).select(F.lit("synonym").alias("source"), F.col("canonical").alias("name"), "term", F.lit(False).alias("hint"), F.array_join("scope", ",").alias("scope"))
    excluded = P.load_exclusions(spark, paths["exclusions"]).select(F.lit("excluded").alias("source"), F.col("list").alias("name"), "term", F.lit(False).alias("hint"), F.lit("").alias("scope"))
    return kind.union(synonym).union(excluded)


@query("A8_apply_reviewed", f"WITH i AS ({INSTITUTIONS}), r AS (SELECT id + 5 AS id, concat(name, CASE WHEN id % 3 = 0 THEN 'x' ELSE '' END) AS name FROM i) SELECT r.id, r.name, CASE WHEN i.id IS NULL THEN 'insert' ELSE 'conflict' END AS kind FROM r LEFT JOIN i USING (id) WHERE i.id IS NULL OR i.name <> r.name")
def apply_reviewed(spark, sf):
    old = frame(spark, sf, INSTITUTIONS).select("id", "name")
    new = old.select((F.col("id") + 5).alias("id"), F.concat("name", F.expr("if(id % 3 = 0, 'x', '')")).alias("name"))
    inserts, conflicts = I.apply_reviewed(old, new, ["id"], "name")
    return inserts.select("id", "name", F.lit("insert").alias("kind")).union(conflicts.select("id", "name", F.lit("conflict").alias("kind")))


SOURCE_TEXT = "concat('  ', p_name, '  [', p_brand, '] (', p_type, ') ')"


def part(spark, sf, *columns):
    (p,) = tables(spark, sf, "part")
    return p.withColumn("t", F.expr(SOURCE_TEXT)).select(F.col("p_partkey").alias("id"), *columns)


@query("B1_norm_text", f"SELECT p_partkey AS id, trim(regexp_replace({SOURCE_TEXT}, '\\s+', ' ', 'g')) AS t FROM part")
def norm_text(spark, sf):
    return part(spark, sf, S.norm_text(F.col("t")).alias("t"))


@query("B2_base_text", f"SELECT p_partkey AS id, trim(regexp_replace(lower({SOURCE_TEXT}), '[^a-z0-9]+', ' ', 'g')) AS t FROM part")
def base_text(spark, sf):
    return part(spark, sf, S.base_text(F.col("t")).alias("t"))


@query("B3_match_key", f"SELECT p_partkey AS id, regexp_replace(lower({SOURCE_TEXT}), '[^a-z0-9]+', '', 'g') AS t FROM part")
def match_key(spark, sf):
    return part(spark, sf, S.match_key(F.col("t")).alias("t"))


@query("B4_base_name", "SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS t FROM part")
def base_name(spark, sf):
    return part(spark, sf, S.base_name(F.col("t")).alias("t"))


@query("B5_category_path", "SELECT doc_id, lang AS parent, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS child FROM documents")
def category_path(spark, sf):
    (docs,) = tables(spark, sf, "documents")
    raw = F.expr("if(doc_id % 5 = 0, if(doc_id % 2 = 0, lang, concat(lang, ' > ')), concat(lang, if(doc_id % 3 = 0, '＞', ' > '), source))")
    return docs.select("doc_id", S.category_parent(raw).alias("parent"), S.category_child(raw).alias("child"))


@query("B6_classify", "SELECT c_custkey, n_name || ' > x' AS raw_category_name, CASE WHEN n_regionkey < 3 THEN CAST(n_nationkey AS BIGINT) END AS category_code FROM customer JOIN nation ON c_nationkey = n_nationkey")
def classify(spark, sf):
    customer, nation = tables(spark, sf, "customer", "nation")
    rows = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("n_name", F.lit(" > x")).alias("raw_category_name"))
    known = nation.filter("n_regionkey < 3").select(F.lower("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("code"))
    return I.classify(rows, known)


@query("B7_resolve_category", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN CAST(100 + CAST(substr(source, 4) AS INT) AS BIGINT) WHEN lang IN ('en', 'de') THEN CASE lang WHEN 'en' THEN 1 ELSE 2 END ELSE 9 END AS category_id, CASE WHEN source IN ('src1', 'src2') THEN 'pair' WHEN lang IN ('en', 'de') THEN 'parent' ELSE 'fallback' END AS by FROM documents")
def resolve_category(spark, sf):
    (docs,) = tables(spark, sf, "documents")
    rows = docs.select("doc_id", F.concat_ws(" > ", "lang", "source").alias("raw_category_name"))
    pairs = docs.filter("source in ('src1', 'src2')").select(F.concat_ws(" > ", "lang", "source").alias("raw_name"), F.expr("100L + cast(substr(source, 4) as int)").alias("category_id")).distinct()
    parents = spark.sql("SELECT * FROM VALUES (1L, 'en', 'en'), (2L, 'de', 'de'), (9L, 'etc', 'rest') AS t(id, name, code)").replace("rest", "etc", ["code"])
    return I.resolve_category(rows, pairs, parents).drop("raw_category_name")


@query("B8_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def parse_date(spark, sf):
    (orders,) = tables(spark, sf, "orders")
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 2 THEN concat(' ', date_format(o_orderdate, 'yyyyMMdd'), ' ') ELSE concat(date_format(o_orderdate, 'yyyy'), '0230') END")
    return orders.select("o_orderkey", S.parse_date(text).alias("day"))


@query("B9_validate_items", "SELECT CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 'invalid' WHEN CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' THEN 'outside' ELSE 'valid' END AS reject, count(*) AS n FROM orders GROUP BY 1")
def validate_items(spark, sf):
    (orders,) = tables(spark, sf, "orders")
    rows = orders.select(F.expr("if(o_orderkey % 7 = 0, '  ', cast(o_orderkey as string))").alias("atc_id"), F.expr("if(o_orderkey % 11 = 0, null, o_orderpriority)").alias("raw_category_name"), F.lit("").alias("found_sequence"), F.date_format("o_orderdate", "yyyyMMdd").alias("registered_text"))
    return I.validate_items(rows, "1996-01-01", "1997-12-31").groupBy(F.coalesce("reject", F.lit("valid")).alias("reject")).agg(F.count("*").alias("n"))


@query("B10_item_rows", f"WITH items AS ({ITEMS}) SELECT atc_id, CAST(registered_on AS STRING) AS registered_on, color_name, CAST(id AS STRING) AS payload_id FROM items")
def item_rows(spark, sf):
    return I.to_item_rows(frame(spark, sf, ITEMS)).select("atc_id", "registered_on", "color_name", F.get_json_object("raw_payload", "$.id").alias("payload_id"))


@query("B12_embedding_input", r"SELECT p_partkey AS id, trim(concat(CASE p_partkey % 4 WHEN 0 THEN '검정 ' WHEN 1 THEN '기타 ' ELSE '' END, trim(regexp_replace(p_name, '\s+', ' ', 'g')))) AS t FROM part")
def embedding_input(spark, sf):
    (p,) = tables(spark, sf, "part")
    color = F.expr("CASE p_partkey % 4 WHEN 0 THEN '블랙(검정)' WHEN 1 THEN '기타' WHEN 2 THEN 'black' END")
    return p.select(F.col("p_partkey").alias("id"), S.embedding_input(color, F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("t"))


@query("B13_embedding_input_v1", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS t FROM part")
def embedding_input_v1(spark, sf):
    (p,) = tables(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), S.embedding_input_v1(F.expr("if(p_partkey % 2 = 0, concat(' ', p_type), '  ')"), F.col("p_name")).alias("t"))


@query("B14_is_overseas", "SELECT s_suppkey, s_suppkey % 6 = 0 AS overseas FROM supplier")
def is_overseas(spark, sf):
    (s,) = tables(spark, sf, "supplier")
    name = F.expr("if(s_suppkey % 3 = 0, '주 덴마크 대사관', s_name)")
    return s.select("s_suppkey", S.is_overseas(F.expr("if(s_suppkey % 2 = 0, 'partner_api', 'police_api')"), name).alias("overseas"))


@query("B15_retention_start", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 6 MONTH AS DATE) AS start FROM orders")
def retention_start(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return o.select("o_orderkey", S.retention_start(F.col("o_orderdate").cast("date"), F.lit(6)).alias("start"))


@query("B16_plan_windows", f"WITH stored AS ({STORED}), src AS ({SOURCES}), n AS (SELECT item_source_code AS code, max(registered_on) AS newest FROM stored GROUP BY 1), f AS (SELECT code, CAST(DATE '{TODAY}' - to_months(retention_months) AS DATE) AS floor FROM src) SELECT code, greatest(floor, least(coalesce(newest, floor), DATE '{TODAY}' - 1)) AS start, DATE '{TODAY}' AS \"end\" FROM f LEFT JOIN n USING (code)")
def plan_windows(spark, sf):
    return I.plan_windows(spark.sql(SOURCES), frame(spark, sf, STORED), TODAY)


@query("B17_backfill_windows", f"WITH q AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) - 2 AS b, CAST(o_orderkey % 33 AS INT) AS days FROM orders), e AS (SELECT *, CASE WHEN days NOT BETWEEN 1 AND 31 THEN 'days' WHEN a > b THEN 'reversed' WHEN a < DATE '1996-01-01' THEN 'before retention' WHEN b > DATE '2000-01-01' THEN 'future' END AS error FROM q), w AS (SELECT id, error, b, days, unnest(CASE WHEN error IS NULL THEN generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), to_days(days)) ELSE [CAST(a AS TIMESTAMP)] END) AS s FROM e) SELECT id, error, CASE WHEN error IS NULL THEN CAST(s AS DATE) END AS window_start, CASE WHEN error IS NULL THEN least(b, CAST(s AS DATE) + days - 1) END AS window_end FROM w")
def backfill_windows(spark, sf):
    (o,) = tables(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    requests = o.select(F.col("o_orderkey").alias("id"), day.alias("start"), F.date_add(day, (F.col("o_orderkey") % 40 - 2).cast("int")).alias("end"), (F.col("o_orderkey") % 33).cast("int").alias("days"), F.lit("1996-01-01").cast("date").alias("floor"))
    return I.backfill_windows(requests, "2000-01-01")


@query("B18_has_photo", "SELECT page_id, page_id % 3 = 1 OR (page_id % 3 = 2 AND regexp_matches(url, '[?#]')) AS photo FROM pages")
def has_photo(spark, sf):
    (p,) = tables(spark, sf, "pages")
    return p.select("page_id", S.has_photo(F.expr("CASE page_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN concat(url, '.jpg') ELSE concat(url, '/img02_no_img.gif') END")).alias("photo"))


#: Categories by part size, with every parent and child that has a class of its own, and others.
RAW = "CASE p_size % 10 WHEN 0 THEN '가방 > ' WHEN 1 THEN '지갑 > 모자' WHEN 2 THEN ' 휴대폰' WHEN 3 THEN '카드 > x > y' WHEN 4 THEN '의류 > 모자' WHEN 5 THEN '의류 > 신발' WHEN 6 THEN '전자기기>무선이어폰' WHEN 7 THEN '전자기기 > 태블릿' WHEN 8 THEN concat(p_type, ' > ', p_brand) END"


@query("B19_category_class", "SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'bag' WHEN 1 THEN 'wallet' WHEN 2 THEN 'phone' WHEN 3 THEN 'card' WHEN 4 THEN 'cap' WHEN 6 THEN 'buds' ELSE 'box' END AS class FROM part")
def category_class(spark, sf):
    (p,) = tables(spark, sf, "part")
    return p.select("p_partkey", S.category_class(F.expr(RAW)).alias("class"))


@query("B20_normalize_places", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name, c_mktsegment AS address, CAST(c_custkey % 100 AS DOUBLE) AS latitude, CAST(c_custkey % 200 AS DOUBLE) AS longitude FROM customer WHERE c_custkey % 100 <= 90 AND c_custkey % 200 <= 180")
def normalize_places(spark, sf):
    from ..operators.places import normalize_places as op

    (c,) = tables(spark, sf, "customer")
    raw = c.select(F.col("c_custkey").alias("id"), F.expr("if(c_custkey % 3 = 0, ' ', c_name)").alias("name"), F.lit("").alias("road_address"), F.expr("if(c_custkey % 2 = 0, c_mktsegment, null)").alias("address1"), F.col("c_mktsegment").alias("address2"), F.lit("z").alias("address3"), F.expr("cast(c_custkey % 100 as string)").alias("latitude"), F.expr("cast(c_custkey % 200 as string)").alias("longitude"))
    return op(raw, ["road_address", "address1", "address2", "address3"])


@query("B21_valid_institutions", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'police' ELSE 'partner' END AS display_group, CASE WHEN s_suppkey % 2 = 0 THEN 'station' END AS label FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0")
def valid_institutions(spark, sf):
    from ..operators.places import valid_institutions as op

    (s,) = tables(spark, sf, "supplier")
    raw = s.select(F.col("s_suppkey").alias("id"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'none' WHEN s_suppkey % 2 = 0 THEN 'police' ELSE 'partner' END").alias("display_group"), F.expr("if(s_suppkey % 7 = 0, '99', '36.5')").alias("latitude"), F.lit("127").alias("longitude"), F.lit("3").alias("item_count"))
    return op(raw, "station").select("id", "display_group", "label")


@query("B22_validate_scope", "SELECT c_nationkey AS query_id, count(DISTINCT c_custkey % 90) FILTER (c_custkey % 90 > 0) AS n, count(DISTINCT c_custkey % 90) FILTER (c_custkey % 90 > 0) BETWEEN 1 AND 40 AS valid FROM customer GROUP BY 1")
def validate_scope(spark, sf):
    from ..operators.places import validate_scope as op

    (c,) = tables(spark, sf, "customer")
    return op(c.select(F.col("c_nationkey").alias("query_id"), (F.col("c_custkey") % 90).alias("location_id")), 40)


@query("B23_kind_mask", "SELECT doc_id, CAST(CASE WHEN contains(text, 'the') OR contains(text, 'der') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'tion') THEN 2 ELSE 0 END + CASE WHEN contains(text, 'token') THEN 4 ELSE 0 END AS INT) AS mask FROM documents WHERE contains(text, 'tion') OR contains(text, 'token')")
def kind_mask(spark, sf):
    (d,) = tables(spark, sf, "documents")
    return d.select("doc_id", S.kind_mask(F.col("text"), [["the", "der"], ["tion"], ["token"]]).alias("mask")).filter(F.col("mask").bitwiseAND(F.lit(6)) != 0)


LAST = "page DESC, pos DESC, registered_on DESC, price DESC, quantity DESC"
DEDUPED = f"SELECT {KEY}, registered_on, price FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY {LAST}) AS r FROM landed) x WHERE r = 1"


def deduped(spark, sf):
    return I.dedupe_items(frame(spark, sf, LANDED), I.KEYS, F.desc("registered_on"), F.desc("price"), F.desc("quantity")).select(*I.KEYS, "registered_on", "price")


@query("C1_dedupe_items", f"WITH landed AS ({LANDED}) {DEDUPED}")
def dedupe_items(spark, sf):
    return deduped(spark, sf)


@query("C2_split_new", f"WITH landed AS ({LANDED}), d AS ({DEDUPED}), s AS ({STORED}) SELECT d.*, s.atc_id IS NULL AS is_new FROM d LEFT JOIN s USING ({KEY})")
def split_new(spark, sf):
    return I.split_new(deduped(spark, sf), frame(spark, sf, STORED))


@query("C3_upsert_items", f"WITH landed AS ({LANDED}), d AS ({DEDUPED}), s AS ({STORED}) SELECT {KEY}, coalesce(d.registered_on, s.registered_on) AS registered_on, coalesce(d.price, s.price) AS price, coalesce(s.first_seen_at, TIMESTAMP '2001-01-01 00:00:00') AS first_seen_at, CASE WHEN d.price IS NOT NULL THEN TIMESTAMP '2001-01-01 00:00:00' ELSE s.last_seen_at END AS last_seen_at FROM d FULL OUTER JOIN s USING ({KEY})")
def upsert_items(spark, sf):
    incoming = deduped(spark, sf)
    old = frame(spark, sf, STORED).withColumns({c: F.col(c).cast("timestamp") for c in ("first_seen_at", "last_seen_at")})
    return I.upsert_items(old, incoming, "2001-01-01 00:00:00")


@query("C3_merge_buckets", f"WITH landed AS ({LANDED}), d AS ({DEDUPED}), s AS ({STORED}) SELECT {KEY}, coalesce(d.registered_on, s.registered_on) AS registered_on, coalesce(d.price, s.price) AS price, coalesce(s.first_seen_at, TIMESTAMP '2001-01-01 00:00:00') AS first_seen_at, CASE WHEN d.price IS NOT NULL THEN TIMESTAMP '2001-01-01 00:00:00' ELSE s.last_seen_at END AS last_seen_at FROM d FULL OUTER JOIN s USING ({KEY})")
def merge_buckets(spark, sf):
    """The same upsert into a bucketed table, in place."""
    old = frame(spark, sf, STORED).withColumns({c: F.col(c).cast("timestamp") for c in ("first_seen_at", "last_seen_at")})
    path = shared(spark, "items")
    I.write_buckets(old, path, 16)
    I.merge_buckets(spark, path, deduped(spark, sf), "2001-01-01 00:00:00", 16)
    return I.read_buckets(spark, path)


#: The last line of an order as the row before, the first one as what came in: places are suppliers' parities, checks are
#: ship dates, details are what the lines say of themselves.
DETAILED = """SELECT o_orderkey AS id, CASE WHEN a.l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS place, CASE WHEN b.l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS old_place, a.l_shipdate AS checked_at, b.l_shipdate AS old_checked_at,
 nullif(a.l_returnflag, 'N') AS detail_org, nullif(b.l_returnflag, 'A') AS old_detail_org, nullif(a.l_linestatus, 'F') AS detail_department, b.l_linestatus AS old_detail_department, CASE WHEN a.l_discount > 0.05 THEN 'cheap' END AS detail_status, 'full' AS old_detail_status,
 CASE WHEN a.l_tax > 0.04 THEN CAST(a.l_suppkey AS STRING) END AS detail_place, CAST(b.l_suppkey AS STRING) AS old_detail_place, CASE WHEN a.l_quantity > 25 THEN CAST(a.l_partkey AS STRING) END AS detail_phone, CAST(b.l_partkey AS STRING) AS old_detail_phone, CAST(NULL AS STRING) AS detail_note, b.l_returnflag AS old_detail_note
 FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) a ON a.l_orderkey = o_orderkey AND a.k = 1
 JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) b ON b.l_orderkey = o_orderkey AND b.k = 1"""


@query("C4_carry_detail", f"SELECT id, {', '.join(f'CASE WHEN place = old_place THEN coalesce({c}, old_{c}) WHEN checked_at > old_checked_at THEN {c} END AS {c}' for c in [*I.DETAIL, 'checked_at'])} FROM ({DETAILED}) x")
def carry_detail(spark, sf):
    rows = frame(spark, sf, DETAILED).withColumns({c: F.col(c).cast("timestamp") for c in ("checked_at", "old_checked_at")})
    return I.carry_detail(rows).select("id", *I.DETAIL, "checked_at")


@query("C5_finalize_status", f"WITH items AS ({ITEMS}) SELECT item_source_code AS source, count(*) AS rows, count(*) FILTER (status IN ('ambiguous', 'unmatched')) AS unmatched, count(*) FILTER (status = 'excluded_overseas') AS overseas, count(*) FILTER (status = 'matched') AS matched FROM items GROUP BY 1")
def finalize_status(spark, sf):
    """What the audit counted while the rows were written, beside a count of what was written."""
    audit = I.Audit(["police_api", "partner_api"])
    done = staged(I.finalize_status(frame(spark, sf, ITEMS), audit).select("item_source_code", "status"), "final")
    kept = done.groupBy(F.col("item_source_code").alias("source")).agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "matched").alias("matched"))
    return audit.rows(spark).select("source", "unmatched", "overseas").join(kept, "source")


@query("C6_insert_missing", f"WITH landed AS ({LANDED}), d AS ({DEDUPED}), s AS ({STORED}) SELECT d.* FROM d ANTI JOIN s USING ({KEY})")
def insert_missing(spark, sf):
    return I.insert_missing(frame(spark, sf, STORED), deduped(spark, sf))


@query("C7_expire_items", f"WITH s AS ({STORED}), src AS ({SOURCES}), due AS (SELECT s.*, row_number() OVER (ORDER BY registered_on, {KEY}) AS r FROM s JOIN src ON code = item_source_code WHERE registered_on < CAST(DATE '{TODAY}' - to_months(retention_months) AS DATE)) SELECT {KEY}, registered_on, coalesce(r <= 1000, false) AS expired FROM s LEFT JOIN due USING ({KEY}, registered_on)")
def expire_items(spark, sf):
    return I.expiry(frame(spark, sf, STORED), spark.sql(SOURCES), TODAY, 1000).select(*I.KEYS, "registered_on", "expired")


@query("C7_expiry_counts", f"WITH s AS ({STORED}), src AS ({SOURCES} UNION ALL SELECT 'other' AS code, 6 AS retention_months, true AS enabled), due AS (SELECT item_source_code, row_number() OVER (ORDER BY registered_on, {KEY}) AS r FROM s JOIN src ON code = item_source_code WHERE registered_on < CAST(DATE '{TODAY}' - to_months(retention_months) AS DATE)) SELECT code, count(r) AS deleted FROM src LEFT JOIN due ON item_source_code = code AND r <= 1000 GROUP BY 1")
def expiry_counts(spark, sf):
    """A row for every selected source, also for one without any item."""
    sources = spark.sql(SOURCES + " UNION ALL SELECT 'other' AS code, 6 AS retention_months, true AS enabled")
    return I.expiry_counts(I.expiry(frame(spark, sf, STORED), sources, TODAY, 1000), sources)


#: Evidence for all unresolved items: of every third the place has changed, of every fifth the identity.
EVIDENCE = f"SELECT id, item_source_code, CASE WHEN id % 5 = 0 THEN 'other' ELSE atc_id END AS atc_id, found_sequence, CASE WHEN id % 3 = 0 THEN 'elsewhere' ELSE raw_category_name END AS place, CAST(NULL AS TIMESTAMP) AS previous_checked_at, storage_location_id AS location_id FROM ({ITEMS}) x WHERE status IN ('ambiguous', 'unmatched')"


@query("C8_apply_evidence", f"WITH i AS ({ITEMS}), e AS ({EVIDENCE}) SELECT i.id, CASE WHEN e.id IS NULL THEN status ELSE 'matched' END AS status, e.location_id FROM i LEFT JOIN e ON e.id = i.id AND e.item_source_code = i.item_source_code AND e.atc_id = i.atc_id AND e.found_sequence = i.found_sequence AND e.place = i.raw_category_name AND status IN ('ambiguous', 'unmatched')")
def apply_evidence(spark, sf):
    items = frame(spark, sf, ITEMS).select("id", *I.KEYS, F.col("raw_category_name").alias("place"), F.lit(None).cast("timestamp").alias("checked_at"), "status", F.lit(None).cast("long").alias("location_id"))
    #: Items of a hundred successive ids are one correction.
    evidence = frame(spark, sf, EVIDENCE).withColumn("correction", F.expr("id - pmod(id, 100)"))
    return I.apply_evidence(items, staged(evidence, "evidence")).select("id", "status", "location_id")


@query("C9_subcategories", "SELECT DISTINCT lang AS category, source AS child FROM documents")
def subcategories(spark, sf):
    (d,) = tables(spark, sf, "documents")
    pairs = d.select(F.col("lang").alias("category"), F.col("source").alias("child"))
    return I.update_subcategories(pairs.filter("doc_id % 2 = 0").distinct(), pairs)


#: A run over landed line items: blank categories and days outside the window leave, unknown categories fall back, places
#: that aren't active stay unmatched, long numbers in the text are masked, stored items of before 1993 are deleted.
RUN = """SELECT item_source_code, atc_id, found_sequence, page, pos, registered_on, price, quantity, CASE WHEN quantity = 7 THEN '' ELSE raw_category_name END AS raw_category_name, CAST(registered_on AS STRING) AS registered_text,
 CASE WHEN raw_category_name LIKE 'O%' THEN 'etc' ELSE 'known' END AS category, CASE WHEN page % 10 = 0 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN quantity > 40 THEN concat('no ', CAST(4000000000000 + pos AS STRING)) ELSE 'none' END AS text FROM ({0}) landed"""
FROM, TO, CUT = "1996-01-01", "2000-12-31", "1997-01-01"


@query("C10_run_audit", f"""WITH r AS ({RUN.format(LANDED)}), g AS (SELECT * FROM r WHERE raw_category_name <> '' AND registered_on BETWEEN DATE '{FROM}' AND DATE '{TO}'), d AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY {LAST}) = 1), s AS ({STORED})
 SELECT source, (SELECT count(*) FROM r WHERE item_source_code = source) AS fetched, (SELECT count(*) FROM r WHERE item_source_code = source AND raw_category_name = '') AS invalid, (SELECT count(*) FROM r WHERE item_source_code = source AND raw_category_name <> '' AND registered_on NOT BETWEEN DATE '{FROM}' AND DATE '{TO}') AS skipped,
 count(d.atc_id) AS selected, count(d.atc_id) FILTER (s.atc_id IS NULL) AS inserted, count(d.atc_id) FILTER (s.atc_id IS NOT NULL) AS updated, count(d.atc_id) FILTER (category = 'etc') AS fallback, count(d.atc_id) FILTER (status = 'ambiguous') AS unmatched, 0::BIGINT AS overseas, count(d.atc_id) FILTER (quantity > 40) AS masked,
 (SELECT count(*) FROM s x WHERE x.item_source_code = source AND x.registered_on < DATE '{CUT}') AS deleted FROM (VALUES ('police_api'), ('partner_api')) v(source) LEFT JOIN d ON d.item_source_code = source LEFT JOIN s ON s.item_source_code = d.item_source_code AND s.atc_id = d.atc_id AND s.found_sequence = d.found_sequence GROUP BY 1""")
def run_audit(spark, sf):
    """All counters come from the two jobs that write the run's items and the rows it leaves of the stored ones."""
    audit = I.Audit(["police_api", "partner_api"])
    stored = frame(spark, sf, STORED)
    landed = I.validate_items(frame(spark, sf, RUN.format(LANDED)), FROM, TO)
    landed = audit.watch(landed, fetched=F.lit(True), invalid=F.col("reject") == "invalid", skipped=F.col("reject") == "outside").filter("reject is null")
    last = I.dedupe_items(landed, I.KEYS, F.desc("registered_on"), F.desc("price"), F.desc("quantity"))
    split = I.finalize_status(I.split_new(last, stored), audit).withColumn("masked", mask_numbers(F.col("text")))
    split = audit.watch(split, selected=F.lit(True), inserted=F.col("is_new"), updated=~F.col("is_new"), fallback=F.col("category") == "etc", masked=F.col("masked") != F.col("text"))
    staged(split.select(*I.KEYS, "status", "masked"), "run")
    left = audit.watch(stored, deleted=F.col("registered_on") < F.lit(CUT).cast("date")).filter(F.col("registered_on") >= F.lit(CUT).cast("date"))
    staged(left, "kept")
    return audit.rows(spark)


@query("C11_match_rate", f"WITH items AS ({ITEMS}) SELECT item_source_code, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status <> 'excluded_overseas') AS counted, round(count(*) FILTER (status = 'matched') / count(*) FILTER (status <> 'excluded_overseas'), 6) AS rate FROM items GROUP BY 1")
def match_rate(spark, sf):
    return I.match_rate(frame(spark, sf, ITEMS), ["item_source_code"])


