"""Queries of text retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms as T
from ..operators import search as R
from ..operators import vectors as V
from ..sources.staged import staged
from .adapt import INSTITUTIONS, ITEMS, PLACES, frame, masked_numbers, tables
from .registry import query
from .vectors import DIM

NOW = "2025-01-01 00:00:00"
PLAIN = r"trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
#: Folded as terms are; beyond lower case only the sharp s matters in the driver's texts.
FOLDED = r"trim(regexp_replace(replace(lower(coalesce({}, '')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
TEXT = f"lower({masked_numbers("concat_ws(' ', item_name, raw_category_name, color_name, description)")})"
DOCS = f"i AS ({ITEMS}), d AS (SELECT id, storage_location_id AS location_id, {TEXT} AS search_text, registered_on FROM i WHERE status = 'matched' AND storage_location_id IS NOT NULL)"
TOKENS = "flatten(list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w: list_concat(['w:' || w], list_transform(range(1, length(w)), lambda k: 'c:' || substr(w, k, 2)))))"
PAIRS = "list_distinct(flatten(list_transform(string_split(text, ' '), lambda w: list_transform(range(1, length(w)), lambda k: substr(w, k, 2)))))"
#: The names of parts are the queries: short texts of whole words, none of them in the dictionaries.
QUERIES = f"q AS (SELECT query_id, text, {PAIRS} AS terms FROM (SELECT min(p_partkey) AS query_id, p_name AS text FROM part GROUP BY p_name) b), s AS (SELECT query_id, l AS location_id FROM q, range(0, 20) r(l) WHERE (query_id + l) % 4 = 0)"
POOL = f"WITH {DOCS}, {QUERIES}, c AS (SELECT q.query_id, d.id, d.search_text FROM q JOIN s USING (query_id) JOIN d USING (location_id) WHERE len(list_filter(terms, lambda t: contains(search_text, t))) > 0)"
SCORED = POOL + f""", y AS (SELECT id, {TOKENS.format(FOLDED.format('search_text'))} AS t FROM d), e AS (SELECT id, len(t) AS length, unnest(t) AS token FROM y), v AS (SELECT id, length, token, count(*) AS tf FROM e GROUP BY 1, 2, 3),
 z AS (SELECT query_id, count(*) AS n, avg(len(t)) AS mean FROM c JOIN y USING (id) GROUP BY 1),
 a AS (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) AS token FROM q), h AS (SELECT query_id, id, length, token, tf FROM a JOIN c USING (query_id) JOIN v USING (id, token)),
 f AS (SELECT query_id, token, count(*) AS df FROM h GROUP BY 1, 2), w AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS raw FROM h JOIN f USING (query_id, token) JOIN z USING (query_id) GROUP BY 1, 2),
 b AS (SELECT query_id, id, round(raw / (raw + 1), 6) AS score FROM w WHERE raw > 0)"""


def inputs(spark, sf):
    """Prepared queries, their scope and the projection of the items."""
    (part,) = tables(spark, sf, "part")
    queries = part.groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("query_id"))
    queries = staged(R.prepared(queries.select("query_id", "text"), T.Dictionary.load()), "queries")
    scope = queries.select("query_id", F.explode(F.expr("sequence(0L, 19L)")).alias("location_id")).filter("(query_id + location_id) % 4 = 0")
    return queries, scope, R.build_documents(frame(spark, sf, ITEMS), None, NOW)


def searched(spark, sf):
    """The same with the items indexed."""
    queries, scope, docs = inputs(spark, sf)
    return queries, scope, R.indexed(docs, T.Dictionary.load())


def scored(spark, sf):
    return R.lexical(*searched(spark, sf))


@query("F1_build_documents", f"WITH {DOCS} SELECT d.id, location_id, search_text, sha256(coalesce(nullif(trim(item_name), ''), '')) AS content_hash, CASE WHEN d.id % 2 = 0 THEN 2023 ELSE 2025 END AS since FROM d JOIN i ON i.id = d.id")
def build_documents(spark, sf):
    items = frame(spark, sf, ITEMS)
    old = items.filter("id % 2 = 0").select("id", F.lit("2023-05-05").cast("timestamp").alias("visible_since"))
    return R.build_documents(items, old, NOW).select("id", "location_id", "search_text", "content_hash", F.year("visible_since").alias("since"))


@query("F2_seed_documents", f"WITH {DOCS} SELECT d.id, location_id FROM d JOIN (SELECT id FROM i WHERE id > 100 ORDER BY id LIMIT 500) k USING (id)")
def seed_documents(spark, sf):
    return R.seed_documents(frame(spark, sf, ITEMS), 100, 500, NOW).select("id", "location_id")


@query("F3_tokenize", f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, {TOKENS.format(PLAIN.format('text'))} AS t FROM documents) x")
def tokenize(spark, sf):
    (d,) = tables(spark, sf, "documents")
    t = d.select("doc_id", T.tokens(T.plain(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|").cast("binary")).alias("digest"))


#: A dictionary over the invented words, so that the dictionary operators meet the driver's texts.
WORDS = T.Dictionary(
    [{"domain": "item", "canonical": "thing", "terms": ["tion", "of the"], "scope": []}, {"domain": "color", "canonical": "dark", "terms": ["der", "la"], "scope": []}],
    [{"name": "one", "categories": [], "terms": ["onthe", "inger"]}, {"name": "two", "categories": [], "terms": ["tionth", "ander"]}],
    {"three": ["ofthe"]},
)
#: Whole texts; blanks are doubled, so that neighbouring words are replaced alike.
DOUBLED = f"' ' || replace({FOLDED.format('text')}, ' ', '  ') || ' '"


@query("F4_canonicalize", f"WITH p AS (SELECT doc_id, regexp_replace(regexp_replace({DOUBLED}, ' of  the ', ' thing ', 'g'), ' (tion|ofthe) ', ' thing ', 'g') AS t FROM documents) SELECT doc_id, trim(regexp_replace(regexp_replace(t, ' (der|la) ', ' dark ', 'g'), ' +', ' ', 'g')) AS t FROM p")
def canonicalize(spark, sf):
    (d,) = tables(spark, sf, "documents")
    return d.select("doc_id", T.canonicalize(F.col("text"), WORDS, True).alias("t"))


#: Hangul-marked compounds made of each document's number and words, of parts that are all known or not.
COMPOUNDS = "SELECT doc_id, unnest(['카드' || doc_id || '지갑', '카드' || doc_id || '지', '지갑카드' || len(text), '케이스' || lang]) AS word FROM documents"


@query("F5_segment", f"SELECT doc_id, word, CASE WHEN regexp_full_match(word, '(카드|지갑|케이스|[0-9]+)+') THEN array_to_string(regexp_extract_all(word, '카드|지갑|케이스|[0-9]+'), ' ') ELSE word END AS parts FROM ({COMPOUNDS}) x WHERE word IS NOT NULL")
def segment(spark, sf):
    (d,) = tables(spark, sf, "documents")
    words = T.Dictionary([{"domain": "item", "canonical": "카드", "terms": [], "scope": []}], [{"name": "지갑", "categories": [], "terms": ["지갑"]}], {})
    made = F.expr("array(concat('카드', doc_id, '지갑'), concat('카드', doc_id, '지'), concat('지갑카드', length(text)), concat('케이스', lang))")
    rows = d.select("doc_id", F.explode(made).alias("word")).filter("word is not null")
    return rows.select("doc_id", "word", F.array_join(T.segment(F.col("word"), words), " ").alias("parts"))


@query("F6_detect_kinds", f"WITH e AS (SELECT doc_id, replace({PLAIN.format('text')}, ' ', '') AS raw FROM documents), k AS (SELECT doc_id, raw, regexp_extract_all(replace(raw, 'ofthe', '|'), 'tionth|ander|inger|onthe') AS m FROM e) SELECT doc_id, CASE WHEN len(m) = 0 THEN CASE WHEN contains(raw, 'ofthe') THEN 'three' ELSE '' END ELSE concat_ws(',', CASE WHEN list_has_any(m, ['onthe', 'inger']) THEN 'one' END, CASE WHEN list_has_any(m, ['tionth', 'ander']) THEN 'two' END) END AS kinds FROM k")
def detect_kinds(spark, sf):
    (d,) = tables(spark, sf, "documents")
    return d.select("doc_id", F.array_join(T.detect_kinds(T.plain(F.col("text")), WORDS), ",").alias("kinds"))


#: The pairs of characters of all words: whatever else a query without a kind offers contains one of them; words of one
#: letter are looked for on their own.
ALONE = "list_sort(list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) = 1)))"


@query("F7_candidate_terms", f"SELECT query_id, text, array_to_string(list_sort({PAIRS}), ',') AS terms, array_to_string({ALONE}, ',') AS words FROM (SELECT item_id AS query_id, {FOLDED.format('text')} AS text FROM benchmark UNION ALL SELECT -p_partkey, {FOLDED.format("concat(p_name, ' ', substr(p_type, 1, 1), ' ', p_size % 10)")} FROM part) b")
def candidate_terms(spark, sf):
    """Candidate terms of whole benchmark texts, and of part names followed by a letter and a digit alone."""
    bench, part = tables(spark, sf, "benchmark", "part")
    names = part.select((-F.col("p_partkey")).alias("query_id"), F.concat_ws(" ", "p_name", F.substring("p_type", 1, 1), F.col("p_size") % 10).alias("text"))
    ready = R.prepared(bench.select(F.col("item_id").alias("query_id"), "text").unionByName(names), T.Dictionary.load())
    return ready.select("query_id", "text", F.array_join("terms", ",").alias("terms"), F.array_join("words", ",").alias("words"))


@query("F8_candidates", POOL + " SELECT query_id, id FROM c")
def candidates(spark, sf):
    queries, scope, docs = inputs(spark, sf)
    docs = staged(docs, "documents")
    return R.candidates(queries, scope, docs, R.gram_lists(docs)).select("query_id", "id")


def kinds_sql(text: str) -> str:
    """Kinds of a text by WORDS, as a list."""
    raw = f"replace({PLAIN.format(text)}, ' ', '')"
    m = f"regexp_extract_all(replace({raw}, 'ofthe', '|'), 'tionth|ander|inger|onthe')"
    named = f"list_filter([CASE WHEN list_has_any({m}, ['onthe', 'inger']) THEN 'one' END, CASE WHEN list_has_any({m}, ['tionth', 'ander']) THEN 'two' END], lambda k: k IS NOT NULL)"
    return f"CASE WHEN len({m}) > 0 THEN {named} WHEN contains({raw}, 'ofthe') THEN ['three'] ELSE [] END"


@query("F9_kind_gate", f"WITH i AS ({ITEMS}), q AS (SELECT item_id, {kinds_sql('text')} AS wanted FROM benchmark), k AS (SELECT id, {kinds_sql('item_name')} AS n, {kinds_sql('raw_category_name')} AS c, {kinds_sql('description')} AS d FROM i), p AS (SELECT id, wanted, d, CASE WHEN len(n) > 0 THEN n WHEN len(c) > 0 THEN c ELSE d END AS own FROM k JOIN q ON item_id = id % (SELECT count(*) FROM benchmark)) SELECT id, array_to_string(wanted, ',') AS wanted, array_to_string(own, ',') AS own, len(wanted) = 0 OR list_has_any(wanted, own) OR list_has_any(wanted, d) AS passes FROM p")
def kind_gate(spark, sf):
    """Kinds found in names, categories and whole descriptions; each item meets one of the benchmark's texts."""
    (bench,) = tables(spark, sf, "benchmark")
    kinds = lambda c: T.detect_kinds(T.plain(F.col(c)), WORDS)
    asked = bench.select(F.col("item_id").alias("turn"), F.col("text").alias("query"), kinds("text").alias("wanted"))
    items = frame(spark, sf, ITEMS).crossJoin(bench.agg(F.count("*").alias("n"))).withColumn("turn", F.col("id") % F.col("n"))
    named = items.select("id", "turn", F.concat("item_name", "raw_category_name").alias("identity"), kinds("item_name").alias("name_kinds"), kinds("raw_category_name").alias("category_kinds"), kinds("description").alias("description_kinds"))
    own = F.when(F.size("name_kinds") > 0, F.col("name_kinds")).when(F.size("category_kinds") > 0, F.col("category_kinds")).otherwise(F.col("description_kinds"))
    return R.kind_gate(named.join(asked, "turn")).select("id", F.array_join("wanted", ",").alias("wanted"), F.array_join(own, ",").alias("own"), F.coalesce("passes", F.lit(True)).alias("passes"))


@query("F10_bm25", SCORED + " SELECT * FROM b")
def bm25(spark, sf):
    return scored(spark, sf)


@query("F11_semantic_score", "SELECT vec_id, round(greatest(0, (coalesce(CASE WHEN vec_id % 9 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) * 3 END, 0) - 0.6) / 0.4), 6) AS score FROM embeddings")
def semantic_score(spark, sf):
    (e,) = tables(spark, sf, "embeddings")
    cos = F.when(F.col("vec_id") % 9 != 0, F.col("embedding")[0].cast("double") * 3)
    return e.select("vec_id", F.round(R.semantic_score(cos), 6).alias("score"))


COS = "round(list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})), 6)".format(a="x.v", b="y.v")
#: Each query and item has the vector of its number. The nearest 60 by codes are scored; cosines from 0.05 on count.
NEAR, LEAST, MOST = 60, 0.05, 30
VECTORS = "vv AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
SEM = f"""{VECTORS}, hm AS (SELECT s.query_id, d.id, x.v AS xv, y.v AS yv, {COS} AS cos, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((x.v[i] > 0) <> (y.v[i] > 0) AS INT))) AS BIGINT) AS far FROM s JOIN d USING (location_id) JOIN vv x ON x.vec_id = s.query_id JOIN vv y ON y.vec_id = d.id),
 hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY far, id DESC) AS place FROM hm), sem0 AS (SELECT query_id, id, cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id DESC) AS rank FROM hr WHERE place <= {NEAR} AND cos >= {LEAST}), sem AS (SELECT query_id, id, 0.5 + cos / 2 AS cos FROM sem0 WHERE rank <= {MOST})"""
#: All items of a scope, without the code table's cut.
WHOLE = "sem AS (SELECT query_id, id, 0.5 + list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) / 2 AS cos FROM s JOIN d USING (location_id) JOIN embeddings x ON x.vec_id = query_id JOIN embeddings y ON y.vec_id = id)"
FUSED = SCORED + f", {WHOLE}, j AS (SELECT query_id, id, b.score, greatest(0, (cos - 0.6) / 0.4) AS semantic, query_id % 5 <> 0 AS ok FROM b FULL OUTER JOIN sem USING (query_id, id)), u AS (SELECT query_id, id, CAST(round(CAST(CASE WHEN ok THEN 0.75 * coalesce(score, 0) + 0.25 * coalesce(semantic, 0) ELSE coalesce(score, 0) END AS DECIMAL(20, 12)), 6) AS DOUBLE) AS score FROM j WHERE score IS NOT NULL OR (ok AND semantic > 0))"


def vectored(spark, sf, scope, docs):
    """The scope's queries and the items with the vectors and codes of their numbers."""
    (e,) = tables(spark, sf, "embeddings")
    vectors = e.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("code", V.binarize(F.col("v"), DIM))
    asked = scope.withColumnRenamed("location_id", "scope").join(vectors.withColumnRenamed("vec_id", "query_id"), "query_id")
    return asked, docs.select("id", F.col("location_id").alias("scope")).join(vectors.withColumnRenamed("vec_id", "id"), "id")


def fused(spark, sf):
    """The semantic side scores every item of a query's scope; a cosine is moved to 0..1 to pass for a similarity. Pairs
    whose semantic score is 0 change nothing and leave first."""
    queries, scope, index = searched(spark, sf)
    asked, items = vectored(spark, sf, scope, index.docs)
    near = V.scope_cosines(asked, items).select("query_id", "id", (0.5 + F.col("cos") / 2).alias("cos")).filter(R.semantic_score(F.col("cos")) > 0)
    available = queries.select("query_id", (F.col("query_id") % 5 != 0).alias("ok"))
    return R.hybrid_rank(R.lexical(queries, scope, index), R.semantic_hits(queries, scope, index.docs, staged(near, "near")), available)


@query("F12_semantic_overlap", f"WITH {DOCS}, {QUERIES}, {SEM}, ex AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id DESC) AS rank FROM hm WHERE cos >= {LEAST}) SELECT ex.query_id, round(count(sem0.id) / count(*), 6) AS overlap FROM ex LEFT JOIN sem0 ON sem0.query_id = ex.query_id AND sem0.id = ex.id AND sem0.rank <= 10 WHERE ex.rank <= 10 GROUP BY 1")
def semantic_overlap(spark, sf):
    """Share of each query's ten nearest items by all cosines of its scope that the code table leads to."""
    _, scope, docs = inputs(spark, sf)
    asked, items = vectored(spark, sf, scope, docs)
    return V.overlap_at_k(V.semantic_topk(asked, items, DIM, LEAST, MOST, NEAR), V.exact_topk(asked, items, LEAST, MOST), 10)


@query("F12_hybrid_rank", FUSED + " SELECT query_id, id, score FROM u")
def hybrid_rank(spark, sf):
    return fused(spark, sf).select("query_id", "id", "score")


@query("F13_ranked_page", SCORED + " SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank, count(*) OVER (PARTITION BY query_id) AS total, CASE WHEN count(*) OVER (PARTITION BY query_id) > 10 THEN 10 END AS next_offset FROM b QUALIFY rank <= 10")
def ranked_page(spark, sf):
    return R.ranked_page(scored(spark, sf), 0, 10)


@query("F14_list_items", f"WITH {DOCS}, {QUERIES}, r AS (SELECT query_id, d.id, location_id, registered_on, row_number() OVER (PARTITION BY query_id ORDER BY registered_on DESC, d.id DESC) AS rank FROM s JOIN d USING (location_id) WHERE query_id % 2 = 0 OR (registered_on, d.id) < (DATE '2024-09-01', 500)), n AS (SELECT query_id, count(*) AS total FROM s JOIN d USING (location_id) WHERE query_id % 2 = 0 GROUP BY 1) SELECT r.*, total FROM r LEFT JOIN n USING (query_id) WHERE rank <= 25")
def list_items(spark, sf):
    queries, scope, _ = inputs(spark, sf)
    before = queries.filter("query_id % 2 = 1").select("query_id", F.lit("2024-09-01").cast("date").alias("before_day"), F.lit(500).cast("long").alias("before_id"))
    return R.list_items(frame(spark, sf, ITEMS), scope, before, 25)


@query("F15_attach_details", SCORED + ", g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM b) SELECT g.query_id, g.id, i.item_name, i.registered_on FROM g JOIN i ON i.id = g.id WHERE rank <= 5")
def attach_details(spark, sf):
    queries, scope, docs = inputs(spark, sf)
    page = R.ranked_page(R.lexical(queries, scope, R.indexed(docs, T.Dictionary.load())), 0, 5)
    return R.attach_details(page, docs, scope).select("query_id", "id", "detail.item_name", "detail.registered_on")


@query("F16_attach_thumbnails", "SELECT page_id AS id, url, CASE WHEN page_id % 3 <> 0 AND page_id % 5 <> 0 THEN 'k' || page_id END AS object_key FROM pages")
def attach_thumbnails(spark, sf):
    (p,) = tables(spark, sf, "pages")
    page = p.select(F.col("page_id").alias("id"), "url")
    ready = page.select("id", "url", F.concat(F.lit("k"), F.col("id")).alias("object_key"), F.expr("if(id % 3 = 0, 'new', 'ready')").alias("status"), F.expr("if(id % 5 = 0, timestamp '2024-01-01', null)").alias("deleted_at"))
    return R.attach_thumbnails(page, ready)


#: Whole turns of conversations, some of them a card number, and names of parts.
TEXTS = "SELECT 'turn' AS origin, CAST(conv_id AS BIGINT) AS a, CAST(turn AS BIGINT) AS b, CASE WHEN conv_id % 7 = 0 THEN ' 4111111111111 ' ELSE text END AS text FROM conversations UNION ALL SELECT 'part' AS origin, CAST(p_partkey AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, p_name AS text FROM part UNION ALL SELECT 'type' AS origin, CAST(p_partkey AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, p_type AS text FROM part"


@query("F17_admit_queries", f"SELECT origin, a, b, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(trim(text)) > 30 THEN 'too long' WHEN regexp_matches(trim(text), '[0-9]{{13}}') THEN 'identifier' END AS reason FROM ({TEXTS}) x")
def admit_queries(spark, sf):
    from ..functions.masks import has_identifier

    return R.admit_queries(frame(spark, sf, TEXTS), has_identifier).select("origin", "a", "b", "reason")


STEPS = (50000.0, 120000.0, 250000.0)
#: Names of parts as texts, every third one asked for by a word that no document has; half of these have a rewrite.
RETRIED = "SELECT query_id, CASE WHEN query_id % 3 = 0 THEN '우산' ELSE name END AS text, CASE WHEN query_id % 4 = 0 THEN CAST(120000.0 AS DOUBLE) END AS requested, CASE WHEN query_id % 2 = 0 THEN name END AS rewritten FROM (SELECT min(CAST(p_partkey AS BIGINT)) AS query_id, p_name AS name FROM part GROUP BY p_name) b"
FAR = "2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians(l.latitude - p.latitude) / 2), 2) + cos(radians(p.latitude)) * cos(radians(l.latitude)) * pow(sin(radians(l.longitude - p.longitude) / 2), 2))))"
RETRY = f"""WITH {DOCS}, q0 AS ({RETRIED}), pl AS ({PLACES}), li AS ({INSTITUTIONS}),
 s AS (SELECT query_id, location_id, greatest(CASE WHEN far <= 50000 THEN 0 WHEN far <= 120000 THEN 1 ELSE 2 END, CASE WHEN requested IS NULL THEN 0 ELSE 1 END) AS step FROM (SELECT p.query_id, l.id AS location_id, min({FAR}) AS far FROM pl p JOIN li l ON abs(l.latitude - p.latitude) < 2.4 GROUP BY 1, 2) x JOIN q0 USING (query_id) WHERE far <= 250000),
 f1 AS (SELECT query_id, min(step) AS first FROM s GROUP BY 1),
 v AS (SELECT query_id, text, nullif(rewritten, text) AS rewritten, first, unnest(CASE WHEN nullif(rewritten, text) IS NULL THEN [0] ELSE [0, 1] END) AS variant FROM q0 LEFT JOIN f1 USING (query_id)),
 t AS (SELECT *, CASE variant WHEN 0 THEN text ELSE rewritten END AS used FROM v),
 c AS (SELECT t.query_id, variant, used, d.id, step, CASE WHEN variant = 1 THEN step - first + 2 WHEN rewritten IS NULL THEN step - first + 1 WHEN step = first THEN 1 END AS number FROM t JOIN s USING (query_id) JOIN d USING (location_id) WHERE len(list_filter({PAIRS.replace('text', 'used')}, lambda x: contains(search_text, x))) > 0),
 y AS (SELECT id, {TOKENS.format(FOLDED.format('search_text'))} AS t FROM d), e AS (SELECT id, len(t) AS length, unnest(t) AS token FROM y), w0 AS (SELECT id, length, token, count(*) AS tf FROM e GROUP BY 1, 2, 3),
 a0 AS (SELECT query_id, variant, unnest(list_distinct({TOKENS.format('used')})) AS token FROM t),
 hit AS (SELECT DISTINCT c.* FROM c JOIN a0 USING (query_id, variant) JOIN w0 ON w0.id = c.id AND w0.token = a0.token),
 k AS (SELECT q.query_id, q.text, q.rewritten, q.first, m.found, coalesce(m.found, 3 - q.first + CASE WHEN q.rewritten IS NULL THEN 0 ELSE 1 END) AS attempt FROM v q LEFT JOIN (SELECT query_id, min(number) AS found FROM hit GROUP BY 1) m USING (query_id) WHERE q.variant = 0),
 k2 AS (SELECT *, CASE WHEN rewritten IS NOT NULL AND attempt > 1 THEN 1 ELSE 0 END AS variant FROM k), k3 AS (SELECT *, first + attempt - 1 - variant AS step FROM k2),
 po AS (SELECT c.query_id, c.id FROM c JOIN k3 ON k3.query_id = c.query_id AND k3.variant = c.variant AND c.step <= k3.step),
 z AS (SELECT query_id, count(*) AS n, avg(len(t)) AS mean FROM po JOIN y USING (id) GROUP BY 1),
 h AS (SELECT po.query_id, po.id, length, w0.token, tf FROM po JOIN k3 USING (query_id) JOIN a0 ON a0.query_id = po.query_id AND a0.variant = k3.variant JOIN w0 ON w0.id = po.id AND w0.token = a0.token),
 df AS (SELECT query_id, token, count(*) AS df FROM h GROUP BY 1, 2), b AS (SELECT query_id, id, round(raw / (raw + 1), 6) AS score FROM (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS raw FROM h JOIN df USING (query_id, token) JOIN z USING (query_id) GROUP BY 1, 2) x),
 g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id DESC) AS rank FROM b)
 SELECT k3.query_id, CASE WHEN k3.attempt IS NULL THEN 'no_institutions' WHEN k3.found IS NULL THEN 'no_matches' ELSE 'results' END AS status, k3.attempt, CASE k3.step WHEN 0 THEN 50000.0::DOUBLE WHEN 1 THEN 120000.0 WHEN 2 THEN 250000.0 END AS radius, CASE k3.variant WHEN 1 THEN k3.rewritten ELSE k3.text END AS text,
 count(g.id) AS total, array_to_string(coalesce(list(g.id ORDER BY rank) FILTER (rank <= 3), []), ',') AS ids FROM k3 LEFT JOIN g USING (query_id) GROUP BY ALL"""


@query("F18_search_with_retry", RETRY)
def search_with_retry(spark, sf):
    asked = frame(spark, sf, RETRIED)
    docs = R.build_documents(frame(spark, sf, ITEMS), None, NOW)
    found = R.search_with_retry(asked, frame(spark, sf, PLACES), frame(spark, sf, INSTITUTIONS), asked.select("query_id", "rewritten"), R.indexed(docs, T.Dictionary.load()), T.Dictionary.load(), STEPS)
    return found.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("F19_check_containment", f"WITH {DOCS}, {QUERIES}, y AS (SELECT d.id, location_id, {TOKENS.format(FOLDED.format('search_text'))} AS t FROM d), a AS (SELECT DISTINCT query_id, location_id, unnest({TOKENS.format('text')}) AS token FROM q JOIN s USING (query_id)) SELECT 0::BIGINT AS missing, count(*) AS scored FROM (SELECT DISTINCT query_id, id FROM a JOIN (SELECT DISTINCT id, location_id, unnest(t) AS token FROM y) k USING (location_id, token)) n")
def check_containment(spark, sf):
    """All items of each scope are scored, and those with a score looked for among the candidates."""
    queries, scope, index = searched(spark, sf)
    pool = scope.join(index.docs.select("id", "location_id"), "location_id")
    everything = staged(R.lexical(queries, scope, index, pool), "scores")
    missing = R.check_containment(everything, R.candidates(queries, scope, index.docs, index.grams)).agg(F.count("*").alias("missing"))
    return missing.join(everything.agg(F.count("*").alias("scored")))
