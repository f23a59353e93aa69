"""Text retrieval for many queries at once. The scope join on the institution always comes first."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masks import mask_numbers
from ..functions.postings import gram_lists, term_grams, token_lists
from ..functions.scalars import embedding_input_v1
from ..functions.terms import Dictionary, candidate_terms, canonicalize, detect_kinds, tokens
from ..sources.staged import heavy, lean, light, spread, staged
from .places import multi_scope

K1, B = 1.2, 0.75
#: Lists that are intersected for one term, the shortest ones; what is left is verified in the texts.
LISTS = 3


class Index(NamedTuple):
    """The search index: one row a document (``docs``), its grams for candidates (``grams``) and its tokens with their
    counts for ranking (``tokens``)."""

    docs: DataFrame
    grams: DataFrame
    tokens: DataFrame


def project(items: DataFrame) -> DataFrame:
    """items with location_id, content_hash (of the first embedding input), search_text (lower case, numbers masked) and
    detail; works on tables and streams."""
    joined = F.lower(mask_numbers(F.concat_ws(" ", "item_name", "raw_category_name", "color_name", "description")))
    detail = F.struct("item_name", "raw_category_name", "color_name", "description", "registered_on")
    text = F.col("normalized_search_text") if "normalized_search_text" in items.columns else F.lit(None).cast("string")
    hashed = F.sha2(F.coalesce(embedding_input_v1(text, F.col("item_name")), F.lit("")), 256)
    return items.withColumns({"location_id": F.col("storage_location_id"), "content_hash": hashed, "search_text": joined, "detail": detail})


def build_documents(items: DataFrame, previous: DataFrame | None, now: str) -> DataFrame:
    """The search projection of matched, located items, with visible_since (kept from the previous projection)."""
    live = items.filter("status = 'matched' and storage_location_id is not null")
    docs = project(live).select("id", "location_id", "content_hash", "search_text", "detail")
    time = F.lit(now).cast("timestamp")
    if previous is None:
        return docs.withColumn("visible_since", time)
    return docs.join(previous.select("id", F.col("visible_since").alias("__since")), "id", "left").withColumn("visible_since", F.coalesce("__since", time)).drop("__since")


def seed_documents(items: DataFrame, after: int, limit: int, now: str) -> DataFrame:
    """The projection of the next ``limit`` items after an id."""
    return build_documents(items.filter(F.col("id") > after).orderBy("id").limit(limit), None, now)


def prepared(queries: DataFrame, dictionary: Dictionary) -> DataFrame:
    """queries(query_id, text) -> query_id, text (canonical), wanted (kinds), terms, words, tokens (distinct: those
    of the text and of its kinds' terms)."""
    kinds_text = {k: " ".join(ts) for k, ts in dictionary.kinds.items()}
    #: Written between, since one Arrow function works on what another one made.
    named = staged(queries.select("query_id", canonicalize(F.col("text"), dictionary, True).alias("text")), "queries")
    named = staged(named.withColumn("wanted", detect_kinds(F.col("text"), dictionary)), "queries")
    spelled = F.array_join(F.transform("wanted", lambda k: F.create_map(*(F.lit(x) for kt in kinds_text.items() for x in kt))[k]), " ") if kinds_text else F.lit("")
    named = named.withColumn("c", candidate_terms(F.col("text"), F.col("wanted"), dictionary)).withColumn("again", canonicalize(F.concat_ws(" ", "text", spelled), dictionary))
    return named.select("query_id", "text", "wanted", "c.terms", "c.words", F.array_distinct(tokens(F.col("again"))).alias("tokens"))


def indexed(docs: DataFrame, dictionary: Dictionary) -> Index:
    """docs(id, location_id, search_text: masked, detail) -> the index. Its documents have id, location_id, search_text,
    canonical text, its number of tokens, and what the kind gate asks for. Each text is folded once."""
    canonical = spread(docs, "id").select(
        "id", "location_id", "search_text", canonicalize(F.col("search_text"), dictionary).alias("canonical"), canonicalize(F.col("detail.item_name"), dictionary).alias("name"),
        canonicalize(F.col("detail.raw_category_name"), dictionary).alias("category"), canonicalize(F.col("detail.description"), dictionary).alias("description"),
    )
    described = F.when(F.col("description") != "", F.col("description")).otherwise(F.col("canonical"))
    kinds = {"name_kinds": F.col("name"), "category_kinds": F.col("category"), "description_kinds": described}
    words = F.filter(F.split("canonical", " "), lambda w: w != "")
    #: A word of n characters has itself and n - 1 pairs as tokens.
    length = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    rows = canonical.select("id", "location_id", "search_text", "canonical", length.alias("length"), F.concat("name", "category").alias("identity"), *(detect_kinds(c, dictionary).alias(n) for n, c in kinds.items()))
    found = staged(rows, "search-index")
    return Index(found, staged(gram_lists(found), "grams"), staged(token_lists(found), "tokens"))


def asked_terms(queries: DataFrame, scope: DataFrame) -> DataFrame:
    """queries(query_id, terms, words), scope(query_id, location_id) -> query_id, location_id, term: ``t`` and what to
    look for inside texts, ``w`` and a letter to look for on its own."""
    marked = F.concat(F.transform("terms", lambda t: F.concat(F.lit("t"), t)), F.transform("words", lambda w: F.concat(F.lit("w"), w)))
    return queries.join(scope, "query_id").select("query_id", "location_id", F.explode(marked).alias("term")).distinct()


def candidates(queries: DataFrame, scope: DataFrame, docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Pairs in scope whose text has any of the query's terms, or any of its one-letter words between other than
    letters and digits. docs(id, location_id, search_text), grams(location_id, gram, id).

    A distinct term of an institution is answered once: the LISTS shortest of its grams' lists are intersected, and
    only texts left over for terms of more than two characters are read. Lists are never gathered: each of their rows
    is a row here, so a frequent gram of a large institution is spread as a join splits it."""
    asked = staged(asked_terms(queries, scope), "asked")
    terms = asked.select("location_id", "term").distinct()
    spelled = term_grams(terms.select("term").distinct())
    wanted = terms.join(spelled, "term").select("location_id", "term", "exact", F.explode("grams").alias("gram"), F.size("grams").alias("n_grams"))
    wanted = staged(wanted, "wanted")
    met = staged(grams.join(lean(wanted.select("location_id", "gram").distinct(), "wanted-grams"), ["location_id", "gram"]), "lists")
    lengths = met.groupBy("location_id", "gram").agg(F.count("*").alias("n"))
    every = Window.partitionBy("location_id", "term")
    sized = wanted.join(lengths, ["location_id", "gram"]).withColumn("there", F.count("*").over(every)).filter("there = n_grams")
    shortest = sized.withColumn("rank", F.row_number().over(every.orderBy("n", "gram"))).filter(F.col("rank") <= LISTS)
    shortest = shortest.select("location_id", "term", "gram", F.least(F.col("n_grams"), F.lit(LISTS)).alias("need"), "exact")
    hits = met.join(lean(shortest, "shortest"), ["location_id", "gram"])
    at_once = hits.filter("need = 1").select("location_id", "term", "id", "exact")
    common = hits.filter("need > 1").groupBy("location_id", "term", "id", "need", "exact").agg(F.count("*").alias("n")).filter("n = need")
    left = at_once.unionByName(common.select("location_id", "term", "id", "exact"))
    term = F.substring("term", F.lit(2), F.length("term"))
    read = heavy(left.filter("not exact")).join(docs.select("id", "location_id", "search_text"), ["id", "location_id"]).filter(F.contains("search_text", term))
    found = left.filter("exact").select("location_id", "term", "id").unionByName(read.select("location_id", "term", "id"))
    return found.join(light(asked), ["location_id", "term"]).select("query_id", "id", "location_id").distinct()


def kind_gate(pairs: DataFrame) -> DataFrame:
    """pairs(wanted, name_kinds, category_kinds, description_kinds, query, identity): the item's kinds are those of
    its name, else its category, else its description."""
    own = F.when(F.size("name_kinds") > 0, F.col("name_kinds")).when(F.size("category_kinds") > 0, F.col("category_kinds")).otherwise(F.col("description_kinds"))
    clash = F.col("query").contains("아이폰") & F.col("identity").rlike("삼성|갤럭시|엘지|샤오미") & ~F.col("identity").contains("아이폰")
    fits = (F.size("wanted") == 0) | F.arrays_overlap("wanted", own)
    phone = F.array_contains("wanted", "휴대폰") & (own == F.array(F.lit("이어폰")))
    return pairs.withColumn("passes", ~clash & (fits | (~phone & F.arrays_overlap("wanted", "description_kinds"))))


def bm25(queries: DataFrame, pool: DataFrame, index: Index) -> DataFrame:
    """queries(query_id, tokens: distinct array), pool(query_id, id, location_id) -> query_id, id, score > 0.

    Frequencies, sizes and the mean length come from each query's whole pool. The index counts each text's tokens;
    those that a query asks for meet it at their institution."""
    lengths = heavy(index.docs.select("id", "length"))
    size = pool.join(lengths, "id").groupBy("query_id").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    asked = queries.select("query_id", F.explode("tokens").alias("token")).distinct()
    here = lean(asked.join(pool.select("query_id", "location_id").distinct(), "query_id"), "asked-tokens")
    hits = index.tokens.join(here, ["location_id", "token"]).join(heavy(pool.select("query_id", "id")), ["query_id", "id"])
    hits = staged(hits.select("query_id", "id", "token", "tf"), "hits")
    found = hits.groupBy("query_id", "token").agg(F.count("*").alias("df"))
    k = hits.join(lean(found, "frequencies"), ["query_id", "token"]).join(lean(size, "sizes"), "query_id").join(lengths, "id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    total = k.groupBy("query_id", "id").agg(F.sum(weight).alias("raw"))
    return total.filter("raw > 0").select("query_id", "id", F.round(F.col("raw") / (F.col("raw") + 1), 6).alias("score"))


def fitting(queries: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs(query_id, id) that pass the kind gate. docs is indexed, queries are prepared."""
    kinds = ("identity", "name_kinds", "category_kinds", "description_kinds")
    asked = queries.select("query_id", "wanted", F.col("text").alias("query"))
    return kind_gate(heavy(pairs.select("query_id", "id")).join(docs.select("id", *kinds), "id").join(asked, "query_id")).filter("passes").select("query_id", "id")


def lexical(queries: DataFrame, scope: DataFrame, index: Index, pool: DataFrame | None = None) -> DataFrame:
    """Scores of the candidates, or of a pool, that pass the kind gate. queries are prepared."""
    pool = staged(candidates(queries, scope, index.docs, index.grams), "pool") if pool is None else pool
    scores = staged(bm25(queries, pool, index), "scored")
    return scores.join(heavy(fitting(queries, scores, index.docs)), ["query_id", "id"], "left_semi")


def semantic_score(cos: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.coalesce(cos, F.lit(0.0)) - 0.60) / 0.40)


def hybrid_rank(lex: DataFrame, sem: DataFrame, available: DataFrame, weight: float = 0.75) -> DataFrame:
    """lex(query_id, id, score), sem(query_id, id, cos), available(query_id, ok): all lexical hits; semantic ones
    with a positive score; unweighted lexical scores where the query has no vector. ``sem`` lies in scope and
    passes the kind gate (semantic_hits)."""
    s = sem.select("query_id", "id", semantic_score(F.col("cos")).alias("semantic"))
    joined = lex.join(s, ["query_id", "id"], "full_outer").join(available, "query_id", "left")
    ok = F.coalesce("ok", F.lit(False))
    fused = F.when(ok, weight * F.coalesce("score", F.lit(0.0)) + (1 - weight) * F.coalesce("semantic", F.lit(0.0))).otherwise(F.coalesce("score", F.lit(0.0)))
    kept = joined.filter(F.col("score").isNotNull() | (ok & (F.col("semantic") > 0))).select("query_id", "id", F.round(fused.cast("decimal(20,12)"), 6).cast("double").alias("score"))
    return ranked(kept)


def semantic_hits(queries: DataFrame, scope: DataFrame, docs: DataFrame, near: DataFrame) -> DataFrame:
    """near(query_id, id, cos) as far as it lies in the query's scope and passes the kind gate."""
    inside = heavy(near).join(docs.select("id", "location_id"), "id").join(scope, ["query_id", "location_id"], "left_semi")
    return inside.join(heavy(fitting(queries, inside, docs)), ["query_id", "id"], "left_semi").select("query_id", "id", "cos")


def ranked(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))))


def ranked_page(scored: DataFrame, offset: int = 0, size: int = 50) -> DataFrame:
    """One page of each query with the total and the next offset; the total is an aggregate, so that the rank
    window can stop at the page's end in every task."""
    total = scored.groupBy("query_id").agg(F.count("*").alias("total"))
    page = ranked(scored).filter((F.col("rank") > offset) & (F.col("rank") <= offset + size))
    following = F.when(F.col("total") > offset + size, F.lit(offset + size))
    return page.join(total, "query_id").select("query_id", "id", "score", "rank", "total", following.alias("next_offset"))


def list_items(items: DataFrame, scope: DataFrame, before: DataFrame | None, limit: int) -> DataFrame:
    """Newest items of each query's scope before its keyset (day, id): the first of each institution, merged. A first
    page, of a query without a keyset, also has the scope's total, counted for each institution once; later ones
    have none. The limit is 1 to 201."""
    if not 1 <= limit <= 201:
        raise ValueError("the limit must be 1 to 201")
    live = items.filter("status = 'matched'").select(F.col("storage_location_id").alias("location_id"), "id", "registered_on")
    rows = scope.join(live, "location_id")
    first = scope.select("query_id").distinct()
    if before is not None:
        rows = rows.join(before, "query_id", "left").filter(F.col("before_id").isNull() | (F.struct("registered_on", "id") < F.struct("before_day", "before_id")))
        first = first.join(before.filter("before_id is not null"), "query_id", "left_anti")
    counts = live.groupBy("location_id").agg(F.count("*").alias("n"))
    total = scope.join(first, "query_id", "left_semi").join(counts, "location_id").groupBy("query_id").agg(F.sum("n").alias("total"))
    order = (F.desc("registered_on"), F.desc("id"))
    inner = rows.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "location_id").orderBy(*order))).filter(F.col("k") <= limit)
    page = inner.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= limit)
    return page.select("query_id", "id", "location_id", "registered_on", "rank").join(total, "query_id", "left")


def attach_details(page: DataFrame, docs: DataFrame, scope: DataFrame) -> DataFrame:
    """Details of ranked ids, as far as they lie in the query's scope."""
    return page.join(docs.select("id", "location_id", "detail"), "id").join(scope, ["query_id", "location_id"], "left_semi")


def attach_thumbnails(page: DataFrame, thumbnails: DataFrame) -> DataFrame:
    ready = thumbnails.filter("status = 'ready' and deleted_at is null").select("id", "url", "object_key")
    return page.join(ready, ["id", "url"], "left")


def admit_queries(queries: DataFrame, has_identifier, longest: int = 30) -> DataFrame:
    text = F.trim(F.coalesce("text", F.lit("")))
    reason = F.when(text == "", "empty").when(F.length(text) > longest, "too long").when(has_identifier(text), "identifier")
    return queries.withColumn("text", text).withColumn("reason", reason)


def _step(at_least: Column, steps: tuple[float, ...]) -> Column:
    """Number of the first step of at least a distance, from 0; null beyond the last one."""
    found = F.lit(None).cast("int")
    for k, r in reversed(list(enumerate(steps))):
        found = F.when(at_least <= r, k).otherwise(found)
    return found


def search_with_retry(queries: DataFrame, places: DataFrame, locations: DataFrame, rewrites: DataFrame, index: Index, dictionary: Dictionary, steps: tuple[float, ...] = (1000.0, 1500.0, 2000.0)) -> DataFrame:
    """queries(query_id long, text, requested: least radius or null), places(query_id, latitude, longitude),
    locations(id, latitude, longitude), rewrites(query_id, rewritten) -> query_id, status, attempt, radius, text, total
    and the ids of the best three.

    Attempts of a query form a lattice: the text as asked at the first radius with an institution, then its rewrite
    there and at each wider radius, or the text itself at wider radii where there is no other rewrite. All of them are
    answered by one pass over the widest scope: a hit doesn't depend on the pool, so each pair of a text and an item
    tells of the first attempt that would find it, and the least of these is the attempt that counts. Only that one
    is ranked, with the statistics of its own scope. Without hits the last attempt counts; without any institution
    there is none. Blank rewrites, and those equal to the text, are none."""
    asked = queries.select("query_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce(_step(F.coalesce("requested", F.lit(0.0)), steps), F.lit(len(steps) - 1)).alias("least"))
    other = rewrites.select("query_id", F.trim("rewritten").alias("rewritten")).filter("rewritten <> ''").groupBy("query_id").agg(F.min("rewritten").alias("rewritten"))
    asked = asked.join(other, "query_id", "left").withColumn("rewritten", F.when(F.col("rewritten") != F.col("text"), F.col("rewritten")))
    near = multi_scope(places.join(queries.select("query_id"), "query_id", "left_semi"), locations, max(steps))
    scope = near.join(asked.select("query_id", "least"), "query_id").select("query_id", "location_id", F.greatest(_step(F.col("distance"), steps), F.col("least")).alias("step"))
    scope = staged(scope, "retry-scope")
    first = scope.groupBy("query_id").agg(F.min("step").alias("first"))
    plan = staged(asked.join(first, "query_id", "left").withColumn("last", F.lit(len(steps)) - F.col("first") + F.col("rewritten").isNotNull().cast("int")), "retry-plan")
    texts = F.array(F.struct(F.lit(0).alias("variant"), F.col("text").alias("t")), F.struct(F.lit(1).alias("variant"), F.col("rewritten").alias("t")))
    spelled = plan.select("query_id", F.explode(texts).alias("v")).select("query_id", "v.variant", F.col("v.t").alias("text")).filter("text is not null")
    variant = (F.col("query_id") * 2 + F.col("variant")).alias("query_id")
    ready = staged(prepared(spelled.select(variant, "text"), dictionary), "retry-queries")
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("variant")
    wide = scope.select("query_id", "location_id", both).select(variant, "location_id").join(ready.select("query_id"), "query_id", "left_semi")
    pool = staged(candidates(ready, wide, index.docs, index.grams), "retry-pool")
    hits = fitting(ready, token_hits(ready, pool, index), index.docs)
    own = (F.floor(F.col("query_id") / 2)).cast("long")
    placed = hits.join(heavy(pool), ["query_id", "id"]).select(own.alias("query_id"), F.pmod("query_id", F.lit(2)).alias("variant"), "location_id").distinct()
    placed = placed.join(scope, ["query_id", "location_id"]).join(plan.select("query_id", "first", "rewritten"), "query_id")
    later = F.col("step") - F.col("first")
    number = F.when(F.col("variant") == 1, later + 2).when(F.col("rewritten").isNull(), later + 1).when(later == 0, F.lit(1))
    least = placed.groupBy("query_id").agg(F.min(number).alias("found"))
    chosen = plan.join(least, "query_id", "left").withColumn("attempt", F.coalesce("found", "last"))
    rewritten = F.col("rewritten").isNotNull() & (F.col("attempt") > 1)
    chosen = chosen.withColumn("step", F.col("first") + F.col("attempt") - 1 - rewritten.cast("int")).withColumn("variant", rewritten.cast("int"))
    chosen = staged(chosen, "retry-chosen")
    within = chosen.filter("found is not null").select("query_id", "variant", F.col("step").alias("most")).join(scope, "query_id").filter("step <= most").select(variant, "location_id")
    scores = staged(lexical(ready, within, index, staged(pool.join(within, ["query_id", "location_id"], "left_semi"), "retry-final")), "retry-scores")
    total = scores.groupBy("query_id").agg(F.count("*").alias("total"))
    best = ranked(scores).filter("rank <= 3").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids"))
    found = total.join(best, "query_id").select(own.alias("query_id"), "total", "ids")
    radius = F.element_at(F.array(*(F.lit(float(r)) for r in steps)), F.col("step") + 1)
    status = F.when(F.col("attempt").isNull(), "no_institutions").when(F.col("found").isNull(), "no_matches").otherwise("results")
    used = F.when(F.col("variant") == 1, F.col("rewritten")).otherwise(F.col("text"))
    rows = chosen.select("query_id", status.alias("status"), "attempt", F.when(F.col("attempt").isNotNull(), radius).alias("radius"), used.alias("text"))
    return rows.join(found, "query_id", "left").select("query_id", "status", "attempt", "radius", "text", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def token_hits(queries: DataFrame, pool: DataFrame, index: Index) -> DataFrame:
    """Pairs of the pool whose text has any of the query's tokens."""
    asked = queries.select("query_id", F.explode("tokens").alias("token")).join(pool.select("query_id", "location_id").distinct(), "query_id")
    met = index.tokens.join(lean(asked, "asked-tokens"), ["location_id", "token"]).select("query_id", "id").distinct()
    return pool.select("query_id", "id").join(heavy(met), ["query_id", "id"], "left_semi")


def retry_log(found: DataFrame) -> DataFrame:
    """Every attempt up to the one that counted, with its number of matches."""
    rows = found.filter("attempt is not null").select("query_id", F.explode(F.sequence(F.lit(1), F.col("attempt"))).alias("number"), "attempt", "total")
    return rows.select("query_id", F.col("number").alias("attempt"), F.when(F.col("number") == F.col("attempt"), F.col("total")).otherwise(0).alias("match_count"))


def check_containment(scored: DataFrame, cands: DataFrame) -> DataFrame:
    """Pairs with a score in the whole scope that are no candidates: must be empty."""
    return scored.join(heavy(cands), ["query_id", "id"], "left_anti")
