"""Ingest: validation, categories, de-duplication, upsert, retention, audit. Built-in functions throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.masks import mask_text
from ..functions.scalars import blank, category_parent, match_key, norm_text, parse_date
from ..sources.staged import staged
from .privacy import is_high_risk

KEYS = ["item_source_code", "atc_id", "found_sequence"]


def named(frame: DataFrame, side: str) -> DataFrame:
    return frame.select(*(F.col(f"`{c}`").alias(side + c) for c in frame.columns))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(place)).filter("__place = 1").drop("__place")


def latest_unique(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The newest n records, the first occurrence of each identity."""
    return first_by(df, keys, *order).orderBy(*order).limit(n)


def page_completeness(pages: DataFrame, by: list[str], keys: list[str], total: str) -> DataFrame:
    """Fetched rows and distinct identities of each window against its declared total."""
    got = pages.groupBy(*by).agg(F.count("*").alias("fetched"), F.countDistinct(*keys).alias("identities"), F.max(total).alias("declared"))
    return got.withColumn("complete", F.col("fetched") >= F.col("declared"))


def apply_reviewed(existing: DataFrame, reviewed: DataFrame, keys: list[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Reviewed rows to insert because their key is new, and those whose key has another target already."""
    inserts = reviewed.join(existing, keys, "left_anti")
    old = existing.select(*keys, F.col(target).alias("__old"))
    return inserts, reviewed.join(old, keys).filter(~F.col(target).eqNullSafe(F.col("__old"))).withColumnRenamed("__old", "existing_target")


def classify(df: DataFrame, categories: DataFrame) -> DataFrame:
    """category code by exact parent name, spaces removed and case folded; null if unknown."""
    key = lambda c: F.regexp_replace(match_key(c), " ", "")
    known = categories.select(key(F.col("name")).alias("__key"), F.col("code").alias("category_code"))
    return df.withColumn("__key", key(category_parent(F.col("raw_category_name")))).join(F.broadcast(known), "__key", "left").drop("__key")


def resolve_category(df: DataFrame, mappings: DataFrame, categories: DataFrame, fallback: str = "etc") -> DataFrame:
    """category_id by exact pair, else parent name, else the fallback row, with ``by`` telling which. Category
    tables are dimensions of a few dozen rows. Fails if the fallback row is missing."""
    pair = mappings.select(F.col("raw_name").alias("__raw"), F.col("category_id").alias("__pair"))
    parent = categories.select(F.col("name").alias("__name"), F.col("id").alias("__parent"))
    rest = categories.filter(F.col("code") == fallback).agg(F.first("id").alias("__rest"))
    joined = df.join(pair, F.col("raw_category_name") == F.col("__raw"), "left").join(parent, category_parent(F.col("raw_category_name")) == F.col("__name"), "left").crossJoin(F.broadcast(rest))
    by = F.when(F.col("__pair").isNotNull(), "pair").when(F.col("__parent").isNotNull(), "parent").otherwise("fallback")
    found = F.coalesce("__pair", "__parent", "__rest", F.raise_error(F.lit("no fallback category")).cast("long"))
    return joined.select(*df.columns, found.alias("category_id"), by.alias("by"))


def validate_items(df: DataFrame, start: str, end: str) -> DataFrame:
    """reject: invalid (blank identity or category, no date) before outside the window; sequence defaults to 1."""
    day = parse_date(F.col("registered_text"))
    reject = F.when(blank(F.col("atc_id")) | blank(F.col("raw_category_name")) | day.isNull(), "invalid").when(~day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), "outside")
    return df.withColumn("registered_on", day).withColumn("found_sequence", F.coalesce(F.nullif(F.trim("found_sequence"), F.lit("")), F.lit("1"))).withColumn("reject", reject)


ROW_COLUMNS = "item_source_code atc_id found_sequence service_category_code service_category_name raw_category_name color_name item_name description image_url raw_storage_name registered_on normalized_search_text raw_payload".split()


def search_text(df: DataFrame) -> Column:
    """Name, subject, colour and category with white space collapsed, masked by the category's risk; columns that
    df lacks count as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("item_name", "description", "color_name", "raw_category_name") if c in df.columns]
    risk = is_high_risk(F.col("raw_category_name")) if "raw_category_name" in df.columns else False
    return mask_text(norm_text(F.concat_ws(" ", *parts)), risk)


def to_item_rows(df: DataFrame) -> DataFrame:
    """The canonical 14 columns, all text; absent ones null, the payload as JSON of the landed columns."""
    payload = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    made = {"raw_payload": payload, "normalized_search_text": search_text(df)}
    return df.select(*((made[c] if c in made else F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in ROW_COLUMNS))


def plan_windows(sources: DataFrame, items: DataFrame, today: str) -> DataFrame:
    """source, start, end of the next incremental read."""
    day = F.lit(today).cast("date")
    newest = items.groupBy(F.col("item_source_code").alias("code")).agg(F.max("registered_on").alias("newest"))
    floor = F.add_months(day, -F.col("retention_months"))
    return sources.join(newest, "code", "left").select("code", F.greatest(floor, F.least(F.coalesce("newest", floor), F.date_sub(day, 1))).alias("start"), day.alias("end"))


def backfill_windows(requests: DataFrame, today: str) -> DataFrame:
    """requests(id, start, end, days, floor) -> id, error or consecutive windows (start, end)."""
    error = F.when(~F.col("days").between(1, 31), "days").when(F.col("start") > F.col("end"), "reversed").when(F.col("start") < F.col("floor"), "before retention").when(F.col("end") > F.lit(today).cast("date"), "future")
    starts = F.when(error.isNull(), F.expr("sequence(start, end, make_interval(0, 0, 0, days))")).otherwise(F.array(F.col("start")))
    rows = requests.select("id", error.alias("error"), F.explode(starts).alias("window_start"), "end", "days")
    return rows.select("id", "error", F.when(F.col("error").isNull(), F.col("window_start")).alias("window_start"), F.when(F.col("error").isNull(), F.least("end", F.date_add("window_start", F.col("days") - 1))).alias("window_end"))


def dedupe_items(df: DataFrame, keys: list[str] = KEYS, *ties: Column) -> DataFrame:
    """The last page and row of each identity."""
    return first_by(df, keys, F.desc("page"), F.desc("pos"), *ties)


def split_new(incoming: DataFrame, existing: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """incoming with is_new: one left join instead of a semi and an anti join."""
    old = existing.select(*keys).distinct().withColumn("__old", F.lit(True))
    return incoming.join(old, keys, "left").withColumn("is_new", F.col("__old").isNull()).drop("__old")


def upsert_items(existing: DataFrame, incoming: DataFrame, now: str, keys: list[str] = KEYS) -> DataFrame:
    """Full outer join on the identity: incoming values win, first_seen_at of the old row stays."""
    time = F.lit(now).cast("timestamp")
    old, new = existing.withColumn("__o", F.lit(True)), incoming.withColumn("__n", F.lit(True))
    joined = named(old, "o_").join(named(new, "n_"), [F.col("o_" + k) == F.col("n_" + k) for k in keys], "full_outer")
    fresh = F.col("n___n").isNotNull()
    out = []
    for c in existing.columns:
        if c == "first_seen_at":
            value = F.coalesce("o_first_seen_at", time)
        elif c == "last_seen_at":
            value = F.when(fresh, time).otherwise(F.col("o_last_seen_at"))
        elif c in incoming.columns:
            value = F.when(fresh, F.col("n_" + c)).otherwise(F.col("o_" + c))
        else:
            value = F.col("o_" + c)
        out.append(value.alias(c))
    return joined.select(*out)


def in_buckets(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(table: DataFrame, path: str, buckets: int = 64, keys: list[str] = KEYS) -> None:
    """A table cut into folders by a hash of the identity, each of about the same size."""
    table.withColumn("bucket", in_buckets(keys, buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def touched(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    """The rows of some buckets; other folders are not read."""
    return spark.read.parquet(path).filter(F.col("bucket").isin(numbers)).drop("bucket")


def replace_buckets(spark: SparkSession, path: str, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], buckets: int, keys: list[str]) -> int:
    """Combine (old rows, incoming rows) of the buckets that an incoming key falls into, in place; returns how many were
    replaced. Only these buckets are read, and each is replaced as a whole. What is combined is written beside the
    table first, so a broken replacement can be run again. The driver sees bucket numbers only, at most ``buckets``."""
    fresh = staged(incoming.withColumn("bucket", in_buckets(keys, buckets)), "incoming")
    numbers = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
    if numbers:
        merged = staged(combine(touched(spark, path, numbers), fresh.drop("bucket")), "merged")
        placed = merged.withColumn("bucket", in_buckets(keys, buckets)).repartition(len(numbers), "bucket")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(numbers)


def merge_buckets(spark: SparkSession, path: str, incoming: DataFrame, now: str, buckets: int = 64, keys: list[str] = KEYS) -> int:
    """upsert_items into a bucketed table in place (replace_buckets); the same rows and time change nothing."""
    return replace_buckets(spark, path, incoming, lambda old, new: upsert_items(old, new, now, keys), buckets, keys)


#: The six columns of a detail check that are carried over or cleared together.
DETAIL = ["detail_org", "detail_department", "detail_status", "detail_place", "detail_phone", "detail_note"]


def carry_detail(joined: DataFrame, columns: list[str] = DETAIL) -> DataFrame:
    """Of rows old and new side by side (old_x, x): a changed place without a newer check clears the detail
    columns; the same place keeps the old ones where the new are null."""
    same = F.col("place").eqNullSafe(F.col("old_place"))
    newer = F.coalesce(F.col("checked_at") > F.coalesce("old_checked_at", F.lit("1900-01-01").cast("timestamp")), F.lit(False))
    return joined.withColumns({c: F.when(same, F.coalesce(c, "old_" + c)).when(newer, F.col(c)) for c in [*columns, "checked_at"]})


#: Counters of a run.
COUNTERS = ("fetched", "selected", "inserted", "updated", "deleted", "unmatched", "invalid", "fallback", "masked", "overseas", "skipped")


class Audit:
    """Counters of a run, taken from the rows as they pass through its jobs: ``watch`` leaves a frame as it is and lets
    Spark count beside, for each source; ``rows`` has the counts once the jobs have run. Sources are a dimension."""

    def __init__(self, sources: list[str], column: str = "item_source_code"):
        self.sources, self.column, self.seen = sources, column, []

    def watch(self, rows: DataFrame, **counters: Column) -> DataFrame:
        """Count rows for which a condition holds, by the counter's name."""
        metrics = [F.count_if((F.col(self.column) == s) & F.coalesce(c, F.lit(False))).alias(f"{name}.{k}") for k, s in enumerate(self.sources) for name, c in counters.items()]
        observation = Observation()
        self.seen.append(observation)
        return rows.observe(observation, *metrics)

    def rows(self, spark: SparkSession) -> DataFrame:
        """source and all COUNTERS, 0 where nothing was watched."""
        total = {(s, name): 0 for s in self.sources for name in COUNTERS}
        for observation in self.seen:
            for key, n in observation.get.items():
                name, _, k = key.rpartition(".")
                total[self.sources[int(k)], name] += n
        return spark.createDataFrame([(s, *(total[s, name] for name in COUNTERS)) for s in self.sources], "source string, " + ", ".join(f"{c} long" for c in COUNTERS))


def finalize_status(df: DataFrame, audit: Audit | None = None) -> DataFrame:
    """Rows still ambiguous become unmatched; an audit counts these with the unmatched and the overseas ones as they pass."""
    done = df.withColumn("status", F.when(F.col("status") == "ambiguous", "unmatched").otherwise(F.col("status")))
    return done if audit is None else audit.watch(done, unmatched=F.col("status") == "unmatched", overseas=F.col("status") == "excluded_overseas")


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return incoming.join(existing.select(*keys), keys, "left_anti")


def expiry(items: DataFrame, sources: DataFrame, today: str, limit: int = 5000, source: str | None = None) -> DataFrame:
    """items with ``expired``: older than the source's retention, the oldest first, at most ``limit`` over all
    selected sources. The limit is a top-k, so only ``limit`` identities are ranked together."""
    chosen = sources.filter("enabled") if source is None else sources.filter((F.col("code") == source) & F.col("enabled"))
    floor = chosen.select(F.col("code").alias("item_source_code"), F.add_months(F.lit(today).cast("date"), -F.col("retention_months")).alias("__floor"))
    due = items.join(floor, "item_source_code").filter(F.col("registered_on") < F.col("__floor"))
    gone = due.orderBy("registered_on", *KEYS).limit(limit).select(*KEYS).withColumn("__gone", F.lit(True))
    return items.join(gone, KEYS, "left").withColumn("expired", F.coalesce("__gone", F.lit(False))).drop("__gone")


def expiry_counts(expired: DataFrame, sources: DataFrame, source: str | None = None) -> DataFrame:
    """Number of expired rows of each selected source, 0 where none expired."""
    chosen = sources.filter("enabled") if source is None else sources.filter((F.col("code") == source) & F.col("enabled"))
    gone = expired.filter("expired").groupBy(F.col("item_source_code").alias("code")).agg(F.count("*").alias("n"))
    return chosen.select("code").join(gone, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("deleted"))


#: A correction has at least one row and at most so many.
EVIDENCE = 100


def apply_evidence(items: DataFrame, evidence: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """items(id, identity, place, checked_at, status, location_id, ...), evidence(id, identity, place, previous_checked_at,
    location_id, correction: optional). It applies where id, identity, place and previous check time still match an
    unresolved row. Rows of the same ``correction`` come together; without that column all of them do, and then there must
    be one. A correction of more than ``most`` rows is refused, and so are two of its rows for one id. Any number of
    corrections applies, in their order: what one has resolved, a later one leaves."""
    if "correction" not in evidence.columns:
        if evidence.isEmpty():
            raise ValueError(f"evidence must have 1 to {most} rows")
        evidence = evidence.withColumn("correction", F.lit(0))
    sizes = evidence.groupBy("correction").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
    wrong = sizes.filter((F.col("n") > most) | (F.col("ids") < F.col("n"))).first()
    if wrong:
        raise ValueError(f"evidence must have 1 to {most} rows" if wrong.n > most else "evidence names an item twice")
    guards = ["id", *KEYS, "place", "previous_checked_at"]
    e = evidence.groupBy(*(F.col(c).alias("__" + c) for c in guards)).agg(F.min(F.struct("correction", "location_id"))["location_id"].alias("__location"))
    same = [F.col(k) == F.col("__" + k) for k in KEYS]
    hit = (F.col("id") == F.col("__id")) & F.col("place").eqNullSafe(F.col("__place")) & F.col("checked_at").eqNullSafe(F.col("__previous_checked_at")) & F.col("status").isin("ambiguous", "unmatched")
    for s in same:
        hit &= s
    joined = items.join(e, hit, "left")
    applied = F.col("__id").isNotNull()
    return joined.select(*(c for c in items.columns if c not in ("status", "location_id")), F.when(applied, "matched").otherwise(F.col("status")).alias("status"), F.when(applied, F.col("__location")).otherwise(F.col("location_id")).alias("location_id"))


def update_subcategories(dim: DataFrame, observed: DataFrame) -> DataFrame:
    """The dimension with pairs (category, child) that it lacks."""
    return dim.unionByName(observed.distinct().join(dim, ["category", "child"], "left_anti"))


def match_rate(items: DataFrame, by: list[str]) -> DataFrame:
    counted = F.count_if(F.col("status") != "excluded_overseas")
    return items.groupBy(*by).agg(F.count_if(F.col("status") == "matched").alias("matched"), counted.alias("counted"), F.round(F.try_divide(F.count_if(F.col("status") == "matched"), counted), 6).alias("rate"))
