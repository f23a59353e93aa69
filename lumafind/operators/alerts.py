"""Alert reservations, matching and the message queue: tables in, tables out, all reservations at once."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import KST
from ..functions.terms import Dictionary
from ..sources.staged import heavy, staged
from .conditions import Conditions, meets, mentions, wanted
from .places import circles, leading_scope, nearest_place
from .search import Index, candidates, lexical, prepared

RADII = (1000, 1500, 2000)
DAY = "interval 24 hours"


def ts(value: str) -> Column:
    return F.lit(value).cast("timestamp")


def local_date(col: Column) -> Column:
    return F.from_utc_timestamp(col, KST).cast("date")


def midnight(day: Column) -> Column:
    """Midnight in Seoul of a date, as an instant."""
    return F.to_utc_timestamp(day.cast("timestamp"), KST)


def validate_reservations(df: DataFrame, has_identifier: Callable[[Column], Column], radii: tuple[int, ...] = RADII) -> DataFrame:
    """df(email, query, places: array of (name, lat, lon), radius_m, consent) with the first reason to refuse and
    places without repeated coordinates, in their order."""
    text = F.trim(F.coalesce("query", F.lit("")))
    coordinates = F.transform("places", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    unique = F.filter("places", lambda p, i: F.array_position(coordinates, F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))) == i + 1)
    rows = df.withColumn("places", unique)
    outside = F.exists("places", lambda p: ~F.coalesce(p["lat"].between(33.0, 38.7) & p["lon"].between(124.5, 132.0), F.lit(False)))
    bad_mail = ~F.coalesce(F.col("email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$") & (F.length("email") <= 254), F.lit(False))
    reason = F.when(bad_mail, "email").when(~F.length(text).between(1, 30), "query").when(has_identifier(text), "identifier").when(~F.coalesce(F.size("places").between(1, 3), F.lit(False)), "places").when(outside, "bounds").when(~F.coalesce(F.col("radius_m").isin(*radii), F.lit(False)), "radius").when(~F.coalesce("consent", F.lit(False)), "consent")
    return rows.withColumn("reason", reason)


def _address_fold(per_address: int):
    """Rows (id, email, address, at in microseconds, room, eligible, given), by address and time, with whether they are
    admitted. Of an address only its last ``per_address`` admitted times are kept."""
    day = 24 * 3600 * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, deque(maxlen=per_address)
        for batch in batches:
            admitted = []
            for address, at, eligible, given in zip(*(batch.column(k).to_pylist() for k in (2, 3, 5, 6))):
                if address is None or address != last:
                    last, kept = address, deque(maxlen=per_address)
                ok = given or (eligible and not (len(kept) == per_address and at - kept[0] < day))
                if ok:
                    kept.append(at)
                admitted.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted, pa.bool_())], [*batch.schema.names, "admitted"])

    return run


def admit_reservations(requests: DataFrame, open_now: DataFrame, earlier: DataFrame | None = None, per_mail: int = 3, per_address: int = 5) -> DataFrame:
    """requests(id, email, address, at) in time order, ties by id: at most ``per_mail`` open reservations of a mail, tested
    first, with those in open_now(email); then at most ``per_address`` admitted requests of an address in 24 hours,
    with those in earlier(address, at). Only admitted requests count, for both. Returns id, email and what refused it:
    mail, address or null. Without an address only the mail counts; requests without a mail are those of one mail.

    A request depends on earlier ones of its address and of its mail. Each round folds every address in a sorted stream,
    with a few times as its state however many requests an address has, and counts what that admits for each mail.
    What a round decides rightly, later rounds keep, since all that it depends on lies before it in time; the rounds
    end when the mails' counts confirm the fold."""
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    held = open_now.groupBy(F.col("email").alias("__mail")).agg(F.count("*").alias("__open"))
    rows = requests.join(held, F.col("email").eqNullSafe(F.col("__mail")), "left").select("id", "email", "address", micros.alias("at"), (F.lit(per_mail) - F.coalesce("__open", F.lit(0))).cast("long").alias("room"))
    rows = rows.withColumn("eligible", F.col("room") > 0).withColumn("given", F.lit(False))
    if earlier is not None:
        none = (F.lit(None).cast(dict(requests.dtypes)[c]).alias(c) for c in ("id", "email"))
        past = earlier.filter("address is not null").select(*none, "address", micros.alias("at"), F.lit(0).cast("long").alias("room"), F.lit(False).alias("eligible"), F.lit(True).alias("given"))
        rows = rows.unionByName(past)
    rows = staged(rows, "requests")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", admitted boolean"
    before = Window.partitionBy("given", "email").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        folded = rows.repartition("address").sortWithinPartitions("address", "at", F.desc("given"), "id").mapInArrow(_address_fold(per_address), schema)
        fits = ~F.col("given") & (F.coalesce(F.sum(F.col("admitted").cast("long")).over(before), F.lit(0)) < F.col("room"))
        judged = staged(folded.withColumn("fits", fits), "admission")
        if judged.filter("fits <> eligible").isEmpty():
            break
        rows = judged.select("id", "email", "address", "at", "room", F.col("fits").alias("eligible"), "given")
    return judged.filter("not given").select("id", "email", F.when(~F.col("eligible"), "mail").when(~F.col("admitted"), "address").alias("refused"))


def alert_period(df: DataFrame, days: int = 7) -> DataFrame:
    day = local_date(F.col("created_at"))
    ends = midnight(F.date_add(day, days + 1))
    return df.withColumn("expires_at", ends).withColumn("first_day", F.date_add(day, 1)).withColumn("last_day", F.date_sub(local_date(ends), 1))


def match_queue(reservations: DataFrame, cursors: DataFrame, messages: DataFrame, source: str, now: str) -> DataFrame:
    """Active, unexpired reservations of before today without a final notice for this expiry, with their cursor;
    order by the cursor, nulls first, to work the oldest first."""
    live = reservations.filter((F.col("status") == "active") & (F.col("expires_at") > ts(now)) & (local_date(F.col("created_at")) < local_date(ts(now))))
    final = messages.filter("kind = 'notice'").select(F.col("reservation_id").alias("id"), F.col("for_expiry").alias("expires_at"))
    mine = cursors.filter(F.col("source") == source).select(F.col("reservation_id").alias("id"), "checked_until")
    return live.join(final, ["id", "expires_at"], "left_anti").join(mine, "id", "left")


def alert_candidates(queue: DataFrame, places: DataFrame, institutions: DataFrame, items: DataFrame, notified: DataFrame, source: str, metres: float) -> DataFrame:
    """Items of the source in any place's circle, at active institutions, visible after the cursor, first seen after
    the reservation, and not yet notified. One grid join serves all reservations of a radius, those with the same places
    at once; of a table of items only their institutions matter. Reservations meet items last."""
    live = institutions.filter("is_active")
    if not items.isStreaming:
        live = live.join(items.select(F.col("location_id").alias("id")).distinct(), "id", "left_semi")
    around = circles(places.select("query_id", "latitude", "longitude").join(queue.select(F.col("id").alias("query_id")), "query_id", "left_semi"))
    near = staged(leading_scope(around, live, metres).select(F.col("query_id").alias("leader"), "location_id"), "near")
    asked = queue.select(F.col("id").alias("reservation_id"), "checked_until", "created_at").join(around.asked.select(F.col("query_id").alias("reservation_id"), "leader"), "reservation_id")
    fresh = items.filter(F.col("item_source_code") == source).select(F.col("id").alias("item_id"), "location_id", "visible_since", "first_seen_at")
    rows = near.join(fresh, "location_id").join(asked, "leader")
    rows = rows.filter(((F.col("visible_since") > F.col("checked_until")) | F.col("checked_until").isNull()) & (F.col("first_seen_at") > F.col("created_at")))
    return rows.join(notified.select("reservation_id", "item_id"), ["reservation_id", "item_id"], "left_anti").select("reservation_id", "item_id", "visible_since")


def search_judge(reservations: DataFrame, cands: DataFrame, index: Index, dictionary: Dictionary, conditions: Conditions | None = None) -> DataFrame:
    """The default judge. reservations(reservation_id, text), cands(reservation_id, item_id) -> reservation_id, item_id,
    score: what a search for the text finds among the reservation's own candidates, its statistics taken from those
    that have any of its terms, as far as it meets the text's condition words."""
    conditions = conditions or Conditions(dictionary)
    asked = reservations.select(F.col("reservation_id").alias("query_id"), "text").join(cands.select(F.col("reservation_id").alias("query_id")).distinct(), "query_id", "left_semi")
    queries = staged(prepared(asked, dictionary), "alert-queries")
    pairs = staged(cands.select(F.col("reservation_id").alias("query_id"), F.col("item_id").alias("id")).distinct(), "alert-pairs")
    there = heavy(pairs).join(index.docs.select("id", "location_id"), "id")
    scope = there.select("query_id", "location_id").distinct()
    pool = staged(candidates(queries, scope, index.docs, index.grams).join(heavy(pairs), ["query_id", "id"], "left_semi"), "alert-pool")
    scores = lexical(queries, scope, index, pool)
    named = mentions(index.docs.join(pool.select("id").distinct(), "id", "left_semi"), conditions)
    kept = meets(scores, staged(wanted(asked, conditions), "conditions"), staged(named, "mentions"))
    return kept.select(F.col("query_id").alias("reservation_id"), F.col("id").alias("item_id"), "score")


def judge(cands: DataFrame, reservations: DataFrame, index: Index, dictionary: Dictionary, judge: Callable[..., DataFrame] = search_judge) -> DataFrame:
    """cands(reservation_id, item_id, ...) that the judge finds alike, with its score. A judge takes reservations
    (reservation_id, text), the candidates, the search index and the dictionary, and returns reservation_id, item_id, score."""
    return heavy(cands).join(judge(reservations, cands, index, dictionary), ["reservation_id", "item_id"])


def record_matches(matches: DataFrame, notified: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new notified pairs, reservations that need a match message because none is pending)."""
    fresh = matches.dropDuplicates(["reservation_id", "item_id"]).join(notified, ["reservation_id", "item_id"], "left_anti")
    pending = messages.filter("kind = 'match' and status = 'pending'").select("reservation_id")
    return fresh, fresh.select("reservation_id").distinct().join(pending, "reservation_id", "left_anti")


def advance_cursors(cursors: DataFrame, cands: DataFrame, source: str) -> DataFrame:
    """Cursors of a source moved to the latest visible time among the candidates, never back."""
    seen = cands.groupBy("reservation_id").agg(F.max("visible_since").alias("__seen"))
    mine = cursors.filter(F.col("source") == source)
    return mine.join(seen, "reservation_id", "full_outer").select("reservation_id", F.lit(source).alias("source"), F.greatest("checked_until", "__seen").alias("checked_until"))


def expiry_notices(reservations: DataFrame, messages: DataFrame, now: str) -> DataFrame:
    """Active reservations that end within 24 hours and have no notice for this expiry: convert the pending match
    message if there is one, else insert."""
    soon = reservations.filter((F.col("status") == "active") & (F.col("expires_at") > ts(now)) & (F.col("expires_at") <= ts(now) + F.expr(DAY))).select(F.col("id").alias("reservation_id"), F.col("expires_at").alias("for_expiry"))
    done = messages.filter("kind = 'notice'").select("reservation_id", "for_expiry")
    waiting = messages.filter("kind = 'match' and status = 'pending'").groupBy("reservation_id").agg(F.min("id").alias("message_id"))
    return soon.join(done, ["reservation_id", "for_expiry"], "left_anti").join(waiting, "reservation_id", "left").withColumn("action", F.when(F.col("message_id").isNotNull(), "convert").otherwise("insert"))


def claim_batch(messages: DataFrame, now: str, limit: int, cap: int) -> DataFrame:
    """The next messages to send: the cap less those sent in 24 hours or in flight; confirmations before matches
    before notices, then the oldest. Claims stuck for ten minutes are open again."""
    stuck = (F.col("status") == "sending") & (F.col("claimed_at") < ts(now) - F.expr("interval 10 minutes"))
    spent = messages.agg(F.count_if(((F.col("status") == "sent") & (F.col("sent_at") > ts(now) - F.expr(DAY))) | ((F.col("status") == "sending") & ~stuck)).alias("__spent"))
    order = F.when(F.col("kind") == "confirm", 0).when(F.col("kind") == "match", 1).otherwise(2)
    waiting = messages.filter((F.col("status") == "pending") | stuck).withColumn("__order", order).orderBy("__order", "created_at", "id").limit(limit)
    place = waiting.withColumn("__place", F.row_number().over(Window.orderBy("__order", "created_at", "id")))
    return place.crossJoin(F.broadcast(spent)).filter(F.col("__place") <= F.lit(cap) - F.col("__spent")).select("id", "kind", (F.col("attempts") + 1).alias("attempts"), F.col("__place").alias("place"))


def payloads(messages: DataFrame, notified: DataFrame, items: DataFrame, places: DataFrame, locations: DataFrame) -> DataFrame:
    """messages(id, reservation_id), notified(reservation_id, item_id, score), items(id, item_name, raw_category_name,
    color_name, registered_on, location_id), places(query_id, position, place_name, latitude, longitude), locations(id,
    name, latitude, longitude) -> each message with its items, by score (none last), date and id from the top, each
    with its institution and the nearest of the reservation's places, and the places in order. A message is one row."""
    at = locations.select(F.col("id").alias("location_id"), F.col("name").alias("location_name"), "latitude", "longitude")
    detail = items.select(F.col("id").alias("item_id"), "item_name", "raw_category_name", "color_name", "registered_on", "location_id").join(at, "location_id", "left")
    pairs = notified.join(messages.select("reservation_id").distinct(), "reservation_id", "left_semi").join(detail, "item_id")
    near = nearest_place(pairs.filter("latitude is not null").select(F.col("reservation_id").alias("query_id"), "item_id", "latitude", "longitude"), places)
    full = pairs.join(near.select(F.col("query_id").alias("reservation_id"), "item_id", F.col("place_name").alias("near_place_name")), ["reservation_id", "item_id"], "left")
    item = F.struct("score", "registered_on", "item_id", "item_name", "raw_category_name", "color_name", "location_name", "near_place_name")
    listed = messages.select("id", "reservation_id").join(full.select("reservation_id", item.alias("item")), "reservation_id", "left").groupBy("id", "reservation_id")
    listed = listed.agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
    where = places.groupBy(F.col("query_id").alias("reservation_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "place_name"))), lambda p: p["place_name"]).alias("places"))
    return listed.join(where, "reservation_id", "left")


def apply_outcomes(messages: DataFrame, outcomes: DataFrame, most: int = 3) -> DataFrame:
    """Only messages being sent change: sent, failed for good, or pending again; the third temporary error fails."""
    got = outcomes.select("id", F.col("outcome").alias("__out"))
    temporary = F.when(F.col("attempts") >= most, "failed").otherwise("pending")
    status = F.when(F.col("__out") == "sent", "sent").when(F.col("__out") == "permanent", "failed").when(F.col("__out") == "temporary", temporary)
    joined = messages.join(got, "id", "left")
    return joined.withColumn("status", F.when(F.col("status") == "sending", F.coalesce(status, F.col("status"))).otherwise(F.col("status"))).drop("__out")


def sendable(messages: DataFrame, reservations: DataFrame, now: str) -> DataFrame:
    """Confirmations go to pending reservations of the last 24 hours, all else to active ones."""
    r = reservations.select(F.col("id").alias("reservation_id"), F.col("status").alias("__status"), F.col("created_at").alias("__created"))
    fresh = F.col("__created") > ts(now) - F.expr(DAY)
    ok = F.when(F.col("kind") == "confirm", (F.col("__status") == "pending") & fresh).otherwise(F.col("__status") == "active")
    return messages.join(r, "reservation_id", "left").withColumn("sendable", F.coalesce(ok, F.lit(False))).drop("__status", "__created")


class Closed(NamedTuple):
    """What closing leaves: all reservations, messages, the log of requests, and one row of counts."""

    reservations: DataFrame
    messages: DataFrame
    log: DataFrame
    counts: DataFrame


def close_ended(reservations: DataFrame, messages: DataFrame, log: DataFrame, now: str) -> Closed:
    """reservations(id, status, email, created_at, expires_at), messages(reservation_id, status), log(address, at): active
    ones past their expiry become expired, pending ones of 24 hours unconfirmed, both without their mail and their
    pending messages; entries of the log of 24 hours go. Reservations closed before keep what they have."""
    time = ts(now)
    expired = (F.col("status") == "active") & (F.col("expires_at") <= time)
    late = (F.col("status") == "pending") & (F.col("created_at") <= time - F.expr(DAY))
    ends = F.when(expired, "expired").when(late, "unconfirmed")
    closed = reservations.withColumn("__ends", ends)
    closing = closed.filter("__ends is not null").select(F.col("id").alias("reservation_id"), F.lit(True).alias("__closing"))
    marked = messages.join(closing, "reservation_id", "left").withColumn("__drop", F.coalesce("__closing", F.lit(False)) & (F.col("status") == "pending"))
    old = F.col("at") <= time - F.expr(DAY)
    counts = closed.agg(F.count_if(F.col("__ends") == "expired").alias("expired"), F.count_if(F.col("__ends") == "unconfirmed").alias("unconfirmed_closed"))
    counts = counts.join(F.broadcast(marked.agg(F.count_if("__drop").alias("messages_dropped")))).join(F.broadcast(log.agg(F.count_if(old).alias("request_log_purged"))))
    kept = closed.withColumn("status", F.coalesce("__ends", "status")).withColumn("email", F.when(F.col("__ends").isNull(), F.col("email"))).drop("__ends")
    return Closed(kept, marked.filter(~F.col("__drop")).select(*messages.columns), log.filter(~F.coalesce(old, F.lit(False))), counts)


def step(state: dict, command: str, at) -> dict:
    """One command on one reservation: confirm in 24 hours, extend by 7 days up to three times while live, cancel
    and discard clear the mail. Used by the batch fold and by the stream."""
    live = state["status"] == "active" and at < state["expires_at"]
    if command == "confirm" and state["status"] == "pending" and at < state["created_at"] + timedelta(hours=24):
        state = {**state, "status": "active"}
    elif command == "extend" and live and state["extension_count"] < 3:
        state = {**state, "expires_at": state["expires_at"] + timedelta(days=7), "extension_count": state["extension_count"] + 1}
    elif command == "cancel" and (live or state["status"] == "pending"):
        state = {**state, "status": "cancelled", "email": None}
    elif command == "discard" and state["status"] == "pending":
        state = {**state, "status": "discarded", "email": None}
    return state


def _command_fold(fields: list[str]):
    """Rows sorted by id, a reservation before its commands -> the reservations after all of them, one state at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    done += [state] if state else []
                    state = {f: row[f] for f in fields}
                elif state and state["id"] == row["id"]:
                    state = step(state, row["command"], row["at"])
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([batch.schema.field(f) for f in fields]))
        if state:
            yield pa.RecordBatch.from_pylist([state], schema=pa.schema([batch.schema.field(f) for f in fields]))

    return run


def apply_commands(reservations: DataFrame, commands: DataFrame) -> DataFrame:
    """reservations(id, status, email, created_at, expires_at, extension_count) after commands(id, command, at, seq) in time
    order, ties by seq. Ids are unique; commands of unknown ids do nothing. Each id's rows pass by sorted, and one
    state is held, so neither the number of commands nor their share of the table matters."""
    fields = ["id", "status", "email", "created_at", "expires_at", "extension_count"]
    kinds = dict(reservations.dtypes)
    none = lambda names, df: [F.lit(None).cast(dict(df.dtypes)[c]).alias(c) for c in names]
    rest = ["command", "at", "seq"]
    rows = reservations.select(*fields, F.lit(0).alias("kind"), *none(rest, commands))
    rows = rows.unionByName(commands.select("id", *none(fields[1:], reservations), F.lit(1).alias("kind"), *rest))
    ordered = rows.repartition("id").sortWithinPartitions("id", "kind", "at", "seq")
    return ordered.mapInArrow(_command_fold(fields), ", ".join(f"{f} {kinds[f]}" for f in fields))


def alert_audit(matches: DataFrame, messages: DataFrame) -> DataFrame:
    """One row of counters and a status for a match and send run."""
    found = matches.agg(F.count("*").alias("matched_items"), F.countDistinct("reservation_id").alias("reservations"))
    sent = messages.agg(F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "pending").alias("waiting"))
    status = F.when(F.col("failed") == 0, "succeeded").when(F.col("sent") > 0, "partial").otherwise("failed")
    return found.crossJoin(sent).withColumn("status", status)


