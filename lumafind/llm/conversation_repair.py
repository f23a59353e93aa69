"""Repair of conversation structure by the auction shortest-path algorithm.

A conversation's rows and four states (nothing kept, a system turn, a user turn, an assistant turn kept last) span
a lattice; edits are arcs of integer cost: Keep, Rerole, Delete a row, Insert a turn. The auction algorithm keeps
a path from the origin and a price at each node that no arc undercuts: at the path's end it extends along the
cheapest arc if the node's price allows, or else raises the price and contracts. Where it has reached the
destination, the prices are a dual solution, every arc of a cheapest path is tight, and the trace follows tight
arcs that lead on to the destination, the ASCII-least label first.

Conversations are cut into blocks of BLOCK rows. In those of several blocks each block is solved between all pairs
of states on its own, the costs to go are chained from the last block backwards, and each block is then traced
from every state it may be entered in; only a few numbers and labels a block pass through a conversation's chain.

Defined results: nulls in role or text are one space, in the id or turn one space where the damage is drawn; rows
without conv_id are one conversation; rows of one turn are taken by role and text before damage; repeated rows are
rows like others. A role whose first character is none of s, u, a (or which is empty) can't be kept, only reroled
or deleted. Texts of any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written
from ._turns import WORD, numbered

BLOCK = 64
#: Fixed values of the cost lattice.
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: States: nothing kept, system, user, assistant kept last. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 50
FINAL = (0, FAR, FAR, 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, was_role, was_text (what orders rows of one turn), copy, role and text after the damage."""
    kept = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("was_role"), F.coalesce("text", F.lit(" ")).alias("was_text"))
    blank = F.lit(" ")
    drawn = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    rows = kept.withColumn("drawn", drawn).filter("drawn <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("drawn") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


def after(rows: DataFrame) -> DataFrame:
    """Role and text of damaged rows."""
    text = F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.regexp_replace("was_text", "[.!?]", "")).otherwise(F.col("was_text"))
    return rows.select("conv_id", "turn", "pos", F.when(F.col("drawn") == 4, "user").otherwise(F.col("was_role")).alias("role"), text.alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, pos, role, text) -> conv_id, turn, pos, initial, fault: blank, duplicate, truncated, or null.
    Whether a role and text were seen earlier is a join on their digests, so no conversation is sorted anew."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    flags = rows.select("conv_id", "turn", "pos", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(WORD)).alias("blank"), (~ended).alias("cut"), digest.alias("digest"))
    first = flags.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("g")).agg(F.min("pos").alias("first"))
    joined = flags.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("g")))
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return joined.select("conv_id", "turn", "pos", "initial", fault.alias("fault"))


def symbol() -> Column:
    """One character a row: d if it must be deleted, else the role's initial (x for others), upper case if truncated."""
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("x"))
    return F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)


def blocks(rows: DataFrame) -> DataFrame:
    """rows(conv_id, pos, initial, fault) -> conv_id, block, symbols, illegal. A block also sees the last row before it."""
    block = ((F.col("pos") - 1) / BLOCK).cast("long")
    there = F.when(F.col("pos") % BLOCK == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = rows.select("conv_id", "pos", "initial", symbol().alias("symbol"), block.alias("block"), F.explode(there).alias("next"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "initial", F.when(F.col("next") == 0, F.col("symbol")).otherwise("").alias("symbol"))))
    held = dealt.groupBy("conv_id", (F.col("block") + F.col("next")).alias("block")).agg(listed.alias("rows"))
    pairs = F.zip_with(F.slice("rows", 1, F.size("rows") - 1), F.slice("rows", 2, F.size("rows")), lambda a, b: F.concat(a["initial"], b["initial"]))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))
    found = held.select("conv_id", "block", F.array_join(F.transform("rows", lambda r: r["symbol"]), "").alias("symbols"), illegal.cast("long").alias("illegal"))
    return found.filter("symbols <> ''")


def lattice(symbols: str, ends: tuple[int, ...], last: bool) -> tuple[list[list[tuple[str, int, int]]], int]:
    """Arcs (label, cost, to) of each node, node 4 * row + state, labels in ASCII order, and the destination. ``ends``:
    what it costs to go on from each state. Turns are inserted before a row, after all rows only in a last block.
    Arcs to nodes that can't reach the destination are left out."""
    n = len(symbols)
    goal = 4 * (n + 1)
    arcs: list[list[tuple[str, int, int]]] = [[] for _ in range(goal + 1)]
    alive = [False] * goal + [True]
    for i in range(n, -1, -1):
        row = symbols[i] if i < n else ""
        extra = CUT if row.isupper() else 0
        for q in (ASSISTANT, USER, SYSTEM, START):
            turn = ASSISTANT if q == USER else USER
            found = []
            if i == n and ends[q] < FAR:
                found.append(("", ends[q], goal))
            if row:
                found.append(("D", DELETE, 4 * (i + 1) + q))
            if row or last:
                found.append(("I", INSERT, 4 * i + turn))
            if row and row != "d":
                kept = {"s": SYSTEM if q == START else None, "u": USER if turn == USER else None, "a": ASSISTANT if q == USER else None}.get(row.lower())
                if kept is not None:
                    found.append(("K", extra, 4 * (i + 1) + kept))
                found.append(("R", REROLE + extra, 4 * (i + 1) + turn))
            arcs[4 * i + q] = found
        #: Insertions lead on within the layer, so reachability settles in a few rounds.
        for _ in range(4):
            for q in range(4):
                alive[4 * i + q] = alive[4 * i + q] or any(alive[to] for _, _, to in arcs[4 * i + q])
    return [[arc for arc in found if alive[arc[2]]] for found in arcs], goal


def auction(arcs: list[list[tuple[str, int, int]]], origin: int, goal: int, price: list[int]) -> int:
    """Cost of the cheapest path from the origin, or FAR. Raises ``price`` in place; it stays below every arc's cost
    plus the price at its end, so that prices serve for further origins."""
    if not arcs[origin]:
        return FAR
    path = [origin]
    while (at := path[-1]) != goal:
        least, to = FAR, goal
        for _, cost, there in arcs[at]:
            if cost + price[there] < least:
                least, to = cost + price[there], there
        if price[at] < least:
            price[at] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return price[origin] - price[goal]


def trace(arcs: list[list[tuple[str, int, int]]], origin: int, goal: int, price: list[int]) -> tuple[str, int]:
    """The ASCII-least labels along tight arcs from the origin to the destination, and the state at the end."""
    leads: dict[int, bool] = {goal: True}
    stack = [origin]
    while stack:  # which nodes lead on to the destination along tight arcs; these make no cycle, as inserting costs
        at = stack[-1]
        if at in leads:
            stack.pop()
            continue
        tight = [to for _, cost, to in arcs[at] if price[at] == cost + price[to]]
        waiting = [to for to in tight if to not in leads]
        if waiting:
            stack += waiting
        else:
            leads[at] = any(leads[to] for to in tight)
            stack.pop()
    labels, at = [], origin
    while True:
        label, _, to = next(arc for arc in arcs[at] if price[at] == arc[1] + price[arc[2]] and leads.get(arc[2]))
        if to == goal:
            return "".join(labels), at % 4
        labels.append(label)
        at = to


@lru_cache(1 << 14)
def solved(symbols: str, ends: tuple[int, ...], last: bool) -> tuple[tuple[int, ...], tuple[str, ...], tuple[int, ...]]:
    """For each state a block may be entered in: the cost to go, the labels and the state at its end."""
    arcs, goal = lattice(symbols, ends, last)
    price = [0] * len(arcs)
    costs = tuple(auction(arcs, q, goal, price) for q in range(4))
    traces = [trace(arcs, q, goal, price) if cost < FAR else ("", START) for q, cost in enumerate(costs)]
    return costs, tuple(t for t, _ in traces), tuple(e for _, e in traces)


@lru_cache(1 << 12)
def crossings(symbols: str) -> tuple[int, ...]:
    """Costs through an inner block from each state (rows of four) to each state."""
    ends = [tuple(0 if k == q else FAR for k in range(4)) for q in range(4)]
    found = []
    for e in ends:
        arcs, goal = lattice(symbols, e, False)
        price = [0] * len(arcs)
        found.append([auction(arcs, q, goal, price) for q in range(4)])
    return tuple(found[to][q] for q in range(4) for to in range(4))


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        through = [None if block == most else crossings(symbols) for block, symbols, most in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(through, pa.list_(pa.int64()))], ["conv_id", "block", "symbols", "most", "through"])


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the last one: what it costs to go on after each."""
    ends = FINAL
    for batch in batches:
        found = []
        for block, symbols, most, through in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            ends = FINAL if block == most else ends
            found.append(ends)
            if block == most and block:
                ends = solved(symbols, FINAL, True)[0]
            elif block:
                ends = tuple(min(FAR, *(through[4 * q + to] + ends[to] for to in range(4))) for q in range(4))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.int64()))], ["conv_id", "block", "symbols", "most", "ends"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for block, symbols, most, ends in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            #: Only differences between the ends matter to the trace; prices then start near the costs.
            base = min(ends)
            costs, labels, states = solved(symbols, tuple(e if e >= FAR else e - base for e in ends), block == most)
            found.append(([c if c >= FAR else c + base for c in costs], labels, states))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.string(), pa.int64())))], ["conv_id", "block", "costs", "traces", "states"])


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the first one: the labels from the state it is entered in, and that state."""
    state = START
    for batch in batches:
        chosen, entered, costs = [], [], []
        for block, cost, traces, states in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            state = START if block == 0 else state
            entered.append(state)
            chosen.append(traces[state])
            costs.append(cost[START] if block == 0 else None)
            state = states[state]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chosen, pa.string()), pa.array(entered, pa.int32()), pa.array(costs, pa.int64())], ["conv_id", "block", "labels", "entered", "cost"])


def edits(rows: DataFrame) -> DataFrame:
    """blocks -> conv_id, block, labels (the block's edits), entered (the state before it), cost (of the whole
    conversation, on its first block)."""
    kind = dict(rows.dtypes)["conv_id"]
    most = rows.groupBy(F.col("conv_id").alias("c")).agg(F.max("block").alias("most"))
    marked = rows.join(most, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "block", "symbols", "most")
    through = marked.mapInArrow(_crossed, f"conv_id {kind}, block long, symbols string, most long, through array<long>")
    chained = through.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    ends = chained.mapInArrow(_backwards, f"conv_id {kind}, block long, symbols string, most long, ends array<long>")
    traced = ends.repartition("conv_id", "block").mapInArrow(_traced, f"conv_id {kind}, block long, costs array<long>, traces array<string>, states array<long>")
    ordered = traced.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return ordered.mapInArrow(_forwards, f"conv_id {kind}, block long, labels string, entered int, cost long")


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted edits and rows of each conversation, a block's edits before its rows -> conv_id, repaired_sha256. A
    conversation is hashed as it streams by; only one block's labels are held."""
    names = {USER: "user", ASSISTANT: "assistant"}
    conv, digest, count = None, None, 0
    labels, at, state = "", 0, START

    def line(text: str) -> None:
        nonlocal count
        digest.update((("\n" if count else "") + text).encode("utf-8", "surrogatepass"))
        count += 1

    def insertions() -> None:
        nonlocal at, state
        while at < len(labels) and labels[at] == "I":
            state = ASSISTANT if state == USER else USER
            line(names[state] + ":")
            at += 1

    for batch in batches:
        done: list[tuple] = []
        for key, role, text, given, entered in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6))):
            if digest is None or key != conv:
                if digest is not None:
                    insertions()
                    done.append((conv, digest.hexdigest()))
                conv, digest, count, labels, at = key, hashlib.sha256(), 0, "", 0
            if given is not None:
                insertions()
                labels, at, state = given, 0, entered
                continue
            insertions()
            edit, at = labels[at], at + 1
            if edit == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                line(f"{role}:{text}")
            elif edit == "R":
                state = ASSISTANT if state == USER else USER
                line(f"{names[state]}:{text}")
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.column(0).type), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])
    if digest is not None:
        insertions()
        yield pa.RecordBatch.from_arrays([pa.array([conv], batch.column(0).type), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text), damaged first -> the audit of every conv_id: gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. See the module for nulls, ties and other cases."""
    kind = dict(conversations.dtypes)["conv_id"]
    rows = after(numbered(damaged(conversations), "conv_id", "turn", "was_role", "was_text", "copy"))
    narrow = written(faults(rows), "faults")
    held = written(blocks(narrow), "blocks")
    chosen = written(edits(held), "edits")
    merged = rows.select("conv_id", "pos", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("labels"), F.lit(None).cast("int").alias("entered"))
    merged = merged.unionByName(chosen.select("conv_id", (F.col("block") * BLOCK + 1).alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "labels", "entered"))
    hashed = merged.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind").mapInArrow(_mended, f"conv_id {kind}, repaired_sha256 string")
    each = narrow.groupBy("conv_id", "turn").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    whole = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = each.groupBy("conv_id").agg(whole.alias("gaps"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))
    illegal = held.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    audits = chosen.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "labels"))), lambda b: b["labels"]), "").alias("audit"))
    found = conversations.select("conv_id").distinct()
    for k, side in enumerate((counts, illegal, audits, hashed)):
        found = found.join(side.withColumnRenamed("conv_id", f"__c{k}"), F.col("conv_id").eqNullSafe(F.col(f"__c{k}")), "left")
    numbers = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
