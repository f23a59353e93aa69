"""The prefix trie and the structure repair against plain searches, with nulls, ties, bands, runs and blocks."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from lumafind.llm import conversation_repair as C
from lumafind.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, pos string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def made(seed, n=60, longest=9):
    """Conversations over few turns, so that many share prefixes, with nulls, repeated rows and an extra column."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 2, 3, longest, longest])):
            text = rng.choice(["a b.", "a b.", "c", "", None, "  ", "Hi. there", "a b.\nc!"])
            rows.append((c, rng.choice([t, t, t, t, None]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), text, "x"))
    rows += [(None, 1, "user", "no id.", "x")] * 2 + rows[:3]
    return rows


def trie(rows):
    own = defaultdict(list)
    for c, t, r, x, _ in rows:
        if c is not None:
            own[c].append((-1 if t is None else t, r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    def total(k):
        parts = [total(x) for x in children[k]]
        own_saved = (len(members[k]) - 1) * len(WORDS.findall(k[-1][1])) if k else 0
        return (sum(p[0] for p in parts) or 1, own_saved + sum(p[1] for p in parts))
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(k))
        out.add((m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(children[k]), *total(k), hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed,band,run", [(1, None, P.RUN), (2, 2, 7), (3, 3, 1), (4, 1, 20)])
def test_trie(spark, seed, band, run):
    rows = made(seed)
    found = [tuple(r) for r in P.prefix_trie(spark.createDataFrame(rows, SCHEMA), band, run).collect()]
    assert len(found) == len(set(found)) and set(found) == trie(rows)


def test_trie_of_copies(spark):
    """A group of copies over many runs, beside a long conversation."""
    rows = [(c, t, "user", f"t{t}", "") for c in range(100, 400, 20) for t in range(5)] + [(c, t, "user", f"t{t}", "") for c in range(1000, 1060) for t in range(5)] + [(2001, t, "user", f"l{t % 7}", "") for t in range(50)]
    found = {tuple(r) for r in P.prefix_trie(spark.createDataFrame(rows, SCHEMA), 10, 9).collect()}
    assert found == trie(rows)


def cheapest(sym):
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, labels, i, q = heapq.heappop(heap)
        if i < 0:
            return cost, labels
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(sym) and q in (0, 3):
            heapq.heappush(heap, (cost, labels, -1, 0))
        turn = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 5, labels + "I", i, turn))
        if i < len(sym):
            heapq.heappush(heap, (cost + 2, labels + "D", i + 1, q))
            role, fault = sym[i]
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                heapq.heappush(heap, (cost + 1 + more, labels + "R", i + 1, turn))
                to = {"s": 1, "u": 2, "a": 3}.get(role)
                if to and (to == 1 and q == 0 or to == turn):
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, to))


def repaired(rows):
    own = defaultdict(list)
    ids = {r[0] for r in rows}
    for c, t, r, x, _ in rows:
        r, x = " " if r is None else r, " " if x is None else x
        e = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        new = ("user" if e == 4 else r, "" if e == 1 else re.sub("[.!?]", "", x) if e == 2 else x)
        own[c] += [] if e == 0 else [((-1 if t is None else t), r, x, t, new)] * (2 if e == 3 else 1)
    out = set()
    for c in ids:
        held = sorted(own[c], key=lambda k: k[:3])
        seen, sym, turns = set(), [], [k[3] for k in held if k[3] is not None]
        for *_, (r, x) in held:
            last = x.rstrip(" \t\n\x0b\x0c\r")[-1:]
            sym.append((r[:1], "blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last not in ".!?" else None))
            seen.add((r, x))
        cost, audit = cheapest(sym)
        lines, q, k = [], 0, 0
        for e in audit:
            turn = 3 if q == 2 else 2
            role = {2: "user", 3: "assistant"}[turn]
            if e == "I":
                lines.append(f"{role}:")
                q = turn
                continue
            r, x = held[k][4]
            k += 1
            if e == "K":
                lines.append(f"{r}:{x}")
                q = {"s": 1, "u": 2, "a": 3}[r[0]]
            elif e == "R":
                lines.append(f"{role}:{x}")
                q = turn
        faults = [f for _, f in sym]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(sym, sym[1:]))
        out.add((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed,n,longest", [(5, 80, 9), (6, 6, 200)])
def test_repair(spark, seed, n, longest):
    """The longer ones fill several blocks."""
    rows = made(seed, n, longest)
    found = [tuple(r) for r in C.repair(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(found) == len(set(found)) and set(found) == repaired(rows)


def test_auction_equals_the_plain_search():
    rng = random.Random(8)
    for _ in range(2000):
        text = "".join(rng.choice("suaxSUAXduauaua") for _ in range(rng.randint(1, 10)))
        rows = [(s.lower() if s != "d" else "u", "blank" if s == "d" else "truncated" if s.isupper() else None) for s in text]
        costs, labels, _ = C.solved(text, C.FINAL, True)
        assert (costs[0], labels[0]) == cheapest(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.prefix_trie(none).count() == 0 and C.repair(none).count() == 0
