"""A trie of conversation prefixes, built as ternary search trees over ranges of sorted conversations.

Turns (role, text) are dictionary-encoded once. A rebuilt conversation is a sequence of codes; sequences longer
than a band (BAND turns, or a 32nd of the longest one) are cut into pieces, each under the digest of the turns before
it. Bands are worked from the deepest one upwards: a band's pieces are range-partitioned and sorted, and each task
cuts its range into runs of bounded size. A run's sequences enter a ternary search tree in median order, which
keeps it balanced; one walk over its nodes from the last made to the first adds up members, leaves and savings.

Only nodes on the path of a run's first or last sequence can have members in other runs. These boundary nodes are
merged by key: each belongs to the first run path that has it, runs along a path are added up from below, and a
node's total is the sum over the paths through it. All other nodes are final in their run.

Defined results: rows without conv_id take no part; null roles and texts are empty; rows of one turn are ordered by
role and text; repeated rows are turns like others; conversations without turns are members of the root; an empty
table gives no nodes; texts of any length are one dictionary entry; further columns are ignored. c % 20 is Spark's
remainder. The members that end at one node are hashed as they stream by, as SHA-256 asks for them in order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import written
from ._turns import WORD, numbered

BAND = 512
#: Bands are at most so many, so that the rounds are bounded for conversations of any length.
BANDS = 32
#: Codes in a run.
RUN = 1 << 17
FAMILY, MOST = 20, 4


def encoded(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, pos, code; dictionary: code, words). Codes are numbers of the distinct turns."""
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = numbered(rows, "conv_id", "turn", "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keyed = placed.select("conv_id", "pos", digest.alias("digest"), F.regexp_count("text", F.lit(WORD + "+")).cast("long").alias("words"))
    dictionary = written(keyed.groupBy("digest").agg(F.max("words").alias("words")).withColumn("code", F.monotonically_increasing_id()), "dictionary")
    return written(keyed.drop("words").join(dictionary, "digest").select("conv_id", "pos", "code", "words"), "codes"), dictionary.select("code", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """turns(conv_id, pos, code, words) -> conv_id, depth from 1, code, words of the rebuilt conversations, and one row
    of depth 0 for each conversation."""
    ids = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    ids = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"), first.alias("h"))
    #: A family has at most twice FAMILY - 1 members (about zero), a head at most MOST - 1 turns to give.
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST)).select(F.col("conv_id").alias("head"), F.col("pos").alias("depth"), "code", "words")
    given = ids.join(heads, "head").filter("depth <= h").select("conv_id", "depth", "code", "words")
    lent = given.groupBy("conv_id").agg(F.count("*").alias("lent"))
    shift = ids.join(lent, "conv_id", "left").select("conv_id", "h", F.coalesce("lent", F.lit(0)).alias("lent"))
    own = turns.join(shift, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), "code", "words")
    none = F.lit(None).cast("long")
    return given.unionByName(own).unionByName(ids.select("conv_id", F.lit(0).cast("long").alias("depth"), none.alias("code"), none.alias("words")))


def pieces(rows: DataFrame, band: int) -> DataFrame:
    """rows of ``rebuilt`` -> conv_id, band, prefix (digest of all earlier bands), codes, words, over (the conversation
    ends here), next (the prefix of the following band, if the conversation has a turn at this band's end). A conversation that ends with a band also has
    an empty piece in the next one, which tells that band of a member."""
    size = F.lit(band)
    ends = rows.filter((F.col("depth") > 0) & (F.col("depth") % band == 0))
    starts = ends.select("conv_id", (F.col("depth") / size).cast("long").alias("band"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("code"), F.lit(None).cast("long").alias("words"))
    dealt = rows.select("conv_id", F.greatest(F.lit(0), ((F.col("depth") - 1) / size).cast("long")).alias("band"), "depth", "code", "words").unionByName(starts)
    listed = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("depth", "code", "words"))))
    held = dealt.groupBy("conv_id", "band").agg(listed.alias("turns"))
    held = held.select("conv_id", "band", F.transform("turns", lambda t: t["code"]).alias("codes"), F.transform("turns", lambda t: t["words"]).alias("words"))
    own = held.withColumn("digest", F.sha2(F.array_join(F.transform("codes", lambda c: c.cast("string")), ","), 256))
    before = F.array_join(F.collect_list("digest").over(Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), ",")
    #: A conversation ends with this piece if it is not full, or if the following piece is empty.
    over = (F.size("codes") < band) | (F.lead(F.size("codes")).over(Window.partitionBy("conv_id").orderBy("band")) == 0)
    told = own.withColumn("before", before).withColumn("over", over)
    follows = F.when(F.size("codes") == band, F.sha2(F.concat_ws(",", F.nullif("before", F.lit("")), "digest"), 256))
    return told.select("conv_id", "band", F.unhex(F.sha2("before", 256)).alias("prefix"), "codes", "words", "over", F.unhex(follows).alias("next"))


class Tree:
    """A ternary search tree: at each node a symbol, links to lesser and greater ones and to the next level. Every node
    stands for one prefix; its number is above its parent's."""

    def __init__(self):
        self.symbol: list = [None]
        self.low, self.same, self.high, self.parent = [0], [0], [0], [-1]
        self.members, self.least, self.words, self.depth = [0], [None], [0], [0]
        self.ends: list[list[int]] = [[]]
        self.below: list[tuple[int, int, int]] = [(0, 0, 0)]

    def insert(self, symbols: list, words: list[int], ids: list[int], ends: list[int], below: tuple[int, int, int]) -> list[int]:
        """Add a sequence with the conversations that have it and those that end with it; returns the path's nodes."""
        path, at = [], 0
        for depth, (s, w) in enumerate(zip(symbols, words)):
            links, node = self.same, self.same[at]
            holder = at
            while node and self.symbol[node] != s:
                links = self.low if s < self.symbol[node] else self.high
                holder, node = node, links[node]
            if not node:
                node = len(self.symbol)
                links[holder] = node
                self.symbol.append(s)
                for column, value in ((self.low, 0), (self.same, 0), (self.high, 0), (self.parent, at), (self.members, 0), (self.least, ids[0]), (self.words, w), (self.depth, depth), (self.ends, []), (self.below, (0, 0, 0))):
                    column.append(value)
            self.members[node] += len(ids)
            if ids[0] < self.least[node]:
                self.least[node] = ids[0]
            path.append(node)
            at = node
        self.ends[at] += ends
        self.below[at] = below
        return path


def median_order(n: int) -> Iterator[int]:
    """0 to n - 1, the median first, then those of both halves."""
    waiting = [(0, n)]
    while waiting:
        a, b = waiting.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            waiting += [(middle + 1, b), (a, middle)]


def digest_of(above: bytes, symbol: int) -> bytes:
    return hashlib.blake2b(above + symbol.to_bytes(8, "little", signed=True), digest_size=16).digest()


def ends_hash(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


NODE = pa.schema([
    ("kind", pa.string()), ("key", pa.binary()), ("up", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("words", pa.int64()), ("path", pa.int64()), ("more_children", pa.int64()), ("more_leaves", pa.int64()), ("more_saved", pa.int64()),
])
NODE_COLUMNS = "kind string, key binary, up binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long, path long, more_children long, more_leaves long, more_saved long"


def run_nodes(rows: list[tuple], start: int, path: int) -> list[tuple]:
    """Nodes of a run of sorted pieces (conv_id, prefix, codes, words, over, below: children, leaves and savings that
    the next band found under the piece) as rows of NODE, ``path`` numbering the first sequence's path and ``path`` + 1
    the last one's. Kinds: ``node`` (final), ``open`` (on a boundary path; its numbers are those of the run without
    other open nodes and without the next band), ``end`` (a member that ends at an open node)."""
    distinct: list[tuple] = []
    for conv, prefix, codes, words, over, below in rows:
        if not (distinct and distinct[-1][0] == prefix and distinct[-1][1] == codes):
            distinct.append((prefix, codes, words, [], [], below))
        distinct[-1][3].append(conv)
        if over:
            distinct[-1][4].append(conv)
    prefixes = sorted({d[0] for d in distinct})
    tree, paths = Tree(), {}
    for k in median_order(len(distinct)):
        prefix, codes, words, ids, ends, below = distinct[k]
        found = tree.insert([bisect_left(prefixes, prefix), *codes], [0, *words], ids, ends, below)
        if k in (0, len(distinct) - 1):
            paths[k] = set(found)
    first, last = paths[0], paths[len(distinct) - 1]
    n = len(tree.symbol)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    keys: list[bytes] = [b""] * n
    for v in range(1, n):
        keys[v] = digest_of(keys[tree.parent[v]], tree.symbol[v]) if tree.depth[v] else prefixes[tree.symbol[v]]
    out: list[tuple] = []
    for v in range(n - 1, 0, -1):
        up, more, inner = tree.parent[v], tree.below[v], tree.depth[v] > 0
        if v in first or v in last:
            head = ("open", keys[v], keys[up] if inner else None, start + tree.depth[v], tree.least[v], None)
            sides = [side for side, nodes in enumerate((first, last)) if v in nodes]
            out.append((*head, tree.members[v], children[v], leaves[v], saved[v], None, tree.words[v], path + sides[0], *more))
            out += [("end", keys[v], None, None, c, *[None] * 11) for c in tree.ends[v]]
            if len(sides) > 1:  # the other path has the node, but none of its numbers
                out.append((*head, 0, 0, 0, 0, None, tree.words[v], path + 1, *more))
            continue
        children[v] += more[0]
        leaves[v] = leaves[v] + more[1] if children[v] else 1
        saved[v] += more[2] + (tree.members[v] - 1) * tree.words[v]
        closed = inner and not (up in first or up in last)
        if inner:
            children[up] += 1
            leaves[up] += leaves[v]
            saved[up] += saved[v]
        parent = (None, tree.least[up]) if closed else (keys[up] if inner else None, None)
        out.append(("node", keys[v], parent[0], start + tree.depth[v], tree.least[v], parent[1], tree.members[v], children[v], leaves[v], saved[v], ends_hash(tree.ends[v]), None, None, None, None, None))
    return out


def _shard(start: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def built() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*run_nodes(rows, start, (part << 32) + 2 * runs)), NODE.types)], schema=NODE)

        for batch in batches:
            for conv, prefix, codes, words, over, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append((conv, prefix, codes, words, over, (children or 0, leaves if children else 0, saved or 0)))
                size += len(codes) + 1
                if size >= most:
                    yield built()
                    rows, size, runs = [], 0, runs + 1
        if rows:
            yield built()

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) -> key, hash of its ids, as they stream by."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, c in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is None or k != key:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(str(c).encode())
            else:
                digest.update(b"," + str(c).encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "sha"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["key", "sha"])


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def merged(nodes: DataFrame) -> DataFrame:
    """Final and boundary nodes of all runs -> key, and the columns of RESULT."""
    open_ = nodes.filter("kind = 'open'")
    owner = F.min("path").alias("owner")
    sums = (F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    each = open_.groupBy("key").agg(F.first("up").alias("up"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, *(F.max(c).alias(c) for c in ("words", "more_children", "more_leaves", "more_saved")), owner)
    each = written(each, "boundary")
    inner = each.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("open_children"))
    each = each.join(inner, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)) + F.col("more_children"))
    own = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves") + F.col("more_leaves"))
    each = each.select("key", "up", "depth", "conv_id", "n_convs", "n_children", own.alias("leaves"), (F.col("saved_tokens") + F.col("more_saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"), "owner")
    mine = F.col("owner") == F.col("path")
    along = open_.select("key", "path", F.col("depth").alias("d")).distinct().join(each.select("key", "leaves", "saved", "owner"), "key")
    below = Window.partitionBy("path").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    along = along.select("key", *(F.sum(F.when(mine, F.col(c)).otherwise(0)).over(below).alias(c) for c in ("leaves", "saved")))
    totals = along.groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = nodes.filter("kind = 'end'").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, "key binary, sha string")
    above = each.select(F.col("key").alias("up"), F.col("conv_id").alias("above"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    shared = each.drop("leaves", "saved").join(totals, "key").join(ends, "key", "left").join(above, "up", "left").withColumnRenamed("above", "parent_conv_id").withColumn("ends_sha256", F.coalesce("sha", empty))
    final = nodes.filter("kind = 'node'").join(above, "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return final.select("key", *RESULT).unionByName(shared.select("key", *RESULT))


def prefix_trie(conversations: DataFrame, band: int | None = None, run: int = RUN) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row for each node of the trie of rebuilt conversations: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. See the module
    for nulls, ties and other cases."""
    turns, _ = encoded(conversations)
    rows = written(rebuilt(turns), "rebuilt")
    longest = rows.agg(F.max("depth").alias("n")).first().n
    if longest is None:
        return rows.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    band = band or max(BAND, -(-longest // BANDS))
    held = written(pieces(rows, band), "pieces")
    below, found = None, []
    for k in range(longest // band, -1, -1):
        mine = held.filter(F.col("band") == k)
        if below is None:
            none = F.lit(None).cast("long")
            mine = mine.select("conv_id", "prefix", "codes", "words", "over", none.alias("children"), none.alias("leaves"), none.alias("saved"))
        else:
            mine = mine.join(below, mine.next == below.key, "left").select("conv_id", "prefix", "codes", "words", "over", "children", "leaves", "saved")
        order = ("prefix", "codes", "conv_id")
        nodes = written(mine.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shard(k * band, run), NODE_COLUMNS), "nodes")
        done = written(merged(nodes), "trie")
        if k:
            below = done.filter(F.col("depth") == k * band).select("key", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
            done = done.filter(F.col("depth") > k * band)
        found.append(done)
    trie = found[0]
    for more in found[1:]:
        trie = trie.unionByName(more)
    return trie.select(*RESULT)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
