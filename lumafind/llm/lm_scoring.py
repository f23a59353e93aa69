"""Language-model scores from the subword lattice of an existing piece vocabulary.

The vocabulary file's scores weight its pieces: as they are ranks, a piece's weight is one over one plus its rank,
and the weights are scaled to a distribution once. A word's lattice probability is the sum over all its
segmentations into pieces, by forward recursion in log space; pieces never cross a space, so the words of a
text and its end are independent, and each distinct word is solved once, in a table of all words.

The model's probability of a word joins what was counted to that: (c + A * lattice) / (N + A), with its count
c among the N training tokens and A = 0.5 * (V + 1) for V distinct ones, the mass that the base score spreads
evenly. The marginal probability of a text by the lattice alone is returned beside it.

The base score is a word unigram with add-half smoothing. Values of the HEAD most frequent words are
broadcast; the rest of each text's words meet theirs in a join on the word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, is_fold, slices, written

#: Words whose values are broadcast: at most 2**17, none longer than LONGEST bytes.
HEAD = 1 << 17
LONGEST = 64
FLUSH = 300_000
END = b""
SPACE = "▁"


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words in UTF-8 with A-Z lower-cased, ended by 0x20 and 0x09-0x0D, of all texts, and the text of each."""
    #: Lowered before it is widened: of a widened slice of an array the kernel reads the wrong bytes.
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    owner = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy())
    real = pc.not_equal(words.flatten(), "")
    return words.flatten().filter(real).cast(pa.large_binary()), owner[real.to_numpy(zero_copy_only=False)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    trained: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64()), "c": pa.array([trained[w] for w in counts], pa.int64())})

    for whole in batches:
        for batch in slices(whole, 1):
            for into, texts in ((counts, batch.column(1)), (trained, batch.column(1).filter(batch.column(0)))):
                found = _split(texts)[0].value_counts()
                into.update(dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist())))
                into[END] += len(texts)
            if len(counts) > FLUSH:
                yield rows()
                counts.clear(), trained.clear()
    if counts:
        yield rows()


def vocabulary_weights(path: str) -> dict:
    """Log probabilities of the vocabulary's pieces and bytes, from the file's scores alone."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [k for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k))]
    weight = {k: 1 / (1 - min(0.0, model.get_score(k))) for k in usable}
    total = math.log(sum(weight.values()))
    logs = {k: math.log(w) - total for k, w in weight.items()}
    pieces = {model.id_to_piece(k): logs[k] for k in usable if not model.is_byte(k)}
    return {"pieces": pieces, "bytes": {int(model.id_to_piece(k)[3:5], 16): logs[k] for k in usable if model.is_byte(k)}}


#: Longest word, in characters, that is solved beside others, and the base of the hash by which pieces are known.
TOGETHER = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(48)


class Lattice:
    """Log probabilities of words: the sum over all their segmentations, by forward recursion in log space. Words
    of up to TOGETHER characters go through it side by side, one place after the other; longer ones alone."""

    def __init__(self, model: dict):
        self.bytes, self.pieces = model["bytes"], model["pieces"]
        self.longest = max(map(len, self.pieces), default=1)
        by_length: dict[int, list[tuple[str, float]]] = {}
        for piece, log in self.pieces.items():
            by_length.setdefault(len(piece), []).append((piece, log))
        #: Logs of single characters by code point, found when first met.
        self.singles = np.full(0x110000, np.nan)
        #: For each length above one: the hash's factor, a mark for the leading 16 bits of the hashes, the hashes, the logs.
        self.tables: dict[int, tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted(by_length.keys() - {1}):
            pieces, logs = zip(*by_length[length])
            hashes = self._hashes(self._letters(pieces, length))[-1]
            order = np.argsort(hashes)
            marks = np.zeros(1 << 16, bool)
            marks[(hashes >> _SHIFT).astype(np.int64)] = True
            self.tables[length] = np.uint64(pow(int(BASE), length, 1 << 64)), marks, hashes[order], np.array(logs)[order]

    def single(self, c: str) -> float:
        """A character's piece, or else its bytes."""
        log = self.pieces.get(c)
        return sum(self.bytes.get(b, -20.0) for b in c.encode(errors="replace")) if log is None else log

    @staticmethod
    def _letters(texts, length: int) -> np.ndarray:
        """Code points by place and text, 0 beyond a text's end."""
        return np.ascontiguousarray(np.array(texts, f"U{length}").view(np.uint32).reshape(len(texts), length).T)

    @staticmethod
    def _hashes(letters: np.ndarray) -> np.ndarray:
        """Running hashes after 0, 1, ... places."""
        out = np.zeros((letters.shape[0] + 1, letters.shape[1]), np.uint64)
        for k, row in enumerate(letters):
            out[k + 1] = out[k] * BASE + row + np.uint64(1)
        return out

    def together(self, texts: list[str]) -> np.ndarray:
        """texts by falling length, each with a character at least."""
        lengths = np.array([len(t) for t in texts])
        letters = self._letters(texts, lengths[0])
        hashes = self._hashes(letters)
        alone = self.singles[letters]
        if (new := np.isnan(alone)).any():
            for c in np.unique(letters[new]).tolist():
                self.singles[c] = self.single(chr(c))
            alone = self.singles[letters]
        reached = np.zeros(hashes.shape)
        for end in range(1, lengths[0] + 1):
            live = int(np.searchsorted(-lengths, -end, side="right"))
            here = reached[end - 1, :live] + alone[end - 1, :live]
            for length, (factor, marks, own, logs) in self.tables.items():
                if length > end:
                    break
                found = hashes[end, :live] - hashes[end - length, :live] * factor
                rows = np.flatnonzero(marks[(found >> _SHIFT).astype(np.int64)])
                at = np.minimum(np.searchsorted(own, found[rows]), len(own) - 1)
                exact = own[at] == found[rows]
                rows, at = rows[exact], at[exact]
                here[rows] = np.logaddexp(here[rows], reached[end - length, rows] + logs[at])
            reached[end, :live] = here
        return reached[lengths, np.arange(len(texts))]

    def alone(self, text: str) -> float:
        """The same for one text of any length, character by character."""
        reached = [0.0]
        for end in range(1, len(text) + 1):
            ways = [reached[end - 1] + self.single(text[end - 1])]
            ways += [reached[end - k] + log for k in range(2, min(end, self.longest) + 1) if (log := self.pieces.get(text[end - k : end])) is not None]
            top = max(ways)
            reached.append(top if len(ways) == 1 else top + math.log(sum([math.exp(x - top) for x in ways])))
        return reached[-1]

    def words(self, words: list[str]) -> np.ndarray:
        texts = [SPACE + w for w in words]
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        #: Code point 0 pads shorter texts, so a text that ends with it goes alone.
        side = [k for k in order if len(texts[k]) <= TOGETHER and texts[k][-1] != "\0"]
        beside = set(side)
        out = np.zeros(len(texts))
        if side:
            out[side] = self.together([texts[k] for k in side])
        for k in order:
            if k not in beside:
                out[k] = self.alone(texts[k])
        return out

    def word(self, word: str) -> float:
        return float(self.words([word])[0])


def _solve(path: str):
    """Natural log of each word's lattice probability; the end has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary_weights(path))
        for batch in batches:
            words = [w.decode(errors="replace") for w in batch.column(0).to_pylist()]
            logs = np.where([w != "" for w in words], lattice.words(words), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], ["word", "n", "c", "lattice"])

    return run


def word_table(docs: DataFrame, path: str) -> DataFrame:
    """docs(held_out, text) -> word, n (uses in all texts), c (uses in training), lattice: one row for each
    distinct word, with the end of a text as the empty word. A null held_out counts as held out."""
    rows = docs.select(F.coalesce(~F.col("held_out"), F.lit(False)).alias("trains"), "text")
    counts = rows.mapInArrow(_count, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return written(counts.mapInArrow(_solve(path), "word binary, n long, c long, lattice double"), "words")


class Model:
    """Log10 shares of words from their training counts and lattice values."""

    def __init__(self, total: int, distinct: int, ends: int):
        self.total, self.floor, self.mass = total, total + 0.5 * (distinct + 1), 0.5 * (distinct + 1)
        #: The end's part of the mass that the lattice spreads.
        self.end = ends / total if total else 0.5

    def values(self, c: np.ndarray, lattice: np.ndarray, is_end: np.ndarray) -> dict[str, np.ndarray]:
        spread = np.where(is_end, np.log(max(self.end, 1e-300)), lattice + np.log(max(1 - self.end, 1e-300)))
        unseen = np.log(self.mass) + spread
        score = np.where(c > 0, np.logaddexp(np.log(np.maximum(c, 1)), unseen), unseen) - np.log(self.total + self.mass)
        return {"known": (c > 0).astype(np.float64), "base": np.log10((c + 0.5) / self.floor), "score": score / math.log(10), "lattice": np.where(is_end, np.log(max(self.end, 1e-300)), lattice) / math.log(10)}


VALUES = ("known", "base", "score", "lattice")


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table, end = sent.value
        place = {w: k for k, w in enumerate(words)}
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, 2):
                found, owner = _split(batch.column(2))
                coded = found.dictionary_encode()
                own = coded.dictionary.to_pylist()
                at = np.fromiter((place.get(w, -1) for w in own), np.int64, len(own))[coded.indices.to_numpy()]
                known, size = at >= 0, batch.num_rows
                sums = [np.bincount(owner[known], table[v][at[known]], size) + end[v] for v in VALUES]
                key, times = np.unique(owner[~known] * np.int64(max(len(own), 1)) + coded.indices.to_numpy()[~known], return_counts=True)
                text, code = key // max(len(own), 1), key % max(len(own), 1)
                rest = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code)).cast(pa.binary()), pa.array(times.astype(np.int64))], ["word", "k"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(size + 1)), pa.int32()), rest)
                columns = [pa.array(row + np.arange(size)), batch.column(0), batch.column(1), pa.array(np.bincount(owner, minlength=size) + 1), *(pa.array(x) for x in sums), lists]
                row += size
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", *VALUES, "rest"])

    return run


def _valued(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, c, lattice = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("k", "c", "lattice"))
            found = model.values(c, lattice, np.zeros(len(c), bool))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(k * found[v]) for v in VALUES)], ["row", *VALUES])

    return run


def score_texts(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, held_out, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    lattice_score; learned from the rows that are not held out.

    A null text is empty: one token, its end. Null doc_ids and repeated rows stay; without training rows all
    counts are 0 and the score is the lattice's; an empty table gives no rows; other columns are ignored.
    """
    table = word_table(docs, path)
    facts = table.agg(F.sum("c").alias("total"), F.count_if(F.col("c") > 0).alias("distinct"), F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).first()
    model = Model(facts.total or 0, facts.distinct, facts.ends or 0)
    short = table.filter(F.length("word").between(1, LONGEST))
    room, least = HEAD, 1 << 62
    for r in short.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if r.words > room:
            break
        room, least = room - r.words, r.n
    top = short.filter(F.col("n") >= least).toArrow()
    words, c, lattice = top.column("word").to_pylist(), top.column("c").to_numpy(), top.column("lattice").to_numpy()
    end = {v: float(x[0]) for v, x in model.values(np.array([facts.ends or 0]), np.zeros(1), np.ones(1, bool)).items()}
    sent = docs.sparkSession.sparkContext.broadcast((words, model.values(c, lattice, np.zeros(len(c), bool)), end))
    kind = dict(docs.dtypes)["doc_id"]
    sums = ", ".join(f"{v} double" for v in VALUES)
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, {sums}, rest array<struct<word:binary,k:long>>"
    rows = written(docs.select("doc_id", "held_out", "text").mapInArrow(_score(sent), schema), "scored")
    rest = rows.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.k")
    each = rest.join(table, "word").select("row", "k", "c", "lattice").mapInArrow(_valued(model), f"row long, {sums}")
    more = each.groupBy("row").agg(*(F.sum(v).alias("more_" + v) for v in VALUES))
    total = {v: F.col(v) + F.coalesce("more_" + v, F.lit(0.0)) for v in VALUES}
    return rows.drop("rest").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", F.round(total["known"]).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        total["base"].alias("base_score"), total["score"].alias("score"), total["lattice"].alias("lattice_score"),
    )


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    return score_texts(docs.select("doc_id", is_fold("doc_id", 1).alias("held_out"), "text"), public_tokenizers.path("piece_bpe_32k.model"))
