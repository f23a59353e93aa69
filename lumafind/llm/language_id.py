"""Language identification of mixed texts.

Words are scored for each learned language by smoothed n-gram log-likelihoods kept in
tables of fixed size; the scripts of a word's letters leave only the languages that were seen to write in
them. Viterbi over the word scores, with a penalty for each switch, labels spans; the language that covers
most letters is the text's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, is_fold, let_go, slices

#: Counters a language: n-grams of UTF-8 bytes by hash. 2**16 doubles are 0.5 MB for each language.
BUCKETS = 1 << 16
#: Bytes of words whose n-grams are taken at once.
LOT = 1 << 19
#: Bytes of text that are labelled at a time, or one longer text.
TEXTS = 1 << 21
GRAMS = 4
SWITCH = 4.0
#: First and last code point of letter ranges by script.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("hangul", 0xAC00, 0xD7A3), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF),
)


#: Names of scripts, the greatest first; letters outside the table count as ``other``.
KINDS = sorted([*(name for name, _, _ in SCRIPTS), "other"], reverse=True)
_EDGES = sorted({e for _, a, b in SCRIPTS for e in (a, b + 1)})
_KIND_FROM = np.array([KINDS.index(next((n for n, a, b in SCRIPTS if a <= e <= b), "other")) for e in (0, *_EDGES)])
#: ASCII letters in lower case; other bytes are 0.
_ASCII = np.array([ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else 0 for c in range(256)], np.uint8)


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(c for c in word if c.isalpha()).lower()


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each large string begins and the last one ends, and the bytes of all."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return ends - ends[0], np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]


def cleaned(words: pa.Array) -> pa.Array:
    """The letters of each word; words in ASCII are taken as bytes, all at once."""
    words = words.cast(pa.large_string())
    ends, data = _bytes(words)
    low = _ASCII[data]
    inside = low != 0
    places = np.concatenate(([0], np.cumsum(inside)))[ends]
    plain = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(places), pa.py_buffer(low[inside]))
    wide = pc.invert(pc.string_is_ascii(words))
    return pc.replace_with_mask(plain, wide, pa.array([letters(w) for w in words.filter(wide).to_pylist()], pa.large_string()))


def scripts(words: pa.Array) -> np.ndarray:
    """The script of most letters of each word, by its place in KINDS; the first there among equals."""
    found = np.full(len(words), KINDS.index("latin"))
    wide = np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
    if len(wide):
        own = words.take(pa.array(wide))
        points = np.frombuffer("".join(own.to_pylist()).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(wide)), pc.utf8_length(own).to_numpy())
        kinds = _KIND_FROM[np.searchsorted(_EDGES, points, side="right")]
        found[wide] = np.bincount(owner * len(KINDS) + kinds, minlength=len(wide) * len(KINDS)).reshape(-1, len(KINDS)).argmax(axis=1)
    return found


def grams(words: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n the buckets of the n-grams, in UTF-8 bytes, from each byte of the framed words on (BUCKETS where
    the word ends before), and where each word begins and the last one ends. No word is empty."""
    first, last, between = (pa.scalar(s, words.type) for s in ("^", "$", ""))
    ends, data = _bytes(pc.binary_join_element_wise(first, words, last, between))
    data = data.astype(np.uint64)
    found = []
    h = np.zeros(len(data) + 1, np.uint64)
    for n in range(1, GRAMS + 1):
        h = h[:-1] * np.uint64(0x100000001B3)
        h += data[n - 1 :]
        h += np.uint64(n)
        buckets = np.full(len(data), BUCKETS)
        buckets[: len(h)] = (((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(BUCKETS - 1)).view(np.int64)
        for k in range(1, n):
            buckets[ends[1:] - k] = BUCKETS
        found.append(buckets)
    return found, ends


def _lots(words: pa.Array) -> Iterator[slice]:
    """Runs of words with some LOT bytes, or one longer word."""
    at = 0
    for lot in slices(pa.record_batch([words], ["word"]), 0, LOT):
        yield slice(at, at := at + len(lot))


def _distinct(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of letters, and the place of each word's letters among them, from 1; 0 if it has none."""
    coded = cleaned(words).dictionary_encode()
    some = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    return coded.dictionary.filter(pa.array(some)), np.where(some, np.cumsum(some), 0)[coded.indices.to_numpy()]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go("language")
    tables: dict[str, np.ndarray] = {}
    written: Counter = Counter()
    for whole in batches:
        for batch in slices(whole, 1, TEXTS):
            langs = batch.column(0)
            for lang in langs.unique():
                texts, name = batch.column(1).filter(pc.equal(langs, lang)), lang.as_py()
                table = tables.setdefault(name, np.zeros(BUCKETS))
                found = pc.utf8_split_whitespace(texts).flatten().value_counts()
                words, places = _distinct(found.field(0))
                counts = np.bincount(places, found.field(1).to_numpy(), len(words) + 1)[1:]
                for lot in _lots(words):
                    buckets, ends = grams(words[lot])
                    weights = np.repeat(counts[lot], np.diff(ends))
                    for own in buckets:
                        table += np.bincount(own, weights, BUCKETS + 1)[:BUCKETS]
                totals = np.bincount(scripts(words), counts, len(KINDS))
                for k in np.flatnonzero(totals).tolist():
                    written[name, KINDS[k]] += int(totals[k])
    for lang, table in tables.items():
        #: A language without any letter is a language all the same: one empty counter stands for it.
        used = np.flatnonzero(table) if table.any() else np.zeros(1, np.int64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "script": pa.nulls(len(used), pa.string()), "bucket": pa.array(used, pa.int32()), "n": pa.array(table[used].astype(np.int64))})
    if written:
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in written], pa.string()), "script": pa.array([k[1] for k in written], pa.string()), "bucket": pa.nulls(len(written), pa.int32()), "n": pa.array(written.values(), pa.int64())})


def learn(docs: DataFrame) -> dict:
    """docs(text, lang): counts over all rows with both. The result has a fixed size a language."""
    seen = docs.filter("text is not null and lang is not null").select("lang", "text")
    found = seen.mapInArrow(_features, "lang string, script string, bucket int, n long").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n"))
    tables: dict[str, np.ndarray] = {}
    written: dict[str, dict] = {}
    for r in found.toLocalIterator():
        if r.script is None:
            tables.setdefault(r.lang, np.zeros(BUCKETS))[r.bucket] = r.n
        else:
            written.setdefault(r.lang, {})[r.script] = r.n
    langs = sorted(tables)
    counts = np.array([tables[lang] for lang in langs]).reshape(-1, BUCKETS)
    logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    #: A language writes in a script if at least one word in 500 did.
    writes = {lang: {s for s, n in written.get(lang, {}).items() if 500 * n >= sum(written[lang].values())} for lang in langs}
    return {"langs": langs, "logs": logs.astype(np.float32), "writes": writes}


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.writes = model["langs"], model["writes"]
        #: What lies beyond a word's end adds nothing.
        self.logs = [np.append(table.astype(np.float64), 0.0) for table in model["logs"]]

    def score(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(languages, 1 + words) scores and the words' lengths; place 0 is a word without letters. Scores are mean n-gram
        log-likelihoods times the root of the word's length, so that long words don't drown their neighbours."""
        lengths = np.concatenate(([0], pc.utf8_length(words).to_numpy()))
        scores = np.zeros((len(self.langs), 1 + len(words)), np.float32)
        kinds = scripts(words)
        able = np.array([[name in self.writes[lang] for name in KINDS] for lang in self.langs])
        for lot in _lots(words):
            buckets, ends = grams(words[lot])
            size = np.diff(ends)
            weight = np.sqrt(lengths[1:][lot] + 1) / sum(np.maximum(size - n, 0) for n in range(GRAMS))
            sums = np.stack([np.add.reduceat(sum(table[b] for b in buckets), ends[:-1]) for table in self.logs]) * weight
            for kind in np.unique(kinds[lot]):
                if able[:, kind].any() and not able[:, kind].all():
                    these = np.flatnonzero(kinds[lot] == kind)
                    sums[:, these] = np.where(able[:, [kind]], sums[:, these], sums[:, these].min(axis=0) - 20)
            scores[:, 1:][:, lot] = sums
        return scores, lengths

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The scored place of each word of all texts in a row, where each text's words begin and the last one's end, the
        scores of the places and their lengths."""
        split = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = split.flatten().dictionary_encode()
        words, places = _distinct(coded.dictionary)
        codes = coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))
        #: Leading or trailing white space leaves an empty piece, which is no word.
        worded = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes]
        return places[codes][worded], np.concatenate(([0], np.cumsum(worded)))[ends], *self.score(words)


#: Words of a sequence that are taken in a row, and words before them from which their first state is estimated.
BLOCK, WARM = 192, 32


def _forward(rows: np.ndarray, words: np.ndarray, begin: np.ndarray, last: np.ndarray, before: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run pieces of words, from begin up to last, side by side. before: (labels, pieces) states ahead of them. Returns
    the order of the pieces, (steps, pieces) places of words and (labels, steps, pieces) scores below the best label."""
    order = np.argsort(begin - last, kind="stable")
    sizes = (last - begin)[order]
    at = np.minimum(begin[order] + np.arange(sizes[0])[:, None], last[order] - 1)
    below, state = rows[:, words[at]], before[:, order]
    for t, n in enumerate(np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")):
        now, held = below[:, t, :n], state[:, :n]
        now += held
        now -= now.max(axis=0)
        np.maximum(now, -switch, out=held)
    return order, at, below


def paths(rows: np.ndarray, words: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of the words of many sequences, none of them empty, by Viterbi. rows: (labels, places) scores; words:
    the sequences' places in a row; bounds: where each begins and the last one ends.

    What a word hands on is how far each label lies below the best one, at most ``switch``. Where one label leads all
    others by that much the past is forgotten, so blocks of a sequence start side by side, from a state found over
    WARM words ahead of them. A block whose state isn't exactly what the block before it hands on is run again."""
    lengths = np.diff(bounds)
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), blocks)
    starts = bounds[:-1][owner]
    first = starts + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    last = np.minimum(first + BLOCK, bounds[1:][owner])
    below = np.empty((len(rows), len(words)), rows.dtype)
    assumed = np.zeros((len(rows), len(owner)), rows.dtype)

    def run(which: np.ndarray, begin: np.ndarray) -> None:
        order, at, found = _forward(rows, words, begin, last[which], assumed[:, which], switch)
        begin, which = begin[order], which[order]
        step = np.arange(len(at))[:, None]
        own = (step >= first[which] - begin) & (step < last[which] - begin)
        below[:, at[own]] = found[:, own]
        warm = np.flatnonzero(begin < first[which])
        assumed[:, which[warm]] = np.maximum(found[:, (first[which] - begin)[warm] - 1, warm], -switch)

    run(np.arange(len(owner)), np.maximum(first - WARM, starts))
    later = np.flatnonzero(first > starts)
    while True:
        handed = np.maximum(below[:, first[later] - 1], -switch)
        wrong = np.flatnonzero((handed != assumed[:, later]).any(axis=0))
        if not len(wrong):
            break
        #: Only the first of a sequence: what the next ones get may change with it.
        wrong = wrong[np.unique(owner[later[wrong]], return_index=True)[1]]
        assumed[:, later[wrong]] = handed[:, wrong]
        run(later[wrong], first[later[wrong]])

    tops = below.argmax(axis=0)
    #: For each label and word the last word up to it that a path with this label reached from another one.
    since = np.zeros(below.shape, np.int32 if len(words) < 1 << 31 else np.int64)
    for own, near in zip(since, below):
        left = np.flatnonzero(near[:-1] < -switch) + 1
        own[left] = left
        own[bounds[:-1]] = bounds[:-1]
        np.maximum.accumulate(own, out=own)
    del below
    marks = np.zeros(len(words), bool)
    labels = np.zeros(len(words), np.int32)
    start, at = bounds[:-1], bounds[1:] - 1
    while len(at):
        label = tops[at]
        at = since[label, at]
        marks[at], labels[at] = True, label
        start, at = start[at > start], at[at > start] - 1
    spans = np.flatnonzero(marks)
    return np.repeat(labels[spans], np.diff(np.append(spans, len(words))))


def viterbi(rows: np.ndarray, index: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """``paths`` of the columns of index, (longest, sequences) places. rows: (places, labels) scores. Returns (longest,
    sequences) labels; what lies beyond a sequence's length has no meaning."""
    inside = (np.arange(len(index))[:, None] < lengths).T
    out = np.zeros(index.T.shape, np.int32)
    out[inside] = paths(np.ascontiguousarray(rows.T), index.T[inside], np.concatenate(([0], np.cumsum(lengths))), switch)
    return out.T


#: Scores of words, one a label, that are held while texts are labelled together, or those of one longer text.
PART = 1 << 21


def label_texts(scorer: Scorer, texts: pa.Array, switch: float = SWITCH) -> list[tuple[str, float, list]]:
    """(language, score, spans) of each text; a span is (first word, one past the last word, language)."""
    found: list = [("und", 0.0, [])] * len(texts)
    labels = len(scorer.langs)
    if not labels:
        return found
    flat, bounds, rows, sizes = scorer.places(texts)
    #: A word without letters adds nothing: it goes with the next word that has some, or with the last one.
    real = np.flatnonzero(flat)
    ends = np.searchsorted(real, bounds)
    which = np.flatnonzero(np.diff(ends))
    ends = np.append(ends[which], len(real))
    at = 0
    while at < len(which):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART // labels, side="right")) - 1)
        lot, part = which[at:to], ends[at : to + 1] - ends[at]
        places = real[ends[at] : ends[to]]
        words = flat[places]
        path = paths(rows, words, part, switch)
        text = np.repeat(np.arange(len(lot)), np.diff(part))
        weight = np.bincount(text * labels + path, sizes[words], len(lot) * labels).reshape(-1, labels)
        means = np.stack([np.bincount(text, own[words], len(lot)) for own in rows], axis=1) / np.diff(part)[:, None]
        counts = np.diff(bounds)[lot]
        share = np.exp((means - means.max(axis=1, keepdims=True)) * np.minimum(counts, 20)[:, None])
        best = weight.argmax(axis=1)
        row = np.arange(len(lot))
        scores = weight[row, best] / weight.sum(axis=1) * share[row, best] / share.sum(axis=1)
        edge = np.concatenate(([True], (np.diff(path) != 0) | (np.diff(text) != 0)))
        edge = np.flatnonzero(edge)
        begins = np.where(np.isin(edge, part), 0, places[edge - 1] + 1 - bounds[lot][text[edge]]).tolist()
        spoken, cuts = path[edge].tolist(), np.searchsorted(edge, part).tolist()
        for k, (name, score, count, a, b) in enumerate(zip(best.tolist(), scores.tolist(), counts.tolist(), cuts, cuts[1:])):
            spans = zip(begins[a:b], [*begins[a + 1 : b], count], spoken[a:b])
            found[lot[k]] = (scorer.langs[name], score, [(x, y, scorer.langs[s]) for x, y, s in spans])
        at = to
    return found


def _scorer(model) -> Scorer:
    let_go("language")
    return Scorer(model.value)


def _predict(model, spans: bool, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index("text"), TEXTS):
                found = label_texts(scorer, batch.column("text"))
                columns = [*(batch.column(c) for c in carried), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                if spans:
                    columns.append(pa.array([[{"start": a, "end": b, "lang": s} for a, b, s in f[2]] for f in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, [*carried, "lang_pred", "score"] + ["spans"] * spans)

    return run


def identify(docs: DataFrame, model: dict, spans: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the carried columns, lang_pred, score in 0..1 and, if asked for, spans of
    words by language.

    A null text, one without letters, or an empty model gives ``und`` with score 0 and no spans. Words are
    split at Unicode white space. Null doc_ids and repeated rows stay; further columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select("doc_id", *carried)
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", lang_pred string, score double"
    rows = docs.select("doc_id", *carried, "text")
    return rows.mapInArrow(_predict(sent, spans, kept.columns), schema + ", spans array<struct<start:long,end:long,lang:string>>" * spans)


def keep_identified(docs: DataFrame, model: dict) -> DataFrame:
    """docs without those that have no language (``und``). Columns are those of docs."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent)
        for whole in batches:
            for batch in slices(whole, place, TEXTS):
                yield batch.filter(pa.array([f[0] != "und" for f in label_texts(scorer, batch.column(place))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.filter(~is_fold("doc_id", 0)))
    rows = docs.select("doc_id", is_fold("doc_id", 0).alias("held_out"), "text")
    return identify(rows, model, carried=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")
