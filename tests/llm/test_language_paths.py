"""Language identification in vector form against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumafind.llm import language_id

WORDS = ["The", "of", "Straße,", "été", "12", "...", "и", "слово", "日本語", "カナ漢字", "x" * 300, "naïve-ish", "ΟΔΟΣ", "a1b2é3"]


def texts(n):
    rnd = random.Random(11)
    return [None, "", " \n", "12 ...", " é ", *(" ".join(rnd.choices(WORDS, k=rnd.randint(1, 40))) for _ in range(n))]


def plain_buckets(word):
    framed = f"^{word}$".encode()
    for n in range(1, language_id.GRAMS + 1):
        for at in range(len(framed) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x100000001B3 + framed[at + k] + k + 1) % 2**64
            yield (h * 0x9E3779B97F4A7C15 % 2**64 >> 40) % language_id.BUCKETS


def plain_script(word):
    named = Counter(next((n for n, a, b in language_id.SCRIPTS if a <= ord(c) <= b), "other") for c in word)
    return max(named, key=lambda n: (named[n], n))


def plain_path(scores, switch):
    best, back = scores[0], []
    for row in scores[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back.append(np.where(stay, np.arange(len(row)), top))
        best = np.where(stay, best, best[top] - switch) + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


@pytest.fixture
def model():
    rng = np.random.default_rng(2)
    logs = rng.normal(-11, 2, size=(3, language_id.BUCKETS)).astype(np.float32)
    return {"langs": ["a", "b", "c"], "logs": logs, "writes": {"a": {"latin", "greek"}, "b": {"latin", "cyrillic"}, "c": {"latin", "han", "kana"}}}


def test_a_task_counts_ngrams_and_passes_no_words_on():
    rows = [(k % 2, t) for k, t in enumerate(texts(40)) if t is not None] + [(2, "12 ...")]
    batch = pa.RecordBatch.from_pydict({"lang": [str(k) for k, _ in rows], "text": [t for _, t in rows]})
    found = [r for b in language_id._features(iter([batch])) for r in b.to_pylist()]
    want = Counter()
    for lang, text in rows:
        for word in filter(None, map(language_id.letters, text.split())):
            want[str(lang), plain_script(word), None] += 1
            want.update((str(lang), None, b) for b in plain_buckets(word))
    assert Counter({(r["lang"], r["script"], r["bucket"]): r["n"] for r in found if r["n"]}) == want
    assert {r["lang"] for r in found} == {"0", "1", "2"}


def test_texts_equal_a_plain_search(model):
    given = texts(60)
    for text, (lang, score, spans) in zip(given, language_id.label_texts(language_id.Scorer(model), pa.array(given))):
        words = [language_id.letters(w) for w in (text or "").split()]
        if not any(words):
            assert (lang, score, spans) == ("und", 0.0, [])
            continue
        rows = np.zeros((len(words), 3))
        for k, w in enumerate(words):
            if w:
                b = list(plain_buckets(w))
                rows[k] = model["logs"][:, b].sum(axis=1, dtype=float) / len(b) * math.sqrt(len(w) + 1)
                able = np.array([plain_script(w) in model["writes"][s] for s in "abc"])
                rows[k] = np.where(able, rows[k], rows[k].min() - 20) if able.any() else rows[k]
        path = plain_path(rows, language_id.SWITCH)
        weight = np.bincount(path, [len(w) for w in words], 3)
        means = rows.sum(axis=0) / sum(map(bool, words))
        share = np.exp((means - means.max()) * min(len(words), 20))
        assert lang == "abc"[weight.argmax()]
        assert score == pytest.approx(weight.max() / weight.sum() * share[weight.argmax()] / share.sum(), abs=1e-5)
        assert [s for a, b, s in spans for _ in range(a, b)] == ["abc"[k] for k in path]


@pytest.mark.parametrize("spread", [3.0, 0.05, 0.0])
def test_blocks_join_to_the_best_path(spread):
    """Clear words, words that settle nothing for blocks on end, and equal ones."""
    rng = np.random.default_rng(4)
    lengths = [1, 2, language_id.BLOCK, language_id.BLOCK + 1, 5 * language_id.BLOCK + 7, 40, 3000]
    rows = rng.normal(0, 1, size=(3, 500)) * spread
    rows[:, 0] = 0
    words = rng.integers(0, 500, sum(lengths)) * (rng.random(sum(lengths)) < 0.3)
    words[:2000] = np.where(np.arange(2000) % 700 < 500, 0, words[:2000])
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    found = language_id.paths(rows, words, bounds, 4.0)
    for a, b in zip(bounds, bounds[1:]):
        assert found[a:b].tolist() == plain_path(rows[:, words[a:b]].T, 4.0)


def test_a_long_text_takes_few_steps(monkeypatch):
    steps, forward = [], language_id._forward

    def counted(*given):
        out = forward(*given)
        steps.append(len(out[1]))
        return out

    monkeypatch.setattr(language_id, "_forward", counted)
    rows = np.random.default_rng(5).normal(0, 3, size=(4, 1000)).astype(np.float32)
    language_id.paths(rows, np.random.default_rng(6).integers(0, 1000, 50_000), np.array([0, 50_000]), 4.0)
    assert sum(steps) < 2_000
