"""The operators against brute force, exact round trips or held-out accuracy on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumafind.llm import ann, bpe, language_id, lm_scoring, ngram_join, packing, pii, queries, token_files
from lumafind.llm._tokens import Encoder, load

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0d]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def brute_classes(sets):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def test_join_of_a_cloud_of_near_copies(spark):
    """Copies around the threshold of each other, in chains, with a passage that all share."""
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    docs = {}
    for d in range(90):
        words = list(base) if d < 60 else [f"v{d}x{k}" for k in range(40)] + base[:20]
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"n{rnd.randrange(400)}"
        docs[d] = " ".join(words)
    sets = {}
    for d, t in docs.items():
        w = t.split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.document_classes(df).collect()} == brute_classes(sets)


def test_search_of_blocks(spark):
    """Every asker gets a link in each block that has a similar member."""
    texts = {k: " ".join(f"a{(k // 3) * 100 + j + (j == k % 3) * 1000}" for j in range(60)) for k in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = spark.createDataFrame([(100, k) for k in range(0, 12, 3)], "holds long, u long")
    members = spark.createDataFrame([(100, k) for k in range(12) if k % 3], "holds long, v long")
    links = {(r.u, r.v) for r in ngram_join.searched(asked, members, docs, 70).collect()}
    assert {u for u, _ in links} == {0, 3, 6, 9} and all(u // 3 == v // 3 for u, v in links)


def test_packing(spark, texts):
    tokenizer = load(P.path("byte_bpe_50k.json"))
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts.items()}
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in packing.op2_packing(spark, SF).collect():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, pieces in parts.items():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at == len(ids[d])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
    assert len(parts) == len(ids) and padding < 0.03 * sum(map(len, ids.values()))


def test_best_fit_takes_the_tightest():
    rnd = random.Random(1)
    lengths = sorted((rnd.randint(1, 1023) for _ in range(800)), reverse=True)
    windows, offsets = packing.best_fit(lengths)
    room, want = {}, []
    for n in lengths:
        fits = [r for r in room.values() if r >= n]
        want.append(1024 - min(fits) if fits else 0)
        w = next((k for k, r in room.items() if fits and r == min(fits)), len(room))
        room[w] = room.get(w, 1024) - n
    assert offsets == want and len(set(windows)) == len(room)


def test_token_files(spark, texts):
    tokenizer = load(P.path("word_bpe_49k.json"))
    at = 0
    for r in sorted(token_files.op9_token_files(spark, SF).collect(), key=lambda r: r.doc_id):
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5_000])
def test_blocks_round_trip(n, high):
    values = np.random.default_rng(n).integers(0, high, n, dtype=np.uint32)
    values[::50] = high - 1
    assert (token_files.decode_ids(token_files.encode_ids(values)) == values).all()


def test_bpe_equals_the_library(spark, texts):
    tokenizer = load(P.path("word_bpe_49k.json"))
    for r in bpe.op10_bpe(spark, SF).collect():
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_joins_of_unsplit_runs():
    """Trees with tiny leaves on runs that nothing splits."""
    rnd = random.Random(1)
    tree = bpe.TreeEncoder(P.path("word_bpe_49k.json"), leaf=8)
    runs = ["a" * 3_000, "'s''s" * 100, "été" * 400, "中文" * 300, "!?" * 700 + "x'll", "İ" * 99, "<|endoftext|>" * 30]
    for _ in range(300):
        runs.append("".join(rnd.choice("abcdeé'!?-_ß中0") for _ in range(rnd.randint(20, 600))))
        runs.append("".join(rnd.choice(["the", "ing", "tion", "a", "e", "s", "é"]) for _ in range(rnd.randint(20, 300))))
    runs += ["it's'll 're " * 90, "H̱é " * 200, "각" * 120, "日本語 テキスト" * 80, "  \n\t " * 60 + "x  　y" * 99, "🙂👍🏽" * 50, "İIıΣς" * 60]
    ids, bounds = tree.encode(pa.array(runs))
    for k, (text, want) in enumerate(zip(runs, tree.tokenizer.encode_batch(runs, add_special_tokens=False))):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want.ids, text[:60]


def test_whole_texts_by_trees(texts):
    """Every text of the table, nearly all of them longer than a leaf."""
    tree, plain = bpe.TreeEncoder(P.path("word_bpe_49k.json"), leaf=50), list(texts.values())
    ids, bounds = tree.encode(pa.array(plain))
    for k, want in enumerate(tree.tokenizer.encode_batch([t or "" for t in plain], add_special_tokens=False)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want.ids


def test_pieces_equal_the_library():
    odd = ["", " ", "\n\n", "a  b\n\n c \n", " x\t y\xa0 z  ", "don't  <|endoftext|> it's", "\0a \0b", "ﬁ Å é"]
    encoder = Encoder(P.path("byte_bpe_50k.json"))
    ids, bounds = encoder.encode(pa.array(odd))
    for k, (text, want) in enumerate(zip(odd, encoder.tokenizer.encode_batch(odd, add_special_tokens=False))):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want.ids, text


def test_base_score(spark, texts):
    tokens = {d: re.findall(WORD, low(t)) + [None] for d, t in texts.items()}
    counts = Counter(x for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1 for x in ws)
    total = sum(counts.values())
    floor = total + 0.5 * (len(counts) + 1)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    usable = {model.id_to_piece(k): 1 / (1 - min(0.0, model.get_score(k))) for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k))}
    weights = {k: w / sum(usable.values()) for k, w in usable.items()}
    pieces = {k: w for k, w in weights.items() if not k.startswith("<0x")}
    bytes_of = {int(k[3:5], 16): w for k, w in weights.items() if k.startswith("<0x")}
    memo = {}

    def log10_lattice(w):
        """Sum over all segmentations, by every substring, in exact scaled fractions of plain floats."""
        if w not in memo:
            text, found = "▁" + w, [0.0]
            for end in range(1, len(text) + 1):
                ways = [found[a] + math.log(pieces[text[a:end]]) for a in range(end) if text[a:end] in pieces]
                if text[end - 1] not in pieces:
                    ways.append(found[end - 1] + sum(math.log(bytes_of[b]) for b in text[end - 1].encode()))
                found.append(max(ways) + math.log(sum(math.exp(x - max(ways)) for x in ways)))
            memo[w] = found[-1] / math.log(10)
        return memo[w]

    ends, mass = counts[None], 0.5 * (len(counts) + 1)

    def share(w):
        spread = 10 ** log10_lattice(w) * (1 - ends / total) if w else ends / total
        return max((counts[w] + mass * spread) / (total + mass), 1e-320)

    for r in lm_scoring.op5_lm_scoring(spark, SF).collect():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / floor) for w in ws), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(share(w)) for w in ws), rel=1e-9)
        assert r.lattice_score == pytest.approx(sum(log10_lattice(w) if w else math.log10(ends / total) for w in ws), rel=1e-9)


def test_lattice_sums_all_segmentations():
    pieces = {"▁": -2.0, "▁a": -1.5, "a": -1.0, "b": -1.2, "ab": -0.7, "▁ab": -2.5, ".": -3.0, "b.": -4.0}
    lattice = lm_scoring.Lattice({"pieces": pieces, "bytes": {0xC3: -5.0, 0xA9: -6.0}, "end": -1.0})

    def brute(text):
        total = 0.0 if text else 1.0
        for k in range(1, len(text) + 1):
            total += math.exp(pieces[text[:k]]) * brute(text[k:]) if text[:k] in pieces else 0.0
        if text and text[0] not in pieces:
            total += math.exp(-11.0) * brute(text[1:])
        return total

    for word in ("a", "ab", "abab", "ba.", "aé", "aba..", "."):
        assert lattice.word(word) == pytest.approx(math.log(brute("▁" + word)))


@pytest.mark.parametrize("texts", [["Abc def", "Ghi jkl", "ZZ yy", "Pqr é"] * 3, ["Abc def", None, "ZZ yy", "Pqr é"] * 3])
def test_words_of_a_slice(texts):
    words, owner = lm_scoring._split(pa.array(texts).slice(5, 6))
    want = [(w.encode(), k) for k, t in enumerate(texts[5:11]) for w in low(t).split()]
    assert list(zip(words.to_pylist(), owner.tolist())) == want


def test_lattice_side_by_side_and_alone():
    lattice = lm_scoring.Lattice(lm_scoring.vocabulary_weights(P.path("piece_bpe_32k.model")))
    words = ["a", "the", "élève", "中文😀", "a\0", "\0", "x" * 63, "x" * 64, "thing" * 500, "a\0b", "the"]
    assert list(lattice.words(words)) == pytest.approx([lattice.alone("▁" + w) for w in words])
    assert len(lattice.words([])) == 0


def test_language_accuracy(spark):
    rows = language_id.op6_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.97


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(3)
    lengths = np.array([6, 4, 1])
    scores = rng.normal(size=(6, 3, 3))
    labels = language_id.viterbi(scores.reshape(-1, scores.shape[2]), np.arange(scores.shape[0] * scores.shape[1]).reshape(scores.shape[:2]), lengths, 0.8)
    for c, n in enumerate(lengths):
        best = max(np.ndindex(*[3] * n), key=lambda p: sum(scores[t, c, p[t]] for t in range(n)) - 0.8 * sum(p[t] != p[t - 1] for t in range(1, n)))
        assert tuple(labels[:n, c].tolist()) == best


def test_mixed_text_has_spans(spark):
    model = language_id.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    (found,) = language_id.label_texts(language_id.Scorer(model), pa.array(["The and of which was in the thing. Der und die nicht mit ein Verheit schich. Le de la pour que dans eaux."]))
    assert [s[2] for s in found[2]] == ["en", "de", "fr"]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 13 <= len(digits) <= 19 and luhn(digits) else []
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans(spark, texts):
    rnd = random.Random(3)
    odd = ["a@b.c+d@e.f g@h", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0000004", "4111 1111 1111 1111-", "1" * 20_000, "1 2" * 9_000, "+1 (555) 123-4567, +49..30 1234567", "a.b.@c..d x@y.z.", "a@" + "b." * 9_000 + "c", "😀 a@b.co 😀 4111111111111111", "+1" * 3_000]
    odd += ["".join(rnd.choice("ab.@-+ 1234 0(),%_5é\n") for _ in range(rnd.randint(5, 80))) for _ in range(500)]
    docs = spark.createDataFrame(list(texts.items()) + [(10**9 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    everything = dict(texts) | {10**9 + k: t for k, t in enumerate(odd)}
    for r in pii.find_spans(docs).collect():
        want = base_spans(everything[r.doc_id] or "")
        assert [tuple(s) for s in r.base] == want
        assert set(want) <= {tuple(s) for s in r.spans}


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([v.vec_id for v in vectors]), np.array([v.embedding for v in vectors], float)
    found = defaultdict(set)
    for r in ann.op8_ann(spark, "/root/testdata/sf0.01").collect():
        found[r.query_id].add(r.vec_id)
        assert r.score == pytest.approx(float(x[ids == r.query_id][0] @ x[ids == r.vec_id][0]), abs=1e-12)
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        hits += len(found[q] & set(ids[np.lexsort((ids, -s))[:20]]))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_components_of_chains_and_stars(spark):
    from lumafind.llm.components import components

    rnd = random.Random(1)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(60, 90)] + [(None, 3), (4, None), (5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()} == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
