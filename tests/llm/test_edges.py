"""Every operator and stage on null, empty, tied, repeated and very long rows, on clashing columns and on an
empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumafind.llm import ann, bpe, language_id, line_dedup, lm_scoring, ngram_join, packing, pii, quality, token_files

P = pytest.importorskip("public_tokenizers")
ROWS = [
    (1, "the cat sat on the mat and then it ran away home", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t \n", "de"),
    (5, "the cat sat on the mat and then it ran away home", "en"),
    (5, "the cat sat on the mat and then it ran away home", "en"),
    (None, "der hund und die katze sind nicht im haus", "de"),
    (None, None, None),
    (7, "word " * 30_000, "en"),
    (8, "x" * 50_000, None),
    (9, "1 " * 5_000 + "\n" * 3_000, "fr"),
    (10, "écrire à l'hôtel 中文 😀 a@b.org, +1 (555) 123-4567, 4111111111111111", "fr"),
    (11, "THE cat sat on the mat and then it ran away home", "en"),
    (5, "another text under the same id", "en"),
]
CLASH = ["node", "component_id", "words", "line", "base", "spans", "id", "k1", "__lines", "doc", "box", "lang_pred"]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(request, spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in CLASH})
    path = str(tmp_path_factory.mktemp("docs") / request.param)
    (df if request.param == "rows" else df.limit(0)).write.parquet(path)
    return spark.read.parquet(path)


def test_line_dedup(docs):
    kept = line_dedup.dedup_lines(docs)
    assert kept.schema.names == docs.schema.names
    rows = kept.collect()
    if docs.count():
        assert sum(r.doc_id is None for r in rows) == 2
        #: 5's copies and 11 repeat 1's line and leave; 5's other text is a line of its own.
        assert sorted((r.doc_id, r.text) for r in rows if r.doc_id == 5) == [(5, "another text under the same id")]
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_packing(docs):
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    assert sum(p.start == 0 for p in pieces) == docs.count()
    used = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used.get(p.sequence_id, 0)
        used[p.sequence_id] = p.offset + p.length
    assert all(n <= 1024 for n in used.values())


def test_quality(docs):
    rows = quality.judged(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 4))


def test_ngram_join(docs):
    classes = ngram_join.document_classes(docs).collect()
    assert len(classes) == docs.count()
    for r in classes:
        want = {None: None, 5: 1, 11: 1}.get(r.doc_id, r.doc_id)
        assert r.component_id == want
    kept = ngram_join.one_of_each(docs)
    assert kept.schema.names == docs.schema.names
    if docs.count():
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 7, 8, 9, 10]


def test_lm_scoring(docs):
    rows = docs.withColumn("held_out", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))
    found = lm_scoring.score_texts(rows, P.path("piece_bpe_32k.model")).collect()
    assert len(found) == docs.count()
    assert all(r.n_tokens == 1 for r in found if r.doc_id in (2, 3, 4))
    assert all(r.score < 0 for r in found)


def test_language_id(docs):
    model = language_id.learn(docs)
    found = language_id.identify(docs, model, spans=True).collect()
    assert len(found) == docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (2, 3, 4, 9))
    kept = language_id.keep_identified(docs, model)
    assert kept.schema.names == docs.schema.names
    if docs.count():
        assert {r.doc_id for r in kept.collect()} == {1, None, 5, 7, 8, 10, 11}


def test_pii(docs):
    found = pii.find_spans(docs.select("doc_id", "text")).collect()
    assert len(found) == docs.count()
    for r in found:
        assert [s.kind for s in r.base] == (["email", "card", "phone"] if r.doc_id == 10 else [])
    hidden = pii.redact(docs)
    assert hidden.schema.names == docs.schema.names
    texts = {r.doc_id: r.text for r in hidden.collect()}
    if texts:
        assert texts[10].endswith("[EMAIL], [PHONE], [CARD]") and texts[2] is None and texts[8] == "x" * 50_000


def test_token_files(spark, docs, tmp_path):
    out = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, out, P.path("word_bpe_49k.json"))
    rows = sorted(token_files.read_tokens(spark, out, with_ids=True).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count()
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == token_files.END
        at += r.n_tokens


def test_bpe(docs):
    rows = bpe.encode_texts(docs, P.path("word_bpe_49k.json")).collect()
    assert len(rows) == docs.count()
    assert all(r.ids == [] and r.decoded == "" for r in rows if r.doc_id in (2, 3, 4))


def test_ann(spark):
    vectors = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 1.0]), (9, [0.5, 0.5]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("size", F.lit(2))
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("id") == 1, k=5, aim=0.999999).collect()]
    assert sorted(found) == [(1, 1, 8, 1.0), (1, 2, 9, 0.5)]
    assert ann.nearest(df.limit(0), F.col("id") == 1).count() == 0


def test_pipeline_stages(spark, docs):
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, None)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.names == docs.schema.names
            df = line_dedup.written(out, "stage")
    if docs.count():
        assert {r.doc_id for r in out.collect()} == {None, 1, 5, 7, 8, 10}
    else:
        assert out.count() == 0
