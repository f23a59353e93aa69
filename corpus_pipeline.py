"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, PII, packing.

Each stage reads what its predecessor kept and, but for the last, returns the columns of documents. Packing
returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
"""

from __future__ import annotations

import public_tokenizers

from lumafind.llm import language_id, line_dedup, ngram_join, packing, pii
from lumafind.llm._common import written


def identify_language(spark, docs, sf_dir):
    """Documents without a language leave; the model is learned from all labelled documents. Null and empty texts have
    none; a text of any length is labelled whole; where two languages score alike the first by name counts; repeated
    rows and null ids stay as they are; an empty table stays empty."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def dedup_lines(spark, docs, sf_dir):
    """Lines similar to an earlier one leave their texts, by doc_id and line; a document that loses all its lines with
    words leaves. Rows that share a doc_id are told apart by their texts; null and wordless texts, lines without words
    and rows with a null doc_id stay; texts of any length are taken line by line."""
    return line_dedup.dedup_lines(docs)


def join_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return ngram_join.one_of_each(docs)


def redact_personal_data(spark, docs, sf_dir):
    """Found spans give way to their kind in brackets, overlapping ones as one, by the kind that begins first; rows and
    other columns stay. Null texts stay null, texts of any length are searched whole, repeated rows alike."""
    return pii.redact(docs)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of all documents in windows of 1,024 ids. Null texts are empty, long ones are cut into full windows first,
    pieces of one length go by hash, repeated rows are packed each; an empty table has no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: The language model, the trees and the tokenizer have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
