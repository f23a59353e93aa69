"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import documents

#: White space that ends words, symbol characters, and frequent function words of English,
#: French, German and Spanish.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in is was that for it with as on be at by this are or from an have not which "
    "le la les de des du et un une en est que qui dans pour pas sur au avec ce il elle "
    "der die das und ist nicht den dem ein eine von zu mit auf für im des sich "
    "el los las del y que un una por con no se su para es lo como más"
).split()
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Rule:
    """A ratio or count that must lie between two bounds; a missing value passes."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None

    def passes(self) -> Column:
        value = F.expr(self.value)
        bounds = [value >= self.least] * (self.least is not None) + [value <= self.most] * (self.most is not None)
        test = bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]
        return F.coalesce(test, F.lit(True))


#: The threshold table. Values are SQL over the measured columns; try_divide leaves empty texts to the base.
RULES = (
    Rule("length", "n_words", 20, None),
    Rule("mean_word_length", "try_divide(word_chars, n_words)", 2.0, 15.0),
    Rule("symbol_ratio", "try_divide(n_symbols, n_words)", None, 0.25),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("stop_word_ratio", "try_divide(n_stop_words, n_words)", 0.02, None),
    Rule("duplicate_lines", "try_divide(n_dup_lines, n_lines)", None, 0.5),
    Rule("letter_ratio", "try_divide(n_letters, word_chars)", 0.6, None),
)


def _repeated_words(words: Column) -> Column:
    """Words in 8-word windows that occur twice or more: windows are hashed by doubling, sorted, and the
    positions with an equal neighbour are covered from left to right."""

    def double(step: int) -> Callable[[Column], Column]:
        return lambda h: F.when(F.size(h) > step, F.zip_with(F.slice(h, F.lit(1), F.size(h) - step), F.slice(h, F.lit(step + 1), F.size(h) - step), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))

    def cover(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda acc, p: F.struct((acc["total"] + p + WINDOW - F.greatest(acc["end"], p)).alias("total"), (p + WINDOW).alias("end")), lambda acc: acc["total"])

    def twice(runs: Column) -> Column:
        pairs = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(pairs, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        return cover(F.sort_array(F.transform(again, lambda x: x["i"])))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    eight = let(let(let(hashes, double(1)), double(2)), double(4))
    return let(eight, lambda runs: F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(twice(runs)))


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and the counts that rules use. A null text counts as empty; other columns
    are ignored; repeated rows stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "").alias("words"))
    length = F.length("text")
    lines = let(F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE, "") != ""), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    ).select("*", F.col("lines.n").cast("long").alias("n_lines"), F.col("lines.again").cast("long").alias("n_dup_lines")).drop("lines")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measured documents with base_failed, kept and, for each failed rule, its name in ``failed``."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(~r.passes(), F.lit(r.name)) for r in rules)))
    return measured(docs).select("*", base.alias("base_failed"), failed.alias("failed")).select("*", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))
