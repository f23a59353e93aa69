"""Masking jobs over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import masks as M
from ..functions.scalars import category_parent

TEXTS = ("item_name", "description", "normalized_search_text", "search_text")


def is_high_risk(raw: Column, risky: tuple[str, ...] = M.HIGH_RISK) -> Column:
    return F.coalesce(category_parent(raw).isin(*risky), F.lit(False))


def mask_table(df: DataFrame, columns: tuple[str, ...] = TEXTS, risky: tuple[str, ...] = M.HIGH_RISK) -> DataFrame:
    """The text columns masked as far as df has them, names in brackets too where the parent category is at high
    risk. All others stay as they are."""
    risk = is_high_risk(F.col("raw_category_name"), risky)
    return df.withColumns({c: M.mask_text(F.col(c), risk) for c in columns if c in df.columns})


def needs_masking(df: DataFrame, columns: tuple[str, ...] = TEXTS, risky: tuple[str, ...] = M.HIGH_RISK) -> DataFrame:
    """One row: rows scanned and rows that masking would change."""
    risk = is_high_risk(F.col("raw_category_name"), risky)
    flag = F.lit(False)
    for c in columns:
        if c in df.columns:
            flag = flag | ~M.mask_text(F.col(c), risk).eqNullSafe(F.col(c))
    return df.select(flag.alias("changed")).agg(F.count("*").alias("scanned"), F.count_if("changed").alias("to_mask"))


def remask(df: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose stored text masking changes, with the new text; a one-row dry-run report)."""
    rows = df.withColumn("masked", M.mask_text(F.col(column), is_high_risk(F.col("raw_category_name"))))
    changed = rows.filter(~F.col("masked").eqNullSafe(F.col(column)))
    report = rows.agg(F.count("*").alias("scanned"), F.count_if(~F.col("masked").eqNullSafe(F.col(column))).alias("changed"), F.max(key).alias("last_id"))
    return changed, report


def reembed_plan(vecs: DataFrame, items: DataFrame, cutoff: str, version: int) -> DataFrame:
    """Current vectors made before the cutoff whose masked input differs; an unknown category is at high risk."""
    old = vecs.filter((F.col("input_version") == version) & F.col("is_current") & (F.col("embedded_at") < F.lit(cutoff).cast("timestamp")))
    joined = old.join(items.select("id", "raw_category_name"), "id", "left")
    risk = F.col("raw_category_name").isNull() | is_high_risk(F.col("raw_category_name"))
    masked = M.mask_text(F.col("embedded_input"), risk)
    return joined.withColumn("masked", masked).filter(F.col("masked") != F.col("embedded_input")).select("id", "embedded_input", "masked")


def masking_report(df: DataFrame, column: str, by: str) -> DataFrame:
    """Rows that each rule alone would change, by source and in all (source null)."""
    flags = {r: F.coalesce(M.by_rule(r)(F.col(column)) != F.col(column), F.lit(False)) for r in M.RULES}
    rows = df.select(by, *(f.alias(r) for r, f in flags.items()))
    return rows.rollup(by).agg(F.count("*").alias("n_rows"), *(F.count_if(r).alias(r) for r in M.RULES))
