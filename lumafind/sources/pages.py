"""Landed dumps, dictionaries and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import ROW_COLUMNS

TAGS = "atcId fdSn prdtClNm fdYmd fdPrdtNm fdSbjt clrNm depPlace fdFilePathImg".split()
PAGE = "header struct<resultCode:string>, body struct<items:struct<item:array<struct<" + ",".join(f"{t}:string" for t in TAGS) + ">>>,pageNo:long,totalCount:long>"


def read_item_pages(spark: SparkSession, path: str, strict_header: bool = True) -> DataFrame:
    """One row per item of XML page files: file, page, total, pos and the trimmed tags. Pages whose result
    code isn't 00 are refused; a page without one passes unless the header is strict."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_xml("value", PAGE).alias("p"))
    code = F.col("p.header.resultCode")
    good = pages.filter(F.coalesce(code == "00", F.lit(not strict_header)))
    rows = good.select("file", F.col("p.body.pageNo").alias("page"), F.col("p.body.totalCount").alias("total"), F.posexplode("p.body.items.item").alias("pos", "item"))
    return rows.select("file", "page", "total", "pos", *(F.trim(f"item.{t}").alias(t) for t in TAGS))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; Spark keeps non-ASCII text and leaves null fields out."""
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """The canonical columns as text with a header and without a byte-order mark."""
    df.select(*(F.col(c).cast("string") for c in ROW_COLUMNS)).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_csv wrote: nothing between commas is null, a pair of quotes an empty text. Spark tells these apart only
    if null has a name of its own, which no field can have."""
    rows = spark.read.schema(", ".join(f"{c} string" for c in ROW_COLUMNS)).option("header", True).option("escape", '"').option("multiLine", True)
    return rows.option("nullValue", uuid.uuid4().hex).option("emptyValue", "").csv(path)


def write_table(df: DataFrame, path: str, month_of: str | None = None) -> None:
    """A fact table by month of a date column, or a plain dimension."""
    if month_of is None:
        df.write.parquet(path)
    else:
        df.withColumn("month", F.date_format(month_of, "yyyy-MM")).repartition("month").write.partitionBy("month").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_kinds(spark: SparkSession, path: str) -> DataFrame:
    """A kind dictionary (kinds: name, categories, terms; hints) as rows kind, term, hint."""
    raw = spark.read.schema("kinds array<struct<name:string,categories:array<string>,terms:array<string>>>, hints map<string,array<string>>").json(path, multiLine=True)
    terms = raw.select(F.explode("kinds").alias("k")).select(F.col("k.name").alias("kind"), F.explode("k.terms").alias("term"), F.lit(False).alias("hint"))
    hints = raw.select(F.explode("hints").alias("kind", "terms")).select("kind", F.explode("terms").alias("term"), F.lit(True).alias("hint"))
    return terms.unionByName(hints)


def load_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """A synonym dictionary (concepts: domain, canonical, terms, scope) as rows domain, canonical, term, scope."""
    raw = spark.read.schema("concepts array<struct<domain:string,canonical:string,terms:array<string>,scope:array<string>>>").json(path, multiLine=True)
    return raw.select(F.explode("concepts").alias("c")).select("c.domain", "c.canonical", F.explode("c.terms").alias("term"), "c.scope")


def load_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Lists of words that are no names (exclusions: list -> words) as rows list, term."""
    raw = spark.read.schema("exclusions map<string,array<string>>").json(path, multiLine=True)
    return raw.select(F.explode("exclusions").alias("list", "terms")).select("list", F.explode("terms").alias("term"))
