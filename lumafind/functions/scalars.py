"""Column functions: normalisation, dates, predicates. All built-in but for Unicode normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The parent categories, and the overseas offices whose items aren't held in the country.
CATEGORIES = (
    ("bag", "가방"), ("clothing", "의류"), ("electronics", "전자기기"), ("wallet", "지갑"), ("mobile_phone", "휴대폰"), ("card", "카드"), ("jewelry", "귀금속"),
    ("etc", "기타물품"), ("books", "도서용품"), ("ownerless", "무주물"), ("industrial", "산업용품"), ("documents", "서류"), ("shopping_bag", "쇼핑백"), ("sports", "스포츠용품"),
    ("instrument", "악기"), ("securities", "유가증권"), ("abandoned", "유류품"), ("car", "자동차"), ("certificate", "증명서"), ("computer", "컴퓨터"), ("cash", "현금"),
)
OVERSEAS = (
    "주타이베이대한민국대표부", "주오스트리아대사관", "주홍콩대한민국총영사관", "주이탈리아대한민국대사관", "주바르셀로나총영사관", "주덴마크대사관", "주체코대사관",
    "주헝가리대한민국대사관", "주스페인대사관", "주스위스대한민국대사관", "주고베총영사관", "주삿포로총영사관", "주독일대사관",
)
PARTNER = "partner_api"
KST = "Asia/Seoul"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfkc_fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def norm_text(col: Column) -> Column:
    """NFKC, white space collapsed, trimmed; null becomes ''."""
    return squeeze(nfkc(F.coalesce(col, F.lit(""))))


def base_text(col: Column, keep_spaces: bool = True) -> Column:
    """NFKC and case folding; runs of other than letters and digits become one space, or nothing."""
    kept = F.regexp_replace(nfkc_fold(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+", " " if keep_spaces else "")
    return F.trim(kept)


def match_key(col: Column) -> Column:
    return base_text(col, keep_spaces=False)


def base_name(col: Column) -> Column:
    """The match key without notes in plain round or square brackets; full-width notes stay."""
    return match_key(F.regexp_replace(F.coalesce(col, F.lit("")), r"\([^)]*\)|\[[^\]]*\]", ""))


def category_parent(col: Column) -> Column:
    return F.trim(F.split(col, "[>＞]", 2)[0])


def category_child(col: Column) -> Column:
    return F.nullif(F.trim(F.get(F.split(col, "[>＞]", 2), F.lit(1))), F.lit(""))


def parse_date(col: Column) -> Column:
    """Year, month and day between dashes, the latter two with or without a leading zero, else eight digits."""
    text = norm_text(col)
    dashed = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))
    return F.coalesce(dashed, F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")))


def blank(col: Column) -> Column:
    return F.trim(F.coalesce(col, F.lit(""))) == ""


def embedding_input(color: Column, name: Column) -> Column:
    """What the colour has in parentheses that hold Hangul, else a colour that has Hangul and no Latin, before the
    name."""
    inside = F.regexp_extract(color, r"\(([^)]*[가-힣][^)]*)\)", 1)
    own = F.when(color.rlike("[가-힣]") & ~color.rlike("[A-Za-z]"), color)
    return squeeze(F.concat_ws(" ", F.coalesce(F.nullif(inside, F.lit("")), own), name))


def embedding_input_v1(text: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.nullif(F.trim(name), F.lit("")))


def is_overseas(source: Column, name: Column) -> Column:
    return (source == PARTNER) & match_key(name).isin(*OVERSEAS)


def retention_start(day: Column, months: Column | int) -> Column:
    """The same day so many calendar months back, clamped to the end of the month."""
    return F.add_months(day, -months)


def has_photo(url: Column, placeholder: str = "/img02_no_img.gif") -> Column:
    """A URL that isn't blank and whose path, without query and fragment, doesn't end in the placeholder."""
    path = F.split(F.trim(url), "[?#]", 2)[0]
    return ~blank(url) & ~F.coalesce(F.endswith(path, F.lit(placeholder)), F.lit(False))


#: Icon classes by exact parent category, for two of them by exact child.
CLASSES = {"가방": "bag", "지갑": "wallet", "휴대폰": "phone", "카드": "card"}
CHILD_CLASSES = {"의류": ("모자", "cap"), "전자기기": ("무선이어폰", "buds")}


def category_class(raw: Column, classes: dict[str, str] | None = None, children: dict[str, tuple[str, str]] | None = None, rest: str = "box") -> Column:
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ">"), lambda p: F.trim(p))
    parent, child = parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    found = F.lit(rest)
    for name, kind in (CLASSES if classes is None else classes).items():
        found = F.when(parent == name, kind).otherwise(found)
    for name, (below, kind) in (CHILD_CLASSES if children is None else children).items():
        found = F.when((parent == name) & (child == below), kind).otherwise(found)
    return found


def kind_mask(text: Column, words: list[list[str]]) -> Column:
    """Bit k is set if the text contains any word of the k-th group."""
    mask = F.lit(0)
    for k, group in enumerate(words):
        hit = F.lit(False)
        for w in group:
            hit = hit | text.contains(w)
        mask = mask.bitwiseOR(F.when(hit, F.lit(1 << k)).otherwise(F.lit(0)))
    return mask


EARTH = 6_371_008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
