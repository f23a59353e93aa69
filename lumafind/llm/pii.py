"""Personal data: validated patterns, and boosted trees over proposed spans. DataFrame functions only.

Base spans come from fixed patterns with checks. Generators with high recall propose further, overlapping
spans; each gets features of its format and of the text around it, and a label where there is evidence: a
valid number plan or checksum, the name of a secret or a spoken cue before it, the issued form or the mixture
of characters of a token, a top-level domain with a cue of mail speak for it; a date, an impossible number, a
compound of words or an unknown domain against it. Base spans have no part in the labels. Proposals with
evidence for them are added, those with evidence against them are not, and gradient-boosted trees, fitted
here on a bounded sample of the labelled ones, decide the unlabelled: for each generator the threshold is the
least score at which the labelled proposals outside base spans, that may be added, reach the wanted precision.
Of overlapping additions the better one stays.

The patterns are written so that the Java engine neither recurses nor rescans on long runs: a separator
between digits, or a dot between label characters, is first replaced by a private character, which turns
the repeated groups into plain character classes of the same extent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import documents, written
from .quality import let

#: Proposals used to fit the trees, in equal shares for each generator and label.
SAMPLE = 20_000
PRECISION = 0.95
ROUNDS, DEPTH = 8, 3
KINDS = ("email", "ip", "card", "phone", "secret", "number")
SPAN = "struct<start:int,end:int,text:string,before:string,after:string>"
JOIN, DOT = "\ue000", "\ue001"

_DIGIT_JOIN = "(?<=[0-9])[ -](?=[0-9])"
_LABEL_DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of fewer than 13 characters can't have 13 digits.
CARD = f"(?<![0-9{JOIN}])[0-9][0-9{JOIN}]{{12,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The generators: longer words with letters and digits, longer numbers, grouped numbers, spelled-out addresses.
SECRET = "(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+"
NUMBER = f"(?<![0-9{JOIN}])[0-9][0-9{JOIN}]{{7,}}+"
GROUPED = r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9])"
SPELLED = r"[A-Za-z0-9._%+-]{1,64}+ ?[(\[]?(?:at|AT)[)\]]? ?[A-Za-z0-9-]{1,63}+(?: ?[(\[]?(?:dot|DOT)[)\]]? ?[A-Za-z0-9-]{1,63}+){0,3} ?[(\[]?(?:dot|DOT)[)\]]? ?[A-Za-z]{2,24}"
GENERATORS = ("secret", "number", "phone", "email")
_NAMES = r"(?i)(token|secret|passw(or)?d|api.?key|key)['\"]?\s*[=:]\s*['\"]?$"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their code-point extent and up to 24 characters around."""

    def walk(pair: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            hit, gap, then = F.get(pair["m"], i), F.get(pair["g"], i), F.get(pair["g"], i + 1)
            begin = acc["at"] + F.length(gap)
            end = begin + F.length(hit)
            one = F.struct(begin.alias("start"), end.alias("end"), hit.alias("text"), F.right(gap, F.lit(24)).alias("before"), F.left(then, F.lit(24)).alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        steps = F.when(F.size(pair["m"]) > 0, F.sequence(F.lit(0), F.size(pair["m"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda acc: acc["out"])

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), walk)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _where(found: Column, text: Column, gate: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """The matches if the text passes a cheap test, and of these the valid ones."""
    kept = F.filter(found, keep) if keep is not None else found
    return F.when(text.rlike(gate), kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def _kind(name: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def proposals(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs with ``text`` -> carried columns, base (kind, start, end) and cands (generator, extent, features)."""
    text = F.translate(F.coalesce("text", F.lit("")), JOIN + DOT, "\x01\x01")
    rows = docs.select(*carried, text.alias("t"))
    has_at, long_number = F.col("t").contains("@"), r"[0-9][0-9 -]{6,}[0-9]"
    joined = F.when(F.col("t").rlike(long_number), F.regexp_replace("t", _DIGIT_JOIN, JOIN)).otherwise(F.lit(""))
    dotted = F.when(has_at, F.regexp_replace("t", _LABEL_DOT, DOT)).otherwise(F.lit(""))
    rows = rows.select("*", joined.alias("j"), dotted.alias("d"))
    digits_in = lambda s, low, high: let(_digits(s["text"]), lambda d: F.length(d).between(low, high))
    octets = lambda s: F.forall(F.split(s["text"], r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda x: (F.length(x) <= 3) & (x.cast("int") <= 255)))
    base = {
        "email": _where(matches(F.col("d"), EMAIL), F.col("d"), "@"),
        "ip": _where(matches(F.col("t"), IP), F.col("t"), r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", octets),
        "card": _where(matches(F.col("j"), CARD), F.col("j"), f"[0-9{JOIN}]{{13}}", lambda s: let(_digits(s["text"]), lambda d: F.length(d).between(13, 19) & _luhn(d))),
        "phone": _where(matches(F.col("t"), PHONE), F.col("t"), r"\+[0-9]", lambda s: digits_in(s, 9, 15)),
    }
    more = {
        "secret": _where(matches(F.col("t"), SECRET), F.col("t"), "[A-Za-z0-9_-]{16}", lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]")),
        "number": _where(matches(F.col("j"), NUMBER), F.col("j"), f"[0-9{JOIN}]{{8}}"),
        "phone": _where(matches(F.col("t"), GROUPED), F.col("t"), r"[0-9][) .-]+[0-9]{3,4}[ .-][0-9]{4}"),
        "email": _where(matches(F.col("t"), SPELLED), F.col("t"), r"(?i)\b(at)\b.{1,66}\bdot\b"),
    }
    spans = rows.select(*carried, F.concat(*(_kind(k, s) for k, s in base.items())).alias("base"), *(s.alias("__" + g) for g, s in more.items()))


    def featured(k: int, generator: str) -> Column:
        return F.transform("__" + generator, lambda s: F.struct(F.lit(k).alias("gen"), *_features(s, generator)))

    cands = F.concat(*(featured(k, g) for k, g in enumerate(GENERATORS)))
    return spans.select(*carried, "base", cands.alias("cands"))


FEATURES = ("gen", "length", "n_digits", "n_letters", "n_upper", "n_marks", "n_switches", "hexadecimal", "quoted", "assigned", "plausible", "glued")
_SWITCH = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
_SPOKEN = r"(?i)\b(call|phone|mobile|cell|tel|fax|card|account|contact|iban|ssn|passport|whatsapp)\b\W*((number|no|nr|me|us|is|at|on)\b\W*){0,2}$"
_MAIL = r"(?i)\b(e-?mails?|mail|write|contact|reach|address|inbox)\b.*$"
_TLD = r"(?i)dot[)\]]? ?(com|org|net|edu|gov|mil|int|info|biz|name|app|dev|ac|ae|ai|ar|at|au|be|bg|br|ca|cc|ch|cl|cn|co|cz|de|dk|ee|eg|es|eu|fi|fr|gr|hk|hr|hu|id|ie|il|in|io|ir|is|it|jp|ke|kr|lt|lu|lv|me|mx|my|ng|nl|no|nz|pe|ph|pk|pl|pt|ro|rs|ru|sa|se|sg|si|sk|th|tr|tv|tw|ua|uk|us|vn|za)$"
#: "look at the dot com" names no host.
_NO_HOST = r"(?i)\bat[)\]]? ?(a|an|the|this|that|each|every|any|one|my|your|his|her|its|our|their)\b"
#: Forms in which tokens are issued, and the form of a UUID, which names but doesn't open.
_ISSUED = "^(A[KS]IA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|sk[_-](live|test|proj)[_-][A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"
_UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: National numbers: North American ones by their plan, others by their trunk prefix.
_PLAN = r"^(\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}$|^(\(0[1-9][0-9]{0,2}\) ?|0[1-9][0-9]{0,2}[.-])[0-9]{3,4}[.-][0-9]{4}$"
_NO_PLAN = "^\\(?(1[0-9]{2}|[1-9][0-9]|[1-9][0-9]{3})[) .-]"
_SOCIAL = "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
_DATE = "^((19|20)[0-9]{2}[ -]?(0[1-9]|1[0-2])[ -]?(0[1-9]|[12][0-9]|3[01])|(0[1-9]|[12][0-9]|3[01])[ -]?(0[1-9]|1[0-2])[ -]?(19|20)[0-9]{2}|((19|20)[0-9]{2}[ -]?){2,})$"
#: Thousands, round numbers, and rows of short numbers.
_AMOUNT = "^[0-9]{1,3}( [0-9]{3})+$|0{5,}$|^[0-9]{1,2}( [0-9]{1,2})+$"


def _switches(text: Column) -> Column:
    """How often digits, small and capital letters follow each other."""
    return F.length(F.regexp_replace(text, _SWITCH, "\x01")) - F.length(text)


def _evidence(generator: str, s: Column) -> Column:
    """1 where there is evidence for personal data or a secret, 0 where there is evidence against it, else null."""
    text, before, after = s["text"], s["before"], s["after"]
    spoken, row = before.rlike(_SPOKEN), before.rlike("[0-9][ .,-]*$") | after.rlike("^[ .,-]?[0-9]")
    if generator == "secret":
        n, length = _switches(text), F.length(text)
        mixed = (length.between(20, 128) & (n >= length * 0.4) & (F.length(F.regexp_replace(text, "[^A-Z]", "")) >= 2)
                 & (F.length(F.regexp_replace(text, "[^a-z]", "")) >= 2) & (F.length(F.regexp_replace(text, "[^0-9]", "")) >= 2) & ~before.rlike("[/+.=]$|(?i)base64,$") & ~after.rlike("^[/+.]"))
        proof = before.rlike(_NAMES) | text.rlike(_ISSUED) | mixed
        contrary = (n <= length / 8) | text.rlike(_UUID)
    elif generator == "number":
        plain = F.translate(text, JOIN, "-")
        spaced, digits = F.translate(text, JOIN, " "), _digits(text)
        size = F.length(digits)
        contrary = (size > 19) | plain.rlike(_DATE) | spaced.rlike(_AMOUNT)
        proof = ~contrary & (spoken | plain.rlike(_SOCIAL) | F.coalesce(F.when(size.between(13, 19), _luhn(digits)), F.lit(False)))
        contrary = contrary | (size >= 13) | row | before.rlike("[A-Za-z]$") | after.rlike("^[A-Za-z]")
    elif generator == "phone":
        abroad = before.rlike(r"\+[0-9]{1,3}[ .-]?$")
        row = row & ~abroad
        proof = spoken | abroad | (text.rlike(_PLAN) & ~row & ~before.rlike("[A-Za-z0-9_.+-]$") & ~after.rlike("^[A-Za-z0-9_]"))
        contrary = row | text.rlike(_NO_PLAN)
    else:
        host = text.rlike(_TLD) & ~text.rlike(_NO_HOST)
        proof = host & (before.rlike(_MAIL) | text.rlike(r"[(\[]") | text.rlike("^[A-Za-z0-9%+-]+[._][A-Za-z0-9._%+-]*[A-Za-z0-9] "))
        contrary = ~host
    return F.when(proof, 1.0).when(contrary, 0.0)


def _features(s: Column, generator: str) -> list[Column]:
    text, before, after = s["text"], s["before"], s["after"]
    count = lambda letters: (F.length(text) - F.length(F.regexp_replace(text, letters, ""))).cast("double")
    flag = lambda test: test.cast("double")
    return [
        s["start"].alias("start"),
        s["end"].alias("end"),
        F.length(text).cast("double").alias("length"),
        count("[0-9]").alias("n_digits"),
        count("[A-Za-z]").alias("n_letters"),
        count("[A-Z]").alias("n_upper"),
        count("[^A-Za-z0-9]").alias("n_marks"),
        _switches(text).cast("double").alias("n_switches"),
        flag(text.rlike("^[0-9a-fA-F]+$")).alias("hexadecimal"),
        flag(before.rlike("['\"]$") & after.rlike("^['\"]")).alias("quoted"),
        flag(before.rlike(r"[=:]\s*['\"]?$")).alias("assigned"),
        flag((text.rlike(_TLD) & ~text.rlike(_NO_HOST)) | F.translate(text, " ", "-").rlike(_PLAN)).alias("plausible"),
        flag(before.rlike("[A-Za-z0-9._+-]$") | after.rlike("^[A-Za-z0-9_+-]")).alias("glued"),
        _evidence(generator, s).alias("label"),
    ]


def fit(labelled: DataFrame) -> GBTClassificationModel | None:
    """Trees from labelled(features..., label, draw): the first of each generator and label by draw. Without
    examples of both sorts there is no model."""
    first = Window.partitionBy("gen", "label").orderBy("draw")
    share = SAMPLE // (2 * len(GENERATORS))
    sample = written(labelled.select(*FEATURES, "label", F.row_number().over(first).alias("place"), "draw").filter(F.col("place") <= share), "sample")
    if sample.select("label").distinct().count() < 2:
        return None
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    return GBTClassifier(labelCol="label", featuresCol="features", maxIter=ROUNDS, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=1, cacheNodeIds=False).fit(gather.transform(sample))


def thresholds(scored: DataFrame) -> list[float]:
    """For each generator the least score at which all its labelled rows of scored(gen, p, label) reach PRECISION;
    2.0, which no score reaches, without any. At most 1001 levels for each generator."""
    levels = scored.filter("label is not null").groupBy("gen", "p").agg(F.count("*").alias("n"), F.sum("label").alias("good")).collect()
    found = []
    for g in range(len(GENERATORS)):
        n, good, least = 0, 0.0, 2.0
        for r in sorted((r for r in levels if r.gen == g), key=lambda r: -r.p):
            n, good = n + r.n, good + r.good
            least = r.p if good >= PRECISION * n else least
        found.append(max(0.5, least))
    return found


def find_spans(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """docs(text, carried columns, ``doc_id`` by default) -> the carried columns, base and spans: arrays of
    (kind, start, end) in code points, end exclusive, by kind as listed, then start.

    A null text is empty and has none; repeated rows and null ids stay; further columns are ignored.
    """
    carried = carried or ["doc_id"]
    found = written(proposals(docs, carried), "proposals").withColumn("__row", F.monotonically_increasing_id())
    each = found.select("__row", "base", F.posexplode("cands").alias("place", "c")).select("__row", "place", "base", "c.*")
    inside = F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    each = each.select("__row", "start", "end", F.col("gen").cast("double").alias("gen"), *FEATURES[1:], "label", inside.alias("covered"), F.xxhash64("__row", "place").alias("draw"))
    model = fit(each.filter("label is not null"))
    free = each.filter("not covered")
    if model is None:
        chosen = free.filter("label = 1").select("__row", "gen", "start", "end", F.lit(1.0).alias("p"))
    else:
        scores = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(free))
        scored = written(scores.select("__row", "gen", "start", "end", "label", F.round(vector_to_array("probability")[1], 3).alias("p")), "scored")
        passes = F.element_at(F.array(*(F.lit(float(t)) for t in thresholds(scored))), F.col("gen").cast("int") + 1)
        chosen = scored.filter((F.col("label") == 1) | (F.col("label").isNull() & (F.col("p") >= passes))).withColumn("p", F.when(F.col("label") == 1, 1.0).otherwise(F.col("p")))
    kind = F.element_at(F.array(*(F.lit(g) for g in GENERATORS)), F.col("gen").cast("int") + 1)
    added = chosen.groupBy("__row").agg(F.collect_list(F.struct("p", "gen", "start", "end", kind.alias("kind"))).alias("more"))
    #: The higher score first; of equal ones the more special generator, then the earlier span.
    order = lambda a: F.struct(-a["p"], -a["gen"], a["start"], a["end"])
    better = F.filter("more", lambda a: ~F.exists("more", lambda b: (b["start"] < a["end"]) & (b["end"] > a["start"]) & (order(b) < order(a))))
    extra = F.transform(F.coalesce(better, F.array().cast("array<struct<p:double,gen:double,start:int,end:int,kind:string>>")), lambda a: F.struct(a["kind"].alias("kind"), a["start"].alias("start"), a["end"].alias("end")))
    both = found.join(added, "__row", "left").select(*carried, "base", F.concat("base", extra).alias("all"))

    def ordered(spans: str) -> Column:
        keyed = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*(F.lit(k) for k in KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return both.select(*carried, ordered("base").alias("base"), ordered("all").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans are replaced as one, by the
    kind that begins first. Columns are those of docs; a null text stays null."""
    names = [f"__{k}" for k in range(len(docs.columns))]
    where = names[docs.columns.index("text")]
    plain = docs.toDF(*names).withColumn("text", F.col(where))
    spans = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(where, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.concat(acc["out"], between, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    found = find_spans(plain, names).select(*names, spans.alias("spans"))
    text = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(where, acc["at"] + 1, F.length(where))))
    return found.withColumn(where, F.when(F.size("spans") > 0, text).otherwise(F.col(where))).select(*names).toDF(*docs.columns)


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)

    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
