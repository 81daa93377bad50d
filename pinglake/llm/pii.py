"""Personal data: regular expressions propose spans, checksums confirm them, context words weigh in.

Everything is DataFrame functions. For each kind a pattern proposes matches, leftmost and without
overlap; the text is split at them, so their places are running sums of lengths and no position
function is needed. A check confirms or drops a proposal: octets up to 255, the Luhn sum of cards,
the remainder modulo 97 of account numbers, digit counts of phones. Kinds whose shape alone says
little start with a low score, which words close before the span raise over the threshold.

Defined cases: null and empty texts have no spans; very long texts are searched whole, and patterns
never go back over what they consumed, so time is linear; equal texts get equal spans; an empty
table gives an empty table; other columns pass through untouched, and working columns have names
that start with ``_pii_``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# Score a span needs, and what a context word before it adds.
THRESHOLD = 0.5
CONTEXT_BONUS = 0.4
# How many code points before a span are searched for context words.
CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    """``pattern`` is the contract's in meaning: quantifiers are possessive where going back could
    not find a match anyway, and the guard before it allows a start only where a run begins or the
    last match ended, which no other start could beat. ``hint`` is a cheap test that every text
    with a match passes."""

    name: str
    pattern: str
    hint: str
    score: float
    base: bool = True
    context: str = ""


_RUN = r"(?:\G|(?<![{0}]))"
# Signs of an account number by country; what follows the number is never taken for a part of it.
IBAN_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Numbers of the country's length; codes that are not in the table, of any length."""
    known = [(f"(?:{c.replace(' ', '|')})", n) for n, c in IBAN_SIGNS.items()]
    each = [rf"{c}[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}" for c, n in known]
    other = rf"(?!{'|'.join(c for c, _ in known)})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(each)}|{other})(?![A-Za-z0-9])"


KINDS = (
    Kind("email", _RUN.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    Kind("ip", _RUN.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.9),
    # Runs of digits with single separators; shorter ones than 16 digits are never cards.
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+", r"[0-9](?:[\x20-]?[0-9]){15}", 0.9),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.8),
    # Beyond the base: account numbers with a mod-97 sum, and shapes that need a word beside them.
    Kind("iban", _iban(), r"[A-Z]{2}[0-9]{2}", 0.9, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", 0.3, False, r"(?i)\b(?:ssn|social security)\b"),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]", 0.3, False, r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|tél|teléfono)\b"),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2).otherwise(x.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _mod97(number: Column) -> Column:
    """Whether an account number, its first four signs moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    moved = F.concat(F.substring(number, 5, 100), F.substring(number, 1, 4))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (a * 100 + code - 55) % 97).otherwise((a * 10 + code - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _confirmed(kind: Kind, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind.name == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int").isNull() | (F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int") <= 255)))
    if kind.name == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind.name == "phone":
        return F.length(digits).between(8, 15)
    if kind.name == "iban":
        return _mod97(F.regexp_replace(found, " ", ""))
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans_of(kind: Kind, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    # (place reached, spans): each match starts where the text between the matches ends.
    start = F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(a["starts"], F.array(a["at"] + F.length(x["gap"]))).alias("starts"),
        ),
    )["starts"]

    def span(x: Column) -> Column:
        score = F.lit(kind.score)
        if kind.context:
            # The words directly before the span; on a tie of places the text before it is all there is.
            before = F.substring(text, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT_CHARS)))
            score = score + F.when(F.regexp_like(before, F.lit(kind.context)), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["hit"])).alias("end"), score.alias("score"))

    proposed = F.arrays_zip(start.alias("start"), found.alias("hit"))
    kept = F.transform(F.filter(proposed, lambda x: _confirmed(kind, x["hit"])), span)
    kept = F.filter(kept, lambda s: s["score"] >= THRESHOLD).cast(_SPAN)
    # Most texts have nothing of a kind: one search without captures spares them the rest.
    hint = F.contains(text, F.lit(kind.hint)) if kind.hint == "@" else F.regexp_like(text, F.lit(kind.hint))
    return F.when(hint, kept).otherwise(F.array().cast(_SPAN))


def find_spans(df: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """``df`` with an array of (kind, start, end, score), by kind as in KINDS, then start; code points, end exclusive.

    Row by row: nothing is shuffled, and a row needs the memory of its own text.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = df
    for k in KINDS:
        out = out.withColumn(f"_pii_{k.name}", _spans_of(k, t))
    return out.withColumn(to, F.concat(*(F.col(f"_pii_{k.name}") for k in KINDS))).drop(*(f"_pii_{k.name}" for k in KINDS))


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with every span replaced by its kind in brackets, e.g. [EMAIL].

    Spans that overlap become one, named after the first to start (the longer one on a tie). A null
    text stays null.
    """
    t = F.col(text)
    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    merged = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.struct(
            F.greatest(a["at"], -s["back"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["parts"], F.array(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(a["parts"]).alias("parts"),
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(t, a["at"] + 1, F.length(t))),
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, merged).otherwise(t))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
