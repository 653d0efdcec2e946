"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby raise their scores.

Only SQL functions run here. A pattern's matches come from regexp_extract_all, the text
between them from split with the same pattern, and the lengths of both add up to the
places. Base kinds (email, ip, card, phone) are kept whatever their score; the further
kinds (iban by mod 97, ssn by its ranges, local phone numbers) need THRESHOLD, which the
last two reach only with a context word within NEAR characters.

Defined results: a null text is an empty one and has no spans; places are code points,
the end exclusive; rows that repeat keep a row each; an empty table gives an empty one.
`spans_col` replaces a column of that name, other columns are not touched.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

NEAR = 40
THRESHOLD = 0.7
LOCAL = "A-Za-z0-9._%+-"


class Kind(NamedTuple):
    name: str
    pattern: str          # of Java's regular expressions, one match for each match of the kind's base pattern
    needs: str            # a text without this mark has no match
    words: str            # context words that raise the score
    score: float
    base: bool


#: Lengths of account numbers by country. Those of other countries end where letters and digits do.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = (r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[ ]?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_COUNTRIES.items())
        + rf"|(?!{'|'.join(IBAN_COUNTRIES.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])")

#: The order is that of the digests. Runs start where the match before ended (\G) or where no
#: character of the run comes before, and are possessive: the matches stay the same, in linear time.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", "@",
         "mail|contact|write|reach", 0.9, True),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}", ".", "ip|host|server|address|login", 0.6, True),
    Kind("card", r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", "",
         "card|visa|master|credit|debit|payment|cvv", 0.7, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "call|phone|tel|fax|mobile|whatsapp", 0.8, True),
    Kind("iban", IBAN, "",
         "iban|account|bank|konto|compte|cuenta", 0.8, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "ssn|social security|tax id", 0.4, False),
    Kind("local_phone", r"(?<![0-9+(-])(?<![0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])", "",
         "call|phone|tel|fax|mobile|whatsapp", 0.4, False),
)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1 when divided by 97."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + (code - 48)) % 97).otherwise((rest * 100 + (code - 55)) % 97)

    marks = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(marks, F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, "[.]"), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(
            F.split(match, "[.]"), lambda p: F.right(F.concat(F.lit("00"), p), F.lit(3)).cast("int") <= 255)
    if kind == "card":
        return luhn(digits_of(match))
    if kind == "phone":
        return F.length(digits_of(match)).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(000|666|9..)-|-00-|-0000$")
    return F.lit(True)


def _starts(matches: Column, between: Column) -> Column:
    """Where each match begins: the lengths of what stands before it."""
    grown = F.aggregate(
        F.sequence(F.lit(1), F.size(matches)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.element_at(between, i)) + F.length(F.element_at(matches, i))).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + F.length(F.element_at(between, i)))).alias("starts")),
        lambda acc: acc["starts"])
    return grown


SPAN = "array<struct<start:int,no:int,end:int,kind:string,score:double,base:boolean>>"


def spans_of_kind(text: Column, no: int, kind: Kind) -> Column:
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    starts = _starts(matches, F.split(text, kind.pattern, -1))

    def span(match: Column, start: Column) -> Column:
        low = F.greatest(start - NEAR, F.lit(0))
        near = F.concat(F.substring(text, low + 1, start - low), F.lit(" "),
                        F.substring(text, start + F.length(match) + 1, F.lit(NEAR)))
        score = F.lit(kind.score) + F.when(near.rlike(rf"(?i)(?<![a-z])(?:{kind.words})"), 0.3).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(no).alias("no"), (start + F.length(match)).cast("int").alias("end"),
                        F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"),
                        valid(kind.name, match).alias("ok"))

    found = F.filter(F.zip_with(matches, starts, span), lambda s: s["ok"] & (F.lit(kind.base) | (s["score"] >= THRESHOLD)))
    plain = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"),
                                                 s["kind"].alias("kind"), s["score"].alias("score"),
                                                 F.lit(kind.base).alias("base")))
    may = text.rlike(kind.pattern)
    if kind.needs:
        may = text.contains(kind.needs) & may
    return F.when(may, plain).otherwise(F.array().cast(SPAN)).cast(SPAN)


def find_personal_data(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Add the spans of each text in order: start, no (of the kind), end, kind, score, base. Nothing is shuffled.

    An added span that lies in one of a base kind is left out.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = reduce(F.concat, [spans_of_kind(text, no, k) for no, k in enumerate(KINDS) if k.base])
    more = reduce(F.concat, [spans_of_kind(text, no, k) for no, k in enumerate(KINDS) if not k.base])
    made = docs.withColumn("__base", base).withColumn("__more", more)
    clear = F.when(F.size("__more") == 0, F.col("__more")).otherwise(F.filter("__more", lambda m: ~F.exists(
        "__base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))
    return made.withColumn(spans_col, F.array_sort(F.concat("__base", clear))).drop("__base", "__more")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """The texts with [KIND] in the place of each span; of spans that overlap the first counts."""
    text = F.col(text_col)
    upto = F.aggregate(
        F.col(spans_col), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["),
                     F.upper(s["kind"]), F.lit("]")).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return docs.withColumn(text_col, F.when(text.isNotNull(), upto))
