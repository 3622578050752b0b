"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score.

Every kind has a pattern, a check and words that make it likelier within 40 characters.
``score`` is 0.5 for a match that holds its check by form alone, 0.8 where a checksum confirms
it, and 0.15 more beside a context word.  Base kinds (email, ip, card, phone) are reported
whenever their check holds; further kinds are reported from ``LEAST_SCORE`` up: account
numbers with a valid mod-97 remainder, as long as their country's are, and identity numbers of
the form 3-2-4 next to a context word.  Context is read across neighbouring matches.

One map stage without a shuffle; offsets come from running sums, so long texts stay linear.
Quantifiers are possessive and starts are anchored, so no text makes a pattern backtrack.

A NULL text is an empty one and has no spans.  Repeated rows are scanned each.  Ids may be
NULL.  Extra columns are ignored.  No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.functions.spans import bind
from exposure.llm.matches import NEAR, digits, in_order, luhn, matches, mod_97

LEAST_SCORE = 0.6
SPANS = "array<struct<start:long,rank:int,end:long,kind:string,value:string,score:double>>"

#: fixed values: pattern of each kind
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
    "id_number": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: words that make a kind likelier
CONTEXT = {
    "email": "e-?mail|contact|write|address",
    "ip": "ip|host|server|client",
    "card": "card|visa|mastercard|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "id_number": "ssn|social security|identity|id number",
}
#: the fewest characters of a match; heads of account numbers stand apart
LEAST = {"email": 5, "ip": 7, "card": 2, "phone": 4, "iban": 5, "id_number": 11}
#: characters of an account number by country
IBAN_CHARS = {
    int(part[:2]): part[2:].split() for part in (
        "15 NO", "16 BE", "18 DK FI FK FO GL NL SD", "19 MK SI", "20 AT BA EE KZ LT LU MN XK", "21 CH HR LI LV",
        "22 BG BH CR DE GB GE IE ME RS VA", "23 AE GI IL IQ OM SO TL", "24 AD CZ ES MD PK RO SA SE SK TN VG", "25 LY PT ST",
        "26 IS TR", "27 BI DJ FR GR IT MC MR SM", "28 AL AZ BY CY DO GT HN HU LB NI PL SV", "29 BR EG PS QA UA",
        "30 JO KW MU YE", "31 MT SC", "32 LC", "33 RU",
    )
}
#: of an account number after its first four characters, with blanks
BODY = 60
BASE = ("email", "ip", "card", "phone")


def _small(part: Column) -> Column:
    return part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$")


def _apart(m: Column) -> Column:
    """Not glued to letters or digits."""
    return ~m["before"].rlike("[A-Za-z0-9]$") & ~m["after"].rlike("^[A-Za-z0-9]")


def _holds(kind: str, m: Column) -> Column:
    v = m["value"]
    if kind == "ip":
        return F.forall(F.split(v, r"\."), _small)
    if kind == "card":
        return luhn(v, 12, 19)
    if kind == "phone":
        return F.length(digits(v)).between(9, 15)
    if kind == "id_number":
        return _apart(m) & ~v.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _guard(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike({"iban": "[A-Z]{2}[0-9]{2}", "id_number": "[0-9]{3}-[0-9]{2}-"}.get(kind, "[0-9]"))


def _account(m: Column) -> Column:
    """A head and what follows, as a match up to where the account number ends.

    That is the length of its country, or else the longest run; where the country is not
    known, the longest that ends at a word's edge and has a valid remainder.
    """

    def ending(n) -> Column:
        body = F.regexp_extract(m["after"], rf"^((?:\x20?[A-Z0-9]){{{n}}}+)(?![A-Za-z0-9])", 1)
        return F.when((body != "") & mod_97(F.concat(m["value"], body)), body)

    country = F.left(m["value"], F.lit(2))
    own = F.coalesce(*[F.when(country.isin(*names), ending(n - 4)) for n, names in IBAN_CHARS.items()])
    known = country.isin(*[x for names in IBAN_CHARS.values() for x in names])
    whole = ending("11,30")
    body = F.coalesce(own, whole, F.when(~known, F.coalesce(*[ending(n) for n in range(30, 10, -1)])), F.lit(""))

    def closed(b: Column) -> Column:
        return F.struct(
            m["start"].alias("start"), (m["end"] + F.length(b)).alias("end"), F.concat(m["value"], b).alias("value"),
            F.right(m["before"], F.lit(NEAR)).alias("before"), F.substr(m["after"], F.length(b) + 1, F.lit(NEAR)).alias("after"),
        )

    return bind(body, closed)


def _accounts(text: Column) -> Column:
    """Account numbers; one that starts inside another is part of it."""
    heads = matches(text, PATTERNS["iban"], _guard("iban", text), BODY + 1 + NEAR, LEAST["iban"])
    valid = F.filter(F.transform(heads, _account), lambda m: (F.length(m["value"]) > 4) & mod_97(m["value"]))

    def outer(found: Column) -> Column:
        def alone(m: Column, i: Column) -> Column:
            n = F.least(i, F.lit(13))
            return ~F.exists(F.slice(found, i - n + 1, n), lambda other: other["end"] > m["start"])

        return F.filter(found, alone)

    return bind(valid, outer)


def _spans(kind: str, rank: int, text: Column) -> Column:
    near = f"(?i)(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])"
    sure = 0.8 if kind in ("card", "iban") else 0.5

    def scored(m: Column) -> Column:
        beside = m["before"].rlike(near) | m["after"].rlike(near)
        return F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"),
            m["value"].alias("value"), (F.lit(sure) + F.when(beside, 0.15).otherwise(0.0)).alias("score"),
        )

    if kind == "iban":
        held = _accounts(text)
    else:
        held = F.filter(matches(text, PATTERNS[kind], _guard(kind, text), least=LEAST[kind]), lambda m: _holds(kind, m))
    found = F.transform(held, scored)
    return found if kind in BASE else F.filter(found, lambda s: s["score"] >= LEAST_SCORE)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, spans)``, one row per input row; spans by start, then kind."""
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = [_spans(kind, rank, F.col("text")) for rank, kind in enumerate(PATTERNS)]
    return texts.select("doc", in_order(F.concat(*kinds)).cast(SPANS).alias("spans"))
