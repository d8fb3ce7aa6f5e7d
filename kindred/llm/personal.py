"""Personal data: patterns propose, checksums confirm, words nearby decide.

Patterns are written so that a text is read a constant number of times however
long its words are: no start inside a run is tried again, and repeats are
possessive, which changes no match and needs no stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.secrets import running
from kindred.llm.words import ascii_lower, let

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "national")
BEFORE, AFTER = 40, 20  # code points on either side in which a word counts
LEAST = 0.5

#: Forms of the base kinds, as what they match in plain regular expressions.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+"
GROUPS = r"(?<![0-9])[0-9]++(?:[\x20./-][0-9]++)++"

IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SSN = r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"
NOT_SSN = r"\A(?:000|666|9)|-00-|-0000\z"
NATIONAL = r"\A[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,4}\z"

#: Characters of an account number in each country that has this form.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29,
}

#: For each kind: what a confirmed match scores by itself, words that support it, words that speak against it.
SCORES = {
    "email": (0.8, "mail|email|e-mail|contact|write|correo|courriel", "noreply|no-reply|example"),
    "ip": (0.5, "ip|address|addr|host|server|client|login|from", "version|ver|release|v|section|chapter"),
    "card": (0.7, "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta", "isbn|order|invoice|serial|tracking"),
    "phone": (0.7, "phone|tel|telephone|call|mobile|cell|fax|telefon|telefono|whatsapp|sms", "isbn|order|invoice|serial"),
    "iban": (0.9, "iban|account|bank|konto|compte|cuenta", "serial|tracking"),
    "ssn": (0.4, "ssn|social|security|taxpayer", "isbn|order|invoice|serial|part"),
    "national": (0.2, "phone|tel|telephone|call|mobile|cell|fax|telefon|telefono|whatsapp|sms|passport|dni|nif", "isbn|order|invoice|serial|version"),
}
SUPPORT, AGAINST = 0.4, 0.3
_FORM = "array<struct<start:int,kind:int,end:int,score:double>>"
_CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def proposals(text: Column, pattern: str) -> Column:
    """All matches as (start, end, found, before, after): code points, end exclusive, and the text around them.

    ``before`` and ``after`` reach no further than the neighbouring match.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def placed(v: Column) -> Column:
        steps = F.transform(v["found"], lambda x, i: F.length(x) + F.length(F.get(v["gaps"], i)))
        return let(running(steps, lambda a, b: a + b), lambda ends: F.transform(v["found"], lambda x, i: F.struct(
            (F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("found"),
            F.right(F.get(v["gaps"], i), F.lit(BEFORE)).alias("before"), F.left(F.get(v["gaps"], i + 1), F.lit(AFTER)).alias("after"),
        )))

    return let(both, placed)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits ends in its check digit."""
    def add(total: Column, x: Column) -> Column:
        return total + x

    doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), add) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1: its first four characters come last, letters count from 10."""
    turned = F.concat(F.substr(account, F.lit(5)), F.left(account, F.lit(4)))
    value = F.transform(F.split(turned, ""), lambda c: F.instr(F.lit(_CHARACTERS), c) - 1)
    return F.aggregate(value, F.lit(0), lambda rest, v: (rest * F.when(v < 10, 10).otherwise(100) + v) % 97) == 1


def scored(kind: str, before: Column, after: Column) -> Column:
    """Score of a confirmed match, from 0 to 1."""
    alone, words, against = SCORES[kind]
    near = let(ascii_lower(F.concat(before, F.lit(" | "), after)), lambda t: F.lit(alone) + _said(t, words, SUPPORT) - _said(t, against, AGAINST))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), near)), 3)


def _said(text: Column, words: str, worth: float) -> Column:
    return F.when(text.rlike(f"(?:\\A|[^a-z0-9])(?:{words})(?:[^a-z0-9]|\\z)"), worth).otherwise(0.0)


def _confirmed(text: Column, kind: str, quick: str, pattern: str, good: Callable[[Column], Column], cut: Callable[[Column], Column] | None = None) -> Column:
    """Scored spans of one kind; texts that ``quick`` misses cost no more than that look."""
    end = lambda x: x["end"] if cut is None else x["start"] + F.length(cut(x))
    kept = F.transform(F.filter(proposals(text, pattern), good), lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end(x).alias("end"), scored(kind, x["before"], x["after"]).alias("score"),
    ))
    return F.when(text.rlike(quick), kept).otherwise(F.array().cast(_FORM))


def _account(found: Column) -> Column:
    """The part of a match that is as long as its country's account numbers; null for other countries and shorter matches."""
    known = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))
    size = F.try_element_at(known, F.left(found, F.lit(2)))
    return F.regexp_substr(found, F.concat(F.lit(r"\A(?:\x20?[A-Z0-9]){"), size.cast("string"), F.lit("}")))


def _good_account(x: Column) -> Column:
    def good(account: Column) -> Column:
        rest = F.concat(F.substr(x["found"], F.length(account) + 1), x["after"])
        free = ~x["before"].rlike(r"[A-Za-z0-9]\z") & ~rest.rlike(r"\A[A-Za-z0-9]")
        return F.coalesce(account.isNotNull() & free & mod_97(F.replace(account, F.lit(" "))), F.lit(False))

    return let(_account(x["found"]), good)


def _free(x: Column) -> Column:
    """Whether a run of digits is not part of a word or a longer number."""
    return ~x["before"].rlike(r"[A-Za-z0-9+]\z") & ~x["after"].rlike(r"\A[A-Za-z0-9]")


def find(docs: DataFrame, key: list[str], text: str = "text", least: float = LEAST) -> DataFrame:
    """Personal data in whole texts: ``key`` columns and ``found``, an array of (start, kind, end, score).

    The base kinds are e-mail addresses, network addresses with parts up to 255,
    card numbers of 14 to 19 digits that pass Luhn's check, and international
    telephone numbers of 10 to 15 digits; all of them are kept, whatever their
    score. To these come account numbers that pass the check modulo 97, and, where
    words nearby lift them to ``least``, social security numbers and national
    telephone or identity numbers; none that overlaps a base span. Places are code
    points, end exclusive, ordered by start and kind.

    Null text: empty, with an empty array. One row for each input row; repeated
    rows and null keys stay; other columns are ignored; an empty table gives an
    empty one. Texts are read whole, in time that grows with their length.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    part = rf"(?:{IP_PART})"
    count = lambda x: F.length(digits(x["found"]))
    base = (
        _confirmed(t, "email", "@", EMAIL, lambda x: F.lit(True)),
        _confirmed(t, "ip", r"[0-9]\.[0-9]", IP, lambda x: x["found"].rlike(rf"\A{part}\.{part}\.{part}\.{part}\z")),
        _confirmed(t, "card", r"[0-9](?:[\x20-]?[0-9]){13}", CARD, lambda x: count(x).between(14, 19) & luhn(digits(x["found"]))),
        _confirmed(t, "phone", r"\+[0-9]", PHONE, lambda x: count(x).between(10, 15)),
    )
    added = (
        _confirmed(t, "iban", r"[A-Z]{2}[0-9]{2}", IBAN, _good_account, lambda x: _account(x["found"])),
        _confirmed(t, "ssn", r"[0-9]-[0-9]", GROUPS, lambda x: _free(x) & x["found"].rlike(SSN) & ~x["found"].rlike(NOT_SSN)),
        _confirmed(t, "national", r"[0-9][\x20./-][0-9]", GROUPS, lambda x: _free(x) & x["found"].rlike(NATIONAL) & count(x).between(7, 12) & ~x["found"].rlike(SSN)),
    )
    every = F.concat(*base, *(F.filter(a, lambda x: x["score"] >= least) for a in added))
    return docs.select(*key, every.alias("_every")).select(*key, let(F.sort_array("_every"), _apart).alias("found"))


def _apart(spans: Column) -> Column:
    """Sorted spans without the added ones that overlap a base one."""
    is_base = lambda x: x["kind"] < len(BASE)
    ends = running(F.transform(spans, lambda x: F.when(is_base(x), x["end"]).otherwise(0)), F.greatest)
    starts = running(F.transform(F.reverse(spans), lambda x: F.when(is_base(x), x["start"]).otherwise(2**31 - 1)), F.least)
    return let(F.struct(ends.alias("ends"), F.reverse(starts).alias("starts")), lambda v: F.filter(
        spans, lambda x, i: is_base(x) | ((F.coalesce(F.get(v["ends"], i - 1), F.lit(0)) <= x["start"]) & (F.coalesce(F.get(v["starts"], i + 1), x["end"]) >= x["end"])),
    ))


def of_kinds(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda x: x["kind"].isin(*map(KINDS.index, kinds)))


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
