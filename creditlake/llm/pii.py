"""Personal data spans: regular expressions propose, checksum validators
confirm, nearby context words adjust the score.  A context word counts within
``CONTEXT_CHARS`` characters before or after a match, whatever else matched there.

All work is inside the row with built-in functions: a text is cut by a pattern
(``split``) and the matches are taken by the same pattern
(``regexp_extract_all``); a fold over the alternating pieces gives every match
its code point offsets, its validity and its score.  Patterns are possessive
and anchored at the start of their run, so a scan is linear in the text and
needs no recursion; they match what the plain patterns match.

Defined cases: a null text is the empty text and has no spans; spans of
different kinds may overlap; repeated rows each give their own row; all other
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let

ACCEPT = 0.5
#: characters before a match, and after it, in which context words are looked for
CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Detector:
    """``valid`` and ``invalid`` are the scores of a match whose validator
    holds or fails; a context word adds ``boost``.  A match counts from
    ``ACCEPT`` on.  ``hint`` must be true for texts that can match at all."""
    kind: str
    pattern: str
    hint: Callable[[Column], Column]
    check: Callable[[Column], Column] | None
    valid: float
    invalid: float
    context: str = ""
    boost: float = 0.0


def _n_digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    def step(acc, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(account: Column) -> Column:
    """IBAN check: first four characters last, letters as 10 to 35, remainder 1."""
    def step(acc, c):
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise(
            (acc * 100 + F.ascii(c) - 55) % 97)
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    return F.aggregate(F.split(turned, "", -1), F.lit(0), step) == 1


def _card(m: Column) -> Column:
    return let(F.regexp_replace(m, "[^0-9]", ""),
               lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))


def _ip(m: Column) -> Column:
    def small(p):
        return let(F.ltrim(p, F.lit("0")), lambda z: F.when(F.length(z) > 3, F.lit(False)).when(
            F.length(z) == 0, F.lit(True)).otherwise(z.cast("int") <= 255))
    return F.forall(F.split(m, r"\.", -1), small)


def _has(char: str) -> Callable[[Column], Column]:
    return lambda t: t.contains(char)


def _has_digit(t: Column) -> Column:
    return t.rlike("[0-9]")


#: the base kinds, in the order that breaks ties between spans of one start
BASE = (
    Detector("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
             _has("@"), None, 1.0, 0.0),
    Detector("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _has_digit, _ip, 1.0, 0.0),
    Detector("card", r"[0-9](?:[\x20-]?[0-9])++", _has_digit, _card, 1.0, 0.0),
    Detector("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _has("+"), lambda m: _n_digits(m).between(9, 15), 1.0, 0.0),
)
#: spans that validators or context words add to the base kinds
ADDED = (
    Detector("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
             _has_digit, lambda m: mod97(F.regexp_replace(m, " ", "")), 0.9, 0.1, r"\b(?:iban|konto|account|compte|cuenta)\b", 0.3),
    Detector("account", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])", _has_digit, lambda m: ~_card(m), 0.3, 0.0,
             r"\b(?:card|credit|visa|mastercard|carte|karte|tarjeta|account|konto|compte|cuenta)\b", 0.3),
    Detector("local_phone", r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])", _has_digit, None, 0.3, 0.0,
             r"\b(?:phone|tel|call|fax|mobile|telefon|appel|llame)\b", 0.3),
    Detector("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _has_digit,
             lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.4, 0.0, r"\b(?:ssn|social|security)\b", 0.4),
    Detector("secret", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{24,}+", _has_digit,
             lambda m: m.rlike("[A-Za-z]") & ~m.rlike("^[0-9-]+$"), 0.3, 0.0,
             r"\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|bearer)\b", 0.4),
)
DETECTORS = BASE + ADDED
SPAN = "struct<start:bigint,kind_no:int,end:bigint,kind:string,score:double>"


def _spans_of(text: Column, no: int, d: Detector) -> Column:
    """Accepted spans of one detector, in order."""
    def fold(pieces):
        def step(acc, x):
            start = acc["pos"] + F.length(x["gap"])
            end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
            holds = F.lit(True) if d.check is None else F.coalesce(d.check(x["hit"]), F.lit(False))
            score = F.when(holds, F.lit(d.valid)).otherwise(F.lit(d.invalid))
            if d.context:
                before = F.right(F.concat(acc["tail"], x["gap"]), F.lit(CONTEXT_CHARS))
                near = F.lower(F.concat_ws("\n", before, x["after"])).rlike(d.context)
                score = score + F.when(near, F.lit(d.boost)).otherwise(F.lit(0.0))
            hit = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"),
                           F.lit(d.kind).alias("kind"), score.alias("score"))
            out = F.when(x["hit"].isNull(), acc["out"]).otherwise(let(hit, lambda h: F.when(
                h["score"] >= ACCEPT, F.concat(acc["out"], F.array(h))).otherwise(acc["out"])))
            tail = F.right(F.concat(acc["tail"], x["gap"], F.coalesce(x["hit"], F.lit(""))), F.lit(CONTEXT_CHARS)) \
                if d.context else F.lit("")
            return F.struct(end.cast("long").alias("pos"), tail.alias("tail"), out.alias("out"))
        zero = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("tail"),
                        F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(pieces, zero, step, lambda acc: acc["out"])

    hits = F.regexp_extract_all(text, F.lit(d.pattern), F.lit(0))
    # a lookahead takes what follows each match without changing the matches
    after = F.regexp_extract_all(text, F.lit(d.pattern + f"(?=((?s:.{{0,{CONTEXT_CHARS}}})))"), F.lit(1)) \
        if d.context else F.transform(hits, lambda h: F.lit(""))
    found = F.zip_with(hits, after, lambda h, a: F.struct(h.alias("hit"), a.alias("after")))
    pieces = F.zip_with(F.split(text, d.pattern, -1), found, lambda g, h: F.struct(
        F.coalesce(g, F.lit("")).alias("gap"), h["hit"].alias("hit"), h["after"].alias("after")))
    return F.when(d.hint(text), fold(pieces)).otherwise(F.array().cast(f"array<{SPAN}>"))


def spans(text: Column, detectors: tuple[Detector, ...] = DETECTORS) -> Column:
    """All accepted spans of a text by start, then kind as listed, then end."""
    t = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_spans_of(t, i, d) for i, d in enumerate(detectors)]))


def find(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """The input with the array of spans ``into`` (start, end exclusive, kind, score)."""
    return docs.withColumn(into, spans(F.col(text)))


def written(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of
    overlapping spans the first is named and all are removed."""
    def step(t):
        def one(acc, s):
            fresh = s["start"] >= acc["pos"]
            gap = F.substring(t, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
            return F.struct(
                F.greatest(acc["pos"], s["end"]).alias("pos"),
                F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))
                .otherwise(acc["out"]).alias("out"))
        return one

    def run(t):
        zero = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))
        return F.aggregate(found, zero, step(t), lambda acc: F.concat(
            acc["out"], F.substring(t, (acc["pos"] + 1).cast("int"), F.length(t))))
    return F.when(text.isNull() | (F.size(found) == 0), text).otherwise(let(text, run))
