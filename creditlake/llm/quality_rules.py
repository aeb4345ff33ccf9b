"""Rule bitmask ledger: every rule is evaluated once per document, its failure
is one bit and its measurements are columns.  Policies are versioned bit masks
applied to the stored ledger; ablations are bitwise aggregations over it, so a
new policy never reads a text again.

Defined cases: a null or empty text has no words and fails ``few_words``;
repeated rows are judged one by one; an empty table gives empty results; extra
columns of the input are left out of the ledger (``kept`` keeps them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, words

SYMBOLS = "#*$%&|<>"
#: fixed values: capital letters of the Latin-1 languages of the corpus
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"

#: measurements of the ledger, in order
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_capitals", "n_exclaims")

#: rule name -> SQL predicate over the measurements that is true when the rule
#: FAILS; the position in this list is the rule's bit and never changes (new
#: rules are appended)
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_ratio", "10 * n_symbols > n_words"),
    ("capital_ratio", "10 * n_capitals > 4 * word_chars"),
    ("exclaim_ratio", "5 * n_exclaims > n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("repeated_lines", "n_lines >= 10 and 2 * n_dup_lines > n_lines"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; ``mask`` has the bits that reject."""
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(BIT))


def _removed(text: Column, chars: str) -> Column:
    """How many characters of ``chars`` the text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _dup_lines(text: Column) -> Column:
    """(lines with a word, those of them equal to an earlier line)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    return let(lines, lambda a: F.struct(
        F.size(a).cast("long").alias("n"),
        (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))


def repeat_words(w: Column, size: int = 3) -> Column:
    """Words covered by ``size``-word windows that occur twice or more.

    Windows are hashed (64 bit) and sorted with their positions; equal
    neighbours are repeats.  A kept window adds the words up to the next kept
    window, at most ``size``."""
    def windows(a):
        return F.transform(
            F.slice(a, 1, F.greatest(F.size(a) - (size - 1), F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, *[F.get(a, i + j) for j in range(1, size)]).alias("h"), i.alias("i")))

    def repeated(s):
        return F.sort_array(F.transform(
            F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])),
            lambda x: x["i"]))

    def covered(p):
        return F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size)))),
            F.lit(0).cast("long"), lambda acc, x: acc + x)

    # comparisons with a missing neighbour are null, which filter() drops
    return let(w, lambda a: let(F.sort_array(windows(a)), lambda s: let(repeated(s), covered)))


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``keep`` columns and the measurements."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*keep, F.struct(
        words(t).alias("w"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _removed(t, SYMBOLS).alias("n_symbols"),
        _dup_lines(t).alias("lines"),
        _removed(t, CAPITALS).alias("n_capitals"),
        _removed(t, "!").alias("n_exclaims")).alias("_m"))
    m = F.col("_m")
    return base.select(
        *keep, F.size(m["w"]).cast("long").alias("n_words"), m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"), m["lines"]["dup"].alias("n_dup_lines"),
        repeat_words(m["w"]).alias("n_repeat_words"), m["lines"]["n"].alias("n_lines"),
        m["n_capitals"].alias("n_capitals"), m["n_exclaims"].alias("n_exclaims"))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and ``failed``, the bit mask of the rules that fail."""
    bits = F.lit(0).cast("long")
    for name, predicate in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(predicate), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, text, keep).select("*", bits.alias("failed"))


def fails(policy: Policy) -> Column:
    """True for ledger rows that the policy rejects."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, documents that only it
    rejects, and documents kept if it were dropped.  The ledger is first
    reduced to one row per distinct mask (at most 2^rules)."""
    masks = (led.select(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("m"))
             .groupBy("m").agg(F.count(F.lit(1)).alias("n")))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"))
                                for r in policy.rules]))
    r = masks.select("m", "n", rules.alias("r")).select("m", "n", "r.rule", "r.bit")
    without = F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0
    zero = F.lit(0).cast("long")
    return r.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(zero)).alias("n_only"),
        F.sum(F.when(without, F.col("n")).otherwise(zero)).alias("kept_without"),
    ).withColumn("policy", F.lit(f"{policy.name}:{policy.version}"))


def failed_by(led: DataFrame, *keys: str) -> DataFrame:
    """Per group: rules that any document, and that every document, fails."""
    return led.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"),
                                  F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"))


def judge(docs: DataFrame, policy: Policy = STANDARD, text: str = "text",
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Ledger with ``base_failed`` and ``kept`` under the policy."""
    return ledger(docs, text, keep).select("*", fails(BASE).alias("base_failed"),
                                           (~(fails(policy) | fails(BASE))).alias("kept"))
