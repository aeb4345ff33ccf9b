"""Document fingerprints from closed syncmers over words.

A run of ``k`` words is an anchor when the smallest hash of its inner runs of
``s`` words lies at its first or last place.  Whether a run is an anchor
depends on the run alone, so an edit elsewhere in the text moves or removes no
anchor.  A fingerprint is the ``SKETCH`` smallest distinct anchor hashes; the
likeness of two fingerprints is the share of the smallest hashes of their union
that both have (exact Jaccard similarity for texts with few anchors).

Defined cases: words longer than ``PIECE`` characters are cut into pieces; a
text with fewer than ``k`` words has one anchor, the whole word sequence; a
null, empty or blank text has none, its fingerprint is the empty string and it
is 1.0 like another such text and 0.0 like any other; equal word sequences have
equal fingerprints; documents are ordered by doc_id (null last), ties by a hash
of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import WORD_GAP, let, shuffle_partitions

K, S, SKETCH, PIECE = 4, 2, 64, 48
_LONG_WORD = rf"[^\x20\x09-\x0D]{{{PIECE + 1}}}"
_PIECES = rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"


def tokens(text: Column) -> Column:
    return F.when(text.rlike(_LONG_WORD), F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))).otherwise(
        F.array_remove(F.split(text, WORD_GAP, -1), ""))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (position in words, hash) of the closed syncmers, in order."""
    m = k - s  # places of inner runs after the first

    def inner(w):
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (s - 1), F.lit(0))),
                           lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, s)]))

    def chosen(a):
        def one(x, i):
            run = [x] + [F.get(a, i + j) for j in range(1, m + 1)]
            edge = F.least(run[0], run[-1])
            mid = F.least(*run[1:-1]) if m > 2 else run[1]
            return F.when(edge <= mid if m > 1 else F.lit(True),
                          F.struct(i.alias("position"), F.xxhash64(*run).alias("hash")))
        return F.array_compact(F.transform(F.slice(a, 1, F.greatest(F.size(a) - m, F.lit(0))), one))

    whole = lambda w: F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(w).alias("hash")))
    none = F.array().cast("array<struct<position:int,hash:bigint>>")
    return let(tokens(F.coalesce(text, F.lit(""))), lambda w: F.when(F.size(w) == 0, none).when(
        F.size(w) < k, whole(w)).otherwise(let(inner(w), chosen)))


def sketch(text: Column, k: int = K, s: int = S, size: int = SKETCH) -> Column:
    """The smallest distinct anchor hashes, in order."""
    return F.slice(F.sort_array(F.array_distinct(anchors(text, k, s)["hash"])), 1, size)


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    both = F.array_intersect(a, b)
    lowest = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(
        (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(lowest, both)) / F.size(lowest))


def written(sk: Column) -> Column:
    return F.array_join(F.transform(sk, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``: a binary search
    over a literal array, O(log n) a row."""
    cut = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
    bits = max(1, len(cuts).bit_length())

    def step(acc, b):
        at = acc + F.element_at(F.array(*[F.lit(1 << j) for j in range(bits)]), b)
        return F.when((at <= len(cuts)) & (F.get(cut, at - 1) <= value), at).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(bits), F.lit(1), F.lit(-1)), F.lit(0), step)


def with_next(docs: DataFrame, parts: int | None = None, text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): every document with the text of the next one
    by doc_id, the first one's after the last.

    Texts move once.  Cut points are doc_ids of the table (one per partition,
    the only values that reach the driver); the document at a cut also goes to
    the end of the range before it, so each range finds its last successor
    without a second pass over the texts."""
    spark = docs.sparkSession
    parts = parts or shuffle_partitions(spark)
    ids = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts).alias("c"),
                   F.min("doc_id").alias("first")).first()
    first = ids["first"]
    cuts = sorted({c for c in (ids["c"] or []) if c > first}) if first is not None else []
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
                      ).withColumn("tie", F.xxhash64("text"))
    last = F.lit(len(cuts))
    own = F.coalesce(_place(F.col("doc_id"), cuts), last) if cuts else F.lit(0)
    put = lambda p, late: F.struct(p.cast("int").alias("range"), F.lit(late).alias("late"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.lit(first).cast("long")), F.array(put(F.col("_own"), 0), put(last, 1)))
    if cuts:
        cut = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
        at_cut = (F.col("_own") > 0) & (F.get(cut, F.col("_own") - 1) == F.col("doc_id"))
        copies = copies.when(at_cut, F.array(put(F.col("_own"), 0), put(F.col("_own") - 1, 1)))
    copies = copies.otherwise(F.array(put(F.col("_own"), 0)))
    dealt = (src.withColumn("_own", own).withColumn("_c", F.explode(copies))
             .select("doc_id", "text", "tie", "_c.range", "_c.late"))
    w = _order()
    return dealt.withColumn("next_text", F.lead("text").over(w))


def _order():
    return Window.partitionBy("range").orderBy("late", F.col("doc_id").asc_nulls_last(), "tie")


def fingerprints(docs: DataFrame, parts: int | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited text's hash and both fingerprints with their
    likeness (columns as the registered query returns them, and ``sketch``)."""
    moved = with_next(docs, parts, text)
    n, t = F.length("text"), F.col("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(t, F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    own = (moved.withColumn("edited", F.coalesce(edited, t))
           .select("doc_id", "range", "late", "tie", n.cast("long").alias("n_chars"),
                   F.sha2("edited", 256).alias("edited_sha256"),
                   sketch(t).alias("sketch"), F.when(F.col("late") == 0, sketch(F.col("edited"))).alias("edited_sketch")))
    near = own.withColumn("next_sketch", F.lead("sketch").over(_order())).where("late = 0")
    return near.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"), "sketch")
