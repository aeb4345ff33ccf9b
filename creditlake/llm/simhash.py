"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has bit j set when over half of the hashes of the text's word
shingles have it.  Fingerprints within ``distance`` bits are linked, and linked
documents form components.

Pigeonring: cut the 64 bits into distance + 1 segments on a ring.  If two
fingerprints differ in at most ``distance`` bits, some segment starts a chain
whose first l segments differ in at most floor(l * distance / segments) bits
for every l; so the first segment is equal, the first two differ in at most one
bit.  Candidates are therefore found by an equality join on (start, first
segment, second segment), where one side also offers the second segment with
each bit flipped.  Longer chains and the full distance are checked on what
meets.  Equal fingerprints are one class before any join, so copies never form
pairs.

Defined cases: a null or blank text has fingerprint 0, which is linked like any
other; a text with fewer words than a shingle has one, the whole sequence;
repeated rows are in one class; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.session import ensure_checkpoint_dir

from .columns import unused
from .components import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
#: hashes turned into bits at once (64 bytes each)
_ROWS = 1 << 15


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; bytes.lower and bytes.split
    touch A-Z and the six ASCII white-space characters only."""
    w = text.lower().split()
    if not w:
        return 0
    runs = zip(*(w[i:] for i in range(size))) if len(w) > size else [w]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(join(r), SEED) for r in runs), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), _ROWS):
        bits = np.unpackbits(h[i:i + _ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    on = (2 * counts > len(h)).astype(np.uint8)
    return int(np.packbits(on, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per input row."""
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            out = pa.array([fingerprint(t.as_py() or b"", size) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "fp"])
    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the ring's segments."""
    m = distance + 1
    edges = [64 * i // m for i in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct ``fp`` within the distance."""
    seg = _segments(distance)
    m = len(seg)

    def part(fp, i):
        lo, width = seg[i % m]
        return F.shiftrightunsigned(fp, lo).bitwiseAND((1 << width) - 1)

    def starts(i, second):
        return F.struct(F.lit(i).alias("i"), part(F.col("fp"), i).alias("first"), second.alias("second"))

    exact = F.array(*[starts(i, part(F.col("fp"), i + 1)) for i in range(m)])
    near = F.array(*[starts(i, part(F.col("fp"), i + 1).bitwiseXOR(F.lit(flip).cast("long")))
                     for i in range(m) for flip in [0] + [1 << b for b in range(seg[(i + 1) % m][1])]])
    index = fps.select(F.col("fp").alias("a"), F.inline(exact))
    probe = fps.select(F.col("fp").alias("b"), F.inline(near))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(True)
    for i in range(m):
        so_far, holds = F.lit(0), F.lit(True)
        for length in range(1, m + 1):
            so_far = so_far + F.bit_count(part(diff, i + length - 1))
            holds = holds & (so_far <= length * distance // m)
        chain = F.when(F.col("i") == i, holds).otherwise(chain)
    return (index.join(probe, ["i", "first", "second"]).where("a < b").where(chain)
            .where(F.bit_count(diff) <= distance).select("a", "b").distinct())


def groups(docs: DataFrame, text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, and component_id, the smallest doc_id reachable by links."""
    ensure_checkpoint_dir(docs.sparkSession)
    fps = fingerprints(docs, text, size).checkpoint()
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).checkpoint()
    member = components(links(classes, distance)).checkpoint()
    of = (classes.join(member, classes["fp"] == member["node"], "left")
          .select("fp", "rep", F.coalesce("component", "fp").alias("root")))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    told = of.join(least, "root").select("fp", "component_id").checkpoint()
    return fps.join(told, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The rows that stay: one of each component, the smallest by doc_id, then by
    a hash of the text; rows of one doc_id but of different components all stay.
    Of rows equal in both, the smallest by the other columns stays.  Documents
    without a doc_id can't be named and stay."""
    ensure_checkpoint_dir(docs.sparkSession)
    tag = unused(docs, "tag")
    rows = docs.where("doc_id is not null").withColumn(tag, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))

    def run(batches):
        for b in batches:
            texts = b.column(2).cast(pa.large_binary())
            out = pa.array([fingerprint(t.as_py() or b"", size) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out], names=["doc_id", "tag", "fp"])
    fps = rows.select(F.col("doc_id").cast("long"), tag, F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, tag long, fp long")
    # of equal fingerprints one row can stay at most
    classes = fps.groupBy("fp").agg(F.min(F.struct("doc_id", "tag")).alias("row")).checkpoint()
    member = components(links(classes, distance)).checkpoint()
    root = classes.join(member, classes["fp"] == member["node"], "left").select(F.coalesce("component", "fp").alias("root"), "row")
    keep = root.groupBy("root").agg(F.min("row").alias("row")).select(
        F.col("row.doc_id").alias("keep_id"), F.col("row.tag").alias("keep_tag"))
    d, k = rows.alias("d"), keep.alias("k")
    stay = d.join(k, (F.col("d.doc_id") == F.col("k.keep_id")) & (F.col(f"d.{tag}") == F.col("k.keep_tag")), "left_semi")
    whole = stay.groupBy("doc_id", tag).agg(F.min(F.struct(*docs.columns)).alias("stay"))
    return whole.select(*[F.col("stay")[c].alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
