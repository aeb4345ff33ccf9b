"""The trie of conversation prefixes: which turns do conversations share?

*Turns in order.*  Rows are dealt by ranges of (conversation, turn), numbered
inside a range and shifted by what the ranges before hold, so a conversation of
any length is numbered by many tasks.

*Whole-sequence collapse.*  A sequence is named by its length and two 64-bit
sums (exclusive or) of hashes of its turns with their places, which need no
order and are summed where the turns are.  Identical conversations become one
weighted sequence with a list of the conversations that end there; only its
smallest conversation goes on.

*Prefixes.*  The names of all prefixes are running sums, made in blocks of
``BLOCK`` turns that are then shifted by the blocks before.  Sequences that are
not found (anti-join) among the proper prefixes are the leaves.  Weights are
summed by prefix.  What a subtree saves is linear too: every turn of every
member, less every node once; a node is counted with the smallest sequence
through it, and the nodes that are a sequence's own are its last ones.

Defined cases: null role or text is empty; a null turn comes first; turns of
equal number are ordered by role, then text, and repeated rows stay repeated;
rows without a conversation id belong to no conversation and are left out; very
long texts are hashed whole; an empty table has no node; other columns are not
read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditlake.session import ensure_checkpoint_dir, scratch_path

from .columns import shuffle_partitions

#: turns of a block of running sums; conversations of a chunk of an end list
BLOCK, END_IDS = 4096, 4096
NODE = ["depth", "x", "y"]


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), role and text of every turn, in order."""
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        # repeated rows are interchangeable; this number lets a range end between them
        F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), "role", "text", "row"]
    parts = shuffle_partitions(conversations.sparkSession)
    dealt = _stored(rows.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    # a conversation that begins in an earlier range: one at most for each range
    sizes = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("conv_id", "part", F.sum("n").over(
        Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before")).where("before > 0")
    ranked = dealt.withColumn("nr", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    return ranked.join(F.broadcast(before), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("nr") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "role", "text")


def hashed(turns: DataFrame) -> DataFrame:
    """conv_id, pos, two hashes of the turn and the length of its text."""
    return turns.select("conv_id", "pos", F.xxhash64(F.lit(1), "role", "text").alias("a"),
                        F.xxhash64(F.lit(2), "role", "text").alias("b"), F.length("text").cast("long").alias("len"))


def rebuild(turns: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(convs, turns): every conversation c begins with the first
    h = crc32(c) % ``heads`` turns of conversation c - c % ``group`` and goes on
    with its own turns after the first h.  ``convs`` also has those without a
    turn.  The remainder of a negative id is negative, as in SQL."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    rest = [c for c in turns.columns if c not in ("conv_id", "pos")]
    first = turns.where(F.col("pos") < heads)
    had = first.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("had"))
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    convs = convs.join(had, "base", "left").select(
        "conv_id", "h", "base", F.least("h", F.coalesce("had", F.lit(0))).alias("k")).checkpoint()
    taken = convs.join(first.withColumnRenamed("conv_id", "base"), "base").where("pos <= h").select("conv_id", "pos", *rest)
    own = turns.where(F.col("pos") > h).join(convs, "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), *rest)
    return convs.select("conv_id"), taken.unionByName(own)


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with the two hashes of the turn at its place."""
    return turns.select("conv_id", "pos", F.xxhash64("pos", "a", "b").alias("gx"), F.xxhash64("b", "a", "pos").alias("gy"), "len")


def sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, the name of its whole sequence (depth, x, y) and ``total``, the
    length of its texts; ``turns`` as of ``hashed``."""
    sums = _placed(turns).groupBy("conv_id").agg(
        F.max("pos").alias("depth"), F.bit_xor("gx").alias("x"), F.bit_xor("gy").alias("y"), F.sum("len").alias("total"))
    return convs.join(sums, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*NODE, "total")])


def prefixes(groups: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each place of each distinct sequence and one for its root:
    conv_id, w, total, last (its depth); the name of the prefix and of the one
    before (px, py); ``upto``, the length of the texts up to here, and ``len``."""
    rows = _placed(turns).join(groups.select("conv_id", "w", "total", F.col("depth").alias("last")), "conv_id")
    rows = rows.withColumn("block", F.expr(f"(pos - 1) div {BLOCK}"))
    run = Window.partitionBy("conv_id", "block").orderBy("pos")
    rows = rows.select("*", F.bit_xor("gx").over(run).alias("x"), F.bit_xor("gy").over(run).alias("y"), F.sum("len").over(run).alias("upto"))
    whole = rows.where("last > %d" % BLOCK).groupBy("conv_id", "block").agg(
        F.bit_xor("gx").alias("bx"), F.bit_xor("gy").alias("by"), F.sum("len").alias("bt"))
    past = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    past = whole.select("conv_id", "block", F.bit_xor("bx").over(past).alias("bx"), F.bit_xor("by").over(past).alias("by"),
                        F.sum("bt").over(past).alias("bt")).where("block > 0")
    rows = rows.join(past, ["conv_id", "block"], "left")
    x, y = (F.col(c).bitwiseXOR(F.coalesce(b, F.lit(0))) for c, b in (("x", "bx"), ("y", "by")))
    rows = rows.select("conv_id", "w", "total", "last", F.col("pos").alias("depth"), x.alias("x"), y.alias("y"),
                       x.bitwiseXOR(F.col("gx")).alias("px"), y.bitwiseXOR(F.col("gy")).alias("py"),
                       (F.col("upto") + F.coalesce("bt", F.lit(0))).alias("upto"), "len")
    zero = F.lit(0).cast("long")
    roots = groups.select("conv_id", "w", "total", F.col("depth").alias("last"), zero.alias("depth"), zero.alias("x"), zero.alias("y"),
                          F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), zero.alias("upto"), zero.alias("len"))
    return rows.unionByName(roots)


def end_lists(members: DataFrame) -> DataFrame:
    """depth, x, y, ``nr`` and ``ids``: the conversations that are exactly this
    sequence, ascending, in chunks of at most ``END_IDS`` ids; ``nr`` is the
    first id of the chunk."""
    dealt = members.select(*NODE, "conv_id").repartitionByRange(
        shuffle_partitions(members.sparkSession), *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    most = END_IDS

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns]
            new = np.zeros(b.num_rows, bool)
            new[::most] = True
            for c in cols[:3]:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            ids = pa.ListArray.from_arrays(pa.array(np.append(at, b.num_rows), pa.int32()), b.column(3))
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in cols] + [ids], names=[*NODE, "nr", "ids"])
    return dealt.mapInArrow(run, "depth long, x long, y long, nr long, ids array<long>")


def end_hashes(ends: DataFrame) -> DataFrame:
    """depth, x, y and the SHA-256 of the decimal ids joined by commas.  A hash
    has one order, so one task reads the chunks of a sequence, one at a time."""
    dealt = ends.repartition(shuffle_partitions(ends.sparkSession), *NODE).sortWithinPartitions(*NODE, "nr")

    def run(batches):
        node, h = None, None

        def row():
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in node], pa.array([h.hexdigest()])],
                                              names=[*NODE, "ends_sha256"])
        for b in batches:
            for *key, _, ids in zip(*b.columns):
                key = [k.as_py() for k in key]
                text = ",".join(map(str, ids.as_py())).encode()
                if key == node:
                    h.update(b"," + text)
                else:
                    if node is not None:
                        yield row()
                    node, h = key, hashlib.sha256(text)
        if node is not None:
            yield row()
    return dealt.mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): a row for each distinct prefix of the sequences of
    ``convs`` (turns as of ``hashed``), named by (depth, x, y), with conv_id
    (smallest member), parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens; and the lists of the conversations that end at a node."""
    ensure_checkpoint_dir(convs.sparkSession)
    turns = _stored(turns, "trie_turns")
    members = _stored(sequences(convs, turns), "trie_sequences")
    groups = members.groupBy(*NODE).agg(F.count(F.lit(1)).alias("w"), F.min("conv_id").alias("conv_id"),
                                        F.first("total").alias("total")).checkpoint()
    rows = _stored(prefixes(groups, turns), "trie_prefixes")

    proper = rows.where("depth < last").select(*NODE).distinct()
    leaves = groups.join(proper, NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    # how far (in text) a sequence runs through nodes that are a smaller one's
    # stored, so that both sides of the join are plain shuffles and a prefix of very many sequences can be split
    owner = rows.groupBy(*NODE).agg(F.min("conv_id").alias("owner")).checkpoint()
    shared = rows.join(owner, NODE).where("owner <> conv_id").groupBy("conv_id").agg(F.max("upto").alias("shared"))
    info = groups.select("conv_id").join(leaves, "conv_id", "left").join(shared, "conv_id", "left").select(
        "conv_id", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("shared", F.lit(0)).alias("shared"))
    above = F.col("upto") - F.col("len")
    nodes = rows.join(info, "conv_id").groupBy(*NODE, "px", "py").agg(
        F.min("conv_id").alias("conv_id"), F.sum("w").alias("n_convs"), F.sum("leaf").cast("long").alias("n_leaves"),
        F.sum(F.col("w") * (F.col("total") - above) - (F.col("total") - F.greatest(above, "shared"))).alias("saved_tokens")).checkpoint()

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"),
                           F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, ["depth", "px", "py"], "left").join(children, NODE, "left")
    return nodes.select(*NODE, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                        "n_leaves", "saved_tokens"), end_lists(members)


def last_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the role and text of their last turn (root: null), from
    the ``turns`` of the sequences."""
    found = turns.select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return nodes.join(found, ["conv_id", "depth"], "left")


def with_end_hashes(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``nodes`` with ends_sha256; that of the empty string where none ends."""
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(end_hashes(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
