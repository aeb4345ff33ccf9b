"""Mixing sources to target weights with a low-discrepancy schedule.

1. Every source's documents are put in a reproducible random order and cut
   into blocks of ``BLOCK`` words (the last block of a source is shorter).
2. Targets: the words of all sources are shared by weight; a target stops at
   ``MAX_EPOCHS`` times its source's words and the rest is shared again.
3. Slot ``i`` of the schedule is a golden-ratio point (integer arithmetic on 40
   bits); the cumulative slot shares map it to a source, and its rank among
   that source's slots names the block, running through the source's blocks
   again and again.
4. Golden-ratio counts differ from the wanted counts by a few slots at most;
   surplus slots of one source are given to sources that lack some.

Everything is a join, a window or an aggregate.  A source with most of the rows
is spread over ``BUCKETS`` hash ranges (order), over chunks of slots (ranks)
and over its blocks (join), so no task gets a whole source.  Tables with one
row per source are the only ones sorted as a whole.

Defined cases: a null text has 0 words and takes 0; a null source is a source
of its own, the last; repeated rows are separate documents; no documents or no
words give an empty schedule; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlake.session import ensure_checkpoint_dir

from .columns import unused, words

BLOCK = 256
MAX_EPOCHS = 3
BUCKETS = 4096
SEED = 20
POINT_BITS = 40
#: slots are ranked in chunks, and points are looked up in cells, of these sizes
CHUNK = 1 << 14
CELL_BITS = 12
#: 2^40 / golden ratio, made odd: consecutive multiples are spread evenly
STEP = int((1 << POINT_BITS) * (5 ** 0.5 - 1) / 2) | 1


def cyclic_weights(n: int = 3) -> Callable[[Column], Column]:
    """Weights 1, 2, ... n, repeating, by the rank of the source."""
    return lambda rank: (rank % n + 1).cast("double")


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source"), F.size(words(F.col(text))).cast("long").alias("size"))


def targets(per_source: DataFrame, weight: Callable[[Column], Column] = cyclic_weights(),
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with rank, weight and target.

    Filling up to a cap in closed form: in the order of cap per weight, the
    sources before the first whose cap is above the common level are full, and
    that level is (total - full caps) / (weights not full)."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    s = (per_source.withColumn("rank", F.row_number().over(everything) - 1)
         .withColumn("weight", weight(F.col("rank")))
         .withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
         .withColumn("fill", F.col("cap") / F.col("weight")))
    by_fill = Window.orderBy("fill", "rank")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = (s.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("level", F.col("left") / F.sum("weight").over(after))
         .withColumn("open", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "rank", "level"))).over(whole)))
    level = F.col("open.level")
    return s.select("source", "source_size", "rank", "weight",
                    F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def placed(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents with their offset ``start`` in the shuffled stream of words of
    their source.  ``copy`` tells repeated rows apart."""
    h = F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(seed))
    d = sized.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    assert BUCKETS == 1 << 12
    w = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    n = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    d = (d.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
         .withColumn("copy", F.row_number().over(n)))
    b = sized.withColumn("h", h).groupBy("source", F.shiftrightunsigned("h", 52).cast("int").alias("bucket")).agg(
        F.sum("size").alias("bucket_size"))
    wb = Window.partitionBy("source").orderBy("bucket")
    b = b.select("source", "bucket", (F.sum("bucket_size").over(wb) - F.col("bucket_size")).alias("offset"))
    on = d["source"].eqNullSafe(b["source"]) & (d["bucket"] == b["bucket"])
    return d.join(b, on).select(d["doc_id"], d["source"], "size", d["bucket"], "copy",
                                (F.col("offset") + F.col("before")).alias("start"))


def slot_needs(target: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per source: words to take, blocks of a pass, slots needed and its range
    of points."""
    size, goal = F.col("source_size"), F.floor("target").cast("long")
    blocks = F.ceil(size / block).cast("long")
    t = (target.where(size > 0).withColumn("goal", goal).withColumn("n_blocks", blocks)
         .withColumn("passes", F.expr("goal div source_size"))
         .withColumn("slots", F.col("passes") * F.col("n_blocks")
                     + F.ceil((F.col("goal") - F.col("passes") * size) / block).cast("long")))
    by_rank = Window.orderBy("rank")
    total = F.sum("slots").over(Window.partitionBy())
    upto = F.sum("slots").over(by_rank).cast("decimal(20,0)")
    high = F.floor(upto * F.lit(1 << POINT_BITS).cast("decimal(14,0)") / total.cast("decimal(20,0)")).cast("long")
    return (t.withColumn("total", total).withColumn("high", high)
            .withColumn("low", F.coalesce(F.lag("high").over(by_rank), F.lit(0).cast("long"))))


def _point(i: Column) -> Column:
    """i * STEP mod 2^40 without leaving 64 bits."""
    mask = (1 << POINT_BITS) - 1
    half = POINT_BITS // 2
    low = i.bitwiseAND((1 << half) - 1) * STEP
    high = (F.shiftright(i, half) * STEP).bitwiseAND((1 << half) - 1)
    return (low.bitwiseAND(mask) + F.shiftleft(high, half)).bitwiseAND(mask)


def schedule(needs: DataFrame) -> DataFrame:
    """(slot, source rank, turn): which source each slot takes from and for the
    how many-th time (from 0)."""
    spark = needs.sparkSession
    total = needs.agg(F.max("total")).first()[0] or 0
    slots = spark.range(total).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"))
    shift = POINT_BITS - CELL_BITS
    cells = needs.where("high > low").select("rank", "slots", "low", "high", F.explode(
        F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"))
    hit = (slots.withColumn("cell", F.shiftright("point", shift)).join(cells, "cell")
           .where("point >= low and point < high")
           .select("slot", "rank", "slots", F.expr(f"slot div {CHUNK}").alias("chunk")))
    n = hit.groupBy("rank", "chunk").agg(F.count(F.lit(1)).alias("n"))
    wc = Window.partitionBy("rank").orderBy("chunk")
    base = n.select("rank", "chunk", (F.sum("n").over(wc) - F.col("n")).alias("base"))
    inside = Window.partitionBy("rank", "chunk").orderBy("slot")
    turns = (hit.withColumn("r", F.row_number().over(inside) - 1).join(base, ["rank", "chunk"])
             .select("slot", "rank", "slots", (F.col("base") + F.col("r")).alias("turn")))
    # surplus slots go to the sources that got too few: a few rows per source
    got = n.groupBy("rank").agg(F.sum("n").alias("got"))
    lack = (needs.select("rank", "slots").join(got, "rank", "left")
            .withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < slots")
            .select("rank", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("turn"))
            .withColumn("k", F.row_number().over(Window.orderBy("rank", "turn"))))
    spare = (turns.where("turn >= slots").select("slot")
             .withColumn("k", F.row_number().over(Window.orderBy("slot"))))
    return (turns.where("turn < slots").select("slot", "rank", "turn")
            .unionByName(spare.join(lack, "k").select("slot", "rank", "turn")))


def mix(docs: DataFrame, weight: Callable[[Column], Column] = cyclic_weights(), block: int = BLOCK,
        text: str = "text", max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(takes, plan): per document how many of its words the mix takes (repeats
    counted), and per slot the source, block and words taken."""
    # texts are read once; ids and sizes, and one row per source, serve the rest
    ensure_checkpoint_dir(docs.sparkSession)
    sized = sizes(docs, text).checkpoint()
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    target = targets(per_source, weight, max_epochs).checkpoint()
    needs = slot_needs(target, block).checkpoint()
    at = schedule(needs).join(needs.select("rank", "source", "source_size", "n_blocks", "goal"), "rank")
    begin = F.expr(f"(turn div n_blocks) * source_size + (turn % n_blocks) * {block}")
    plan = at.select("slot", "rank", "source", F.expr("turn div n_blocks").alias("epoch"),
                     F.expr("turn % n_blocks").alias("block"),
                     F.least(F.lit(block), F.col("source_size") - F.expr(f"(turn % n_blocks) * {block}"),
                             F.col("goal") - begin).alias("words"))
    uses = plan.groupBy("rank", "block", "words").agg(F.count(F.lit(1)).alias("uses"))
    rank = target.select("rank", "source", "source_size", "target")
    p = placed(sized)
    p = (p.join(rank, p["source"].eqNullSafe(rank["source"])).drop(rank["source"])
         .select("doc_id", "source", "rank", "source_size", "target", "bucket", "copy", "start", "size",
                 F.explode(F.sequence(F.expr(f"start div {block}"),
                                      F.expr(f"greatest(start, start + size - 1) div {block}"))).alias("block")))
    piece = p.join(uses, ["rank", "block"], "left")
    first = F.greatest(F.lit(0), F.col("start") - F.col("block") * block)
    end = F.least(F.col("words"), F.col("start") + F.col("size") - F.col("block") * block)
    took = F.coalesce(F.greatest(F.lit(0), end - first) * F.col("uses"), F.lit(0))
    takes = (piece.groupBy("doc_id", "source", "rank", "bucket", "copy", "start", "size", "source_size", "target")
             .agg(F.sum(took).cast("long").alias("taken"))
             .select("doc_id", "source", "size", "source_size", "target", "taken", "rank", "start", "copy"))
    return takes, plan


def repeat(docs: DataFrame, takes: DataFrame, text: str = "text") -> DataFrame:
    """The mix as whole documents: every row as often as the mix takes its
    words, rounded (halves up), so one that is taken for less than half goes.
    Rows of one doc_id, source and size are repeated alike."""
    size, time = unused(docs, "size_of"), unused(docs, "time")
    times = takes.where("size > 0").groupBy("doc_id", "source", "size").agg(
        F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("times")).where("times > 0")
    t, d = times.alias("t"), docs.withColumn(size, F.size(words(F.col(text))).cast("long")).alias("d")
    on = (F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source"))
          & (F.col(f"d.{size}") == F.col("t.size")))
    return d.join(t, on).select(*[F.col(f"d.{c}") for c in docs.columns],
                                F.explode(F.sequence(F.lit(1), F.col("t.times"))).alias(time)).drop(time)
