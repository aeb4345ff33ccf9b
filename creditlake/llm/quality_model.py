"""Quality classifier: an interpolated modified Kneser-Ney n-gram model per
language, trained on trusted text, gives every document a perplexity that a
quantile of its language judges.

Every ``HOLD_OUT``-th trusted document (by a hash of its id) is left out of
training; the quantile is taken over these, so that it speaks of texts that the
model has not seen.

The model's tokens are characters (``ORDER`` of them): the words of the corpus
are an open set, its spelling is not.  Counts of all n-grams of all trusted
documents are aggregated, smoothed and joined as tables sharded by n-gram; no
count, table or document is kept in one place.

How scores meet documents without moving one row per character: documents are
packed into chunks (a few million characters of one language) in a table
bucketed by chunk.  A chunk offers its distinct n-grams, which are joined with
the sharded counts, and gets back one log probability each.  Both joins of
chunks use the bucketing, so packed texts are written once and never shuffled.

Defined cases: a null or empty text has no perplexity and is not kept; a null
language is the language ''; a language without trusted text has no model, its
documents have no perplexity and are kept (nothing speaks against them), as are
those of a language without held-out documents;
repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlake.session import scratch_path

from .columns import shuffle_partitions

ORDER = 4
CHUNK_CHARS = 1 << 22
HOLD_OUT = 5
#: share of a language's held-out trusted documents whose perplexity is accepted
QUANTILE = 0.995
#: added to the quantile of the log perplexity
MARGIN = 0.0
#: log perplexities are ranked in bins of this width
BIN = 0.001
PAD = "\n" * (ORDER - 1)
PACKED = "chunk long, lang string, doc_ids array<long>, tags array<long>, sizes array<long>, body binary"
#: places of a chunk worked on at once
SLICE = 1 << 19
#: tables with one row per language are sent to all tasks up to this many rows
LANGUAGES = 10_000


def _by_language(table: DataFrame) -> DataFrame:
    """A table with one row per language, ready to be joined: computed once, and
    broadcast if it is as small as it should be, so that the rows of a language
    with most of the corpus are not dealt out by it."""
    table = table.checkpoint()
    return F.broadcast(table) if table.limit(LANGUAGES + 1).count() <= LANGUAGES else table


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


# chunks

def pack(docs: DataFrame, text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows of ``PACKED``: the padded texts of some documents of one language.
    ``tags`` are text hashes, which tell rows of one doc_id apart."""
    def run(batches):
        at = TaskContext.get().partitionId() << 24
        open_: dict[str, list] = {}

        def row(lang, d):
            nonlocal at
            at += 1
            body = zstandard.ZstdCompressor(3).compress("".join(d[3]).encode())
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([lang])] + [pa.array([x], pa.list_(pa.int64())) for x in d[:3]]
                + [pa.array([body], pa.binary())], names=["chunk", "lang", "doc_ids", "tags", "sizes", "body"])
        for b in batches:
            for doc, tag, lang, t in zip(*[c.to_pylist() for c in b.columns]):
                d = open_.setdefault(lang, [[], [], [], [], 0])
                for x, y in zip(d, (doc, tag, len(t), PAD + t)):
                    x.append(y)
                d[4] += len(t) + len(PAD)
                if d[4] >= chunk_chars:
                    yield row(lang, open_.pop(lang))
        for lang, d in open_.items():
            yield row(lang, d)
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(t), F.coalesce("lang", F.lit("")), t).mapInArrow(run, PACKED)


class _Chunk:
    """Code points, sizes and n-gram keys of a packed row.

    A key is a 64-bit number made of the n-gram's characters by their rank
    among the characters of the chunk, so keys are exact and can be turned back
    into text.  Where a chunk has too many characters for that, the symbols are
    its distinct character pairs instead."""

    def __init__(self, row: dict):
        text = zstandard.ZstdDecompressor().decompress(row["body"]).decode() if row["body"] else ""
        self.sizes = np.array(row["sizes"], np.int64)
        self.begin = np.cumsum(self.sizes + len(PAD)) - self.sizes - len(PAD)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.n = max(0, len(points) - ORDER + 1)
        used = np.flatnonzero(np.bincount(points))
        self.span = 1 if len(used) <= 1 << 64 // ORDER else 2
        if self.span == 1:
            self.table = used.astype(np.uint32)[:, None]
            self.rank = np.zeros(used[-1] + 1, np.uint32)
            self.rank[used] = np.arange(len(used))
            self.symbols = self.rank[points]
        else:
            pairs, at = np.unique(_pairs(points[:-1], points[1:]), return_inverse=True)
            self.table = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
            self.rank, self.symbols = pairs, at.astype(np.uint32)
        self.bits = np.uint64(64 // (ORDER // self.span))

    def _joined(self, columns: list[np.ndarray]) -> np.ndarray:
        key = columns[0].astype(np.uint64)
        for c in columns[1:]:
            key = key << self.bits | c
        return key

    def keys(self, lo: int, hi: int) -> np.ndarray:
        """Keys of the n-grams that begin at places lo:hi of the packed text."""
        return self._joined([self.symbols[lo + k:hi + k] for k in range(0, ORDER, self.span)])

    def distinct(self, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts) over the n-grams of the documents, one n-gram per
        character; n-grams that cross into the next document are none of it."""
        docs = np.ones(len(self.sizes), bool) if docs is None else docs
        edge = np.zeros(self.n + 1, np.int32)
        np.add.at(edge, self.begin[docs], 1)
        np.add.at(edge, self.begin[docs] + self.sizes[docs], -1)
        mine = np.cumsum(edge[:-1]) > 0
        parts = [np.unique(self.keys(lo, min(lo + SLICE, self.n))[mine[lo:lo + SLICE]], return_counts=True)
                 for lo in range(0, self.n, SLICE)] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

    def grams(self, keys: np.ndarray) -> list[str]:
        mask = (np.uint64(1) << self.bits) - np.uint64(1)
        m = ORDER // self.span
        points = np.concatenate([self.table[(keys >> self.bits * np.uint64(m - 1 - k)) & mask] for k in range(m)], axis=1)
        s = np.ascontiguousarray(points, "<u4").tobytes().decode("utf-32-le")
        return [s[i:i + ORDER] for i in range(0, len(s), ORDER)]

    def keys_of(self, grams: list[str]) -> np.ndarray:
        """Keys of n-grams of this chunk."""
        points = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER).T
        if self.span == 1:
            return self._joined([self.rank[p] for p in points])
        return self._joined([np.searchsorted(self.rank, _pairs(a, b)).astype(np.uint64) for a, b in zip(points[::2], points[1::2])])

    def sums(self, known: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Per document the sum of the values of its n-grams' keys."""
        order = np.argsort(known)
        known, value = known[order], value[order]
        upto = np.zeros(self.n + 1)
        for lo in range(0, self.n, SLICE):
            hi = min(lo + SLICE, self.n)
            at = np.searchsorted(known, self.keys(lo, hi))      # a key between documents may be unknown; it is in no sum
            upto[lo + 1:hi + 1] = value[np.minimum(at, len(known) - 1)]
        np.cumsum(upto, out=upto)
        return upto[self.begin + self.sizes] - upto[self.begin]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def _chunk_grams(chunks: DataFrame) -> DataFrame:
    """(chunk, lang, gram): the distinct n-grams of each chunk."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c = _Chunk(r)
                grams = c.grams(c.distinct()[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), r["chunk"])), pa.array([r["lang"]] * len(grams), pa.string()),
                     pa.array(grams, pa.string())], names=["chunk", "lang", "gram"])
    return chunks.mapInArrow(run, "chunk long, lang string, gram string")


def _trusted_counts(chunks: DataFrame, trusted: DataFrame) -> DataFrame:
    """(lang, gram, n) over the trusted documents of each chunk."""
    mine = (chunks.select("chunk", F.explode("doc_ids").alias("doc_id")).join(trusted, "doc_id")
            .groupBy(F.col("chunk").alias("of")).agg(F.collect_set("doc_id").alias("ids")))
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        r, ids = left.to_pylist()[0], set(right.column("ids")[0].as_py())
        c = _Chunk(r)
        keys, n = c.distinct(np.array([d in ids for d in r["doc_ids"]], bool))
        grams = c.grams(keys)
        return pa.Table.from_arrays([pa.array([r["lang"]] * len(grams), pa.string()), pa.array(grams, pa.string()),
                                     pa.array(n, pa.int64())], schema=schema)
    return (chunks.groupBy("chunk").cogroup(mine.groupBy("of"))
            .applyInArrow(run, "lang string, gram string, n long"))


# the model: counts, continuation counts, discounts, probabilities

def count_tables(chunks: DataFrame, trusted: DataFrame) -> dict[int, DataFrame]:
    """Per order k a table (lang, gram, c): occurrences for the highest order,
    numbers of distinct left neighbours below."""
    c = {ORDER: _trusted_counts(chunks, trusted).groupBy("lang", "gram").agg(F.sum("n").alias("c")).checkpoint()}
    for k in range(ORDER - 1, 0, -1):
        c[k] = (c[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram"))
                .agg(F.count(F.lit(1)).alias("c")).checkpoint())
    return c


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts of one order.  Where
    the counts of counts don't give one, the discount is 0.5, 1 or 1.5."""
    n = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))

    def d(i):
        raw = i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))
        return F.when((raw > 0) & (raw < i), raw).otherwise(F.lit(i / 2)).alias(f"d{i}")
    return counts.groupBy("lang").agg(*n).select("lang", d(1), d(2), d(3))


def _discount(c: Column) -> Column:
    return F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def _contexts(counts: DataFrame, discount: DataFrame, k: int) -> DataFrame:
    """(lang, context, total, held): per context of order k its count and the
    mass that discounting takes from it."""
    return (counts.join(discount, "lang")
            .groupBy("lang", F.substring("gram", 1, k - 1).alias("context"))
            .agg(F.sum("c").cast("double").alias("total"), F.sum(_discount(F.col("c"))).alias("held")))


def log_probabilities(grams: DataFrame, counts: dict[int, DataFrame]) -> DataFrame:
    """(lang, gram, logp) for distinct (lang, gram): interpolated from the
    single characters (over a uniform share for unseen ones) up to ``ORDER``."""
    one = _by_language(counts[1].groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("v")))
    p = grams.join(one, "lang").withColumn("p", 1 / F.col("v")).drop("v")
    for k in range(1, ORDER + 1):
        tail = F.substring("gram", ORDER - k + 1, k)
        discount = _by_language(discounts(counts[k]))
        seen = counts[k].join(discount, "lang").select(
            "lang", F.col("gram").alias("tail"), (F.col("c") - _discount(F.col("c"))).alias("kept"))
        p = (p.withColumn("tail", tail).withColumn("context", F.substring("gram", ORDER - k + 1, k - 1))
             .join(seen, ["lang", "tail"], "left").join(_contexts(counts[k], discount, k), ["lang", "context"], "left")
             .withColumn("p", F.when(F.col("total").isNull(), F.col("p")).otherwise(
                 (F.coalesce("kept", F.lit(0.0)) + F.col("held") * F.col("p")) / F.col("total")))
             .select("lang", "gram", "p"))
    return p.select("lang", "gram", F.log("p").cast("float").alias("logp"))


def _document_scores(chunks: DataFrame, told: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("lang", pa.string()),
                        ("n_chars", pa.int64()), ("logp", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        r = left.to_pylist()[0]
        n = np.array(r["sizes"], np.int64)
        total = np.full(len(n), np.nan)
        if right.num_rows:
            c = _Chunk(r)
            total = c.sums(c.keys_of(right.column("gram").to_pylist()), right.column("logp").to_numpy())
        return pa.Table.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["tags"], pa.int64()),
                                     pa.array([r["lang"]] * len(n), pa.string()), pa.array(n),
                                     pa.array(total, pa.float64(), mask=np.isnan(total) | (n == 0))], schema=schema)
    return (chunks.groupBy("chunk").cogroup(told.groupBy("of"))
            .applyInArrow(run, "doc_id long, tag long, lang string, n_chars long, logp double"))


def scores(docs: DataFrame, trusted: DataFrame, text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, tag (hash of the text), lang, n_chars and perplexity of every
    row of ``docs``, under models trained on the rows with a trusted doc_id."""
    spark = docs.sparkSession
    name, folder = f"quality_chunks_{uuid.uuid4().hex}", scratch_path(spark, "quality_chunks")
    (pack(docs, text, chunk_chars).write.bucketBy(shuffle_partitions(spark), "chunk").option("path", folder)
     .saveAsTable(name))
    chunks = spark.table(name)
    counts = count_tables(chunks, trusted)
    offered = scratch_path(spark, "quality_grams")
    _chunk_grams(chunks).write.parquet(offered)
    own = spark.read.parquet(offered)
    logp = log_probabilities(own.select("lang", "gram").distinct(), counts)
    told = own.join(logp, ["lang", "gram"]).select(F.col("chunk").alias("of"), "gram", "logp")
    found = scratch_path(spark, "quality_scores")
    _document_scores(chunks, told).write.parquet(found)
    spark.sql(f"DROP TABLE {name}")          # the catalog's entry; the table is external
    return spark.read.parquet(found).select("doc_id", "tag", "lang", "n_chars",
                                            F.exp(-F.col("logp") / F.col("n_chars")).alias("perplexity"))


def thresholds(scored: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang, limit): the perplexity that this share of a language's held-out
    documents does not exceed, from counts per bin of the logarithm, and a
    margin."""
    bins = (scored.where("perplexity is not null").join(trusted, "doc_id")
            .groupBy("lang", F.floor(F.log("perplexity") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    return (bins.select("lang", "bin", upto.alias("upto"), total.alias("total"))
            .where(F.col("upto") >= quantile * F.col("total"))
            .groupBy("lang").agg(F.exp((F.min("bin") + 1) * BIN + margin).alias("limit")))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", quantile: float = QUANTILE,
             chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Scores with the language's ``limit`` and ``kept``."""
    trusted = trusted_ids(labels)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HOLD_OUT)) == 0
    scored = scores(docs, trusted.where(~held), text, chunk_chars)
    limits = _by_language(thresholds(scored, trusted.where(held), quantile))
    return scored.join(limits, "lang", "left").select(
        "doc_id", "tag", "lang", "n_chars", "perplexity", "limit",
        ((F.col("n_chars") > 0) & F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    bad = classify(docs, labels, text).where("not kept").select("doc_id", "tag").distinct()
    tag = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    d, b = docs.withColumn("_tag", tag).alias("d"), bad.alias("b")
    on = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d._tag") == F.col("b.tag"))
    return d.join(b, on, "left_anti").select(*[F.col(f"d.{c}") for c in docs.columns])
