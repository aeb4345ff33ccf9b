"""Explanation text/factors against the reference's Python rendering, and
the exact ranking operators against brute force on small fixtures."""

import itertools
import math
import random

from pyspark.sql import functions as F

from creditlake.operators.ranking import exact_auc, ordered_index, split_hash, stratified_split
from creditlake.plans import explain as X


BASE = "Вероятность дефолта составляет {}%. Основные факторы решения модели выделены ниже."

# probability, importances, features -> percentage, factors in order, details, confidence
GOLDEN = [
    # equal sizes keep the order of the input
    (0.1234, [("income", -0.1), ("x1", 0.1), ("debt_to_income", 0.25)], {"income": 50000.0}, "12.34",
     [("debt_to_income", 0.0, 0.25), ("income", 50000.0, -0.1), ("x1", 0.0, 0.1)],
     "debt_to_income: вклад +0.250; income: вклад -0.100; x1: вклад +0.100", 0.925),
    # the five largest of seven; confidence is capped
    (0.5, [("a", 0.01), ("b", -0.3), ("c", 0.2), ("d", 0.02), ("e", -0.15), ("f", 0.4), ("g", -0.05)], {"f": 1.5, "a": 9.0}, "50.00",
     [("f", 1.5, 0.4), ("b", 0.0, -0.3), ("c", 0.0, 0.2), ("e", 0.0, -0.15), ("g", 0.0, -0.05)],
     "f: вклад +0.400; b: вклад -0.300; c: вклад +0.200; e: вклад -0.150; g: вклад -0.050", 0.95),
    (0.99, [("age", -0.0351)], {"age": 35.0}, "99.00", [("age", 35.0, -0.0351)], "age: вклад -0.035", 0.7175),
]


def test_explain_golden_rows(spark):
    rows = [(i, p, imps, feats) for i, (p, imps, feats, *_) in enumerate(GOLDEN)]
    df = spark.createDataFrame(
        rows, "application_id int, default_probability double, "
              "importances array<struct<feature:string,importance:double>>, features map<string,double>")
    df = df.withColumn("model_version", F.lit("t"))
    advice = {r[0]: r[2] for r in X.RULES}
    middle = {"brief": None, "detailed": X.TEXT_DETAILED, "policy": X.TEXT_POLICY}
    for mode in X.MODES:
        got = {r.application_id: r for r in X.explain(df, mode).collect()}
        for i, (_, _, _, pct, factors, details, conf) in enumerate(GOLDEN):
            text = BASE.format(pct) + (middle[mode] + details if middle[mode] else "")
            assert got[i].explanation_text == text
            assert [(k.feature, k.value, k.impact) for k in got[i].key_factors] == factors
            assert [k.advice for k in got[i].key_factors] == [advice.get(f, X.DEFAULT_ADVICE) for f, _, _ in factors]
            assert got[i].confidence == conf


def test_exact_auc_vs_pairs(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randint(0, 1), float(rnd.randint(0, 20))) for i in range(300)]   # many ties
    got = exact_auc(spark.createDataFrame(rows, "id int, y int, s double"), "y", "s", partitions=7).first()
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    num = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    assert math.isclose(got.auc, num / (len(pos) * len(neg)), rel_tol=1e-12)


def test_exact_auc_many_distinct_scores(spark):
    """More distinct scores than a range partitioner samples."""
    n = 300_000
    df = spark.range(n, numPartitions=6).select(
        F.pmod(F.xxhash64("id"), F.lit(2)).alias("y"), (F.xxhash64("id", F.lit(1)) / 2.0 ** 40).alias("s"))
    df = df.unionByName(df.limit(1000).select("y", F.lit(0.0).alias("s")))
    got = exact_auc(df, "y", "s").first()
    x = df.toPandas().sort_values("s")
    rank = x.s.rank().to_numpy()
    y = x.y.to_numpy() == 1
    want = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert (got.n_pos, got.n_neg) == (y.sum(), (~y).sum()) and math.isclose(got.auc, want, rel_tol=1e-9)


def test_ordered_index_many_values(spark):
    df = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("v"), F.col("id").alias("other"))
    got = ordered_index(df, "v", "i").orderBy("v").select("i").toPandas().i.to_numpy()
    assert (got == range(200_000)).all()


def test_stratified_split_exact_counts(spark):
    rows = [(i, 1 if i % 5 == 0 else 0) for i in range(1, 2001)]
    out = stratified_split(spark.createDataFrame(rows, "k long, y int"), "y", "k", 0.1, 17)
    counts = {(r.y, r.is_validation): r["count"] for r in out.groupBy("y", "is_validation").count().collect()}
    assert counts[(1, True)] == math.ceil(0.1 * 400) and counts[(0, True)] == math.ceil(0.1 * 1600)
    again = stratified_split(spark.createDataFrame(rows[::-1], "k long, y int"), "y", "k", 0.1, 17)
    a = {r.k for r in out.where("is_validation").collect()}
    b = {r.k for r in again.where("is_validation").collect()}
    assert a == b
    # the smallest hashes of each class, as a plain sort finds them
    keyed = spark.createDataFrame(rows, "k long, y int").select("k", "y", split_hash(F.col("k"), 17).alias("h")).collect()
    for y, n in ((1, 40), (0, 160)):
        assert {r.k for r in sorted((r for r in keyed if r.y == y), key=lambda r: r.h)[:n]} == {k for k in a if (k % 5 == 0) == (y == 1)}
