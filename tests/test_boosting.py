"""Boosted trees against a plain-Python trainer and a plain walk over the trees."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlake.operators import boosting as B
from creditlake.plans import boost as P
from creditlake.plans import explain as X
from creditlake.plans.file_features import file_features_from
from tests.conftest import SF001

SETTINGS = B.Settings(rounds=4, depth=3, bins=16, l2=3.0, wait=3)


def plain_train(rows, n, s):
    """Trees from rows (bins, label, held, hash): dictionaries and loops."""
    trees, aucs = [], []
    score = [0.0] * len(rows)
    for number in range(s.rounds + 1):
        if number:
            held = [(score[i], r[1]) for i, r in enumerate(rows) if r[2]]
            binned = [(min(int(1 / (1 + math.exp(-x)) * B.SCORE_BINS), B.SCORE_BINS - 1), y) for x, y in held]
            pos, neg = [b for b, y in binned if y], [b for b, y in binned if not y]
            aucs.append(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)))
            best = max(range(number), key=lambda k: (aucs[k], -k)) + 1
            if number == s.rounds or number - best >= s.wait:
                return trees[:best], aucs
        mine = [i for i, r in enumerate(rows) if not r[2] and B.sampled(np.array([r[3]], np.int64), s.seed, number, s.subsample)[0]]
        g, h = {}, {}
        for i in mine:
            p, w = 1 / (1 + math.exp(-score[i])), s.positive_weight if rows[i][1] else 1.0
            g[i], h[i] = round(w * (rows[i][1] - p) * B.UNIT), round(w * p * (1 - p) * B.UNIT)
        splits, leaf = [], dict.fromkeys(mine, 0)
        for _ in range(s.depth):
            options = []
            for f in range(n):
                for b in range(s.bins - 1):
                    sides = {}
                    for i in mine:
                        side = sides.setdefault((leaf[i], rows[i][0][f] > b), [0, 0])
                        side[0] += g[i]
                        side[1] += h[i]
                    whole = {}
                    for (k, _), (a, c) in sides.items():
                        whole.setdefault(k, [0, 0])
                        whole[k][0] += a
                        whole[k][1] += c
                    val = lambda d: sum((a / B.UNIT) ** 2 / (c / B.UNIT + s.l2) for a, c in d.values())
                    options.append((val(sides) - val(whole), f, b))
            top = max(o[0] for o in options)
            if top <= 1e-9:
                break
            _, f, b = min((o for o in options if o[0] >= top - 1e-9), key=lambda o: o[1:])
            splits.append((f, b))
            leaf = {i: 2 * k + (rows[i][0][f] > b) for i, k in leaf.items()}
        steps = []
        for k in range(1 << len(splits)):
            inside = [i for i in mine if leaf[i] == k]
            steps.append(sum(g[i] for i in inside) / B.UNIT / (sum(h[i] for i in inside) / B.UNIT + s.l2) * s.rate)
        trees.append((splits, steps))
        for i, r in enumerate(rows):
            k = 0
            for f, b in splits:
                k = 2 * k + (r[0][f] > b)
            score[i] += steps[k]


def noisy(spark):
    """The whole test table with a label that no feature gives away."""
    c = spark.read.parquet(f"{SF001}/customer.parquet")
    f = {"a": F.col("c_acctbal"), "b": F.pmod("c_custkey", F.lit(17)).cast("double"), "c": F.when(F.pmod("c_custkey", F.lit(5)) > 0, F.col("c_nationkey")),
         "d": F.lit(1.0)}
    y = (F.col("c_acctbal") + F.pmod(F.xxhash64("c_custkey"), F.lit(9000)) > 9000).cast("int")
    df = c.select("c_custkey", *[v.alias(k) for k, v in f.items()], y.alias("y"))
    return df.withColumn("v", F.pmod("c_custkey", F.lit(4)) == 0), list(f)


def test_trees_equal_a_plain_trainer(spark, monkeypatch):
    df, features = noisy(spark)
    monkeypatch.setattr(B, "KEEP", 2)                      # scores are written anew in between
    forest = B.train(df.repartition(5), features, "y", "c_custkey", "v", SETTINGS)
    rows = B.binned_rows(df, features, forest.edges, F.col("y"), F.col("v"), B.row_hash(F.col("c_custkey")).alias("h")).collect()
    trees, aucs = plain_train([(list(r.bins), r.y, r.v, r.h) for r in rows], len(features), SETTINGS)
    assert len(forest.trees) == len(trees) > 0
    for t, (splits, steps) in zip(forest.trees, trees):
        assert t.splits == splits and np.allclose(t.leaves, steps, atol=1e-6)
    assert np.allclose(forest.auc, aucs, atol=1e-9)
    again = B.train(df.repartition(2), features, "y", "c_custkey", "v", SETTINGS)
    assert [(t.splits, t.leaves, t.cover) for t in again.trees] == [(t.splits, t.leaves, t.cover) for t in forest.trees]


def test_attribution_is_a_walk_of_the_trees(spark):
    """Each row's score and parts from the stored node table, node by node."""
    df, features = noisy(spark)
    forest = B.train(df, features, "y", "c_custkey", "v", SETTINGS)
    stored = B.forest_of(forest.rows(), features)
    got = {r.c_custkey: r for r in B.score(df, stored, F.col("c_custkey"), importances=True).collect()}
    for row in df.collect():
        raw, parts = 0.0, dict.fromkeys(features, 0.0)
        for tree in forest.trees:
            n = len(tree.splits)

            def mean(prefix):
                under = [k for k in range(1 << n) if not prefix or format(k, f"0{n}b").startswith(prefix)]
                cover = sum(tree.cover[k] for k in under)
                if cover == 0:
                    return sum(tree.leaves[k] for k in under) / len(under)
                return sum(tree.leaves[k] * tree.cover[k] for k in under) / cover
            prefix, before = "", mean("")
            for f, b in tree.splits:
                x = row[features[f]]
                prefix += str(int(x is not None and x > forest.edges[f][b]))
                now = mean(prefix)
                parts[features[f]] += now - before
                before = now
            raw += tree.leaves[int(prefix or "0", 2)]
        r = got[row.c_custkey]
        assert abs(r.raw - raw) < 1e-9 and abs(r.probability - 1 / (1 + math.exp(-raw))) < 1e-9
        assert [i.feature for i in r.importances] == features
        assert all(abs(i.importance - parts[i.feature]) < 1e-9 for i in r.importances)
    shares = B.global_importances(forest)
    assert [f for f, _ in shares] == features and abs(sum(v for _, v in shares) - 1) < 1e-9 and shares[3][1] == 0


def test_no_class_no_feature_no_rows(spark):
    df, features = noisy(spark)
    assert B.train(df, ["d"], "y", "c_custkey", "v", SETTINGS).trees == []
    assert B.train(df.limit(0), features, "y", "c_custkey", "v", SETTINGS).trees == []
    whole = B.train(df.withColumn("v", F.lit(False)), features, "y", "c_custkey", "v", SETTINGS)
    assert len(whole.trees) == SETTINGS.rounds and whole.auc == [None] * SETTINGS.rounds


@pytest.fixture(scope="module")
def files(spark):
    train, test = file_features_from(spark, SF001)
    return train.cache(), test.cache()


def test_model_registry_and_scores(spark, files, tmp_path):
    train, test = files
    root = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        P.load_model(spark, root)
    first = P.fit(train, settings=B.Settings(rounds=2))
    assert P.register_model(spark, root, first) == 1 and P.load_model(spark, root).name == "boost-v1"
    assert P.register_model(spark, root, P.fit(train, settings=B.Settings(rounds=3)), {"note": 1.0}) == 2
    model = P.load_model(spark, root)
    assert model.version == 2 and P.load_model(spark, root) is model and P.load_model(spark, root, 1).version == 1
    rows = {(r.version, r.name): (r.value, r.is_current) for r in P.registry(spark, root).collect()}
    assert rows[2, "note"] == (1.0, True) and rows[1, "features"] == (float(len(model.forest.features)), False)
    # a version whose pointer was never written does not count
    spark.range(1).write.parquet(f"{root}/version=3/metrics")
    assert P.current_version(spark, root) == 2
    # what was stored scores as what was trained
    want = P.score(first, test).drop("model_version").collect()
    got = P.score(P.load_model(spark, root, 1), test).drop("model_version").collect()
    assert sorted(want) == sorted(got) and all(r.predicted_default == (r.default_probability >= 0.5) for r in want)
    P.check_order(model, model.forest.features)
    with pytest.raises(ValueError, match="from position 0"):
        P.check_order(model, model.forest.features[::-1])
    with pytest.raises(ValueError, match="lacks model features"):
        P.score(model, test.drop(model.forest.features[0]))
    # factors: shares of the score, signed, of absolute sum 1, then ranked and told
    scored = P.score(model, test, importances=True).collect()
    for r in scored:
        total = sum(abs(i.importance) for i in r.importances)
        assert total == 0 or abs(total - 1) < 0.01
    told = {r.application_id: r for r in P.explain(model, test).collect()}
    assert len(told) == len(scored)
    for r in scored:
        e = told[r.sk_id_curr]
        best = sorted(r.importances, key=lambda i: -abs(i.importance))[:X.TOP_K]
        assert [f.feature for f in e.key_factors] == [i.feature for i in best]
        assert all(f"{f.feature}: вклад {f.impact:+.3f}" in e.explanation_text for f in e.key_factors)
        assert [f.value for f in e.key_factors] == [r.features[f.feature] for f in e.key_factors]
    # rows without a model row take the rule
    requests = test.select("sk_id_curr").unionByName(spark.range(10**9, 10**9 + 5).withColumnRenamed("id", "sk_id_curr"))
    versions = [r.model_version for r in P.with_fallback(model, test, requests, "sk_id_curr").collect()]
    assert versions.count("boost-v2") == len(scored) and versions.count("heuristic-v1") == 5
    assert {r.model_version for r in P.with_fallback(None, test, requests, "sk_id_curr").collect()} == {"heuristic-v1"}


def test_auc_rounds_are_those_of_a_whole_fit(spark, files, monkeypatch):
    """The query trains with the reference's 1000 rounds and waits 45 of them."""
    from creditlake.catalog import boost as Q
    seen = []

    def train(df, features, label, key, validation, settings):
        seen.append(settings)
        return B.Forest(features, [[]] * len(features), [B.Tree([], [0.0], [1])], [0.75, 0.5])
    monkeypatch.setattr(Q, "file_features_from", lambda *_: files)
    monkeypatch.setattr(B, "train", train)
    got = sorted(tuple(r) for r in Q.boost_auc_rounds(spark, SF001).collect())
    assert seen == [B.Settings()] and (seen[0].rounds, seen[0].wait) == (1000, 45)
    assert got == [(1, 0.75, True), (2, 0.5, False)]
