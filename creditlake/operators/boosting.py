"""Boosted trees on histograms (M-02), trained by one aggregate per tree level.

Numbers are put into at most ``BINS`` quantile bins once.  A tree is symmetric:
all nodes of a level share one split, so a tree is a list of (feature, bin) and
2^depth leaves.  For each level the tasks add up gradients and Hessians by
(feature, leaf, bin) from all rows they hold, one packed row per feature and
task travels, the sums are added up over the tasks, each feature names its best
split, and one row per feature reaches the driver.  Leaves are Newton steps with an L2 term.  Training stops some rounds
after the best AUC of the validation rows and keeps the trees up to it.

What travels is bounded by features x leaves x bins, at any number of rows.
Sums are integers (gradients in units of 2^-24), so trees do not depend on the
order of rows or tasks.  Rows are read from a table in the shared folder; their
scores are written anew every ``KEEP`` trees, and the trees since then are
applied on the way, so a lost executor repeats one scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: bins of a feature; bins of the score that the validation AUC is taken from
BINS, SCORE_BINS = 64, 1 << 16
#: trees between two writings of the scores
KEEP = 10
UNIT = 1 << 24
_ALL = 0xFFFFFFFFFFFFFFFF


@dataclass(frozen=True)
class Settings:
    """The reference model's training parameters."""
    rounds: int = 1000
    rate: float = 0.1
    depth: int = 7
    l2: float = 40.0
    subsample: float = 0.7
    positive_weight: float = 5.0
    wait: int = 45
    seed: int = 17
    bins: int = BINS


@dataclass
class Tree:
    """``splits``: (feature number, bin): a row goes right if its bin is above.
    ``leaves``: step of each leaf (already times the rate); ``cover``: rows."""
    splits: list[tuple[int, int]]
    leaves: list[float]
    cover: list[int]


@dataclass
class Forest:
    features: list[str]
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    #: validation AUC after each round, also of rounds that were not kept
    auc: list[float | None] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        """(tree, node, feature, threshold, value, cover): inner nodes first,
        numbered by level, then leaves; a leaf has no feature."""
        out = []
        for t, tree in enumerate(self.trees):
            for level, (f, b) in enumerate(tree.splits):
                out.append((t, level, self.features[f], float(self.edges[f][b]), None, None))
            for k, (v, n) in enumerate(zip(tree.leaves, tree.cover)):
                out.append((t, len(tree.splits) + k, None, None, float(v), int(n)))
        return out


ROWS = "tree int, node int, feature string, threshold double, value double, cover long"


def forest_of(rows: list[tuple], features: list[str]) -> Forest:
    """The forest of ``Forest.rows``; edges are the thresholds that it uses."""
    place = {f: i for i, f in enumerate(features)}
    edges = [sorted({r[3] for r in rows if r[2] == f}) for f in features]
    forest = Forest(list(features), edges)
    for t in range(max((r[0] for r in rows), default=-1) + 1):
        mine = sorted(r for r in rows if r[0] == t)
        splits = [(place[r[2]], edges[place[r[2]]].index(r[3])) for r in mine if r[2] is not None]
        ends = [r for r in mine if r[2] is None]
        forest.trees.append(Tree(splits, [r[4] for r in ends], [r[5] for r in ends]))
    return forest


def quantile_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """At most ``bins`` - 1 distinct quantiles per feature, in one aggregate."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted({float(v) for v in (row[f"q{i}"] or []) if v is not None}) for i in range(len(features))]


def row_hash(key: Column) -> Column:
    """What a row is sampled by."""
    return F.xxhash64(key.cast("string"))


def sampled(hashes: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Bernoulli rows of a tree: the same rows in every run (splitmix64)."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & _ALL)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) < share * (1 << 53)


def leaf_of(binned: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    """Leaf of each row (rows x features of bins) under some splits."""
    at = np.zeros(len(binned), np.int64)
    for f, b in splits:
        at = at * 2 + (binned[:, f] > b)
    return at


def add_trees(score: np.ndarray, binned: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for t in trees:
        score = score + np.asarray(t.leaves)[leaf_of(binned, t.splits)]
    return score


def gradients(score: np.ndarray, label: np.ndarray, positive_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Integer gradients (of the likelihood) and Hessians of the logistic loss."""
    p = 1 / (1 + np.exp(-score))
    w = np.where(label > 0, positive_weight, 1.0)
    return np.rint(w * (label - p) * UNIT).astype(np.int64), np.rint(w * p * (1 - p) * UNIT).astype(np.int64)


def add_histogram(sums: np.ndarray, binned: np.ndarray, leaf: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> None:
    """Add a batch's rows to ``sums`` (g, h and n by feature and leaf * bins + bin)."""
    slots = leaf[None, :] * bins + binned.T
    for f, slot in enumerate(slots):
        # a batch's sums stay below 2^53, so they are exact as doubles
        for k, weights in enumerate((g, h, None)):
            sums[k, f] += np.bincount(slot, weights, sums.shape[2]).astype(np.int64)


def packed(sums: np.ndarray) -> bytes:
    """The slots of (g, h, n) sums that have rows, with their sums."""
    used = np.flatnonzero(sums[2])
    return np.concatenate([used[None], sums[:, used]]).astype("<i8").tobytes()


def added_up(blocks: list[bytes]) -> tuple[np.ndarray, ...]:
    """(slot, g, h, n) over all packed sums, by ascending slot."""
    cols = np.concatenate([np.frombuffer(b, "<i8").reshape(4, -1) for b in blocks], axis=1)
    slots, at = np.unique(cols[0], return_inverse=True)
    out = np.zeros((3, len(slots)), np.int64)
    for row, col in zip(out, cols[1:]):
        np.add.at(row, at, col)
    return slots, *out


def gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return (g / UNIT) ** 2 / (h / UNIT + l2)


def best_split(slot: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, bins: int, l2: float):
    """(gain over no split, bin, g, h, n of the two sides of each leaf) of one
    feature's sums; the lowest bin of equal gains, None if none gains."""
    full = np.zeros((3, leaves * bins), np.int64)
    for row, v in zip(full, (g, h, n)):
        row[slot] = v
    full = full.reshape(3, leaves, bins)
    left = np.cumsum(full, axis=2)[:, :, :-1]
    whole = full.sum(axis=2, keepdims=True)
    right = whole - left
    both = (gain(left[0], left[1], l2) + gain(right[0], right[1], l2)).sum(axis=0)
    best = int(np.argmax(both)) if both.size else 0
    over = float(both[best] - gain(whole[0, :, 0], whole[1, :, 0], l2).sum()) if both.size else 0.0
    if over <= 1e-9:
        return None
    sides = np.stack([left[:, :, best], right[:, :, best]], axis=2).reshape(3, 2 * leaves)
    return over, best, *[s.tolist() for s in sides]


def auc_of(slot: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float | None:
    """AUC of counts per score bin, ties (of a bin) by halves."""
    order = np.argsort(slot)
    pos, neg = pos[order].astype(float), neg[order].astype(float)
    below = np.cumsum(neg) - neg
    total = pos.sum() * neg.sum()
    return float((pos * (below + neg / 2)).sum() / total) if total else None


def score_bin(score: np.ndarray) -> np.ndarray:
    return np.minimum((1 / (1 + np.exp(-score)) * SCORE_BINS).astype(np.int64), SCORE_BINS - 1)


def binned_rows(df: DataFrame, features: list[str], edges: list[list[float]], *keep: Column) -> DataFrame:
    """``keep`` columns and ``bins``, one byte per feature: how many of the
    feature's edges are below the value; null and NaN are below all."""
    kept = df.select(*keep, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    n = len(kept.columns) - len(features)
    schema = kept.select(*kept.columns[:n], F.lit(b"").alias("bins")).schema
    cuts = [np.array(e) for e in edges]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns[:n] + [pa.array([r.tobytes() for r in _bins(b.columns[n:], cuts)], pa.binary())],
                                             names=schema.names)
    return kept.mapInArrow(run, schema)


def _bins(columns: list[pa.Array], cuts: list[np.ndarray]) -> np.ndarray:
    rows = len(columns[0]) if columns else 0
    out = np.zeros((rows, len(columns)), np.uint8)
    for k, (c, cut) in enumerate(zip(columns, cuts)):
        x = c.to_numpy(zero_copy_only=False).astype(np.float64)
        out[:, k] = np.where(np.isnan(x), 0, np.searchsorted(cut, x, side="left"))
    return out


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    """The bytes of a column of ``features`` bytes in each row."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros((len(column), features), np.uint8)
    first = int(np.frombuffer(places, width, 1, column.offset * np.dtype(width).itemsize)[0])
    return np.frombuffer(data, np.uint8, len(column) * features, first).reshape(len(column), features)


def _level(rows: DataFrame, n_features: int, trees: list[Tree], splits: list[tuple[int, int]], number: int, s: Settings,
           with_auc: bool) -> list:
    """Best split of each feature for the level after ``splits`` in tree
    ``number``; as feature -1 the AUC of the validation rows, if asked for.
    ``trees`` are those not in the rows' scores yet."""
    bins, leaves = s.bins, 1 << len(splits)

    def sums(batches):
        full = np.zeros((3, n_features, leaves * bins), np.int64)
        aucs = np.zeros((3, SCORE_BINS), np.int64)
        for b in batches:
            binned = _matrix(b.column("bins"), n_features)
            label = b.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            held = b.column("is_validation").to_numpy(zero_copy_only=False).astype(bool)
            score = add_trees(b.column("score").to_numpy(), binned, trees)
            mine = ~held & sampled(b.column("hash").to_numpy(), s.seed, number, s.subsample)
            g, h = gradients(score[mine], label[mine], s.positive_weight)
            add_histogram(full, binned[mine], leaf_of(binned[mine], splits), g, h, bins)
            if with_auc:
                at = score_bin(score[held])
                good, all_ = (np.bincount(at, w, SCORE_BINS).astype(np.int64) for w in (label[held] > 0, None))
                aucs += np.stack([good, all_ - good, all_])
        parts = [(f, packed(full[:, f])) for f in range(n_features) if full[2, f].any()]
        if aucs.any():
            parts.append((-1, packed(aucs)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())],
                                             names=["feature", "sums"])

    def choose(table: pa.Table) -> pa.Table:
        f = table.column("feature")[0].as_py()
        slot, g, h, n = added_up(table.column("sums").to_pylist())
        if f < 0:
            row = (f, auc_of(slot, g, h), None, [], [], [])
        else:
            row = (f, *(best_split(slot, g, h, n, leaves, bins, s.l2) or (None, None, [], [], [])))
        kinds = [pa.int32(), pa.float64(), pa.int32()] + [pa.list_(pa.int64())] * 3
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["feature", "gain", "bin", "g", "h", "n"])

    found = (rows.mapInArrow(sums, "feature int, sums binary").groupBy("feature")
             .applyInArrow(choose, "feature int, gain double, bin int, g array<long>, h array<long>, n array<long>"))
    return found.collect()


def _rescored(rows: DataFrame, n_features: int, trees: list[Tree]) -> DataFrame:
    """The rows with the trees added to their scores, written and read again."""
    def run(batches):
        for b in batches:
            score = add_trees(b.column("score").to_numpy(), _matrix(b.column("bins"), n_features), trees)
            yield b.set_column(b.schema.get_field_index("score"), "score", pa.array(score))
    path = scratch_path(rows.sparkSession, "boost_rows")
    rows.mapInArrow(run, rows.schema).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def train(df: DataFrame, features: list[str], label: str, key: str, validation: str, settings: Settings = Settings()) -> Forest:
    """A forest over numeric ``features`` of the rows with a label; rows flagged
    in ``validation`` only measure the AUC.  Without validation rows of both
    classes all rounds are trained."""
    s = settings
    known = df.where(F.col(label).isNotNull())
    forest = Forest(list(features), quantile_edges(known.where(~F.col(validation)), features, s.bins))
    path = scratch_path(df.sparkSession, "boost_rows")
    binned_rows(known, features, forest.edges, row_hash(F.col(key)).alias("hash"), F.col(label).cast("double").alias("label"),
                F.col(validation).alias("is_validation"), F.lit(0.0).alias("score")).write.parquet(path)
    rows, fresh, best, best_round = df.sparkSession.read.parquet(path), [], -math.inf, 0
    while True:
        number, splits, chosen, tree = len(forest.trees), [], None, None
        for level in range(s.depth):
            found = _level(rows, len(features), fresh, splits, number, s, with_auc=level == 0)
            if level == 0:
                auc = next((r["gain"] for r in found if r["feature"] < 0), None)
                if number:
                    forest.auc.append(auc)
                    if auc is not None and auc > best:
                        best, best_round = auc, number
                if number == s.rounds or number and auc is not None and number - best_round >= s.wait:
                    break
            options = [r for r in found if r["feature"] >= 0 and r["gain"] is not None]
            if not options:
                break
            chosen = min(options, key=lambda r: (-r["gain"], r["feature"]))
            splits = [*splits, (chosen["feature"], chosen["bin"])]
            step = np.array(chosen["g"]) / UNIT / (np.array(chosen["h"]) / UNIT + s.l2) * s.rate
            tree = Tree(splits, step.tolist(), list(chosen["n"]))
        if tree is None:
            break
        forest.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == KEEP:
            rows, fresh = _rescored(rows, len(features), fresh), []
    if best_round:
        del forest.trees[best_round:]
    return forest


# scores and attributions

def _node_values(tree: Tree) -> list[np.ndarray]:
    """Per level the mean step of the rows under each node (of an empty node:
    that of the node above), the leaves last."""
    values, cover = [np.asarray(tree.leaves, float)], np.asarray(tree.cover, float)
    weights = [cover]
    for _ in tree.splits:
        v, c = values[0], weights[0]
        both = c.reshape(-1, 2).sum(axis=1)
        sums = (v * c).reshape(-1, 2).sum(axis=1)
        values.insert(0, np.divide(sums, both, out=v.reshape(-1, 2).mean(axis=1), where=both > 0))
        weights.insert(0, both)
    return values


def attributions(binned: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(score, contribution of each feature) of rows: what a row's step from
    node to node changes is the split feature's; with the trees' mean steps the
    contributions add up to the score."""
    score, parts = np.zeros(len(binned)), np.zeros((len(binned), len(forest.features)))
    for tree in forest.trees:
        values, at = _node_values(tree), np.zeros(len(binned), np.int64)
        for level, (f, b) in enumerate(tree.splits):
            below = at * 2 + (binned[:, f] > b)
            parts[:, f] += values[level + 1][below] - values[level][at]
            at = below
        score += values[-1][at]
    return score, parts


def shares(parts: np.ndarray, digits: int) -> np.ndarray:
    """Each row's parts over the sum of their absolute values (added up from
    left to right), rounded as Python rounds; unchanged where the sum is 0."""
    total = np.zeros(len(parts))
    for k in range(parts.shape[1]):
        total += np.abs(parts[:, k])
    row, col = np.nonzero((parts != 0) & (total > 0)[:, None])
    out = parts.copy()
    out[row, col] = [round(v, digits) for v in (parts[row, col] / total[row]).tolist()]
    return out


def score(df: DataFrame, forest: Forest, *keep: Column, importances: bool = False, digits: int | None = None) -> DataFrame:
    """``keep`` columns, ``raw`` (log odds), ``probability`` and, if asked for,
    ``importances``: (feature, importance) of all features in their order, with
    ``digits`` as shares of the row's whole, and ``features``, their values.
    (The map is made here: as an expression over all columns that are also read
    as features it would have the optimizer infer every mix of both.)"""
    kept = df.select(*keep, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(forest.features)])
    n = len(kept.columns) - len(forest.features)
    more = ["cast(null as array<struct<feature:string,importance:double>>) importances",
            "cast(null as map<string,double>) features"] if importances else []
    schema = kept.selectExpr(*[f"`{c}`" for c in kept.columns[:n]], "0.0D raw", "0.0D probability", *more).schema
    cuts, names = [np.array(e) for e in forest.edges], forest.features

    def run(batches):
        for b in batches:
            binned = _bins(b.columns[n:], cuts)
            if importances:
                raw, parts = attributions(binned, forest)
                parts = parts if digits is None else shares(parts, digits)
            else:
                raw = add_trees(np.zeros(len(binned)), binned, forest.trees)
            cols = b.columns[:n] + [pa.array(raw), pa.array(1 / (1 + np.exp(-raw)))]
            if importances:
                flat = pa.StructArray.from_arrays([pa.array(names * len(binned), pa.string()), pa.array(parts.ravel())],
                                                  names=["feature", "importance"])
                offsets = pa.array(np.arange(len(binned) + 1) * len(names), pa.int32())
                values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns[n:]], 1).ravel()
                cols += [pa.ListArray.from_arrays(offsets, flat),
                         pa.MapArray.from_arrays(offsets, pa.array(names * len(binned), pa.string()), pa.array(values, from_pandas=True))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)
    return kept.mapInArrow(run, schema)


def global_importances(forest: Forest) -> list[tuple[str, float]]:
    """(feature, share): how much splits on it change the steps of the rows of
    the training sample, on average; all shares add up to 1."""
    total = dict.fromkeys(forest.features, 0.0)
    for tree in forest.trees:
        values, cover = _node_values(tree), np.asarray(tree.cover, float)
        for level, (f, _) in enumerate(tree.splits):
            weight = cover.reshape(len(values[level + 1]), -1).sum(axis=1)
            change = np.abs(values[level + 1] - np.repeat(values[level], 2))
            total[forest.features[f]] += float((weight * change).sum())
    whole = sum(total.values())
    return [(f, v / whole if whole else 0.0) for f, v in total.items()]
