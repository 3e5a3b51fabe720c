"""Softmax boosting: one tree per class and round, fitted to shared residuals.

Each round takes the class probabilities of the trees so far and fits a small
tree per class to what is left (1 or 0 less the probability); a leaf's value is
one Newton step on the log loss.  Trees grow level by level from sums over
(node, feature, bin) that every task makes of its own rows, so a level of all
trees is one pass.  Several models that leave out one fold each grow in the
same passes.  Rows with equal bins, label and fold get equal scores in every
round, so they are counted first and a pass reads each such group once.  Where
the groups are so few that a task can hold them, as with a few features of any
number of rows, there are no passes: one task per model grows all its rounds.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tribunal.session import freeze, ship_package

#: Rounds between two cuts of the lineage.
ROUNDS_PER_CUT = 10
#: Sums over (model, class, node, feature, bin) that one level may bring to the driver; their number does not grow with the rows.
CELLS_ON_DRIVER = 500_000
#: Groups of equal rows, times classes, times features, that one task holds to grow a model by itself.
CELLS_IN_TASK = 4_000_000
_SUMS = "m int, k int, node int, f int, b int, n double, r double, h double"


@dataclass
class Trees:
    """Complete trees of one depth, by round and class; a node that is not split sends all rows to the left."""

    feature: np.ndarray      # rounds x classes x inner nodes, -1: not split
    cut: np.ndarray          # bin that still goes left
    value: np.ndarray        # rounds x classes x leaves
    weight: np.ndarray       # rounds x classes x all nodes: rows that reach it in training
    gain: np.ndarray         # rounds x classes x inner nodes

    @classmethod
    def unsplit(cls, rounds: int, classes: int, depth: int) -> "Trees":
        shape = (rounds, classes)
        return cls(np.full((*shape, (1 << depth) - 1), -1), np.zeros((*shape, (1 << depth) - 1), dtype=np.int64),
                   np.zeros((*shape, 1 << depth)), np.zeros((*shape, (2 << depth) - 1)), np.zeros((*shape, (1 << depth) - 1)))

    @property
    def depth(self) -> int:
        return int(np.log2(self.value.shape[-1]))

    def split(self, row: dict, r: int, level: int, step: float) -> None:
        """Note the best split (k, node, f, b, gain and the sums on its left and in all) of a node of one level of a round."""
        K, nodes = self.value.shape[1], 1 << level
        at = (r, row["k"], row["node"] + nodes - 1)
        sides = [(row["nl"], row["rl"], row["hl"]), (row["n"] - row["nl"], row["r"] - row["rl"], row["h"] - row["hl"])]
        if row["gain"] > 0:
            self.feature[at], self.cut[at], self.gain[at] = row["f"], row["b"], row["gain"]
        else:
            sides = [(row["n"], row["r"], row["h"]), (0.0, 0.0, 0.0)]
        self.weight[at] = row["n"]
        for side, (n, rest, h) in enumerate(sides):
            self.weight[r, row["k"], 2 * (row["node"] + nodes - 1) + 1 + side] = n
            if level == self.depth - 1:
                newton = (K - 1) / K * rest / h if abs(h) > 1e-150 else 0.0
                self.value[r, row["k"], 2 * row["node"] + side] = step * newton


def descend(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Number inside its level of the node that each row reaches in one tree."""
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for level in range(levels):
        at = node + (1 << level) - 1
        f = feature[at]
        right = (f >= 0) & (x[rows, f] > cut[at])
        node = 2 * node + right
    return node


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def level_sums(
    bins: np.ndarray, label: np.ndarray, n: np.ndarray, raw: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int, n_bins: int,
) -> np.ndarray:
    """Rows, residuals and curvatures over (class, node, feature, bin) of one level of the trees of one round of a model."""
    K, nodes, d = raw.shape[1], 1 << level, bins.shape[1]
    total = np.zeros((3, K, nodes, d, n_bins))
    rest = (np.arange(K) == label[:, None]) - softmax(raw)
    for k in range(K):
        place = descend(bins, feature[k], cut[k], level) * n_bins
        weights = (n, n * rest[:, k], n * np.abs(rest[:, k]) * (1 - np.abs(rest[:, k])))
        for f in range(d):
            at = place + bins[:, f]
            for s, w in enumerate(weights):
                total[s, k, :, f] += np.bincount(at, weights=w, minlength=nodes * n_bins).reshape(nodes, n_bins)
    return total


def grow_alone(bins: np.ndarray, label: np.ndarray, n: np.ndarray, base: np.ndarray, like: "SoftmaxBoosting") -> Trees:
    """All rounds of one model from groups of equal rows."""
    trees = Trees.unsplit(like.rounds, like.n_classes, like.depth)
    raw = np.tile(base, (len(bins), 1))
    for r in range(like.rounds):
        for level in range(like.depth):
            sums = level_sums(bins, label, n, raw, trees.feature[r], trees.cut[r], level, like.bins)
            for row in best_of(sums[:, None]):
                trees.split(row, r, level, like.step)
        for k in range(like.n_classes):
            raw[:, k] += trees.value[r, k][descend(bins, trees.feature[r, k], trees.cut[r, k], like.depth)]
    return trees


@dataclass
class SoftmaxModel:
    """Boosted trees of one model: class scores are ``base`` plus the values of all leaves reached."""

    trees: Trees
    edges: list[list[float]]
    base: np.ndarray
    n_features: int
    columns: dict[str, str] = field(default_factory=lambda: {
        "predictionCol": "prediction", "probabilityCol": "probability", "rawPredictionCol": "rawPrediction"})

    @property
    def thresholds(self) -> np.ndarray:
        """Split values in place of bins."""
        out = np.zeros(self.trees.cut.shape)
        for f, edges in enumerate(self.edges):
            here = self.trees.feature == f
            out[here] = np.array(edges or [0.0])[self.trees.cut[here]]
        return out

    @property
    def featureImportances(self) -> np.ndarray:
        """Improvement of the splits of each feature, all together 1."""
        used = self.trees.feature >= 0
        sums = np.bincount(self.trees.feature[used], weights=self.trees.gain[used], minlength=self.n_features)
        return sums / (sums.sum() or 1.0)

    def getParam(self, title: str) -> str:
        return title

    def copy(self, columns: dict[str, str]) -> "SoftmaxModel":
        return SoftmaxModel(self.trees, self.edges, self.base, self.n_features, self.columns | columns)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Class scores of some rows."""
        t, cuts = self.trees, self.thresholds
        out = np.tile(self.base, (len(x), 1))
        for r in range(t.value.shape[0]):
            for k in range(t.value.shape[1]):
                out[:, k] += t.value[r, k][descend(x, t.feature[r, k], cuts[r, k], t.depth)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add raw scores, probabilities and the most likely class, the smallest on a tie."""
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.raw(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

        raw, shares, guess = (self.columns[c] for c in ("rawPredictionCol", "probabilityCol", "predictionCol"))
        scored = df.withColumn("_raw", scores(vector_to_array("features")))
        lifted = F.transform("_raw", lambda v: F.exp(v - F.array_max("_raw")))
        scored = scored.withColumn("_lifted", lifted).withColumn(
            "_shares", F.transform("_lifted", lambda v: v / F.aggregate("_lifted", F.lit(0.0), lambda a, b: a + b)))
        return scored.withColumns({
            raw: array_to_vector("_raw"), shares: array_to_vector("_shares"),
            guess: (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double")}).drop("_raw", "_lifted", "_shares")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """Nodes by tree, as the explanation reads them; each tree adds to the output of its class only."""
        t, cuts, rows = self.trees, self.thresholds, []
        inner = t.feature.shape[2]
        for r in range(t.value.shape[0]):
            for k in range(t.value.shape[1]):
                for node in range(2 * inner + 1):
                    is_leaf = node >= inner
                    split = not is_leaf and t.feature[r, k, node] >= 0
                    value = [0.0] * len(self.base)
                    if is_leaf:
                        value[k] = float(t.value[r, k, node - inner])
                    # An unsplit node hands everything to its left child.
                    rows.append((r * t.value.shape[1] + k, node, -1 if is_leaf else 2 * node + 1, -1 if is_leaf else 2 * node + 2,
                                 int(t.feature[r, k, node]) if split else 0, float(cuts[r, k, node]) if split else float("inf"),
                                 float(t.weight[r, k, node]), value))
        return spark.createDataFrame(
            rows, "tree int, id int, leftChild int, rightChild int, feature int, threshold double, weight double, value array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        t = self.trees
        facts = {"edges": self.edges, "base": self.base.tolist(), "n_features": self.n_features,
                 **{c: getattr(t, c).tolist() for c in ("feature", "cut", "value", "weight", "gain")}}
        spark.createDataFrame([(json.dumps(facts),)], "value string").write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SoftmaxModel":
        facts = json.loads(spark.read.text(path).first()["value"])
        whole = {c: np.array(facts[c], dtype=np.int64) for c in ("feature", "cut")}
        real = {c: np.array(facts[c], dtype=float) for c in ("value", "weight", "gain")}
        return cls(Trees(**whole, **real), facts["edges"], np.array(facts["base"]), facts["n_features"])


@dataclass(frozen=True)
class SoftmaxBoosting:
    """Estimator of ``SoftmaxModel``: ``rows`` need (features, label) and, to leave out folds, fold."""

    n_classes: int
    rounds: int = 100
    depth: int = 3
    step: float = 0.1
    bins: int = 128
    cells_in_task: int = CELLS_IN_TASK

    def fit(self, rows: DataFrame) -> SoftmaxModel:
        return self.fit_without(rows.withColumn("fold", F.lit(-1)), [-2])[0]

    def fit_without(self, rows: DataFrame, left_out: list[int]) -> list[SoftmaxModel]:
        """One model for each fold that is left out, all grown in the same passes."""
        spark = rows.sparkSession
        ship_package(spark)
        plain = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"), "fold")
        d = plain.select(F.size("x")).first()[0]
        edges = self._edges(plain, d)
        K, M = self.n_classes, len(left_out)
        counts = np.zeros((M, K))
        for r in plain.groupBy("fold", "label").count().collect():
            for m, fold in enumerate(left_out):
                counts[m, r["label"]] += r["count"] * (r["fold"] != fold)
        share = np.maximum(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1), np.finfo(np.float32).eps)
        base = np.log(share)
        state = self._binned(plain, edges, base).persist(StorageLevel.MEMORY_AND_DISK)
        if state.count() * K * d <= self.cells_in_task:
            grown = self._grown_alone(state, base, left_out)
            state.unpersist()
            return [SoftmaxModel(grown[m], edges, base[m], d) for m in range(M)]
        grown = [Trees.unsplit(self.rounds, K, self.depth) for _ in left_out]
        for r in range(self.rounds):
            before = None
            if r:
                before, state = state, self._advanced(state, grown, r - 1)
                state = freeze(state) if r % ROUNDS_PER_CUT == 0 else state.persist(StorageLevel.MEMORY_AND_DISK)
            for level in range(self.depth):
                self._grow(state, grown, r, level, left_out, d)
                if before is not None:
                    before.unpersist()      # the first level has read it
                    before = None
        state.unpersist()
        return [SoftmaxModel(grown[m], edges, base[m], d) for m in range(M)]

    def _edges(self, plain: DataFrame, d: int) -> list[list[float]]:
        """Ends of the bins of each feature: quantiles from a mergeable sketch."""
        wanted = [q / self.bins for q in range(1, self.bins)]
        cuts = plain.agg(*[F.percentile_approx(F.col("x")[f], wanted, 10_000).alias(f"f{f}") for f in range(d)]).first()
        return [sorted(set(cuts[f"f{f}"] or [])) for f in range(d)]

    def _binned(self, plain: DataFrame, edges: list[list[float]], base: np.ndarray) -> DataFrame:
        """(bins, label, fold, n, raw): bins of the features with their rows and the class scores of every model, as bytes."""
        def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = len(batch)
                if not n:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                bins = np.stack([np.searchsorted(e, x[:, f]) if e else np.zeros(n, int) for f, e in enumerate(edges)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [_bytes(bins.astype(np.uint16)), batch.column(1), batch.column(2).cast(pa.int32())], ["bins", "label", "fold"])

        binned = plain.mapInArrow(bin_, "bins binary, label int, fold int")
        return binned.groupBy("bins", "label", "fold").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "raw", F.lit(bytearray(base.astype(np.float64).tobytes())))

    def _grown_alone(self, state: DataFrame, base: np.ndarray, left_out: list[int]) -> list[Trees]:
        """The trees of every model, each grown by one task from all groups, which are few."""
        spark = state.sparkSession
        groups = state.select("bins", "label", "fold", "n").toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast([
            _items(groups["bins"].combine_chunks(), np.uint16), *(groups[c].to_numpy() for c in ("label", "fold", "n"))])

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins, label, fold, n = shared.value
            for m in (int(m) for batch in batches for m in batch.column(0).to_pylist()):
                some = np.flatnonzero(fold != left_out[m])
                # Folds no longer matter: groups that differ in nothing else are one.
                own, place = np.unique(np.column_stack([bins[some], label[some]]), axis=0, return_inverse=True)
                rows = np.bincount(place.ravel(), weights=n[some], minlength=len(own))
                trees = grow_alone(own[:, :-1].astype(np.int64), own[:, -1].astype(np.int64), rows, base[m], self)
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([pickle.dumps(trees)], pa.binary())], ["m", "trees"])

        done = spark.range(0, len(left_out), 1, len(left_out)).mapInArrow(grow, "m int, trees binary").collect()
        shared.destroy()
        return [pickle.loads(r["trees"]) for r in sorted(done, key=lambda r: r["m"])]

    def _advanced(self, state: DataFrame, grown: list[Trees], r: int) -> DataFrame:
        """``state`` with the trees of one round added to the class scores."""
        trees = [(t.feature[r].copy(), t.cut[r].copy(), t.value[r].copy()) for t in grown]
        K, depth = self.n_classes, self.depth

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                bins, raw = _items(batch.column(0), np.uint16), _items(batch.column(4), np.float64).copy()
                for m, (feature, cut, value) in enumerate(trees):
                    for k in range(K):
                        raw[:, m * K + k] += value[k][descend(bins, feature[k], cut[k], depth)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], _bytes(raw)], ["bins", "label", "fold", "n", "raw"])

        return state.mapInArrow(add, "bins binary, label int, fold int, n long, raw binary")

    def _grow(self, state: DataFrame, grown: list[Trees], r: int, level: int, left_out: list[int], d: int) -> None:
        """Split all nodes of one level of all trees of a round."""
        K, B, nodes, M = self.n_classes, self.bins, 1 << level, len(grown)
        trees = [(t.feature[r].copy(), t.cut[r].copy()) for t in grown]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, M, K, nodes, d, B))
            for batch in batches:
                if not len(batch):
                    continue
                bins, raw = _items(batch.column(0), np.uint16), _items(batch.column(4), np.float64)
                label, fold, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                for m, (feature, cut) in enumerate(trees):
                    some = np.flatnonzero(fold != left_out[m])
                    total[:, m] += level_sums(
                        bins[some], label[some], n[some].astype(float), raw[some, m * K:(m + 1) * K], feature, cut, level, B)
            where = np.nonzero(total[0])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(w, pa.int32()) for w in where], *[pa.array(t[where]) for t in total]],
                ["m", "k", "node", "f", "b", "n", "r", "h"])

        cells = state.mapInArrow(sums, _SUMS).groupBy("m", "k", "node", "f", "b").agg(*[F.sum(c).alias(c) for c in "nrh"])
        if M * K * nodes * d * B <= CELLS_ON_DRIVER:
            splits = _best_on_driver(cells.toPandas(), (M, K, nodes, d, B))
        else:
            splits = (r.asDict() for r in _best_splits(cells).collect())
        for row in splits:
            grown[row["m"]].split(row, r, level, self.step)


def _best_splits(cells: DataFrame) -> DataFrame:
    """(m, k, node) with the split of the largest improvement and the sums on its left and in all; of equal ones the first."""
    of = Window.partitionBy("m", "k", "node", "f")
    left = of.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = cells.select("m", "k", "node", "f", "b", *[F.sum(c).over(left).alias(f"{c}l") for c in "nrh"],
                        *[F.sum(c).over(of).alias(c) for c in "nrh"])
    gap = F.col("rl") / F.col("nl") - (F.col("r") - F.col("rl")) / (F.col("n") - F.col("nl"))
    gain = F.when(F.col("nl") < F.col("n"), F.col("nl") * (F.col("n") - F.col("nl")) / F.col("n") * gap * gap).otherwise(0.0)
    best = both.withColumn("gain", F.round(gain, 10)).groupBy("m", "k", "node").agg(
        F.max_by(F.struct("f", "b", "gain", "nl", "rl", "hl", "n", "r", "h"), F.struct("gain", -F.col("f"), -F.col("b"))).alias("s"))
    return best.select("m", "k", "node", "s.*")


def _best_on_driver(cells: pd.DataFrame, shape: tuple[int, ...]) -> Iterator[dict]:
    """``_best_splits`` of sums whose number is bounded by the shape of the trees."""
    sums = np.zeros((3, *shape))
    sums[(slice(None), *(cells[c].to_numpy() for c in ("m", "k", "node", "f", "b")))] = cells[["n", "r", "h"]].to_numpy().T
    return best_of(sums)


def best_of(sums: np.ndarray) -> Iterator[dict]:
    """``_best_splits`` of sums (rows, residuals, curvatures) over (model, class, node, feature, bin)."""
    left, whole = np.cumsum(sums, axis=-1), sums.sum(axis=-1, keepdims=True)
    rest = whole - left
    inside = (left[0] > 0) & (rest[0] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = left[1] / left[0] - rest[1] / rest[0]
        gain = np.where(inside, np.round(left[0] * rest[0] / whole[0] * gap * gap, 10), 0.0)
    m, k, node, d, bins = sums.shape[1:]
    flat = gain.reshape(m * k * node, d * bins)
    for place, best in enumerate(flat.argmax(axis=1).tolist()):
        at = (*np.unravel_index(place, (m, k, node)), *np.unravel_index(best, (d, bins)))
        totals = whole[(slice(None), *at[:4], 0)]
        if totals[0]:
            yield {**dict(zip(("m", "k", "node", "f", "b"), map(int, at))), "gain": float(gain[at]),
                   **dict(zip(("nl", "rl", "hl"), left[(slice(None), *at)].tolist())), **dict(zip("nrh", totals.tolist()))}


def _bytes(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _items(column: pa.Array, kind: type) -> np.ndarray:
    """The matrix whose rows are the binary values."""
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data[int(bounds[0]):int(bounds[-1])], dtype=kind).reshape(len(column), -1)
