import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from tribunal.functions.shapley import expected
from tribunal.operators import boosting as B, explain as X
from tribunal.operators.boosting import SoftmaxBoosting, SoftmaxModel, softmax


@pytest.fixture(scope="module")
def rows(spark):
    """Four classes in a plane, some labels wrong, and a feature without meaning."""
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, size=(900, 3))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.2)
    y = np.where(rng.uniform(size=900) < 0.1, rng.integers(0, 4, 900), y)
    data = [(i, *map(float, v), float(t), i % 5) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "row_id long, a double, b double, c double, label double, fold int")
    return VectorAssembler(inputCols=list("abc"), outputCol="features").transform(df).repartition(3).persist()


def _arrays(rows):
    found = rows.orderBy("row_id").collect()
    return np.array([r["features"].toArray() for r in found]), np.array([int(r["label"]) for r in found]), np.array([r["fold"] for r in found])


def _reference(x, y, edges, rounds, depth, step, K):
    """The same boosting on plain arrays: exhaustive best splits by improvement, Newton leaves."""
    share = np.maximum(np.bincount(y, minlength=K) / len(y), np.finfo(np.float32).eps)
    raw = np.tile(np.log(share), (len(x), 1))
    bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)

    def grow(some, rest, level, out):
        best = (0.0,)
        for f in range(x.shape[1]):
            for b in np.unique(bins[some, f])[:-1]:
                left = some[bins[some, f] <= b]
                n, m = len(left), len(some) - len(left)
                other = some[bins[some, f] > b]
                gain = round(n * m / len(some) * (rest[left].mean() - rest[other].mean()) ** 2, 10)
                if gain > best[0]:
                    best = (gain, left, other)
        if level == depth or len(best) == 1:
            h = (np.abs(rest[some]) * (1 - np.abs(rest[some]))).sum()
            out[some] = step * (K - 1) / K * rest[some].sum() / h if abs(h) > 1e-150 else 0.0
            return
        for side in best[1:]:
            grow(side, rest, level + 1, out)

    for _ in range(rounds):
        p, add = softmax(raw), np.zeros_like(raw)
        for k in range(K):
            grow(np.arange(len(x)), (y == k) - p[:, k], 0, add[:, k])
        raw += add
    return raw


@pytest.mark.parametrize("on_driver", [0, 10**6])
def test_equals_the_method_on_plain_arrays(rows, monkeypatch, on_driver):
    monkeypatch.setattr(B, "CELLS_ON_DRIVER", on_driver)
    boost = SoftmaxBoosting(4, rounds=3, depth=2, bins=16)
    model = boost.fit(rows)
    x, y, _ = _arrays(rows)
    np.testing.assert_allclose(model.raw(x), _reference(x, y, model.edges, 3, 2, 0.1, 4), atol=1e-9)
    scored = {r["row_id"]: r for r in model.transform(rows).collect()}
    shares = softmax(model.raw(x))
    for i, s in enumerate(shares):
        np.testing.assert_allclose(scored[i]["probability"].toArray(), s, atol=1e-12)
        assert scored[i]["prediction"] == s.argmax()


def test_folds_grow_together(rows):
    boost = SoftmaxBoosting(4, rounds=2, depth=2, bins=16)
    together = boost.fit_without(rows, [0, 3])
    x, y, fold = _arrays(rows)
    for model, left_out in zip(together, (0, 3)):
        kept = fold != left_out
        np.testing.assert_allclose(model.raw(x[kept]), _reference(x[kept], y[kept], model.edges, 2, 2, 0.1, 4), atol=1e-9)


def test_loss_of_held_out_rows_falls(rows):
    """Rows of the folds 1 to 4 train, those of fold 0 test."""
    x, y, fold = _arrays(rows)
    model = SoftmaxBoosting(4, rounds=10, depth=3, bins=32).fit_without(rows, [0])[0]
    losses = []
    for rounds in (0, 4, 10):
        t = model.trees
        part = SoftmaxModel(type(t)(*(a[:rounds] for a in (t.feature, t.cut, t.value, t.weight, t.gain))), model.edges, model.base, 3)
        shares = softmax(part.raw(x[fold == 0]))
        assert shares.sum(axis=1) == pytest.approx(1.0)
        losses.append(-np.log(shares[np.arange(len(shares)), y[fold == 0]]).mean())
    assert losses[0] == pytest.approx(np.log(4), abs=0.1) and losses[0] > losses[1] + 0.3 > losses[2] + 0.4


def test_saved_explained_and_ranked(spark, rows, tmp_path):
    model = SoftmaxBoosting(4, rounds=3, depth=3, bins=16).fit(rows)
    model.save(spark, str(tmp_path / "m"))
    again = SoftmaxModel.load(spark, str(tmp_path / "m"))
    x, _, _ = _arrays(rows)
    np.testing.assert_array_equal(again.raw(x), model.raw(x))
    ensemble = X.tree_ensemble(model, spark)
    groups = [g for block in X._leaf_blocks(ensemble) for g in block]
    np.testing.assert_allclose(expected(groups) + model.base, ensemble.base, atol=1e-12)
    phi = {(r["row_id"], r["output"]): sum(r["phi"]) for r in X.tree_shap_values(rows.limit(40), ensemble).collect()}
    raw = model.raw(x)
    for (i, k), total in phi.items():
        assert ensemble.base[k] + total == pytest.approx(raw[i, k], abs=1e-9)
    ranking = [r["feature"] for r in X.native_importance(model, list("abc"), spark).orderBy("rank").collect()]
    assert set(ranking[:2]) == {"a", "b"} and model.featureImportances.sum() == pytest.approx(1.0)


def test_a_class_that_a_fold_lacks(spark):
    df = spark.createDataFrame([(i, float(i % 3), float(i % 3), 0 if i % 3 == 2 else 1) for i in range(30)],
                               "row_id long, a double, label double, fold int")
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(df)
    model = SoftmaxBoosting(3, rounds=2, depth=1, bins=4).fit_without(rows, [0])[0]
    shares = softmax(model.raw(np.array([[0.0], [1.0], [2.0]])))
    assert np.isfinite(shares).all() and shares[:, 2].max() < 0.01 and shares[0].argmax() == 0


def test_equal_rows_are_read_once_a_pass(spark, monkeypatch):
    """A pass reads the groups of equal bins, label and fold; its sums count all their rows."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, size=(700, 2)).astype(float)
    y = np.where(rng.uniform(size=700) < 0.3, rng.integers(0, 3, 700), (x[:, 0] + x[:, 1]).astype(int) % 3)
    fold = rng.integers(0, 2, 700)
    df = spark.createDataFrame([(i, *map(float, v), float(t), int(f)) for i, (v, t, f) in enumerate(zip(x, y, fold))],
                               "row_id long, a double, b double, label double, fold int")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).repartition(5)
    states, binned = [], SoftmaxBoosting._binned

    def seen(*args):
        states.append(binned(*args))
        return states[-1]

    monkeypatch.setattr(SoftmaxBoosting, "_binned", seen)
    models = SoftmaxBoosting(3, rounds=3, depth=2, bins=8).fit_without(rows, [0, -2])
    read = states[0].select("n").collect()
    assert len(read) == len({(*v, t, f) for v, t, f in zip(x.tolist(), y.tolist(), fold.tolist())})
    assert sum(r["n"] for r in read) == 700
    for model, kept in zip(models, (fold != 0, fold >= 0)):
        np.testing.assert_allclose(model.raw(x[kept]), _reference(x[kept], y[kept], model.edges, 3, 2, 0.1, 3), atol=1e-9)
        assert (model.trees.weight[:, :, 0] == kept.sum()).all()


@pytest.mark.parametrize("in_task", [0, 10**6])
def test_groups_in_one_task_and_in_passes_grow_the_same_trees(rows, in_task):
    boost = SoftmaxBoosting(4, rounds=3, depth=2, bins=16, cells_in_task=in_task)
    x, y, fold = _arrays(rows)
    for model, left_out in zip(boost.fit_without(rows, [0, 3]), (0, 3)):
        kept = fold != left_out
        np.testing.assert_allclose(model.raw(x[kept]), _reference(x[kept], y[kept], model.edges, 3, 2, 0.1, 4), atol=1e-9)
        assert model.trees.weight[0, 0, 0] == kept.sum()


def test_few_groups_need_no_pass_per_round(rows):
    """The number of Spark jobs does not follow the rounds."""
    context = rows.sparkSession.sparkContext
    jobs = {}
    for rounds in (1, 12):
        context.setJobGroup(f"boosting {rounds}", "")
        assert SoftmaxBoosting(4, rounds=rounds, depth=2, bins=16).fit(rows).trees.value.shape[0] == rounds
        jobs[rounds] = len(context.statusTracker().getJobIdsForGroup(f"boosting {rounds}"))
    context._jsc.clearJobGroup()
    assert 0 < jobs[12] <= jobs[1] + 1
