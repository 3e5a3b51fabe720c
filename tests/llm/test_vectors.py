import numpy as np
import pytest
from fixtures import joined
from pyspark.sql import functions as F

from tribunal.llm import queries as Q
from tribunal.llm.common import table
from tribunal.llm.pivots import PivotIndex, vector_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    """rows: (id, vector, label), ids unique."""
    links = []
    good = [(i, np.array(v, dtype=np.float32).astype(float), lab) for i, v, lab in rows
            if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for lab in {(g[2], len(g[1])) for g in good}:
        own = [g for g in good if (g[2], len(g[1])) == lab]
        x = np.array([g[1] for g in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found = np.argwhere(np.triu(x @ x.T >= cosine, 1))
        links += [(own[a][0], own[b][0]) for a, b in found]
    ids = [r[0] for r in rows]
    comp = joined(ids, links)
    n = {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i], comp[i] == i) for i in ids}


def rows_of(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def cloud(seed=0, n=400, dim=64):
    """Vectors with near copies at all cosines around the limit, and many exact copies."""
    r = np.random.default_rng(seed)
    out = []
    for g in range(n):
        base = r.normal(size=dim)
        base /= np.linalg.norm(base)
        out.append(base)
        for _ in range(int(r.integers(0, 4))):
            noise = r.normal(size=dim)
            noise -= (noise @ base) * base
            noise /= np.linalg.norm(noise)
            c = r.uniform(0.975, 0.999)
            out.append(c * base + np.sqrt(1 - c * c) * noise)
    out += [out[0]] * 50
    hub = out[5]
    out += [hub + 0.01 * r.normal(size=dim) for _ in range(150)]
    return [(i, [float(np.float32(x)) for x in v], int(i % 3 == 0)) for i, v in enumerate(out)]


@pytest.mark.parametrize("block", [1024, 16])
def test_matches_brute_force(spark, block):
    rows = cloud()
    got = rows_of(vector_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), index=PivotIndex(block=block)))
    expected = brute(rows)
    linked = sum(e[0] for e in expected.values())
    assert linked > 1000 and sum(g[0] for g in got.values()) >= 0.995 * linked
    assert all(got[i][0] <= expected[i][0] for i in got)
    assert sum(got[i] == expected[i] for i in got) >= 0.99 * len(got)


def test_awkward_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1),
            (8, [1.0, None, 3.0], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1),
            (11, [1.0, 2.0], 1), (12, [2.0, 4.0, 6.0], 1), (13, [-1.0, -2.0, -3.0], 1)]
    df = spark.createDataFrame([*rows, (None, v, 1), (2, v, 1)], SCHEMA).repartition(3)
    for c in ("rep", "weight", "n_links", "component_id", "kept", "vector", "n", "place"):
        df = df.withColumn(c, F.lit("clash"))
    got = vector_duplicates(df).collect()
    assert len(got) == 15
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None} == {(0, None, True)}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == brute(rows)
    assert vector_duplicates(df.where("1 = 0")).count() == 0


def test_query(spark, folder):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, folder, "embeddings").collect()]
    assert rows_of(Q.op7_pivot_permutations(spark, folder)) == brute(rows)
