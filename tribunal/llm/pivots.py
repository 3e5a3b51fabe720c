"""Near-duplicate vectors through a pivot-permutation index.

Every vector is described by its nearest reference points (pivots) in order of
nearness.  Each pivot's inverted list holds the vectors that name it.  Vectors
of one list that share enough pivots are candidates and are verified by cosine
right there, in blocks, so no table of pairs ever exists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tribunal.llm.common import prepare_workers, total, written
from tribunal.llm.components import components
from tribunal.llm.near_dup import spanning


@dataclass(frozen=True)
class PivotIndex:
    """Settings: the linking cosine, pivots named per vector, pivots that candidates share, and bounds.

    The number of pivots grows with the square root of the table up to
    ``most_pivots``; lists of more than ``block`` vectors are compared block by
    block.  Pivots come from the ``sample`` vectors with the smallest hashes.
    """

    cosine: float = 0.98
    named: int = 8
    shared: int = 3
    least_pivots: int = 64
    most_pivots: int = 4096
    sample: int = 8192
    block: int = 1024
    group_bytes: int = 8 << 20


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def choose_pivots(vectors: list[np.ndarray], wanted: int) -> np.ndarray:
    """Up to ``wanted`` unit vectors, no two nearly alike, so that a large group of copies is one pivot."""
    chosen = np.empty((0, len(vectors[0])))
    for row in unit(np.array(vectors)):
        if not len(chosen) or np.max(chosen @ row) < 0.9:
            chosen = np.vstack([chosen, row])
        if len(chosen) == wanted:
            break
    return chosen


def describe(rows: np.ndarray, pivots: np.ndarray, named: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    near = -(unit(rows) @ pivots.T)
    k = min(named, len(pivots))
    first = np.argpartition(near, k - 1, axis=1)[:, :k]
    order = np.argsort(np.take_along_axis(near, first, axis=1), axis=1, kind="stable")
    return np.take_along_axis(first, order, axis=1)


def compare_list(
    vectors: np.ndarray, perms: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, pivot: int,
    shared: int, cosine: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``left`` with ``right`` that are this list's to report, and the weight linked to each vector.

    A pair that shares several lists is reported by the one with the smallest pivot.
    """
    names, column = np.unique(perms, return_inverse=True)
    column = column.reshape(perms.shape)
    marks = np.zeros((len(vectors), len(names)), dtype=np.float32)
    np.put_along_axis(marks, column, 1, axis=1)
    both = marks[left] @ marks[right].T
    lower = marks[:, names < pivot]
    earlier = lower[left] @ lower[right].T
    need = min(shared, perms.shape[1])
    candidates = (both >= need) & (earlier == 0) & (left[:, None] != right[None, :])
    exact = unit(vectors[left]) @ unit(vectors[right]).T
    links = candidates & (exact >= cosine)
    linked = np.zeros(len(vectors), dtype=np.int64)
    linked[left] += links @ weight[right]
    if not np.array_equal(left, right):
        linked[right] += links.T @ weight[left]
    return links, linked


def vector_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    index: PivotIndex = PivotIndex(),
) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept.

    Only vectors with equal labels and equal lengths are compared.  A vector that
    is null, empty or zero or holds null or non-finite components, and a row
    with a null label or key, link with nothing.  Equal vectors are one class
    and are counted, not paired.  Rows that repeat a key and vector are the same
    vector; a key with several vectors gets their links together.  Other columns
    are not read; an empty table gives no rows.
    """
    prepare_workers(rows)
    spark = rows.sparkSession
    wide = "double" if "double" in dict(rows.select(vector).dtypes)[vector] else "float"
    kind = "<f8" if wide == "double" else "<f4"
    base = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"),
                       F.col(vector).cast(f"array<{wide}>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound
              & F.exists("vector", lambda x: x != 0))
    good = base.where(usable).dropDuplicates(["vec_id", "label", "vector"])
    classes = written(good.groupBy("label", "vector").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    n_classes = classes.count()

    sample = classes.orderBy(F.xxhash64("vector"), "rep").limit(index.sample).select("vector").collect()
    by_length: dict[int, list] = {}
    for (v,) in sample:
        by_length.setdefault(len(v), []).append(np.array(v))
    wanted = min(index.most_pivots, max(index.least_pivots, math.ceil(2 * math.sqrt(max(n_classes, 1)))))
    pivots = {n: choose_pivots(v, wanted) for n, v in by_length.items()}
    shared = spark.sparkContext.broadcast(pivots)            # at most most_pivots vectors of each length
    named = index.named

    def name_pivots(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(0)
            length = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            where = np.concatenate([[0], np.cumsum(length)])
            perms: list = [None] * part.num_rows
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                block = np.stack([flat[where[i]:where[i] + n] for i in own])
                found = (describe(block, shared.value[int(n)], named) if int(n) in shared.value
                         else np.zeros((len(own), 1), dtype=np.int64))
                for i, p in zip(own, found):
                    perms[i] = p
            packed = [flat[a:b].astype(kind).tobytes() for a, b in zip(where[:-1], where[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), part.column(3), pa.array(length, pa.int32()),
                 pa.array(perms, pa.list_(pa.int32())), pa.array(packed, pa.binary())],
                ["label", "rep", "weight", "n", "perm", "packed"])

    label_kind = dict(classes.dtypes)["label"]
    described = written(classes.select("vector", "label", "rep", "weight").mapInArrow(
        name_pivots, f"label {label_kind}, rep long, weight long, n int, perm array<int>, packed binary"), "described")

    place = ["label", "n", "pivot"]
    listed = described.withColumn("pivot", F.explode("perm"))
    sizes = listed.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / index.block).cast("int").alias("n_blocks"))
    placed = (
        listed.join(sizes, place)
        .withColumn("own", F.pmod(F.xxhash64("rep", "packed"), F.col("n_blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    )
    n_groups = max(1, -(-total(described, F.octet_length("packed") * named + 64 * named) // index.group_bytes))
    place_code = F.xxhash64(*place, "x", "y")
    dealt = placed.select(
        F.xxhash64(*place).alias("place"), "pivot", "x", "y", "own", "rep", "weight", "perm", "packed",
        F.pmod(place_code, F.lit(n_groups)).alias("_group"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("place", "pivot", "x", "y", "rep")])
        where = np.stack([group[c].to_numpy() for c in ("place", "pivot", "x", "y")], axis=1)
        rep, own, weight = (group[c].to_numpy() for c in ("rep", "own", "weight"))
        perms, packed = group["perm"].to_pylist(), group["packed"].to_pylist()
        cuts = np.flatnonzero(np.any(where[1:] != where[:-1], axis=1)) + 1
        out: list[tuple] = []
        for lo, hi in zip([0, *cuts], [*cuts, len(rep)]):
            home = own[lo:hi]
            left, right = np.flatnonzero(home == where[lo, 2]), np.flatnonzero(home == where[lo, 3])
            if hi - lo < 2 or not len(left) or not len(right):
                continue
            vectors = np.stack([np.frombuffer(p, dtype=kind) for p in packed[lo:hi]])
            links, linked = compare_list(vectors, np.array(perms[lo:hi]), weight[lo:hi], left, right,
                                         int(where[lo, 1]), index.shared, index.cosine)
            names = rep[lo:hi]
            out += [(int(names[i]), None, int(linked[i])) for i in np.flatnonzero(linked)]
            out += [(a, b, None) for a, b in spanning(links, names[left], names[right])]
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["a", "b", "n"])

    found = written(dealt.groupBy("_group").applyInArrow(compare, "a long, b long, n long"), "vector-links")
    linked = found.where("b is null").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("n"))
    inner = classes.groupBy("rep").agg(F.sum(F.col("weight") - 1).alias("inner"))
    comps = components(found.where("b is not null").select("a", "b").union(_ties(good, classes)))
    named_classes = (
        inner.join(linked, F.col("rep") == F.col("_a"), "left").join(comps, F.col("rep") == F.col("node"), "left")
        .select("rep", (F.col("inner") + F.coalesce("n", F.lit(0))).alias("n"),
                F.coalesce("component", "rep").alias("component"))
    )
    member = classes.select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), "rep")
    own = (
        base.where(usable).join(member, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")))
        .select("vec_id", "rep").join(named_classes, "rep")
        .select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    )
    alone = base.where(~F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _ties(good: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of a key that has several vectors."""
    several = good.groupBy("vec_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("vec_id")
    return (
        good.join(several, "vec_id", "left_semi").join(classes, ["label", "vector"])
        .where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    )
