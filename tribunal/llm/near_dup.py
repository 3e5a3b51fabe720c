"""Near-duplicate documents by tensored MinHash banding and exact verification.

Two small collections of MinHash groups are computed per document; the table
keys are all pairs of one group from each.  So m x m tables cost only 2m
groups, about the square root of the hash computations of independent tables.
A document whose group values of the first collection nobody shares can have
no partner, and only the others get their pairs written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tribunal.llm.common import (
    Words, batches, mixed, prepare_workers, shingle_codes, slices, text_bytes, total, written,
)
from tribunal.llm.components import components

#: Text handled at once by one task.
_SLICE = 1 << 20


@dataclass(frozen=True)
class Banding:
    """Words in a shingle, linking similarity in percent, MinHashes in a group and the chance of a miss.

    The chance holds for a pair exactly at the threshold, per collection.
    """

    words: int = 3
    percent: int = 85
    group: int = 4
    miss: float = 2e-4

    @property
    def groups(self) -> int:
        """Groups in each of the two collections."""
        shared = (self.percent / 100) ** self.group
        return math.ceil(math.log(self.miss) / math.log(1 - shared))


def document_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle codes) for every row of a text column."""
    raw, starts, ends = text_bytes(column)
    for i, j in slices(starts, ends, _SLICE):
        found = Words(raw, starts[i:j], ends[i:j], lower=True)
        for k in range(i, j):
            code = found.code[found.first[k - i]:found.first[k - i + 1]]
            if 0 < len(code) < words:
                # A short text is one shingle; its length tells it from a longer one.
                yield k, shingle_codes(code, len(code)) + np.uint64(len(code))
            else:
                yield k, np.unique(shingle_codes(code, words))


def signatures(docs: DataFrame, key: str, text: str, banding: Banding) -> DataFrame:
    """Per row: key, set size, two digests of the set and the two collections of MinHash groups."""
    words, group, m = banding.words, banding.group, banding.groups
    schema = "doc_id long, n_shingles long, set_a long, set_b long, u array<long>, v array<long>"

    def sign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20)
        times = rng.integers(0, 2**63, 2 * m * group, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        plus = rng.integers(0, 2**63, 2 * m * group, dtype=np.uint64)
        tag = mixed(np.arange(1, 2 * m + 1, dtype=np.uint64))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        titles = ("doc_id", "n_shingles", "set_a", "set_b", "u", "v")
        for part in parts:
            keys = part.column(0).to_pylist()
            out = []
            for k, codes in document_sets(part.column(1), words):
                if not len(codes):
                    out.append((keys[k], 0, 0, 0, [], []))
                    continue
                least = np.full(2 * m * group, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(codes), 256):
                    block = codes[at:at + 256, None] * times + plus
                    np.minimum(least, block.min(axis=0), out=least)
                joined = shingle_codes_rows(least.reshape(2 * m, group)) + tag
                joined = mixed(joined).astype(np.int64)
                digests = (mixed(codes).sum(dtype=np.uint64), mixed(codes ^ np.uint64(0x5555)).sum(dtype=np.uint64))
                out.append((keys[k], len(codes), *(int(d.astype(np.int64)) for d in digests), joined[:m], joined[m:]))
                if len(out) == 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], titles)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], titles)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(sign, schema)


def shingle_codes_rows(rows: np.ndarray) -> np.ndarray:
    """One code per row of a matrix of codes."""
    out = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = mixed(out + rows[:, k] * np.uint64(2 * k + 3))
    return out


def candidate_links(reps: DataFrame) -> DataFrame:
    """(a, b): each document of a table bucket with the bucket's smallest one."""
    left = reps.select("rep", F.explode("u").alias("u"))
    shared = left.groupBy("u").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    live = left.join(shared, "u").join(reps.select("rep", "v"), "rep")
    keys = live.select("rep", F.explode(F.transform("v", lambda v: F.xxhash64(F.col("u"), v))).alias("key"))
    keys = written(keys, "buckets")
    least = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("rep").alias("b")).where("rows > 1")
    return keys.join(least.drop("rows"), "key").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Intersection sizes of ``sets[left]`` with ``sets[right]``, by products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    codes, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = n > 1
    column = np.cumsum(often) - 1
    keep = often[inverse]
    owner, column = owner[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 4096
    for at in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        out += block[left] @ block[right].T
    return out.astype(np.int64)


def spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix ``links`` connects, one per node but the first of each tree."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    for i, j in zip(*np.nonzero(links)):
        x, y = root(int(left[i])), root(int(right[j]))
        if x != y:
            above[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in above if root(x) != x]


def verified_links(
    docs: DataFrame, key: str, text: str, reps: DataFrame, clusters: DataFrame, banding: Banding,
    block: int = 256, block_bytes: int = 8 << 20,
) -> DataFrame:
    """Links (a, b) between documents of one cluster whose full sets are similar enough.

    A cluster is cut into blocks of bounded rows and bytes; every pair of blocks
    is compared in one place on the full sets, and only links that connect
    something go on.
    """
    words, percent = banding.words, banding.percent
    members = clusters.join(reps.select(F.col("rep").alias("node"), "n_shingles"), "node")
    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("codes"))
    blocks = sized.select("component", F.greatest(
        F.ceil(F.col("rows") / block), F.ceil(F.col("codes") * 8 / block_bytes)).cast("int").alias("n_blocks"))
    placed = members.join(blocks, "component").withColumn(
        "own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    visits = placed.select("node", "component", "own", F.least("own", "other").alias("x"),
                           F.greatest("own", "other").alias("y"), "n_shingles")
    visits = written(visits, "visits")
    n_groups = max(1, -(-total(visits, F.col("n_shingles") * 8 + 64) // block_bytes))

    def to_sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = part.column(0).to_pylist()
            out = []
            for k, codes in document_sets(part.column(1), words):
                out.append((keys[k], codes.tobytes()))
                if len(out) == 500:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], ["node", "codes"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], ["node", "codes"])

    nodes = clusters.select(F.col("node").alias("_node"))
    wanted = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).join(
        nodes, F.col("_key") == F.col("_node"), "left_semi")
    sets = wanted.mapInArrow(to_sets, "node long, codes binary")

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by([("component", "ascending"), ("x", "ascending"), ("y", "ascending"),
                               ("node", "ascending")])
        where = np.stack([group[c].to_numpy() for c in ("component", "x", "y")], axis=1)
        node, own = group["node"].to_numpy(), group["own"].to_numpy()
        codes = group["codes"].to_pylist()
        cuts = np.flatnonzero(np.any(where[1:] != where[:-1], axis=1)) + 1
        found = []
        for lo, hi in zip([0, *cuts], [*cuts, len(node)]):
            _, one = np.unique(node[lo:hi], return_index=True)      # a repeated row of a document is no second one
            names, home = node[lo:hi][one], own[lo:hi][one]
            sets_ = [np.frombuffer(codes[lo + i], dtype=np.uint64) for i in one]
            left = np.flatnonzero(home == where[lo, 1])
            right = np.flatnonzero(home == where[lo, 2])
            if not len(left) or not len(right):
                continue
            shared = shared_counts(sets_, left, right)
            size = np.array([len(s) for s in sets_])
            either = size[left][:, None] + size[right][None, :] - shared
            links = (100 * shared >= percent * either) & (left[:, None] != right[None, :])
            found += spanning(links, names[left], names[right])
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = visits.drop("n_shingles").join(sets, "node").withColumn(
        "_group", F.pmod(F.xxhash64("component", "x", "y"), F.lit(n_groups)))
    return dealt.groupBy("_group").applyInArrow(verify, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", banding: Banding = Banding()
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Words are split at ASCII white space and lower-cased in A-Z.  Documents are
    linked if their shingle sets reach the similarity; equal sets are linked
    without comparing them.  Null or wordless text has an empty set and links
    with nothing.  Rows that repeat a key are the same document and get the
    same component; a null key links with nothing and is kept.  Other columns
    are not read.  An empty table gives no rows.
    """
    prepare_workers(docs)
    signed = written(signatures(docs, key, text, banding), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["set_a", "set_b", "n_shingles"]
    least = full.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    ahead = least.withColumnRenamed("rep", "doc_id")
    reps = full.join(ahead, [*same, "doc_id"]).dropDuplicates(["doc_id", *same]).select(
        F.col("doc_id").alias("rep"), "n_shingles", "u", "v")
    reps = written(reps, "representatives")
    clusters = written(components(candidate_links(reps)), "clusters")
    links = verified_links(docs, key, text, reps, clusters, banding)
    # A key with several texts ties its sets together.
    tied = full.join(least, same).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.union(_ties(tied, least)))
    named = least.join(found, F.col("rep") == F.col("node"), "left").select(
        *[F.col(c).alias(f"_{c}") for c in same], F.coalesce("component", "rep").alias("_component"))
    match = [F.col(c) == F.col(f"_{c}") for c in same] + [F.col("n_shingles") > 0, F.col("doc_id").isNotNull()]
    out = signed.join(named, match, "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"),
        F.coalesce("_component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", banding: Banding = Banding()
) -> DataFrame:
    """Rows of ``docs``, with all columns, without those that are near-duplicates of a kept document.

    Of each group the smallest key stays.  Rows that repeat a kept key with the
    same text are one document and one of them stays; rows without a key and
    documents without words all stay.
    """
    gone = near_duplicates(docs, key, text, banding).where("not kept").select(F.col("doc_id").alias("llm_gone"))
    left = docs.join(gone, F.col(key).cast("long") == F.col("llm_gone"), "left_anti")
    repeated = docs.groupBy(F.col(key).alias("llm_again")).agg(F.count(F.lit(1)).alias("llm_rows")).where(
        "llm_rows > 1 and llm_again is not null")
    repeated = written(repeated.select("llm_again"), "repeated-keys")
    if not repeated.head(1):
        return left
    once = left.join(repeated, F.col(key) == F.col("llm_again"), "left_anti")
    again = left.join(repeated, F.col(key) == F.col("llm_again"), "left_semi").dropDuplicates([key, text])
    return once.union(again)


def _ties(tied: DataFrame, least: DataFrame) -> DataFrame:
    """Links through documents that represent one set and belong to another as well."""
    return tied.join(least.select(F.col("rep").alias("a")).distinct(), "a", "left_semi").select("a", "b")
