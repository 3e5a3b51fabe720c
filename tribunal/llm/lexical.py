"""Ranked lexical search through hashed max-sketches.

The index has one row per document: its terms (64-bit codes) with their counts,
and a sketch.  The sketch folds the terms into hashed coordinates: each holds
the largest count among the terms that hash to it, and only the coordinates
that hold one are stored.  A document's impact of a term grows with the count,
so a query's terms, looked up in the sketch, give an upper bound of its score;
a block of queries is looked up at once for a block of documents.  Documents are
then scored exactly by descending bound until no bound reaches the score of the
last place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tribunal.llm.common import Words, binaries, prepare_workers, slices, text_bytes, written
from tribunal.session import new_path

_INDEX = "row long, doc_id long, n long, coordinates binary, peaks binary, codes binary, counts binary"
_SLICE = 4 << 20
#: Pairs of a document's coordinate or a query's term with what it meets, in one step.
_PAIRS = 1 << 20
#: A coordinate's largest count; it stands for all counts from here on.
_FULL = 255

_BREAKS = np.ones(256, dtype=bool)
_BREAKS[0x30:0x3A] = _BREAKS[0x41:0x5B] = _BREAKS[0x61:0x7B] = _BREAKS[0x80:] = False


#: Coordinates of a sketch.  Bounds of texts with about as many distinct terms get loose, not wrong.
COORDINATES = 1 << 16


@dataclass(frozen=True)
class Search:
    """Places per query, documents scored ahead to find a threshold, and queries bounded in one pass."""

    places: int = 50
    seeds: int = 64
    seeds_per_task: int = 16
    queries: int = 256
    query_terms: int = 50_000
    round_pairs: int = 32


def term_counts(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Distinct terms of each text: row, code and count (sorted by row), and how many terms each text has."""
    words = Words(raw, starts, ends, lower=True, breaks=_BREAKS)
    size = np.diff(words.first)
    row = np.repeat(np.arange(len(size)), size).astype(np.uint64)
    # Row and the head of the code in one number; the rare case of equal heads is sorted in full.
    head = (row << np.uint64(44)) | (words.code >> np.uint64(20))
    order = np.argsort(head)
    own, code = row[order], words.code[order]
    opens = np.append(True, (own[1:] != own[:-1]) | (code[1:] != code[:-1]))[:len(own)]
    if np.any(opens[1:] & (head[order][1:] == head[order][:-1])) or len(size) >= 1 << 20:
        order = np.lexsort((words.code, row))
        own, code = row[order], words.code[order]
        opens = np.append(True, (own[1:] != own[:-1]) | (code[1:] != code[:-1]))[:len(own)]
    at = np.flatnonzero(opens)
    return own[at].astype(np.int64), code[at], np.diff(np.append(at, len(own))), size


def sketches(own: np.ndarray, code: np.ndarray, count: np.ndarray, coordinates: int = COORDINATES):
    """Largest count at each coordinate that a row's terms hash to: row, coordinate and peak, sorted by these."""
    place = own.astype(np.uint64) * np.uint64(coordinates) + (code & np.uint64(coordinates - 1))
    order = np.argsort(place, kind="stable")
    place = place[order]
    opens = np.flatnonzero(np.append(True, place[1:] != place[:-1])[:len(place)])
    peak = np.maximum.reduceat(np.minimum(count, _FULL)[order], opens) if len(opens) else np.zeros(0)
    place = place[opens].astype(np.int64)
    return place // coordinates, (place % coordinates).astype("<u2"), peak.astype(np.uint8)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Items of a binary column in one array, and the number of each row."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    raw = data[int(bounds[0]):int(bounds[-1])] if data is not None else b""
    return np.frombuffer(raw, dtype=kind), np.diff(bounds) // size


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", coordinates: int = COORDINATES) -> DataFrame:
    """Index of all documents with a term, written to the shared folder; see ``_INDEX``.

    Terms are the runs of letters and digits of ASCII and of all other
    characters beyond it, A-Z lower-cased, in the whole text.  Null text has
    none.  Every row is a document, whatever its key.  Other columns are not
    read.
    """
    prepare_workers(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"),
                       F.col(text).alias("text"))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        titles = [x.split()[0] for x in _INDEX.split(", ")]
        for part in parts:
            raw, starts, ends = text_bytes(part.column(2))
            for i, j in slices(starts, ends, _SLICE):
                own, code, count, size = term_counts(raw, starts[i:j], ends[i:j])
                at, coordinate, peak = sketches(own, code, count, coordinates)
                distinct, held = (np.bincount(x, minlength=j - i) for x in (own, at))
                batch = pa.RecordBatch.from_arrays([
                    part.column(0).slice(i, j - i), part.column(1).slice(i, j - i), pa.array(size, pa.int64()),
                    binaries(coordinate, held), binaries(peak, held), binaries(code, distinct),
                    binaries(count.astype("<u4"), distinct)], titles)
                yield batch.filter(pa.array(size > 0))

    return written(rows.mapInArrow(scan, _INDEX), "sketches")


class Block:
    """Some queries: their terms, and once the corpus statistics are known, the weights."""

    def __init__(self, texts: list[str | None]):
        raw, starts, ends = text_bytes(pa.array(texts, pa.string()))
        own, code, _, _ = term_counts(raw, starts, ends)
        self.n = len(texts)
        self.vocabulary, which = np.unique(code, return_inverse=True)
        size = np.bincount(own, minlength=self.n)
        # Terms of each query, filled up with a term that no document has.
        self.terms = np.full((self.n, max(1, int(size.max(initial=0)))), len(self.vocabulary), dtype=np.int64)
        self.terms[own, np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)] = which
        self.own, self.which = own, which
        self.by_width: dict[int, tuple[np.ndarray, ...]] = {}

    def weigh(self, found: dict[int, int], n_docs: int, n_terms: int) -> None:
        """Weights from the number of documents that hold each term."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        for t in range(len(self.vocabulary)):
            self.weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * found.get(t, 0) + 1)))

    def lookups(self, coordinates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By coordinate: where its entries start, and their queries and weights."""
        if coordinates not in self.by_width:
            place = (self.vocabulary[self.which] & np.uint64(coordinates - 1)).astype(np.int64) * self.n + self.own
            entries, at = np.unique(place, return_inverse=True)
            weight = np.bincount(at, weights=self.weight[self.which], minlength=len(entries))
            starts = np.searchsorted(entries, np.arange(coordinates + 1) * self.n)
            self.by_width[coordinates] = starts, entries % max(1, self.n), weight
        return self.by_width[coordinates]

    def norms(self, n: np.ndarray) -> np.ndarray:
        """Length norm of documents of ``n`` terms, in whole numbers of any size."""
        values, at = np.unique(n, return_inverse=True)
        return np.array([50 + 50 * int(v) * self.n_docs // self.n_terms for v in values], dtype=np.int64)[at]

    def bounds(self, n: np.ndarray, coordinate: np.ndarray, peak: np.ndarray, held: np.ndarray,
               coordinates: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Upper bounds of all scores: (documents, documents x queries), some documents at a time.

        All numbers are whole and below 2 ** 53, so doubles hold them exactly.
        """
        starts, query, weight = self.lookups(coordinates)
        of = np.repeat(np.arange(len(n)), held)
        met = starts[coordinate.astype(np.int64) + 1] - starts[coordinate]
        some = np.flatnonzero(met)
        of, met, first = of[some], met[some], starts[coordinate[some]]
        count = peak[some].astype(np.int64)
        impact = np.where(count < _FULL, impacts(count, self.norms(n)[of]), 1_000_000)
        reached = np.append(0, np.cumsum(met))
        edges = np.searchsorted(of, np.arange(len(n) + 1))
        low = 0
        while low < len(n):
            stop = int(np.searchsorted(reached[edges], reached[edges[low]] + _PAIRS, side="right")) - 1
            high = min(len(n), max(low + 1, min(stop, low + max(1, _PAIRS // max(1, self.n)))))
            mine = slice(edges[low], edges[high])
            pairs = np.repeat(first[mine] - reached[mine] + reached[mine.start], met[mine])
            pairs += np.arange(len(pairs))
            place = np.repeat((of[mine] - low) * self.n, met[mine]) + query[pairs]
            total = np.bincount(place, weights=np.repeat(impact[mine], met[mine]) * weight[pairs],
                                minlength=(high - low) * self.n)
            yield slice(low, high), total.reshape(high - low, self.n)
            low = high

    def matched(self, code: np.ndarray, count: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of some documents that a query has, as sorted numbers (document, term), and their counts."""
        known = len(self.vocabulary)
        if not known:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place = np.searchsorted(self.vocabulary, code)
        place[place == known] = 0
        hit = np.flatnonzero(self.vocabulary[place] == code)
        return np.repeat(np.arange(len(size)), size)[hit] * (known + 1) + place[hit], count[hit].astype(np.int64)

    def scores(self, n: np.ndarray, matched: tuple[np.ndarray, np.ndarray], docs: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Exact scores of pairs (document, query)."""
        out, norm, (held, count) = np.zeros(len(docs), dtype=np.int64), self.norms(n), matched
        if not len(held):
            return out
        step = max(1, _PAIRS // self.terms.shape[1])
        for a in range(0, len(docs), step):
            d, terms = docs[a:a + step, None], self.terms[queries[a:a + step]]
            wanted = d * (len(self.vocabulary) + 1) + terms
            place = np.searchsorted(held, wanted)
            place[place == len(held)] = 0
            found = np.where(held[place] == wanted, count[place], 0)
            out[a:a + step] = (self.weight[terms] * impacts(found, norm[d])).sum(axis=1)
        return out


def impacts(count: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * count) // (1000 * count + 20 * norm)


def document_counts(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How many documents hold each term of a block's vocabulary, by its number."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(vocabulary), dtype=np.int64)
        for part in parts:
            code, _ = _flat(part.column(0), "<u8")
            place = np.searchsorted(vocabulary, code)
            place[place == len(vocabulary)] = 0
            found += np.bincount(place[vocabulary[place] == code], minlength=len(vocabulary))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["term", "docs"])

    if not len(vocabulary):
        return {}
    counted = index.select("codes").mapInArrow(count, "term long, docs long")
    return {r["term"]: r["docs"] for r in counted.groupBy("term").agg(F.sum("docs").alias("docs")).collect()}


class _Best:
    """The best scores of each query so far; ``least`` is what a document must reach."""

    def __init__(self, least: np.ndarray, places: int):
        self.least, self.places = least.copy(), places
        self.top = np.zeros((len(least), places), dtype=np.int64)

    def add(self, queries: np.ndarray, scores: np.ndarray) -> None:
        for q in np.unique(queries).tolist():
            both = np.append(self.top[q], scores[queries == q])
            self.top[q] = np.partition(both, len(both) - self.places)[-self.places:]
            self.least[q] = max(self.least[q], self.top[q].min())


def best_bounds(index: DataFrame, block: Block, how: Search, coordinates: int) -> DataFrame:
    """(row, queries): the documents with the highest bounds of each query, ``how.seeds`` of each."""

    def bound(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((0, block.n))
        rows = np.zeros((0, block.n), dtype=np.int64)
        for part in parts:
            own, n = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            (coordinate, held), (peak, _) = _flat(part.column(2), "<u2"), _flat(part.column(3), "u1")
            for docs, bounds in block.bounds(n, coordinate, peak, held, coordinates):
                top = np.concatenate([top, bounds])
                rows = np.concatenate([rows, np.broadcast_to(own[docs][:, None], bounds.shape)])
                if len(top) > how.seeds_per_task:
                    best = np.argpartition(-top, how.seeds_per_task - 1, axis=0)[:how.seeds_per_task]
                    top, rows = np.take_along_axis(top, best, 0), np.take_along_axis(rows, best, 0)
        query = np.broadcast_to(np.arange(block.n), top.shape)
        some = top > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(query[some], pa.int64()), pa.array(rows[some], pa.int64()), pa.array(top[some])],
            ["query", "row", "bound"])

    bounded = index.select("row", "n", "coordinates", "peaks").mapInArrow(bound, "query long, row long, bound double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("bound").desc(), "row"))
    best = bounded.withColumn("place", place).where(F.col("place") <= how.seeds)
    return best.groupBy("row").agg(F.collect_set("query").alias("queries"))


def thresholds(index: DataFrame, block: Block, how: Search, coordinates: int) -> np.ndarray:
    """A score that the last place of each query reaches at least: exact scores of the documents with the best bounds."""
    # At most seeds x queries rows, whatever the corpus.
    seeds = F.broadcast(best_bounds(index, block, how, coordinates))

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.column(0).to_numpy(zero_copy_only=False)
            (code, size), (count, _) = _flat(part.column(1), "<u8"), _flat(part.column(2), "<u4")
            lists = part.column(3)
            docs = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy(zero_copy_only=False))
            queries = lists.flatten().to_numpy(zero_copy_only=False)
            scores = block.scores(n, block.matched(code, count, size), docs, queries)
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(scores)], ["query", "score"])

    scored = index.join(seeds, "row").select("n", "codes", "counts", "queries").mapInArrow(
        score, "query long, score long").where("score > 0")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
    last = scored.withColumn("place", place).where(F.col("place") == how.places)
    least = np.ones(block.n, dtype=np.int64)
    for r in last.collect():
        least[r["query"]] = r["score"]
    return least


def best_documents(index: DataFrame, block: Block, least: np.ndarray, how: Search, coordinates: int) -> DataFrame:
    """(query, rank, doc_id, score) of the best documents; ``least`` has a score per query that the last place reaches."""

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(least, how.places)
        kept: list[tuple[np.ndarray, ...]] = []
        for part in parts:
            n = part.column(1).to_numpy(zero_copy_only=False)
            (coordinate, held), (peak, _) = _flat(part.column(2), "<u2"), _flat(part.column(3), "u1")
            docs, queries, bounds = [], [], []
            for some, matrix in block.bounds(n, coordinate, peak, held, coordinates):
                d, q = np.nonzero(matrix >= best.least)
                docs.append(d + some.start)
                queries.append(q)
                bounds.append(matrix[d, q])
            docs, queries, bounds = (np.concatenate(x) if x else np.zeros(0, int) for x in (docs, queries, bounds))
            chosen, docs = np.unique(docs, return_inverse=True)
            few = part.take(pa.array(chosen))
            (code, size), (count, _) = _flat(few.column(4), "<u8"), _flat(few.column(5), "<u4")
            matched, lengths, own = block.matched(code, count, size), n[chosen], few.column(0)
            own, absent = own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False)
            # By descending bound: the first pairs of each query, then those that still reach its last place.
            order = np.lexsort((-bounds, queries))
            docs, queries, bounds = docs[order], queries[order], bounds[order]
            while len(docs):
                turn = np.arange(len(docs)) - np.searchsorted(queries, queries)
                now = turn < how.round_pairs
                scores = block.scores(lengths, matched, docs[now], queries[now])
                good = scores >= best.least[queries[now]]
                hits, places = queries[now][good], docs[now][good]
                best.add(hits, scores[good])
                kept.append((hits, scores[good], own[places], absent[places]))
                rest = ~now & (bounds >= best.least[queries])
                docs, queries, bounds = docs[rest], queries[rest], bounds[rest]
            if sum(len(k[0]) for k in kept) > 1 << 16:
                kept = [_first(kept, how.places)]
        if kept:
            query, score, key, absent = _first(kept, how.places)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int64()), pa.array(key, pa.int64(), mask=absent), pa.array(score, pa.int64())],
                ["query", "doc_id", "score"])

    found = index.select("doc_id", "n", "coordinates", "peaks", "codes", "counts").mapInArrow(
        search, "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.places)


def _first(kept: list[tuple[np.ndarray, ...]], places: int) -> tuple[np.ndarray, ...]:
    """The first ``places`` of each query, by descending score and ascending key."""
    query, score, key, absent = (np.concatenate(x) for x in zip(*kept))
    order = np.lexsort((key, absent, -score, query))
    query = query[order]
    some = order[np.arange(len(query)) - np.searchsorted(query, query) < places]
    return tuple(np.concatenate(x)[some] for x in zip(*kept))


def blocks_of(queries: DataFrame, key: str, text: str, how: Search) -> Iterator[list]:
    """Rows of the query table, some at a time, by number and size of texts."""
    rows, size = [], 0
    for row in queries.select(F.col(key).alias("key"), F.col(text).alias("text")).toLocalIterator():
        rows.append(row)
        size += len(row.text or "")
        if len(rows) == how.queries or size >= 8 * how.query_terms:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def search(
    index: DataFrame, queries: DataFrame, key: str = "item_id", text: str = "text", how: Search = Search(),
    coordinates: int = COORDINATES,
) -> DataFrame:
    """(key, rank, doc_id, score): the ``how.places`` best documents of each query with a score above 0.

    Equal scores rank by ascending doc_id, a null doc_id last.  Every row of
    ``queries`` is a query of its own, also with a null or repeated key; one
    without terms, or without a match, has no rows.  Queries go through the
    index in blocks of bounded size; the results of each block are written.
    Terms are compared by 64-bit codes.  ``coordinates`` is that of the index.
    """
    spark: SparkSession = index.sparkSession
    prepare_workers(index)
    size = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    path, kind = new_path(spark, "found"), queries.select(key).schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for rows in blocks_of(queries, key, text, how) if size["docs"] else ():
        block = Block([r.text for r in rows])
        block.weigh(document_counts(index, block.vocabulary), size["docs"], size["terms"])
        found = best_documents(index, block, thresholds(index, block, how, coordinates), how, coordinates)
        keys = spark.createDataFrame([(n, r.key) for n, r in enumerate(rows)], f"_query long, `{key}` {kind}")
        found.join(F.broadcast(keys), F.col("query") == F.col("_query")).select(
            key, "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def lexical_search(docs: DataFrame, queries: DataFrame, how: Search = Search()) -> DataFrame:
    """``build_index`` and ``search`` in one, for tables with the columns (doc_id, text) and (item_id, text)."""
    return search(build_index(docs), queries, how=how)
