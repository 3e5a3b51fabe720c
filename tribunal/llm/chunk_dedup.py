"""Substring deduplication: passages of over 50 words that an earlier document has go, exactly.

Texts are cut into chunks by their content: a gear hash rolls over the words, and
a chunk starts at each word whose hash is the smallest of some stretch of
neighbouring ones.  The rule looks at no more than the words around, so chunks
resist insertions, and a passage of over 50 words always holds a whole chunk,
cut alike wherever the passage stands.  Chunks are deduplicated by digest; around
chunks that two documents have, the windows of 51 words that meet the same
chunk first make a run, compared by a digest of all its words.  Only where a
chunk has unlike runs, as at the ends of a passage, the windows of each run's
first holder are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tribunal.llm.common import Words, join_counted, mixed, prepare_workers, slices, text_bytes, written

_SLICE = 4 << 20
_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


@dataclass(frozen=True)
class Passages:
    """A passage goes if it is longer than ``longer_than`` words.

    Chunks start at the smallest gear hash, over ``gear`` words, of some
    ``stretch`` neighbouring ones, so they have at most ``stretch`` words.  A
    chunk's digest covers ``reach`` words from its start, and its length, so that
    short chunks of everyday words are not alike by chance.
    """

    longer_than: int = 50
    gear: int = 4
    stretch: int = 12
    reach: int = 24

    def __post_init__(self):
        hashes = self.window - self.gear + 1
        if hashes < 4 * self.stretch - 2 or not self.stretch <= self.reach <= self.window - 2 * self.stretch + 2:
            raise ValueError("A passage would not always hold a whole chunk.")

    @property
    def window(self) -> int:
        return self.longer_than + 1


def word_gear(code: np.ndarray, n: int) -> np.ndarray:
    """Gear hash of the ``n`` words from each word on (fewer at the end): sum of code << (64 / n x distance)."""
    h, span, shift = code, 1, 64 // n
    while span < n:
        step = min(span, n - span)
        later = np.zeros_like(h)
        later[:-step] = h[step:]
        # After a step that does not double, both parts overlap: still a hash of the same words.
        h = h + (later << np.uint64(shift * step))
        span += step
    return mixed(h)


def smallest_of(values: np.ndarray, n: int) -> np.ndarray:
    """Smallest of the ``n`` values from each value on, where there are as many."""
    out, span = values, 1
    while span < n:
        step = min(span, n - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def chunk_starts(words: Words, passages: Passages) -> np.ndarray:
    """Words at which a chunk starts, of all rows."""
    size, n = passages.stretch, len(words.code)
    if n < size:
        return np.zeros(0, dtype=np.int64)
    hashes = word_gear(words.code, passages.gear)
    row_end = np.repeat(words.first[1:], np.diff(words.first))
    least = np.zeros(n, dtype=np.uint64)
    least[:n - size + 1] = smallest_of(hashes, size)
    # A stretch counts only if all its hashes lie inside one row.
    least[np.arange(n) + size + passages.gear - 2 >= row_end] = 0
    highest = ~smallest_of(~np.append(np.zeros(size - 1, dtype=np.uint64), least), size)
    return np.flatnonzero((hashes == highest) & (hashes > 0))


def chunk_runs(words: Words, passages: Passages):
    """Runs of the windows that meet one chunk first: row, digest of the chunk, first window in its row, number of windows.

    A window meets a chunk first if none starts between its own first
    ``stretch`` - 1 words and the chunk; before these, starts may depend on words
    outside the window.
    """
    size, margin = passages.window, passages.stretch - 1
    cuts = chunk_starts(words, passages)
    empty = np.zeros(0, dtype=np.int64)
    if len(cuts) < 2:
        return empty, empty, empty, empty
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[cuts]
    begin, end = words.first[row], words.first[row + 1]
    same = row[1:] == row[:-1]
    low = np.maximum(begin, np.append(0, np.where(same, cuts[:-1] - margin + 1, 0)))
    high = np.minimum(cuts - margin, end - size)
    length = np.append(np.where(same, np.diff(cuts), 0), 0)
    some = np.flatnonzero((low <= high) & (length > 0))
    reach = run_digests(words.code, cuts[some], np.full(len(some), passages.reach))
    chunk = mixed(reach.astype(np.uint64) + length[some].astype(np.uint64)).astype(np.int64)
    return row[some], chunk, (low - begin)[some], (high - low + 1)[some]


def run_digests(code: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Digests of ``n`` words from the words ``first`` on."""
    weights = np.full(len(code) + 1, _STEP, dtype=np.uint64)
    weights[0] = 1
    np.multiply.accumulate(weights, out=weights)
    sums = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(code * weights[:-1], out=sums[1:])
    back = np.full(len(code) + 1, _BACK, dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mixed((sums[first + n] - sums[first]) * back[first] + n.astype(np.uint64)).astype(np.int64)


def spans_of(words: Words, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray):
    """Start and stop byte of ``n`` words of a row from its word ``at`` on, up to the next word.

    At the start or end of a text the white space there belongs to them, too.
    """
    first = words.first[row] + at
    begin = np.where(at == 0, 0, words.start[first] - starts[row])
    last = first + n == words.first[1:][row]
    return begin, np.where(last, (ends - starts)[row], np.append(words.start, 0)[first + n] - starts[row])


def chunks_of(docs: DataFrame, passages: Passages) -> DataFrame:
    """Chunks of ``docs`` (_key, _mark, _text): digest and doc_id."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = part.column(0).to_numpy(zero_copy_only=False)
            raw, starts, ends = text_bytes(part.column(2))
            for i, j in slices(starts, ends, _SLICE):
                row, chunk, *_ = chunk_runs(Words(raw, starts[i:j], ends[i:j], lower=False), passages)
                for k in range(0, len(row), 50_000):
                    s = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(chunk[s]), pa.array(keys[i:j][row[s]], pa.int64())], ["chunk", "doc_id"])

    return docs.mapInArrow(cut, "chunk long, doc_id long")


def runs_of(docs: DataFrame, passages: Passages) -> DataFrame:
    """Runs of ``docs`` (_key, _mark, _text): chunk, digest, doc_id, mark, first window, windows, start and stop byte."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, marks = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            raw, starts, ends = text_bytes(part.column(2))
            for i, j in slices(starts, ends, _SLICE):
                words = Words(raw, starts[i:j], ends[i:j], lower=False)
                row, chunk, at, n = chunk_runs(words, passages)
                n_words = n + passages.window - 1
                digest = run_digests(words.code, words.first[row] + at, n_words)
                begin, stop = spans_of(words, starts[i:j], ends[i:j], row, at, n_words)
                ids, texts = keys[i:j][row], marks[i:j][row]
                for k in range(0, len(row), 50_000):
                    s = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[s], pa.int64()) for c in (chunk, digest, ids, texts)]
                        + [pa.array(c[s], pa.int32()) for c in (at, n, begin, stop)],
                        ["chunk", "run", "doc_id", "mark", "at", "n", "start", "stop"])

    return docs.mapInArrow(
        cut, "chunk long, run long, doc_id long, mark long, at int, n int, start int, stop int")


def windows_of(docs: DataFrame, passages: Passages) -> DataFrame:
    """Windows of ``docs`` (_key, _mark, _text, _runs): digest, doc_id, mark, first word, start and stop byte."""
    size = passages.window

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, marks = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            raw, starts, ends = text_bytes(part.column(2))
            runs = part.column(3)
            for i, j in slices(starts, ends, _SLICE):
                words = Words(raw, starts[i:j], ends[i:j], lower=False)
                own = runs.slice(i, j - i)
                flat = own.flatten()
                row = np.repeat(np.arange(j - i), own.value_lengths().to_numpy(zero_copy_only=False))
                at, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                row, at = np.repeat(row, n), np.repeat(at, n) + place
                sizes = np.full(len(row), size)
                digest = run_digests(words.code, words.first[row] + at, sizes)
                begin, stop = spans_of(words, starts[i:j], ends[i:j], row, at, sizes)
                ids, texts = keys[i:j][row], marks[i:j][row]
                for k in range(0, len(row), 50_000):
                    s = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(digest[s], pa.int64()), pa.array(ids[s], pa.int64()),
                         pa.array(texts[s], pa.int64()), pa.array(at[s], pa.int32()),
                         pa.array(begin[s], pa.int32()), pa.array(stop[s], pa.int32())],
                        ["digest", "doc_id", "mark", "at", "start", "stop"])

    return docs.mapInArrow(cut, "digest long, doc_id long, mark long, at int, start int, stop int")


def holders(rows: DataFrame, digest: str) -> DataFrame:
    """(digest, first, last, rows): the documents between which each digest is found, if there are two at least."""
    return rows.groupBy(digest).agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows")).where("first <> last")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Windows that a document with a smaller key has too, as runs of one window."""
    seen = written(holders(windows, "digest"), "seen")
    later = join_counted(windows, seen, "digest", ["first"], ["doc_id", "at"]).where("doc_id <> first")
    return later.select("doc_id", "mark", "at", F.lit(1).alias("n"), "start", "stop")


def spans_from(repeated: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, spans): unions of repeated runs of windows, as byte ranges."""
    order = Window.partitionBy("doc_id", "mark").orderBy("at")
    ahead = F.lag(F.col("at") + F.col("n")).over(order) - 1 + size
    runs = (
        repeated.distinct().withColumn("break", F.when(F.col("at") <= ahead, 0).otherwise(1))
        .withColumn("group", F.sum("break").over(order))
        .groupBy("doc_id", "mark", "group")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"),
             (F.max(F.col("at") + F.col("n")) - 1 + size - F.min("at")).alias("words"))
    )
    return runs.groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"), F.sum("words").alias("removed_words"))


def without_spans(text, spans):
    """``text`` without the byte ranges ``spans``, which start and end at words."""
    body = text.cast("binary")
    return F.aggregate(
        spans, F.struct(F.lit(b"").alias("kept"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["kept"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"])).alias("kept"),
            s["stop"].alias("at")),
        lambda acc: F.concat(acc["kept"], F.substring(body, acc["at"] + 1, F.octet_length(body)))).cast("string")


def substring_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", passages: Passages = Passages()
) -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` freed of repeated passages, and two columns more.

    Every common run of more than ``passages.longer_than`` words with one
    document of a smaller key goes whole, nothing else does.  Words are
    compared, white space between them is not.  ``llm_removed_words`` counts
    removed words, ``llm_spans`` holds the removed byte ranges of the old text
    (null: none); columns of these names are replaced.  A passage stays where
    the smallest key has it and inside one document may repeat.  Rows with a
    null key, null text or no words come back as they are; rows that repeat a
    key are one document, each cleaned by its own text where these differ.  An
    empty table gives no rows.
    """
    prepare_workers(docs)
    own = docs.drop("llm_removed_words", "llm_spans", "llm_doc", "llm_mark")
    text_key, mark = F.col(key).cast("long"), F.xxhash64(text)
    texts = own.select(text_key.alias("_key"), mark.alias("_mark"), F.col(text).alias("_text")).where("_key is not null")
    shared = written(holders(chunks_of(texts, passages), "chunk"), "chunks")
    runs = written(join_counted(runs_of(texts, passages), shared, "chunk", [], ["doc_id", "mark", "at"]), "runs")
    seen = written(runs.groupBy("chunk", "run").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "seen")
    held = written(join_counted(runs, seen.drop("chunk"), "run", ["first"], ["doc_id", "at"]), "held")
    # A run's later holders lose it whole; its first holder may share windows with the chunk's unlike runs.
    whole = held.where("doc_id <> first").select("doc_id", "mark", "at", "n", "start", "stop")
    mixed_chunks = written(seen.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "mixed")
    unlike = join_counted(held.where("doc_id = first"), mixed_chunks, "chunk", [], ["doc_id", "at"]).groupBy("doc_id", "mark").agg(
        F.collect_set(F.struct("at", "n")).alias("_runs"))
    candidates = texts.join(unlike, (F.col("_key") == F.col("doc_id")) & (F.col("_mark") == F.col("mark")))
    windows = written(windows_of(candidates.select("_key", "_mark", "_text", "_runs"), passages), "windows")
    repeated = whole.unionByName(repeated_windows(windows))
    spans = written(spans_from(repeated, passages.window).select(
        F.col("doc_id").alias("llm_doc"), F.col("mark").alias("llm_mark"), F.col("spans").alias("llm_spans"),
        F.col("removed_words").alias("llm_removed_words")), "spans")
    joined = own.join(spans, (text_key == F.col("llm_doc")) & (mark == F.col("llm_mark")), "left")
    cleaned = F.when(F.col("llm_spans").isNull(), F.col(text)).otherwise(without_spans(F.col(text), F.col("llm_spans")))
    return joined.withColumn(text, cleaned).withColumn(
        "llm_removed_words", F.coalesce("llm_removed_words", F.lit(0)).cast("long")).drop("llm_doc", "llm_mark")
