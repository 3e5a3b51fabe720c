"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tribunal.llm.common import ROWS_OUT, binaries, prepare_workers, slices, text_bytes, total
from tribunal.llm.tokens import encoder
from tribunal.operators.ordering import earlier_sums

_PIECES = "_llm_doc long, _llm_start long, _llm_length int, _llm_tokens long, _llm_ids binary"
_PIECE_TITLES = ["_llm_doc", "_llm_start", "_llm_length", "_llm_tokens", "_llm_ids", "_llm_before"]
_PACKED = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
           "cost double, ids binary")


#: Bytes of text encoded at once.
TEXT_SLICE = 4 << 20
#: Buckets of the order that one task sums up at once.
BUCKETS_PER_RUN = 4_096


def row_bytes(text: str) -> Column:
    """About what one row's pieces take in a group: its text and a constant, which a row without text takes too."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(64)).cast("long")


def slices_of(rows: DataFrame, slice_bytes: int) -> DataFrame:
    """``rows`` with ``_llm_before``: about how many bytes lie before a row in the order of ``_llm_position``.

    Neighbouring positions make a bucket, of about an eighth of a slice; all
    rows of a bucket get its start.
    """
    size = rows.agg(F.sum("_llm_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    width = max(16, (slice_bytes // 8) * size["rows"] // (size["bytes"] or 1))
    bucketed = rows.withColumn("_llm_bucket", F.floor(F.col("_llm_position") / F.lit(width)))
    sums = bucketed.groupBy("_llm_bucket").agg(F.sum("_llm_bytes").alias("_llm_sum"))
    starts = earlier_sums(sums, [], "_llm_bucket", F.floor(F.col("_llm_bucket") / F.lit(BUCKETS_PER_RUN)), "_llm_sum")
    return bucketed.join(starts, "_llm_bucket").withColumnRenamed("_offset", "_llm_before")


def piece_cost(length: np.ndarray, linear: float, quadratic: float) -> np.ndarray:
    """Estimated work of one piece: per-token work plus attention inside the piece."""
    return linear * length + quadratic * np.square(length, dtype=np.float64)


def pack_group(
    lengths: np.ndarray, capacity: int, linear: float, quadratic: float
) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Place pieces, longest (so dearest) first, each into the cheapest sequence with room.

    Returns placements (piece, from, length, sequence, offset) and the number
    of sequences, the fewest that hold all tokens.  A piece that fits into no
    single sequence is cut over those with the most room.
    """
    n_open = -(-int(lengths.sum()) // capacity)
    room, cost = np.full(n_open, capacity, dtype=np.int64), np.zeros(n_open)
    placed = []
    for i in np.argsort(-lengths, kind="stable"):
        length, done = int(lengths[i]), 0
        while done < length:
            rest = length - done
            fits = room >= rest
            if fits.any():
                k, take = int(np.argmin(np.where(fits, cost, np.inf))), rest
            else:
                k = int(np.argmax(room))
                take = int(room[k])
            placed.append((int(i), done, take, k, capacity - int(room[k])))
            room[k] -= take
            cost[k] += piece_cost(np.array(take), linear, quadratic)
            done += take
    return placed, n_open


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 1024,
    end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, group_bytes: int = 16 << 20,
    order: str | None = None, size: str | None = None, slice_bytes: int = 1 << 20,
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    A document is its token ids and ``end_id``; null text counts as empty, so
    every row, repeated or with a null key too, gives at least one id.  Each
    document is cut into pieces of ``capacity`` ids and a shorter rest.  Pieces
    are dealt evenly over groups that hold about ``group_bytes`` of text; a
    group's sequences are filled by descending cost, always the cheapest one
    with room.  A long document's pieces and repeated rows spread over many
    groups.  One row per piece comes back, with its ids as little-endian
    unsigned 32-bit integers; other columns of ``docs`` are not read.  An empty
    table gives no rows.

    With ``order``, a column of numbers from 0, a group is a slice of that order
    instead, of about ``slice_bytes``: sequence ids of earlier slices are
    smaller, and inside a slice sequences are numbered at random, so any run of
    sequences holds what the order has there.  ``size`` may name a column with
    ``row_bytes`` of the text.
    """
    prepare_workers(docs)
    rows = docs.select(F.col(key).cast("long").alias("_llm_key"), F.col(text).alias("_llm_text"), *([] if not order else [
        F.col(order).cast("long").alias("_llm_position"), (F.col(size) if size else row_bytes(text)).alias("_llm_bytes")]))
    if order:
        rows = slices_of(rows, slice_bytes).select("_llm_key", "_llm_text", "_llm_before", "_llm_bytes")
        schema = _PIECES + ", _llm_before long"
    else:
        n_groups = max(1, -(-total(rows, row_bytes("_llm_text")) // group_bytes))
        schema = _PIECES

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = np.dtype("<u2" if max(enc.vocabulary, end_id) < 1 << 16 else "<u4")
        for part in parts:
            _, starts, ends = text_bytes(part.column(1))
            for i, j in slices(starts, ends, TEXT_SLICE):
                some = part.slice(i, j - i)
                ids, counts = enc.ids_with_end(some.column(1), end_id)
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(j - i), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(counts[row] - start, capacity)
                columns = [some.column(0).take(pa.array(row)), pa.array(start), pa.array(length, pa.int32()),
                           pa.array(counts[row]), binaries(ids.astype(kind), length)]
                if order:
                    before, width = (some.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
                    columns.append(pa.array(before[row] + width[row] * start // counts[row]))
                batch = pa.RecordBatch.from_arrays(columns, _PIECE_TITLES[:len(columns)])
                for k in range(0, len(row), ROWS_OUT):
                    yield batch.slice(k, ROWS_OUT)

    def fill(group: pa.Table) -> pa.Table:
        ranks = np.lexsort((
            np.array(group["_llm_start"]), np.array(group["_llm_doc"].fill_null(0)),
            np.array(group["_llm_doc"].is_null()), np.array(group["_llm_tokens"])))
        group = group.take(pa.array(ranks))
        number = group["_llm_group"][0].as_py()
        lengths = group["_llm_length"].to_numpy().astype(np.int64)
        docs_, starts, tokens = (group[c].to_pylist() for c in ("_llm_doc", "_llm_start", "_llm_tokens"))
        ids = group["_llm_ids"].to_pylist()
        placed, n_open = pack_group(lengths, capacity, linear, quadratic)
        renamed = np.random.default_rng(number).permutation(n_open).tolist() if order else range(n_open)
        out = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "cost", "ids")}
        for i, begin, size, sequence, offset in placed:
            width = len(ids[i]) // int(lengths[i])
            piece = np.frombuffer(ids[i], dtype=f"<u{width}")[begin:begin + size].astype("<u4").tobytes()
            row = (docs_[i], starts[i] + begin, size, tokens[i], (number << 32) + renamed[sequence], offset,
                   float(piece_cost(np.array(size), linear, quadratic)), piece)
            for column, value in zip(out.values(), row):
                column.append(value)
        kinds = (*[pa.int64()] * 6, pa.float64(), pa.binary())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    if order:
        group = F.floor(F.col("_llm_before") / F.lit(slice_bytes))
    else:
        group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups))
    pieces = rows.mapInArrow(cut, schema).withColumn("_llm_group", group).drop("_llm_before")
    return pieces.groupBy("_llm_group").applyInArrow(fill, _PACKED)
