"""Length-delimited binary record files with masked checksums and an offset index.

A frame is: length of the data (8 bytes), masked CRC-32C of those 8 bytes
(4 bytes), the data, masked CRC-32C of the data (4 bytes), all little-endian.
The data of one document is a flag byte (1: the key is null, 2: ids take four
bytes instead of two), the key (8 bytes) and the ids.  The index, a Parquet
table beside the files, has one row per record with its file and offset, so
that a reader can fetch records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tribunal.llm.common import prepare_workers, qualified, slices, store_of, text_bytes, total, written
from tribunal.llm.tokens import encoder
from tribunal.session import new_path

_INDEX = "file string, file_bytes long, first_key long, first_row long, key long, offset long, data_bytes long, n_tokens long"
_READ = "file string, doc_id long, place long, before long, n_tokens long, ids_crc32 long"

# Fixed values of CRC-32C and of the mask used by this record format.
_POLYNOMIAL = 0x82F63B78
_MASK = 0xA282EAD8
_BLOCK = 1024
#: Bytes of text encoded at once.
TEXT_SLICE = 4 << 20


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _distance_tables(byte_table: np.ndarray) -> np.ndarray:
    """Row d: what a byte adds to the checksum when d bytes follow it in the block."""
    out = np.empty((_BLOCK, 256), dtype=np.uint32)
    out[0] = byte_table
    for d in range(1, _BLOCK):
        out[d] = (out[d - 1] >> 8) ^ byte_table[out[d - 1] & 0xFF]
    return out


_BY_DISTANCE = _distance_tables(_byte_table())
_BY_BYTE = _BY_DISTANCE[0].tolist()
_FALLING = np.arange(_BLOCK - 1, -1, -1)


def crc32c(data: bytes) -> int:
    """CRC-32C; the checksum is linear, so a block is the xor of its bytes' shares."""
    if len(data) < 64:
        state = 0xFFFFFFFF
        for b in data:
            state = (state >> 8) ^ _BY_BYTE[(state ^ b) & 0xFF]
        return state ^ 0xFFFFFFFF
    raw = np.frombuffer(data, dtype=np.uint8)
    pad = -len(raw) % _BLOCK
    padded = np.concatenate([np.zeros(pad, np.uint8), raw])        # leading zeros change nothing
    padded[pad:pad + 4] ^= 0xFF                                     # the all-ones start value
    shares = _BY_DISTANCE[_FALLING, padded.reshape(-1, _BLOCK)]
    state = 0
    for block in np.bitwise_xor.reduce(shares, axis=1).tolist():
        if state:
            carried = 0
            for k in range(4):
                carried ^= int(_BY_DISTANCE[_BLOCK - 1 - k][(state >> (8 * k)) & 0xFF])
            state = carried
        state ^= block
    return state ^ 0xFFFFFFFF


def masked(checksum: int) -> int:
    """Rotate and add, so that checksums of data that hold checksums stay good."""
    return (((checksum >> 15) | (checksum << 17)) + _MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked(crc32c(length))), data, struct.pack("<I", masked(crc32c(data)))))


def read_frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of every frame; a wrong checksum or a cut-off frame is an error."""
    offset = 0
    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError(f"frame at {offset} is cut off")
        yield offset, (data := _body(stream, head, offset))
        offset += 16 + len(data)


def _body(stream, head: bytes, offset: int) -> bytes:
    length, check = struct.unpack("<QI", head)
    if check != masked(crc32c(head[:8])):
        raise ValueError(f"length of the frame at {offset} fails its checksum")
    rest = stream.read(length + 4)
    if len(rest) < length + 4:
        raise ValueError(f"frame at {offset} is cut off")
    data = rest[:length]
    if struct.unpack("<I", rest[length:])[0] != masked(crc32c(data)):
        raise ValueError(f"data of the frame at {offset} fails its checksum")
    return data


def serialize(key: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
    flags = (key is None) | (2 if wide else 0)
    return struct.pack("<Bq", flags, key or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def deserialize(data: bytes) -> tuple[int | None, np.ndarray]:
    flags, key = struct.unpack_from("<Bq", data)
    ids = np.frombuffer(data, dtype="<u4" if flags & 2 else "<u2", offset=9).astype("<u4")
    return (None if flags & 1 else key), ids


@dataclass
class RecordFiles:
    """Where the files are and what is in them; ``index`` lists only files of finished tasks."""

    folder: str
    index: DataFrame


def write_records(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1,
    file_bytes: int = 64 << 20, folder: str | None = None,
) -> RecordFiles:
    """Encode every document and write its ids with ``end_id`` in ascending key order.

    Null text counts as empty; a null key comes first; rows with equal keys all
    stay, in the order they were read.  Tasks get one key range each, cut also
    inside a key that many rows share, and write a file under a name of their
    own attempt.  The index is written by Spark, so files of lost or repeated
    attempts are never listed.  An empty table gives an empty index and no
    files.  Other columns are not read.
    """
    prepare_workers(docs)
    spark = docs.sparkSession
    folder = qualified(spark, folder or new_path(spark, "records"))
    rows = docs.select(F.col(key).cast("long").alias("_llm_key"), F.col(text).alias("_llm_text"))
    n_files = max(1, -(-total(rows, F.octet_length("_llm_text") + F.lit(4)) // file_bytes))
    n_files = max(n_files, spark.sparkContext.defaultParallelism)
    placed = rows.withColumn("_llm_row", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(n_files, "_llm_key", "_llm_row").sortWithinPartitions("_llm_key", "_llm_row")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        enc = encoder(tokenizer)
        store, base = store_of(folder)
        out, path, sink, at, first = [], None, None, 0, None
        for part in parts:
            keys, numbers = part.column(0).to_pylist(), part.column(2).to_pylist()
            _, starts, ends = text_bytes(part.column(1))
            for i, j in slices(starts, ends, TEXT_SLICE):
                ids, counts = enc.ids_with_end(part.column(1).slice(i, j - i), end_id)
                for doc, row, own in zip(keys[i:j], numbers[i:j], np.split(ids, np.cumsum(counts)[:-1])):
                    if sink is None:
                        path, first = f"{uuid.uuid4().hex}.records", (doc, row)
                        store.create_dir(base, recursive=True)
                        sink = store.open_output_stream(f"{base}/{path}")
                    data = serialize(doc, own)
                    sink.write(frame(data))
                    out.append((path, None, *first, doc, at, len(data), len(own)))
                    at += len(data) + 16
                if len(out) >= 10_000:
                    yield _index_batch(out)
                    out = []
        if sink is not None:
            sink.close()
            out.append((path, at, *first, None, None, None, None))
            yield _index_batch(out)

    listed = f"{folder}-index"
    placed.mapInArrow(write, _INDEX).write.parquet(listed)
    return RecordFiles(folder, spark.read.schema(_INDEX).parquet(listed))


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), *[pa.int64()] * 7)
    titles = ("file", "file_bytes", "first_key", "first_row", "key", "offset", "data_bytes", "n_tokens")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], titles)


def read_records(spark: SparkSession, files: RecordFiles) -> DataFrame:
    """Read every listed file from start to end, checking each frame.

    One row per record: file, doc_id, place in the file, ids before it in the
    file, number of ids and the CRC-32 of the ids as unsigned 32-bit integers.
    """
    folder = files.folder
    closed = files.index.where("file_bytes is not null").select("file", "file_bytes")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        kinds = (pa.string(), *[pa.int64()] * 5)
        titles = ("file", "doc_id", "place", "before", "n_tokens", "ids_crc32")
        for part in parts:
            for path, size in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                out, before, place, seen = [], 0, 0, 0
                with store.open_input_stream(f"{base}/{path}", buffer_size=1 << 20) as stream:
                    for offset, data in read_frames(stream):
                        doc, ids = deserialize(data)
                        out.append((path, doc, place, before, len(ids), zlib.crc32(ids.tobytes())))
                        before, place, seen = before + len(ids), place + 1, offset + 16 + len(data)
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], titles)
                            out = []
                if seen != size:
                    raise ValueError(f"{path} has {seen} bytes instead of {size}")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], titles)

    n = max(1, spark.sparkContext.defaultParallelism)
    return closed.repartition(n, F.xxhash64("file")).mapInArrow(read, _READ)


def with_starts(records: DataFrame, files: RecordFiles) -> DataFrame:
    """Add ``start``: ids of all documents before each one, over all files in key order.

    The files are read once.  Only one row per file is summed up in order; these
    sums and the records are tables, so a join knows which one is small.
    """
    records = written(records, "read")
    first = files.index.where("file_bytes is not null").select(F.col("file").alias("_file"), "first_key", "first_row")
    sizes = records.groupBy("file").agg(F.sum("n_tokens").alias("_ids")).join(first, F.col("file") == F.col("_file"))
    before = Window.orderBy(F.col("first_key").asc_nulls_first(), "first_row").rowsBetween(
        Window.unboundedPreceding, -1)
    bases = written(sizes.select("_file", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base")), "bases")
    return (
        records.join(bases, F.col("file") == F.col("_file"))
        .withColumn("start", F.col("_base") + F.col("before")).drop("_base", "_file")
    )


def read_record(folder: str, file: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its index row: the access of a shuffled reader."""
    store, base = store_of(folder)
    with store.open_input_file(f"{base}/{file}") as stream:
        stream.seek(offset)
        return deserialize(_body(stream, stream.read(12), offset))
