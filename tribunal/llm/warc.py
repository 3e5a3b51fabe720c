"""WARC archives written from, and read back into, a chunked record table.

A payload travels as rows (record, chunk number, bytes), so neither writer nor
reader holds more of a record than one chunk.  Digests are carried from chunk
to chunk.  Every record is a gzip member of its own.  A task writes files under
names of its own attempt and lists them in a Parquet manifest that Spark
commits, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tribunal.llm.common import prepare_workers, qualified, store_of
from tribunal.session import new_path

_MANIFEST = "file string, bytes long, records long"
_CHUNKS = ("record_id string, record_type string, refers_to string, target_uri string, declared_bytes long, "
           "declared_digest string, chunk_no int, chunk binary, chunk_bytes int, bytes_so_far long, "
           "digest_so_far string, last boolean")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_READ = 1 << 16


@dataclass
class Archives:
    """Folder of the files and the manifest of the finished ones."""

    folder: str
    manifest: DataFrame


def chunk_table(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = 1 << 16,
    least_bytes: int = 100,
) -> DataFrame:
    """Rows (page_id, url, n_bytes, digest, refers_to, n_chunks, chunk_no, chunk) in record order.

    Of records with equal payloads of at least ``least_bytes``, those with the
    smallest key are kept and the others refer to it and carry no payload.
    Null payloads count as empty.  Null keys never are the smallest; if all
    keys of a payload are null, each record keeps its payload.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"),
        F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("digest"))
    large = rows.where(F.col("n_bytes") >= least_bytes)
    keepers = (
        large.groupBy("digest").agg(F.min("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and keeper is not null").select(F.col("digest").alias("_digest"), "keeper")
    )
    named = rows.join(keepers, F.col("digest") == F.col("_digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    named = named.withColumn("refers_to", refers).withColumn("n_chunks", F.when(
        F.col("refers_to").isNull(), F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk_bytes))
    ).otherwise(1).cast("int"))
    # The pieces together are as large as the payload, which stays behind.
    pieces = F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1), lambda i: F.when(
        F.col("refers_to").isNull(), F.substring(F.col("body"), i * chunk_bytes + 1, F.lit(chunk_bytes))
    ).otherwise(F.lit(b"")))
    return named.select("page_id", "url", "n_bytes", "digest", "refers_to", "n_chunks",
                        F.posexplode(pieces).alias("chunk_no", "chunk"))


def record_name(key: int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def record_key(column):
    """Key of a record name, as a column."""
    return F.regexp_extract(column, r"^<urn:page:(-?\d*)>$", 1).try_cast("long")


def header(key, url, n_bytes, digest, refers_to, date: str) -> bytes:
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(key)}",
             f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {record_name(refers_to)}", f"X-Payload-Length: {n_bytes}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else n_bytes}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace")


def write_archives(
    chunks: DataFrame, file_bytes: int = 256 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z",
    folder: str | None = None,
) -> Archives:
    """Write the records of a chunk table; every task rolls to a new file at ``file_bytes``.

    The payload's digest is built up chunk by chunk and held against the one in
    the header; a difference, or a record with missing chunks, is an error.  An
    empty table gives no files.
    """
    prepare_workers(chunks)
    spark = chunks.sparkSession
    folder = qualified(spark, folder or new_path(spark, "warc"))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        sink, path, at, n, files = None, None, 0, 0, []
        member, digest, due = None, None, 0
        for part in parts:
            columns = [part.column(c) for c in range(len(part.schema))]
            for i in range(part.num_rows):
                key, url, n_bytes, declared, refers, n_chunks, number, chunk = (c[i].as_py() for c in columns)
                if number == 0:
                    if sink is not None and at >= file_bytes:
                        sink.close()
                        files.append((path, at, n))
                        sink = None
                    if sink is None:
                        store.create_dir(base, recursive=True)
                        path, at, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        sink = store.open_output_stream(f"{base}/{path}", compression=None)
                    member, digest, due = zlib.compressobj(level, wbits=31), hashlib.sha256(), 0
                    start = header(key, url, n_bytes, declared, refers, date)
                    sink.write(member.compress(start))
                if number != due:
                    raise ValueError(f"record {key}: chunk {number} instead of {due}")
                due += 1
                digest.update(chunk)
                sink.write(member.compress(chunk))
                if number == n_chunks - 1:
                    if refers is None and digest.hexdigest() != declared:
                        raise ValueError(f"record {key}: its payload does not have the digest of its header")
                    sink.write(member.compress(b"\r\n\r\n") + member.flush())
                    at, n = sink.tell(), n + 1
        if sink is not None:
            sink.close()
            files.append((path, at, n))
        if files:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*files), (pa.string(), pa.int64(), pa.int64()))],
                ["file", "bytes", "records"])

    listed = f"{folder}-manifest"
    chunks.mapInArrow(write, _MANIFEST).write.parquet(listed)
    return Archives(folder, spark.read.schema(_MANIFEST).parquet(listed))


def _inflated(stream) -> Iterator[bytes | None]:
    """Unpacked blocks of a file of gzip members; None after each member."""
    member, started = zlib.decompressobj(31), False
    data = stream.read(_READ)
    while data:
        started = True
        block = member.decompress(data, _READ)
        if block:
            yield block
        data = member.unconsumed_tail
        if member.eof:
            yield None
            data, member, started = member.unused_data, zlib.decompressobj(31), False
        if not data:
            data = stream.read(_READ)
    if started:
        raise ValueError("the archive ends inside a record")


def stream_records(stream, chunk_bytes: int) -> Iterator[tuple[dict, int, bytes, bool]]:
    """(header fields, chunk number, chunk, last) over a file, one chunk in memory."""
    blocks = _inflated(stream)
    held, fields, left, number = b"", None, 0, 0
    for block in blocks:
        if block is None:
            if fields is None or left or held != b"\r\n\r\n":
                raise ValueError("a record does not have the length of its header")
            held, fields = b"", None
            continue
        held += block
        if fields is None:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                continue
            lines = held[:end].decode("utf-8").split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            left, number, held = int(fields["Content-Length"]), 0, held[end + 4:]
            if not left:
                yield fields, 0, b"", True
        while left and len(held) >= min(left, chunk_bytes):
            take = min(left, chunk_bytes)
            left -= take
            yield fields, number, held[:take], not left
            number, held = number + 1, held[take:]


def read_archives(
    spark: SparkSession, archives: Archives, chunk_bytes: int = 1 << 16, payload: bool = True
) -> DataFrame:
    """The chunk table of the archives, with the digest of each record up to and with each chunk.

    The last chunk's ``bytes_so_far`` and ``digest_so_far`` are those of the
    whole payload.  Without ``payload`` the chunk bytes stay behind.
    """
    folder = archives.folder
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(),
             pa.int32(), pa.int64(), pa.string(), pa.bool_())
    titles = [x.split()[0] for x in _CHUNKS.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], titles)

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        for part in parts:
            for path in part.column(0).to_pylist():
                rows, digest, n = [], None, 0
                with store.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    for fields, number, chunk, last in stream_records(stream, chunk_bytes):
                        if number == 0:
                            digest, n = hashlib.sha256(), 0
                        digest.update(chunk)
                        n += len(chunk)
                        rows.append((
                            fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"),
                            fields.get("WARC-Target-URI"),
                            int(fields.get("X-Payload-Length", fields["Content-Length"])),
                            fields["WARC-Payload-Digest"].removeprefix("sha256:"), number,
                            chunk if payload else None, len(chunk), n, digest.hexdigest(), last))
                        if len(rows) == (64 if payload else 5_000):
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    n = max(1, spark.sparkContext.defaultParallelism)
    return archives.manifest.select("file").repartition(n, F.xxhash64("file")).mapInArrow(read, _CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    revisit = F.col("record_type") == "revisit"
    return chunks.where("last").select(
        record_key(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type", record_key(F.col("refers_to")).alias("refers_to"))
