import gzip
import hashlib
import random

import pytest
from compare import database, differences
from pyspark.sql import functions as F

from tribunal.llm import queries as Q
from tribunal.llm.oracle import ORACLE
from tribunal.llm.warc import chunk_table, read_archives, records, write_archives

BIG = random.Random(1).randbytes(40_000).hex() * 5
ROWS = [(1, "http://a/ x\n", "x" * 150), (2, "http://b", "x" * 150), (None, "http://c", "x" * 150), (4, None, None),
        (5, "u", ""), (6, "u", "é" * 49), (7, "u", "é" * 49), (8, "u", "é" * 50), (9, "u", "é" * 50), (9, "u", "é" * 50),
        (10, "u", BIG), (11, "u", "a\r\n\r\nWARC/1.1\r\n"), (None, "n", "q" * 200), (None, "n", "q" * 200)]


def pages(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for c in ("digest", "keeper", "n_bytes", "chunk", "body", "record_type"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def expected(rows):
    keeper = {}
    for key, _, html in rows:
        if len((html or "").encode()) >= 100 and key is not None:
            keeper[html] = min(key, keeper.get(html, key))
    out = []
    for key, _, html in rows:
        raw = (html or "").encode()
        first = keeper.get(html)
        refers = first if first is not None and first != key else None
        out.append((key, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_awkward_pages(spark):
    archives = write_archives(chunk_table(pages(spark), chunk_bytes=1000))
    got = records(read_archives(spark, archives, chunk_bytes=777)).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)
    none = write_archives(chunk_table(pages(spark).where("1 = 0")))
    assert records(read_archives(spark, none)).count() == 0


def test_chunks_carry_digests_and_join_to_the_payload(spark):
    archives = write_archives(chunk_table(pages(spark), chunk_bytes=1000))
    chunks = read_archives(spark, archives, chunk_bytes=4096).where("record_id = '<urn:page:10>'").orderBy("chunk_no")
    rows = chunks.collect()
    digest, payload = hashlib.sha256(), b""
    for i, r in enumerate(rows):
        digest.update(r.chunk)
        payload += r.chunk
        assert (r.chunk_no, r.digest_so_far, r.bytes_so_far) == (i, digest.hexdigest(), len(payload))
        assert len(r.chunk) <= 4096 and r["last"] == (i == len(rows) - 1)
    assert payload.decode() == BIG


def test_files_roll_and_are_plain_gzip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", random.Random(i).randbytes(500).hex()) for i in range(60)]
    archives = write_archives(chunk_table(pages(spark, rows)), file_bytes=4000, folder=str(tmp_path / "w"))
    listed = archives.manifest.collect()
    assert sum(f.records for f in listed) == 60 and len(listed) > 3
    for f in listed:
        raw = (tmp_path / "w" / f.file).read_bytes()
        assert len(raw) == f.bytes and gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_damage_is_noticed(spark, tmp_path):
    archives = write_archives(chunk_table(pages(spark)), folder=str(tmp_path / "w"))
    path = max((tmp_path / "w" / f.file for f in archives.manifest.collect()), key=lambda p: p.stat().st_size)
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(Exception, match="ends inside|gzip|Error"):
        records(read_archives(spark, archives)).count()


def test_query(spark, folder):
    assert differences(Q.op4_chunked_warc(spark, folder), database(folder), ORACLE["op4_chunked_warc"]) == []
