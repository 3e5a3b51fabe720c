import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import DOCS, documents, empty
from tokenizers import Tokenizer

from tribunal.llm import queries as Q
from tribunal.llm.common import table
from tribunal.llm.packing import pack, pack_group
from tribunal.llm.records import crc32c, frame, read_record, read_records, with_starts, write_records
from tribunal.llm.sharding import write_shuffled
from tribunal.llm.tokens import encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


LIBRARY = {path: Tokenizer.from_file(path) for path in (BYTE, WORD)}


def ids_of(path, text, end):
    return [*LIBRARY[path].encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_give_the_ids_of_whole_texts(path):
    texts = ["a  b", " a", "a ", "", "a\n b", "a \n b", "don't 's x", "Ça été ́", "tab\tx y", "ß ẞ İ Σς ΟΔΟΣ x",
             "12 345 a1 1a", "x y  z", "a<|endoftext|>b <|endoftext|> c", "\0 a \0b", "end\n", "\x1c q", "日本 語 ok",
             "e\u0301te\u0301 x\u0301\u0323", "Å K ﬁ", "a\u00a0b c\u3000 d", "x \u0301y", "İİ İ. Σ", "👩‍💻 👍🏽!"]
    expected = [ids_of(path, t, 9)[:-1] for t in texts]
    for part in (texts, texts[::-1], [f"{t} {k}{t}" for k in "ab" for t in texts] + texts):
        got = dict(zip(part, encoder(path).encode(part)))
        assert [np.frombuffer(got[t], "<u4").tolist() for t in texts] == expected


def check_pieces(rows, docs, capacity, end):
    expected = Counter()
    for doc, text in docs:
        expected[(doc, tuple(ids_of(BYTE, text, end)))] += 1
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        assert 0 < r.length <= capacity and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    got = Counter()
    for doc, own in pieces.items():
        whole = defaultdict(list)
        for r in own:
            whole[(r.start, r.length)].append(r)
        n = min(len(v) for v in whole.values())
        ids = [i for (_, _), v in sorted(whole.items()) for i in np.frombuffer(v[0].ids, "<u4").tolist()]
        got[(doc, tuple(ids))] += n
    assert got == expected
    return sequences


def test_packing_awkward_documents(spark):
    rows = pack(documents(spark), BYTE, capacity=64).collect()
    check_pieces(rows, [(d[0], d[1]) for d in DOCS], 64, 0)
    assert pack(empty(spark), BYTE).count() == 0


def test_packing_query_has_little_padding(spark, folder):
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    rows = pack(table(spark, folder, "documents"), BYTE).collect()
    sequences = check_pieces(rows, docs, 1024, 0)
    used = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) <= -(-used // 1024) + 1
    found = {(r.doc_id, r.start): r for r in Q.op1_cost_balanced_packing(spark, folder).collect()}
    for r in rows:
        assert found[r.doc_id, r.start].ids_crc32 == zlib.crc32(r.ids)


def test_rows_without_text_spread_over_groups(spark):
    docs = [(n, None, "en", "a", 0) for n in range(3000)]
    rows = pack(documents(spark, docs), BYTE, capacity=64, group_bytes=8 << 10).collect()
    check_pieces(rows, [(d[0], d[1]) for d in docs], 64, 0)
    assert len({r.sequence_id >> 32 for r in rows}) > 10


def test_packing_balances_cost():
    lengths = np.random.default_rng(0).integers(1, 1024, 4000)
    placed, n = pack_group(lengths, 1024, 1.0, 1 / 1024)
    assert n == -(-int(lengths.sum()) // 1024)
    cost = np.zeros(n)
    for _, _, size, k, _ in placed:
        cost[k] += size + size**2 / 1024
    arbitrary = np.array([c.sum() for c in np.array_split(lengths + lengths**2 / 1024, n)])
    assert cost.std() < arbitrary.std()


def test_checksum_and_frame():
    assert crc32c(b"123456789") == 0xE3069283          # the published check value
    data = bytes(range(256)) * 23
    slow = 0xFFFFFFFF
    for b in data:
        slow ^= b
        for _ in range(8):
            slow = (slow >> 1) ^ (0x82F63B78 if slow & 1 else 0)
    assert crc32c(data) == slow ^ 0xFFFFFFFF
    assert len(frame(data)) == len(data) + 16


def expected_records(docs):
    start, out = 0, []
    for doc, text in docs:
        ids = np.array(ids_of(WORD, text, 1), dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_records_awkward_documents(spark):
    files = write_records(documents(spark), WORD, file_bytes=2000)
    got = with_starts(read_records(spark, files), files).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    order = sorted([(d[0], d[1]) for d in DOCS], key=lambda d: (d[0] is not None, d[0] or 0))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected_records(order)
    some = files.index.where("key = 8").first()
    assert read_record(files.folder, some.file, some.offset)[1].tolist() == ids_of(WORD, "ONE\ttwo", 1)
    none = write_records(empty(spark), WORD)
    assert with_starts(read_records(spark, none), none).count() == 0


def test_records_notice_damage(spark, tmp_path):
    files = write_records(documents(spark), WORD, folder=str(tmp_path / "r"))
    file = files.index.first().file
    path = tmp_path / "r" / file
    raw = bytearray(path.read_bytes())
    raw[30] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        read_records(spark, files).count()


def test_records_query(spark, folder):
    docs = [tuple(r) for r in table(spark, folder, "documents").orderBy("doc_id").select("doc_id", "text").collect()]
    got = sorted(map(tuple, Q.op5_record_files(spark, folder).collect()))
    assert got == expected_records(docs)


def test_shards_awkward_documents(spark):
    rows = write_shuffled(documents(spark), n_shards=4, bucket_bytes=4000)
    got = [(r.doc_id, r.text, r.kept) for r in rows.collect()]
    assert Counter(got) == Counter((d[0], d[1], "clash") for d in DOCS)
    assert write_shuffled(empty(spark)).count() == 0


def test_shards_query(spark, folder):
    rows = Q.op2_external_shuffle(spark, folder).collect()
    docs = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "rows")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(16))
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3


def test_shuffle_is_reproducible(spark, folder):
    a, b, c = (
        [(r.doc_id, r.llm_shard, r.llm_slot) for r in
         write_shuffled(table(spark, folder, "documents"), seed=s).collect()] for s in (1, 1, 2))
    assert sorted(a) == sorted(b) != sorted(c)


BITS = ["a", "b", "Z", "é", "ß", "İ", "Σ", "漢", "0", "5", *" " * 4, "  ", "\n", "\n\n", "\t", "\r\n", " \n", "\u00a0", "\u3000",
        "\u2003", "\u0085", "'", "'s", "'t", "'LL", "’", ".", ",", "!", "(", "-", "~", "≠", "\u0301", "\u0338", "=",
        "<|endoftext|>", "<|EndOfText|>", "\x00", "\x1c", "👩‍💻", "/", '"', "word", "Hello", "don't", "\u200b", "½", "٣"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_mixed_scripts_and_white_space_give_the_ids_of_whole_texts(path, monkeypatch):
    import random

    from tribunal.llm import tokens

    r = random.Random(11)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    code = "def f(x):\n    if x:\n\n        return  {'a': x}\n\t\n   "
    texts += [code, code * 3 + "\n", "para one.\n\n  Indented  para\u00a0two.\n", "\n", "  ", " " * 50 + "x"]
    expected = [x.ids for x in LIBRARY[path].encode_batch(texts, add_special_tokens=False)]
    for remembered in (10**6, 50):                      # and with a memory that is too small
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        own = tokens.Encoder(path)
        for some in range(0, len(texts), 500):
            got = own.encode(texts[some:some + 500])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == expected[some:some + 500]
