import inspect
import random
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
from fixtures import DOCS, documents, empty, shingles
from test_near_dup import brute
from test_packing_records_shards import check_pieces

import __spark_entry__ as E
from tribunal.llm.common import table
from tribunal.llm.line_quality import quality_columns


def test_shape():
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in P.STAGES)
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and "pipeline" in E.queries()


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    results = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        results.append(docs)
    assert all(r.columns == columns for r in results[:4])
    raw = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    judged = {r.doc_id: r for r in quality_columns(table(spark, folder, "documents")).collect()}
    one, two, three, four = ({r.doc_id: r for r in x.collect()} for x in results[:4])
    assert {d: r.text for d, r in one.items()} == {d: r.clean for d, r in judged.items() if r.kept}
    assert all(r.n_chars == len(r.text) for r in one.values()) and set(one) < set(raw)
    comp = brute([(d, r.text) for d, r in one.items()], 5, 80)
    assert set(two) == {d for d, c in comp.items() if c[2]}
    assert all(two[d] == one[d] for d in two)
    assert set(three) == set(two) and all(len(three[d].text) <= len(two[d].text) for d in two)
    assert four == three and results[3].count() == len(four)
    check_pieces(results[4].collect(), [(d, r.text) for d, r in four.items()], 1024, 0)
    ran = P.run(spark, folder)
    assert ran.columns == results[4].columns and ran.count() == results[4].count()


@pytest.mark.parametrize("k", range(5))
def test_awkward_documents(spark, folder, k):
    stage = P.STAGES[k][1]
    out = stage(spark, documents(spark, clashing=False), folder).collect()
    ids = sorted((r.doc_id for r in out), key=str)
    every = sorted((d[0] for d in DOCS), key=str)
    if k == 0:
        # Document 1 has ten words and loses none; only fewer than ten are too few.
        assert ids == [1, 4, 5, 6]
    elif k == 1:
        expected = [d for d in every if d not in (5, 6, 8)]
        expected.remove(7)
        assert ids == expected
    elif k < 4:
        assert ids == every
    else:
        assert set(ids) == set(every)
    assert stage(spark, empty(spark), folder).count() == 0


def test_run_packs_the_target_weights(spark, tmp_path):
    """Half of the input is of a source that shares one part in 101; sequences follow the weights while all last."""
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(5000)]
    rows, source = [], {}
    for n in range(6000):
        source[n] = "hot" if n % 2 else "src0" if n % 8 == 0 else f"src{1 + n // 2 % 19}"
        text = " ".join(r.choice(vocabulary) for _ in range(r.randint(100, 220))) + " the of and to that have with."
        rows.append((n, text, "en", source[n], len(text)))
    documents(spark, rows, clashing=False).write.parquet(str(tmp_path / "documents.parquet"))
    packed = P.run(spark, str(tmp_path)).select("doc_id", "sequence_id", "length").collect()
    assert {p.doc_id for p in packed} == set(source)
    tokens = Counter()
    for p in packed:
        tokens[p.sequence_id] += p.length
    order = sorted(tokens)
    assert len({s >> 32 for s in order}) > 4
    for part in (order[:200], order[200:400], order[:400]):
        chosen, share = set(part), Counter()
        for p in packed:
            if p.sequence_id in chosen:
                share[source[p.doc_id] if source[p.doc_id] in ("hot", "src0") else "named"] += p.length
        whole = sum(share.values())
        assert share["hot"] < 0.06 * whole and abs(share["src0"] / whole - 24 / 101) < 0.06
