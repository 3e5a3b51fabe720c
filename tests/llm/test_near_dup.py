import random

import pytest
from fixtures import DOCS, documents, empty, joined, shingles

from tribunal.llm import queries as Q
from tribunal.llm.common import table
from tribunal.llm.components import components
from tribunal.llm.near_dup import Banding, near_duplicates


def brute(docs, n=3, percent=85):
    sets = {d: shingles(t, n) for d, t in docs}
    ids = sorted(sets)
    by_shingle = {}
    for d in ids:
        for s in sets[d]:
            by_shingle.setdefault(s, []).append(d)
    shared = {}
    for own in by_shingle.values():
        for i, x in enumerate(own):
            for y in own[i + 1:]:
                shared[x, y] = shared.get((x, y), 0) + 1
    links = [(x, y) for (x, y), c in shared.items() if 100 * c >= percent * (len(sets[x]) + len(sets[y]) - c)]
    comp = joined(ids, links)
    return {d: (len(sets[d]), comp[d], comp[d] == d) for d in ids}


def rows_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_matches_brute_force(spark, folder):
    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    assert rows_of(Q.op3_tensored_near_duplicates(spark, folder)) == brute(docs)


@pytest.mark.parametrize("banding", [Banding(), Banding(5, 80)])
def test_chains_of_edits(spark, banding):
    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(4000)]
    docs, n = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 200))]
        for _ in range(25):
            for _ in range(r.randint(0, 3)):
                base = list(base)
                base[r.randrange(len(base))] = r.choice(vocabulary)
            docs.append((n, " ".join(base), "en", "a", 1))
            n += 1
    found = rows_of(near_duplicates(documents(spark, docs), banding=banding))
    assert found == brute([(d[0], d[1]) for d in docs], banding.words, banding.percent)


def test_blocks_of_a_large_cluster(spark):
    from tribunal.llm.near_dup import candidate_links, signatures, verified_links
    from pyspark.sql import functions as F

    r = random.Random(5)
    base = [f"v{i}" for i in range(150)]
    docs = []
    for n in range(120):
        own = list(base)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(150)] = f"x{r.randrange(10**6)}"
        docs.append((n, " ".join(own), "en", "a", 1))
    df, banding = documents(spark, docs), Banding()
    reps = signatures(df, "doc_id", "text", banding).select(F.col("doc_id").alias("rep"), "n_shingles", "u", "v")
    clusters = components(candidate_links(reps))
    small = verified_links(df, "doc_id", "text", reps, clusters, banding, block=8).collect()
    comp = joined(range(120), [(x.a, x.b) for x in small])
    assert comp == {d: c[1] for d, c in brute([(d[0], d[1]) for d in docs]).items()}


def test_awkward_documents(spark):
    found = near_duplicates(documents(spark)).collect()
    assert len(found) == len(DOCS)
    null = [r for r in found if r.doc_id is None]
    assert [(r.n_shingles, r.component_id, r.kept) for r in null] == [(1, None, True)]
    plain = [(d[0], d[1]) for d in DOCS if d[0] is not None]
    expected = brute(plain)
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == expected[r.doc_id]
    assert near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)]
    nodes = sorted({x for e in links for x in e if e[0] != e[1]})
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == joined(nodes, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
