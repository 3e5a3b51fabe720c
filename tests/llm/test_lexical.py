import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from fixtures import DOCS, documents, empty, lower_az

from tribunal.llm.common import text_bytes
from tribunal.llm.lexical import (
    Block, COORDINATES, Search, build_index, lexical_search, search, sketches, term_counts,
)

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lower_az(text or ""))


def brute(docs, items, places=50):
    """(item, rank, document, score) by scoring every document for every item."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            norm = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * norm))
                for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, n + 1, f[3], -f[0]) for n, f in enumerate(sorted(found, key=lambda f: f[:3])[:places])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def corpus(n=400, seed=1):
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.5)) % 900}"      # noqa: E731
    rows = [(d, " ".join(word() for _ in range(r.choice([3, 30, 200]))), "en", "a", 1) for d in range(n)]
    # a third of the documents are copies: many equal scores
    return [(d, rows[7][1] if d % 3 == 0 else t, *x) for d, t, *x in rows]


def test_matches_brute_force(spark):
    rows = corpus()
    r = random.Random(2)
    asked = [(i, " ".join(r.choice(rows)[1].split()[:40])) for i in range(40)] + [(7, "w1 w2 w2 W3"), (99, "nowhere")]
    expected = brute([x[:2] for x in rows], asked)
    docs = documents(spark, rows)
    assert got(lexical_search(docs, items(spark, asked))) == expected
    small = Search(seeds=3, seeds_per_task=2, queries=7, round_pairs=1)
    for coordinates in (1, 16):
        index = build_index(docs, coordinates=coordinates)
        assert got(search(index, items(spark, asked), how=small, coordinates=coordinates)) == expected
    three = [x for x in expected if x[1] <= 3]
    assert got(search(index, items(spark, asked), how=Search(places=3), coordinates=16)) == three


def test_awkward_documents_and_items(spark):
    asked = [(1, "alpha TWO one"), (2, None), (3, ""), (None, "no w5x3 漢字"), (1, "alpha TWO one"), (5, "- ! \x00"),
             (6, "É éà"), (8, "w1x1 " * 3000 + DOCS[3][1])]
    rows = [d[:2] for d in DOCS]
    assert got(lexical_search(documents(spark), items(spark, asked))) == brute(rows, asked)
    assert lexical_search(empty(spark), items(spark, asked)).count() == 0
    assert lexical_search(documents(spark), items(spark, []).where("1 = 0")).count() == 0


def test_counts_beyond_a_coordinate_and_equal_heads(spark):
    rows = [(1, "x " * 300 + "y", "en", "a", 1), (2, "x " * 254, "en", "a", 1), (3, "x y", "en", "a", 1)]
    asked = [(1, "x"), (2, "y x")]
    assert got(lexical_search(documents(spark, rows), items(spark, asked))) == brute([x[:2] for x in rows], asked)


def test_bounds_hold_and_prune():
    r = random.Random(3)
    texts = [" ".join(f"w{int(r.paretovariate(0.4)) % 5000}" for _ in range(r.choice([5, 80, 900]))) for _ in range(500)]
    raw, starts, ends = text_bytes(pa.array(texts))
    own, code, count, size = term_counts(raw, starts, ends)
    asked = [" ".join(r.choice(texts).split()[:30]) for _ in range(20)]
    block = Block(asked)
    df = Counter(code.tolist())
    block.weigh({n: df[int(c)] for n, c in enumerate(block.vocabulary)}, len(texts), int(size.sum()))
    shares = []
    for coordinates in (64, COORDINATES):
        at, coordinate, peak = sketches(own, code, count, coordinates)
        bounds = np.zeros((len(texts), len(asked)))
        for docs, some in block.bounds(size, coordinate, peak, np.bincount(at, minlength=len(texts)), coordinates):
            bounds[docs] = some
        docs, queries = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(asked)), indexing="ij"))
        matched = block.matched(code, count, np.bincount(own, minlength=len(texts)))
        scores = block.scores(size, matched, docs, queries).reshape(bounds.shape)
        assert (bounds >= scores).all()
        last = np.sort(scores, axis=0)[-50]
        shares.append((bounds >= last).mean())
    assert shares[1] < 0.15 < shares[0]
