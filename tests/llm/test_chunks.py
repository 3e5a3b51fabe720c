import random
import re

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOCS, documents, empty, words

from tribunal.llm import queries as Q
from tribunal.llm.chunk_dedup import Passages, chunk_runs, chunk_starts, substring_dedup
from tribunal.llm.common import Words, join_counted, table, text_bytes


def words_of(*texts):
    raw, starts, ends = text_bytes(pa.array(texts))
    return Words(raw, starts, ends, lower=False)


def sentence(r, n, vocabulary=3000):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def cuts(*texts):
    found = words_of(*texts)
    return [chunk_starts(words_of(x), Passages()).tolist() for x in texts] if len(texts) == 1 else [
        (np.array([c for c in chunk_starts(found, Passages()) if a <= c < b]) - a).tolist()
        for a, b in zip(found.first, found.first[1:])]


def test_chunks_are_short_and_resist_insertions():
    r = random.Random(2)
    text = sentence(r, 3000)
    own = cuts(text)[0]
    gaps = np.diff(own)
    assert gaps.max() <= Passages().stretch and own[0] < 12 and 3000 - own[-1] < 30 and 5 < gaps.mean() < 8
    shifted = cuts(sentence(r, 7) + " " + text)[0]
    assert {c + 7 for c in own if c >= 11} <= set(shifted)
    # each row of a batch is cut by itself
    assert cuts(text, "", "x", "a b c d e f g h i j k l m", text) == [own, [], [], cuts("a b c d e f g h i j k l m")[0], own]


def test_every_passage_holds_a_whole_chunk_cut_alike():
    r = random.Random(3)
    how = Passages()
    for n in range(200):
        passage = sentence(r, 51, vocabulary=r.choice([1, 2, 5, 3000]))
        digests = []
        for _ in range(2):
            before = sentence(r, r.randint(0, 60), vocabulary=5)
            text = f"{before} {passage} {sentence(r, r.randint(0, 60), vocabulary=5)}"
            row, chunk, at, windows = chunk_runs(words_of(text), how)
            place = len(words(before))
            mine = [int(c) for c, a, w in zip(chunk, at, windows) if a <= place < a + w]
            assert len(mine) == 1 and int(windows.sum()) == len(words(text)) - 50
            digests.append(mine[0])
        assert digests[0] == digests[1]


def test_limits_without_a_sure_chunk_are_refused():
    for wrong in (dict(longer_than=40), dict(stretch=13), dict(reach=30), dict(reach=11)):
        with pytest.raises(ValueError):
            Passages(**wrong)


def test_planted_passages_go_and_clean_documents_stay(spark):
    r = random.Random(3)
    line = sentence(r, 13)
    passages = [sentence(r, n) for n in (*range(51, 121, 5), *range(52, 120, 6))]
    docs, planted = [], {}
    for n in range(300):
        parts = [sentence(r, r.randint(5, 60)) for _ in range(4)]
        if n % 3 == 0:
            parts[1] = line
        if n % 5 == 0:
            p = (n // 5) % len(passages)
            planted.setdefault(p, []).append(n)
            parts[2] = passages[p]
        docs.append((n, "\n".join(parts), "en", "a", 1))
    got = {x.doc_id: x for x in substring_dedup(documents(spark, docs)).collect()}
    later = [n for own in planted.values() for n in own[1:]]
    missed = [n for n in later if not got[n].llm_removed_words]
    assert not missed
    text = {d[0]: d[1] for d in docs}
    for n in range(300):
        if n not in later:
            assert got[n].text == text[n] and got[n].llm_removed_words == 0
        else:
            assert len(words(text[n])) - len(words(got[n].text)) == got[n].llm_removed_words
        assert got[n].kept == "clash"


def test_awkward_documents(spark):
    got = substring_dedup(documents(spark)).collect()
    assert len(got) == len(DOCS)
    text = {d[0]: d[1] for d in DOCS}
    for r in got:
        if r.doc_id == 5:
            assert r.text == "" and r.llm_removed_words == 9000
        elif r.doc_id == 6:
            assert r.llm_removed_words > 8900
        else:
            assert r.text == text[r.doc_id]
    assert substring_dedup(empty(spark)).count() == 0


def brute(docs, most=50):
    """Text, removed words and number of spans: every window of more than ``most`` words of a smaller key goes."""
    seen, out = {}, {}
    for d, text in sorted(docs):
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
        bad = [False] * len(found)
        for i in range(len(found) - most):
            window = tuple(m.group() for m in found[i:i + most + 1])
            if seen.setdefault(window, d) != d:
                bad[i:i + most + 1] = [True] * (most + 1)
        starts = [0, *[m.start() for m in found[1:]], len(text)]
        kept = "".join(text[starts[i]:starts[i + 1]] for i in range(len(found)) if not bad[i]) if found else text
        out[d] = (kept, sum(bad), sum(b and not a for a, b in zip([False, *bad], bad)))
    return out


def test_every_passage_of_over_fifty_words_goes_whole(spark):
    r = random.Random(6)
    passages = [sentence(r, n) for n in [51] * 80 + [55] * 30 + [60] * 20] + ["w " * 51, "a b " * 40]
    docs = [(2 * k + n, f"{sentence(r, r.randint(0, 9))} x{2 * k + n} " + (p if n else p.replace(" ", "\n")) + f" y{n} é "
             + sentence(r, r.randint(0, 70)), "en", "a", 1) for k, p in enumerate(passages) for n in (0, 1)]
    got = {x.doc_id: (x.text, x.llm_removed_words, len(x.llm_spans or ()))
           for x in substring_dedup(documents(spark, docs)).collect()}
    expected = brute([d[:2] for d in docs])
    assert got == expected
    assert all(expected[2 * k + 1][1] == len(words(p)) for k, p in enumerate(passages))


def test_holders_other_than_the_first_count(spark):
    r = random.Random(7)
    p, q = sentence(r, 30), sentence(r, 60)
    docs = [(1, f"{p} {sentence(r, 40)}"), (2, f"{sentence(r, 9)} {p} {q}"), (3, f"{p} {q} end"), (4, f"{q[:-6]} {p}")]
    got = {x.doc_id: (x.text, x.llm_removed_words, len(x.llm_spans or ()))
           for x in substring_dedup(documents(spark, [(*d, "en", "a", 1) for d in docs])).collect()}
    assert got == brute(docs) and got[3][0] == "end"


def test_query_removes_exactly_the_repeated_windows(spark, folder):
    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect() if r.text is not None]
    got = {r.doc_id: (r.text, r.removed_words, r.n_spans) for r in Q.op8_gear_chunks(spark, folder).collect()}
    expected = brute(docs)
    assert {d: got[d] for d in expected} == expected and sum(v[1] for v in expected.values()) > 0


def test_shared_text_of_fifty_words_stays(spark):
    r = random.Random(8)
    shared = [sentence(r, n) for n in [35] * 20 + [40] * 20 + [50] * 20]
    docs = [(2 * k + n, f"{sentence(r, 9)} x{n} {p} y{n} {sentence(r, 9)}") for k, p in enumerate(shared) for n in (0, 1)]
    p, q = sentence(r, 30), sentence(r, 30)
    docs += [(200, p), (201, q), (202, f"{p} {q}")]
    got = substring_dedup(documents(spark, [(*d, "en", "a", 1) for d in docs])).collect()
    assert sorted((x.doc_id, x.text) for x in got) == docs and not any(x.llm_removed_words for x in got)


def test_every_text_of_a_repeated_key_is_cleaned(spark):
    r = random.Random(9)
    a, b, other = (sentence(r, n) for n in (100, 60, 90))
    docs = [(1, a), (2, a), (2, f"other {other}"), (3, f"x {b}"), (3, f"{b} {sentence(r, 5)} {a} end"), (4, f"{b} last")]
    got = substring_dedup(documents(spark, [(*d, "en", "a", 1) for d in docs])).collect()
    assert sorted((x.doc_id, x.text, x.llm_removed_words) for x in got) == sorted([
        (1, a, 0), (2, "", 100), (2, f"other {other}", 0), (3, f"x {b}", 0),
        (3, docs[4][1].replace(a + " ", ""), 100), (4, "last", 60)])


def test_counted_join_is_the_same_for_hot_and_other_keys(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 * (id % 7) as k", "-id as x")
    keyed = spark.createDataFrame([(0, "a", 143), (1, "b", 143), (4, "c", 143), (99, "d", 1)], "k long, v string, rows long")
    expected = sorted((i, i % 7 * (i % 7), -i, {0: "a", 1: "b", 4: "c"}[i % 7 * (i % 7)]) for i in range(1000) if i % 7 < 3)
    for most in (1, 3, 1000):
        got = join_counted(rows, keyed, "k", ["v"], ["id"], most).collect()
        assert sorted(tuple(r) for r in got) == expected
