import re
from collections import Counter, defaultdict

import pytest
from compare import database, differences
from fixtures import DOCS, documents, empty, words
from hypothesis import given, settings, strategies as st

from tribunal.llm import mixing, queries as Q
from tribunal.llm.common import table
from tribunal.llm.line_quality import keep_good, quality_columns
from tribunal.llm.mixing import in_order, mix, pfair_slots
from tribunal.llm.oracle import ORACLE


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_no_source_is_a_block_away_from_its_share(parts):
    named = {f"s{i}": p for i, p in enumerate(parts)}
    period = sum(parts)
    slots = sorted(pfair_slots(named), key=lambda s: s[2])
    assert [s[2] for s in slots] == list(range(period))
    placed = Counter()
    for s, j, slot in slots:
        assert j == placed[s] and j * period // named[s] <= slot < -(-(j + 1) * period // named[s])
        placed[s] += 1
        for name, p in named.items():
            assert abs(placed[name] * period - p * (slot + 1)) < period


def test_mixture_keeps_every_row_and_its_proportions(spark):
    docs = [(i, f"t{i}", "en", ["a", "b", "c", None][min(3, i % 7)], 1) for i in range(700)]
    rows = mix(documents(spark, docs), {"a": 3, "b": 2, "c": 1}, block=4, rest=2).collect()
    assert sorted(r.doc_id for r in rows) == list(range(700)) and {r.kept for r in rows} == {"clash"}
    position = {r.llm_position for r in rows}
    assert len(position) == 700
    blocks = defaultdict(set)
    for r in rows:
        blocks[r.source].add((r.llm_slot, r.llm_block))
        assert r.llm_position // 4 == r.llm_slot
    full = min(max(b) for b in ([s for s, _ in blocks[x]] for x in blocks))
    for source, part in (("a", 3), ("b", 2), ("c", 1), (None, 2)):
        own = sorted(blocks[source])
        assert [b for _, b in own] == list(range(len(own)))
        for t in range(1, full + 1):
            assert abs(sum(s < t for s, _ in own) - part / 8 * t) < 1


def test_no_window_over_all_buckets_of_a_source(spark, monkeypatch):
    docs = documents(spark, [(i, f"t{i}", "en", "a" if i % 3 else "b", 1) for i in range(900)])
    few = {r.doc_id: r.llm_position for r in mix(docs, {"a": 3, "b": 2}).collect()}
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 0.02)
    mixed = mix(docs, {"a": 3, "b": 2})
    plan = mixed._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"windowspecdefinition\(llm_source#\d+, llm_bucket#\d+ ASC", plan)
    assert {r.doc_id: r.llm_position for r in mixed.collect()} == few


def test_mixture_of_awkward_documents(spark):
    rows = mix(documents(spark), {"a": 2, "never seen": 5}).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((d[0], d[1]) for d in DOCS)
    assert mix(empty(spark), {"a": 1}).count() == 0
    with pytest.raises(ValueError):
        mix(documents(spark), {"a": 0})


def test_files_follow_the_mixture(spark, tmp_path):
    mixed = mix(documents(spark, clashing=False), {"a": 2, "b": 1}, block=1)
    in_order(mixed, 3).write.parquet(str(tmp_path / "m"))
    import pyarrow.parquet as pq

    positions = [p for f in sorted((tmp_path / "m").glob("part-*.parquet"))
                 for p in pq.read_table(f)["llm_position"].to_pylist()]
    assert positions == sorted(positions) and len(positions) == len(DOCS)


def base(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    twice = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if twice[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


def found(row):
    return (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)


def test_quality_of_awkward_documents(spark):
    extra = [(20, "a b c d e " * 40 + "x y z", "en", "a", 1), (21, "same line here.\n" * 5 + "other\n\n", "en", "a", 1),
             (22, "| » |\n" * 3 + "𝔘𝔫𝔦 code ## <b> & more words than ten in this line of text.", "en", "a", 1),
             (23, "p q r s t p q r s t q r s t p end of it all.", "en", "a", 1)]
    rows = quality_columns(documents(spark, DOCS + extra)).collect()
    assert len(rows) == len(DOCS + extra)
    text = {d[0]: d[1] for d in DOCS + extra}
    for r in rows:
        assert found(r) == base(text[r.doc_id])
        assert not (r.kept and r.base_failed)
    assert quality_columns(empty(spark)).count() == 0


def test_line_rules(spark):
    prose = "This line is a plain sentence with quite a few words in it."
    cases = {
        prose: True, "Home": False, "Home | About | Contact | Login": False, "Yes, it is.": True,
        "word | other | third | fourth | fifth | sixth": False, "WE!! ARE!! SO!! LOUD!! HERE!!": False,
        "Please accept cookies to go on with this page.": False, "a### b*** c%%% d$$$ e&&&": False,
        "a longer line without its final mark": True, "¿Qué es esto?": True, "„Ja“, sagte er.": True,
    }
    docs = [(i, f"{prose}\n{x}\n{prose} Indeed so.", "en", "a", 1) for i, x in enumerate(cases)]
    rows = quality_columns(documents(spark, docs)).collect()
    got = {list(cases)[r.doc_id]: len(r.clean.split("\n")) == 3 for r in rows}
    assert got == cases


def test_documents_that_lose_much_are_rejected(spark):
    good = "\n".join(f"Sentence number {i} says {i * 3} new things about topic {i * 7}." for i in range(20))
    bad = good + "\n" + "\n".join(f"menu{i} | item{i} | link{i} | more{i}" for i in range(30))
    some = good + "\nHome | About | Contact | Login | Help"
    docs = [(1, good, "en", "a", 5), (2, bad, "en", "a", 5), (3, some, "en", "a", 5), (4, None, "en", "a", 5)]
    kept = keep_good(documents(spark, docs), length="n_chars").collect()
    assert {r.doc_id: r.text for r in kept} == {1: good, 3: good}
    assert all(r.n_chars == len(good) and r.kept == "clash" for r in kept)
    assert kept[0].__fields__ == documents(spark, docs).columns


@pytest.mark.parametrize("title", ["op9_pfair_mixture", "op10_line_quality"])
def test_queries(spark, folder, title):
    assert differences(Q.QUERIES[title](spark, folder), database(folder), ORACLE[title]) == []


def test_quality_query_matches_brute_force(spark, folder):
    text = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    for r in Q.op10_line_quality(spark, folder).collect():
        assert found(r) == base(text[r.doc_id])
