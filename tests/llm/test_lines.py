import random
from collections import defaultdict

from fixtures import DOCS, documents, empty, lower_az

from tribunal.llm.line_runs import LineRuns, dedup_lines, key_hash, without_lines
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"


def brute(rows, least):
    """(key, text after, lines, dropped) of each row."""
    holders = defaultdict(set)
    split = [(k, (t or "").split("\n")) for k, t in rows]
    for n, (_, lines) in enumerate(split):
        for line in lines:
            holders[lower_az(line.strip(BLANKS))].add(n)
    out = []
    for k, lines in split:
        kept = [x for x in lines if not lower_az(x.strip(BLANKS)) or len(holders[lower_az(x.strip(BLANKS))]) < least]
        out.append((k, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text or "", r.llm_lines, r.llm_dropped) for r in df.collect()), key=str)


def corpus(n=300):
    r = random.Random(1)
    shared = [f"Line  {i} É" for i in range(40)]
    rows = []
    for d in range(n):
        lines = [f"own {d} {i}" for i in range(r.randint(0, 5))]
        lines += [r.choice(["", "  ", "\t"]) + r.choice([s, s.upper(), s + " \r"]) for s in r.sample(shared, r.randint(0, 9))]
        lines += ["HOT line"] * (d % 3 == 0) * 2 + [""] * r.randint(0, 2)
        r.shuffle(lines)
        rows.append((d, "\n".join(lines), "en", "a", 1))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    for least, batches, fanout in ((10, 8, 3), (40, 5, 2), (2, 1, 4)):
        cleaned = dedup_lines(documents(spark, rows), min_documents=least, batches=batches, fanout=fanout)
        assert got(cleaned) == brute([x[:2] for x in rows], least)
    assert {r.kept for r in cleaned.select("kept").collect()} == {"clash"}


def test_hot_and_other_keys_agree(spark):
    rows = corpus()
    docs = documents(spark, rows, clashing=False)
    runs = LineRuns(spark, 10, 4)
    runs.add(docs)
    common = runs.common()
    expected = brute([x[:2] for x in rows], 10)
    # all keys broadcast, some, none
    for most in (10**9, 20, 1):
        assert got(without_lines(docs, common, most_hot=most)) == expected
    runs.release()


def test_awkward_documents(spark):
    rows = [d[:2] for d in DOCS]
    assert got(dedup_lines(documents(spark), min_documents=2)) == brute(rows, 2)
    assert got(dedup_lines(documents(spark), min_documents=1)) == brute(rows, 1)
    assert dedup_lines(empty(spark)).count() == 0
    untouched = dedup_lines(documents(spark)).where("doc_id = 2").first()
    assert untouched.text is None and untouched.llm_lines == 1


def test_a_text_of_many_lines_takes_linear_time(spark):
    text = "\n".join(f"x{i % 50_000}" for i in range(200_000))
    docs = documents(spark, [(i, text, "en", "a", 1) for i in (1, 2)], clashing=False)
    rows = got(dedup_lines(docs, min_documents=2, batches=2))
    assert rows == [(1, "", 200_000, 200_000), (2, "", 200_000, 200_000)]


def test_levels_hold_sorted_runs_and_settled_keys_are_not_added(spark):
    docs = documents(spark, [(i, f"common\nown {i}", "en", "a", 1) for i in range(30)], clashing=False)
    runs = LineRuns(spark, 2, 4, fanout=3)
    for part in range(7):
        runs.add(docs.where(F.col("doc_id") % 7 == part))
    assert [len(x) for x in runs.levels] == [1, 2]
    common = spark.range(1).select(*key_hash(F.lit("common"))).first()
    held = spark.table(runs.title).where(f"high = {common.high} and low = {common.low}").collect()
    live = {r for level in runs.levels for r in level}
    assert sum(r.docs for r in held if r.run in live) == 5       # documents 0, 7, 14, 21, 28: later batches add nothing
    assert [(r.high, r.low) for r in runs.common().collect()] == [(common.high, common.low)]
    plan = runs.unsettled(runs.spark.table(runs.title).where("run = '0-6'"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Exchange" not in plan
    runs.release()


def test_plain_deduplication_keeps_new_lines(spark):
    runs = LineRuns(spark, 1, 4)
    a = documents(spark, [(1, "a\nb", "en", "a", 1)], clashing=False)
    b = documents(spark, [(2, "B \nc", "en", "a", 1)], clashing=False)
    runs.add(a)
    assert runs.unsettled(runs.counts(b)).count() == 1
    runs.add(b)
    assert runs.common().count() == 3
    runs.release()


def test_no_python_in_the_plan(spark, folder):
    from tribunal.llm import queries as Q

    plan = Q.op11_line_runs(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
