"""Small awkward tables and brute-force helpers."""

import re

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(9000))
DOCS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", len(LONG)),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG + " tail", "fr", None, 1),
    (7, "one two", "en", "a", 7),
    (7, "one two", "en", "a", 7),
    (8, "ONE\ttwo", "en", "a", 7),
    (9, "  spaced   out \n\n text\r\n", "en", "a", 3),
    (10, "   \n\t ", "en", "a", 3),
    (None, "no key here", "en", "a", 3),
    (11, "éà ü 漢字 <|endoftext|> x", "de", "c", 3),
    (12, "word", "de", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["kept", "start", "shard", "slot", "component_id", "n_words", "node", "a", "b", "u", "key", "rep",
            "llm_slot", "llm_row", "_key", "position", "line", "length"]


def documents(spark, rows=DOCS, clashing=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASHING if clashing else []:
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return documents(spark, DOCS).where("1 = 0")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n):
    w = words(lower_az(text or ""))
    if not w:
        return frozenset()
    if len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def joined(nodes, links):
    """Smallest reachable node of each node."""
    above = {n: n for n in nodes}

    def root(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for x, y in links:
        x, y = root(x), root(y)
        above[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}
