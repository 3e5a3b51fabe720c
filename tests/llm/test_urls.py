import random
import re

from pyspark.sql import functions as F

from tribunal.llm import queries as Q
from tribunal.llm.common import table
from tribunal.llm.queries import URL_RULES
from tribunal.llm.url_filter import Rule, TreeSettings, judge_urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return (best.text, best.verdict) if best else (None, None)


URLS = [None, "", "no scheme", "HTTP://WWW.Example.ORG/es/x", "http://example.org/en/12?q=/es/", "http://org/x",
        "http://notorg/x", "http://a.org", "http://a.org?x=/fr/", "http://x.com/fr/1#a", "http://com/de/", "ftp://ÄÖ.com/de/é",
        "http://e.com/\nde/", "a://b://c.org/z", "http://x.net/1", "http://x.net/1", "http://" + "a" * 5000 + ".net/" + "b/" * 3000]


def pages(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    for c in ("host", "path", "rule", "label", "depth", "verdict", "probability", "entropy"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def check_base(rows, urls):
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path = split(urls[r.page_id])
        text, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, text)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_awkward_urls(spark):
    check_base(judge_urls(pages(spark, URLS), URL_RULES).collect(), dict(enumerate(URLS)))
    assert judge_urls(pages(spark, URLS).where("1 = 0"), URL_RULES).count() == 0
    assert {r.verdict for r in judge_urls(pages(spark, URLS), []).collect()} == {"allow"}
    one = [Rule("block", "net", "/")]
    assert {r.verdict for r in judge_urls(pages(spark, URLS), one).collect()} == {"block"}


def test_query(spark, folder):
    urls = {r.page_id: r.url for r in table(spark, folder, "pages").collect()}
    check_base(Q.op6_url_trees(spark, folder).collect(), urls)


def labelled_urls(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        bad = r.random() < 0.4
        word = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
        if bad:
            host = f"{word(3)}-{word(4)}{r.randrange(10**6)}.{r.choice(['xyz', 'top', 'com'])}"
            url = f"http://{host}/{word(5)}{r.randrange(10**8)}?" + "&".join(f"{word(2)}={r.randrange(999)}" for _ in range(4))
        else:
            url = f"https://www.{word(8)}.{r.choice(['com', 'org', 'edu'])}/{word(6)}/{word(7)}.html"
        if r.random() < 0.05:
            bad = not bad
        yield url, int(bad)


def test_trees_learn_from_labelled_urls(spark):
    train = spark.createDataFrame(list(labelled_urls(3000, 1)), "url string, label int")
    held = list(labelled_urls(1500, 2))
    judged = judge_urls(pages(spark, [u for u, _ in held]), [], train, settings=TreeSettings(rows=2000)).collect()
    right = sum((r.verdict == "block") == bool(held[r.page_id][1]) for r in judged)
    assert right / len(held) > 0.9
