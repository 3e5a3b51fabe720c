"""Allow and block URLs: explicit rules first, boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FEATURES = ["url_length", "path_length", "host_length", "depth", "labels", "digit_ratio", "entropy", "parameters",
             "hyphens", "odd_characters", "has_fragment", "suffix1_block", "suffix2_block", "ending_block"]


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeSettings:
    """Trees, their depth, and how many labelled rows at most are used to fit them (suffix statistics use all)."""

    trees: int = 20
    depth: int = 4
    rows: int = 20_000
    smoothing: float = 20.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(_llm_url, instr(_llm_url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.substring(after, F.length(host) + 1, F.length(after))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^?#]*", 0)


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, or null."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if text is None else (text, verdict)


def _letters(column: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(column, f"[^{keep}]", ""))


def _entropy(column: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    n = F.length(column).cast("double")
    share = lambda c: (n - F.length(F.replace(column, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(
        F.array_distinct(F.split(column, "")), F.lit(0.0),
        lambda acc, c: F.when(c == "", acc).otherwise(acc - share(c) * F.log2(share(c))))).otherwise(0.0)


def _half(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit(5)), F.lit(2))


def lexical(urls: DataFrame) -> DataFrame:
    """Add the lexical features and suffixes of ``_llm_url``, ``host`` and ``path``."""
    url = F.coalesce("_llm_url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        "url_length": F.length(url).cast("double"), "path_length": F.length("path").cast("double"),
        "host_length": F.length("host").cast("double"), "depth": _letters(F.col("path"), "/").cast("double"),
        "labels": (_letters(F.col("host"), ".") + 1).cast("double"),
        "digit_ratio": _letters(url, "0-9") / n, "entropy": _entropy(url),
        "parameters": F.when(query == "", 0.0).otherwise((_letters(query, "&") + 1).cast("double")),
        "hyphens": _letters(url, r"\-").cast("double"),
        "odd_characters": (F.length(url) - _letters(url, "a-zA-Z0-9/.:\\-")).cast("double"),
        "has_fragment": (F.instr(url, "#") > 0).cast("double"),
        "suffix1": F.substring_index("host", ".", -1), "suffix2": F.substring_index("host", ".", -2),
        "ending": F.regexp_extract("path", r"\.([a-zA-Z0-9]{1,8})$", 1),
    })


@dataclass
class UrlModel:
    """Fitted trees with the labels of every suffix; without both classes, one fixed verdict."""

    settings: TreeSettings
    trees: object | None
    fixed: float
    share: float
    suffixes: dict[str, DataFrame]

    def with_shares(self, rows: DataFrame, training: bool = False) -> DataFrame:
        """Add block shares; a training row gets those of the other half, which its own label is not part of."""
        half, k = _half(F.col("_llm_url")), self.settings.smoothing
        for c, stats in self.suffixes.items():
            rows = rows.join(stats, F.col(c) == F.col("_suffix"), "left")
            own = (lambda x: F.when(half == 0, F.col(f"{x}1")).otherwise(F.col(f"{x}0"))) if training else (
                lambda x: F.col(f"{x}0") + F.col(f"{x}1"))
            share = (own("_b") + k * self.share) / (own("_n") + k)
            rows = rows.withColumn(f"{c}_block", F.coalesce(share, F.lit(self.share))).drop(
                "_suffix", "_n0", "_n1", "_b0", "_b1")
        return rows

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``block``, the probability that a URL is to be blocked."""
        if self.trees is None:
            return rows.withColumn("block", F.lit(self.fixed))
        ready = VectorAssembler(inputCols=_FEATURES, outputCol="_features").transform(
            self.with_shares(lexical(rows)))
        return self.trees.transform(ready).withColumn(
            "block", vector_to_array("probability")[1]).select(*rows.columns, "block")


def fit(labelled: DataFrame, settings: TreeSettings = TreeSettings()) -> UrlModel:
    """Fit on rows with ``_llm_url``, ``host``, ``path`` and ``label`` (1: block; null labels are left out).

    Block shares of host suffixes and file endings count all labelled rows.
    The trees see at most about ``settings.rows`` rows, chosen by a hash of the
    URL.  With one class only, its verdict holds for every URL; without any
    row, nothing is blocked.
    """
    rows = lexical(labelled.where("label is not null"))
    n, blocked = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or not blocked or blocked == n:
        return UrlModel(settings, None, float(bool(n and blocked)), float(bool(n and blocked)), {})
    share, half = blocked / n, _half(F.col("_llm_url"))
    sums = [F.sum((half == h).cast("long") * weight).alias(f"{x}{h}")
            for x, weight in (("_n", F.lit(1)), ("_b", F.col("label"))) for h in (0, 1)]
    suffixes = {c: rows.groupBy(F.col(c).alias("_suffix")).agg(*sums) for c in ("suffix1", "suffix2", "ending")}
    model = UrlModel(settings, None, 0.0, share, suffixes)
    part = min(1.0, settings.rows / n)
    if part < 1:
        rows = rows.where(F.pmod(F.xxhash64("_llm_url", F.lit(3)), F.lit(1 << 20)) < int(part * (1 << 20)))
    ready = VectorAssembler(inputCols=_FEATURES, outputCol="_features").transform(
        model.with_shares(rows, training=True))
    model.trees = GBTClassifier(
        featuresCol="_features", labelCol="label", maxIter=settings.trees, maxDepth=settings.depth, seed=1
    ).fit(ready.select("_features", F.col("label").cast("double").alias("label")))
    return model


def judge_urls(
    pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, key: str = "page_id", url: str = "url",
    settings: TreeSettings = TreeSettings(),
) -> DataFrame:
    """Per row: page_id, host, path, rule and verdict (allow or block).

    ``labelled`` has ``url`` and ``label`` (1: block) to train on; without it,
    the URLs that the rules decide are the labelled ones.  Null and malformed
    URLs have empty host and path and are judged by the trees.  Rows are judged
    one by one, so repeated rows and null keys stay; other columns are not
    read.  An empty table gives no rows.
    """
    def parsed(df: DataFrame, *columns: Column) -> DataFrame:
        kept = df.select(*columns, F.col(url).alias("_llm_url"))
        host, path = host_and_path(F.col("_llm_url"))
        return kept.withColumns({"host": host, "path": path})

    text, verdict = rule_columns(rules)
    rows = parsed(pages, F.col(key).alias("page_id")).withColumns({"rule": text, "ruled": verdict})
    if labelled is None:
        training = rows.withColumn("label", (F.col("ruled") == "block").cast("int"))
    else:
        training = parsed(labelled, F.col("label").cast("int").alias("label"))
    model = fit(training.select("_llm_url", "host", "path", "label"), settings)
    judged = model.score(rows)
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("block") > 0.5, "block").otherwise("allow")).alias("verdict"))
