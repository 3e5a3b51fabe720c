"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (high, low, docs): the 128-bit hash of a line's key and in
how many documents of some batches it was found, bucketed and sorted by the
hash.  All runs are partitions of one bucketed table, so a batch that is dealt
into the same buckets meets them in merge joins without another shuffle.  A
batch drops the keys that the runs have settled already (a merge anti-join) and
adds the others as a run of level 0; when a level holds ``fanout`` runs, they
are merged into one run of the next level.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tribunal.llm.common import total, written
from tribunal.session import new_path

_BLANKS = " \t\n\x0b\f\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HASH = ["high", "low"]


def lines_of(text: Column) -> Column:
    """Lines of a text; null and empty have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """Key of each line: without blanks at both ends, A-Z lower-cased."""
    body = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(body) == F.length(body), F.lower(body)).otherwise(
        F.translate(body, _CAPITALS, _CAPITALS.lower()))
    return F.transform(F.split(lowered, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)))


def key_hash(line: Column) -> list[Column]:
    """Two 64-bit hashes of a key under different seeds."""
    return [F.xxhash64(line).alias("high"), F.xxhash64(F.lit(7), line).alias("low")]


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` loops over something else."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class LineRuns:
    """How many documents hold a line, kept in sorted runs of ``levels``.

    A key is settled once the runs count at least ``limit`` documents for it;
    what later batches know of it is not added.  ``limit=1`` is plain
    deduplication against everything added before.  Each row of a batch is one
    document.  ``release`` drops the table's name; its files stay in the shared
    folder.
    """

    def __init__(self, spark: SparkSession, limit: int, buckets: int = 64, fanout: int = 4):
        self.spark, self.limit, self.buckets, self.fanout = spark, limit, buckets, fanout
        self.title = f"llm_runs_{uuid.uuid4().hex}"
        self.path = new_path(spark, "runs")
        self.levels: list[list[str]] = []
        self.written = 0

    def counts(self, docs: DataFrame, text: str = "text", batch: Column | None = None) -> DataFrame:
        """(batch, high, low, docs) of the non-empty keys, dealt into the buckets of the runs."""
        found = docs.select(
            (F.lit(0) if batch is None else batch).alias("batch"),
            F.explode(F.array_distinct(line_keys(F.col(text)))).alias("line"))
        hashed = found.where("line <> ''").select("batch", *key_hash(F.col("line")))
        counted = hashed.groupBy("batch", *_HASH).agg(F.count(F.lit(1)).alias("docs"))
        return counted.repartition(self.buckets, *_HASH)

    def _append(self, rows: DataFrame, level: int) -> None:
        run = f"{level}-{self.written}"
        self.written += 1
        (rows.select(*_HASH, "docs", F.lit(run).alias("run")).write.mode("append").format("parquet")
         .partitionBy("run").bucketBy(self.buckets, *_HASH).sortBy(*_HASH)
         .option("path", self.path).saveAsTable(self.title))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.table(self.title).where(F.col("run").isin(runs)).groupBy(*_HASH).agg(
            F.sum("docs").alias("docs"))

    def unsettled(self, counted: DataFrame) -> DataFrame:
        """Rows of ``counted`` whose keys the runs have not settled (merge anti-join)."""
        live = [r for level in self.levels for r in level]
        if not live:
            return counted
        settled = self._read(live).where(F.col("docs") >= self.limit)
        return counted.join(settled.hint("merge"), _HASH, "left_anti")

    def add_counts(self, counted: DataFrame) -> None:
        """Add one batch of counts as a run, then compact full levels."""
        self._append(self.unsettled(counted), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._append(self._read(merged), level + 1)
            level += 1

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Add a batch of documents."""
        self.add_counts(self.counts(docs, text))

    def add_in_batches(self, docs: DataFrame, batch: Column, batches: int, text: str = "text") -> None:
        """Add one table in batches 0 to ``batches`` - 1; the texts are read once."""
        title, path = f"{self.title}_in", f"{self.path}-in"
        (self.counts(docs, text, batch).write.format("parquet").partitionBy("batch")
         .bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", path).saveAsTable(title))
        for number in range(batches):
            self.add_counts(self.spark.table(title).where(F.col("batch") == number))
        self.spark.sql(f"drop table {title}")

    def common(self) -> DataFrame:
        """(high, low, docs) of the settled keys, written; ``docs`` counts up to the batch that settled a key at least."""
        live = [r for level in self.levels for r in level]
        if not live:
            return self.spark.createDataFrame([], "high long, low long, docs long")
        return written(self._read(live).where(F.col("docs") >= self.limit), "common")

    def release(self) -> None:
        self.spark.sql(f"drop table if exists {self.title}")


def without_lines(
    docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text", most_hot: int = 10_000
) -> DataFrame:
    """``docs`` without the lines whose keys ``common`` has, and ``llm_lines`` and ``llm_dropped`` (counts).

    The other lines stay, joined by line breaks; a text that loses nothing
    stays as it is, null too.  Keys that make up at least one in ``most_hot`` of
    all counts of ``common`` (so at most that many) are broadcast, as one of
    them may be in a third of all documents; the others meet in a shuffled
    join.  Rows are told apart by key and text: rows equal in both lose the same
    lines.  Columns named ``llm_lines`` and ``llm_dropped`` are replaced.
    """
    own = docs.drop("llm_lines", "llm_dropped")
    mark = F.xxhash64(F.col(text))
    lines = own.select(
        F.col(key).alias("_doc"), mark.alias("_mark"), F.posexplode(line_keys(F.col(text))).alias("_at", "_line")
    ).where("_line <> ''").select("_doc", "_mark", "_at", *key_hash(F.col("_line")))
    least = -(-total(common, "docs") // most_hot)
    hot = common.where(F.col("docs") >= least).select(
        F.col("high").alias("_high"), F.col("low").alias("_low"), F.lit(True).alias("_hot"))
    rest = common.where(F.col("docs") < least).select(
        F.lit(False).alias("tier"), F.col("high").alias("_h"), F.col("low").alias("_l"), F.lit(True).alias("_rest"))
    flagged = lines.join(F.broadcast(hot), (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")), "left")
    # Lines with hot keys need no second look-up: they are spread by document, where nothing matches.
    dealt = flagged.select(
        "_doc", "_mark", "_at", F.coalesce("_hot", F.lit(False)).alias("_tier"),
        F.when(F.col("_hot"), F.col("_mark")).otherwise(F.col("high")).alias("high"), "low")
    met = dealt.join(rest, (F.col("_tier") == F.col("tier")) & (F.col("high") == F.col("_h"))
                     & (F.col("low") == F.col("_l")), "left").where(F.col("_tier") | F.col("_rest"))
    drops = met.groupBy(F.col("_doc").alias("_drop_doc"), F.col("_mark").alias("_drop_mark")).agg(
        F.collect_set("_at").alias("_drops"))
    joined = own.join(
        drops, F.col(key).eqNullSafe(F.col("_drop_doc")) & mark.eqNullSafe(F.col("_drop_mark")), "left")
    split = F.struct(lines_of(F.col(text)).alias("lines"), F.col("_drops").alias("drops"))
    kept = let(split, lambda s: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["drops"]),
        lambda i: F.get(s["lines"], i)), "\n"))
    return joined.withColumns({
        "llm_lines": F.size(lines_of(F.col(text))).cast("long"),
        "llm_dropped": F.coalesce(F.size("_drops"), F.lit(0)).cast("long"),
        text: F.when(F.col("_drops").isNull(), F.col(text)).otherwise(kept),
    }).drop("_drops", "_drop_doc", "_drop_mark")


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_documents: int = 10, batches: int = 8,
    fanout: int = 4, bucket_bytes: int = 64 << 20,
) -> DataFrame:
    """``docs`` without lines whose key is in at least ``min_documents`` rows; see ``without_lines``.

    The table goes through the runs in ``batches`` batches dealt by a hash of
    key and text.  The number of buckets follows the size of the texts.  Every
    row counts as one document, also with a null key or one that repeats.
    Null text is one empty line, and empty keys never go.  An empty table
    gives no rows.  Other columns stay as they are.
    """
    spark = docs.sparkSession
    size = total(docs, F.octet_length(text))
    buckets = 1 << max(3, math.ceil(math.log2(size / bucket_bytes))) if size else 8
    runs = LineRuns(spark, min_documents, buckets, fanout)
    runs.add_in_batches(docs, F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(batches)), batches, text)
    common = runs.common()
    runs.release()
    return without_lines(docs, common, key, text)
