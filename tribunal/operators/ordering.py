"""Order-based primitives that never sort a whole group in one task.

``Window.partitionBy(label).orderBy(x)`` puts a class holding half of all rows
into one task, and ``median`` keeps every distinct value of a column in one
aggregation buffer.  Both are replaced here by exact multi-pass forms.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tribunal.functions.columns import name
from tribunal.session import freeze

ROWS_PER_BUCKET = 50_000
EXACT_MEDIAN_ROWS = 1_000_000
_ACCURACY = 10_000


def _with_offset(rows: DataFrame, offsets: DataFrame, groups: list[str], part: str) -> DataFrame:
    """Add the offset of each row's part; a null group is a group too."""
    keys = {c: f"_of_{i}" for i, c in enumerate([*groups, part])}
    renamed = offsets.select(*[name(c).alias(alias) for c, alias in keys.items()], "_offset")
    match = F.col(part) == F.col(keys[part])
    for c in groups:
        match = match & name(c).eqNullSafe(F.col(keys[c]))
    return rows.join(renamed, match, "inner").drop(*keys.values())


def earlier_sums(totals: DataFrame, groups: list[str], part: str, coarse: Column, value: str) -> DataFrame:
    """Replace ``value`` by ``_offset``, its sum over the earlier parts of the group.

    ``totals`` has one row per group and part.  ``coarse`` maps runs of
    neighbouring parts to one value and keeps their order: sums go first over
    these runs, then inside each, so no window holds all parts of a group.
    """
    keys = [name(c) for c in groups]
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cut = totals.withColumn("_coarse", coarse)
    runs = (
        cut.groupBy(*keys, "_coarse").agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.coalesce(
            F.sum("_sum").over(ahead(Window.partitionBy(*keys).orderBy("_coarse"))), F.lit(0)))
        .drop("_sum")
    )
    inside = cut.withColumn("_inside", F.coalesce(
        F.sum(value).over(ahead(Window.partitionBy(*keys, "_coarse").orderBy(part))), F.lit(0)))
    return _with_offset(inside, runs, groups, "_coarse").withColumn(
        "_offset", F.col("_offset") + F.col("_inside")).drop("_coarse", "_inside", value)


def spread_row_number(
    df: DataFrame, groups: list[str], ordering: list[str], output: str, n_rows: int
) -> DataFrame:
    """Row number (from 0) inside ``groups``, ordered by an md5 of ``ordering``.

    The leading hex digits of the md5 split every group into buckets of equal
    expected size, so the number of a row is (rows in earlier buckets) + (rank
    inside its bucket): the same result as one window over the group.
    """
    digest = F.md5(F.concat_ws("#", *[name(c).cast("string") for c in ordering]))
    digits = max(0, math.ceil(math.log(max(n_rows, 1) / ROWS_PER_BUCKET, 16)))
    keyed = df.withColumn("_digest", digest).withColumn(
        "_bucket", F.substring("_digest", 1, digits) if digits else F.lit("")
    )
    keys = [*groups, "_bucket"]
    inside = Window.partitionBy(*[name(c) for c in keys]).orderBy("_digest", *[name(c) for c in ordering])
    if not digits:
        ranked = keyed.withColumn(output, F.row_number().over(inside).cast("long") - 1)
        return ranked.drop("_digest", "_bucket")
    counts = keyed.groupBy(*[name(c) for c in keys]).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = earlier_sums(counts, groups, "_bucket", F.substring("_bucket", 1, max(0, digits - 3)), "_rows")
    return (
        keyed.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
        .transform(_with_offset, offsets, groups, "_bucket")
        .withColumn(output, F.col("_offset") + F.col("_rank"))
        .drop("_digest", "_bucket", "_rank", "_offset")
    )


def sorted_row_number(
    df: DataFrame, groups: list[str], ordering: list[str], output: str
) -> DataFrame:
    """Row number (from 0) inside ``groups`` in the order of ``ordering``.

    A range partitioning on (groups, ordering) gives each task one slice; the
    slice counts give the offsets.  The slices are frozen because their
    boundaries come from a sample.  ``ordering`` must identify a row, or equal
    rows all land in one slice.
    """
    keys = [name(c) for c in groups]
    sliced = freeze(
        df.repartitionByRange(*keys, *[name(c) for c in ordering])
        .withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*[name(c) for c in ordering])
    return (
        sliced.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
        .transform(_with_offset, offsets, groups, "_slice")
        .withColumn(output, F.col("_offset") + F.col("_rank"))
        .drop("_slice", "_rank", "_offset")
    )


@dataclass
class _Bracket:
    """Open interval known to hold the wanted rank."""

    column: str
    rank: int
    inside: int
    before: int = 0
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = name(self.column)
        test = value.isNotNull()
        if self.low is not None:
            test = test & (value > F.lit(self.low))
        if self.high is not None:
            test = test & (value < F.lit(self.high))
        return test


def order_statistics(
    df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int], accuracy: int = _ACCURACY
) -> dict[tuple[str, int], float]:
    """Exact values at the given 0-based ranks of double columns.

    Each round narrows the open interval around a rank with a mergeable
    quantile sketch and then counts the rows around its ends exactly, so one
    round cuts the candidates by a factor of about ``accuracy / 4``.  Only fixed
    size buffers are shuffled; a value held by many rows becomes an interval
    end and is settled by its count.
    """
    found: dict[tuple[str, int], float] = {}
    open_brackets = [
        _Bracket(column, rank, counts[column])
        for column, wanted in ranks.items() for rank in sorted(set(wanted))
    ]
    while open_brackets:
        # ranks still in the same interval share its sketch
        shared: dict[tuple, list[_Bracket]] = {}
        for b in open_brackets:
            shared.setdefault((b.column, b.low, b.high), []).append(b)
        sketches, positions = [], []
        for group in shared.values():
            ends = []
            for b in group:
                centre, margin = (b.rank - b.before + 0.5) / b.inside, 2.0 / accuracy
                positions.append((b, f"s{len(sketches)}", len(ends)))
                ends += [max(0.0, centre - margin), min(1.0, centre + margin)]
            value = F.when(group[0].holds(), name(group[0].column))
            sketches.append(F.percentile_approx(value, ends, accuracy).alias(f"s{len(sketches)}"))
        row = df.agg(*sketches).first()
        tried = [(b, row[sketch][i], row[sketch][i + 1]) for b, sketch, i in positions]
        counters = []
        for i, (b, low, high) in enumerate(tried):
            value, within = name(b.column), b.holds()
            for tag, test in (
                ("a", value < F.lit(low)), ("b", value == F.lit(low)),
                ("c", (value > F.lit(low)) & (value < F.lit(high))),
                ("d", (value == F.lit(high)) & F.lit(high != low)),
            ):
                counters.append(F.count_if(within & test).alias(f"{tag}{i}"))
        row = df.agg(*counters).first()
        open_brackets = []
        for i, (b, low, high) in enumerate(tried):
            below, at_low, middle, at_high = (row[f"{t}{i}"] for t in "abcd")
            position = b.rank - b.before
            if position < below:
                open_brackets.append(_Bracket(b.column, b.rank, below, b.before, b.low, low))
            elif position < below + at_low:
                found[b.column, b.rank] = low
            elif position < below + at_low + middle:
                open_brackets.append(_Bracket(
                    b.column, b.rank, middle, b.before + below + at_low, low, high))
            elif position < below + at_low + middle + at_high:
                found[b.column, b.rank] = high
            else:
                passed = below + at_low + middle + at_high
                open_brackets.append(_Bracket(
                    b.column, b.rank, b.inside - passed, b.before + passed, high, b.high))
    return found


def medians(df: DataFrame, counts: dict[str, int]) -> dict[str, float]:
    """Exact medians (mean of the middle two for an even count)."""
    columns = [c for c, n in counts.items() if n]
    if not columns:
        return {}
    if max(counts.values()) <= EXACT_MEDIAN_ROWS:
        row = df.agg(*[F.median(name(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return {c: row[f"m{i}"] for i, c in enumerate(columns)}
    middle = {c: [(counts[c] - 1) // 2, counts[c] // 2] for c in columns}
    values = order_statistics(df, middle, {c: counts[c] for c in columns})
    return {c: (values[c, lo] + values[c, hi]) / 2 for c, (lo, hi) in middle.items()}
