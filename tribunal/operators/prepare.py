"""Cleaning, encoding and scaling of a feature table.

``fit_preparation`` reads the table in at most three aggregate jobs and keeps
only fixed-size parameters; ``Preparation.apply`` is then a plain projection
that Catalyst fuses with the scan, usable on training rows, on new rows and on
a stream alike.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tribunal.functions import rules
from tribunal.functions.columns import (
    CATEGORICAL, NUMERIC, UNSUPPORTED, category_code, category_text, kind_of, label_text,
    long_form, name, numeric_value, present_value,
)
from tribunal.operators.ordering import medians, sorted_row_number
from tribunal.operators.refit import GrowthParams, growth_params, scaled_as_grown

# An estimate above this bound proves more than MAX_CATEGORIES distinct values:
# the sketch has 512 registers and n values fill at most n of them, so its
# linear count never exceeds 512 * ln(512 / (512 - n)) = 20.4 for n = 20.
_SKETCH_ERROR = 0.05
_SKETCH_LIMIT = rules.MAX_CATEGORIES + 2
_LITERAL_CLASSES = 256


@dataclass(frozen=True)
class NumericParams:
    median: float
    mean: float
    std: float
    missing: int


@dataclass(frozen=True)
class CategoryParams:
    categories: list[str]
    mode: str
    n_values: int | None = None     # distinct values without the one that stands for missing cells


@dataclass
class Preparation:
    """Fitted parameters of one table, plus the log of decisions."""

    target: str
    problem_type: str
    features: list[str]
    numeric: dict[str, NumericParams]
    categorical: dict[str, CategoryParams]
    types: dict[str, T.DataType]
    original: list[str]
    n_rows: int
    steps: list[dict] = field(default_factory=list)
    growth: dict[str, GrowthParams] = field(default_factory=dict)

    def encoded(self, feature: str, unseen: str = "keep") -> Column:
        """Imputed and scaled number, or category code, as double.

        ``unseen='insert'`` gives an unknown category the code it would have
        had, were it known: the number of known categories below it.
        ``'refit'`` prepares every row as if it were the last row of the
        training table: median, mean and deviation include it, and an unknown
        category beyond the category limit drops the column, which is then 0.
        """
        dtype = self.types[feature]
        if feature in self.numeric:
            p = self.numeric[feature]
            if unseen == "refit":
                if feature not in self.growth:
                    raise ValueError(f"Scoring with unseen='refit' needs with_growth: nothing is known about '{feature}'.")
                return scaled_as_grown(numeric_value(feature, dtype), p, self.growth[feature])
            filled = F.coalesce(numeric_value(feature, dtype), F.lit(p.median))
            return (filled - F.lit(p.mean)) / F.lit(p.std or 1.0)
        categories = self.categorical[feature].categories
        text = category_text(feature, dtype)
        code = category_code(text, categories)
        if unseen in ("insert", "refit"):
            filled = F.coalesce(text, F.lit(rules.MISSING_CATEGORY))
            below = sum((F.when(filled > F.lit(c), 1).otherwise(0) for c in categories), F.lit(0))
            beyond = unseen == "refit" and self.categorical[feature].n_values == rules.MAX_CATEGORIES
            code = F.when(self._unknown(feature, text), 0 if beyond else below).otherwise(code)
        return code.cast("double")

    def _unknown(self, feature: str, text: Column) -> Column:
        """Whether a category is none of the training values.

        Missing cells share their code with a text that reads like them, but
        that text is a value of its own when values are counted.
        """
        p = self.categorical[feature]
        filled = F.coalesce(text, F.lit(rules.MISSING_CATEGORY))
        unknown = category_code(text, p.categories) < 0
        if p.n_values == rules.MAX_CATEGORIES and len(p.categories) > p.n_values:
            unknown = unknown | (text.isNotNull() & (filled == rules.MISSING_CATEGORY))
        return unknown

    def apply(self, df: DataFrame, keep: list[str] = (), unseen: str = "keep") -> DataFrame:
        """Project ``keep`` and every prepared feature."""
        return df.select(
            *[name(c) for c in keep],
            *[self.encoded(f, unseen).alias(f) for f in self.features],
        )

    def params_frame(self, spark: SparkSession) -> DataFrame:
        rows = []
        for i, f in enumerate(self.features):
            p = self.numeric.get(f)
            rows.append((i, f, NUMERIC if p else CATEGORICAL,
                         p.median if p else None, p.mean if p else None, p.std if p else None,
                         None if p else self.categorical[f].mode))
        return spark.createDataFrame(
            rows, "ordinal long, feature string, kind string, median double, mean double, std double, mode string")

    def categories_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f, c, code) for f, p in self.categorical.items() for code, c in enumerate(p.categories)]
        return spark.createDataFrame(rows, "feature string, category string, code int")

    def log_frame(self, spark: SparkSession) -> DataFrame:
        return decision_log(spark, "preprocessing", self.steps)


def decision_log(spark: SparkSession, phase: str, steps: list[dict]) -> DataFrame:
    """Ordered decisions of one phase; the detail is JSON text."""
    rows = [
        (i + 1, phase, s["step"], s["rule"], json.dumps(
            {k: v for k, v in s.items() if k not in ("step", "rule")}, ensure_ascii=False))
        for i, s in enumerate(steps)
    ]
    return spark.createDataFrame(rows, "seq int, phase string, step string, rule string, detail string")


def feature_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, missing cells and their ratio."""
    types = {f.name: f.dataType for f in df.schema.fields}
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if(present_value(c, types[c]).isNull()).alias(f"_m{i}") for i, c in enumerate(columns)
    ])
    entries = F.array(*[
        F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(c).alias("feature"),
                 F.col(f"_m{i}").alias("n_missing"), F.col("_n").alias("n_rows"))
        for i, c in enumerate(columns)
    ])
    return wide.select(F.inline(entries)).withColumn(
        "missing_ratio", F.coalesce(F.try_divide(F.col("n_missing"), F.col("n_rows")), F.lit(0.0)))


def missing_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    return missing_counts(df, columns).select("feature", "missing_ratio")


def drop_high_missing(df: DataFrame, columns: list[str], limit: float = rules.MAX_MISSING_RATIO) -> DataFrame:
    """The table without columns whose missing ratio exceeds ``limit``."""
    rows = missing_counts(df, columns).filter(F.col("missing_ratio") > limit).collect()
    return df.drop(*[r["feature"] for r in rows])


def classify_columns(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Column names by kind, table order kept."""
    kinds: dict[str, list[str]] = {NUMERIC: [], CATEGORICAL: [], UNSUPPORTED: []}
    for c in columns:
        kinds[kind_of(df.schema[c].dataType)].append(c)
    return kinds


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (feature, category) of text-like columns; nulls not counted."""
    texts = {c: category_text(c, df.schema[c].dataType) for c in columns}
    return (
        long_form(df, [], texts, "feature", "category")
        .filter(F.col("category").isNotNull())
        .groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n_rows"))
    )


def cardinality_report(df: DataFrame, columns: list[str], limit: int = rules.MAX_CATEGORIES) -> DataFrame:
    """Exact distinct count of every text-like column and the keep/drop decision."""
    texts = {c: category_text(c, df.schema[c].dataType) for c in columns}
    return (
        long_form(df, [], texts, "feature", "category")
        .groupBy("feature").agg(F.countDistinct("category").alias("n_categories"))
        .withColumn("decision", F.when(F.col("n_categories") > limit, "dropped").otherwise("kept"))
    )


def low_cardinality(df: DataFrame, columns: list[str]) -> tuple[dict[str, dict[str, int]], list[str]]:
    """Category counts of columns within the limit, and the columns beyond it.

    A fixed-size sketch removes the clearly unbounded columns first, so their
    values are never shuffled; the rest are counted exactly.
    """
    if not columns:
        return {}, []
    row = df.agg(*[
        F.approx_count_distinct(category_text(c, df.schema[c].dataType), _SKETCH_ERROR).alias(f"d{i}")
        for i, c in enumerate(columns)
    ]).first()
    return _exact_categories(df, [c for i, c in enumerate(columns) if row[f"d{i}"] <= _SKETCH_LIMIT], columns)


def _exact_categories(df, candidates, columns):
    counts: dict[str, dict[str, int]] = {c: {} for c in candidates}
    if candidates:
        for r in category_counts(df, candidates).collect():
            counts[r["feature"]][r["category"]] = r["n_rows"]
    kept = {c: v for c, v in counts.items() if len(v) <= rules.MAX_CATEGORIES}
    return kept, [c for c in columns if c not in kept]


def _with_imputed(count: int, mean: float, variance: float, missing: int, fill: float) -> tuple[float, float]:
    """Mean and population deviation after ``missing`` cells became ``fill``."""
    if not missing:
        return mean, math.sqrt(variance)
    total = count + missing
    both = mean + (fill - mean) * missing / total
    pooled = (count * (variance + (mean - both) ** 2) + missing * (fill - both) ** 2) / total
    return both, math.sqrt(pooled)


def fit_preparation(
    df: DataFrame, target: str, problem_type: str, exclude: list[str] = ()
) -> Preparation:
    """Decide what to keep and fit the parameters; order of rules is fixed.

    Drop high-missing, then high-cardinality columns; impute medians; encode
    categories; scale.  Constant columns divide by 1.
    """
    original = feature_columns(df, [target, *exclude])
    types = {c: df.schema[c].dataType for c in original}
    kinds = classify_columns(df, original)
    usable = [c for c in original if c not in kinds[UNSUPPORTED]]
    steps = [{
        "step": "Target Separation", "rule": f"Removed '{target}' from feature matrix.",
        "columns_before": [*original, target], "columns_after": original,
    }]
    if kinds[UNSUPPORTED]:
        steps.append({
            "step": "Drop Unsupported Types", "rule": "Features must be numbers, text, booleans or dates.",
            "dropped": kinds[UNSUPPORTED],
        })

    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(usable):
        value = present_value(c, types[c])
        aggregates.append(F.count(value).alias(f"c{i}"))
        if c in kinds[NUMERIC]:
            aggregates += [F.avg(value).alias(f"a{i}"), F.var_pop(value).alias(f"v{i}")]
        else:
            aggregates.append(F.approx_count_distinct(value, _SKETCH_ERROR).alias(f"d{i}"))
    stats = df.agg(*aggregates).first()
    n = stats["n"]
    index = {c: i for i, c in enumerate(usable)}

    high_missing = [c for c in usable if n and (n - stats[f"c{index[c]}"]) / n > rules.MAX_MISSING_RATIO]
    if high_missing:
        steps.append({
            "step": "Mostly Missing Columns",
            "rule": f"Drop if more than {rules.MAX_MISSING_RATIO:.0%} missing.", "dropped": high_missing,
        })
    numeric_cols = [c for c in kinds[NUMERIC] if c not in high_missing]
    text_cols = [c for c in kinds[CATEGORICAL] if c not in high_missing]

    screened = [c for c in text_cols if stats[f"d{index[c]}"] <= _SKETCH_LIMIT]
    counts, high_card = _exact_categories(df, screened, text_cols)
    if high_card:
        steps.append({
            "step": "Columns of Many Categories",
            "rule": f"Drop if more than {rules.MAX_CATEGORIES} distinct values.", "dropped": high_card,
        })

    present = {c: stats[f"c{index[c]}"] for c in numeric_cols}
    values = df.select(*[numeric_value(c, types[c]).alias(c) for c in numeric_cols])
    middle = medians(values, present) if numeric_cols else {}
    numeric: dict[str, NumericParams] = {}
    for c in numeric_cols:
        i, missing = index[c], n - present[c]
        mean, std = _with_imputed(present[c], stats[f"a{i}"], stats[f"v{i}"], missing, middle[c])
        numeric[c] = NumericParams(middle[c], mean, std, missing)
    categorical = {}
    for c, seen in counts.items():
        known = set(seen)
        if sum(seen.values()) < n:
            known.add(rules.MISSING_CATEGORY)
        mode = min(seen, key=lambda v: (-seen[v], v)) if seen else rules.MISSING_CATEGORY
        categorical[c] = CategoryParams(sorted(known), mode, len(seen))

    imputed = {c: p.median for c, p in numeric.items() if p.missing}
    if imputed:
        steps.append({"step": "Median Imputation", "rule": "Fill missing numbers with the column median.",
                      "medians": imputed})
    if categorical:
        steps.append({"step": "Label Encoding", "rule": "Categories in text order become 0, 1, 2, …",
                      "categories": {c: p.categories for c, p in categorical.items()}})
    if numeric:
        steps.append({"step": "Feature Scaling", "rule": "Zero mean, unit population deviation.",
                      "columns": list(numeric)})
    return Preparation(
        target, problem_type, [c for c in original if c in numeric or c in categorical],
        numeric, categorical, types, original, n, steps)


def with_growth(df: DataFrame, preparation: Preparation) -> Preparation:
    """The preparation with what ``unseen='refit'`` needs; ``df`` is the table it was fitted on."""
    return replace(preparation, growth=growth_params(df, preparation))


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill missing numbers with the exact column median."""
    types = {c: df.schema[c].dataType for c in columns}
    values = df.select(*[numeric_value(c, types[c]).alias(c) for c in columns])
    counts = values.agg(*[F.count(name(c)).alias(c) for c in columns]).first().asDict()
    middle = medians(values, counts)
    return df.withColumns({
        c: F.coalesce(numeric_value(c, types[c]), F.lit(middle.get(c)).cast("double")) for c in columns
    })


def label_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each category by its position in text order; missing is ``'nan'``.

    Columns must be within the category limit (``low_cardinality`` checks it).
    """
    counts, beyond = low_cardinality(df, columns)
    if beyond:
        raise ValueError(f"Too many categories to encode: {beyond}")
    nulls = df.agg(*[
        F.count_if(name(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)
    ]).first()
    encoded = {}
    for i, c in enumerate(columns):
        known = set(counts[c]) | ({rules.MISSING_CATEGORY} if nulls[f"n{i}"] else set())
        encoded[c] = category_code(category_text(c, df.schema[c].dataType), sorted(known))
    return df.withColumns(encoded)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    types = {c: df.schema[c].dataType for c in columns}
    row = df.agg(*[
        agg for i, c in enumerate(columns) for agg in (
            F.avg(numeric_value(c, types[c])).alias(f"a{i}"),
            F.stddev_pop(numeric_value(c, types[c])).alias(f"s{i}"))
    ]).first()
    return df.withColumns({
        c: (numeric_value(c, types[c]) - F.lit(row[f"a{i}"])) / F.lit(row[f"s{i}"] or 1.0)
        for i, c in enumerate(columns)
    })


def class_codes(df: DataFrame, target: str) -> DataFrame:
    """(label, code): class labels in text order numbered from 0, any count."""
    text = label_text(target, df.schema[target].dataType)
    labels = df.select(text.alias("label")).filter(F.col("label").isNotNull()).distinct()
    head = labels.limit(_LITERAL_CLASSES + 1).collect()
    if len(head) <= _LITERAL_CLASSES:
        ordered = sorted(r["label"] for r in head)
        return df.sparkSession.createDataFrame(
            [(label, i) for i, label in enumerate(ordered)], "label string, code long")
    return sorted_row_number(labels, [], ["label"], "code").select("label", "code")


def encode_target(df: DataFrame, target: str, output: str = "label") -> tuple[DataFrame, DataFrame]:
    """Add the class code as double (null for a null target); also return the (label, code) table.

    The codes of few classes are literals; otherwise a join whose strategy is
    left to the optimizer and whose hot labels are split by adaptive execution.
    """
    text = label_text(target, df.schema[target].dataType)
    codes = class_codes(df, target)
    head = codes.limit(_LITERAL_CLASSES + 1).collect()
    if len(head) <= _LITERAL_CLASSES:
        ordered = [r["label"] for r in sorted(head, key=lambda r: r["code"])]
        position = F.array_position(F.array(*[F.lit(v) for v in ordered]), text) - 1
        return df.withColumn(output, position.cast("double")), codes
    renamed = codes.select(F.col("label").alias("_class_text"), F.col("code").cast("double").alias(output))
    joined = df.withColumn("_own_text", text).join(renamed, F.col("_own_text") == F.col("_class_text"), "left")
    return joined.drop("_own_text", "_class_text"), codes


def cast_target(df: DataFrame, target: str, output: str = "label") -> DataFrame:
    """Add the regression target as double."""
    return df.withColumn(output, numeric_value(target, df.schema[target].dataType))
