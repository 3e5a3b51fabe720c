"""Column-level helpers shared by the operators (all stay inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tribunal.functions import rules

NUMERIC = "numeric"
CATEGORICAL = "categorical"
UNSUPPORTED = "unsupported"

_CATEGORICAL_TYPES = (
    T.StringType, T.VarcharType, T.CharType, T.BooleanType,
    T.DateType, T.TimestampType, T.TimestampNTZType,
)


def kind_of(dtype: T.DataType) -> str:
    """Numeric, categorical or unsupported (arrays, maps, structs, binary)."""
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, _CATEGORICAL_TYPES):
        return CATEGORICAL
    return UNSUPPORTED


def name(column: str) -> Column:
    """Reference a column by its literal name, dots and spaces included."""
    return F.col("`" + column.replace("`", "``") + "`")


def numeric_value(column: str, dtype: T.DataType) -> Column:
    """Column as double with NaN turned into null."""
    value = name(column).cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = F.when(F.isnan(value), F.lit(None)).otherwise(value)
    return value


def category_text(column: str, dtype: T.DataType) -> Column:
    """Column as text; booleans read ``True``/``False``; null stays null."""
    text = name(column).cast("string")
    return F.initcap(text) if isinstance(dtype, T.BooleanType) else text


def present_value(column: str, dtype: T.DataType) -> Column:
    """The value used to decide whether a cell is missing."""
    kind = kind_of(dtype)
    if kind == NUMERIC:
        return numeric_value(column, dtype)
    if kind == CATEGORICAL:
        return category_text(column, dtype)
    return name(column)


def label_text(column: str, dtype: T.DataType) -> Column:
    """Text of a class label: text order decides the class code."""
    if kind_of(dtype) == NUMERIC:
        return numeric_value(column, dtype).cast("string") if isinstance(
            dtype, (T.FloatType, T.DoubleType)) else name(column).cast("string")
    return category_text(column, dtype)


def category_code(text: Column, categories: list[str]) -> Column:
    """Position of ``text`` in the sorted category list; -1 when unseen."""
    known = F.array(*[F.lit(c) for c in categories])
    filled = F.coalesce(text, F.lit(rules.MISSING_CATEGORY))
    return (F.array_position(known, filled) - 1).cast("int")


def banded(value: Column, bands: list[tuple[float, object]], otherwise: object) -> Column:
    """First band whose upper bound is not exceeded."""
    chain = None
    for upper, result in bands:
        test = value <= F.lit(float(upper))
        chain = F.when(test, F.lit(result)) if chain is None else chain.when(test, F.lit(result))
    return chain.otherwise(F.lit(otherwise))


def signal_level(score: Column, top: Column) -> Column:
    """high / medium / low / none by share of the best score."""
    share = F.try_divide(score, top)
    return (
        F.when(top == 0, "none")
        .when(share >= rules.SIGNAL_HIGH, "high")
        .when(share >= rules.SIGNAL_MEDIUM, "medium")
        .when(share > 0, "low")
        .otherwise("none")
    )


def long_form(df: DataFrame, keep: list[str], values: dict[str, Column], key: str, value: str) -> DataFrame:
    """Unpivot ``values`` (one row per entry).

    The rows are produced by a generator ahead of whatever aggregates them, so
    a following ``groupBy`` still combines on the map side.
    """
    entries = F.array(*[
        F.struct(F.lit(label).alias(key), expr.alias(value)) for label, expr in values.items()
    ])
    return df.select(*[name(c) for c in keep], F.inline(entries))
