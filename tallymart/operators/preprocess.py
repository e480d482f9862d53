"""Preprocessing of raw tables: null tokens, types, text, categories. Each step is one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions import columns as C
from tallymart.operators.digests import repeat_figures
from tallymart.specs import NULL_TOKENS, RETAIL, DatasetSpec


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _apply(df: DataFrame, names: list[str], f: Callable[[Column], Column]) -> DataFrame:
    names = [n for n in names if n in df.columns]
    return df.withColumns({n: f(F.col(n)) for n in names}) if names else df


def normalize_nulls(df: DataFrame, names: list[str] | None = None, tokens: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    return _apply(df, [n for n in _text_columns(df) if names is None or n in names], lambda c: C.null_if_token(c, tokens))


def normalize_text(df: DataFrame, names: list[str] | None = None, lowercase: bool = False) -> DataFrame:
    return _apply(df, [n for n in _text_columns(df) if names is None or n in names], lambda c: C.clean_text(c, lowercase))


def normalize_categories(df: DataFrame, names: list[str], lowercase: bool = True) -> DataFrame:
    return normalize_text(df, names, lowercase)


def parse_timestamps(df: DataFrame, names: list[str]) -> DataFrame:
    return _apply(df, [n for n in names if n in _text_columns(df)], C.to_timestamp)


def convert_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    return _apply(df, names, C.to_number)


def convert_integer(df: DataFrame, names: list[str]) -> DataFrame:
    return _apply(df, names, C.to_integer)


def normalize_dtypes(df: DataFrame, datetime: list[str] = (), numeric: list[str] = (), integer: list[str] = (), string: list[str] = ()) -> DataFrame:
    out = convert_integer(convert_numeric(parse_timestamps(df, list(datetime)), list(numeric)), list(integer))
    return _apply(out, list(string), lambda c: c.cast("string"))


def preprocess_dataframe(df: DataFrame, spec: DatasetSpec, lowercase_categories: bool = True, strict_nulls: bool = False) -> DataFrame:
    """Null tokens, then types, then text, then categories. A blank string of three spaces so becomes an empty one;
    ``strict_nulls`` looks for null tokens once more after trimming."""
    out = normalize_nulls(df)
    out = normalize_dtypes(out, spec.of_type("datetime"), spec.of_type("numeric"), spec.of_type("integer"), spec.of_type("string"))
    out = normalize_text(out, [c for c in spec.of_type("string") if c not in spec.categorical])
    out = normalize_categories(out, list(spec.categorical), lowercase_categories)
    return normalize_nulls(out) if strict_nulls else out


def preprocess_dataset(df: DataFrame, name: str, specs: dict[str, DatasetSpec] = RETAIL, **more) -> DataFrame:
    if name not in specs:
        raise ValueError(f"no such dataset: {name}")
    return preprocess_dataframe(df, specs[name], **more)


def _unpivot(df: DataFrame, amounts: dict[str, Column], rows: Callable[[str], dict[str, Column]]) -> DataFrame:
    """One aggregate, one row for each column of the table."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *(c.alias(n) for n, c in amounts.items()))
    structs = [F.struct(F.lit(c).alias("column"), *(v.alias(k) for k, v in rows(c).items())) for c in df.columns]
    return one.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def missing(df: DataFrame, c: str) -> Column:
    """Null or NaN."""
    col = F.col(f"`{c}`")
    kind = df.schema[c].dataType
    return col.isNull() | F.isnan(col) if isinstance(kind, T.DoubleType | T.FloatType) else col.isNull()


def dtype_summary(df: DataFrame) -> DataFrame:
    """(column, dtype, null_count)."""
    kinds = dict(df.dtypes)
    return _unpivot(df, {f"m_{c}": F.count_if(missing(df, c)) for c in df.columns}, lambda c: {"dtype": F.lit(kinds[c]), "null_count": F.col(f"m_{c}")})


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_rate) with the rate as a share of rows, four digits."""
    rate = lambda c: F.coalesce(F.round(F.try_divide(F.col(f"m_{c}").cast("double"), F.col("__n").cast("double")), 4), F.lit(0.0))
    return _unpivot(df, {f"m_{c}": F.count_if(missing(df, c)) for c in df.columns}, lambda c: {"missing_count": F.col(f"m_{c}"), "missing_rate": rate(c)})


def duplicate_summary(df: DataFrame) -> DataFrame:
    """(total_rows, participating_rows, excess_rows, duplicate_groups) of whole rows."""
    return repeat_figures(df).select("total_rows", "participating_rows", "excess_rows", "duplicate_groups")


def standardise_codes(df: DataFrame, names: list[str]) -> DataFrame:
    return _apply(df, names, C.code)


def blanks_to_null(df: DataFrame, names: list[str], lowercase: bool = True) -> DataFrame:
    return _apply(df, names, lambda c: C.blank_to_null(c, lowercase))
