"""Profiles of tables. Amounts of one table come from one aggregate over all its columns, then turn into rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.functions.columns import percent
from tallymart.operators import sketches
from tallymart.operators.checks import unmatched
from tallymart.operators.digests import repeat_figures, repeated_rows
from tallymart.operators.preprocess import missing

NULL_LABEL = "[NULL]"


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rows(one: DataFrame, structs: list[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def column_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column, dtype, missing, missing_pct, distinct_values). Distinct values are counted exactly, or estimated from
    sketches (``approximate``: one scan for all columns; see ``sketches`` for the error)."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(missing(df, c)).alias(f"m_{c}") for c in df.columns))
    rows = _rows(one, [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.col(f"m_{c}").alias("missing"), percent(F.col(f"m_{c}"), F.col("n"), 2).alias("missing_pct")) for c in df.columns])
    counts = sketches.estimates(sketches.distinct_sketches(df)).drop("rows") if approximate else sketches.distinct_counts(df)
    return rows.join(F.broadcast(counts), "column")  # a row a column


def null_profile(df: DataFrame) -> DataFrame:
    """(column, null_count, total_rows, non_null_count, null_pct)."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(missing(df, c)).alias(f"m_{c}") for c in df.columns))
    return _rows(one, [F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("null_count"), F.col("n").alias("total_rows"), (F.col("n") - F.col(f"m_{c}")).alias("non_null_count"), percent(F.col(f"m_{c}"), F.col("n"), 4).alias("null_pct")) for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


#: Buckets to a unit of the logarithm, and equal parts of a bucket, by which exact quantiles close in on their values.
PER_LOG, PARTS = 4096, 4096
QUARTERS = (0.25, 0.5, 0.75)


def _earlier(amount: str, by: tuple[str, ...], order: str) -> Column:
    """The sum of an amount over what comes before in a group."""
    return F.coalesce(F.sum(amount).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _holding(df: DataFrame) -> DataFrame:
    """Those rows in whose ``n`` places after ``before`` a wanted rank lies, with these ranks only."""
    at, n = F.col("before"), F.col("n")
    return df.withColumn("ranks", F.filter("ranks", lambda r: (r >= at) & (r < at + n))).filter(F.size("ranks") > 0)


def quantiles(df: DataFrame, columns: list[str], marks: tuple[float, ...] = QUARTERS) -> DataFrame:
    """One row, ``__q``: a map from column to its exact quantiles by linear interpolation (NaN is the largest value).
    A column without any value is not in it.

    Equal values are counted together first. Counts of buckets by logarithm tell which bucket holds a wanted rank, counts
    of equal parts of that bucket which part, and only values of that part are put in order. So no buffer holds the
    distinct values of a column; windows see at most some 3 million buckets of a column, and what is broadcast are at
    most two ranges for each mark and column.
    """
    x = F.col("x")
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")).select("v.*").filter("x IS NOT NULL")
    by_size = F.floor(F.signum(x) * F.log1p(F.abs(x) * 2.0**20) * PER_LOG)
    bucket = F.when(F.isnan(x) | (x == float("inf")), F.lit(2**40)).when(x == float("-inf"), F.lit(-(2**40))).otherwise(by_size)
    counts = pairs.groupBy("c", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("b", bucket)

    buckets = counts.groupBy("c", "b").agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    placed = buckets.withColumns({"before": _earlier("n", ("c",), "b"), "all": F.sum("n").over(Window.partitionBy("c"))})
    place = [(F.col("all") - 1) * F.lit(m) for m in marks]
    wanted = placed.withColumn("ranks", F.array_distinct(F.array(*(f(p) for p in place for f in (F.floor, F.ceil)))))
    inside = counts.join(F.broadcast(_holding(wanted).drop("n")), ["c", "b"])
    inside = inside.withColumn("p", F.coalesce(F.floor(F.try_divide(x - F.col("lo"), F.col("hi") - F.col("lo")) * PARTS), F.lit(0)))

    parts = inside.groupBy("c", "b", "p").agg(F.sum("n").alias("n"), F.first("before").alias("base"), F.first("ranks").alias("ranks"))
    parts = _holding(parts.withColumn("before", F.col("base") + _earlier("n", ("c", "b"), "p"))).select("c", "b", "p", F.col("before").alias("base"), "ranks")
    last = inside.select("c", "b", "p", "x", "n", "all").join(F.broadcast(parts), ["c", "b", "p"])
    found = _holding(last.withColumn("before", F.col("base") + _earlier("n", ("c", "b", "p"), "x")))
    each = found.select("c", "all", "x", F.explode("ranks").alias("rank")).groupBy("c").agg(F.first("all").alias("all"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def between(p: Column) -> Column:
        low, high = F.floor(p), F.ceil(p)
        a, b = F.col("at")[low], F.col("at")[high]
        return F.when(a == b, a).otherwise((high - p) * a + (p - low) * b)

    return each.agg(F.map_from_entries(F.collect_list(F.struct("c", F.array(*map(between, place))))).alias("__q"))


def _approximate(x: Column, accuracy: int = 10_000) -> Column:
    """Quartiles with a rank error of 1 / accuracy, by one pass."""
    return F.percentile_approx(x, F.array(*map(F.lit, QUARTERS)), F.lit(accuracy))


def _with_quartiles(df: DataFrame, columns: list[str], amounts: list[Column], exact: bool) -> DataFrame:
    """One row of aggregates, the quartiles of each column among them (``q_`` and its name)."""
    if not exact:
        return df.agg(*amounts, *(_approximate(F.col(c).cast("double")).alias(f"q_{c}") for c in columns))
    return df.agg(*amounts).crossJoin(F.broadcast(quantiles(df, columns))).withColumns({f"q_{c}": F.col("__q")[c] for c in columns})


def numeric_basic(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, min, max, mean, median, std) with the sample deviation."""
    names = columns or numeric_columns(df)
    x = {c: F.col(c).cast("double") for c in names}
    one = _with_quartiles(df, names, [e.alias(f"{k}_{c}") for c in names for k, e in (("min", F.min(x[c])), ("max", F.max(x[c])), ("mean", F.avg(x[c])), ("std", F.stddev_samp(x[c])))], exact)
    return _rows(one, [F.struct(F.lit(c).alias("column"), F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max"), F.col(f"mean_{c}").alias("mean"), F.get(f"q_{c}", F.lit(1)).alias("median"), F.col(f"std_{c}").alias("std")) for c in names])


def _fence(q: Column) -> list[Column]:
    """Quartiles, their distance and the fences 1.5 times that distance beyond them."""
    a, b = F.get(q, F.lit(0)), F.get(q, F.lit(2))
    return [a.alias("q1"), F.get(q, F.lit(1)).alias("median"), b.alias("q3"), (b - a).alias("iqr"), (a - 1.5 * (b - a)).alias("lower_bound"), (b + 1.5 * (b - a)).alias("upper_bound")]


def five_numbers(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """(column, min, q1, median, q3, max, iqr, lower_bound, upper_bound)."""
    x = {c: F.col(c).cast("double") for c in columns}
    one = _with_quartiles(df, columns, [e.alias(f"{k}_{c}") for c in columns for k, e in (("min", F.min(x[c])), ("max", F.max(x[c])))], exact)
    rows = _rows(one, [F.struct(F.lit(c).alias("column"), F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max"), *_fence(F.col(f"q_{c}"))) for c in columns])
    return rows.select("column", "min", "q1", "median", "q3", "max", "iqr", "lower_bound", "upper_bound")


def _with_bounds(df: DataFrame, columns: list[str], exact: bool) -> DataFrame:
    """The table beside its fences: one row, a map from column to bounds."""
    if exact:
        bounds = quantiles(df, columns).select(F.transform_values("__q", lambda _, q: F.struct(*_fence(q))).alias("__b"))
    else:
        one = df.agg(*(_approximate(F.col(c).cast("double")).alias(c) for c in columns))
        bounds = one.select(F.create_map(*(e for c in columns for e in (F.lit(c), F.struct(*_fence(F.col(c)))))).alias("__b"))
    return df.crossJoin(F.broadcast(bounds))


def iqr_outliers(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """(column, lower_bound, upper_bound, potential_outliers, outlier_pct of non-null values)."""
    wide = _with_bounds(df, columns, exact)
    b = lambda c: F.col("__b")[c]
    x = {c: F.col(c).cast("double") for c in columns}
    one = wide.agg(F.first("__b").alias("__b"), *(F.count_if((x[c] < b(c)["lower_bound"]) | (x[c] > b(c)["upper_bound"])).alias(f"o_{c}") for c in columns), *(F.count(c).alias(f"n_{c}") for c in columns))
    return _rows(one, [F.struct(F.lit(c).alias("column"), b(c)["lower_bound"].alias("lower_bound"), b(c)["upper_bound"].alias("upper_bound"), F.col(f"o_{c}").alias("potential_outliers"), percent(F.col(f"o_{c}"), F.col(f"n_{c}"), 2).alias("outlier_pct")) for c in columns])


def outlier_rows(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Rows outside the fences, with the fences."""
    wide, x = _with_bounds(df, [column], exact), F.col(column).cast("double")
    b = F.col("__b")[column]
    return wide.filter((x < b["lower_bound"]) | (x > b["upper_bound"])).withColumns({"lower_bound": b["lower_bound"], "upper_bound": b["upper_bound"]}).drop("__b")


def skewness_g1(x: Column) -> Column:
    """The bias-corrected coefficient; null for fewer than three values. An aggregate."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


# Names of shapes and directions in reports.
SYMMETRIC, MODERATE, HIGH = "Approximately symmetric", "Moderately skewed", "Highly skewed"
RIGHT, LEFT = "Right-skewed", "Left-skewed"


def skew_shape(skew: Column) -> Column:
    size = F.abs(skew)
    return F.when(skew.isNull(), "Undefined").when(size < 0.5, SYMMETRIC).when(size <= 1.0, MODERATE).otherwise(HIGH)


def skew_direction(skew: Column) -> Column:
    """Below the limit of moderate skew there is no direction."""
    return F.when(skew.isNull(), "Undefined").when(F.abs(skew) < 0.5, SYMMETRIC).when(skew > 0, RIGHT).otherwise(LEFT)


def skew_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, skewness, shape, direction)."""
    one = df.agg(*(skewness_g1(F.col(c).cast("double")).alias(f"s_{c}") for c in columns))
    return _rows(one, [F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").alias("skewness"), skew_shape(F.col(f"s_{c}")).alias("shape"), skew_direction(F.col(f"s_{c}")).alias("direction")) for c in columns])


def zero_negative(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, zero_count, negative_count)."""
    one = df.agg(*(e.alias(f"{k}_{c}") for c in columns for k, e in (("z", F.count_if(F.col(c) == 0)), ("g", F.count_if(F.col(c) < 0)))))
    return _rows(one, [F.struct(F.lit(c).alias("column"), F.col(f"z_{c}").alias("zero_count"), F.col(f"g_{c}").alias("negative_count")) for c in columns])


def numeric_profile(df: DataFrame, dataset: str, columns: list[str], exact: bool = True) -> DataFrame:
    """The consolidated profile, 20 columns: two scans, one for the fences and one for all other amounts."""
    wide = _with_bounds(df, columns, exact)
    b = lambda c: F.col("__b")[c]
    amounts = [F.first("__b").alias("__b")]
    for c in columns:
        x = F.col(c).cast("double")
        amounts += [F.count(c).alias(f"n_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}"), F.avg(x).alias(f"mean_{c}"), F.stddev_samp(x).alias(f"std_{c}"), skewness_g1(x).alias(f"s_{c}"), F.count_if((x < b(c)["lower_bound"]) | (x > b(c)["upper_bound"])).alias(f"o_{c}"), F.count_if(x == 0).alias(f"z_{c}"), F.count_if(x < 0).alias(f"g_{c}")]
    rows = []
    for c in columns:
        v = {"count": F.col(f"n_{c}"), "min": F.col(f"min_{c}"), "q1": b(c)["q1"], "median": b(c)["median"], "q3": b(c)["q3"], "max": F.col(f"max_{c}"), "mean": F.col(f"mean_{c}"), "std": F.col(f"std_{c}"), "iqr": b(c)["iqr"], "skewness": F.col(f"s_{c}"), "shape": skew_shape(F.col(f"s_{c}")), "direction": skew_direction(F.col(f"s_{c}"))}
        v |= {"lower_bound": b(c)["lower_bound"], "upper_bound": b(c)["upper_bound"], "potential_outliers": F.col(f"o_{c}"), "outlier_pct": percent(F.col(f"o_{c}"), F.col(f"n_{c}"), 2), "zero_count": F.col(f"z_{c}"), "negative_count": F.col(f"g_{c}")}
        rows.append(F.struct(F.lit(dataset).alias("dataset"), F.lit(c).alias("column"), *(e.alias(k) for k, e in v.items())))
    return _rows(wide.agg(*amounts), rows)


# ---------------------------------------------------------------- categories


def category_frequency(df: DataFrame, column: str, rare_below: float = 1.0) -> DataFrame:
    """(category, frequency, pct, is_rare); null is a category of its own. Only distinct values meet in the share."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(NULL_LABEL)).alias("category")).agg(F.count(F.lit(1)).alias("frequency"))
    total = counts.agg(F.sum("frequency").alias("__total"))
    shared = counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("frequency") * 100.0 / F.col("__total"))
    return shared.select("category", "frequency", F.round("share", 4).alias("pct"), F.when(F.col("share") < rare_below, "YES").otherwise("NO").alias("is_rare"))


def category_summary(df: DataFrame, dataset: str, column: str) -> DataFrame:
    """(dataset, column, unique_categories, top_category, top_frequency, top_pct, rare_categories, rare_category_pct,
    rare_rows, rare_rows_pct); of equally frequent categories the first by name is the top one."""
    f = category_frequency(df, column)
    rare = F.col("is_rare") == "YES"
    one = f.agg(F.count(F.lit(1)).alias("k"), F.sum("frequency").alias("n"), F.min(F.struct((-F.col("frequency")).alias("m"), "category")).alias("top"), F.count_if(rare).alias("r"), F.coalesce(F.sum(F.when(rare, F.col("frequency"))), F.lit(0)).alias("rr"))
    top = -F.col("top.m")
    return one.select(F.lit(dataset).alias("dataset"), F.lit(column).alias("column"), F.col("k").alias("unique_categories"), F.col("top.category").alias("top_category"), top.alias("top_frequency"), percent(top, F.col("n"), 2).alias("top_pct"), F.col("r").alias("rare_categories"), percent(F.col("r"), F.col("k"), 2).alias("rare_category_pct"), F.col("rr").alias("rare_rows"), percent(F.col("rr"), F.col("n"), 2).alias("rare_rows_pct"))


def top_categories(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return category_frequency(df, column).orderBy(F.desc("frequency"), "category").limit(k)


def rare_categories(df: DataFrame, column: str) -> DataFrame:
    return category_frequency(df.filter(F.col(column).isNotNull()), column).filter(F.col("is_rare") == "YES")


def top_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, top_value, frequency, pct of non-null): one grouping over all text columns at once."""
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")).select("p.*").filter(F.col("value").isNotNull())
    counts = pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b"), F.sum("n").alias("all"))
    return best.select("column", F.col("b.value").alias("top_value"), (-F.col("b.m")).alias("frequency"), percent(-F.col("b.m"), F.col("all"), 2).alias("pct"))


# ---------------------------------------------------------------- dates


def date_columns(df: DataFrame, by_name: bool = False) -> list[str]:
    """Columns of a date or time type, or those whose name speaks of a date or timestamp, whatever their type."""
    if by_name:
        return [c for c in df.columns if "date" in c.lower() or "timestamp" in c.lower()]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.DatetimeType)]


def date_stats(df: DataFrame, columns: list[str] | None = None, by_name: bool = False) -> DataFrame:
    """(column, min_date, max_date, missing_count, missing_pct). Text is parsed first; what does not parse is missing."""
    names = columns or date_columns(df, by_name)
    df = df.withColumns({c: F.try_to_timestamp(c).cast("timestamp_ntz") for c in names if isinstance(df.schema[c].dataType, T.StringType)})
    one = df.agg(F.count(F.lit(1)).alias("n"), *(e.alias(f"{k}_{c}") for c in names for k, e in (("lo", F.min(c)), ("hi", F.max(c)), ("m", F.count_if(F.col(c).isNull())))))
    return _rows(one, [F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("min_date"), F.col(f"hi_{c}").alias("max_date"), F.col(f"m_{c}").alias("missing_count"), percent(F.col(f"m_{c}"), F.col("n"), 2).alias("missing_pct")) for c in names])


def date_gaps(df: DataFrame, column: str) -> DataFrame:
    """(gap_start, gap_end, gap_seconds) between neighbouring distinct times.

    Times are dealt by day; a gap inside a day needs its own day only, and one between days the last and first time of
    neighbouring days, which are as many rows as there are days.
    """
    times = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("t")).distinct().withColumn("day", F.to_date("t"))
    inside = times.withColumn("before", F.lag("t").over(Window.partitionBy("day").orderBy("t"))).filter("before IS NOT NULL").select(F.col("before").alias("gap_start"), F.col("t").alias("gap_end"))
    days = times.groupBy("day").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    between = days.withColumn("before", F.lag("last").over(Window.orderBy("day"))).filter("before IS NOT NULL").select(F.col("before").alias("gap_start"), F.col("first").alias("gap_end"))
    seconds = F.timestamp_diff("SECOND", F.col("gap_start").cast("timestamp"), F.col("gap_end").cast("timestamp"))
    return inside.unionByName(between).withColumn("gap_seconds", seconds)


#: Intervals that one is divided into at each step of the search for the largest gaps.
INTERVALS = 4096


def largest_gaps(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k largest gaps (gap_start, gap_end, gap_seconds), of equal ones the earliest, without ordering the times.

    Times fall into equal intervals, which keep their first and last time only. Gaps between neighbouring intervals are
    known then; an interval is divided further only if its own span could hold a gap among the k largest. At most
    INTERVALS rows are ordered together, whether all times lie in one day or not.
    """
    kind = df.schema[column].dataType.simpleString()
    t = F.col("t").cast("timestamp")
    held = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("t")).withColumn("us", F.unix_micros(t))
    best: list = []
    # Intervals that are open: their number, first and last time; at first one that holds all.
    open_ = held.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).filter("hi > lo").withColumn("at", F.lit(0).cast("bigint"))
    rows, first, fine = held.withColumn("at", F.lit(0).cast("bigint")), open_.first(), 1
    if first is None:
        return held.select(F.col("t").alias("gap_start"), F.col("t").alias("gap_end"), F.lit(0).cast("bigint").alias("gap_seconds")).limit(0)
    start, width = first.lo, first.hi - first.lo + 1
    schema = f"gap_start {kind}, gap_end {kind}, gap_seconds bigint"
    while True:
        fine *= INTERVALS
        step = max(1, -(-width // fine))
        within = Window.partitionBy("at").orderBy("next")
        parts = rows.withColumn("next", F.floor((F.col("us") - start) / F.lit(step)).cast("bigint")).groupBy("at", "next").agg(F.min("t").alias("first"), F.max("t").alias("last"))
        seconds = lambda a, b: F.timestamp_diff("SECOND", a.cast("timestamp"), b.cast("timestamp"))
        between = parts.withColumn("before", F.lag("last").over(within)).filter("before IS NOT NULL").select(F.col("before").alias("gap_start"), F.col("first").alias("gap_end"), seconds(F.col("before"), F.col("first")).alias("gap_seconds"))
        found = between.orderBy(F.desc("gap_seconds"), "gap_start").limit(k).collect()
        best = sorted([*best, *found], key=lambda r: (-r.gap_seconds, r.gap_start))[:k]
        spans = parts.select("next", "first", seconds(F.col("first"), F.col("last")).alias("span")).filter(F.col("first") < F.col("last"))
        if len(best) == k:
            spans = spans.filter((F.col("span") > best[-1].gap_seconds) | ((F.col("span") == best[-1].gap_seconds) & (F.col("first") < F.lit(best[-1].gap_start))))
        if step == 1 or spans.isEmpty():
            return df.sparkSession.createDataFrame([tuple(r) for r in best], schema)
        rows = rows.withColumn("at", F.floor((F.col("us") - start) / F.lit(step)).cast("bigint")).join(spans.select(F.col("next").alias("at")), "at", "left_semi").select("t", "us", "at")


def date_profile(df: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    """(dataset, column, total_records, min_date, max_date, missing_count, missing_pct, max_gap_seconds)."""
    gaps = union([largest_gaps(df, c, 1).agg(F.max("gap_seconds").alias("max_gap_seconds")).withColumn("column", F.lit(c)) for c in columns])
    total = df.agg(F.count(F.lit(1)).alias("total_records"))
    return date_stats(df, columns).join(F.broadcast(gaps), "column").crossJoin(F.broadcast(total)).select(F.lit(dataset).alias("dataset"), "column", "total_records", "min_date", "max_date", "missing_count", "missing_pct", "max_gap_seconds")


def year_distribution(df: DataFrame, column: str) -> DataFrame:
    return _shares(df.filter(F.col(column).isNotNull()), [F.year(column).alias("year")])


def month_distribution(df: DataFrame, column: str) -> DataFrame:
    return _shares(df.filter(F.col(column).isNotNull()), [F.month(column).alias("month")])


def year_month_distribution(df: DataFrame, column: str) -> DataFrame:
    return _shares(df.filter(F.col(column).isNotNull()), [F.year(column).alias("year"), F.month(column).alias("month")])


def _shares(df: DataFrame, keys: list[Column]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("records").alias("__all")))).withColumn("pct", percent(F.col("records"), F.col("__all"), 2)).drop("__all")


def sequence_checks(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(sequence, violations, violation_pct) for ordered pairs (earlier, later)."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(b) < F.col(a)).alias(f"v{k}") for k, (a, b) in enumerate(pairs)))
    return _rows(one, [F.struct(F.lit(f"{a} -> {b}").alias("sequence"), F.col(f"v{k}").alias("violations"), percent(F.col(f"v{k}"), F.col("n"), 4).alias("violation_pct")) for k, (a, b) in enumerate(pairs)])


def chronology_rows(df: DataFrame, earlier: str, later: str) -> DataFrame:
    return df.filter(F.col(later) < F.col(earlier))


# ---------------------------------------------------------------- keys and relationships


def key_profile(df: DataFrame, dataset: str, keys: list[str]) -> DataFrame:
    """(dataset, key_name, total_rows, valid_rows, unique_key_count, duplicate_key_rows, excess_rows, null_key_rows,
    uniqueness_pct, duplicate_pct). Rows in repeated keys and rows beyond the first are told apart."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    n, ok = F.col("n"), ~F.col("bad")
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("bad", null)
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = g.agg(s("n").alias("total_rows"), s(F.when(ok, n)).alias("valid_rows"), F.count_if(ok).alias("unique_key_count"), s(F.when(ok & (n > 1), n)).alias("duplicate_key_rows"), s(F.when(ok, n - 1)).alias("excess_rows"), s(F.when(~ok, n)).alias("null_key_rows"))
    return one.select(F.lit(dataset).alias("dataset"), F.lit(", ".join(keys)).alias("key_name"), "*", percent(F.col("unique_key_count"), F.col("valid_rows"), 2).alias("uniqueness_pct"), percent(F.col("duplicate_key_rows"), F.col("valid_rows"), 2).alias("duplicate_pct"))


def row_duplicates(df: DataFrame, dataset: str) -> DataFrame:
    """(dataset, total_rows, distinct_rows, duplicate_rows, duplicate_pct) of whole rows."""
    one = repeat_figures(df).select("total_rows", "distinct_rows", F.col("excess_rows").alias("duplicate_rows"))
    return one.select(F.lit(dataset).alias("dataset"), "*", percent(F.col("duplicate_rows"), F.col("total_rows"), 4).alias("duplicate_pct"))


def relationship(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], label: str) -> DataFrame:
    """(relationship, child_rows_checked, match_count, non_match_count, match_pct, non_match_pct): rows for a single
    key, distinct tuples for a composite one; null keys are left out. Keys are counted before they meet their parents."""
    keys = child.select(*columns).dropna().groupBy(*columns).agg((F.count(F.lit(1)) if len(columns) == 1 else F.max(F.lit(1)).cast("long")).alias("__n"))
    found = parent.select(*(F.col(p).alias(f"__p{k}") for k, p in enumerate(parent_columns))).distinct()
    joined = keys.join(found, reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__p{k}") for k, c in enumerate(columns))), "left")
    one = joined.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("child_rows_checked"), F.coalesce(F.sum(F.when(F.col("__p0").isNotNull(), F.col("__n"))), F.lit(0)).alias("match_count"))
    miss = F.col("child_rows_checked") - F.col("match_count")
    return one.select(F.lit(label).alias("relationship"), "child_rows_checked", "match_count", miss.alias("non_match_count"), percent(F.col("match_count"), F.col("child_rows_checked"), 2).alias("match_pct"), percent(miss, F.col("child_rows_checked"), 2).alias("non_match_pct"))


def unmatched_keys(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    return unmatched(child.select(column).distinct(), column, parent, parent_column)


def missing_lifecycle(df: DataFrame, condition: str, columns: list[str]) -> DataFrame:
    """(affected_rows): rows of a state that miss any of the times it implies."""
    return df.filter(F.expr(condition)).agg(F.count_if(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))).alias("affected_rows"))


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("occurrences")).filter((F.col("occurrences") > 1) & F.col(column).isNotNull()).orderBy(F.desc("occurrences"), column)


def duplicate_rows(df: DataFrame) -> DataFrame:
    return repeated_rows(df, "occurrences")


def zero_report(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """(dataset, column, zero_count) across tables."""
    return union([zero_negative(tables[t], cs).select(F.lit(t).alias("dataset"), "column", "zero_count") for t, cs in columns.items()])


def bounds_report(tables: dict[str, DataFrame], rules: dict[str, dict[str, str]]) -> DataFrame:
    """(dataset, bound, violations): a condition for each named bound."""
    parts = []
    for t, named in rules.items():
        one = tables[t].agg(*(F.count_if(F.expr(c)).alias(f"b{k}") for k, c in enumerate(named.values())))
        parts.append(_rows(one, [F.struct(F.lit(t).alias("dataset"), F.lit(n).alias("bound"), F.col(f"b{k}").alias("violations")) for k, n in enumerate(named)]))
    return union(parts)


# ---------------------------------------------------------------- anomalies

OBSERVATION, POTENTIAL, CONFIRMED = "Observation", "Potential anomaly", "Confirmed anomaly"


def _anomaly(df: DataFrame, dataset: str, what: Column, kind: str, label: Column, count: Column, pct: Column, text: Column) -> DataFrame:
    return df.select(F.lit(dataset).alias("dataset"), what.alias("column_or_relationship"), F.lit(kind).alias("anomaly_type"), label.alias("classification"), count.cast("long").alias("count"), F.round(pct.cast("double"), 4).alias("percentage"), text.alias("description"))


def anomaly_register(
    tables: dict[str, DataFrame], specs: dict, edges: tuple, numeric: dict[str, list[str]], categories: dict[str, list[str]], sequences: dict[str, list[tuple[str, str]]], may_be_negative: tuple[str, ...] = (), exact: bool = True
) -> DataFrame:
    """One row for each anomaly found by the profiles. Missing values are observations, unless in a key; repeated keys
    and unmatched keys of a reference are confirmed, of a lookup potential; outliers, skew, zeros and rare categories
    are observations; negatives are confirmed unless allowed; impossible sequences are confirmed."""
    parts = []
    say = lambda s: F.lit(s)
    for t, df in tables.items():
        key = specs[t].key if t in specs else ()
        p = null_profile(df).filter("null_count > 0")
        parts.append(_anomaly(p, t, F.col("column"), "Missing Values", F.when(F.col("column").isin(*key), CONFIRMED).otherwise(OBSERVATION) if key else say(OBSERVATION), F.col("null_count"), F.col("null_pct"), say("values are missing")))
        if key:
            k = key_profile(df, t, list(key)).filter("duplicate_key_rows > 0")
            parts.append(_anomaly(k, t, F.col("key_name"), "Duplicate Keys", say(CONFIRMED), F.col("duplicate_key_rows"), F.col("duplicate_pct"), say("rows share a key")))
        else:
            d = row_duplicates(df, t).filter("duplicate_rows > 0")
            parts.append(_anomaly(d, t, say("__FULL_ROW__"), "Duplicate Rows", say(POTENTIAL), F.col("duplicate_rows"), F.col("duplicate_pct"), say("rows repeat others")))
    for t, columns in numeric.items():
        # One profile gives all four kinds: its rows are not computed anew for each of them.
        p = numeric_profile(tables[t], t, columns, exact)
        n, out, low, zero = F.col("count"), F.col("potential_outliers"), F.col("negative_count"), F.col("zero_count")
        allowed = F.col("column").isin(*may_be_negative) if may_be_negative else say(False)
        kinds = [
            (out > 0, "Extreme Values", OBSERVATION, out, F.col("outlier_pct"), say("values lie outside the fences")),
            ((low > 0) & ~allowed, "Invalid Negative Values", CONFIRMED, low, percent(low, n, 4), say("values below zero")),
            (zero > 0, "Zero Values", OBSERVATION, zero, percent(zero, n, 4), say("values are zero")),
            (F.col("shape") == HIGH, "Highly Skewed", OBSERVATION, n, say(100.0), F.lower("direction")),
        ]
        each = [F.struct(keep.alias("keep"), say(kind).alias("kind"), say(label).alias("label"), amount.cast("long").alias("amount"), rate.cast("double").alias("rate"), text.alias("text")) for keep, kind, label, amount, rate, text in kinds]
        found = p.select(F.col("column"), F.explode(F.array(*each)).alias("k")).filter("k.keep")
        parts.append(found.select(say(t).alias("dataset"), F.col("column").alias("column_or_relationship"), F.col("k.kind").alias("anomaly_type"), F.col("k.label").alias("classification"), F.col("k.amount").alias("count"), F.round("k.rate", 4).alias("percentage"), F.col("k.text").alias("description")))
    for t, pairs in sequences.items():
        s = sequence_checks(tables[t], pairs).filter("violations > 0")
        parts.append(_anomaly(s, t, F.col("sequence"), "Suspicious Dates", say(CONFIRMED), F.col("violations"), F.col("violation_pct"), say("a later event comes first")))
    for e in edges:
        r = relationship(tables[e.child], [e.column], tables[e.parent], [e.parent_column], f"{e.child}.{e.column} -> {e.parent}").filter("non_match_count > 0")
        parts.append(_anomaly(r, e.child, F.col("relationship"), "Unmatched Keys", say(POTENTIAL if e.lookup else CONFIRMED), F.col("non_match_count"), F.col("non_match_pct"), say("keys have no counterpart")))
    for t, columns in categories.items():
        for c in columns:
            s = category_summary(tables[t], t, c).filter("rare_categories > 0")
            parts.append(_anomaly(s, t, F.col("column"), "Rare Categories", say(OBSERVATION), F.col("rare_categories"), F.col("rare_category_pct"), say("categories hold under one per cent")))
    return union(parts)


def anomalies_by_class(register: DataFrame) -> DataFrame:
    return register.groupBy("classification").agg(F.count(F.lit(1)).alias("anomalies"), F.count_distinct("dataset").alias("datasets"))


def top_missing(tables: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """The columns with the largest share of missing values."""
    every = union([null_profile(df).select(F.lit(t).alias("dataset"), "column", "null_count", "null_pct") for t, df in tables.items()])
    return every.filter("null_count > 0").orderBy(F.desc("null_pct"), "dataset", "column").limit(k)


def observations(coverage: DataFrame, missing_values: DataFrame, numbers: DataFrame, categories: DataFrame, dates: DataFrame, classes: DataFrame) -> DataFrame:
    """(section, dataset, subject, amount, percentage): what the profiles say, from their results.

    Rows of each dataset, the columns with most missing values, skewed columns (amount: their values) and those with
    outliers, dominant categories, missing dates, anomalies by class.
    """

    def part(df: DataFrame, section: Column, dataset: Column, subject: Column, amount: str, percentage: Column) -> DataFrame:
        return df.select(section.alias("section"), dataset.alias("dataset"), subject.alias("subject"), F.col(amount).cast("long").alias("amount"), percentage.cast("double").alias("percentage"))

    none, of, column = F.lit(None), F.col("dataset"), F.col("column")
    skewed = F.col("shape").isin(HIGH, MODERATE)
    marks = F.array(F.struct(skewed.alias("keep"), F.col("shape").alias("section"), F.col("count").alias("amount"), F.lit(None).cast("double").alias("percentage")), F.struct((F.col("potential_outliers") > 0).alias("keep"), F.lit("Potential outliers").alias("section"), F.col("potential_outliers").alias("amount"), F.col("outlier_pct").alias("percentage")))
    numeric = numbers.select("dataset", "column", F.explode(marks).alias("m")).filter("m.keep").select("dataset", "column", "m.*")
    return union([
        part(coverage, F.lit("Dataset coverage"), of, F.lit("rows"), "total_rows", none),
        part(missing_values, F.lit("Missing values"), of, column, "null_count", F.col("null_pct")),
        part(numeric, F.col("section"), of, column, "amount", F.col("percentage")),
        part(categories, F.lit("Dominant category"), of, F.concat_ws(": ", column, "top_category"), "top_frequency", F.col("top_pct")),
        part(dates, F.lit("Missing dates"), of, column, "missing_count", F.col("missing_pct")),
        part(classes, F.lit("Anomalies"), F.lit("all"), F.col("classification"), "anomalies", none),
    ])
