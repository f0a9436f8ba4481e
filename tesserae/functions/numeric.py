"""Column functions on dates, numbers and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import ColumnLike, as_col, unwrap

#: Date formats tried in turn. Fixed values.
DATE_FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "d MMM yyyy", "MMM d, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd"]
#: Mean days of a month. Fixed value.
MONTH_DAYS = 30.4375


def parse_date(x: ColumnLike, formats: list[str] = DATE_FORMATS) -> Column:
    """The date of a text in the first format that fits; null if none does."""
    s = unwrap(x)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in formats])


def parse_money(x: ColumnLike) -> Column:
    """An amount with dollar sign and thousands commas; in brackets it is negative. Null if it isn't a number."""
    s = F.trim(F.regexp_replace(unwrap(x), "[$,]", ""))
    bracketed = s.rlike(r"^\(.*\)$")
    return F.when(bracketed, F.concat(F.lit("-"), F.regexp_replace(s, "[()]", ""))).otherwise(s).try_cast("double")


def parse_year(x: ColumnLike) -> Column:
    """The year of a date text or a number; null if neither."""
    s = unwrap(x)
    number = F.when(s.rlike(r"^[0-9]{4}(\.0+)?$"), s).try_cast("double").cast("int")
    return F.coalesce(number, F.year(parse_date(x)))


def duration(start: ColumnLike, end: ColumnLike) -> list[Column]:
    """Columns ``duration_days``, ``duration_months`` and ``negative_duration`` (0/1, 0 if unknown)."""
    days = F.datediff(as_col(end), as_col(start))
    return [days.alias("duration_days"), (days / F.lit(MONTH_DAYS)).alias("duration_months"), F.coalesce((days < 0).cast("int"), F.lit(0)).alias("negative_duration")]


def activity(end: ColumnLike, today: ColumnLike) -> Column:
    """``unknown`` without end, ``expired`` if it lies before ``today``, else ``active``."""
    return F.when(as_col(end).isNull(), "unknown").when(as_col(end) < as_col(today), "expired").otherwise("active")


def years_since(current: ColumnLike, year: ColumnLike) -> Column:
    """Years from ``year`` to ``current``; 0 if there is none, as for this year."""
    return F.coalesce(as_col(current) - as_col(year), F.lit(0))


def safe_log1p(x: ColumnLike) -> Column:
    """``ln(1 + x)`` with null and negative values as 0."""
    return F.log1p(F.greatest(F.coalesce(as_col(x).cast("double"), F.lit(0.0)), F.lit(0.0)))


def wants_log(name: str) -> bool:
    """Whether a feature is a count or total that gets a log copy, by its name."""
    counted = any(w in name for w in ("count", "prior", "degree", "awards")) or name.endswith(("_sum", "_max"))
    return name.startswith(("g_", "m_team_size", "m_num_co_pis")) and counted and not name.startswith("g_log1p_")


def add_log_copies(df: DataFrame) -> DataFrame:
    """``df`` with a ``<name>_log1p`` copy of every count-like feature."""
    return df.withColumns({f"{c}_log1p": safe_log1p(c) for c in df.columns if wants_log(c)})


def minmax(df: DataFrame, cols: list[str], default: float = 0.0) -> DataFrame:
    """``df`` with ``<col>_scaled`` in [0, 1]: nulls and non-finite values become ``default``, a constant column 0.

    The range comes from one aggregate and is joined as its single row.
    """
    ok = {c: F.when(~F.isnan(as_col(c).cast("double")) & (F.abs(as_col(c).cast("double")) < float("inf")), as_col(c).cast("double")) for c in cols}
    ranges = df.agg(*[f(ok[c]).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    held = df.join(F.broadcast(ranges), F.lit(True), "left")  # one row
    for c in cols:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        held = held.withColumn(f"{c}_scaled", F.when(ok[c].isNull(), default).when(hi > lo, (ok[c] - lo) / (hi - lo)).otherwise(0.0))
    return held.drop(*ranges.columns)


def one_hot(col: ColumnLike, values: list[str], prefix: str) -> list[Column]:
    return [F.coalesce((as_col(col) == v).cast("double"), F.lit(0.0)).alias(f"{prefix}_{v}") for v in values]


def multi_hot(codes: ColumnLike, values: list[str], prefix: str) -> list[Column]:
    """An indicator per value and one, ``<prefix>_OTHER``, for codes outside of ``values``."""
    codes = F.coalesce(as_col(codes), F.array().cast("array<string>"))
    known = F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
    return [F.array_contains(codes, v).cast("double").alias(f"{prefix}_{v}") for v in values] + [(F.size(F.array_except(codes, known)) > 0).cast("double").alias(f"{prefix}_OTHER")]


def summarize_list(values: ColumnLike, prefix: str) -> list[Column]:
    """Sum, mean, max, min and number of non-zero items of an array; all 0 for null and empty ones."""
    xs = F.filter(F.coalesce(as_col(values), F.array().cast("array<double>")), lambda v: v.isNotNull())
    n, total = F.size(xs), F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return [
        total.alias(f"{prefix}_sum"), F.when(n > 0, total / n).otherwise(0.0).alias(f"{prefix}_mean"), zero(F.array_max(xs)).alias(f"{prefix}_max"), zero(F.array_min(xs)).alias(f"{prefix}_min"),
        F.size(F.filter(xs, lambda v: v != 0)).alias(f"{prefix}_nonzero"),
    ]


def sigmoid(x: ColumnLike) -> Column:
    return 1 / (1 + F.exp(-as_col(x)))


def softmax(xs: ColumnLike) -> Column:
    """Softmax of an array, shifted by its maximum."""
    exps = F.transform(as_col(xs), lambda v: F.exp(v - F.array_max(as_col(xs))))
    total = F.aggregate(exps, F.lit(0.0), lambda a, v: a + v)
    return F.transform(exps, lambda v: v / total)


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """``(target, n, weight)`` per class: rows over classes times rows of the class. Null targets are left out."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # over the classes, not the rows
    return counts.withColumn("weight", F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n")))


def mean_pool(vectors: ColumnLike, mask: ColumnLike) -> Column:
    """Mean of the vectors (array of arrays) whose mask is 1; null if none is."""
    kept = F.filter(F.arrays_zip(as_col(vectors).alias("v"), as_col(mask).alias("m")), lambda z: z["m"] == 1)
    total = F.aggregate(F.slice(kept, F.lit(2), F.greatest(F.size(kept), F.lit(1))), F.get(kept, F.lit(0))["v"], lambda a, z: F.zip_with(a, z["v"], lambda p, q: p + q))
    return F.transform(total, lambda v: v / F.size(kept))


def l2_normalize(vector: ColumnLike) -> Column:
    """The vector with length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(as_col(vector), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return F.transform(as_col(vector), lambda v: F.when(norm > 0, v / norm).otherwise(v.cast("double")))
