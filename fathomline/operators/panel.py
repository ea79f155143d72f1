"""Panel preparation: complete cases, codes, design columns, checks and grouped transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quoted(column: str) -> str:
    """A column's name for Spark, which may hold dots and signs, as those of terms do."""
    return "`" + column.replace("`", "``") + "`"


def _complete(df: DataFrame, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    kinds = dict(df.dtypes)
    for c in columns:
        at = F.col(quoted(c))
        out = out & at.isNotNull()
        if kinds[c] in ("double", "float"):
            out = out & ~F.isnan(at) & (F.abs(at) < float("inf"))
    return out


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are neither null, NaN nor infinite."""
    return df.filter(_complete(df, columns))


def omitted_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The other rows."""
    return df.filter(~F.coalesce(_complete(df, columns), F.lit(False)))


def numbered(df: DataFrame, by: Sequence[str | Column], name: str) -> DataFrame:
    """df with name: each row's place, from 0, in the order of by over the whole table.

    The rows are sorted by range and kept; their partitions' sizes give each partition's first place. No partition holds all rows, and none goes
    through Python. Places of rows equal in by are open.
    """
    mark = "_mark"
    ordered = df.orderBy(*by).withColumn(mark, F.monotonically_increasing_id()).persist()  # its upper bits are the partition
    part = F.shiftright(mark, 33)
    sizes = {r["p"]: r["count"] for r in ordered.groupBy(part.alias("p")).count().collect()}
    first, offsets = 0, []
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(first)]
        first += sizes[p]
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*offsets), part)
    return ordered.withColumn(name, (start + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop(mark)


def factorize(df: DataFrame, column: str, code: str) -> DataFrame:
    """code: 1 for the smallest distinct value, 2 for the next, and so on."""
    values = numbered(df.select(column).distinct(), [column], code)
    return df.join(values.withColumn(code, F.col(code) + 1), column)


def original_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The place of each row of an id by time, from 0: orig_order within it."""
    return df.withColumn("orig_order", (F.row_number().over(Window.partitionBy(keys[0]).orderBy(*keys[1:])) - 1).cast("long"))


def dummies(df: DataFrame, column: str, levels: Sequence, prefix: str) -> DataFrame:
    """Treatment contrasts: a 0/1 column for every level but the first in order."""
    return df.select("*", *[F.when(F.col(column) == v, 1.0).otherwise(0.0).alias(f"{prefix}{v}") for v in sorted(levels)[1:]])


def balance(df: DataFrame) -> DataFrame:
    """n_firms, n_obs, min_t, max_t and balanced of a panel."""
    per = df.groupBy("id").agg(F.count("*").alias("t"))
    return per.agg(
        F.count("*").alias("n_firms"), F.sum("t").alias("n_obs"), F.min("t").alias("min_t"), F.max("t").alias("max_t"), (F.min("t") == F.max("t")).alias("balanced")
    )


def varying_firms(df: DataFrame, column: str, tolerance: float = 1e-8) -> DataFrame:
    """(id, deviation) of the ids in which a column that has to be constant isn't."""
    column = quoted(column)
    lo, hi, mean = F.min(column), F.max(column), F.avg(column)
    return df.groupBy("id").agg(F.greatest(hi - mean, mean - lo).alias("deviation")).filter(F.col("deviation") > tolerance)


def check_time_invariant(df: DataFrame, columns: Sequence[str]) -> None:
    for c in columns:
        if not varying_firms(df, c).isEmpty():
            raise ValueError(f"{c} has to be constant over time within each id")


def within(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus their mean over the id, as <name>_w."""
    over = Window.partitionBy("id")
    return df.select("*", *[(F.col(c) - F.avg(c).over(over)).alias(f"{c}_w") for c in columns])


def firm_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy("id").agg(F.count("*").alias("t"), *[F.avg(c).alias(f"{c}_mean") for c in columns])


def rescaled(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """column moved and stretched to [low, high]; its range is one row, joined by broadcast."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.lit(low) + (F.col(column) - F.col("_lo")) * (high - low) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.join(F.broadcast(ends)).withColumn(column, scaled).drop("_lo", "_hi")


def replaced_near(df: DataFrame, column: str, value: float, by: float, tolerance: float = 1e-12) -> DataFrame:
    return df.withColumn(column, F.when(F.abs(F.col(column) - value) < tolerance, F.lit(by)).otherwise(F.col(column)))


def variance(z: Sequence[str | Column], gamma: Sequence[float]) -> Column:
    """Log-linear variance exp(z'gamma)."""
    terms = [g * (F.col(c) if isinstance(c, str) else c) for c, g in zip(z, gamma, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.exp(out)


def swept(df: DataFrame, columns: Sequence[str], rows: bool = False) -> DataFrame:
    """Columns less their own mean, or with rows less the mean of the row's columns. Means of columns are one row, joined by broadcast."""
    if rows:
        mean = sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
        return df.withColumns({c: F.col(c) - mean for c in columns})
    means = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    return df.join(F.broadcast(means)).withColumns({c: F.col(c) - F.col(f"_mean_{c}") for c in columns}).drop(*means.columns)


def repeated(df: DataFrame, count: Column, place: str = "place") -> DataFrame:
    """Each row as often as count says, with place from 1; none where it is null or under 1."""
    n = count.cast("long")
    return df.filter(n >= 1).withColumn(place, F.explode(F.sequence(F.lit(1).cast("long"), n)))
