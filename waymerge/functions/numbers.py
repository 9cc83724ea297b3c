"""Number rules that differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def round_half_up(x: Column) -> Column:
    """Round halves toward +infinity (Spark's ``round`` goes away from zero)."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def ratio_pct(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(F.lit(0.0))


def pct_change(old: Column, new: Column) -> Column:
    """Percentage change; from zero it is 100 when anything appeared, else 0."""
    return (
        F.when(old == 0, F.when(new > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
        .otherwise((new - old) / old * 100.0)
    )


def leading_number(text: Column) -> Column:
    """Parse the longest numeric prefix (``'40.7abc'`` gives 40.7), else NULL."""
    prefix = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(prefix != "", prefix).try_cast("double")


def present(c: Column) -> Column:
    """The string when it is neither NULL nor empty."""
    return F.when(c != "", c)


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[present(c) for c in cols])


def is_finite(c: Column) -> Column:
    """True for a real number: not NULL, not NaN, not infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def nonzero(c: Column) -> Column:
    """True for a present value other than 0 (some rules read 0 as missing)."""
    return c.isNotNull() & ~F.isnan(c) & (c != 0)


def settled(df: DataFrame, column: str) -> DataFrame:
    """The same rows with ``column`` passed through a one-element explode.

    Spark pushes a filter below projections by copying the column's expression into
    it; for a score built in many steps that copy grows exponentially. A filter on
    a generated column stays above it.
    """
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.array(column)).alias(column))


def apart(df: DataFrame, column: str) -> DataFrame:
    """The same rows; what follows ``column`` is compiled apart from what makes it.

    Spark compiles a chain of steps to one method, and the JVM leaves a method of over 8,000 bytes
    uncompiled, which costs more than the steps themselves. A lambda ends such a chain.
    """
    return df.withColumn(column, F.get(F.transform(F.array(column), lambda x: x), F.lit(0)))


def settled_apart(df: DataFrame, column: str) -> DataFrame:
    """The same rows; filters on ``column`` stay above what makes it (``settled``), and both are compiled ``apart``.

    After a join, a filter would otherwise be compiled into its loop over the pairs, which then grows past what the JVM compiles.
    """
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.transform(F.array(column), lambda x: x)).alias(column))


def shuffle_width(df: DataFrame) -> int:
    """Partitions for a step whose cost is computing, not bytes: the run-time merging of
    small partitions would leave few tasks with all the work."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
