"""Operations: resources, write budgets, latencies, heartbeats, the newest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A level holds above this share of memory, and searches are that wide on it.
CRITICAL, WARNING = (0.9, 16), (0.8, 32)


def degradation(used_share: Column) -> Column:
    return F.when(used_share > CRITICAL[0], "Critical").when(used_share > WARNING[0], "Warning").otherwise("Normal")


def search_width(level: Column, normal: int = 64) -> Column:
    return F.when(level == "Critical", CRITICAL[1]).when(level == "Warning", WARNING[1]).otherwise(normal)


def utilisation(written: Column, budget: float) -> Column:
    return written / budget if budget > 0 else F.lit(1.0)


def interval_factor(share: Column) -> Column:
    """How much longer to wait between checkpoints as the day's write budget is used up."""
    return F.when(share > 0.95, 4).when(share > 0.80, 2).otherwise(1)


def latencies(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, p50, p99): the values at sorted places n/2 and floor(0.99 n), by rank, not by collecting."""
    from .framing import ordinal

    ranked = ordinal(df.select(key, value), key, [value], F.floor(F.log2(F.col(value) + 1)), "_i")
    sized = ranked.join(df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")), key)
    at = lambda place: F.max(F.when(F.col("_i") == place, F.col(value)))
    return sized.groupBy(key, "n", "mean").agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * 0.99)).alias("p99"))


def stale(df: DataFrame, key: str, at: str, now: Column, limit: int) -> DataFrame:
    """Keys whose last sign of life is older than the limit."""
    return df.groupBy(key).agg(F.max(at).alias("last")).where(now - F.col("last") > limit)


def newest(df: DataFrame, order: list[str], n: int = 10, most: int = 100) -> DataFrame:
    """The newest rows, as a read endpoint serves them: ten unless asked, a hundred at most."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(min(n, most))
