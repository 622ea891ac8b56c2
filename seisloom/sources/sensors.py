"""Synthetic sensors: rows (i, v) of one channel, from formulas; noise from a seeded generator."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import MASK, lcg_noise

#: Frequencies of P, S and surface waves in Hz.
HZ = {"PWave": 5.0, "SWave": 2.0, "SurfaceWave": 0.3}
ERRORS = ("ReadFailed", "Disconnected", "Timeout", "Calibration")


def _sine(t: Column, hz: float) -> Column:
    return F.sin(t * (2 * math.pi * hz))


def _after(t: Column, start: float | Column, wave) -> Column:
    """A wave from its arrival on."""
    return F.when(t >= start, wave(t - start)).otherwise(F.lit(0.0))


def pattern(t: Column, name: str) -> Column:
    """A pure wave, or P at 0 s, S at 3 s and a surface wave at 8 s, each dying away."""
    if name != "FullSequence":
        return _sine(t, HZ[name])
    return (
        _after(t, 0.0, lambda d: F.exp(d * -0.3) * _sine(d, HZ["PWave"]))
        + _after(t, 3.0, lambda d: F.exp(d * -0.2) * _sine(d, HZ["SWave"]) * 1.5)
        + _after(t, 8.0, lambda d: F.exp(d * -0.1) * _sine(d, HZ["SurfaceWave"]) * 2.0)
    )


def truncated(x: Column) -> Column:
    """To 32-bit integers, towards zero and within their range."""
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.greatest(F.lit(-(2**31)), F.least(F.lit(2**31 - 1), whole)).cast("int")


def noise(spark: SparkSession, n: int, seed: int, level: float) -> DataFrame:
    """(i, noise): the generator's values are sequential, so one task makes a sensor's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch["seed"]:
                yield pd.DataFrame({"i": range(n), "noise": lcg_noise(int(s), n, level)})

    return spark.createDataFrame([(str(seed & MASK),)], "seed string").mapInPandas(run, "i long, noise double")


def mock(spark: SparkSession, n: int, name: str = "FullSequence", amplitude: float = 1000.0, rate: float = 100.0, sensor_id: int = 0, noise_level: float = 0.0) -> DataFrame:
    """(i, v) of n samples: pattern plus noise, times amplitude."""
    rows = spark.range(n).select(F.col("id").alias("i"))
    signal = pattern(F.col("i") / F.lit(rate), name)
    if noise_level:
        rows = rows.join(noise(spark, n, sensor_id * 6364136223846793005 + 1, noise_level), "i")
        signal = signal + F.col("noise")
    return rows.select("i", truncated(signal * amplitude).alias("v"))


def noise_only(spark: SparkSession, n: int, sensor_id: int, level: float) -> DataFrame:
    return noise(spark, n, sensor_id * 6364136223846793005 + 42, level).select("i", truncated(F.col("noise")).alias("v"))


def arrivals(distance_km: float) -> tuple[float, float]:
    """Of the S wave, 2 to 10 s after the P wave, and of the surface wave, at most 20 s."""
    shear = min(max(distance_km / 3.5 - distance_km / 6.0, 2.0), 10.0)
    return shear, min(shear + 3.0 + 0.05 * distance_km, 20.0)


def simulated(spark: SparkSession, magnitude: float, distance_km: float, noise_level: float, rate: int) -> DataFrame:
    """(chunk, t, samples): an event of that magnitude at that distance, in chunks of a second."""
    amp = 100 * 10 ** (magnitude - 2) / (1 + math.sqrt(distance_km / 10))
    shear, surface = arrivals(distance_km)
    n = int((surface + 15) * rate)
    t = F.col("i") / F.lit(float(rate))
    signal = (
        _after(t, 0.0, lambda d: F.exp(d * -0.3) * _sine(d, 5.0) * (amp * 0.4))
        + _after(t, shear, lambda d: F.least(d / 0.5, F.lit(1.0)) * F.exp(d * -0.15) * _sine(d, 2.0) * amp)
        + _after(t, surface, lambda d: F.least(d, F.lit(1.0)) * F.exp(d * -0.08) * _sine(d, 0.3) * (amp * 1.5))
    )
    rows = spark.range(n).select(F.col("id").alias("i")).join(noise(spark, n, 0xDEADBEEF12345678, 1.0), "i")  # fixed value: the seed of its noise
    values = rows.select(F.floor(F.col("i") / rate).alias("chunk"), "i", truncated(signal + F.col("noise") * (noise_level * amp * 0.1)).alias("v"))
    grouped = values.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))  # `rate` of a chunk
    return grouped.select("chunk", F.col("chunk").cast("double").alias("t"), F.col("s.v").alias("samples"))


def replayed(stored: DataFrame, n: int) -> DataFrame:
    """(i, v) of n samples: the stored ones, then zeros."""
    rows = stored.sparkSession.range(n).select(F.col("id").alias("i"))
    return rows.join(stored.select("i", "v"), "i", "left").select("i", F.coalesce("v", F.lit(0)).alias("v"))


def polled(samples: DataFrame, errors: DataFrame, batch: int = 64) -> DataFrame:
    """(ch, poll, status, n): reads of `batch` samples; a poll named in errors (ch, poll, error) fails and yields none."""
    polls = samples.groupBy("ch", F.floor(F.col("i") / batch).alias("poll")).agg(F.count("*").alias("n"))
    joined = polls.join(errors, ["ch", "poll"], "left")
    return joined.select("ch", "poll", F.coalesce("error", F.lit("Ok")).alias("status"), F.when(F.col("error").isNull(), F.col("n")).otherwise(0).alias("n"))


@dataclass(frozen=True)
class SensorConfig:
    sensor_id: int
    pattern: str = "FullSequence"
    amplitude: float = 1000.0
    noise_level: float = 0.0
    rate: float = 100.0


def discovered(spark: SparkSession, configs: list[SensorConfig], n: int) -> DataFrame:
    """(ch, i, v) of all configured sensors: one projection over a small table of settings, where there is no noise."""
    out = None
    for c in configs:
        rows = mock(spark, n, c.pattern, c.amplitude, c.rate, c.sensor_id, c.noise_level).select(F.lit(c.sensor_id).cast("long").alias("ch"), "i", "v")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "ch long, i long, v int")


def with_places(samples: DataFrame, order: list[str]) -> DataFrame:
    return samples.withColumn("i", F.row_number().over(Window.partitionBy("ch").orderBy(*order)) - 1)
