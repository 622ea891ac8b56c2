"""The 256 features of a frame: spectrum 128, envelope 32, onset 16, autocorrelation 32, priors 32, time of day 16; unit length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import kernels as K

PRIORS = [0.0] * 32


def features(samples: Column, timestamp_us: Column, priors: list[float] | None = None) -> Column:
    """Not yet normalised."""
    parts = [f(samples) for f in (K.envelope_fine, K.envelope_medium, K.envelope_coarse, K.sta_lta, K.autocorrelation)]
    return F.concat(K.spectrum_z(samples), *parts, F.array(*[F.lit(float(p)) for p in priors or PRIORS]), A.time_of_day(timestamp_us))


def embedded(frames: DataFrame, priors: list[float] | None = None) -> DataFrame:
    """`frames` (samples, timestamp_us, ...) with vector, source_window_hash and the norm before normalisation."""
    raw = frames.withColumn("_raw", features(F.col("samples"), F.col("timestamp_us"), priors))
    raw = raw.withColumn("norm", A.norm(F.col("_raw")))
    return raw.withColumn("vector", F.when(F.col("norm") > A.TINY, F.transform("_raw", lambda x: x / F.col("norm"))).otherwise(F.col("_raw"))).withColumn("source_window_hash", K.window_hash("samples")).drop("_raw")


def noise_floor(frames: DataFrame, order: list[str], alpha: float = 0.01, value: str = "amplitude_rms") -> DataFrame:
    """An exponential mean from 0, over the quiet frames, those of wave type Unknown, in `order`: sum of alpha * (1 - alpha)^(rows after) * value.

    The weights make it a plain aggregation; only ranks need the order.
    """
    from .framing import ordinal

    quiet = frames.where("wave_type = 'Unknown'")
    ranked = ordinal(quiet.withColumn("_all", F.lit(1)), "_all", order, F.col(order[0]), "_i", wide=True)
    n = quiet.count()
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), F.lit(n) - 1 - F.col("_i"))
    return ranked.agg(F.sum(weight * F.col(value)).alias("noise_floor"))
