"""Sensor samples to overlapping frames, and what a frame is reduced to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SIZE, OVERLAP, RATE = 256, 128, 100.0


#: Buckets of one key that a single task adds up, where a key has very many.
WIDE = 4096


def ordinal(df: DataFrame, key: str, order: list[str], bucket: Column | None = None, name: str = "i", wide: bool = False) -> DataFrame:
    """`df` with its 0-based place within `key` in the total order `order`.

    With `bucket`, a column that never falls along `order`, rows are ranked within (key, bucket) and moved up by the
    counts of earlier buckets, so that a key with most of the rows is shared by as many tasks as it has buckets. The
    counts, one row for each key and bucket, are joined on that key. With `wide`, for keys with millions of buckets,
    which are then integers, counts are added up within `WIDE` neighbouring buckets, and those sums over the key: the
    longest run of one task is shorter by that factor.
    """
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)
    dealt = df.withColumn("_bucket", bucket)
    counts = dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = earlier_sums(counts, key, wide)
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)).cast("long"))
    return local.join(before, [key, "_bucket"]).withColumn(name, F.col("_before") + F.col("_local") - 1).drop("_bucket", "_local", "_before")


def earlier_sums(counts: DataFrame, key: str, wide: bool = False) -> DataFrame:
    """(key, _bucket, _before): the sum of _n over the key's earlier buckets."""
    if not wide:
        return counts.select(key, "_bucket", (F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    grouped = counts.withColumn("_wide", F.floor(F.col("_bucket") / WIDE))
    sums = grouped.groupBy(key, "_wide").agg(F.sum("_n").alias("_sum"))
    sums = sums.select(key, "_wide", (F.sum("_sum").over(Window.partitionBy(key).orderBy("_wide")) - F.col("_sum")).alias("_below"))
    inner = grouped.select(key, "_wide", "_bucket", (F.sum("_n").over(Window.partitionBy(key, "_wide").orderBy("_bucket")) - F.col("_n")).alias("_inner"))
    return inner.join(sums, [key, "_wide"]).select(key, "_bucket", (F.col("_inner") + F.col("_below")).alias("_before"))


#: Rows of a key that one task of `trailing` goes through, unless windows are longer.
STRETCH = 16_384


def trailing(df: DataFrame, key: str, order: list[str], bucket: Column, n: int, value: Callable[[WindowSpec], Column], name: str) -> DataFrame:
    """`df` with `name`, an aggregate over the last n rows of the key up to each row, itself among them: value(window).

    Ranks (`ordinal`, with its `bucket`) cut a key into stretches; the last n - 1 rows of a stretch are also given to
    the next, so a key with most rows is shared by as many tasks as it has stretches, and each window sees the rows of
    one plain window, in the same order.
    """
    long = max(STRETCH, 8 * n)
    own = F.floor(F.col("_i") / long)
    seen = F.when(F.col("_i") % long > long - n, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = ordinal(df, key, order, bucket, "_i").withColumn("_stretch", F.explode(seen))
    over = Window.partitionBy(key, "_stretch").orderBy("_i").rowsBetween(-(n - 1), 0)
    return dealt.withColumn(name, value(over)).where(own == F.col("_stretch")).drop("_i", "_stretch")


def frames(samples: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(ch, k, samples) for each complete frame: positions [k * step, k * step + size) of a channel's (ch, i, v)."""
    step = size - overlap
    if size % step == 0:
        return _from_pieces(samples, size, step)
    last = F.floor(F.col("i") / step)
    covers = F.sequence(F.greatest(F.lit(0), last - (size - 1) // step), last)
    placed = samples.select("ch", "i", "v", F.explode(covers).alias("k")).where(F.col("i") - F.col("k") * step < size)
    grouped = placed.groupBy("ch", "k").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_s"))  # at most `size` of a frame
    return grouped.where(F.size("_s") == size).select("ch", F.col("k").cast("long"), F.col("_s.v").alias("samples"))


def _from_pieces(samples: DataFrame, size: int, step: int) -> DataFrame:
    """The same where frames are whole numbers of steps: samples meet once, in pieces of a step; frames are made of pieces."""
    pieces = samples.groupBy("ch", F.floor(F.col("i") / step).alias("p")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_s"))  # at most `step` of a piece
    covers = F.sequence(F.greatest(F.lit(0), F.col("p") - (size // step - 1)), F.col("p"))
    placed = pieces.select("ch", "p", F.col("_s.v").alias("_v"), F.explode(covers).alias("k"))
    grouped = placed.groupBy("ch", "k").agg(F.array_sort(F.collect_list(F.struct("p", "_v"))).alias("_p"))
    whole = grouped.select("ch", F.col("k").cast("long").alias("k"), F.flatten("_p._v").alias("samples"))
    return whole.where(F.size("samples") == size)


def polled(polls: DataFrame, key: str, order: list[str], bucket: Column, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Polls (key, ok, n, ...) with k, the frame that a poll yields or null, and held, the samples that it leaves waiting.

    A poll that fails reads nothing and yields nothing. Any other adds its n samples, and yields one frame if at least
    `size` wait, of which `size - overlap` then go. After j polls that have read A samples, no more than
    F = (A - overlap) / step frames can be whole, and each poll adds one at most: the number of frames is the least
    F_i + (j - i) over all i up to j, a running minimum. `bucket` never falls along `order`: sums and minima run within
    (key, bucket) and are moved by those of earlier buckets, so that a key with most polls has as many tasks as buckets.

    As reads of at most a step leave less than `size`, a ring of four sizes never drops a sample; larger reads are an
    error. Null `ok` counts as a failure.
    """
    step = size - overlap
    read = F.when(F.coalesce("ok", F.lit(False)), F.when(F.col("n") > step, F.raise_error(F.lit("a poll reads more than a step"))).otherwise(F.col("n").cast("long"))).otherwise(0)
    dealt = polls.withColumns({"_b": bucket, "_ok": F.coalesce("ok", F.lit(False)).cast("long"), "_n": read})
    own = Window.partitionBy(key, "_b").orderBy(*order)
    sizes = dealt.groupBy(key, "_b").agg(F.sum("_ok").alias("_j0"), F.sum("_n").alias("_a0"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_b", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_j0", "_a0")])
    placed = dealt.join(sizes, [key, "_b"]).withColumn("_j", F.col("_j0") + F.sum("_ok").over(own)).withColumn("_a", F.col("_a0") + F.sum("_n").over(own))
    placed = placed.withColumn("_f", F.when(F.col("_ok") == 1, F.greatest(F.lit(0), F.floor((F.col("_a") - overlap) / step)) - F.col("_j")))
    least = placed.groupBy(key, "_b").agg(F.min("_f").alias("_m0"))
    least = least.select(key, "_b", F.least(F.lit(0), F.min("_m0").over(earlier)).alias("_m0"))
    before = F.least("_m0", F.min("_f").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    found = placed.join(least, [key, "_b"]).withColumn("_was", F.col("_j") - F.col("_ok") + before).withColumn("_w", F.col("_j") + F.least(before, "_f"))
    k = F.when((F.col("_ok") == 1) & (F.col("_w") > F.col("_was")), F.col("_was"))
    return found.select(*polls.columns, k.cast("long").alias("k"), (F.col("_a") - F.col("_w") * step).cast("long").alias("held"))


def rms(samples: Column) -> Column:
    """Root mean square; 0 of nothing."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def crossings(samples: Column) -> Column:
    """Sign changes between neighbours, where 0 counts as positive."""
    n = F.size(samples)
    pairs = F.zip_with(F.slice(samples, 1, n - 1), F.slice(samples, 2, n - 1), lambda a, b: F.when((a >= 0) != (b >= 0), 1).otherwise(0))
    return F.when(n < 2, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0), lambda a, x: a + x))


def zero_crossing_hz(samples: Column, rate: float = RATE) -> Column:
    """Crossings over twice the duration; 0 below two samples."""
    n = F.size(samples)
    return F.when(n < 2, F.lit(0.0)).otherwise(crossings(samples) / (2.0 * (n - 1) / rate))


def wave_type(amplitude: Column, hz: Column) -> Column:
    """Unknown below an RMS of 10; P above 3 Hz, S from 1 Hz, else Surface."""
    return F.when(amplitude < 10, "Unknown").when(hz > 3, "P").when(hz >= 1, "S").otherwise("Surface")


def frame_time_us(k: Column, rate: int = 100, step: int = SIZE - OVERLAP) -> Column:
    """Signal time of frame k: the step's duration is added before it is stamped."""
    return ((k + 1) * F.lit(step * (1_000_000 // rate))).cast("long")


def ring_tail(samples: DataFrame, capacity: int) -> DataFrame:
    """What a ring of `capacity` still holds after all of a channel's samples: its last ones."""
    order = Window.partitionBy("ch").orderBy(F.desc("i"))
    return samples.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= capacity).drop("_r")


def metadata(framed: DataFrame, station_id: int = 1) -> DataFrame:
    """Frames with amplitude, dominant frequency, wave type, signal time and station."""
    out = framed.withColumn("amplitude_rms", rms(F.col("samples"))).withColumn("dominant_freq_hz", zero_crossing_hz(F.col("samples")))
    out = out.withColumn("wave_type", wave_type(F.col("amplitude_rms"), F.col("dominant_freq_hz"))).withColumn("timestamp_us", frame_time_us(F.col("k")))
    return out.withColumn("station_id", F.lit(station_id).cast("long"))
