"""Error signals, low-rank weight deltas, ground truth and probation of a candidate model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import keyed_events


def error_signal(probability: Column, magnitude: Column, peak_s: Column, confidence: Column) -> Column:
    return F.array(probability - 0.5, magnitude - 3.0, peak_s - 5.0, confidence - 0.5)


def low_rank_delta(gradients: DataFrame, features: DataFrame, key: str, rank: int, rate: float) -> DataFrame:
    """(key, i, r, a): a[i][r] = gradient i * rate * mean feature r. The other factor is the truncated identity.

    `gradients` has one array for each key; means are taken by dimension. The rank is at most either width.
    """
    means = features.select(key, F.posexplode("features").alias("r", "_f")).where(F.col("r") < rank).groupBy(key, "r").agg(F.avg("_f").alias("_mean"))
    wide = gradients.select(key, F.posexplode("gradient").alias("i", "_g"), F.size("gradient").alias("_n"))
    return wide.join(means, key).where(F.col("r") < F.col("_n")).select(key, "i", "r", (F.col("_g") * rate * F.col("_mean")).alias("a"))


def applied(weights: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """W + A B for matrices as (i, j, w), (i, r, a), (r, j, b); only where both overlap."""
    product = a.join(b, "r").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("_d"))
    return weights.join(product, ["i", "j"], "left").select("i", "j", (F.col("w") + F.coalesce("_d", F.lit(0.0))).alias("w"))


def labelled(predictions: DataFrame, waves: DataFrame, second_us: int = 1_000_000) -> DataFrame:
    """(id, event, magnitude, labeled_at) of predictions (id, probability) by the waves (id, us, wave, amplitude) after them.

    An event had an S wave 1 to 10 s, and a surface wave 5 to 30 s, after the first wave. An unlikely prediction is no
    event; a likely one without waves cannot be labelled yet. The magnitude takes the largest of all the waves.
    """
    first = waves.groupBy("id").agg(F.min("us").alias("_first"))
    timed = waves.join(first, "id").withColumn("_s", (F.col("us") - F.col("_first")) / second_us)
    seen = timed.groupBy("id").agg(
        F.bool_or((F.col("wave") == "S") & F.col("_s").between(1.0, 10.0)).alias("_shear"),
        F.bool_or((F.col("wave") == "Surface") & F.col("_s").between(5.0, 30.0)).alias("_surface"),
        F.max("amplitude").alias("_top"),
        F.max("us").alias("_last"),
    )
    return _labels(predictions.join(seen, "id", "left"))


def _labels(joined: DataFrame) -> DataFrame:
    unlikely = F.col("probability") <= 0.3
    event = F.when(unlikely, F.lit(False)).when(F.col("_last").isNotNull(), F.col("_shear") & F.col("_surface"))
    return joined.select("id", event.alias("event"), F.when(event & ~unlikely & (F.col("_top") > 0), F.log10("_top")).alias("magnitude"), F.when(unlikely, F.coalesce("_last", F.lit(0))).otherwise(F.col("_last")).alias("labeled_at"))


def followed(predictions: DataFrame, waves: DataFrame, second_us: int = 1_000_000) -> DataFrame:
    """labelled() for any predictions (id, station, us, probability): by the station's waves (station, us, wave, amplitude) from the first one later than the prediction to 30 s after that.

    What follows a wave depends on its time alone: sliding ranges over buckets of 30 s, to which each wave also goes as
    the next bucket's, give it once for each time of a wave. A prediction then finds its first later wave, in its own
    bucket or as the least of a later one, an as-of join that sends a row only to its bucket.
    """
    span = 30 * second_us
    bucket = F.floor(F.col("us") / span)
    copied = waves.select("station", "us", "wave", "amplitude", F.explode(F.array(bucket, bucket - 1)).alias("_b"))
    along = Window.partitionBy("station", "_b").orderBy("us")
    within = lambda low, high: along.rangeBetween(low * second_us, high * second_us)
    seen = copied.select(
        "station",
        "us",
        "_b",
        F.coalesce(F.bool_or(F.col("wave") == "S").over(within(1, 10)), F.lit(False)).alias("_shear"),
        F.coalesce(F.bool_or(F.col("wave") == "Surface").over(within(5, 30)), F.lit(False)).alias("_surface"),
        F.max("amplitude").over(within(0, 30)).alias("_top"),
        F.max("us").over(within(0, 30)).alias("_last"),
    )
    seen = seen.where(F.col("_b") == bucket).drop("_b").dropDuplicates(["station", "us"])
    asked = predictions.select("id", "station", "us", "probability", bucket.alias("_b"), F.lit(None).cast("long").alias("_wave"))
    times = waves.select(F.lit(None).cast(predictions.schema["id"].dataType).alias("id"), "station", "us", F.lit(None).cast("double").alias("probability"), bucket.alias("_b"), F.col("us").alias("_wave"), F.lit(True).alias("_is_wave"))
    both = asked.withColumn("_is_wave", F.lit(False)).unionByName(times)
    own = F.min("_wave").over(along.rangeBetween(1, Window.unboundedFollowing))
    firsts = both.groupBy("station", "_b").agg(F.min("_wave").alias("_first"))
    later = Window.partitionBy("station").orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select("station", "_b", F.min("_first").over(later).alias("_later"))
    found = both.withColumn("_own", own).where("NOT _is_wave").join(firsts, ["station", "_b"])
    found = found.select("id", "station", "probability", F.coalesce("_own", "_later").alias("us"))
    return _labels(found.join(seen, ["station", "us"], "left"))


def accuracy(outcomes: DataFrame) -> DataFrame:
    """(arm, samples, correct, accuracy): correct if (probability >= 0.5) agrees with the event."""
    right = F.sum(((F.col("probability") >= 0.5) == F.col("event")).cast("int"))
    return outcomes.groupBy("arm").agg(F.count("*").alias("samples"), right.alias("correct"), (right / F.count("*")).alias("accuracy"))


def probation(arms: DataFrame, elapsed_s: Column, length_s: int = 3600) -> DataFrame:
    """InProgress until the time is over; then Promote if the candidate is at least as accurate, else Rollback. No samples: accuracy 0."""
    pick = lambda arm: F.coalesce(F.max(F.when(F.col("arm") == arm, F.col("accuracy"))), F.lit(0.0))
    both = arms.agg(pick("candidate").alias("candidate"), pick("current").alias("current"))
    result = F.when(elapsed_s < length_s, "InProgress").when(F.col("candidate") >= F.col("current"), "Promote").otherwise("Rollback")
    return both.select("candidate", "current", result.alias("result"))


def probation_lifecycle(rows: DataFrame, key: str, order: list[str], length_us: int = 3_600_000_000) -> DataFrame:
    """The columns of `order` with result and version for each `evaluate` of rows (key, us, kind, version, arm, ok).

    `start` begins a probation of a candidate `version`, in the place of one that runs; `outcome` counts for the arm
    candidate or current while one runs. An evaluation without a probation, or before its length is over, is InProgress;
    then the candidate is promoted if it is at least as accurate (no outcomes: 0), and its version becomes the current
    one, or rolled back; either ends the probation. The first version is 0.
    """

    def step(s: dict, row: tuple) -> list:
        if row.kind == "start":
            s.update(candidate=row.version, since=row.us, right={"candidate": 0, "current": 0}, all={"candidate": 0, "current": 0})
        elif row.kind == "outcome" and s["candidate"] is not None and row.arm in s["all"]:
            s["all"][row.arm] += 1
            s["right"][row.arm] += bool(row.ok)
        if row.kind != "evaluate":
            return []
        result = "InProgress"
        if s["candidate"] is not None and max(0, row.us - s["since"]) >= length_us:
            share = {arm: s["right"][arm] / s["all"][arm] if s["all"][arm] else 0.0 for arm in s["all"]}
            result = "Promote" if share["candidate"] >= share["current"] else "Rollback"
            s.update(candidate=None, now=s["candidate"] if result == "Promote" else s["now"])
        return [(getattr(row, key), *(getattr(row, c) for c in order), result, s["now"])]

    named = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, *order))
    wanted = rows.select(*dict.fromkeys([key, *order, "us", "kind", "version", "arm", "ok"]))
    return keyed_events(wanted, key, order, lambda: {"candidate": None, "now": 0}, step, lambda state, own: [], f"{named}, result string, version long")
