"""The whole tick as one stream: samples to frames, search, prediction, micro update and decision, by micro-batch.

Open frames are state of the stream. What a tick needs of earlier ticks is kept in tables below one folder, a directory
for each micro-batch: `frames` with their vectors, which later ticks search and take their history from, `alerts`, each
station's cooldown after the batch, and `decisions`. A batch only reads directories of earlier batches and replaces its
own, so a batch that is run again after a failure gives the same rows, and a restarted stream goes on where it stopped.

Frames must come in the order of k over all channels: a micro-batch holds the same stretch of time of each channel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import adaptation as D
from ..operators import alerts as L
from ..operators import embedding as E
from ..operators import framing as P
from ..operators import graph as G
from ..operators import vectors as V
from ..storage import written
from .processors import frame_stream

#: A frame's id is k * CHANNELS + channel: time, then channel.
CHANNELS = 1_000_000
NEAREST, HISTORY, SPAN_US = 16, 100, 60_000_000
#: Rank and rate of the micro update.
RANK, RATE = 4, 0.01
#: Frames that are predicted at a time, in the order of ids.
SLICE = 16_384
_STATE = "station long, level string, magnitude double, at long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def identified(frames: DataFrame) -> DataFrame:
    """Embedded frames of (ch, k, samples) with vec_id."""
    return E.embedded(P.metadata(frames)).withColumn("vec_id", F.col("k") * CHANNELS + F.col("ch"))


def _before(spark: SparkSession, folder: str, n: int, schema: StructType) -> DataFrame | None:
    """Rows of the directories of batches before n, chosen by their names, or None for the first."""
    if n == 0:
        return None
    every = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(folder)
    return every.where(F.col("batch") < n).drop("batch")


def _slices(ids: DataFrame) -> list[tuple[int, int]]:
    """The first and last id of each `SLICE` of (id), in order: one row of a slice comes to the driver."""
    ranked = P.ordinal(ids.select("id", F.lit(0).alias("_all")), "_all", ["id"], F.floor(F.col("id") / 1024), "_i", wide=True)
    found = ranked.groupBy(F.floor(F.col("_i") / SLICE).alias("s")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    return [(r["low"], r["high"]) for r in found.orderBy("s").collect()] or [(0, -1)]


def predicted(new: DataFrame, every: DataFrame, folder: str) -> DataFrame:
    """G.predictions() of the frames `new` (vec_id, timestamp_us, vector) among `every`, which are those and all before them, as a table below `folder`.

    Slices of the new frames are searched, linked and predicted one after the other, each with the frames up to its
    last, so that what is shuffled at a time is bounded by a slice and one copy of the vectors before it.
    """
    parts = []
    for n, (low, high) in enumerate(_slices(new.select(F.col("vec_id").alias("id")))):
        own, until = new.where(F.col("vec_id").between(low, high)), every.where(F.col("vec_id") <= high)
        vectors = until.select("vec_id", F.col("vector").alias("embedding"))
        near = V.nearest(own.select("vec_id", F.col("vector").alias("embedding")), vectors, NEAREST, earlier=True)
        near = written(near.select(F.col("query_id").alias("centre"), F.col("vec_id").alias("id"), F.col("rank").alias("order")), f"{folder}/near-{n}")
        centres, ids = own.select(F.col("vec_id").alias("centre")), until.select(F.col("vec_id").alias("id"))
        ids = ids.where(F.col("id") >= low).unionByName(ids.where(F.col("id") < low).orderBy(F.desc("id")).limit(HISTORY - 1))
        nodes = written(G.neighbourhood(centres, near, G.recent(ids, HISTORY).join(centres, "centre")), f"{folder}/nodes-{n}")
        seen = until.select(F.col("vec_id").alias("id"), F.col("timestamp_us").alias("us"), "vector")
        parts.append(G.predictions(nodes, seen, SPAN_US))
        written(parts[-1], f"{folder}/made-{n}")
    return new.sparkSession.read.schema(parts[0].schema).parquet(*[f"{folder}/made-{n}" for n in range(len(parts))])


def tick(frames: DataFrame, n: int, folder: str, cooldown: L.Cooldown) -> None:
    """Batch n: frames (ch, k, samples), in tables below `folder`."""
    spark = frames.sparkSession
    new = written(identified(frames).select("vec_id", "ch", "timestamp_us", "vector"), f"{folder}/frames/batch={n}")
    old = _before(spark, f"{folder}/frames", n, new.schema)
    every = new if old is None else old.unionByName(new)
    made = predicted(new, every, f"{folder}/predicted/batch={n}").join(new, F.col("centre") == F.col("vec_id"))
    error = D.error_signal(F.col("event_probability"), F.col("estimated_magnitude"), F.col("estimated_time_to_peak_s"), F.col("confidence"))
    micro = F.transform(error, lambda g: F.transform(F.slice("vector", 1, RANK), lambda f: g * RATE * f))
    p = made.select(F.col("ch").alias("station"), F.col("timestamp_us").alias("us"), F.col("centre").alias("id"), F.col("event_probability").alias("probability"), F.col("estimated_magnitude").alias("magnitude"), micro.alias("micro"))
    p = written(p, f"{folder}/predictions/batch={n}")
    state = spark.createDataFrame([], _STATE) if n == 0 else spark.read.schema(_STATE).parquet(f"{folder}/alerts/batch={n - 1}")
    decided = written(L.resumed(p.drop("micro"), state, cooldown), f"{folder}/decided/batch={n}")
    last = decided.groupBy("station").agg(F.max_by(F.struct("last_level", "last_magnitude", "last_at"), F.struct("us", "id")).alias("s"))
    written(last.select("station", F.col("s.last_level").alias("level"), F.col("s.last_magnitude").alias("magnitude"), F.col("s.last_at").alias("at")), f"{folder}/alerts/batch={n}")
    written(decided.where("id IS NOT NULL").select("id", "level", "kind").join(p.select("id", "micro"), "id"), f"{folder}/decisions/batch={n}")


def run(samples: DataFrame, folder: str, cooldown: L.Cooldown | None = None) -> StreamingQuery:
    """Start (or restart) the tick over a stream (ch, i, v) in the order of i, up to what is there now. Results come in `decisions` below `folder`: id, level, kind, micro."""
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    cooldown = cooldown or L.Cooldown()
    stream = frame_stream(samples).writeStream.foreachBatch(lambda frames, n: tick(frames, n, folder, cooldown))
    return stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What the ticks so far have decided."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/decisions")
