from pyspark.sql import functions as F

from seisloom.operators import alerts, framing
from seisloom.streaming import processors

SF = "/root/testdata/sf0.001"


def drain(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def source(spark, rows, order, parts, folder):
    bounds = rows.selectExpr(f"max({order}) AS m").first()[0] + 1
    for k in range(parts):
        rows.where((F.col(order) >= bounds * k / parts) & (F.col(order) < bounds * (k + 1) / parts)).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_alerts_as_in_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = e.select(F.min(us)).first()[0]
    rows = e.select(F.col("user_id").alias("station"), (us - start).alias("us"), F.col("event_id").alias("id"), F.least(F.lit(1.0), F.col("value") / 100).alias("probability"), (F.col("value") / 50).alias("magnitude"))
    cooldown = alerts.Cooldown(12 * 3_600_000_000)
    got = drain(spark, processors.alert_stream(source(spark, rows, "us", 3, tmp_path / "in"), cooldown), "alerts", tmp_path)
    assert sorted(map(tuple, got.select("id", "kind").collect())) == sorted(map(tuple, alerts.decisions(rows, cooldown).select("id", "kind").collect()))


def test_frames_as_in_batch(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 2).alias("ch"), F.floor(F.col("id") / 2).alias("i"), F.col("id").cast("int").alias("v"))
    got = drain(spark, processors.frame_stream(source(spark, rows, "i", 4, tmp_path / "in")), "frames", tmp_path)
    plain = lambda df: sorted((r["ch"], r["k"], tuple(r["samples"])) for r in df.collect())
    assert plain(got) == plain(framing.frames(rows))


def test_claims(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, 0, "claim"), (1, 11, 5, "vote"), (2, 10, 1, "vote"), (3, 10, 2, "claim"), (3, 10, 9, "vote")], "claim_id long, station long, us long, kind string")
    got = drain(spark, processors.claim_stream(source(spark, rows, "us", 1, tmp_path / "in"), timeout_ms=10**9), "claims", tmp_path)
    assert {tuple(r) for r in got.collect()} == {(1, "Reached", 2), (2, "UnknownClaim", 0), (3, "Reached", 2)}
