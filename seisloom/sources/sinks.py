"""Where alerts go: a JSON log, a relay queue, views of the newest rows for a read API, a dashboard row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.folds import priority_queue
from ..operators.runtime import newest


def log_alerts(alerts: DataFrame, folder: str) -> None:
    """One JSON line for each alert that went out; other decisions are not logged."""
    alerts.where(F.col("kind").isin("EmitLocal", "EmitCappedAtMedium")).write.mode("append").json(folder)


def relay(alerts: DataFrame, key: str, order: list[str], capacity: int = 500) -> DataFrame:
    """(key, place, payload): each key's queue for upstream. Critical alerts go to the front and push out the back, others go to the back and push out the front."""
    rows = alerts.select(key, *order, F.to_json(F.struct(*alerts.columns)).alias("payload"), (F.col("level") == "Critical").alias("urgent"))
    return priority_queue(rows, key, order, "payload", "urgent", capacity).select(key, F.posexplode("items").alias("place", "payload"))


def endpoint(rows: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """JSON of the newest rows: ten unless asked for, a hundred at most."""
    return newest(rows, order, 10 if limit is None else limit).select(F.to_json(F.struct(*rows.columns)).alias("json"))


def dashboard(sensors: DataFrame, peers: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: statuses counted, whether any peer is healthy, alerts that went out."""
    s = sensors.agg(F.count("*").alias("sensors"), F.count_if(F.col("status") == "Active").alias("active"), F.count_if(F.col("status") == "Failed").alias("failed"))
    p = peers.agg(F.count("*").alias("peers"), F.coalesce(F.bool_or(F.col("health") == "Healthy"), F.lit(False)).alias("mesh_available"))
    a = alerts.agg(F.count_if(F.col("kind").isin("EmitLocal", "EmitCappedAtMedium")).alias("alerts"))
    return s.join(p).join(a)


def memory_used(lines: Column) -> Column:
    """(total - available) / total from the lines of a memory report, as an array."""
    value = lambda name: F.try_element_at(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, rf"^{name}:\s+(\d+)", 1)), lambda x: x != ""), F.lit(1)).cast("double")
    return (value("MemTotal") - value("MemAvailable")) / value("MemTotal")
