"""Signed snapshots in three rotating slots, with a manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 3


def latest(slots: DataFrame, keys: list[str]) -> DataFrame:
    """The valid slot with the greatest sequence; of equals, the last slot."""
    rest = [c for c in slots.columns if c not in keys]
    best = slots.where("valid").groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("sequence", "slot")).alias("_b"))
    return best.select(*keys, "_b.*")


class Manifest:
    """Slots as rows; a slot is written before the manifest names it, so a crash leaves the older one."""

    def __init__(self, slots: list[dict] | None = None, active: int = SLOTS - 1):
        self.slots, self.active = slots or [{"slot": k, "sequence": 0, "valid": False, "digest": ""} for k in range(SLOTS)], active

    @staticmethod
    def parse(text: str) -> Manifest:
        """An unreadable manifest counts as none."""
        try:
            data = json.loads(text)
            return Manifest(data["slots"], data["active"])
        except (ValueError, KeyError, TypeError):
            return Manifest()

    def text(self) -> str:
        return json.dumps({"active": self.active, "slots": self.slots}, indent=2)

    def record(self, slot: int, sequence: int, digest: str) -> None:
        if not 0 <= slot < SLOTS:
            raise ValueError("no such slot")
        self.slots[slot] = {"slot": slot, "sequence": sequence, "valid": True, "digest": digest}
        self.active = slot

    def next_slot(self) -> int:
        return (self.active + 1) % SLOTS

    def best(self) -> dict | None:
        valid = [s for s in self.slots if s["valid"]]
        return max(valid, key=lambda s: (s["sequence"], s["slot"])) if valid else None


def digest_of(rows: DataFrame) -> str:
    """Of all rows, whatever their order: a distributed sum of row hashes, with their number."""
    n, total = rows.select(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return hashlib.sha256(f"{n}/{total}".encode()).hexdigest()


def write(rows: DataFrame, folder: str, manifest: Manifest, sequence: int) -> int:
    slot = manifest.next_slot()
    rows.write.mode("overwrite").parquet(f"{folder}/slot-{slot}")
    manifest.record(slot, sequence, digest_of(rows.sparkSession.read.parquet(f"{folder}/slot-{slot}")))
    return slot


def recover(spark: SparkSession, folder: str, manifest: Manifest, log: DataFrame | None = None) -> tuple[DataFrame, dict, int] | None:
    """(rows, slot, entries of the log from its sequence on), None without a valid slot. A changed snapshot is an error."""
    if not (slot := manifest.best()):
        return None
    rows = spark.read.parquet(f"{folder}/slot-{slot['slot']}")
    if digest_of(rows) != slot["digest"]:
        raise ValueError("the snapshot was changed")
    return rows, slot, 0 if log is None else log.where(F.col("seq") >= slot["sequence"]).count()


def boot(spark: SparkSession, folder: str, manifest: Manifest, log: DataFrame | None = None) -> tuple[str, DataFrame | None, int]:
    """(Warm, rows, entries since) from the best slot; Cold without one, or if it was changed: older slots are not tried."""
    try:
        found = recover(spark, folder, manifest, log)
    except ValueError:
        found = None
    return ("Cold", None, 0) if found is None else ("Warm", found[0], found[2])
