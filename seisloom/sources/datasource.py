"""Sensors as a Spark data source: `spark.read.format("sensor")` and `spark.readStream.format("sensor")`.

Options: sensors (how many), samples (of each, in batch), pattern, amplitude, rate, batch (samples of a micro-batch).
A partition is a sensor; values come from formulas, so a lost task makes the same rows again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "ch long, i long, v int"


def sample(name: str, t: float) -> float:
    """The same patterns as the column form."""
    wave = lambda hz, d: math.sin(2 * math.pi * hz * d)
    pure = {"PWave": 5.0, "SWave": 2.0, "SurfaceWave": 0.3}
    if name in pure:
        return wave(pure[name], t)
    parts = ((0.0, 0.3, 1.0, 5.0), (3.0, 0.2, 1.5, 2.0), (8.0, 0.1, 2.0, 0.3))
    return sum(gain * math.exp(-decay * (t - start)) * wave(hz, t - start) for start, decay, gain, hz in parts if t >= start)


class _Sensor(InputPartition):
    def __init__(self, channel: int):
        super().__init__(channel)
        self.channel = channel


class _Rows:
    def __init__(self, options: dict[str, str]):
        self.sensors, self.samples = int(options.get("sensors", 1)), int(options.get("samples", 1000))
        self.pattern, self.amplitude = options.get("pattern", "FullSequence"), float(options.get("amplitude", 1000.0))
        self.rate, self.batch = float(options.get("rate", 100.0)), int(options.get("batch", 64))

    def of(self, channel: int, start: int, stop: int) -> Iterator[tuple]:
        for i in range(start, stop):
            yield channel, i, int(sample(self.pattern, i / self.rate) * self.amplitude)


class SensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.rows = _Rows(options)

    def partitions(self) -> list[InputPartition]:
        return [_Sensor(k) for k in range(self.rows.sensors)]

    def read(self, partition: _Sensor) -> Iterator[tuple]:
        return self.rows.of(partition.channel, 0, self.rows.samples)


class SensorStreamReader(SimpleDataSourceStreamReader):
    """Each micro-batch takes `batch` more samples of every sensor."""

    def __init__(self, options: dict[str, str]):
        self.rows = _Rows(options)

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _between(self, start: int, stop: int) -> Iterator[tuple]:
        return iter([row for k in range(self.rows.sensors) for row in self.rows.of(k, start, stop)])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        stop = min(start["at"] + self.rows.batch, self.rows.samples)
        return self._between(start["at"], stop), {"at": stop}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._between(start["at"], end["at"])

    def commit(self, end: dict) -> None:
        pass


class SensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sensor"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SensorReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return SensorStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SensorSource)
