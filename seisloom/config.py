"""Settings of a station; every time constant of the operators can be set."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class StationConfig:
    station_id: int = 1
    sensors: int = 1
    sample_rate_hz: float = 100.0
    frame_size: int = 256
    frame_overlap: int = 128
    neighbours: int = 16
    edge_span_us: int = 60_000_000
    thresholds: tuple[float, float, float, float] = (0.3, 0.5, 0.7, 0.9)
    cooldown_us: int = 30_000_000
    claim_timeout_us: int = 10_000_000
    checkpoint_interval_s: int = 900
    write_budget_bytes: int = 10 * 2**30
    peers: tuple[int, ...] = field(default=())
