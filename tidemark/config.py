"""Settings of the operators; every function takes what it needs from one of these."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class SourceConfig:
    """Where trades and markets are, and what their columns are called."""

    trades_path: str = ""
    markets_path: str = ""
    format: str = "parquet"  # parquet, csv or jdbc
    jdbc_url: str = ""
    jdbc_partition_column: str | None = None
    jdbc_bounds: tuple[int, int] = (0, 1)
    jdbc_partitions: int = 8
    columns: dict[str, str] = field(
        default_factory=lambda: {"timestamp": "timestamp", "market_id": "market_id", "side": "side", "price": "price", "usd_amount": "usd_amount", "token_amount": "token_amount"}
    )  # canonical name -> name in the source
    yes_side: str = "token1"
    no_side: str = "token2"


@dataclass(frozen=True)
class Gap:
    """A known hole in the record, start included and end not."""

    start: datetime = datetime(2025, 10, 1)
    end: datetime = datetime(2026, 2, 1)


@dataclass(frozen=True)
class BucketConfig:
    minutes: int = 5
    whale_usd: float = 1000.0
    max_empty: int = 48


@dataclass(frozen=True)
class FeatureConfig:
    lags: tuple[int, ...] = (1, 2, 3, 6, 12)
    windows: tuple[int, ...] = (6, 12, 24, 48)
    cross_features: bool = True
    in_order: bool = False  # sums of windows add up their rows in order

    @classmethod
    def low_memory(cls) -> FeatureConfig:
        return cls(lags=(1, 3, 6), windows=(6, 12))


@dataclass(frozen=True)
class LabelConfig:
    forward: int = 6
    min_move: float = 0.001


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.7
    validation: float = 0.15
    gap: int = 12
    purge: int = 6


@dataclass(frozen=True)
class ChunkConfig:
    days: int = 90
    context: int = 60  # buckets before a chunk that its features may look back on
    minutes: int = 5
    origin: datetime = datetime(2020, 1, 1)


@dataclass(frozen=True)
class ModelConfig:
    max_trees: int = 200
    learning_rate: float = 0.05
    depth: int = 7
    min_leaf: int = 50
    row_share: float = 0.8
    column_share: str = "0.8"
    patience: int = 50
    seed: int = 42


@dataclass(frozen=True)
class BacktestConfig:
    threshold: float = 0.55
    fee: float = 0.02
    max_position: float = 10.0
    kelly: bool = False
    kelly_cap: float = 0.25
    bankroll: float = 100.0
