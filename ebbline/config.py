"""Job settings. One frozen dataclass, passed explicitly to every job."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timezone


@dataclass(frozen=True)
class Thresholds:
    """Alert limits; a metric alerts only when strictly above its limit."""

    revenue_mean_delta: float = 5.0
    tenure_mean_delta: float = 1.0
    monthly_contract_share_delta: float = 0.05
    probability_delta: float = 0.03
    high_risk_share_delta: float = 0.03
    revenue_at_risk_total: float = 50000.0
    mean_probability: float = 0.45


@dataclass(frozen=True)
class Settings:
    """Locations and parameters of the batch jobs.

    ``root`` is a folder every executor can reach; the versions of all stages
    and models live below it. ``run_id`` names a run: a run that is repeated
    under its name replaces its ledger entries instead of adding to them.
    ``multi_line`` tells whether quoted cells of CSV files hold line breaks; left
    open, the files are looked through.
    """

    root: str
    raw_csv: str | None = None
    multi_line: bool | None = None
    run_id: str | None = None
    database: str = "risk_mart"
    run_date: date | None = None
    min_rows: int = 1000
    snapshot_months: int = 12
    seed: int = 42
    test_share: float = 0.2
    forest_trees: int = 400
    forest_depth: int = 10
    model_name: str = "subscriber_risk"
    thresholds: Thresholds = field(default_factory=Thresholds)

    @property
    def as_of(self) -> date:
        return self.run_date or datetime.now(timezone.utc).date()

    @property
    def uploads_path(self) -> str:
        return f"{self.root}/uploads"

    @property
    def mart_path(self) -> str:
        return f"{self.root}/mart"
