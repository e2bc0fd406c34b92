"""Half-open time partitions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from fibrelark.schema import ContractError

PARTS = ("train", "calibration", "validation", "test")


@dataclass(frozen=True)
class TemporalSplit:
    train_end: datetime
    calibration_end: datetime
    validation_end: datetime
    test_end: datetime

    def __post_init__(self) -> None:
        if any(e.tzinfo is None for e in self.ends):
            raise ContractError("boundaries need a time zone")
        if not all(a < b for a, b in zip(self.ends, self.ends[1:], strict=False)):
            raise ContractError("boundaries must increase")

    @property
    def ends(self) -> tuple[datetime, ...]:
        return (self.train_end, self.calibration_end, self.validation_end, self.test_end)

    def part(self, time: Column) -> Column:
        """train, calibration, validation or test; NULL at or after the last boundary."""
        out = F.when(time < F.lit(self.train_end), PARTS[0])
        for name, end in zip(PARTS[1:], self.ends[1:], strict=True):
            out = out.when(time < F.lit(end), name)
        return out


def split_of(start: datetime, days: float, fractions: tuple[float, ...] = (0.4, 0.55, 0.75, 1.0)) -> TemporalSplit:
    """Boundaries at fractions of a period."""
    if not (0 < fractions[0] < fractions[1] <= 0.55 < fractions[2] < fractions[3] == 1):
        raise ContractError(f"fractions break their order: {fractions}")
    start = start if start.tzinfo else start.replace(tzinfo=UTC)
    return TemporalSplit(*(start + timedelta(days=days * f) for f in fractions))
