"""Settings of a report run.

A report either runs for one day (`as_of` is given) or for many snapshots in
one job (`snapshots` is given); in the second case every source carries a
`snapshot_date` column, which becomes part of every key.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAPSHOT = "snapshot_date"

HORIZON_RULES = ("base", "weekly", "transfer")
CONSUMPTION_RULES = ("prev_shippable", "same_ref", "self_shippable")
RATE_ROUNDINGS = ("half_even", "ceiling")
ON_DUPLICATE = ("expand", "error")


@dataclass(frozen=True)
class SnapshotRules:
    """The rules that were in force on one snapshot date; a rule that isn't
    given is the one of the report."""

    snapshot_date: date
    consumption_rule: str | None = None
    rate_rounding: str | None = None

    def __post_init__(self):
        _one_of(self.consumption_rule, (None, *CONSUMPTION_RULES))
        _one_of(self.rate_rounding, (None, *RATE_ROUNDINGS))


@dataclass(frozen=True)
class ReportParams:
    as_of: date | None = None
    snapshots: tuple[SnapshotRules, ...] = ()
    order_horizon_days: int = 15
    month_days: int = 30
    horizon_rule: str = "base"
    consumption_rule: str = "prev_shippable"
    rate_rounding: str = "half_even"
    # "expand" keeps every row a duplicated dimension key produces,
    # "error" stops the job at the first duplicated key.
    on_duplicate: str = "expand"
    # The seven lowest month codes; read from the forecast when not given.
    months: tuple[str, ...] = ()
    # An item-location with more lots than this is spread over several tasks.
    lots_per_task: int = 4_000_000

    def __post_init__(self):
        _one_of(self.horizon_rule, HORIZON_RULES)
        _one_of(self.consumption_rule, CONSUMPTION_RULES)
        _one_of(self.rate_rounding, RATE_ROUNDINGS)
        _one_of(self.on_duplicate, ON_DUPLICATE)
        if (self.as_of is None) == (not self.snapshots):
            raise ValueError("give either as_of or snapshots")
        if self.months and self.snapshots:
            raise ValueError("months differ per snapshot and are read from the forecast")
        if self.months and len(self.months) != 7:
            raise ValueError("months must hold seven month codes")

    @classmethod
    def base(cls, as_of: date, **changes) -> "ReportParams":
        return cls(as_of=as_of, **changes)

    @classmethod
    def weekly(cls, as_of: date | None = None, **changes) -> "ReportParams":
        settings = {"horizon_rule": "weekly", "consumption_rule": "self_shippable"}
        return cls(as_of=as_of, **(settings | changes))

    @classmethod
    def transfer(cls, as_of: date | None = None, **changes) -> "ReportParams":
        settings = {"horizon_rule": "transfer", "rate_rounding": "ceiling"}
        return cls(as_of=as_of, **(settings | changes))

    @property
    def many_snapshots(self) -> bool:
        return bool(self.snapshots)

    @property
    def snapshot_keys(self) -> tuple[str, ...]:
        return (SNAPSHOT,) if self.many_snapshots else ()

    @property
    def ref_keys(self) -> tuple[str, ...]:
        """The item-location comes first: sorting compares the beginning of the first column before all else."""
        return ("ref", *self.snapshot_keys)

    @property
    def as_of_column(self) -> Column:
        return F.col(SNAPSHOT) if self.many_snapshots else F.lit(self.as_of)

    def rule(self, name: str) -> Column:
        """A rule as a column: one literal, or chosen by snapshot date."""
        if not self.many_snapshots:
            return F.lit(getattr(self, name))
        dates_by_value: dict[str, list[date]] = {}
        for snapshot in self.snapshots:
            value = getattr(snapshot, name) or getattr(self, name)
            dates_by_value.setdefault(value, []).append(snapshot.snapshot_date)
        default = F.lit(getattr(self, name))
        chosen = F
        for value, dates in dates_by_value.items():
            chosen = chosen.when(F.col(SNAPSHOT).isin(dates), value)
        return chosen.otherwise(default)


def _one_of(value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{value!r} is not one of {allowed}")
