"""Names and rules a caller declares about an event log."""

from __future__ import annotations

from dataclasses import dataclass, field

# Canonical column names every operator works on after `normalize_log`.
CASE = "case_id"
ACTIVITY = "activity"
TS = "ts"
ORDER_KEY = "order_key"
POS = "event_pos"


@dataclass(frozen=True)
class LogSpec:
    """Maps a source table's columns to the canonical event-log names.

    `order_key` breaks timestamp ties and must be unique within (case, ts): rows of a
    distributed table have no order of their own.
    """

    case: str
    activity: str
    ts: str
    order_key: str
    static_cols: tuple[str, ...] = ()
    event_cols: tuple[str, ...] = ()


@dataclass(frozen=True)
class OutcomeSpec:
    """Outcome activity -> binary target. The set of outcomes is declared, so it is small."""

    targets: dict[str, int] = field(default_factory=dict)

    @property
    def activities(self) -> list[str]:
        return sorted(self.targets)
