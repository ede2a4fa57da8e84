"""Every threshold of the lakehouse, in one place."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

# fixed values: bands are half-open, lowest first; the last label has no upper edge
DISTANCE = ((1.0, "short"), (5.0, "medium"), (20.0, "long"), (None, "very_long"))
FARE = ((10.0, "economy"), (30.0, "standard"), (100.0, "premium"), (None, "luxury"))
TEMPERATURE = ((32.0, "freezing"), (50.0, "cold"), (70.0, "mild"), (85.0, "warm"), (None, "hot"))
PRECIPITATION = ((0.1, "light"), (0.5, "moderate"), (None, "heavy"))
WIND = ((10.0, "calm"), (20.0, "breezy"), (30.0, "windy"), (None, "dangerous"))
ATTENDANCE = ((1000, "small"), (10000, "medium"), (50000, "large"), (None, "mega"))
DURATION = ((2.0, "brief"), (6.0, "moderate"), (12.0, "extended"), (None, "multi_day"))
DEMAND = {"high_demand": ("SPORTS", "CONCERT"), "medium_demand": ("CONFERENCE", "FESTIVAL")}


@dataclass(frozen=True)
class RushHours:
    morning: tuple[int, int] = (7, 9)
    evening: tuple[int, int] = (16, 19)


@dataclass(frozen=True)
class WeatherRules:
    severe_conditions: tuple[str, ...] = ("SNOW", "STORM")
    severe_precipitation: float = 1.0
    severe_wind: float = 30.0
    high_impact_wind: float = 50.0
    medium_impact_precipitation: float = 0.5
    travel_conditions: tuple[str, ...] = ("STORM", "SNOW", "FOG")
    extreme_cold: float = 20.0
    extreme_hot: float = 95.0


@dataclass(frozen=True)
class EventRules:
    major_attendance: int = 20000
    major_types: tuple[str, ...] = ("SPORTS", "CONCERT")
    major_type_attendance: int = 10000


@dataclass(frozen=True)
class Rules:
    rush: RushHours = field(default_factory=RushHours)
    weather: WeatherRules = field(default_factory=WeatherRules)
    events: EventRules = field(default_factory=EventRules)
    rows_in_batch: int = 80
    offsets_in_batch: int = 2500
    metric_window: str = "5 minutes"
    latency_window_seconds: int = 120
    latency_accuracy: int = 1000


RULES = Rules()


def settings_of(rules: Rules = RULES) -> dict[str, object]:
    """Every threshold by its dotted name, such as ``weather.severe_wind``."""
    out = {}
    for name, value in asdict(rules).items():
        out |= {f"{name}.{k}": v for k, v in value.items()} if isinstance(value, dict) else {name: value}
    return out


def unset(given: Mapping[str, str], rules: Rules = RULES) -> list[str]:
    """Names of thresholds that ``given`` doesn't set."""
    return sorted(settings_of(rules).keys() - given.keys())


def with_settings(given: Mapping[str, str], rules: Rules = RULES) -> Rules:
    """``rules`` with thresholds from texts by dotted name; lists are comma-separated. Unknown names and values of the wrong type raise."""
    known = settings_of(rules)
    lost = sorted(given.keys() - known.keys())
    if lost:
        raise ValueError(f"no such thresholds: {', '.join(lost)}")

    def read(name: str, was: object) -> object:
        if name not in given:
            return was
        if isinstance(was, tuple):
            parts = tuple(type(was[0])(x.strip()) for x in given[name].split(","))
            if isinstance(was[0], int) and len(parts) != len(was):
                raise ValueError(f"{name} takes {len(was)} numbers")
            return parts
        return type(was)(given[name])

    parts = {f.name: getattr(rules, f.name) for f in fields(rules)}
    made = {k: replace(v, **{f.name: read(f"{k}.{f.name}", getattr(v, f.name)) for f in fields(v)}) if is_dataclass(v) else read(k, v) for k, v in parts.items()}
    return Rules(**made)

# fixed values: what producers call a valid record; wider than what the gate lets through
ZONES = (1, 263)
VALID_DISTANCE, VALID_PASSENGERS, VALID_TEMPERATURE, VALID_ATTENDANCE = (0.0, 100.0), (0, 10), (-50.0, 150.0), (0, 100000)
DRY_CONDITIONS, DRY_PRECIPITATION = ("CLEAR", "CLOUDY", "FOG"), 0.1
