"""Parameters shared by the operators, and the values that are fixed by the data contract."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: status vocabulary and its numeric codes -------------------
STATUS_CODES = {"unknown": 0, "available": 1, "in_use": 2}
STATUSES = tuple(STATUS_CODES)
OUTLET_CODES = {"outlet_1": 1, "outlet_2": 2}

# ---- fixed values: day names, 1 = Sunday ------------------------------------
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# ---- fixed values: the reference week that weekly windows are written on ----
# day of week 1..7 falls on 12..18 November 2017, local time
REFERENCE_YEAR, REFERENCE_MONTH, REFERENCE_DAY_BEFORE_SUNDAY = 2017, 11, 11
SCHEDULE_TIME_FORMAT = "yyyyMMdd'T'HHmmss'Z'"

# ---- fixed values: insight types ---------------------------------------------
MORNING, MIDDAY, AFTERNOON, ALL_DAY = 0, 1, 2, 3

# ---- fixed values: alert colours and channels --------------------------------
ALERT_COLOURS = {
    "initial": "0099ff",
    "became_nonzero": "009900",
    "increased": "009900",
    "decreased": "ffcc00",
    "went_to_zero": "990000",
    "available": "009900",
    "unavailable": "990000",
}
CHANNEL_UPGRADE_THRESHOLD = "upgrade-threshold"
CHANNEL_AVAIL_UPGRADE = "avail-upgrade"
CHANNEL_AVAIL_DOWNGRADE = "avail-downgrade"
CHANNEL_FORECAST = "forecast"


def clock_minutes(text: str) -> int:
    """``'9:30'`` -> 570, minutes since midnight."""
    hour, minute = (int(part) for part in text.split(":"))
    return hour * 60 + minute


@dataclass(frozen=True)
class Settings:
    """Every tunable of the analytics, with the service defaults."""

    zone: str = "America/Los_Angeles"
    slot_minutes: int = 2
    capacity: int = 32
    # availability windows
    open_at: int = 2
    close_at: int = 2
    min_slots: int = 2
    window_label: str = "available window"
    # insights
    morning_max_end: str = "9:30"
    midday_max_start: str = "16:00"
    midday_min_minutes: int = 4
    afternoon_min_start: str = "16:01"
    apply_afternoon_min_start: bool = False
    # live analytics
    velocity_counts: tuple[int, ...] = (1, 3, 5)
    lookahead_minutes: int = 480
    notify_interval_minutes: int = 10
    end_of_day: str = "23:58"
    late_minutes: int = 0  # polls are held so long for others that come late
    # alert routing
    upgrade_threshold: int = 2
    default_channel: str = "default"
    # history
    train_days: int = 7
    ledger_expire_days: int = 7
    collect_days: int = 1  # how late a reading is collected at most, where there is no zone map
    # forest
    forest_trees: int = 100
    forest_depth: int = 30
    forest_bins: int = 128
    forest_seed: int = 1234

    def __post_init__(self) -> None:
        if not 1 <= self.slot_minutes <= 60 or 60 % self.slot_minutes:
            raise ValueError("slot_minutes must divide 60")

    @property
    def slots_per_hour(self) -> int:
        return 60 // self.slot_minutes

    @property
    def slots_per_day(self) -> int:
        return 24 * self.slots_per_hour


DEFAULTS = Settings()
