"""Scalar functions on time, geography and delay (F1-F18, F24-F28). Column in, Column out."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
DAY_S = 86_400
HALF_DAY_S = 43_200


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clock_to_seconds(col) -> Column:
    """``HH:MM[:SS]`` (hours may exceed 24) to seconds; malformed text gives null."""
    p = F.split(_c(col), ":")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + F.when(F.size(p) >= 3, part(3)).otherwise(0)


def epoch_to_local_seconds(col, tz: str) -> Column:
    """epoch seconds to local seconds past midnight; daylight saving follows ``tz``."""
    local = F.from_utc_timestamp(F.timestamp_seconds(_c(col)), tz)
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def seconds_to_clock(col) -> Column:
    """seconds to ``HH:MM:SS`` on a 24 h clock."""
    s = F.pmod(F.floor(_c(col)).cast("bigint"), F.lit(DAY_S))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(_c(col).isNotNull(), F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60)))


def wrap_delay(col) -> Column:
    """a difference of more than half a day belongs to the neighbouring day."""
    c = _c(col)
    return F.when(c > HALF_DAY_S, c - DAY_S).when(c < -HALF_DAY_S, c + DAY_S).otherwise(c)


def trip_key(col) -> Column:
    """key part of a trip id: six digits, underscore, rest; null when absent."""
    return F.nullif(F.regexp_extract(_c(col), r"_(\d{6}_.*)$", 1), F.lit(""))


def service_day(col) -> Column:
    """service calendar, the second last dash-separated token."""
    return F.try_element_at(F.split(_c(col), "-"), F.lit(-2))


def short_trip(col) -> Column:
    """trip id after the first underscore."""
    return F.regexp_replace(_c(col), r"^[^_]*_", "")


def wrap_clock(col) -> Column:
    """clock text with the hour taken modulo 24."""
    p = F.split(_c(col), ":")
    h = F.try_element_at(p, F.lit(1)).try_cast("int") % 24
    return F.concat_ws(":", F.lpad(h.cast("string"), 2, "0"), F.try_element_at(p, F.lit(2)), F.coalesce(F.try_element_at(p, F.lit(3)), F.lit("00")))


def event_hour(scheduled, actual) -> Column:
    """F8: hour from scheduled, else actual seconds."""
    return F.pmod(F.floor(F.coalesce(_c(scheduled), _c(actual)) / 3600), F.lit(24)).cast("int")


def hour_sin(hour) -> Column:
    """F9."""
    return F.sin(_c(hour) * (2 * math.pi / 24))


def hour_cos(hour) -> Column:
    """F9."""
    return F.cos(_c(hour) * (2 * math.pi / 24))


def decode_hour(sin, cos) -> Column:
    """inverse of the cyclic encoding."""
    return F.pmod(F.round(F.atan2(_c(sin), _c(cos)) * (24 / (2 * math.pi))), F.lit(24)).cast("int")


def dow(ts) -> Column:
    """Monday = 0."""
    return F.weekday(_c(ts))


def is_weekend(ts) -> Column:
    """F10."""
    return (F.weekday(_c(ts)) >= 5).cast("int")


def day_kind(ts) -> Column:
    """calendar label of the schedule."""
    d = F.weekday(_c(ts))
    return F.when(d == 5, "Saturday").when(d == 6, "Sunday").when(d.isNotNull(), "Weekday")


def period_of_day(hour) -> Column:
    """F11."""
    h = _c(hour)
    return (
        F.when(h.between(6, 9), "morning_peak")
        .when(h.between(10, 15), "midday")
        .when(h.between(16, 19), "evening_peak")
        .when(h.isNotNull(), "off_peak")
    )


def is_rush(hour, variant: str = "closed") -> Column:
    """two published rush definitions: 7-9 and 16-19, or [7,9) and [17,19)."""
    h = _c(hour)
    cond = (h.between(7, 9) | h.between(16, 19)) if variant == "closed" else (((h >= 7) & (h < 9)) | ((h >= 17) & (h < 19)))
    return F.coalesce(cond, F.lit(False)).cast("int")


def direction(stop_id) -> Column:
    """platform letter at the end of a stop id."""
    last = F.right(_c(stop_id), F.lit(1))
    return F.when(last.isin("N", "S"), last)


def direction_code(stop_id) -> Column:
    """N = 1, S = 0."""
    d = direction(stop_id)
    return F.when(d == "N", 1).when(d == "S", 0)


def merge_time(service_date, actual_clock, scheduled_clock) -> Column:
    """service date plus the actual, else scheduled clock; unreadable clocks give null."""
    clock = F.coalesce(_c(actual_clock), _c(scheduled_clock))
    return F.try_to_timestamp(F.concat_ws(" ", _c(service_date).cast("string"), clock), F.lit("yyyy-MM-dd HH:mm:ss"))


def apparent_temp(t, wind) -> Column:
    """wind chill index (Celsius, km/h)."""
    t, v = _c(t), F.pow(_c(wind), F.lit(0.16))
    return F.lit(13.12) + F.lit(0.6215) * t - F.lit(11.37) * v + F.lit(0.3965) * t * v


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """great circle distance in metres."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dp, dl = p2 - p1, F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dp / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), F.lit(2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bin_interval(col, edges: Sequence[float], labels: Sequence | None = None) -> Column:
    """F16: class of right-closed intervals (-inf, e0], (e0, e1], ..., (en, inf)."""
    c = _c(col)
    labels = list(range(len(edges) + 1)) if labels is None else list(labels)
    out = F.when(c.isNull(), None)
    for e, lab in zip(edges, labels):
        out = out.when(c <= e, lab)
    return out.otherwise(labels[-1])


# fixed values: class edges in seconds
DELAY_CLASS_EDGES = (-60, 60, 180, 300, 450)
DELAY_BUCKET_EDGES = (0, 60, 300)


def delay_features(delay="delay", lag1="lag1", lag2="lag2", stops_left="stops_left", time_left="time_left") -> dict[str, Column]:
    """derived delay features."""
    d, l1, l2 = _c(delay), _c(lag1), _c(lag2)
    return {
        "delay_velocity": d - l1,
        "delay_acceleration": (d - l1) - (l1 - l2),
        "delay_x_stops": d * _c(stops_left),
        "delay_ratio": d / (_c(time_left) + 1),
    }


def trend_features(
    delay="delay", lag1="lag1", lag2="lag2", route_mean="route_mean", station10="station_10m", station20="station_20m",
    time_left="time_left", n_events="n_events", phases=("before", "during", "after"),
) -> dict[str, Column]:
    """trend, inertia and event features of the delta models."""
    d, l1, l2 = _c(delay), _c(lag1), _c(lag2)
    impact = None
    for p in phases:
        impact = _c(p).cast("int") if impact is None else impact + _c(p).cast("int")
    return {
        "delay_change": d - l1,
        "delay_change_prev": l1 - l2,
        "delay_accel": (d - l1) - (l1 - l2),
        "delay_vs_route": d - _c(route_mean),
        "delay_vs_station": d - F.coalesce(_c(station10), d),
        "station_trend": _c(station10) - _c(station20),
        "delay_time_ratio": d / (_c(time_left) + 1.0),
        "has_alert": F.coalesce((_c(n_events) > 0).cast("int"), F.lit(0)),
        "alert_impact": impact,
    }


def time_bin(t, width: int) -> Column:
    """start of the bin of a numeric time."""
    return (F.floor(_c(t) / width) * width).cast("bigint")


def rel_bin(x, w: float = 5) -> Column:
    """F25."""
    return (F.floor(_c(x) / w) * w).cast("bigint")


def present_delay(col) -> Column:
    """non-negative minutes shown to a rider; null where there is no prediction."""
    return at_least_zero(col) / 60


def at_least_zero(col) -> Column:
    """Negative values as 0; null stays null."""
    return F.when(_c(col).isNotNull(), F.greatest(_c(col), F.lit(0.0)))


def event_end_hours(kind, durations: dict[str, float], default: float = 2.5) -> Column:
    """planned duration by event type."""
    out = None
    for k, v in durations.items():
        out = F.when(_c(kind) == k, v) if out is None else out.when(_c(kind) == k, v)
    return F.lit(default) if out is None else out.otherwise(default)


def lookup(col, mapping: dict, default=None) -> Column:
    """Small fixed mapping as a map literal."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    got = F.try_element_at(m, _c(col))
    return got if default is None else F.coalesce(got, F.lit(default))
