"""Text rules on routes, alerts and places (P12-P18, P30, F19-F21, F23). Whole texts, Catalyst only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.scalars import _c

# ---- fixed values -------------------------------------------------------------------------
ROUTES = ("1", "2", "3", "4", "5", "6", "7", "A", "B", "C", "D", "E", "F", "G", "J", "L", "M", "N", "Q", "R", "S", "W", "Z", "GS", "FS", "H", "SIR")
LINE_PATTERN = r"(?<![\p{L}\p{N}\p{M}_])([1-7A-GJLMNQRSWZ])(?![\p{L}\p{N}\p{M}_])"
PLACE_PATTERN = r"(?U)(?:at|from|to|near)\s+([A-Z][a-z0-9]+(?:\s[A-Z][a-z0-9]+)*)"
STATUS_RULES = (
    ("Suspension", ("suspended", "part-suspended")),
    ("Severe Delay", ("severe-delays",)),
    ("Delay", ("delay",)),
    ("Service Change", ("reroute", "express-to-local", "stops-skipped", "boarding-change")),
    ("Cancellation", ("cancellations",)),
)
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
BODY_PLANNED = ("planned work",)
BODY_RESUMED = ("resumed", "regular service", "resolved")
BODY_DELAY = ("delay", "held", "waiting", "slower")
BODY_STORM = ("preparing for", "storm")
REASON_DOORS = ("door",)
REASON_SIGNALS = ("signal",)
REASON_MEDICAL = ("person on the tracks", "ems")
REASON_WORK = ("track", "work")
REASON_WEATHER = ("winter storm",)
BODY_CHANGE = ("running local", "running express", "rerouted", "bypass")
FLAG_DELAY = r"\bdelay\b"
FLAG_CHANGE = r"service\s*change"
FLAG_SUSPENSION = r"\bsuspension\b"
FLAG_PLANNED = r"planned\s*work|maintenance|weekend"
FLAG_SHOCK = r"signal\s*malfunction|sick\s*passenger|police|unauthorized|delay|suspension"
GROUP_PLANNED = "planned work|maintenance|weekend|service change"
GROUP_SHOCK = "signal|sick|police|unauthorized|delay|suspension|investigation"
# -------------------------------------------------------------------------------------------


def norm_route(col) -> Column:
    """P12."""
    return F.upper(F.trim(_c(col)))


def route_token(key) -> Column:
    """Second underscore token of a trip key, before the first dot."""
    return F.substring_index(F.try_element_at(F.split(_c(key), "_"), F.lit(2)), ".", 1)


def route_from_key(key) -> Column:
    """Recovered route, only when shorter than three characters."""
    tok = F.nullif(route_token(key), F.lit(""))
    return F.when(F.length(tok) < 3, tok)


def fill_route(route, key) -> Column:
    """Live variant, fills null or empty routes without the length rule."""
    return F.coalesce(F.nullif(F.trim(_c(route)), F.lit("")), F.nullif(route_token(key), F.lit("")))


def canonical_route(route, trip=None, known: tuple[str, ...] = ROUTES) -> Column:
    """Listed route, its suffix after ``-`` or ``_`` dropped, ``SI`` read as ``SIR``.

    With ``trip`` given, an unlisted route falls back to the first listed token of the trip id.
    """

    def listed(x: Column) -> Column:
        x = F.trim(x)
        base = F.regexp_replace(x, r"[-_].*$", "")
        return F.when(x.isin(*known), x).when(base.isin(*known), base).when(base == "SI", "SIR")

    out = listed(_c(route))
    if trip is None:
        return out
    tokens = F.transform(F.split(_c(trip), "_"), lambda x: F.substring_index(x, ".", 1))
    named = F.filter(F.transform(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), listed), lambda x: x.isNotNull())
    return F.coalesce(out, F.try_element_at(named, F.lit(1)))


def _any(text: Column, words) -> Column:
    out = None
    for w in words:
        hit = F.contains(text, F.lit(w))
        out = hit if out is None else out | hit
    return out


def _all(text: Column, words) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(text, F.lit(w))
    return out


def alert_category(status) -> Column:
    """Six-way category; the first matching rule wins."""
    s = F.lower(_c(status))
    out = None
    for name, words in STATUS_RULES:
        out = F.when(_any(s, words), name) if out is None else out.when(_any(s, words), name)
    return out.otherwise("Other")


def strip_tags(html) -> Column:
    """Visible text: comments, scripts and styles dropped, tags to spaces, basic entities read, white space collapsed."""
    raw = _c(html)
    t = F.regexp_replace(raw, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    t = F.when(F.contains(raw, F.lit("<")), t).otherwise(raw)
    for name, ch in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(ch))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def classify_alert_text(df: DataFrame, body: str) -> DataFrame:
    """Category, lines, reason, location and a 500 character snippet of an alert body.

    All rules read the whole text; the snippet is only what is shown.
    """
    text = F.col("_text")
    low = F.col("_low")
    lines = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(LINE_PATTERN), F.lit(1))))
    place = F.regexp_extract(text, PLACE_PATTERN, 1)
    category = (
        F.when(_any(low, BODY_RESUMED), "Service Resumed")
        .when(_all(low, BODY_STORM), "Weather Prep")
        .when(_any(low, BODY_DELAY), "Delay")
        .when(_any(low, BODY_CHANGE), "Service Change")
        .when(_any(low, BODY_PLANNED), "Planned Work")
        .otherwise("Info/Other")
    )
    reason = (
        F.when(_any(low, REASON_DOORS), "Mechanical (Doors)")
        .when(_any(low, REASON_SIGNALS), "Signal Problems")
        .when(_any(low, REASON_MEDICAL), "Medical/Police")
        .when(_all(low, REASON_WORK), "Maintenance")
        .when(_any(low, REASON_WEATHER), "Weather")
        .otherwise("Unknown")
    )
    return (
        df.withColumn("_text", strip_tags(body))
        .withColumn("_low", F.lower("_text"))
        .withColumn("category", category)
        .withColumn("lines", F.array_join(lines, ", "))
        .withColumn("reason", reason)
        .withColumn("location", F.when(place == "", "Multiple/System-wide").otherwise(place))
        .withColumn("text_snippet", F.substring("_text", 1, 500))
        .drop("_text", "_low")
    )


def alert_flags(category, description) -> dict[str, Column]:
    """Pattern flags; an unplanned shock is never planned work."""
    cat = F.lower(F.coalesce(_c(category), F.lit("")))
    des = F.lower(F.coalesce(_c(description), F.lit("")))
    planned = des.rlike(FLAG_PLANNED)
    return {
        "is_delay_alert": cat.rlike(FLAG_DELAY).cast("int"),
        "is_service_change_alert": cat.rlike(FLAG_CHANGE).cast("int"),
        "is_suspension_alert": cat.rlike(FLAG_SUSPENSION).cast("int"),
        "is_planned_work": planned.cast("int"),
        "is_unplanned_shock": (des.rlike(FLAG_SHOCK) & ~planned).cast("int"),
    }


def incident_group(*texts) -> Column:
    """Three-way group of the joined alert texts; planned wins over shock."""
    t = F.lower(F.concat_ws(" ", *[F.coalesce(_c(x), F.lit("")) for x in texts]))
    return F.when(t.rlike(GROUP_PLANNED), "planned").when(t.rlike(GROUP_SHOCK), "unplanned").otherwise("other")


def split_lines(col) -> Column:
    """affected lines on comma or bar, trimmed, upper case, blanks dropped."""
    return F.filter(F.transform(F.split(_c(col), r"[,|]"), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def is_platform(stop) -> Column:
    """P30."""
    return F.coalesce(_c(stop).rlike("[NS]$"), F.lit(False))


def base_stop(stop) -> Column:
    """P30."""
    return F.regexp_replace(_c(stop), "[NS]$", "")


def extract_stop_ids(nested) -> Column:
    """platform ids inside nested arrays, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(_c(nested)), lambda x: x.rlike("[NS]$"))))


def intersections(location, borough, city: str = "New York") -> Column:
    """``A between B and C`` segments to crossing texts, else the place itself."""
    tail = F.concat(F.lit(", "), _c(borough), F.lit(f", {city}"))

    def one(seg: Column) -> Column:
        parts = F.split(F.trim(seg), " between ")
        streets = F.filter(F.transform(F.split(F.try_element_at(parts, F.lit(2)), " and "), lambda x: F.trim(x)), lambda x: x != "")
        named = F.transform(streets, lambda x: F.concat(F.trim(F.element_at(parts, 1)), F.lit(" & "), x, tail))
        return F.when(F.size(parts) > 1, named).otherwise(F.array().cast("array<string>"))

    crossings = F.flatten(F.transform(F.split(_c(location), ","), one))
    return F.when(F.size(crossings) > 0, crossings).otherwise(F.array(F.concat(_c(location), tail)))
