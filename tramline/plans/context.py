"""Context tables of the pipelines: weather hours, service alerts, city events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions import fixed
from tramline.functions import scalars as sc
from tramline.functions import text as tx
from tramline.operators import aggregates, clean, windows
from tramline.operators.intervals import map_stations


def clean_weather(raw: DataFrame, ts: str = "Date", z_column: str = "Temperature") -> DataFrame:
    """Hourly weather: coerced, with a time and a temperature, without duplicates and daily outliers, with derived columns.

    Columns: Date, Temperature, Rain, Precipitation, Wind Speed, Snow, Cloud Cover.
    """
    need = [ts, "Temperature", "Rain", "Precipitation", "Wind Speed", "Snow", "Cloud Cover"]
    d = clean.require(raw, need)
    d = clean.coerce_types(d, {ts: "timestamp", **{c: "double" for c in need[1:]}})
    d = clean.drop_null_keys(d, [ts, "Temperature"]).distinct()
    d = d.withColumns({"service_date": F.to_date(ts), "hour": F.hour(ts)})
    d = clean.zscore_filter(d, z_column, ["service_date"])
    d = windows.rolling_rows_sum(d, ["service_date"], ["hour"], "Precipitation", 3, 24, "precip_3h_accum")
    flags = clean.weather_flags("precip_3h_accum", "Temperature", "Wind Speed", "Snow")
    d = d.withColumns(
        {
            "apparent_temp": sc.apparent_temp("Temperature", "Wind Speed"),
            "is_freezing": flags["is_freezing"],
            "is_high_wind": flags["is_high_wind"],
            "is_rush_hour": sc.is_rush("hour", "closed"),
        }
    )
    return aggregates.temp_extreme(d, ["service_date"], "Temperature")


def clean_alerts(raw: DataFrame, agency: str) -> DataFrame:
    """Raw updates to one row per alert and line: event_id, start, end, category, route_id, texts.

    Columns: event_id, status_label, affected, header, date, agency, description.
    """
    d = clean.filter_in(raw, "agency", [agency])
    d = aggregates.collapse_alerts(d, "event_id", "date", ["agency", "affected"], ["status_label", "header", "description"], ["header"])
    d = clean.drop_null_keys(d, ["event_id", "timestamp_start"])
    d = d.withColumn("category", tx.alert_category("status_label")).withColumn("route_id", F.explode(tx.split_lines("affected")))
    # lines of one alert are distinct; its updates count the repetitions
    d = d.select("event_id", "timestamp_start", "timestamp_end", "category", "route_id", "num_updates", F.col("header").alias("text_snippet"), "description").distinct()
    return d.withColumn("alert_s", F.unix_seconds(F.col("timestamp_start").cast("timestamp")))


def city_permits(raw: DataFrame, live: bool = False) -> DataFrame:
    """Street permits above the risk bound with their score. Columns: event_type and others."""
    if live:
        d = clean.map_score(raw, "event_type", fixed.LIVE_EVENT_RISK, fixed.LIVE_RISK_ABOVE + 1, "risk")
        return d.withColumn("score", F.col("risk") / 10)
    d = clean.map_score(raw, "event_type", fixed.EVENT_RISK, fixed.RISK_MINIMUM, "risk")
    return d.withColumn("score", sc.lookup("risk", fixed.RISK_SCORE))


def clean_events(raw: DataFrame, stops: DataFrame) -> DataFrame:
    """City events by platform: stations listed, named stops found, clock texts to seconds.

    ``raw``: nombre_evento, tipo, fecha_inicio, hora_inicio, hora_salida_estimada, score,
    paradas_afectadas array<struct<name, lines, lat, lon>>. ``stops``: stop_id, stop_name, stop_lat, stop_lon.
    """
    d = clean.clean_stations(raw, "paradas_afectadas").withColumn("_p", F.explode("paradas_afectadas"))
    d = d.select("nombre_evento", "tipo", "fecha_inicio", "hora_inicio", "hora_salida_estimada", "score", F.col("_p.name").alias("parada_nombre"), F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"))
    names = d.select("parada_nombre", "lat", "lon").distinct()
    found = map_stations(names, stops, "parada_nombre", "stop_name").select("parada_nombre", "stop_id").distinct()
    j = d.join(found, "parada_nombre").filter(tx.is_platform("stop_id"))
    return j.select(
        F.to_date("fecha_inicio").alias("service_date"), "stop_id", "nombre_evento", "tipo", "score",
        F.coalesce(sc.clock_to_seconds("hora_inicio"), F.lit(0)).alias("start_s"),
        F.coalesce(sc.clock_to_seconds("hora_salida_estimada"), F.lit(sc.DAY_S - 1)).alias("end_s"),
    ).distinct()
