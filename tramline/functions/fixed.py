"""Fixed values of the transit domain: lookup tables that results depend on."""

# fixed values: risk by kind of city event (historical table)
EVENT_RISK = {
    "Parade": 10,
    "Athletic Race / Tour": 10,
    "Street Event": 8,
    "Stationary Demonstration": 7,
    "Street Festival": 7,
    "Special Event": 7,
    "Single Block Festival": 6,
    "Bike the Block": 6,
    "BID Multi-Block": 6,
    "Plaza Event": 6,
    "Plaza Partner Event": 6,
    "Block Party": 5,
    "Theater Load in and Load Outs": 5,
    "Open Culture": 4,
    "Religious Event": 3,
    "Press Conference": 3,
    "Health Fair": 3,
    "Rigging Permit": 3,
    "Farmers Market": 2,
    "Sidewalk Sale": 2,
    "Shooting Permit": 2,
    "Filming/Photography": 2,
    "Open Street Partner Event": 2,
    "Production Event": 1,
    "Sport - Adult": 1,
    "Sport - Youth": 1,
    "Miscellaneous": 1,
    "Stickball": 1,
    "Clean-Up": 1,
}
# fixed values: the live table differs in one kind; live events must exceed 6, historical ones reach 8
LIVE_EVENT_RISK = {**EVENT_RISK, "Special Event": 6}
RISK_MINIMUM = 8
LIVE_RISK_ABOVE = 6
RISK_SCORE = {8: 0.8, 9: 0.9, 10: 1.0}

# fixed values: hours from start to exit
EVENT_HOURS = {"concert": 3.0, "music_festival": 8.0, "classical": 2.5, "opera": 3.0, "ballet": 2.5}
GAME_HOURS = {"nba": 2.5, "mlb": 3.0, "nhl": 2.5, "nfl": 3.5, "usa.1": 2.0}
DEFAULT_HOURS = 2.5
CONCERT_HOURS = 3.0

# fixed values: usual start by venue
VENUE_START = {
    "Madison Square Garden": "19:30",
    "Barclays Center": "19:30",
    "UBS Arena": "19:30",
    "Forest Hills Stadium": "18:00",
    "Kings Theatre": "20:00",
    "Brooklyn Paramount": "20:00",
    "Amazura Concert Hall": "21:00",
    "Great Lawn (Central Park)": "16:00",
    "Flushing Meadows Park": "13:00",
    "Under the K Bridge": "18:00",
    "Lincoln Center": "19:30",
}
DEFAULT_START = "20:00"

# fixed values: venues and cities of home games
HOME_VENUES = ("Madison Square Garden", "UBS Arena", "Prudential Center", "Yankee Stadium", "Citi Field", "MetLife Stadium", "Red Bull Arena")
HOME_CITIES = ("New York", "Elmont", "Newark", "East Rutherford", "Harrison")

# fixed values: columns of a training row, in order
FINAL_COLUMNS = (
    "date", "match_key", "stop_id", "route_id", "direction", "delay_seconds", "lagged_delay_1", "lagged_delay_2", "route_rolling_delay",
    "actual_headway_seconds", "is_unscheduled", "hour_sin", "hour_cos", "dow", "is_weekend",
    "target_delay_10m", "target_delay_20m", "target_delay_30m", "target_delay_45m", "target_delay_60m",
    "station_delay_10m", "station_delay_20m", "station_delay_30m", "target_delay_end",
    "delta_delay_10m", "delta_delay_20m", "delta_delay_30m", "delta_delay_45m", "delta_delay_60m", "delta_delay_end",
    "stops_to_end", "merge_time", "scheduled_time_to_end", "temp_extreme",
    "n_eventos_afectando", "tipo_referente", "afecta_previo", "afecta_durante", "afecta_despues",
    "category", "num_updates", "timestamp_start", "seconds_since_last_alert", "is_alert_just_published",
    "seconds_to_next_alert", "alert_in_next_15m", "alert_in_next_30m",
)

# fixed values: lines with much open track
EXTERIOR_LINES = ("7", "N", "Q", "J", "Z", "B", "D")
