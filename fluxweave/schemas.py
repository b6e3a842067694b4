"""Schemas of the stored tables as DDL (no inference at read time)."""

TOUCHES = "time TIMESTAMP, device_id STRING, x_pos DOUBLE, y_pos DOUBLE, velocity DOUBLE"
EVENTS = "time TIMESTAMP, name STRING, event_type STRING"
TRANSITIONS = "time TIMESTAMP, transition_type STRING, spread DOUBLE, ratio DOUBLE"
APP_MESSAGES = "time TIMESTAMP, type STRING, device_id STRING, label STRING, value STRING"
ONLINE = "time TIMESTAMP, type STRING, device_id STRING, app_id STRING"
TARGETS = "time TIMESTAMP, target INT"
DESIGN = "time TIMESTAMP, perf_number INT, `group` INT, performance INT, button STRING, server STRING, overall STRING"
MESSAGES = "time TIMESTAMP, address STRING, tags STRING, args ARRAY<STRING>"
FEATURE_TYPES = {
    "centroid_x": "DOUBLE",
    "centroid_y": "DOUBLE",
    "std_x": "DOUBLE",
    "std_y": "DOUBLE",
    "freq": "LONG",
    "movement_freq": "LONG",
    "touchdown_freq": "LONG",
    "velocity": "DOUBLE",
    "gesture": "INT",
    "target": "INT",
}
