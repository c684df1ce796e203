"""Fixed values shared by operators: thresholds, weights, horizons and capacities."""

# Forecast horizons as (label, seconds).
HORIZONS = [
    ("15s", 15),
    ("30s", 30),
    ("1m", 60),
    ("5m", 300),
    ("15m", 900),
    ("30m", 1800),
    ("60m", 3600),
    ("120m", 7200),
    ("180m", 10800),
]
SHORT_HORIZONS = ["15s", "30s", "1m", "5m", "15m"]

# Sampling and forecast scoring.
SAMPLE_INTERVAL = 15.0
MIN_MODEL_SCORES = 8
TARGET_ACCURACY = 85.0
TOLERANCE_INTERVALS = 1.5
CANDIDATE_ERROR_WINDOW = 100
HORIZON_ERROR_WINDOW = 500

# Risk bands.
RISK_CUTS = (0.25, 0.50, 0.75)
RISK_LABELS = ("SAFE", "WATCH", "HIGH", "CRITICAL")
TWO_LEVEL_CUT = 0.65
TWO_LEVEL_LABELS = ("NO STAMPEDE", "STAMPEDE")
INDEX_CUT = 65.0
MIN_CROWD = 1.0

# Zone grid.
ZONE_CAPACITY = ((300, 400, 300), (350, 500, 350), (300, 400, 300))
MIN_HOTSPOT = 30.0
GROWING_CUT = 0.015
CRITICAL_CUT = 0.04

# Motion.
MOTION_FLOOR = 0.5
OPPOSING_FLOOR = 0.3
MIN_ACTIVE_RATIO = 0.08
OPPOSING_DANGER = 0.35
SPEED_ALPHA = 0.35

# Exponential smoothing.
PRESSURE_ALPHA = 0.15
COUNT_ALPHA = 0.65

# Optics.
SENSOR_HFOV = 80.0
BASELINE_PX_PER_M = 50.0
INFER_WIDTH = 512

# Vehicle classes.
VEHICLE_CLASSES = {1: "bicycle", 2: "car", 3: "motorcycle", 4: "uav", 5: "bus", 7: "truck"}

# Cooldowns and freshness, in seconds.
ALERT_COOLDOWN = 60.0
NOTIFY_COOLDOWN = 30.0
STALE_AFTER = 20.0

# Longest stretch of one key's timeline handled together by one task, in seconds.
CHUNK_SECONDS = 3600.0
# Rows a chunk of time should not exceed; denser timelines get shorter chunks.
CHUNK_ROWS = 1_000_000
# Rows of one key's timeline handled together where frames count rows.
BLOCK_ROWS = 1000
# Rows that a task which sorts or groups them should not exceed, and rows worth a task of their own.
TASK_ROWS = 2_000_000
SMALL_TASK_ROWS = 100_000
