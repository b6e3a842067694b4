"""The codes, groups and names that results depend on."""

# --- fixed values -----------------------------------------------------------

# Gesture code -> state number.
GESTURE_CODES = {"N": 0, "FT": 1, "ST": 2, "FS": 3, "FSA": 4, "VSS": 5, "BS": 6, "SS": 7, "C": 8, "?": 9}

# State number -> short name.
GESTURE_NAMES = {0: "n", 1: "ft", 2: "st", 3: "fs", 4: "fsa", 5: "vss", 6: "bs", 7: "ss", 8: "c"}

# State number -> group: none, taps, swipes, swirls, combo.
GESTURE_GROUPS = {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 3, 8: 4, 9: 4}
GROUP_NAMES = {0: "none", 1: "taps", 2: "swipes", 3: "swirls", 4: "combo"}

# State number -> scoring group, used only by the graded match score.
SCORING_GROUPS = {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 3, 7: 3, 8: 4, 9: 5}

# Ensemble state -> number.
ENSEMBLE_STATES = {"stasis": 0, "convergence": 1, "divergence": 2, "development": 3}

# Performance type number -> name.
PERFORMANCE_TYPES = {
    0: "Performance-Local",
    1: "Performance-Remote",
    2: "Experiment-Both",
    3: "Experiment-None",
    4: "Experiment-Button",
    5: "Experiment-Server",
    6: "Experiment-ButtonFade",
}

# Study tablets -> seat number.
DEVICE_SEATS = {
    "BD49B35A-8999-4987-9759-8D3F28D1292B": 1,
    "9A5116EA-2793-4C75-AC93-524C9EF550FD": 2,
    "1A56F5DD-C5B6-4E56-8690-E5A12BAA7E78": 3,
    "24C41EC3-7ECC-40DA-B942-7ABE23017E74": 4,
}

# Study group and seat -> participant.
PARTICIPANTS = {
    (1, 1): "A",
    (1, 2): "B",
    (1, 3): "C",
    (1, 4): "D",
    (2, 1): "E",
    (2, 2): "F",
    (2, 3): "G",
    (2, 4): "H",
    (3, 1): "I",
    (3, 2): "J",
    (3, 3): "K",
    (3, 4): "L",
    (4, 1): "M",
    (4, 2): "N",
    (4, 3): "O",
    (4, 4): "P",
}

# Columns of a feature vector, in model order.
FEATURE_COLUMNS = [
    "centroid_x",
    "centroid_y",
    "std_x",
    "std_y",
    "freq",
    "movement_freq",
    "touchdown_freq",
    "velocity",
]

# Sentinels and thresholds.
NO_CENTROID = -1.0
BAD_TARGET = 100
SCREEN_WIDTH, SCREEN_HEIGHT = 1024.0, 768.0
FEATURE_SECONDS, TICK_SECONDS, FLUX_SECONDS, TRAILING_SECONDS = 5, 1, 15, 37
ROLLING_ROWS = 15
NEW_IDEA_LIVE, NEW_IDEA_POSTHOC, NEW_IDEA_EXPERIMENTAL = 0.3, 0.15, 0.8
DEBOUNCE_SECONDS = 10
TOUCH_RETENTION_SECONDS, GESTURE_RETENTION_SECONDS, GESTURE_RETENTION_ROWS = 5, 60, 300
FOREST_TREES, FOREST_FEATURES = 100, 3
PLAYBACK_FPS, COLOUR_SLOTS = 25, 14

# --- end of fixed values ----------------------------------------------------

PERF, DEV, TIME = "performance_id", "device_id", "time"
N_GROUPS, N_STATES = 5, 9
