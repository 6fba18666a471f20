"""Constants of the model (fixed values) and run limits."""

HOUR_MS = 3_600_000
NOW_MS = 1_706_659_200_000  # 2024-01-31T00:00:00Z, the clock of the test views
ANCHOR_GAP_H, REFERENCE_POPULATION = 12.0, 10_000.0
POPULATION_EXPONENT = 0.5
TIER_FACTOR = {1: 0.7, 2: 1.0, 3: 1.4}
RATE_MIN, RATE_MAX = 1 / 72, 1 / 2
PRIOR_STRENGTH, MIN_COHORT_GAPS = 3, 3
SEPARATION_H, GAP_FLOOR_H = 0.5, 1 / 60
Z_CRITICAL, EPSILON = 1.96, 1e-12
GATE_HOURS, GATE_NATS = 6.0, 3.0
TIME_WINDOW_H, TEXT_BLOCK, SNIPPET = 72, 0.35, 600
ADMIT, AMBIGUOUS_LOW, WEAK_BRIDGE = 0.60, 0.45, 0.75
MAX_DEPTH, MAX_UNRESOLVED = 6, 200
PRIOR_MATCH = 0.06
#: Fixed values: (agreement, disagreement) probabilities of each comparison level.
MATCH_TABLE = {
    "geo": {"same": (0.88, 0.10), "adjacent": (0.04, 0.24), "far": (0.06, 0.61), "unknown": (0.02, 0.05)},
    "time": {"lt6h": (0.70, 0.12), "lt24h": (0.22, 0.23), "lt72h": (0.07, 0.35), "beyond": (0.01, 0.30)},
    "text": {"high": (0.55, 0.03), "med": (0.33, 0.17), "low": (0.12, 0.80)},
    "source": {"same": (0.45, 0.38), "diff": (0.55, 0.62)},
}
FUZZY_MIN, UNKNOWN_BAR = 0.55, 0.6
MAX_TITLE, MAX_TEXT, MAX_ARTICLES = 300, 1800, 6
SILENT_GAPS = 3.0  # expected gaps after which a silence is reported
POLL_IDLE_S, POLL_RUNNING_S = 5.0, 1.2
TOP_ESCALATIONS, TOP_AMBIGUOUS, INCIDENT_CAP = 8, 12, 200
