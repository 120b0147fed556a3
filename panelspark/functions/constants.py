"""Fixed values.

These must equal the published ones for results to agree, so they are stated
here as plain text in their natural order.
"""

# Label classes, in report order, and their signed direction.
DECISION_CLASSES = ("cut", "hold", "hike")
DIRECTION = {"cut": -1, "hold": 0, "hike": 1}

# The two regimes of a spliced state series.
POINT_REGIME = "point_target"
RANGE_REGIME = "target_range"
POLICY_REGIMES = (POINT_REGIME, RANGE_REGIME)

# Labels and alignment.
RATE_CHANGE_TOLERANCE_BPS = 0.25
STATE_TOLERANCE_DAYS = 7
MARKET_MAX_AGE_DAYS = 10
NO_PRIOR_CHANGE_DAYS = 3650

# Context features.
INFLATION_TARGET_PERCENT = 2.0
LABOUR_WEIGHT = 0.5

# Windows, in calendar months.
RATE_CHANGE_MONTHS = (1, 3)
INFLATION_CHANGE_MONTHS = (1, 3)
INFLATION_MEAN_MONTHS = (3, 6)
LABOUR_CHANGE_MONTHS = (1, 3)
LABOUR_MEAN_MONTHS = (3,)

# Evaluation.
RANDOM_STATE = 42
CV_SPLITS = 5
TEST_FRACTION = 0.2
NUM_TREES = 300
GRID_MAX_DEPTH = (5, 10, None)
GRID_MIN_LEAF = (1, 3, 5)
GRID_MAX_FEATURES = ("sqrt", "0.5")
GRID_CLASS_WEIGHT = (None, "balanced")
SEED_RANGE = range(0, 101)
RANKING_LIMIT = 10
CHART_FEATURES = 15

# Page extraction limits.
MAX_TITLE_CHARS = 300
MAX_HEADINGS = 40
MAX_HEADING_CHARS = 300
MAX_TABLES = 5
MAX_TABLE_ROWS = 5
MAX_TABLE_COLUMNS = 12
MAX_CELL_CHARS = 500

# Market series that enter the model, and the (yield, spread) pairs.
MARKET_COLUMNS = (
    "treasury_3m_pct",
    "treasury_6m_pct",
    "treasury_1y_pct",
    "treasury_2y_pct",
    "treasury_5y_pct",
    "treasury_10y_pct",
    "curve_10y_minus_2y_pct",
    "curve_10y_minus_3m_pct",
)
SPREAD_PAIRS = (
    ("treasury_3m_pct", "treasury_3m_minus_funds_pct"),
    ("treasury_6m_pct", "treasury_6m_minus_funds_pct"),
    ("treasury_1y_pct", "treasury_1y_minus_funds_pct"),
    ("treasury_2y_pct", "treasury_2y_minus_funds_pct"),
    ("treasury_5y_pct", "treasury_5y_minus_funds_pct"),
    ("treasury_10y_pct", "treasury_10y_minus_funds_pct"),
)

# Model features in their exact output order, then the two targets.
FEATURE_COLUMNS = (
    "rate_level",
    "rate_chg_1m",
    "rate_chg_3m",
    "pce_yoy",
    "pce_yoy_chg",
    "pce_yoy_chg3",
    "pce_yoy_ma3",
    "pce_yoy_ma6",
    "unemployment",
    "unemp_chg",
    "unemp_chg3",
    "unemp_ma3",
    "natural_unemployment",
    "abs_inflation_gap",
    *MARKET_COLUMNS,
    *(spread for _, spread in SPREAD_PAIRS),
    "is_scheduled",
    "prior_decision",
    "prior_is_change",
    "prior2_is_change",
    "prior3_change_count",
    "prior3_direction",
    "prior_rate_change_bps",
    "same_direction_streak",
    "days_since_prior_meeting",
    "days_since_prior_change",
)
TARGET_COLUMNS = ("is_change", "decision")
LABEL_COLUMNS = (
    "policy_date_after",
    "target_lower_after",
    "target_upper_after",
    "policy_rate_after",
    "policy_regime_after",
    "rate_change_bps",
    *TARGET_COLUMNS,
)
LEAKAGE_MARKERS = ("future", "lead", "next_", "_after", "label")

# Columns of the clean event panel.
CLEAN_COLUMNS = (
    "meeting_date",
    "is_scheduled",
    "source_url",
    "pce_reference_date",
    "pce_index",
    "pce_yoy",
    "unemployment_reference_date",
    "unemployment",
    "natural_unemployment_reference_date",
    "natural_unemployment",
    "policy_date_before",
    "target_lower_before",
    "target_upper_before",
    "policy_rate_before",
    "policy_regime_before",
    "policy_date_after",
    "target_lower_after",
    "target_upper_after",
    "policy_rate_after",
    "policy_regime_after",
    "rate_change_bps",
    "decision",
    "is_change",
)

# Declared series: logical name, series id, frequency, role.
SERIES_CATALOG = (
    ("target_rate", "DFEDTAR", "daily", "policy"),
    ("target_upper", "DFEDTARU", "daily", "policy"),
    ("target_lower", "DFEDTARL", "daily", "policy"),
    ("pce_index", "PCEPI", "monthly", "inflation"),
    ("unemployment", "UNRATE", "monthly", "labour"),
    ("natural_unemployment", "NROU", "quarterly", "labour"),
    ("treasury_3m_pct", "DGS3MO", "daily", "market"),
    ("treasury_6m_pct", "DGS6MO", "daily", "market"),
    ("treasury_1y_pct", "DGS1", "daily", "market"),
    ("treasury_2y_pct", "DGS2", "daily", "market"),
    ("treasury_5y_pct", "DGS5", "daily", "market"),
    ("treasury_10y_pct", "DGS10", "daily", "market"),
    ("treasury_30y_pct", "DGS30", "daily", "market"),
    ("real_5y_tips_pct", "DFII5", "daily", "market"),
    ("real_10y_tips_pct", "DFII10", "daily", "market"),
    ("real_30y_tips_pct", "DFII30", "daily", "market"),
    ("curve_10y_minus_2y_pct", "T10Y2Y", "daily", "market"),
    ("curve_10y_minus_3m_pct", "T10Y3M", "daily", "market"),
    ("breakeven_inflation_5y_pct", "T5YIE", "daily", "market"),
    ("breakeven_inflation_10y_pct", "T10YIE", "daily", "market"),
    ("investment_grade_oas_pct", "BAMLC0A0CM", "daily", "market"),
    ("high_yield_oas_pct", "BAMLH0A0HYM2", "daily", "market"),
)

# Month names accepted on calendar pages.
MONTH_NUMBERS = {
    "jan": 1, "january": 1,
    "feb": 2, "february": 2,
    "mar": 3, "march": 3,
    "apr": 4, "april": 4,
    "may": 5,
    "jun": 6, "june": 6,
    "jul": 7, "july": 7,
    "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10,
    "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}

# Page patterns: the yearly panel title and the archive heading.
PANEL_TITLE = r"(?i)\b(\d{4})\s+FOMC\s+Meetings\b"
ARCHIVE_HEADING = r"(?i)^(.+?)\s+(Meeting|Conference Call)\s+-\s+(\d{4})$"
