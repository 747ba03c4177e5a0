"""Fixed values that results depend on. Nothing here is computed."""

from __future__ import annotations

# Plain metrics, one mart column each.
METRIC_COLUMNS = (
    "NEW_CASES",
    "NEW_DEATHS",
    "CASES_7DMA",
    "DEATHS_7DMA",
    "NEW_CASES_PER_100K",
    "NEW_DEATHS_PER_100K",
    "TOTAL_VACCINATIONS",
    "PEOPLE_VACCINATED",
    "PEOPLE_FULLY_VACCINATED",
    "DAILY_VACCINATIONS",
    "TOTAL_VACCINATIONS_PER_HUNDRED",
    "PEOPLE_VACCINATED_PER_HUNDRED",
    "PEOPLE_FULLY_VACCINATED_PER_HUNDRED",
)

# Metrics that need the yearly table.
GDP_METRIC = "GDP_PPP_PER_CAPITA"
GDP_VS_CASES_METRIC = "GDP_VS_CASES_PER100K_YEAR"
GDP_METRICS = (GDP_METRIC, GDP_VS_CASES_METRIC)

# Metrics offered to users, in display order (label, metric).
METRIC_CHOICES = (
    ("New Cases", "NEW_CASES"),
    ("New Cases per 100k", "NEW_CASES_PER_100K"),
    ("New Deaths", "NEW_DEATHS"),
    ("New Deaths per 100k", "NEW_DEATHS_PER_100K"),
    ("Total Vaccinations", "TOTAL_VACCINATIONS"),
    ("Daily Vaccinations", "DAILY_VACCINATIONS"),
    ("People Vaccinated", "PEOPLE_VACCINATED"),
    ("People Fully Vaccinated", "PEOPLE_FULLY_VACCINATED"),
    ("Total Vaccinations per 100", "TOTAL_VACCINATIONS_PER_HUNDRED"),
    ("People Vaccinated per 100", "PEOPLE_VACCINATED_PER_HUNDRED"),
    ("People Fully Vaccinated per 100", "PEOPLE_FULLY_VACCINATED_PER_HUNDRED"),
    ("GDP PPP per Capita", "GDP_PPP_PER_CAPITA"),
    ("GDP vs Cases per 100k (Year)", "GDP_VS_CASES_PER100K_YEAR"),
)

# Date bounds, and the open range used when comments are listed without one.
FIRST_DAY = "2020-01-01"
LAST_DAY = "2023-12-31"
COMMENTS_FROM = "2020-01-01"
COMMENTS_TO = "2100-01-01"

# Spellings of the serial-number column of the yearly file.
SERIAL_COLUMNS = ("Sr.No", "Sr. No", "S.No", "S No")

# Pattern names, parameter bounds and defaults.
STREAKS = "Rising streaks (cases)"
SPIKES = "Spike day (cases)"
SURGES = "Vaccination surge"
RUN_LENGTH_BOUNDS = (2, 30)
SPIKE_BOUNDS = (1.1, 10.0)
STREAK_LENGTH = 3
SPIKE_MULTIPLIER = 1.5
SURGE_LENGTH = 5

# Column headings of the pattern tables.
PATTERN_HEADINGS = {
    STREAKS: {
        "country": "Country",
        "start_day": "Start Day",
        "end_day": "End Day",
        "streak_len": "Streak Length (days)",
        "start_cases": "Cases (start)",
        "end_cases": "Cases (end)",
    },
    SPIKES: {
        "country": "Country",
        "spike_day": "Spike Day",
        "prev_cases": "Cases (prev day)",
        "spike_cases": "Cases (spike day)",
        "pct_jump": "Jump (%)",
    },
    SURGES: {
        "country": "Country",
        "start_day": "Start Day",
        "end_day": "End Day",
        "surge_len": "Surge Length (days)",
        "total_new_shots": "Total Doses (surge)",
        "start_shots": "Doses (start)",
        "end_shots": "Doses (end)",
    },
}

# Tier names from low to high, and reasons a series is left out of clustering.
TIERS = ("Low GDP", "Mid GDP", "High GDP")
NO_SERIES = "empty-or-non-datetime"
FEW_WEEKS = "insufficient-weekly-points"
NO_FEATURES = "insufficient-features"

# Clustering window, cluster counts, restarts, seed, ratio guard.
WINDOW_DAYS_BOUNDS = (30, 400)
WINDOW_DAYS = 180
MIN_WEEKS = 4
CLUSTERS = (2, 4)
RESTARTS = 10
SEED = 42
RATIO_GUARD = 1e-6

# Forecast horizon, season, fewest points, interval width, fewest residuals.
HORIZON_BOUNDS = (7, 90)
HORIZON = 14
SEASON_DAYS = 7
FEWEST_POINTS = 10
INTERVAL_Z = 1.96
FEW_RESIDUALS = 3

# Bubble sizes, newest comments returned, placeholder texts.
BUBBLE_SCALE = 40
BUBBLE_OFFSET = 6
NEWEST_COMMENTS = 200
NO_USER = "—"
NO_COMMENTS = "No comments yet."
