"""Values that results must agree on, in one place. All fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Confidence weights of sources.
BASE_CONFIDENCE = {
    "ISSUER_MRF": 0.6,
    "ISSUER_TIC_MRF": 0.6,
    "CMS_PARTD": 0.65,
    "MARKETPLACE_API": 0.55,
    "SECRET_SHOPPER": 0.85,
    "CROWD": 0.5,
}
UNKNOWN_CONFIDENCE = 0.05
HALF_LIFE_DAYS = 90
AGREE_CEILING, AGREE_STEP, SINGLE_FACTOR, CONFLICT_FACTOR = 0.95, 0.2, 0.9, 0.5
CONFIRM_BELOW = 0.8
UNVERIFIED_FACTOR, DISPUTED_SCORE = 0.6, 0.1
STALE_DAYS, FILE_FRESH_DAYS, CATALOG_DAYS, GUIDANCE_DAYS = 180, 60, 8, 30
STALE_PENALTY = 0.1
# Grades and the least score of each.
GRADES = (("A", 0.85), ("B", 0.7), ("C", 0.5), ("D", 0.3))
CRITICAL_WEIGHT, KEPT_CONFIDENCE_WEIGHT = 0.3, 0.1

# Legal suffixes dropped from employer names.
EMPLOYER_SUFFIXES = (
    "INC", "INCORPORATED", "LLC", "LLP", "LP", "LTD", "CORP", "CORPORATION", "CO", "COMPANY", "PC", "PLLC", "PA", "GROUP",
    "HOLDINGS", "THE",
)

# States of each prescription drug plan region.
PDP_REGIONS = {
    "1": "NH ME", "2": "CT MA RI VT", "3": "NY", "4": "NJ", "5": "DE DC MD", "6": "PA WV", "7": "VA", "8": "NC", "9": "SC",
    "10": "GA", "11": "FL", "12": "AL TN", "13": "MI", "14": "OH", "15": "IN KY", "16": "WI", "17": "IL", "18": "MO",
    "19": "AR", "20": "MS", "21": "LA", "22": "TX", "23": "OK", "24": "KS", "25": "IA MN MT NE ND SD WY", "26": "NM",
    "27": "CO", "28": "AZ", "29": "NV", "30": "OR WA", "31": "ID UT", "32": "CA", "33": "HI", "34": "AK", "35": "AS",
    "36": "GU", "37": "MP", "38": "PR", "39": "VI",
}

# Turns a minute, a day and a month.
VISITOR_LIMITS = {"minute": 3, "day": 10, "month": 50}
NETWORK_LIMITS = {"minute": 10, "day": 30, "month": 150}
TURN_COST = 50_000
# What a site's turns may cost a month and a day, in millionths of a dollar.
SITE_LIMITS = {"month": 100_000_000, "day": 5_000_000}

# Premium payments in a year.
PERIODS = {"monthly": 12, "weekly": 52, "biweekly": 26, "semimonthly": 24}


@dataclass(frozen=True)
class CostPolicy:
    """Premium credit rules. The numbers are placeholders until a plan year's are published."""

    fpl_base: float = 15650.0
    fpl_step: float = 5500.0
    floor_pct: float = 100.0
    ceiling_pct: float = 400.0
    # Percent of the poverty line, percent of income expected as contribution.
    schedule: tuple[tuple[float, float], ...] = field(
        default=((0, 2.07), (133, 3.1), (150, 4.14), (200, 6.52), (250, 8.33), (300, 9.83), (400, 9.83))
    )
    # Highest percent of the poverty line, variant, actuarial value.
    csr_bands: tuple[tuple[float, str, float], ...] = field(default=((150, "94", 0.94), (200, "87", 0.87), (250, "73", 0.73)))
    silver_av: float = 0.7
    verify: bool = True
