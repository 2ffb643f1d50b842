"""Schemas, vocabularies and constants of the engine."""

from __future__ import annotations

RAW_POSTING = (
    "title string, company string, location string, description string, apply_url string, source_url string, "
    "salary_min_usd int, salary_max_usd int, salary_source string, category string, "
    "_cjl_company string, _discovery_channel string, _job_type string"
)

# Closed vocabularies.
FUNCTIONS = ("Community", "Design", "Engineering", "Marketing", "Operations", "Sales", "BizDev", "Product", "Other")
VERTICALS = ("DeFi", "L1", "L2", "CEX", "DEX", "Gaming", "Infrastructure", "NFT", "RWA", "Oracles", "AI-Crypto", "Fintech", "Payments", "AI", "SaaS", "Other")
SENIORITIES = ("Junior", "Mid", "Senior", "Lead", "Head", "Executive", "Unspecified")
REMOTE = ("Remote", "Hybrid", "Onsite", "Unspecified")
APPLICATION_STATUSES = ("saved", "applied", "interview", "offer", "rejected", "stale")
OPERATIONS = ("classify", "geo_filter", "cv_score", "cv_extract", "weekly_summary")

# Limits and thresholds.
INACTIVE_AFTER_DAYS, DELETE_AFTER_DAYS, STALE_AFTER_DAYS = 30, 60, 30
SUSPEND_AFTER = 7
WARM, CLASSIFY_MIN = 40, 40
MAX_AGE_DAYS = 30
RUN_CAPS = {"classify": 500, "geo_filter": 1000, "cv_score": 1000, "backlog": 2000}
BACKLOG_BELOW = 100
RESCUE_FLOOR, RESCUE_HITS, RESCUE_CAP = 35, 3, 100
SALARY_BAND = (30_000, 120_000)
SALARY_PENALTY = 5
GLOBAL_CAP_USD = 30
STAGE_CAPS_USD = {"classify": 5, "geo_filter": 5, "cv_score": 20, "cv_extract": 1}
PARSE_WARN, PARSE_FAIL = 0.05, 0.20
PRICE_IN, PRICE_OUT, CACHE_WRITE, CACHE_READ = 0.50, 2.50, 2.0, 0.1
TEXT_CAPS = {"title": 500, "company": 200, "location": 200, "description": 5000, "apply_url": 1000, "source": 100, "source_url": 1000}
