"""Dates, years and thresholds of the analyses.

The snapshot dates are configuration, never the wall clock: a report must give
the same answer on every run over the same data.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Config:
    # Snapshot dates.
    age_anchor: date = date(2014, 1, 28)
    segment_anchor: date = date(2014, 1, 28)
    report_anchor: date = date(2013, 12, 31)

    # Year-over-year comparison of the two reports.
    prior_year: int = 2012
    current_year: int = 2013

    # Single-period analyses.
    ranking_year: int = 2014
    focus_year: int = 2013
    focus_month: int = 12

    # Sizes of the ranked lists.
    top_customers: int = 10
    top_products: int = 5
    idle_customers: int = 3

    # Catalogue cost ranges (inclusive upper bounds, whole money units).
    cost_low: int = 99
    cost_mid: int = 500
    cost_high: int = 1000

    # Customer segments: months and spend.
    new_months: int = 3
    settled_months: int = 12
    active_months: int = 2
    slipping_months: int = 4
    lost_months: int = 12
    vip_spend: int = 5000
    growth_spend: int = 1000
    mid_stage_months: int = 11

    # Product report: inclusive upper bounds unless named otherwise.
    recency_active: int = 2
    recency_slow: int = 6
    recency_at_risk: int = 12
    sales_mid_from: int = 10_000
    sales_high_above: int = 50_000
    lifespan_short: int = 6
    lifespan_standard: int = 12
    margin_high_above: float = 0.40
    margin_stable_from: float = 0.15
    profit_steady_from: int = 5_000
    profit_massive_above: int = 20_000
    occasional_orders: int = 5
