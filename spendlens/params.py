"""Parameters of every report, gathered in one dataclass.

Defaults are the reference service's thresholds.  ``as_of`` replaces every
wall-clock read of the reference: reports never look at the clock.
"""

from __future__ import annotations

import dataclasses
import datetime as _dt

from . import fixed

@dataclasses.dataclass(frozen=True)
class Params:
    # time
    as_of: _dt.date = _dt.date(2001, 8, 1)
    min_year: int = 2016            # history never starts before this year
    history_years: int = 5          # forecast window: target-5 .. target
    recommendation_years: int = 2   # recommendation window: target-2 .. target
    quick_recommendation_years: int = 1
    # labels
    unknown_label: str = fixed.UNKNOWN_LABEL
    # monitoring
    trend_years: int = 3
    trend_divisor: float = 3.0
    month_band: float = 0.15
    year_band: float = 0.10
    linear_weight: float = 0.6
    alert_dev: tuple = (10.0, 20.0)
    budget_used: float = 0.9
    # projection
    proj_dev: tuple = (5.0, 15.0)
    min_rows: int = 100
    naive_growth: float = 1.05
    confidence: float = 0.95
    # anomalies
    contamination: float = 0.05
    top_n: int = 20
    anomaly_many: int = 100
    anomaly_ratio: float = 50.0
    origin_share: float = 0.5
    n_trees: int = 100
    sample_size: int = 256
    seed: int = 42
    # recommendations
    high_saving: float = 0.10
    unit_mean_factor: float = 1.5
    unit_saving: float = 0.15
    category_saving: float = 0.08
    few_orders: int = 100
    saving_mean_factor: float = 1.3
    origin_saving: float = 0.15
    small_orders_min: int = 1000
    small_saving: float = 0.10
    trend_min_pct: float = 10.0
    recent_months: int = 6
    max_recommendations: int = 10
    max_opportunities: int = 5
    max_trends: int = 10
    # data quality
    example_limit: int = 10
    # quantiles: exact (skew-safe) by default; False = sketch only (percentile_approx)
    quantile_accuracy: int = 10_000
    exact_quantiles: bool = True

    def replace(self, **kw) -> "Params":
        return dataclasses.replace(self, **kw)


DEFAULT = Params()

# Parameters used by the registered queries on the driver's test tables:
# the tables span 1995-01-01 .. 2001-08-01, so history may start before 2016.
TEST = Params(min_year=1990)
