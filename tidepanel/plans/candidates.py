"""Functions that candidate formulas may use, by name, as Column builders.

Formula text is not parsed: a candidate is a Python expression over these.
Functions that need the whole section or table (``rank_cs``, ``zscore_cs``,
``industry_neutralize``, ``winsorize``) work on DataFrames and live in
:mod:`tidepanel.operators.cross_section`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import scalar
from tidepanel.operators import cross_section, timeseries

ROW_FUNCTIONS = {
    "safe_div": scalar.safe_div,
    "log1p": scalar.safe_log1p,
    "abs": lambda x: F.abs(scalar.col(x)),
    "sign": scalar.sign,
    "interaction": scalar.interaction,
}
WINDOW_FUNCTIONS = {
    "rolling_mean": timeseries.ts_mean,
    "rolling_sum": timeseries.ts_sum,
    "rolling_std": timeseries.ts_std,
    "rolling_min": timeseries.ts_min,
    "rolling_max": timeseries.ts_max,
    "delta": timeseries.delta,
    "ts_return": timeseries.returns,
    "return": timeseries.returns,
    "pct_change": timeseries.returns,
}
SECTION_FUNCTIONS = {
    "rank_cs": cross_section.cs_pct_rank,
    "zscore_cs": cross_section.cs_zscore,
    "industry_neutralize": cross_section.industry_neutralize,
    "winsorize": cross_section.winsorize,
}
