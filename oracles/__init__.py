"""DuckDB SQL computing every named query's result independently, over the same tables."""

from oracles import facts, reports

# The written report's sections, in reading order.
SECTIONS = (
    "kpi_cards", "attainment_by_state", "axis_stats", "progress_summary", "delta_text", "weekly_series",
    "label_spacing", "late_registration_ytd", "late_registration_month", "global_progress",
    "surgery_zero_progress", "surgery_low_performers", "weekly_series_registered", "attainment_observed",
    "indicator_growth_table", "actual_vs_model", "period_bands", "anniversary_points",
)

ORACLES = {**facts.ORACLES, **reports.ORACLES}
ORACLES["report_datasets"] = reports.report_counts(ORACLES, SECTIONS)

__all__ = ["ORACLES"]
