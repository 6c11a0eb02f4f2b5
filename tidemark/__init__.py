"""tidemark: bi-temporal service-activity reporting on Spark DataFrames.

Activity records carry two dates, when something happened and when it was registered. The package unifies
several years of them into one additive daily fact and derives totals, growth, weekly series,
late-registration decompositions, target attainment and worst-performer rankings from it.
"""

from tidemark.params import METRICS, ReportParams

__all__ = ["METRICS", "ReportParams"]
