"""Report parameters: every date, year list, target and threshold an operator needs, in one frozen object."""

from __future__ import annotations

import calendar
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, timedelta

# The five additive measures of the daily fact, in report order.
METRICS = (
    "consultas_totales",
    "consultas_generales",
    "consultas_de_especialidad",
    "procedimientos_quirurgicos",
    "egresos",
)

# Distinct-person counts that accompany the five measures, in the same order.
PERSON_METRICS = (
    "personas_consulta_total",
    "personas_general",
    "personas_especialidad",
    "personas_qx",
    "personas_egresos",
)

# Series label of each measure.
SERIES_LABELS = {
    "consultas_totales": "Totales",
    "consultas_generales": "Generales",
    "consultas_de_especialidad": "Especialidad",
    "procedimientos_quirurgicos": "Procedimientos quirúrgicos",
    "egresos": "Egresos",
}

# Report title of each measure.
METRIC_TITLES = {
    "consultas_totales": "Consultas totales",
    "consultas_generales": "Consultas generales",
    "consultas_de_especialidad": "Consultas de especialidad",
    "procedimientos_quirurgicos": "Procedimientos quirúrgicos",
    "egresos": "Egresos",
}

# Card title of each KPI, activity first, persons second.
CARD_TITLES = {
    "consultas_totales": "Consultas totales",
    "consultas_generales": "Consulta general",
    "consultas_de_especialidad": "Especialidad",
    "procedimientos_quirurgicos": "Procedimientos quirúrgicos",
    "egresos": "Egresos",
    "personas_consulta_total": "Consultas totales",
    "personas_general": "Consultas generales",
    "personas_especialidad": "Consultas especialidad",
    "personas_qx": "Intervenidas",
    "personas_egresos": "Egresadas",
}

# Annual national target of each measure.
ANNUAL_TARGETS = {
    "consultas_totales": 60_000_000.0,
    "consultas_generales": 52_500_000.0,
    "consultas_de_especialidad": 7_500_000.0,
    "procedimientos_quirurgicos": 1_100_000.0,
    "egresos": 1_600_000.0,
}

WEEKS_PER_YEAR = 52


@dataclass(frozen=True)
class PeriodBand:
    """A labelled date interval; ``label_height`` places its label as a share of the series maximum."""

    start: date
    end: date
    label: str
    label_height: float


# Operating periods of the monthly report.
PERIOD_BANDS = (
    PeriodBand(date(2022, 8, 1), date(2023, 12, 31), "2022 – 2023\nAños de transición", 0.92),
    PeriodBand(date(2024, 1, 1), date(2024, 12, 31), "2024\nPrimer año de operación", 0.91),
    PeriodBand(date(2025, 1, 1), date(2025, 12, 31), "2025\nSegundo año\nde operación", 0.94),
    PeriodBand(date(2026, 1, 1), date(2026, 6, 30), "2026\nTercer año\nde operación", 0.86),
)


@dataclass(frozen=True)
class ReportParams:
    """Everything a report run depends on besides its inputs.

    ``years`` is the comparison spine, oldest first; its last year is the current one. Years up to
    ``history_last_year`` come from the pre-aggregated history, later ones from record files.
    """

    cutoff: date
    years: tuple[int, ...] = (2023, 2024, 2025, 2026)
    history_last_year: int = 2023
    first_year_day: int = 15
    annual_targets: Mapping[str, float] = field(default_factory=lambda: dict(ANNUAL_TARGETS))
    excluded_states: tuple[str, ...] = ("Yucatán", "Guanajuato")
    excluded_nowcast_states: tuple[str, ...] = ("Iniems", "Guanajuato", "Yucatán", "Yucatan")
    excluded_score_states: tuple[str, ...] = ("Yucatan",)
    excluded_categories: tuple[str, ...] = ("UNEME", "Unidades moviles")
    person_scope: str = "NACIONAL"
    light_thresholds: tuple[float, float, float] = (0.60, 0.80, 0.95)
    low_performer_factor: float = 0.49
    page_size: int = 10
    label_gap: float = 0.06
    week_offsets: Mapping[int, int] = field(default_factory=lambda: {2024: 4})
    anniversary_month: int = 6
    series_start: date = date(2022, 8, 1)
    series_end: date = date(2026, 6, 1)
    bands: tuple[PeriodBand, ...] = PERIOD_BANDS
    nowcast_as_of: date | None = None

    @classmethod
    def for_run_date(cls, today: date, **overrides) -> ReportParams:
        """Parameters of a run on ``today``: the cut-off is the last Wednesday strictly before it."""
        back = (today.isoweekday() - 3) % 7 or 7
        return cls(cutoff=today - timedelta(days=back), **overrides)

    @property
    def current_year(self) -> int:
        return self.years[-1]

    @property
    def first_year(self) -> int:
        return self.years[0]

    @property
    def recent_years(self) -> tuple[int, ...]:
        """The spine without its first year: the years shown in weekly and growth tables."""
        return self.years[1:]

    @property
    def growth_reference_years(self) -> tuple[int, ...]:
        """Past recent years, nearest first."""
        return tuple(reversed(self.recent_years[:-1]))

    @property
    def first_record_year(self) -> int:
        return self.history_last_year + 1

    @property
    def week_number(self) -> int:
        """Weeks completed at the cut-off: ISO week less one."""
        return self.cutoff.isocalendar().week - 1

    @property
    def target_share(self) -> float:
        return self.week_number / WEEKS_PER_YEAR

    @property
    def percent_to_date(self) -> float:
        return self.week_number * 100 / WEEKS_PER_YEAR

    @property
    def month(self) -> int:
        return self.cutoff.month

    @property
    def current_year_start(self) -> date:
        return date(self.current_year, 1, 1)

    @property
    def month_start(self) -> date:
        return date(self.current_year, self.month, 1)

    @property
    def month_end(self) -> date:
        """Last day of the cut-off's own month, in the cut-off's year."""
        last = calendar.monthrange(self.cutoff.year, self.cutoff.month)[1]
        return date(self.cutoff.year, self.cutoff.month, last)

    def weekly_target(self, metric: str) -> float:
        return self.annual_targets[metric] / WEEKS_PER_YEAR
