"""The set of tables a report reads, independent of where they are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame


class ReportInputs:
    """Source tables of one report. Subclasses provide each table as a lazy property.

    ``visits`` has clues, fecha_consulta, fecha_insert, tipo_consulta, periodo; ``surgeries`` and
    ``discharges`` have clues, fecha_egreso, fecha_insert, periodo. ``periodo`` is the year of the file a
    record came from: classification rules and the load cut-off differ by file year.
    """

    catalog: DataFrame
    targets: DataFrame
    history: DataFrame
    visits: DataFrame
    surgeries: DataFrame
    discharges: DataFrame
    persons: DataFrame
    nowcast_state: DataFrame
    nowcast_national: DataFrame
    excluded: DataFrame
    monthly_series: DataFrame

    @property
    def history_rows(self) -> DataFrame:
        """History at the grain that is cheapest to add up; the cube itself where it is stored."""
        return self.history

    @property
    def joint_records(self) -> DataFrame | None:
        """All three record kinds in one table with es_cirugia / es_egreso flags, where stored that way.

        Lets the fact be built from a single scan. None when each kind has files of its own.
        """
        return None
