"""Report datasets on disk: one folder per report date and section, each with its own columns.

What a reader sees of a date is what its last manifest names. A run writes its sections to folders of its own and puts a
new manifest in place only when all are there, so a run that dies half-way leaves the report as it was. Runs for
different dates don't meet; of two for one date, each manifest takes over what the one before it names beside the
sections written anew. Folders that a manifest no longer names are removed once the next one is in place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.sources.folders import Folder

#: Attempts at a manifest's next number when other runs for the same date take it first.
ATTEMPTS = 20


def section_path(root: str, report_date: date, section: str) -> str:
    return f"{root.rstrip('/')}/report_date={report_date.isoformat()}/section={section}"


def ordered(df: DataFrame, order_by: Sequence[str | Column], files: int | None = None) -> DataFrame:
    """Rows for a sink in global order: each file holds a range of them, sorted, and ranges don't overlap.

    What a file's and a row group's statistics say is then narrow, and a reader who asks for some of the first column
    opens few of them.
    """
    spread = df.repartitionByRange(files, *order_by) if files else df.repartitionByRange(*order_by)
    return spread.sortWithinPartitions(*order_by)


class ReportSink:
    """The sections of all report dates below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._folder = spark, Folder(spark, root)

    @staticmethod
    def _manifests(report_date: date) -> str:
        return f"_manifests/{report_date.isoformat()}"

    def _last(self, report_date: date) -> tuple[int, dict[str, str]]:
        names = [n for n in self._folder.names(self._manifests(report_date)) if n.endswith(".json")]
        if not names:
            return 0, {}
        return int(names[-1].removesuffix(".json")), json.loads(self._folder.read(f"{self._manifests(report_date)}/{names[-1]}"))

    def sections(self, report_date: date) -> dict[str, str]:
        """Paths of the sections that the date's report consists of."""
        return {name: self._folder.child(path) for name, path in sorted(self._last(report_date)[1].items())}

    def dates(self) -> list[date]:
        return [date.fromisoformat(name) for name in self._folder.names("_manifests")]

    def run(self, report_date: date) -> "ReportRun":
        return ReportRun(self, report_date)

    def publish(self, report_date: date, written: dict[str, str]) -> None:
        """Make the sections written, as paths below the root, those of the date."""
        for _ in range(ATTEMPTS):
            version, before = self._last(report_date)
            name = f"{self._manifests(report_date)}/{version + 1:08d}.json"
            if self._folder.write_once(name, json.dumps(before | written)):
                for old in {path for section, path in before.items() if section in written} - set(written.values()):
                    self._folder.remove(old)
                if version:
                    self._folder.remove(f"{self._manifests(report_date)}/{version:08d}.json")
                return
        raise RuntimeError(f"other runs kept publishing {report_date}")

    def remove(self, names: Iterable[str]) -> None:
        for name in names:
            self._folder.remove(name)

    def child(self, name: str) -> str:
        return self._folder.child(name)

    def clean(self) -> list[str]:
        """Remove what runs that were killed have left; not while another run writes. Returns what was removed."""
        gone = [name for name in self._folder.names() if name.startswith("_tables-")]
        for report_date in self._folder.names():
            if report_date.startswith("report_date="):
                kept = set(self._last(date.fromisoformat(report_date.partition("=")[2]))[1].values())
                for section in self._folder.names(report_date):
                    found = [f"{report_date}/{section}/{run}" for run in self._folder.names(f"{report_date}/{section}")]
                    gone += [name for name in found if name not in kept]
        self.remove(gone)
        return gone


class ReportRun:
    """One run for a date: ``with`` publishes its sections at the end, or removes them if it fails."""

    def __init__(self, sink: ReportSink, report_date: date):
        self._sink, self._date, self._id = sink, report_date, uuid.uuid4().hex
        self._written: dict[str, str] = {}
        #: For tables that only this run reads; the underscore keeps them out of scans of the report's folders.
        self.tables = sink.child(f"_tables-{self._id}")

    def write(self, df: DataFrame, section: str) -> None:
        name = f"report_date={self._date.isoformat()}/section={section}/run={self._id}"
        self._written[section] = name
        df.write.parquet(self._sink.child(name))

    def __enter__(self) -> "ReportRun":
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            if kind is None:
                self._sink.publish(self._date, self._written)
            else:
                self._sink.remove(self._written.values())
        finally:
            self._sink.remove([f"_tables-{self._id}"])


def write_section(df: DataFrame, root: str, report_date: date, section: str) -> None:
    """Replace one section of one report date; other sections and dates are left alone."""
    with ReportSink(df.sparkSession, root).run(report_date) as run:
        run.write(df, section)


def read_section(spark: SparkSession, root: str, report_date: date, section: str) -> DataFrame:
    return spark.read.parquet(ReportSink(spark, root).sections(report_date)[section])


def read_section_history(spark: SparkSession, root: str, section: str) -> DataFrame:
    """One section over all report dates, with report_date and section as columns."""
    sink = ReportSink(spark, root)
    paths = [path for day in sink.dates() for name, path in sink.sections(day).items() if name == section]
    reader = spark.read.option("basePath", root.rstrip("/")).option("mergeSchema", "true")
    return reader.parquet(*paths).drop("run")
