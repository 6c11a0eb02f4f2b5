"""Write one weekly report: ``python -m tidemark --paths paths.json --out DIR [--run-date YYYY-MM-DD]``.

``paths.json`` holds the fields of ``ReportPaths``; record files are lists keyed by file year.
"""

from __future__ import annotations

import argparse
import json
from datetime import date

from tidemark.params import ReportParams
from tidemark.plans.report import SECTIONS, write_report
from tidemark.session import SHUFFLE_PARTITIONS, build_session
from tidemark.sources.files import FileInputs, ReportPaths

RECORD_FILES = ("visits", "surgeries", "discharges")
MONTHLY_SECTIONS = ("period_bands", "anniversary_points")


def load_paths(path: str) -> ReportPaths:
    with open(path, encoding="utf-8") as handle:
        fields = json.load(handle)
    for name in RECORD_FILES:
        fields[name] = {int(year): files for year, files in fields[name].items()}
    return ReportPaths(**fields)


def main(arguments: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("--paths", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--run-date", type=date.fromisoformat, default=date.today())
    parser.add_argument("--shuffle-partitions", help="default: three per core")
    options = parser.parse_args(arguments)
    paths = load_paths(options.paths)
    spark = build_session()
    if options.shuffle_partitions:
        spark.conf.set(SHUFFLE_PARTITIONS, options.shuffle_partitions)
    chosen = {n: b for n, b in SECTIONS.items() if paths.monthly_series or n not in MONTHLY_SECTIONS}
    return write_report(FileInputs(spark, paths), ReportParams.for_run_date(options.run_date), options.out, chosen)


if __name__ == "__main__":
    main()
