"""Writing a period report: one dataset per sheet below a folder named after the period."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame

from slotledger.functions.periods import resolve_period
from slotledger.operators.bookings import within
from slotledger.plans.reports import report_sheets
from slotledger.schemas import Settings


def export_report(
    bookings: DataFrame,
    employees: DataFrame,
    settings: Settings,
    period: str,
    ref: str,
    out: str,
    fmt: str = "parquet",
) -> str:
    """Write every sheet of the report as parquet or CSV and return the report's folder.

    The bookings of the period are read once and kept for all sheets. A period's name may be any text (which then means the
    year), so it is escaped in the folder's name.
    """
    start, end = resolve_period(period, ref)
    folder = f"{out.rstrip('/')}/report-{quote(period, safe="")}-{start.isoformat()}"
    columns = ("date", "shift", "kind", "user_id")
    kept = within(bookings, start, end).select(*columns).persist()
    try:
        for name, sheet in report_sheets(kept, employees, settings, period, ref).items():
            writer = sheet.write.mode("overwrite").format(fmt)
            (writer.option("header", True) if fmt == "csv" else writer).save(f"{folder}/{name}")
    finally:
        kept.unpersist()
    return folder
