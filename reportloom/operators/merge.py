"""The first step of an analysis: several report files become one clean table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from reportloom.functions.extract import (
    backfill_year, fill_concerns_from_attachments, fill_content_from_attachment, process_reports, report_year,
)
from reportloom.functions.text import (
    clean_categories, clean_coroner_area, clean_coroner_name, clean_deceased_name,
)
from reportloom.operators.dedup import deduplicate_reports
from reportloom.sources.files import stack_files


def merge_reports(
    frames: dict[str, DataFrame], keys: Sequence[str] = ("title",), current_year: int | None = None, normalise: bool = True
) -> DataFrame:
    """Stack named files, drop repeats, fill texts, extract and clean all fields.

    Files hold record_id, ingest_seq, title, content and pdfs. A blank content takes the
    text of the first attachment before fields are extracted; missing concerns and
    years are filled afterwards. One plan: only the two dedups shuffle.
    """
    once = deduplicate_reports(stack_files(frames), keys)
    extracted = process_reports(fill_content_from_attachment(once), normalise=normalise)
    cleaned = extracted.withColumns({
        "deceased_name": clean_deceased_name("deceased_name"),
        "coroner_name": clean_coroner_name("coroner_name"),
        "coroner_area": clean_coroner_area("coroner_area"),
        "categories": clean_categories("categories"),
        "year": report_year(F.col("date_of_report")),
    })
    return fill_concerns_from_attachments(backfill_year(cleaned, current_year=current_year))
