"""Results in the format that the settings name."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import texts as T
from tessera.operators import contacts as C
from tessera.settings import Settings
from tessera.sources import tables

ROWS = 1_000_000
ROUNDED = ("confidence", "validation_score")
STATISTICS = ("Total Contacts", "With Names", "With Phone Numbers", "With Job Titles", "With Companies", "Average Confidence", "Average Validation Score")


def sheet_rows(contacts: DataFrame) -> DataFrame:
    """The known columns first, then all others; texts without null, ``nan`` and ``None``, numbers with three digits (half to even)."""
    known = [c for c in P.EXPORT_COLUMNS if c in contacts.columns]
    kind = dict(contacts.dtypes)

    def cell(c: str):
        col = F.col("`" + c.replace("`", "``") + "`")
        if c in ROUNDED:
            return F.bround(col.cast("double"), 3).alias(c)
        if kind[c] != "string":
            return col
        return F.when(col.isNull() | col.isin("nan", "None"), "").otherwise(col).alias(c)

    return contacts.select(*[cell(c) for c in [*known, *(c for c in contacts.columns if c not in known)]])


def workbook(contacts: DataFrame, order: str) -> dict[str, DataFrame]:
    """The three sheets of the workbook; ``order`` settles ties among companies."""
    summary = C.summary_by_method(contacts).unionByName(C.summary_top_companies(contacts, order))
    summary = summary.toDF("Category", "Type", "Count", "Percentage")
    return {"Contacts": sheet_rows(contacts), "Summary": summary, "Statistics": C.statistics(contacts).toDF(*STATISTICS)}


def write_document(contacts: DataFrame, path: str, settings: Settings, at: datetime, most: int = ROWS) -> None:
    """One JSON document with the run's settings and all contacts; more than ``most`` are an error."""
    rows = contacts.limit(most + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()
    if len(rows) > most:
        raise ValueError("more contacts than one document should hold; write JSON lines")
    about = {"export_timestamp": at.isoformat(), "total_contacts": len(rows), "extractor_version": "1.0", "config": {k: getattr(settings, k) for k in ("max_depth", "validate_emails", "extract_social")}}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"metadata": about, "contacts": [json.loads(r[0]) for r in rows]}, f, indent=2, ensure_ascii=False)


def export_results(contacts: DataFrame, source_url: str, settings: Settings, at: datetime, order: str = "email") -> str:
    """Write contacts as the settings say; returns the path.

    CSV is a folder of parts, written by the executors, and nothing without contacts; JSON and workbooks are
    single files of bounded size that the driver writes.
    """
    spark = contacts.sparkSession
    name = settings.output_file or spark.range(1).select(T.export_name(F.lit(source_url), F.lit(at))).first()[0]
    path = os.path.join(settings.output_dir, name + {"csv": ".csv", "json": ".json", "excel": ".xlsx"}[settings.output_format])
    if settings.output_format == "csv":
        if contacts.take(1):
            tables.write_csv(contacts, path)
        return path
    os.makedirs(settings.output_dir, exist_ok=True)
    if settings.output_format == "json":
        write_document(contacts, path, settings, at)
    else:
        tables.write_xlsx(workbook(contacts, order) if contacts.take(1) else {"Sheet1": spark.createDataFrame([], "empty string").drop("empty")}, path)
    return path
