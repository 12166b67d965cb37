"""Readers and writers of seeds, pages and contacts."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import scalars as S
from tessera.operators import contacts as C


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """``url`` of each line that is a valid address; lines that start with ``#`` and blank ones don't count."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.trim("value").alias("url"))
    return lines.filter(S.is_url(F.col("url")))


def write_csv(contacts: DataFrame, path: str) -> None:
    C.export_rows(contacts).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_json(contacts: DataFrame, path: str) -> None:
    """One JSON object a line, for tables of any size."""
    contacts.select(*[c for c in P.EXPORT_COLUMNS if c in contacts.columns]).write.mode("overwrite").json(path)


def write_xlsx(sheets: dict[str, DataFrame], path: str, most: int = 1_000_000) -> None:
    """A workbook of small tables; a sheet holds ``most`` rows at most by format, more is an error."""
    book = {}
    for name, df in sheets.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more rows than a sheet can hold; write CSV or JSON")
        book[name] = [df.columns, *[list(r) for r in rows]]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        pkg = "http://schemas.openxmlformats.org/package/2006"
        n = range(1, len(book) + 1)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(n, book, strict=True)) + "</sheets></workbook>")
        for i, rows in zip(n, book.values(), strict=True):
            cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    with open(path, "wb") as f:
        f.write(out.getvalue())
