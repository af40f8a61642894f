"""Writers: JSON documents and lines, run exports, summaries, workbooks."""

from __future__ import annotations

import json
import re
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """One object per line with null fields kept; with an order, range-partitioned files in that order."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_run(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Lines partitioned by run."""
    df.repartition(run).write.mode("overwrite").partitionBy(run).option("ignoreNullFields", "false").json(path)


def suffixed(path: str, suffix: str | None) -> str:
    """A file name with a slug of the suffix before its ending."""
    if not suffix:
        return path
    slug = re.sub(r"\s+", "-", suffix.strip().lower()).replace("+", "plus").replace("&", "and")
    where = Path(path)
    return str(where.with_name(f"{where.stem}_{slug}{where.suffix}"))


def write_json_document(df: DataFrame, path: str, order: str, most: int = 100_000) -> int:
    """One array, indented; for results with a bound, which is checked."""
    rows = df.orderBy(order).limit(most + 1).toLocalIterator()
    found = [r.asDict(recursive=True) for r in rows]
    if len(found) > most:
        raise ValueError(f"more than {most} rows for one document; write lines instead")
    Path(path).write_text(json.dumps(found, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return len(found)


def summary(df: DataFrame, counts: dict[str, Column], order: str, sample: int = 5) -> dict:
    """Counts in one pass, and the first rows."""
    totals = df.agg(*(c.alias(name) for name, c in counts.items())).first().asDict()
    return totals | {"sample": [r.asDict(recursive=True) for r in df.orderBy(order).limit(sample).collect()]}


def column_widths(df: DataFrame, columns: list[str], least: int = 10, most: int = 42) -> DataFrame:
    """(column, width): the longest text and two, heading included, within bounds."""
    longest = df.agg(*(F.max(F.length(F.col(c).cast("string"))).alias(c) for c in columns))
    width = lambda c: F.greatest(F.lit(least), F.least(F.lit(most), F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(len(c))) + 2))
    return longest.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), width(c).cast("bigint").alias("width")) for c in columns)))).select("col.*")


def _letter(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def write_workbook(rows: list[dict], columns: list[str], widths: dict[str, int], path: str, sheet: str = "Apply", link: str | None = None) -> None:
    """A workbook of one sheet: dark heading, frozen first row, filter, wrapped cells, links in one column."""

    def cell(n: int, r: int, value, style: int) -> str:
        where = f"{_letter(n)}{r}"
        if value is None:
            return f'<c r="{where}" s="{style}"/>'
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{where}" s="{style}"><v>{value}</v></c>'
        return f'<c r="{where}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = ["".join(cell(n, 1, c, 1) for n, c in enumerate(columns, 1))]
    links = []
    for r, row in enumerate(rows, 2):
        lines.append("".join(cell(n, r, row.get(c), 2) for n, c in enumerate(columns, 1)))
        if link and row.get(link):
            links.append((f"{_letter(columns.index(link) + 1)}{r}", str(row[link])))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    cols = "".join(f'<col min="{n}" max="{n}" width="{widths.get(c, 12)}" customWidth="1"/>' for n, c in enumerate(columns, 1))
    body = "".join(f'<row r="{r}">{line}</row>' for r, line in enumerate(lines, 1))
    marks = "".join(f'<hyperlink ref="{where}" r:id="rId{n}"/>' for n, (where, _) in enumerate(links, 1))
    span = f"A1:{_letter(len(columns))}{len(lines)}"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF1F2937"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}" xmlns:r="{rel}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData>{body}</sheetData><autoFilter ref="{span}"/>{f"<hyperlinks>{marks}</hyperlinks>" if links else ""}</worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{package}/relationships">'
        + "".join(f'<Relationship Id="rId{n}" Type="{rel}/hyperlink" Target="{escape(url, {chr(34): "&quot;"})}" TargetMode="External"/>' for n, (_, url) in enumerate(links, 1))
        + "</Relationships>",
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in parts.items():
            out.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{content}')
