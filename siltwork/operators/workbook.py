"""Workbooks of several sheets, one or more per fund, written in tasks.

A workbook is a zip of XML parts. Rows are numbered within fund and sheet, so many to a file;
a fund of more rows gets further files, and no task holds more than one file's rows.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.operators.ranking import rank_within

ROWS_PER_FILE = 50_000
#: The header's colour, and those of scores and risks, from which value on.
HEADER = "0E7C66"
SCORE_COLOURS = ((80, "D4EDD8"), (72, "E8F2DD"), (64, "FFF6D6"), (42, "FFE9CC"), (None, "FFE0E0"))
RISK_COLOURS = ((60, "FFE0E0"), (40, "FFF6D6"), (None, "E8F2DD"))
COLOURS = ("D4EDD8", "E8F2DD", "FFF6D6", "FFE9CC", "FFE0E0")
CELL = "struct<text:string,number:double,colour:string>"
SPREADSHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def text_cell(value: Column) -> Column:
    return F.struct(F.coalesce(value.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("colour"))


def number_cell(value: Column, colours: Sequence[tuple[float | None, str]] = ()) -> Column:
    """A number; a null one is an empty cell. Its colour is that of the first bound it reaches."""
    colour = F.lit(None).cast("string")
    for least, name in reversed(colours):
        colour = F.lit(name) if least is None else F.when(value >= least, name).otherwise(colour)
    return F.struct(F.lit("").alias("text"), value.cast("double").alias("number"), F.when(value.isNotNull(), colour).alias("colour"))


def sheet(rows: DataFrame, fund: str, order: Sequence[Column], cells: Sequence[Column]) -> DataFrame:
    """fund, place (from 1), cells of a sheet's rows."""
    placed = rank_within(rows, [fund], order, "place", "__all")
    return placed.select(F.col(fund).alias("fund"), "place", F.array(*cells).cast(f"array<{CELL}>").alias("cells"))


def with_averages(rows: DataFrame, numbered: Sequence[int]) -> DataFrame:
    """A sheet and, last of each fund, the averages of some columns (by place from 0), to two digits."""
    width = F.max(F.size("cells")).alias("n")
    means = [F.floor(F.avg(F.get("cells", F.lit(k))["number"]) * 100 + 0.5) / 100 for k in numbered]
    last = rows.groupBy("fund").agg((F.max("place") + 1).alias("place"), width, F.array(*means).alias("means"))
    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.when(k == 0, text_cell(F.lit("Averages"))).when(F.array_contains(F.array(*map(F.lit, numbered)), k), number_cell(F.get(F.col("means"), (F.array_position(F.array(*map(F.lit, numbered)), k) - 1).cast("int")))).otherwise(text_cell(F.lit(""))))
    return rows.unionByName(last.select("fund", "place", cells.cast(f"array<{CELL}>").alias("cells")))


def _letters(at: int) -> str:
    out = ""
    at += 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out


def _legal(text: str) -> str:
    """Without the characters that XML has no form for."""
    return "".join(c for c in text if c in "\t\n\r" or (c >= " " and not "\ud800" <= c <= "\udfff" and c not in "￾￿"))


def _row(number: int, cells: Sequence[dict], styles: dict[str | None, int], header: bool = False) -> str:
    out = [f'<row r="{number}">']
    for k, cell in enumerate(cells):
        style = 1 if header else styles[cell["colour"]]
        place = f'r="{_letters(k)}{number}" s="{style}"'
        if cell["number"] is not None:
            out.append(f"<c {place}><v>{cell['number']!r}</v></c>")
        else:
            out.append(f'<c {place} t="inlineStr"><is><t xml:space="preserve">{escape(_legal(cell["text"]))}</t></is></c>')
    return "".join([*out, "</row>"])


class Workbook:
    """One file while its rows come, sheet by sheet."""

    def __init__(self, names: Sequence[str], headers: Sequence[Sequence[str]]):
        self.names, self.headers = names, headers
        self.styles = {None: 0} | {c: 2 + i for i, c in enumerate(COLOURS)}
        self.bodies = [[_row(1, [{"text": h, "number": None, "colour": None} for h in header], self.styles, True)] for header in headers]

    def add(self, sheet_number: int, cells: Sequence[dict]) -> None:
        body = self.bodies[sheet_number]
        body.append(_row(len(body) + 1, cells, self.styles))

    def content(self) -> bytes:
        fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in (HEADER, *COLOURS))
        formats = '<xf fontId="0" fillId="0"/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/>' + "".join(f'<xf fontId="0" fillId="{3 + i}" applyFill="1"/>' for i in range(len(COLOURS)))
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        count = range(1, len(self.names) + 1)
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in count) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{SPREADSHEET}" xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(count, self.names)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in count) + f'<Relationship Id="rId{len(self.names) + 1}" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet xmlns="{SPREADSHEET}"><fonts count="2"><font/><font><b/></font></fonts><fills count="{3 + len(COLOURS)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{2 + len(COLOURS)}">{formats}</cellXfs></styleSheet>',
        }
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as pack:
            for name, body in parts.items():
                pack.writestr(zipfile.ZipInfo(name), head + body)
            pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
            for i, rows in zip(count, self.bodies):
                with pack.open(zipfile.ZipInfo(f"xl/worksheets/sheet{i}.xml"), "w") as part:
                    part.write(f'{head}<worksheet xmlns="{SPREADSHEET}">{pane}<sheetData>'.encode())
                    for row in rows:
                        part.write(row.encode())
                    part.write(b"</sheetData></worksheet>")
        return out.getvalue()


def read_workbook(content: bytes) -> dict[str, list[list[str | float]]]:
    """Names and rows of a workbook's sheets, the header first; numbers as numbers."""
    tag = f"{{{SPREADSHEET}}}"
    with zipfile.ZipFile(io.BytesIO(content)) as pack:
        names = [s.get("name") for s in ElementTree.fromstring(pack.read("xl/workbook.xml")).iter(f"{tag}sheet")]
        out = {}
        for i, name in enumerate(names, 1):
            rows = ElementTree.fromstring(pack.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{tag}row")
            out[name] = [["".join(c.itertext()) if c.get("t") == "inlineStr" else float(c.find(f"{tag}v").text) for c in row.iter(f"{tag}c")] for row in rows]
        return out


def workbooks(sheets: Sequence[tuple[str, Sequence[str], DataFrame]], most: int | None = None) -> DataFrame:
    """fund, part, workbook (bytes): files of all sheets (name, header, rows as of ``sheet``).

    A file has at most ``most`` rows of each sheet, in their order; further rows of a fund are
    in further parts, from 0. A fund without rows in a sheet has its header there. Empty sheets
    give no file. Characters that XML cannot hold are left out.
    """
    most = most or ROWS_PER_FILE
    rows = None
    for number, (_, _, one) in enumerate(sheets):
        one = one.select("fund", F.lit(number).alias("sheet"), "place", "cells", F.floor((F.col("place") - 1) / most).cast("int").alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind, names, headers = rows.schema["fund"].dataType.simpleString(), [n for n, _, _ in sheets], [h for _, h, _ in sheets]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, book = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]).cast(fund_type), pa.array([now[1]], pa.int32()), pa.array([book.content()], pa.binary())], names=["fund", "part", "workbook"])

        for batch in batches:
            fund_type = batch.column("fund").type
            for fund, part, number, cells in zip(*[batch.column(c).to_pylist() for c in ("fund", "part", "sheet", "cells")]):
                if now != (fund, part):
                    if book:
                        yield done()
                    now, book = (fund, part), Workbook(names, headers)
                book.add(number, cells)
        if book:
            yield done()

    dealt = rows.repartition(parts, "fund", "part").sortWithinPartitions("fund", "part", "sheet", "place")
    return dealt.select("fund", "part", "sheet", "cells").mapInArrow(write, f"fund {kind}, part int, workbook binary")


LINES = 100


def sheet_digests(books: DataFrame) -> DataFrame:
    """fund, sheet, rows, cells_sha256 of files as of ``workbooks``, read back in tasks.

    The digest is that of a sheet's rows in all parts of its fund, one after the other: cells
    joined by a bar, rows by a line break. A sheet's lines stream past it in their order, some at
    a time, so no task holds a sheet. Sheets without rows give none.
    """
    fund = books.schema["fund"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, book in enumerate(batch.column("workbook")):
                for sheet_name, rows in read_workbook(book.as_py()).items():
                    lines = ["|".join(map(str, row)) for row in rows[1:]]
                    pieces = ["\n".join(lines[i : i + LINES]) for i in range(0, len(lines), LINES)]
                    n = len(pieces)
                    sizes = [min(LINES, len(lines) - i) for i in range(0, len(lines), LINES)]
                    same = pa.array([k] * n, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("fund").take(same), pa.array([sheet_name] * n, pa.string()), batch.column("part").take(same), pa.array(range(n), pa.int32()), pa.array(pieces, pa.string()), pa.array(sizes, pa.int64())],
                        names=["fund", "sheet", "part", "at", "lines", "rows"],
                    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fund_type, count, state = None, None, 0, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]).cast(fund_type), pa.array([now[1]], pa.string()), pa.array([count], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["fund", "sheet", "rows", "cells_sha256"])

        for batch in batches:
            fund_type = batch.column("fund").type
            for one, name, lines, n in zip(*[batch.column(c).to_pylist() for c in ("fund", "sheet", "lines", "rows")]):
                if now != (one, name):
                    if state:
                        yield done()
                    now, count, state = (one, name), 0, hashlib.sha256()
                elif count:
                    state.update(b"\n")
                state.update(lines.encode())
                count += n
        if state:
            yield done()

    parts = int(books.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = books.mapInArrow(read, f"fund {fund}, sheet string, part int, at int, lines string, rows long")
    ordered = lines.repartition(parts, "fund", "sheet").sortWithinPartitions("fund", "sheet", "part", "at")
    return ordered.select("fund", "sheet", "lines", "rows").mapInArrow(digest, f"fund {fund}, sheet string, rows long, cells_sha256 string")
