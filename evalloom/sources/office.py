"""Workbooks, word documents and slides: read in the tasks that hold the files, workbooks written with a commit.

Files come as rows of Spark's ``binaryFile`` source, so they may lie wherever Spark reads. A workbook becomes rows of cells
(path, sheet, row, column, text, number); tables, types and markdown are made from the cells by Spark.
"""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACK = "{http://schemas.openxmlformats.org/package/2006/relationships}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
#: Rows of a sheet, by the format, its header among them.
SHEET_ROWS = 1_048_576
CELLS = "path string, sheet_no int, sheet string, row int, col int, text string, number double"


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Members that a part refers to, by id."""
    folder, name = part.rsplit("/", 1)
    tree = ET.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    full = lambda t: t.lstrip("/") if t.startswith("/") else f"{folder}/{t}"
    return {r.get("Id"): full(r.get("Target")) for r in tree.iter(f"{_PACK}Relationship")}


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n


def _cells(content: bytes) -> Iterator[tuple[int, str, int, int, str | None, float | None]]:
    """(sheet_no, sheet, row, col, text, number) of all cells that are not empty; rows and columns from 1."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        targets = _targets(z, "xl/workbook.xml")
        sheets = list(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        for number, sheet in enumerate(sheets, start=1):
            row = 0
            for _, r in ET.iterparse(z.open(targets[sheet.get(f"{_REL}id")])):
                if r.tag != f"{_MAIN}row":
                    continue
                row, col = int(r.get("r", row + 1)), 0
                for c in r.iter(f"{_MAIN}c"):
                    col = _column(c.get("r")) if c.get("r") else col + 1
                    kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    elif value is None or value.text is None:
                        continue
                    elif kind == "s":
                        text = shared[int(value.text)]
                    elif kind == "b":
                        text = "True" if value.text == "1" else "False"
                    elif kind in ("str", "e", "d"):
                        text = value.text
                    else:
                        yield number, sheet.get("name"), row, col, None, float(value.text)
                        continue
                    if text != "":
                        yield number, sheet.get("name"), row, col, text, None
                r.clear()


def workbook_cells(files: DataFrame) -> DataFrame:
    """A row a cell that is not empty, of workbook files (path, content); a file is read in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                held = []
                for cell in _cells(bytes(content)):
                    held.append((path, *cell))
                    if len(held) == 20_000:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                yield pd.DataFrame(held, columns=names)

    return files.select("path", "content").mapInPandas(run, CELLS)


def read_workbook(spark: SparkSession, path: str, sheets: tuple[str, ...] = (), required: tuple[str, ...] = ()) -> DataFrame:
    """One sheet of a workbook as a table: the first of ``sheets`` that it has, else its first sheet.

    The first row names the columns; columns without a name, and rows and columns without a value, go. A column of
    numbers is long if all are whole, else double; any other is text. Raises where a required column is missing.
    """
    cells = workbook_cells(spark.read.format("binaryFile").load(path))
    names = [r.sheet for r in cells.groupBy("sheet").agg(F.min("sheet_no").alias("n")).orderBy("n").collect()]  # a row a sheet
    sheet = next((s for s in sheets if s in names), names[0] if names else None)
    own = cells.where(F.col("sheet").eqNullSafe(sheet)).select("row", "col", F.coalesce("text", F.col("number").cast("string")).alias("shown"), "number", "text")
    first = own.agg(F.min("row")).first()[0]
    head = F.max(F.when(F.col("row") == first, F.col("shown")))
    body = F.col("row") > first
    columns = own.groupBy("col").agg(head.alias("name"), F.count_if(body).alias("n"), F.count_if(body & F.col("text").isNotNull()).alias("texts"), F.count_if(body & (F.col("number") != F.floor("number"))).alias("parts")).orderBy("col").collect() if first else []  # a row a column
    kept = [c for c in columns if c.name and c.n]
    lost = [c for c in required if c not in [k.name for k in columns]]
    if lost:
        raise ValueError(f"missing columns: {lost}")
    if not kept:
        return spark.createDataFrame([], "`" + "` string, `".join([c.name for c in columns if c.name] or ["empty"]) + "` string")
    value = {c.col: (F.when(F.col("col") == c.col, F.col("shown")) if c.texts else F.when(F.col("col") == c.col, F.col("number").cast("double" if c.parts else "long"))) for c in kept}
    rows = own.where(body & F.col("col").isin([c.col for c in kept])).groupBy("row").agg(*[F.max(value[c.col]).alias(f"c{c.col}") for c in kept])
    return rows.orderBy("row").select(*[F.col(f"c{c.col}").alias(c.name) for c in kept])


def workbook_text(content: bytes) -> str:
    """All sheets of a workbook as pipe tables under their names."""
    sheets: dict[str, dict[int, dict[int, object]]] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            sheets[sheet.get("name")] = {}
    for _, sheet, row, col, text, number in _cells(content):
        sheets[sheet].setdefault(row, {})[col] = text if text is not None else number
    out = ""
    for sheet, rows in sheets.items():
        out += f"\n--- EXCEL BLATT: '{sheet}' ---\n{_pipes(rows)}\n"
    return out


def _pipes(rows: dict[int, dict[int, object]]) -> str:
    """A pipe table; numbers to the right, rows and columns without values left out."""
    if not rows:
        return ""
    first, *rest = sorted(rows)
    columns = sorted({c for r in rest for c in rows[r]})
    numeric = {c: all(isinstance(rows[r].get(c, 0.0), float) for r in rest) for c in columns}
    shown = lambda v: "nan" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    table = [[shown(rows[first].get(c, f"Unnamed: {c - 1}")) for c in columns]] + [[shown(rows[r].get(c)) for c in columns] for r in rest]
    width = [max(3, *(len(line[i]) for line in table)) for i in range(len(columns))]
    pad = lambda line: "| " + " | ".join(v.rjust(w) if numeric[c] else v.ljust(w) for v, w, c in zip(line, width, columns, strict=True)) + " |"
    rule = "|" + "|".join("-" * (w + 1) + ":" if numeric[c] else ":" + "-" * (w + 1) for w, c in zip(width, columns, strict=True)) + "|"
    return "\n".join([pad(table[0]), rule, *map(pad, table[1:])])


def _word_text(p: ET.Element) -> str:
    out = ""
    for e in p.iter():
        out += (e.text or "") if e.tag == f"{_WORD}t" else "\t" if e.tag == f"{_WORD}tab" else "\n" if e.tag in (f"{_WORD}br", f"{_WORD}cr") else ""
    return out


def document_text(content: bytes) -> str:
    """Paragraphs of a word document that are not empty, then its tables, a line a row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    out = ["--- FLIESSTEXT ---", *[t for t in map(_word_text, body.findall(f"{_WORD}p")) if t.strip()], "\n--- TABELLEN IN DOKUMENT ---"]
    for table in body.findall(f"{_WORD}tbl"):
        for row in table.findall(f"{_WORD}tr"):
            cells = []
            for cell in row.findall(f"{_WORD}tc"):
                span = cell.find(f"{_WORD}tcPr/{_WORD}gridSpan")
                text = "\n".join(map(_word_text, cell.findall(f"{_WORD}p"))).strip().replace("\n", " ")
                cells += [text] * (int(span.get(f"{_WORD}val")) if span is not None else 1)
            out.append(" | ".join(cells))
        out.append("[Tabelle Ende]\n")
    return "\n".join(out)


def slides_text(content: bytes) -> str:
    """Slides in their order: title, then the text of each other shape."""
    out = ""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = _targets(z, "ppt/presentation.xml")
        order = [targets[s.get(f"{_REL}id")] for s in ET.fromstring(z.read("ppt/presentation.xml")).iter(f"{_SLIDE}sldId")]
        for number, member in enumerate(order, start=1):
            title, rest = "", []
            for shape in ET.fromstring(z.read(member)).findall(f"{_SLIDE}cSld/{_SLIDE}spTree/{_SLIDE}sp"):
                lines = ["".join((e.text or "") if e.tag == f"{_DRAW}t" else " " if e.tag == f"{_DRAW}br" else "" for e in p.iter()) for p in shape.iter(f"{_DRAW}p")]
                kind = shape.find(f"{_SLIDE}nvSpPr/{_SLIDE}nvPr/{_SLIDE}ph")
                if kind is not None and kind.get("type") in ("title", "ctrTitle") and not title:
                    title = f"TITEL: {chr(10).join(lines)}\n"
                elif "\n".join(lines):
                    rest.append(f"- {chr(10).join(lines)}\n")
            out += f"\n--- FOLIE {number} ---\n{title}{''.join(rest)}"
    return out


def write_workbook(frames: dict[str, DataFrame], path: str) -> None:
    """A sheet a frame, with a header. The file appears whole by a rename, or not at all.

    Raises where a frame has more rows than a sheet can hold; rows are streamed into the file, not collected.
    """
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        if df.count() >= SHEET_ROWS:
            raise ValueError(f"sheet {name!r} would have more than {SHEET_ROWS} rows")
    with tempfile.TemporaryDirectory() as folder:
        local = Path(folder) / "book.xlsx"
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
            _write_parts(z, list(frames))
            for i, df in enumerate(frames.values(), start=1):
                with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                    out.write(_row_xml(1, df.columns).encode())
                    for n, row in enumerate(df.toLocalIterator(), start=2):
                        out.write(_row_xml(n, row).encode())
                    out.write(b"</sheetData></worksheet>")
        jvm = spark.sparkContext._jvm
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.copyFromLocalFile(False, True, at(f"file://{local}"), at(f"{path}.part"))
        fs.delete(at(path), False)
        fs.rename(at(f"{path}.part"), at(path))


def _row_xml(number: int, values) -> str:
    cells = []
    for i, v in enumerate(values):
        if v is None or v != v:
            continue
        letters, n = "", i + 1
        while n:
            n, digit = divmod(n - 1, 26)
            letters = chr(65 + digit) + letters
        ref = f'r="{letters}{number}"'
        if isinstance(v, bool):
            cells.append(f'<c {ref} t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, (int, float)):
            cells.append(f"<c {ref}><v>{v!r}</v></c>")
        else:
            text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", "; ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v))
            cells.append(f'<c {ref} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def _write_parts(z: zipfile.ZipFile, sheets: list[str]) -> None:
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(sheets) + 1)
    overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
    z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{overrides}</Types>')
    rel = lambda i, t, target: f'<Relationship Id="rId{i}" Type="{_REL[1:-1]}/{t}" Target="{target}"/>'
    z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACK[1:-1]}">{rel(1, "officeDocument", "xl/workbook.xml")}</Relationships>')
    z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACK[1:-1]}">{"".join(rel(i, "worksheet", f"worksheets/sheet{i}.xml") for i in numbers)}</Relationships>')
    listed = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, start=1))
    z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{listed}</sheets></workbook>')
