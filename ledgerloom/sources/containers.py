"""Tables inside files that Spark has no reader for: workbooks, HTML tables and archives. Files are read in parallel, one
whole file at a time; what Python does with one is a small unpacking step, all else stays in DataFrame operators."""

from __future__ import annotations

import datetime as dt
import io
import itertools
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import decoded

#: Unpacked bytes of one part of a container; larger ones are reported, not read.
MOST_BYTES = 100_000_000
#: Numbers of the formats that a workbook shows as dates without describing them (fixed values), and the marks of its own.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
_DATE_MARKS = re.compile(r"[dmyhs]", re.IGNORECASE)


def _unpacked(spark: SparkSession, path: str, schema: str, unpack: Callable[[bytes], list[tuple]]) -> DataFrame:
    """(file, error, ...) rows of every file; a file that cannot be read is one row with its error, and stops nothing."""
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(file, *r) for r in unpack(bytes(content))]
                except Exception as e:  # noqa: BLE001  whatever is wrong with one file is that file's answer
                    rows = [(file, str(e) or type(e).__name__, *[None] * len(names))]
                yield pd.DataFrame(rows, columns=["file", "error", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, error string, {schema}")


class _Workbook:
    """The parts of a workbook by the names that its own lists give them."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())

    def events(self, part: str) -> Iterator[ElementTree.Element]:
        """The elements of a part as they end, without their namespaces; nothing if the part is not there."""
        if part not in self.names:
            return
        if self.zip.getinfo(part).file_size > MOST_BYTES:
            raise ValueError(f"{part} is too large")
        with self.zip.open(part) as stream:
            for _, element in ElementTree.iterparse(stream):
                element.tag = element.tag.rpartition("}")[2]
                yield element

    def first_sheet(self) -> str:
        """The sheet that comes first in the workbook's own order; by name where it has none."""
        order = [{k.rpartition("}")[2]: v for k, v in e.attrib.items()}.get("id") for e in self.events("xl/workbook.xml") if e.tag == "sheet"]
        targets = {e.get("Id"): e.get("Target", "") for e in self.events("xl/_rels/workbook.xml.rels") if e.tag == "Relationship"}
        for target in filter(None, map(targets.get, order)):
            part = posixpath.normpath(posixpath.join("xl", target)) if not target.startswith("/") else target[1:]
            if part in self.names:
                return part
        return min((n for n in self.names if n.startswith("xl/worksheets/")), key=lambda n: (len(n), n))

    def texts(self) -> list[str]:
        """Shared texts by number: the runs of each put together, readings above them left out."""
        out = []
        for e in self.events("xl/sharedStrings.xml"):
            if e.tag == "rPh":
                e.clear()
            elif e.tag == "si":
                out.append("".join(t.text or "" for t in e.iter() if t.tag == "t"))
        return out

    def date_styles(self) -> set[int]:
        """Numbers of the cell styles that show a date."""
        own, used = {}, []
        for e in self.events("xl/styles.xml"):
            if e.tag == "numFmt":
                own[int(e.get("numFmtId", "0"))] = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", ""))
            elif e.tag == "cellXfs":
                used = [int(x.get("numFmtId", "0")) for x in e if x.tag == "xf"]
        return {i for i, n in enumerate(used) if n in DATE_FORMATS or _DATE_MARKS.search(own.get(n, ""))}

    def cells(self) -> Iterator[tuple[int, int, str | None]]:
        """(row, column, value) of each cell of the first sheet, both from 0, in the order of the file; a date as year-month-day."""
        texts, dates = self.texts(), self.date_styles()
        since = dt.datetime(1904, 1, 1) if any(e.tag == "workbookPr" and e.get("date1904") in ("1", "true") for e in self.events("xl/workbook.xml")) else dt.datetime(1899, 12, 30)
        row, column = 0, 0
        for e in self.events(self.first_sheet()):
            if e.tag == "row":
                row, column = row + 1, 0
                e.clear()
            elif e.tag == "c":
                letters = (e.get("r") or "").rstrip("0123456789")
                if letters:
                    column = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters))) - 1
                kind, parts = e.get("t", "n"), {child.tag: child for child in e}
                value = parts["v"].text if "v" in parts else None
                if "is" in parts:
                    value = "".join(t.text or "" for t in parts["is"].iter() if t.tag == "t")
                elif kind == "s" and value is not None:
                    value = texts[int(value)]
                elif kind == "n" and value and int(e.get("s", "0")) in dates:
                    value = (since + dt.timedelta(days=float(value))).isoformat(" ").removesuffix(" 00:00:00")
                yield row, column, value
                column += 1


def _sheet_rows(content: bytes) -> list[tuple]:
    out = []
    for row, cells in itertools.groupby(_Workbook(content).cells(), key=lambda c: c[0]):
        values = {column: value for _, column, value in cells}
        out.append((None, row, [values.get(i) for i in range(max(values) + 1)]))
    return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, error, row, cells) of the first sheet of each workbook; cells of a date's style are dates, rows without a cell are left out."""
    return _unpacked(spark, path, "row int, cells array<string>", _sheet_rows)


#: Entities that tables write for characters (fixed values).
ENTITIES = [("&nbsp;", " "), ("&#8377;", "₹"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_cells(row: Column) -> Column:
    """The texts of the cells of one table row in HTML: tags gone, spaces squeezed."""
    cells = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]>|</tr>|\z)"), F.lit(1))

    def text(cell: Column) -> Column:
        t = F.regexp_replace(cell, "(?s)<[^>]*>", "")
        for name, character in ENTITIES:
            t = F.regexp_replace(t, name, character)
        return F.trim(F.regexp_replace(t, r"\s+", " "))

    return F.transform(cells, text)


def read_html_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, error, row, cells) of all table rows of each HTML file; a file without one gives a row that says so."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.split(decoded(F.col("content")), r"(?i)<tr\b[^>]*>").alias("_parts"))
    rows = files.select("file", F.posexplode_outer(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0)))).alias("row", "_row"))
    return rows.select("file", F.when(F.col("row").isNull(), "no table rows").alias("error"), "row", html_cells(F.col("_row")).alias("cells"))


def _members(content: bytes) -> list[tuple]:
    archive, out = zipfile.ZipFile(io.BytesIO(content)), []
    for member in archive.infolist():
        if member.file_size > MOST_BYTES:
            out.append((f"{member.filename} is too large", member.filename, None))
        elif not member.is_dir():
            try:
                out.append((None, member.filename, archive.read(member).decode("utf-8", "replace")))
            except Exception as e:  # noqa: BLE001  one member that cannot be unpacked leaves the others
                out.append((str(e) or type(e).__name__, member.filename, None))
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, error, member, text) of each member of each archive; a member that is too large or cannot be unpacked has an error
    and no text."""
    return _unpacked(spark, path, "member string, text string", _members)


#: Folders of an export by the path of a member (fixed patterns), the first that fits.
FOLDERS = [("activity", r"my.?activity[^/]*\.(?:html|json)$"), ("sends", r"(?:money.?sends|transactions)[^/]*\.csv$"), ("rewards", r"rewards?[^/]*\.csv$"), ("google", r"purchases?[^/]*\.(?:csv|json)$"), ("groups", r"group[^/]*\.json$")]


def folder_of(member: Column) -> Column:
    """Which folder of an export a member belongs to; null for the others."""
    out, low = F.lit(None).cast("string"), F.lower(member)
    for name, pattern in reversed(FOLDERS):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def named(rows: DataFrame, header: list[str]) -> DataFrame:
    """Rows of cells as columns of the given names, in order; cells that are not there are null."""
    return rows.select("file", "row", *[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(header)])
