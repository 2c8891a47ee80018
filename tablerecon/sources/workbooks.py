"""Spreadsheet workbooks (.xlsx) as text tables.

Spark lists the files; a task opens a workbook where it lies, by random access
into the archive, and reads the heads of its sheets.  Each sheet is then a row
of its own, (file, sheet, columns), dealt to the tasks that stream its XML in
pieces and send on Arrow batches.  So no task holds a file or a sheet, and only
wanted columns are turned into text.  Stores that Python cannot open go through
Spark's ``binaryFile`` source instead, one file a cell.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablerecon.functions.numbers import decimals_of, is_date_format
from tablerecon.operators.columns import clean_name
from tablerecon.sources.files import listed, opened

#: Cells of a batch, and bytes of XML that are parsed at once.
_BATCH_CELLS = 100_000
_CHUNK = 256 << 10
# Built-in number formats that a workbook does not spell out.
_BUILTIN_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "yyyy-mm-dd",
    15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 20: "hh:mm", 21: "hh:mm:ss", 22: "yyyy-mm-dd hh:mm", 49: "@",
}
# Day zero of the two spreadsheet calendars.
_EPOCH_1900 = datetime.datetime(1899, 12, 30)
_EPOCH_1904 = datetime.datetime(1904, 1, 1)


@dataclass(frozen=True)
class Layout:
    """Where a sheet's header and data are (rows count from 1).

    ``two_level`` reads a group title row above the header: titles fill to
    the right over their merged cells (or over blank ones when nothing is
    merged) and are joined to the column title with ``-``.  ``display`` shows
    numbers as their format does.  Rows without any value are left out unless
    ``keep_blank_rows`` is set.
    """

    header_row: int = 1
    data_row: int | None = None
    two_level: bool = False
    display: bool = False
    keep_blank_rows: bool = False

    @property
    def first_data_row(self) -> int:
        return self.data_row or self.header_row + (2 if self.two_level else 1)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _column_index(reference: str) -> int:
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _parser(start: Callable, end: Callable | None = None, chars: Callable | None = None):
    """An expat parser whose handlers get names without a prefix."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = lambda tag, attrs: start(tag.rpartition(":")[2], attrs)
    if end:
        parser.EndElementHandler = lambda tag: end(tag.rpartition(":")[2])
    parser.CharacterDataHandler = chars
    return parser


class _Strings:
    """Shared strings as one run of bytes and their ends: a few bytes beside the text of each."""

    def __init__(self, stream) -> None:
        self.data, self.ends = bytearray(), array("Q")
        depth = {"rPh": 0, "t": 0}

        def start(tag: str, attrs: dict) -> None:
            if tag in depth:
                depth[tag] += 1

        def end(tag: str) -> None:
            if tag in depth:
                depth[tag] -= 1
            elif tag == "si":
                self.ends.append(len(self.data))

        def chars(text: str) -> None:
            if depth["t"] and not depth["rPh"]:
                self.data += text.encode()

        parser = _parser(start, end, chars)
        while chunk := stream.read(_CHUNK):
            parser.Parse(chunk)

    def __getitem__(self, i: int) -> str:
        return self.data[self.ends[i - 1] if i else 0 : self.ends[i]].decode()


class _Book:
    """One open workbook: sheet parts, shared strings, number formats."""

    def __init__(self, source) -> None:
        self.zip = zipfile.ZipFile(source)
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        targets = {r.attrib["Id"]: r.attrib["Target"] for r in links}
        self.sheets: dict[str, str] = {}
        self.epoch = _EPOCH_1900
        for e in book.iter():
            if _local(e.tag) == "workbookPr" and e.attrib.get("date1904") in ("1", "true"):
                self.epoch = _EPOCH_1904
            if _local(e.tag) == "sheet":
                target = targets[_attr(e, "id")]
                self.sheets[e.attrib["name"]] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        self.formats = self._formats() if "xl/styles.xml" in names else []
        self._strings: _Strings | None = None

    def strings(self) -> _Strings:
        """Shared strings, read when a wanted cell first needs one."""
        if self._strings is None:
            with self.zip.open("xl/sharedStrings.xml") as f:
                self._strings = _Strings(f)
        return self._strings

    def _formats(self) -> list[str]:
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own, used = {}, []
        for e in styles.iter():
            if _local(e.tag) == "numFmt":
                own[int(e.attrib["numFmtId"])] = e.attrib["formatCode"]
            if _local(e.tag) == "cellXfs":
                used = [int(x.attrib.get("numFmtId", 0)) for x in e]
        return [own.get(i, _BUILTIN_FORMATS.get(i, "General")) for i in used]

    def merged(self, sheet: str) -> list[tuple[int, int, int]]:
        """Merged ranges as (first row, first column, last column).

        They come after all rows, which are passed over as bytes.
        """
        out, rest = [], b""
        mark = re.compile(rb"<(?:\w+:)?mergeCell\s[^>]*?ref\s*=\s*[\"']([A-Za-z0-9:$]+)[\"'][^>]*>")
        with self.zip.open(self.sheets[sheet]) as f:
            while chunk := f.read(_CHUNK):
                rest += chunk
                done = 0
                for found in mark.finditer(rest):
                    a, _, b = found[1].decode().replace("$", "").partition(":")
                    out.append((int(re.sub(r"\D", "", a)), _column_index(a), _column_index(b or a)))
                    done = found.end()
                # What may be the beginning of another one stays.
                rest = rest[max(done, rest.rfind(b"<"), 0) :]
        return out

    def width(self, sheet: str) -> int:
        """Columns the sheet uses: as it declares, or else by looking at every row."""
        declared: list[int] = []

        def start(tag: str, attrs: dict) -> None:
            if tag == "dimension":
                declared.append(_column_index(attrs["ref"].rpartition(":")[2]) + 1)
            elif tag == "sheetData" and not declared:
                declared.append(0)

        parser = _parser(start)
        with self.zip.open(self.sheets[sheet]) as f:
            while not declared and (chunk := f.read(1 << 14)):
                parser.Parse(chunk)
        if declared and declared[0]:
            return declared[0]
        return max((width for _, _, width in self.rows(sheet, False, frozenset())), default=0)

    def rows(self, sheet: str, display: bool, wanted: frozenset[int] | None = None) -> Iterator[tuple[int, dict[int, str | None], int]]:
        """Number, cells by column and width of each row; only ``wanted`` columns, if given, are read as text."""
        done: list[tuple[int, dict[int, str | None], int]] = []
        number, at, kind, style = 0, -1, "n", "0"
        cells: dict[int, str | None] = {}
        parts: list[str] | None = None
        taking = phonetic = False

        def start(tag: str, attrs: dict) -> None:
            nonlocal number, at, kind, style, cells, parts, taking, phonetic
            if tag == "c":
                at = _column_index(attrs["r"]) if "r" in attrs else at + 1
                kind, style = attrs.get("t", "n"), attrs.get("s", "0")
                parts = [] if kind == "inlineStr" else None
            elif tag == "row":
                number, at, cells = int(attrs.get("r", number + 1)), -1, {}
            elif tag == "v":
                parts, taking = [], True
            elif tag == "t":
                taking = not phonetic
            elif tag == "rPh":
                phonetic = True

        def chars(text: str) -> None:
            if taking and parts is not None:
                parts.append(text)

        def end(tag: str) -> None:
            nonlocal taking, phonetic
            if tag == "c":
                if parts is not None and (wanted is None or at in wanted):
                    cells[at] = self._cell("".join(parts), kind, style, display)
            elif tag == "row":
                done.append((number, cells, at + 1))
            elif tag in ("v", "t"):
                taking = False
            elif tag == "rPh":
                phonetic = False

        parser = _parser(start, end, chars)
        with self.zip.open(self.sheets[sheet]) as f:
            while chunk := f.read(_CHUNK):
                parser.Parse(chunk)
                yield from done
                done.clear()

    def _cell(self, value: str, kind: str, style: str, display: bool) -> str | None:
        if kind == "s":
            return self.strings()[int(value)]
        if kind == "b":
            return "True" if value == "1" else "False"
        if kind != "n":
            return value
        if not value:
            return None
        i = int(style)
        return cell_text(value, self.formats[i] if i < len(self.formats) else "General", self.epoch, display)


def cell_text(value: str, fmt: str, epoch: datetime.datetime = _EPOCH_1900, display: bool = False) -> str:
    """A numeric cell as text: the plain value, or as its format shows it."""
    number = float(value)
    if fmt != "General" and is_date_format(fmt):
        moment = epoch + datetime.timedelta(seconds=round(number * 86_400))
        if moment.time() == datetime.time(0) and not any(t in fmt.lower() for t in ("h", "s")):
            return moment.strftime("%Y-%m-%d")
        return moment.strftime("%Y-%m-%d %H:%M:%S")
    if display and fmt not in ("General", "@"):
        shown = number * 100 if "%" in fmt else number
        return f"{shown:.{decimals_of(fmt)}f}" + ("%" if "%" in fmt else "")
    if number.is_integer() and abs(number) < 1e15:
        return str(int(number))
    return repr(number)


def header_names(book: _Book, sheet: str, layout: Layout) -> list[str]:
    """Cleaned column names of a sheet; repeated and blank ones get a number."""
    wanted = {layout.header_row, layout.header_row + 1} if layout.two_level else {layout.header_row}
    found: dict[int, list[str]] = {}
    for number, cells, width in book.rows(sheet, False):
        if number in wanted:
            found[number] = [cells.get(i) or "" for i in range(width)]
        if number >= max(wanted):
            break
    top = found.get(layout.header_row, [])
    # Data may reach further right than the header does.
    top += [""] * (book.width(sheet) - len(top))
    if layout.two_level:
        low = found.get(layout.header_row + 1, [])
        width = max(len(top), len(low))
        top += [""] * (width - len(top))
        low += [""] * (width - len(low))
        ranges = [r for r in book.merged(sheet) if r[0] == layout.header_row]
        if ranges:
            for _, first, last in ranges:
                top[first : last + 1] = [top[first]] * (min(last, width - 1) + 1 - first)
        else:
            last_title = ""
            for i, title in enumerate(top):
                last_title = title or last_title
                top[i] = last_title
        top = [f"{a}-{b}".strip("-") for a, b in zip(top, low)]
    names: list[str] = []
    for i, name in enumerate(map(clean_name, top)):
        name = name or f"_column_{i + 1}"
        names.append(name if name not in names else f"{name}_{i + 1}")
    return names


def _opened(path: str, content: bytes | None) -> _Book:
    return _Book(opened(path, content))


def _catalog(files: DataFrame, layout: Layout, sheet: str | None = None) -> DataFrame:
    """file, sheet and columns of every sheet, from the heads of the sheets; and the content that came along."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                book = _opened(path.as_py(), content.as_py())
                rows = [
                    {"file": path.as_py(), "sheet": s, "columns": header_names(book, s, layout), "content": content.as_py()}
                    for s in book.sheets
                    if sheet is None or s == sheet
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("columns", pa.list_(pa.string())), ("content", pa.binary())])
    return files.mapInArrow(scan, "file string, sheet string, columns array<string>, content binary")


def workbook_catalog(
    spark: SparkSession, paths: Sequence[str], layout: Layout = Layout(), through_spark: bool | None = None
) -> DataFrame:
    """Every sheet of every workbook with its column names."""
    return _catalog(listed(spark, paths, through_spark), layout).drop("content")


def read_workbooks(
    spark: SparkSession,
    paths: Sequence[str],
    sheet: str | None = None,
    layout: Layout = Layout(),
    columns: Sequence[str] | None = None,
    through_spark: bool | None = None,
) -> DataFrame:
    """Sheets of many workbooks as one table of text columns.

    ``_file``, ``_sheet`` and ``_row`` say where a row comes from.  Cached
    values are read, not formulas.  Columns are matched by cleaned name;
    without ``columns`` the distinct names of all headers are looked up first,
    which reads the sheets' heads only.  ``sheet`` picks one sheet per file,
    otherwise all are read.  ``through_spark`` has the files read by Spark
    instead of Python (by default where Python has no access to the store).
    """
    catalog = _catalog(listed(spark, paths, through_spark), layout, sheet)
    if columns is None:
        places = catalog.select(F.posexplode("columns").alias("place", "name"))
        # Distinct names only: a sheet has at most 16,384 columns.
        found = places.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()
        columns = [r["name"] for r in found]
    wanted = list(columns)
    fields = ["_file", "_sheet", "_row", *wanted]
    schema = pa.schema([(n, pa.int64() if n == "_row" else pa.string()) for n in fields])
    batch_rows = max(1, _BATCH_CELLS // len(fields))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, names, content in zip(*(batch.column(c).to_pylist() for c in ("file", "sheet", "columns", "content"))):
                yield from _sheet_batches(path, name, names, _opened(path, content))

    def _sheet_batches(path: str, name: str, names: list[str], book: _Book) -> Iterator[pa.RecordBatch]:
        places = {n: i for i, n in enumerate(names)}
        picked = [places.get(n, -1) for n in wanted]
        # Whether a row is blank shows in all its columns.
        read = None if not layout.keep_blank_rows else frozenset(picked)
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            arrays = [pa.array(c, t.type) for c, t in zip(zip(*rows), schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for number, cells, _ in book.rows(name, layout.display, read):
            if number < layout.first_data_row:
                continue
            if not layout.keep_blank_rows and not any(cells.values()):
                continue
            rows.append((path, name, number, *map(cells.get, picked)))
            if len(rows) == batch_rows:
                yield made()
        if rows:
            yield made()

    ddl = ", ".join(f"`{n.replace('`', '``')}` {'bigint' if n == '_row' else 'string'}" for n in fields)
    # One sheet is the unit of work; many of them share a task, one after the other.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return catalog.repartition(tasks, "file", "sheet").mapInArrow(load, ddl)
