"""Workbooks: XLSX is zipped XML, read with the standard library, one workbook a row."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby, islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import plain

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_TEXT, _VALUE, _CELL = f"{_MAIN}t", f"{_MAIN}v", f"{_MAIN}c"
#: Uncompressed bytes of a small part (lists of sheets, relations, tables) that are read at most: beyond it the file is refused.
MOST_BYTES = 16 << 20
#: Uncompressed bytes up to which a part is parsed at once; a larger one is pulled element by element.
WHOLE_BYTES = 1 << 20
#: Rows, workbooks and bytes of workbooks of one Arrow batch.
BATCH_ROWS, BATCH_BOOKS, BATCH_BYTES = 10_000, 1_000, 8 << 20
#: Bytes of XML that are written or read by arrays at once.
STEP_BYTES = 1 << 20


def _small(book: zipfile.ZipFile, name: str) -> bytes:
    if book.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
    return book.read(name)


def _xml(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(_small(book, name))


@lru_cache(maxsize=4)
def _targets(relations: bytes) -> dict[str, str]:
    """Parts by their relation; workbooks of one writer mostly have the same."""
    return {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(relations)}


def _pulled(book: zipfile.ZipFile, name: str, tag: str):
    """The elements of a tag in a part of any size, as they come; of a large one what was read goes before the next is parsed."""
    if book.getinfo(name).file_size <= WHOLE_BYTES:
        yield from ElementTree.fromstring(book.read(name)).iter(tag)
        return
    with book.open(name) as part:
        events = ElementTree.iterparse(part, events=("start", "end"))
        above: list = []
        for event, element in events:
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if element.tag == tag:
                yield element
                if above:
                    above[-1].clear()


class SharedStrings:
    """A workbook's shared strings as UTF-8 bytes with a table of offsets: a few bytes more than the text itself."""

    def __init__(self, book: zipfile.ZipFile):
        self.data, self.ends = bytearray(), array("Q", [0])
        if "xl/sharedStrings.xml" in book.namelist():
            for s in _pulled(book, "xl/sharedStrings.xml", f"{_MAIN}si"):
                self.data += "".join(t.text or "" for t in s.iter(f"{_MAIN}t")).encode()
                self.ends.append(len(self.data))

    def __getitem__(self, i: int) -> str:
        return self.data[self.ends[i] : self.ends[i + 1]].decode()


@lru_cache(maxsize=1 << 14)
def _column(ref: str) -> int:
    """The number of a cell's column, by its reference without digits."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell, shared: SharedStrings) -> str | None:
    """What a cell shows: a formula's stored result, rich text joined, a link's text; errors and formulas without a result are empty."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        if len(cell) == 1 and len(cell[0]) == 1 and cell[0][0].tag == _TEXT:  # one run of text
            return cell[0][0].text or ""
        return "".join([t.text or "" for t in cell.iter(_TEXT)])
    v = cell.find(_VALUE)
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    return v.text


def book_sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets, in order."""
    return _listed(_small(book, "xl/workbook.xml"), _small(book, "xl/_rels/workbook.xml.rels"))


def _listed(book: bytes, relations: bytes) -> list[tuple[str, str]]:
    targets = _targets(relations)
    if one := _ONE_SHEET.fullmatch(book):  # as written here
        return [(one[1].decode(), f"xl/{targets['rId1']}")]
    found = ((sheet.get("name"), targets[sheet.get(f"{_REL}id")]) for sheet in ElementTree.fromstring(book).iter(f"{_MAIN}sheet"))
    return [(name, target.lstrip("/") if target.startswith("/") else f"xl/{target}") for name, target in found]


def sheet_rows(book: zipfile.ZipFile, part: str, shared: SharedStrings) -> Iterator[tuple[int, list[str | None]]]:
    """(row from 0, cells) of a sheet, one row at a time; rows that the sheet leaves out are empty."""
    expected = 0
    for row in _pulled(book, part, f"{_MAIN}row"):
        at = int(row.get("r", expected + 1)) - 1
        for empty in range(expected, at):
            yield empty, []
        cells: list[str | None] = []
        for cell in row.findall(_CELL):
            i = _column(cell.get("r").rstrip("0123456789")) if cell.get("r") else len(cells)
            cells += [None] * (i + 1 - len(cells))
            cells[i] = _value(cell, shared)
        yield at, cells
        expected = at + 1


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row from 0, cells) of every sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = SharedStrings(book)
        for name, part in book_sheets(book):
            for at, cells in sheet_rows(book, part, shared):
                yield name, at, cells


def book_tables(book: zipfile.ZipFile, name: str, part: str) -> Iterator[tuple[str, str, str]]:
    """(sheet, name, range) of the named tables of one sheet."""
    folder, _, file = part.rpartition("/")
    rels = f"{folder}/_rels/{file}.rels"
    if rels in book.namelist():
        for r in _xml(book, rels):
            if r.get("Type", "").endswith("/table"):
                t = _xml(book, "xl/" + r.get("Target").removeprefix("../").removeprefix("/xl/"))
                yield name, t.get("name"), t.get("ref")


def workbook_tables(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(sheet, name, range) of the named tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        for name, part in book_sheets(book):
            yield from book_tables(book, name, part)


_ONE_SHEET = re.compile(
    f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets><sheet name="([ !#-%\'-;=?-~]*)" sheetId="1" r:id="rId1"/></sheets></workbook>'
    .encode()
)


def _small_sheets(data: bytes) -> list[tuple[str, bytes]] | None:
    """(name, XML) of the sheets of a workbook that is small in all its parts and has no shared strings; else None."""
    parts = plain.directory(data)
    if not parts or "xl/sharedStrings.xml" in parts or not parts.keys() >= {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"}:
        return None
    read = lambda name: plain.part(data, parts[name], name)
    if max(whole for *_, whole, _ in parts.values()) > WHOLE_BYTES:
        return None
    listed = _listed(read("xl/workbook.xml"), read("xl/_rels/workbook.xml.rels"))
    return [(name, read(part)) for name, part in listed] if all(part in parts for _, part in listed) else None


def _small_rows(books: list[tuple[str, bytes, list[tuple[str, bytes]] | None]]) -> Iterator[pa.RecordBatch]:
    """(path, sheet, row, cells) of workbooks (path, content, small sheets): those of plain form by arrays, others one at a time."""
    left = [b[:2] for b in books if b[2] is None]
    books = [b for b in books if b[2]]
    while books:
        of = [i for i, b in enumerate(books) for _ in b[2]]
        odd, rows = plain.sheets([xml for *_, sheets in books for _, xml in sheets])
        if rows is not None:
            sheet, numbers, cells = rows
            at = pa.array(sheet)
            paths = pa.array([books[i][0] for i in of], pa.string())
            names = pa.array([name for *_, sheets in books for name, _ in sheets], pa.string())
            whole = pa.RecordBatch.from_arrays([paths.take(at), names.take(at), pa.array(numbers, pa.int32()), cells], names=_CELLS)
            yield from (whole.slice(i, BATCH_ROWS) for i in range(0, whole.num_rows, BATCH_ROWS))
            break
        others = {of[i] for i in np.flatnonzero(odd)}
        left += [books[i][:2] for i in sorted(others)]
        books = [b for i, b in enumerate(books) if i not in others]
    yield from _batches((path, *r) for path, data in left for r in workbook_rows(data))


_CELLS = ["path", "sheet", "row", "cells"]


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string())]
    while some := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=_CELLS)


def _shared(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches bounded as workbooks share them: an operator before may have left batches of a few rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def workbook_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, row, cells) of workbooks (path, content)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                data = content.as_py()
                held.append((path, data, _small_sheets(data)))
                size += sum(len(xml) for _, xml in held[-1][2] or [("", data)])
                if size > STEP_BYTES:
                    yield from _small_rows(held)
                    held, size = [], 0
        yield from _small_rows(held)

    return _shared(files).select("path", "content").mapInArrow(rows, "path string, sheet string, row int, cells array<string>")


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of all workbooks below a path."""
    return workbook_cells(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path))


def read_xlsx_tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, name, ref) of the named tables of all workbooks below a path."""

    def tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                yield pd.DataFrame([(name, *t) for t in workbook_tables(data)], columns=["path", "sheet", "name", "ref"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInPandas(
        tables,
        "path string, sheet string, name string, ref string"
    )


_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    f'<Relationship Id="rId1" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    f'<Relationship Id="rId1" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL[1:-1]}/styles" Target="styles.xml"/></Relationships>',
    # cell styles: 0 plain, 1 bold, 2 two decimals
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="2" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
#: They come first in each workbook, too small to gain from compression.
_BEFORE = plain.entries([(name.encode(), text.encode(), text.encode(), 0) for name, text in _PARTS.items()])
_NUMBER = "^-?[0-9]+([.][0-9]+)?$"
#: What XML can't hold.
_UNFIT = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_OPENING, _CLOSING = f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode(), b"</sheetData></worksheet>"


@lru_cache(maxsize=1 << 14)
def _letters(i: int) -> str:
    return (_letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


@lru_cache(maxsize=1 << 12)
def _inline(text: str) -> str:
    """A text as a cell holds it; spaces at its ends are kept by name only."""
    shown = escape(_UNFIT.sub(" ", text))
    return f"<is><t{'' if shown == shown.strip() else ' xml:space=\"preserve\"'}>{shown}</t></is>"


#: What follows a cell's place, by its kind: text, text of a bold row, number, price.
_KINDS = [
    lambda c: f'" t="inlineStr">{_inline(c)}</c>',
    lambda c: f'" s="1" t="inlineStr">{_inline(c)}</c>',
    lambda c: f'"><v>{c}</v></c>',
    lambda c: f'" s="2"><v>{c}</v></c>',
]


def _row_xml(at: np.ndarray, cells: pa.ListArray, numbers: frozenset[int], prices: frozenset[int], bold: frozenset[int]) -> pa.StringArray:
    """Rows (numbers from 0, cells) as a sheet holds them. Cells of a kind that hold the same are made once."""
    lengths, values = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False).astype(np.int64), cells.flatten()
    owner = np.repeat(np.arange(len(at)), lengths)
    column = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(values), 0), False).to_numpy(zero_copy_only=False))
    values, owner, column = values.take(pa.array(kept)), owner[kept], column[kept]
    wide = int(column.max(initial=-1)) + 1
    is_price, is_number = (np.array([i in some for i in range(wide)], bool) for some in (prices, numbers | prices))
    kind = np.isin(at, list(bold))[owner].astype(np.int8)
    may = np.flatnonzero((kind == 0) & is_number[column])
    may = may[pc.match_substring_regex(values.take(pa.array(may)), _NUMBER).to_numpy(zero_copy_only=False)]
    kind[may] = np.where(is_price[column[may]], 3, 2)
    shown, which = [], np.zeros(len(values), np.int64)
    for k, show in enumerate(_KINDS):
        of = np.flatnonzero(kind == k)
        coded = values.take(pa.array(of)).dictionary_encode()
        which[of] = coded.indices.to_numpy() + len(shown)
        shown += map(show, coded.dictionary.to_pylist())
    place, row = pa.array([f'<c r="{_letters(i)}' for i in range(wide)], pa.string()), pa.array(at + 1).cast(pa.string())
    each = pc.binary_join_element_wise(
        place.take(pa.array(column)), row.take(pa.array(owner)), pa.array(shown, pa.string()).take(pa.array(which)), ""
    )
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at)))])
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), "")
    return pc.binary_join_element_wise('<row r="', row, '">', whole, "</row>", "")


def _book(sheet: str, pieces: Iterator[bytes]) -> bytes:
    """A workbook of one sheet, whose rows come in pieces of XML; of several only their compressed bytes are held."""
    title = quoteattr(_UNFIT.sub(" ", re.sub(r"[\[\]:*?/\\]", " ", sheet))[:31])
    listed = f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets><sheet name={title} sheetId="1" r:id="rId1"/></sheets></workbook>'
    first, second = next(pieces, b""), next(pieces, None)
    if second is None:
        content, packer = b"".join((_OPENING, first, _CLOSING)), zlib.compressobj(1, zlib.DEFLATED, -15)
        stored = packer.compress(content) + packer.flush()
        text = listed.encode()
        return plain.zipped([(b"xl/workbook.xml", text, text, 0), (b"xl/worksheets/sheet1.xml", content, stored, 8)], _BEFORE)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        for name, text in {**_PARTS, "xl/workbook.xml": listed}.items():
            book.writestr(zipfile.ZipInfo(name), text)
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as part:
            for piece in chain([_OPENING, first, second], pieces, [_CLOSING]):
                part.write(piece)
    return out.getvalue()


def workbook(
    sheet: str, rows: Iterator[tuple[int, list[str | None]]], numbers: frozenset[int], prices: frozenset[int],
    bold: frozenset[int]
) -> bytes:
    """A workbook of one sheet. rows ascend by their number, from 0; columns in numbers and prices hold numbers below the bold rows."""
    each = iter(lambda: list(islice(it, 1000)), [])
    it = iter(rows)
    xml = (_row_xml(np.array([r[0] for r in some]), pa.array([r[1] for r in some], pa.list_(pa.string())), numbers, prices, bold) for some in each)
    return _book(sheet, (x for some in xml for x in [pc.binary_join(pa.array([some.to_pylist()]), "")[0].as_py().encode()]))


def workbooks(
    rows: DataFrame, *, numbers: list[int] = (), prices: list[int] = (), bold: list[int] = (), dealt: bool = False
) -> DataFrame:
    """(path, content): one workbook of each path. rows: path, sheet, row (from 0), cells array<string>.

    Rows are dealt by path, sorted and written as they come; of workbooks only their compressed bytes are held, some to a batch.
    dealt: all rows of a path stand in one partition already.
    """
    numbers, prices, bold = frozenset(numbers), frozenset(prices), frozenset(bold)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, memoryview]]:
        """(path, sheet, XML of rows that follow each other)."""
        for some in chain.from_iterable(map(_steps, batches)):
            xml = _row_xml(some["row"].to_numpy(zero_copy_only=False), some["cells"], numbers, prices, bold)
            ends, data = np.frombuffer(xml.buffers()[1], np.int32)[: len(xml) + 1].tolist(), memoryview(xml.buffers()[2] or b"")
            codes = [pc.fill_null(some[c].dictionary_encode().indices, -1).to_numpy() for c in ("path", "sheet")]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1
            starts = [0, *new.tolist()]
            names = (some[c].take(pa.array(starts)).to_pylist() for c in ("path", "sheet"))
            for path, sheet, lo, hi in zip(*names, starts, [*starts[1:], len(xml)]):
                yield path, sheet, data[ends[lo] : ends[hi]]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, contents, size = [], [], 0
        for (path, sheet), group in groupby(pieces(batches), key=lambda r: r[:2]):
            paths.append(path)
            contents.append(_book(sheet, (r[2] for r in group)))
            size += len(contents[-1])
            if len(paths) == BATCH_BOOKS or size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                paths, contents, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    rows = _shared(rows).select("path", "sheet", "row", "cells")
    ordered = (rows if dealt else rows.repartition("path")).sortWithinPartitions("path", "sheet", "row")
    return ordered.mapInArrow(written, "path string, content binary")


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about STEP_BYTES of XML."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch["cells"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["cells"].flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    step = np.concatenate([[0], size])[ends] // STEP_BYTES
    cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:]) if hi > lo)
