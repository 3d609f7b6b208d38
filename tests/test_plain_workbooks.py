import io
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerloom.operators import reports as RP
from offerloom.sources import plain
from offerloom.sources import xlsx as X

OPENING = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
CLOSING = "</sheetData></worksheet>"


def _rows(xml: bytes) -> list:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("s.xml", xml)
    with zipfile.ZipFile(out) as book:
        return list(X.sheet_rows(book, "s.xml", X.SharedStrings(book)))


def at_once(xmls: list[bytes]) -> list:
    odd, rows = plain.sheets(xmls)
    assert not odd.any()
    out = [[] for _ in xmls]
    for sheet, at, cells in zip(rows[0].tolist(), rows[1].tolist(), rows[2].to_pylist()):
        out[sheet].append((at, cells))
    return out


def test_sheets_at_once_are_those_one_by_one():
    rng = random.Random(5)
    texts = ["a", " lead", "é€😀", "&amp;&lt;b&gt; &quot;x&quot; &amp;amp;", "x\ty\nz", "", "  ", "=1", "\x7f", "A1\" s=\"1"]
    xmls = []
    for _ in range(300):
        rows, at = [], 0
        for _ in range(rng.randrange(6)):
            at += rng.choice([1, 1, 1, 4])
            cells = []
            for c in sorted(rng.sample([*range(30), 700, 701, 702], rng.randrange(7))):
                style = rng.choice(["", ' s="2"'])
                text = f' t="inlineStr"><is><t{rng.choice(["", " xml:space=" + chr(34) + "preserve" + chr(34)])}>{rng.choice(texts)}</t></is>'
                cells.append(f'<c r="{X._letters(c)}{at}"{style}{rng.choice([text, text, "><v>" + rng.choice(["1.5", "-2", ""]) + "</v>"])}</c>')
            rows.append(f'<row r="{at}">{"".join(cells)}</row>')
        xmls.append((OPENING + "".join(rows) + CLOSING).encode())
    assert at_once(xmls) == [_rows(x) for x in xmls]
    assert at_once([(OPENING + CLOSING).encode()]) == [[]] and plain.sheets([])[1] is None


ODD = [
    '<row r="1"><c r="A1"/></row>', '<row r="1"/>', '<row r="1" spans="1:2"><c r="A1"><v>1</v></c></row>', '<row><c r="A1"><v>1</v></c></row>',
    '<row r="1"><c><v>1</v></c></row>', '<row r="1"><c r="A1" t="b"><v>1</v></c></row>', '<row r="1"><c r="A1" t="e"><v>#REF!</v></c></row>',
    '<row r="1"><c r="A1"><f>1+1</f><v>2</v></c></row>', '<row r="1"><c r="A1" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>',
    '<row r="1"><c r="A1" t="inlineStr"><is><t>a&#66;</t></is></c></row>', '<row r="1"><c r="A1" t="inlineStr"><is><t><![CDATA[<c>]]></t></is></c></row>',
    '<!-- <row r="1"> --><row r="2"><c r="B2"><v>1</v></c></row>', '<row r="1"> <c r="A1"><v>1</v></c></row>', '<row r="1"><c r="A1" s="12"><v>1</v></c></row>',
    '<row r="1"><c r="B1"><v>1</v></c><c r="A1"><v>2</v></c></row>', '<row r="1"><c r="A1"><v>1</v></c><c r="A1"><v>2</v></c></row>',
    '<row r="1"><c r="A1" t="inlineStr"><is><t>a > b</t></is></c></row>', '<row r="1"><c r="A1" t="inlineStr"><is><t>a\r\nb</t></is></c></row>',
    '<row r="1"><c r="A1" t="inlineStr"><is><t/></is></c></row>', '<row r="1"><c r="A1" t="inlineStr"><is><t xml:lang="nederlands">b</t></is></c></row>',
    '<row r="0"><c r="A1"><v>1</v></c></row>', '<row r="1" x="<"></row>', '<row r="1"><c r="A1"><v>1</v></row></c>', '<row r="1"><c r="A1"><v>&nbsp;</v></c></row>',
    '<row r="1"><c r="A1" cm="1"><v>1</v></c></row>', '<row r="1"><c r="A1" t="inlineStr"><is><t>\x01</t></is></c></row>', '<row r="1"><c r="A1"><v>1</t></c></row>',
]


@pytest.mark.parametrize("rows", ODD)
def test_odd_sheets_are_told_apart(rows):
    fine = (OPENING + '<row r="1"><c r="A1"><v>7</v></c></row>' + CLOSING).encode()
    odd, found = plain.sheets([fine, (OPENING + rows + CLOSING).encode(), fine])
    assert odd[1] and found is None


def packed(xml: str, **more: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in {**X._PARTS, **more}.items():
            book.writestr(name, text)
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{plain.MAIN}" xmlns:r="{X._REL[1:-1]}"><sheets><sheet name="a &amp; b" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/worksheets/sheet1.xml", xml)
    return out.getvalue()


def test_odd_workbooks_stand_among_plain_ones(spark):
    shared = packed(OPENING + '<row r="1"><c r="A1" t="s"><v>1</v></c></row>' + CLOSING, **{"xl/sharedStrings.xml": f'<sst xmlns="{plain.MAIN}"><si><t>x</t></si><si><t>y</t></si></sst>'})
    books = [packed(f'<?xml version="1.0"?>{OPENING}{r}{CLOSING}') for r in ODD[:20]] + [shared]
    books += [X.workbook("S", iter([(0, ["a", None, "1"]), (2, ["<&>"])]), frozenset([2]), frozenset(), frozenset())] * 3
    files = spark.createDataFrame([(str(i), bytearray(b)) for i, b in enumerate(books)], "path string, content binary").coalesce(1)
    got = sorted((int(r["path"]), r["sheet"], r["row"], r["cells"]) for r in X.workbook_cells(files).collect())
    assert got == sorted((i, *r) for i, b in enumerate(books) for r in X.workbook_rows(b))
    assert (20, "a & b", 0, ["y"]) in got and (22, "S", 2, ["<&>"]) in got


def test_plain_workbooks_are_read_at_once(monkeypatch):
    # before, each workbook's XML was parsed alone
    books = [X.workbook("S", iter([(0, ["a", str(i)])]), frozenset([1]), frozenset(), frozenset()) for i in range(50)]
    monkeypatch.setattr(X, "workbook_rows", None)
    (batch,) = X._small_rows([(str(i), b, X._small_sheets(b)) for i, b in enumerate(books)])
    assert batch.to_pydict() == {"path": [*map(str, range(50))], "sheet": ["S"] * 50, "row": [0] * 50, "cells": [["a", str(i)] for i in range(50)]}


def test_zips_are_those_of_the_library():
    data = X.workbook("Lijst/1", iter([(0, ["é"])]), frozenset(), frozenset(), frozenset())
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        assert book.testzip() is None and len(book.namelist()) == len(X._PARTS) + 2
        parts = plain.directory(data)
        assert {n: plain.part(data, e, n) for n, e in parts.items()} == {n: book.read(n) for n in book.namelist()}
    at = data.index(b"<styleSheet")
    with pytest.raises(zipfile.BadZipFile):
        plain.part(data[:at] + b"X" + data[at + 1 :], parts["xl/styles.xml"], "xl/styles.xml")
    assert plain.directory(b"no zip") is plain.directory(data + b"x") is plain.directory(b"") is None


def test_a_workbook_goes_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)  # as an operator before may leave it
    rows = spark.range(25_000).select(
        (F.when(F.col("id") < 21_000, "big").otherwise(F.concat(F.lit("p"), (F.col("id") % 2000).cast("string")))).alias("path"), F.lit("S").alias("sheet"),
        F.when(F.col("id") < 21_000, F.col("id")).otherwise(0).cast("int").alias("row"), F.array(F.lit("&"), F.lit(None), F.col("id").cast("string"), F.repeat(F.lit("x"), 100)).alias("cells")
    )
    books = X.workbooks(rows.where("path = 'big' or cells[2] >= 23000").coalesce(1), prices=[2])
    n = books.mapInArrow(lambda them: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in them), "n long").toArrow()["n"].to_pylist()
    assert sum(n) == 2001 and len(n) <= 8
    got = X.workbook_cells(books).where("size(cells) > 0").collect()
    assert {(r["row"], *r["cells"]) for r in got} == {
        (i if i < 21_000 else 0, "&", None, str(i), "x" * 100) for i in range(25_000) if i < 21_000 or i >= 23_000
    }


def test_lines_of_a_sheet_are_dealt_once(spark):
    lines = spark.range(40).select((F.col("id") % 7).alias("quote_id"), F.col("id").alias("position"), *(F.lit(1).alias(c) for c in ("stems_per_box", "quantity_boxes")))
    books = X.workbooks(RP.customer_workbook(lines), dealt=True)
    assert books._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # two before
    assert books.count() == 7 and X.workbook_cells(books).count() == 7 * 5 + 40


def test_cells_are_written_as_before():
    at = np.array([0, 1, 5])
    rows = pa.array([["n", None, "2.50", "", "-3", "1e5"], None, ["<", " y ", "7", None, ".5", "9"]], pa.list_(pa.string()))
    assert X._row_xml(at, rows, frozenset([4, 5]), frozenset([2]), frozenset([0])).to_pylist() == [
        '<row r="1"><c r="A1" s="1" t="inlineStr"><is><t>n</t></is></c><c r="C1" s="1" t="inlineStr"><is><t>2.50</t></is></c>'
        '<c r="E1" s="1" t="inlineStr"><is><t>-3</t></is></c><c r="F1" s="1" t="inlineStr"><is><t>1e5</t></is></c></row>',
        '<row r="2"></row>',
        '<row r="6"><c r="A6" t="inlineStr"><is><t>&lt;</t></is></c><c r="B6" t="inlineStr"><is><t xml:space="preserve"> y </t></is></c>'
        '<c r="C6" s="2"><v>7</v></c><c r="E6" t="inlineStr"><is><t>.5</t></is></c><c r="F6"><v>9</v></c></row>',
    ]
