import io
import zipfile

import pytest
from pyspark.sql import functions as F

from offerloom.sources import workbooks as W
from offerloom.sources import xlsx as X

MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheets, shared=(), tables=()):
    """A workbook of {name: rows}; rows of shared strings' numbers or texts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        listed = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(names))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>')
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            "<Relationships>" + "".join(
                f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))
            ) + "</Relationships>"
        )
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for i, name in enumerate(names):
            with z.open(f"xl/worksheets/s{i}.xml", "w") as part:
                part.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
                for at, row in enumerate(sheets[name]):
                    cells = "".join(
                        f'<c t="s"><v>{c}</v></c>' if isinstance(c, int) else f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in row
                    )
                    part.write(f'<row r="{at + 1}">{cells}</row>'.encode())
                part.write(b"</sheetData></worksheet>")
            if i < len(tables):
                z.writestr(
                    f"xl/worksheets/_rels/s{i}.xml.rels",
                    f'<Relationships><Relationship Id="t" Type="x/table" Target="../tables/t{i}.xml"/></Relationships>'
                )
                z.writestr(f"xl/tables/t{i}.xml", f'<table xmlns="{MAIN}" name="{tables[i]}" ref="A1:B2"/>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.xlsx").write_bytes(book({"One": [[0, "x"], [], [1]], "Two": [["y"]]}, shared=["Ro &amp; se", "é"], tables=["T1", "T2"]))
    (tmp_path / "in" / "b.xlsx").write_bytes(book({"One": [["z"]]}))
    (tmp_path / "notes.txt").write_text("not a workbook")
    return tmp_path


@pytest.mark.parametrize("split", [1, 1 << 20])
def test_rows_of_all_sheets(spark, folder, split):
    df = W.read_workbooks(spark, f"file://{folder}", split_bytes=split)
    got = sorted((r["path"][-6:], r["sheet"], r["row"], r["cells"]) for r in df.collect())
    assert got == [
        ("a.xlsx", "One", 0, ["Ro & se", "x"]), ("a.xlsx", "One", 1, []), ("a.xlsx", "One", 2, ["é"]),
        ("a.xlsx", "Two", 0, ["y"]), ("b.xlsx", "One", 0, ["z"])
    ]
    assert df.rdd.getNumPartitions() == (3 if split == 1 else 1)
    named = W.read_workbooks(spark, f"file://{folder}", tables=True, split_bytes=split).collect()
    assert sorted((r["sheet"], r["name"], r["ref"]) for r in named) == [("One", "T1", "A1:B2"), ("Two", "T2", "A1:B2")]


def test_filters_reach_the_reader(spark, folder):
    df = W.read_workbooks(spark, f"file://{folder}", split_bytes=1).where((F.col("sheet") == "Two") & (F.col("row") >= 0))
    assert [r["cells"] for r in df.collect()] == [["y"]]
    assert df.rdd.getNumPartitions() == 1  # of three
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert ">= 0" in plan and "Two" not in plan  # the source takes the filter on the sheet, Spark keeps the other
    path = f"{folder}/in/b.xlsx"
    assert W.read_workbooks(spark, f"file://{folder}").where(F.col("path").isin(path, "elsewhere")).count() == 1
    reader = W.WorkbookReader(f"file://{folder}", "*.xlsx", False, 1)
    left = list(reader.pushFilters([W.EqualTo(("sheet",), "One"), W.EqualTo(("row",), 3), W.In(("sheet",), ("One", "x"))]))
    assert left == [W.EqualTo(("row",), 3)] and reader.only == {"sheet": {"One"}}


def test_what_is_no_workbook(spark, folder):
    (folder / "bad.xlsx").write_bytes(b"PK not zipped")
    with pytest.raises(Exception, match="bad.xlsx is no workbook"):
        W.read_workbooks(spark, f"file://{folder}").collect()
    (folder / "none").mkdir()
    assert W.read_workbooks(spark, f"file://{folder}/none").collect() == []
    with pytest.raises(Exception, match="missing"):
        W.read_workbooks(spark, f"file://{folder}/missing").collect()


def test_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame(
        [("p", "S", 0, ["a", None]), ("p", "S", 2, ["b"]), ("q", "S", 0, ["c"])],
        "path string, sheet string, row int, cells array<string>"
    )
    W.write_workbooks(X.workbooks(rows), f"file://{tmp_path}/out")
    got = sorted((r["path"].rsplit("/", 1)[1], r["row"], r["cells"]) for r in W.read_workbooks(spark, f"file://{tmp_path}/out").collect())
    assert got == [("p.xlsx", 0, ["a"]), ("p.xlsx", 1, []), ("p.xlsx", 2, ["b"]), ("q.xlsx", 0, ["c"])]


def test_a_large_sheet_takes_little_memory(tmp_path):
    """300 MB of XML are pulled in a process of their own that stays far below 1 GB."""
    import subprocess
    import sys

    (tmp_path / "big.xlsx").write_bytes(book({"S": ([f"{i} {'x' * 200}", 0] for i in range(1_100_000))}, shared=["s"]))
    code = f"""
import resource, zipfile
from offerloom.sources import xlsx as X
with zipfile.ZipFile({str(tmp_path / "big.xlsx")!r}) as book:
    part = X.book_sheets(book)[0][1]
    assert book.getinfo(part).file_size > 290 << 20
    assert sum(1 for _ in X.sheet_rows(book, part, X.SharedStrings(book))) == 1_100_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run(
        [sys.executable, "-c", code], capture_output=True, text=True, timeout=300,
        cwd=X.__file__.rsplit("/offerloom/", 1)[0]
    )
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 600
