import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from offerloom.operators import tables as TB
from offerloom.sources import delimited as CSV
from offerloom.sources import files as FI
from offerloom.sources import mails as ML
from offerloom.sources import xlsx as X
from offerloom.streaming import offers as ST


def of(spark, value, build):
    return spark.createDataFrame([(value,)], "x string").select(build(F.col("x"))).first()[0]


def test_mails(spark):
    multi = 'From: a@b\r\nContent-Type: multipart/alternative; boundary="B1"\r\n\r\n--B1\r\nContent-Type: text/html\r\n\r\n<p>no</p>\r\n--B1\r\nContent-Type: text/plain\r\n\r\nRoses $1\r\n\r\nBye\r\n--B1--'
    assert of(spark, multi, ML.mail_text).split() == ["Roses", "$1", "Bye"]
    html = "Subject: x\n\n<html><style>p{}</style><body>Rose<br>Pink &amp; red</body></html>"
    assert of(spark, html, ML.mail_text).split() == ["Rose", "Pink", "&", "red"]
    assert of(spark, "no headers\n\nhere", ML.mail_text) == "no headers\n\nhere"
    assert of(spark, "To: x\n\nplain body", ML.mail_text).strip() == "plain body"


def test_nested_and_encoded_mails(spark):
    inner = "--in\nContent-Type: text/html\n\n<p>no</p>\n--in\nContent-Type: text/plain; charset={}\nContent-Transfer-Encoding: {}\n\n{}\n--in--\n"
    nested = 'From: a@b\nContent-Type: multipart/mixed; boundary="out"\n\n--out\nContent-Type: text/plain\nContent-Disposition: attachment\n\nfile\n--out\nContent-Type: multipart/alternative; boundary=in\n\n' + inner + "--out--\n"
    said = lambda *parts: of(spark, nested.format(*parts), ML.mail_text).strip()
    assert said("iso-8859-1", "quoted-printable", "Crème=20br=FBl=E9e=\n 5=2C0") == "Crème br\xfbl\xe9e 5,0"
    assert said("utf-8", "Base64", "w6kg4oKsIDE=") == "é € 1" and said("no-such-set", "base64", "w6k=") == "é"
    assert said("utf-8", "8bit", "é stays") == "é stays" and said("utf-8", "base64", "%%%") is not None
    only_html = "Subject: x\nContent-Type: multipart/related; boundary=q\n\n--q\nContent-Type: text/html\nContent-Transfer-Encoding: quoted-printable\n\n<div>a=3Db</div>\n--q--"
    assert of(spark, only_html, ML.mail_text).strip() == "a=b"
    assert of(spark, "Fwd\nFrom: x\n\nbody here", ML.mail_text).strip() == "body here"
    assert of(spark, "Content-Type: multipart/mixed; boundary=none\n\nno parts", ML.mail_text).strip() == "no parts"
    assert of(spark, "", ML.mail_text) == "" and of(spark, None, ML.mail_text) is None


@pytest.mark.parametrize("text,want", [("a,b;c", ","), ("a;b;c", ";"), ('"a;b;c",d', ","), ("\n\nx;y", ";"), ("", ","), ("﻿a;b", ";")])
def test_delimiters(spark, text, want):
    assert of(spark, text, FI.delimiter) == want


def test_csv_cells(spark):
    text = '﻿Product,Price\nRose,"1,50"\n\n"two\nlines","say ""hi"""\nlast,\n'
    df = spark.createDataFrame([("p", "CSV", text)], "path string, sheet string, text string")
    got = [r["cells"] for r in FI.sheet_cells(df).orderBy("row").collect()]
    assert [c for c in got if any(c)] == [["Product", "Price"], ["Rose", "1,50"], ["two\nlines", 'say "hi"'], ["last", None]]
    assert of(spark, 'a,"b', FI.unterminated_quote) is True and of(spark, 'a,"b"', FI.unterminated_quote) is False


def test_csv_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Product;FOB\nRose;0,45\n")
    got = CSV.read_csv(spark, f"file://{tmp_path}/a.csv").orderBy("row").collect()
    assert [r["cells"] for r in got] == [["Product", "FOB"], ["Rose", "0,45"]]
    (tmp_path / "b.csv").write_text('Product;"FOB\n')
    with pytest.raises(ValueError, match="b.csv: a quote"):
        CSV.read_csv(spark, f"file://{tmp_path}")
    (tmp_path / "b.csv").write_text('')
    (tmp_path / "c.csv").write_text('\n\nx,"y;z"\n')
    by = {}
    for r in CSV.read_csv(spark, f"file://{tmp_path}").orderBy("row").collect():
        by.setdefault(r["path"][-5:], []).append(r["cells"])
    assert by == {  # each file has its own separator
        "a.csv": [["Product", "FOB"], ["Rose", "0,45"]],
        "c.csv": [[None], [None], ["x", "y;z"]]
    }


@pytest.mark.parametrize("block", [7, 64, 1000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_blocks(spark, tmp_path, block, end):
    """One quoted file over many tasks equals the reader of whole texts; borders fall into quoted line ends, doubled quotes and cells."""
    cells = ["plain", "", '"a;b"', f'"two{end}lines"', '"say ""hi"""', f'"{end}{end}"', "x" * 30, '""', f'"""{end}"""', '5" pot']
    rows = [";".join(cells[zlib.crc32(f"{i}/{j}".encode()) % len(cells)] for j in range(1 + i % 4)) for i in range(150)]
    text = "\ufeffA;B;C" + end + end.join(rows)
    (tmp_path / "a.csv").write_bytes(text.encode())
    keys = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = CSV.read_csv(spark, f"file://{tmp_path}/a.csv")
        assert df.rdd.getNumPartitions() >= len(text) // block // 2
        got = sorted((r["row"], r["cells"]) for r in df.collect())
    finally:
        for k in keys:
            spark.conf.unset(k)
    whole = spark.createDataFrame([("p", "CSV", text)], "path string, sheet string, text string")
    assert [c for _, c in got] == [r["cells"] for r in FI.sheet_cells(whole, ";").orderBy("row").collect()]
    assert [r for r, _ in got] == list(range(len(got)))


def workbook(rows):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Product</t></si><si><r><t>Ro</t></r><r><t>se</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
        z.writestr(
            "xl/worksheets/_rels/sheet1.xml.rels",
            '<Relationships><Relationship Id="t1" Type="x/table" Target="../tables/table1.xml"/></Relationships>'
        )
        z.writestr("xl/tables/table1.xml", f'<table xmlns="{main}" name="T1" ref="A1:C4"/>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>FOB</t></is></c></row><row r="4"><c r="A4" t="s"><v>1</v></c><c r="B4"><f>1+1</f><v>2</v></c><c r="C4" t="e"><v>#N/A</v></c><c r="D4" t="b"><v>1</v></c><c r="E4"><f>x</f></c></row>'
    data = workbook(rows)
    assert list(X.workbook_rows(data)) == [
        ("S1", 0, ["Product", None, "FOB"]),
        ("S1", 1, []),
        ("S1", 2, []),
        ("S1", 3, ["Rose", "2", None, "true", None])
    ]
    (tmp_path / "a.xlsx").write_bytes(data)
    assert X.read_xlsx(spark, f"file://{tmp_path}").count() == 4
    assert [(r["name"], r["ref"]) for r in X.read_xlsx_tables(spark, f"file://{tmp_path}").collect()] == [("T1", "A1:C4")]


def grid(spark, rows, path="p"):
    return spark.createDataFrame([(path, "S", i, r) for i, r in enumerate(rows)], "path string, sheet string, row int, cells array<string>")


def test_sheets_with_known_words(spark):
    g = grid(
        spark,
        [
            ["Offer", None], ["", ""], ["Product", "Variety", "Largo", "Stems per box", "FOB USD", "QB"],
            ["Roses", " Freedom ", "60 cm", "40", "$ 0,45", "12"], ["", "x", "", "", "", ""],
            ["Foo bar", None, None, None, "?", None]
        ]
    )
    assert [r["header"] for r in TB.synonym_headers(g).collect()] == [2]
    a, b = TB.parse_sheet(g).orderBy("row").collect()
    assert (
        a["product_group"], a["variety"], a["length_cm"], a["stems_per_box"], a["price"], a["boxes"], a["confidence"],
        a["needs_review"]
    ) == ("Rose", "Freedom", 60.0, 40, "0.45", 12, "high", False)
    assert (b["product_group"], b["price"], b["confidence"], b["warnings"]) == ("Foo Bar", None, "low", ["PRICE_UNREADABLE"])


def test_regions(spark):
    g = grid(spark, [["title"], ["Naam", "Prijs", "x"], ["a", "1,5", "b"], [None], ["c", "2", "d"]])
    r = TB.regions(g).first()
    assert (r["header"], r["last"], r["source"]) == (1, 4, "scanned-header")
    assert TB.table_text(g, TB.regions(g)).first()["text"] == "Naam | Prijs | x\na | 1,5 | b\nc | 2 | d"
    named = spark.createDataFrame(
        [("p", "S", "T", "$A$3:C9"), ("p", "S", "U", "nonsense")],
        "path string, sheet string, name string, ref string"
    )
    r = TB.regions(g, named).first()
    assert (r["header"], r["last"], r["source"]) == (2, 4, "named-table")


def test_known_sheet(spark):
    head = [
        "Packs left", "Pack quantity", "Fust code", "Product description", "Stem length", "Stems per bunch",
        "Box weight", "FOB price USD"
    ]
    g = grid(
        spark,
        [
            ["list"], [], head, ["12", "40", "QB", "Rosa Freedom", "60", "20", "8,5", "0.45"],
            ["1", "", "", "", "", "", "", ""], ["3", "25", "HB", "Mystery", "50", None, "7", None]
        ]
    )
    rows = TB.known_rows(g, TB.regions(g))
    got = rows.orderBy("row_index").collect()
    assert [
        (r["row_index"], r["description"], r["quantity"], r["stems_per_box"], r["price"], r["weight"]) for r in got
    ] == [(1, "Rosa Freedom", 12, 40, "0.45", "8.5"), (2, "Mystery", 3, 25, None, "7")]
    assert TB.description_list(rows).first()["text"] == "#1 | Rosa Freedom\n#2 | Mystery"
    described = spark.createDataFrame(
        [("p", "S", "#1 | Rosa Freedom", 1, "Rose", "Freedom", None, None), ("p", "S", "#1 | again", 2, "Other", None, None, None)],
        "path string, sheet string, raw_text string, position int, product_group string, variety string, color string, grade string"
    )
    m = {r["row_index"]: r for r in TB.merge_descriptions(rows, described).collect()}
    assert (
        m[1]["product_group"],
        m[1]["variety"],
        m[1]["needs_review"],
        m[1]["warnings"]
    ) == ("Rose", "Freedom", False, ["STEMS_PER_BUNCH_GIVEN"])
    assert (m[2]["product_group"], m[2]["needs_review"], m[2]["warnings"]) == ("Mystery", True, ["DESCRIPTION_UNREAD", "PRICE_UNREADABLE"])


def test_offers_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("Hello all\n12QB x 40 Roses Freedom $0.45 | tinted 0.6\n")
    args = (spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    ST.run(*args).awaitTermination()
    (tmp_path / "in" / "2.txt").write_text("5HB 25 HYD blue $0.9\n")
    ST.run(*args).awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted((r["product_group"], r["price"]) for r in got) == [("Hydrangea", "0.9"), ("Rose", "0.45"), ("Rose", "0.6")]
