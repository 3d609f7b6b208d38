from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerloom.functions import arrays as A
from offerloom.operators import maintain as M
from offerloom.operators import parse as P
from offerloom.sources import sinks as SK
from offerloom.sources import xlsx as X


def test_workbooks_keep_odd_cells(spark):
    cells = ['a & <b> "c"', None, "", " lead\x00ing", "1.50", "x1"]
    rows = [("q", "S/1", 0, cells), ("q", "S/1", 3, ["2", "3.25"]), ("r", "T", 1, [None])]
    df = spark.createDataFrame(rows, "path string, sheet string, row int, cells array<string>")
    got = {
        (r["path"], r["sheet"], r["row"]): r["cells"] for r in X.workbook_cells(
            X.workbooks(df.repartition(3), numbers=[0, 4], prices=[1], bold=[0])
        ).collect()
    }
    assert got[("q", "S 1", 0)] == ['a & <b> "c"', None, None, " lead ing", "1.50", "x1"]
    assert got[("q", "S 1", 1)] == [] and got[("q", "S 1", 3)] == ["2", "3.25"] and got[("r", "T", 1)] == []
    assert X.workbooks(df.limit(0)).count() == 0


def test_columns_have_letters():
    assert [X._letters(i) for i in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_clearings_and_inspections_are_summed_once(spark):
    rows = [(1, "CLEARING", "1.0"), (1, "CLEARING", "2.0"), (1, "INSPECTION", "0.5"), (2, "INSPECTION", "0.25"), (3, "HANDLING", "4")]
    costs = spark.createDataFrame(
        rows,
        "route_id int, category string, amount string"
    ).withColumn("amount", F.col("amount").cast("decimal(10,4)"))
    got = {(r["route_id"], r["category"]): float(r["amount"]) for r in M.consolidate_clearing(costs).collect()}
    assert got == {(1, "CLEARING_INSPECTION"): 3.5, (2, "CLEARING_INSPECTION"): 0.25, (3, "HANDLING"): 4.0}


def test_bulk_edits(spark):
    lit = {k: F.lit(v) for k, v in {"weight": " 2.5 ", "stems": "12x", "box_type": " ", "length": "", "notes": " n "}.items()}
    on = lambda *fields: {f: F.lit(True) for f in fields}
    one = spark.range(1)
    error = lambda *fields, **new: one.select(
        A.edit_error(on(*fields), lit | {k: F.lit(v) for k, v in new.items()})
    ).first()[0]
    assert error() == "NOTHING_ENABLED" and error("weight", "stems") is None and error("box_type") == "NO_BOX_TYPE"
    assert {error("weight", weight=w) for w in ("0", "-1", "x", "", None, "Infinity", "NaN")} == {"BAD_WEIGHT"}
    assert {error("stems", stems=s) for s in ("0", "-3", "x", "", None)} == {"BAD_STEMS"} and error("stems", stems=" +4") is None
    shown = one.select(A.edit_summary(on("notes", "length"), lit)).first()[0]
    assert [(x["label"], x["value"]) for x in shown] == [("Lengte", "(leeg)"), ("Aantekeningen", "n")]


def test_batches_that_are_not_listed_stay_unseen(spark, tmp_path):
    folder = f"file://{tmp_path}"
    first = SK.write_together(folder, a=spark.range(3), b=spark.range(1))
    SK.write_together(folder, a=spark.range(3, 5), b=spark.range(0))
    spark.range(9, 12).write.parquet(f"{folder}/a/{'f' * 32}")
    got = SK.read_together(spark, folder, "a").collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2, 3, 4] and {r["batch"] for r in got if r["id"] < 3} == {first}
    assert SK.read_together(spark, folder, "b").count() == 1


def test_a_batch_with_a_key_is_written_once(spark, tmp_path):
    """Two writers race with one key, and a third comes later: one batch, no folders left of the others, and only listed files are read."""
    folder = f"file://{tmp_path}"
    with ThreadPoolExecutor(2) as pool:
        made = list(pool.map(lambda n: SK.write_together(folder, key="day 1", a=spark.range(n * 100, n * 100 + 5)), range(2)))
    assert made[0] == made[1] == SK.write_together(folder, key="day 1", a=spark.range(900, 905))
    SK.write_together(folder, key="day 2", a=spark.range(50, 52))
    got = SK.read_together(spark, folder, "a")
    assert got.count() == 7 and got.where("id < 900").select("batch").distinct().count() == 2
    assert len(list((tmp_path / "a").iterdir())) == 2 and len(SK.batches(spark, folder)) == 2
    assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) == 2
    with pytest.raises(ValueError, match="no batch"):
        SK.read_together(spark, folder, "missing")


def test_one_of_many_puts_a_file(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: SK.put_if_absent(spark, f"{tmp_path}/m/x.json", str(n) * 1000), range(8)))
    assert sum(won) == 1 and (tmp_path / "m" / "x.json").read_text() == str(won.index(True)) * 1000 and len(
        list((tmp_path / "m").iterdir())
    ) == 1


def test_a_grade_goes_where_it_stands_alone(spark):
    df = spark.createDataFrame([("5QB 40 Rose selected SELECT red select $1",), ("5QB 40 Rose xselect $1",)], "text string")
    a, b = P.parse_offer_line(df, "text").collect()
    assert (a["grade"], a["variety"]) == ("select", "selected red select") and (b["grade"], b["variety"]) == (None, "xselect")


def test_small_workbooks_share_batches(spark):
    # before, each workbook was a data frame of its own on both ways: one Arrow batch a workbook
    rows = spark.range(3000).select(
        F.col("id").cast("string").alias("path"),
        F.lit("S").alias("sheet"),
        F.lit(1).alias("row"),
        F.array(F.lit(" a "), F.lit(None), F.lit("<b>"), F.col("id").cast("string")).alias("cells")
    )
    books = X.workbooks(rows, numbers=[3])
    batches = books.mapInArrow(lambda them: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in them), "n long").toArrow()["n"].to_pylist()
    assert sum(batches) == 3000 and len(batches) <= 3000 // X.BATCH_BOOKS + 2 * books.rdd.getNumPartitions()
    got = {(r["path"], r["row"], *r["cells"]) for r in X.workbook_cells(books).where("row = 1").collect()}
    assert got == {(str(i), 1, " a ", None, "<b>", str(i)) for i in range(3000)}


def test_a_large_sheet_is_pulled_as_a_small_one(monkeypatch):
    data = X.workbook("S", ((i, [f"x {i}", str(i), " y "]) for i in range(5000)), frozenset([1]), frozenset(), frozenset())
    whole = list(X.workbook_rows(data))
    monkeypatch.setattr(X, "WHOLE_BYTES", 0)
    assert list(X.workbook_rows(data)) == whole and whole[4999] == ("S", 4999, ["x 4999", "4999", " y "])
