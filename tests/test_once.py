"""What is asked of a text several times is made once, by the plans."""

from pyspark.sql import functions as F

from offerloom.functions import text as T
from offerloom.operators import match as MA
from offerloom.operators import parse as P
from offerloom.operators import relational as R
from offerloom.operators import textindex as TX
from offerloom.plans.domain import table as surface_table
from offerloom.plans.surface import _grid


def written(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_article_parts_split_a_name_once(spark):
    df = spark.createDataFrame([("Rose Spray  Red Eye",), ("Rose",), (None,)], "v string").select(T.article_parts(F.col("v")).alias("p"))
    assert [r["p"] and tuple(r["p"]) for r in df.collect()] == [("Rose Spray", "Red Eye"), None, None]
    assert written(df).count("regexp_replace") == 1


def test_groups_and_prices_read_their_text_once(spark):
    df = spark.createDataFrame([(" HYD ", "$ 1.234,50"), ("blue moon", "1,5"), (None, None), ("", "x")], "g string, p string")
    out = df.select(T.product_group(F.col("g")).alias("g"), T.decimal_string(F.col("p")).alias("p"))
    want = [("Hydrangea", True, "1234.50"), ("Blue Moon", False, "1.5"), (None, False, None), ("", False, None)]
    assert [(r["g"]["name"], r["g"]["recognized"], r["p"]) for r in out.collect()] == want
    assert written(df.select(T.product_group(F.col("g")).alias("x"))).count("trim(") == 1
    assert written(df.select(T.decimal_string(F.col("p")).alias("x"))).count("[^0-9.,]") == 1


def test_pasted_lines_are_cut_once(spark):
    df = spark.createDataFrame([("A,b c,60,QB,25,1.5",), ("leverancier,b,c,d,5,6",), (None,)], "line string")
    out = P.assortment_paste(df)
    assert [r["supplier"] for r in out.collect()] == ["A"]
    assert plan(out).count("split(") == 2  # between tabs, between commas


def test_items_of_a_response_are_read_once_for_all_fields(spark):
    df = spark.createDataFrame([('{"lines":[{"rawText":"r","boxesAvailable":"many","fobPricePerStem":"1,50","length":null}, 7]}',)], "response string")
    out = P.structured_lines(df)
    assert [(r["raw_text"], r["price"], r["boxes"], r["recovered"]) for r in out.collect()][0] == ("r", "1.50", None, True)
    assert out.count() == 2 and "get_json_object" not in plan(out)


def test_an_index_holds_a_text_once_however_many_rows_share_it(spark):
    df = spark.createDataFrame([(i, "Red Eye", "red eye" if i % 2 else None) for i in range(200)], "id long, a string, b string")
    index = TX.build(df, "id", ("a", "b"))
    assert index.postings.count() == len("red eye") - 2
    assert index.ids("D EY").count() == 200 and index.ids("red", ("b",)).count() == 100


def test_a_line_has_its_outcome_by_one_aggregate_of_both_tiers(spark):
    lines = spark.createDataFrame([(1, 1, None, "Red", None)], "line_id long, farm_id long, product_name string, variety string, length_cm double")
    articles = spark.createDataFrame(
        [(5, 1, 5, "r", "Rose", "Garden Red", "50"), (6, 1, 6, "r", "Rose", "red", "60"), (7, 2, 7, "r", "Rose", "red", "60")],
        "article_id long, farm_id long, variant_id long, product_id string, product_name string, variety string, stem_length string"
    )
    out = MA.match_lines(lines, articles)
    assert [(r["match_status"], r["article_id"], r["n_options"]) for r in out.collect()] == [("DERIVED", 6, 1)]
    assert plan(out).count("Aggregate") == 3  # asked keys, groups of articles, outcomes


def test_a_grid_is_made_once(spark):
    table = lambda name: surface_table(spark, "/root/testdata/sf0.001", name)
    assert "Window" not in plan(_grid(table)) and _grid(table).count() > 0


def test_mapped_lines_are_joined_by_numbers_and_their_wording_read_where_mapped(spark):
    lines = [(1, 1, 7, " Röd  ros "), (2, 1, 7, "RED ROSE"), (3, 1, 8, "red rose"), (4, 2, 7, "red rose"), (5, 1, 7, None), (6, None, 7, "red rose"), (7, 1, None, "red rose"), (8, 1, 7, "other")]
    lines = spark.createDataFrame(lines, "line_id int, farm_id int, article_id int, raw_text string")
    known = [(1, "rod ros", 7), (1, "red rose", 7), (1, "blue rose", 8), (2, "red", 7), (1, None, 7), (None, "red rose", 7)]
    known = spark.createDataFrame(known, "farm_id int, normalized_source string, article_id int")
    df = R.mapped_flag(lines, known, T.source_key(F.col("raw_text")))
    assert df.columns == [*lines.columns, "has_mapping"]
    assert {r["line_id"]: r["has_mapping"] for r in df.collect()} == {i: i in (1, 2) for i in range(1, 9)}
    joins = [x for x in plan(df).splitlines() if "Join LeftOuter" in x]
    assert len(joins) == 1 and "raw_text" not in joins[0]
