from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from offerloom.operators import pricing as P
from offerloom.operators import quotes as Q

SCHEMA = (
    "id string, incoterm string, fob decimal(10,6), source_currency string, target_currency string, stems_per_box int, margin_pct decimal(6,3), weight_kg decimal(10,3), freight_rate decimal(10,4), freight_unit string, "
    "costs array<struct<name:string,category:string,amount:decimal(10,4),unit:string>>, fx_base string, fx_quote string, fx_rate decimal(12,6), manual_price decimal(12,6)"
)


def line(**over):
    base = {
        "id": "x", "incoterm": "FOB", "fob": D(1), "source_currency": "USD", "target_currency": "USD",
        "stems_per_box": 40, "margin_pct": D(15), "weight_kg": None, "freight_rate": None, "freight_unit": None,
        "costs": None, "fx_base": None, "fx_quote": None, "fx_rate": None, "manual_price": None
    }
    return tuple((base | over).values())


def priced(spark, **over):
    return P.priced(spark.createDataFrame([line(**over)], SCHEMA)).first()


def test_fob(spark):
    assert priced(spark)["final_price"] == D("1.15")


def test_half_cent_rounds_up(spark):
    r = priced(spark, incoterm="CFR", fob=D("0.45"), weight_kg=D(8), freight_rate=D(3), margin_pct=D(10))
    assert (r["freight"], r["calculated"], r["final_price"]) == (D("0.6"), D("1.155"), D("1.16"))


def test_ddp_with_exchange(spark):
    costs = [("Clearing", "CLEARING", D("0.03"), "PER_STEM"), ("Handling", "HANDLING", D("2.00"), "PER_BOX")]
    r = priced(
        spark, incoterm="DDP", fob=D("0.45"), weight_kg=D("6.5"), freight_rate=D("3.1"), costs=costs,
        target_currency="EUR", fx_base="USD", fx_quote="EUR", fx_rate=D("0.92"), margin_pct=D(20)
    )
    assert (r["cost_source"], r["cost_target"], r["calculated"], r["final_price"]) == (D("1.03375"), D("0.95105"), D("1.14126"), D("1.14"))


def test_manual_price_wins_and_the_calculated_one_stays(spark):
    r = priced(spark, manual_price=D("1.25"))
    assert (r["calculated_rounded"], r["final_price"], r["is_manual"]) == (D("1.15"), D("1.25"), True)


def test_rate_in_the_other_direction(spark):
    r = priced(spark, target_currency="EUR", fx_base="EUR", fx_quote="USD", fx_rate=D("1.25"), margin_pct=D(0))
    assert r["final_price"] == D("0.80")


@pytest.mark.parametrize(
    "over,want",
    [
        ({"fob": None}, ["MISSING_FOB_PRICE"]),
        ({"fob": D(0)}, ["MISSING_FOB_PRICE"]),
        ({"fob": D(-1)}, ["NEGATIVE_PRICE"]),
        ({"stems_per_box": 0}, ["ZERO_STEMS_PER_BOX"]),
        ({"incoterm": "CFR"}, ["MISSING_WEIGHT", "MISSING_FREIGHT_RATE"]),
        ({"incoterm": "CFR", "freight_unit": "PER_BOX", "freight_rate": D(2)}, []),
        (
            {"incoterm": "DDP", "weight_kg": D(1), "freight_rate": D(1), "costs": []},
            ["MISSING_DDP_CLEARING_INSPECTION", "MISSING_DDP_HANDLING"]
        ),
        ({"target_currency": None}, ["MISSING_CUSTOMER_CURRENCY", "MISSING_EXCHANGE_RATE"]),
        ({"margin_pct": None}, ["MISSING_MARGIN"]),
        (
            {
                "incoterm": "DDP", "freight_unit": "PER_STEM", "freight_rate": D(1),
                "costs": [("a", "CLEARING", D(1), "PER_KG"), ("b", "HANDLING", D(1), "FLAT")]
            },
            ["MISSING_WEIGHT"]
        ),
    ],
)
def test_blockers(spark, over, want):
    r = priced(spark, **over)
    assert r["issues"] == want
    assert (r["final_price"] is None) == bool(want)


def test_route_issues_collapse_without_an_origin(spark):
    df = spark.createDataFrame([line(incoterm="CFR", margin_pct=None)], SCHEMA).withColumn("origin_missing", F.lit(True))
    assert P.priced(df).first()["issues"] == ["MISSING_WEIGHT", "MISSING_MARGIN", "ORIGIN_NOT_CONFIGURED"]


def test_incoterm_that_the_route_lacks(spark):
    df = spark.createDataFrame([line(incoterm="CFR")], SCHEMA).withColumn("route_supports", F.lit(False))
    assert P.priced(df).first()["issues"] == ["INCOTERM_NOT_SUPPORTED_ON_ROUTE"]


@pytest.mark.parametrize(
    "q,unit,boxes,stems,want",
    [
        (550, "STEMS", None, 100, "STEMS_NOT_DIVISIBLE"),
        (500, "STEMS", None, 100, 5),
        (D("1.5"), "BOXES", None, 100, "FRACTIONAL_BOXES"),
        (3, "BOXES", None, None, "MISSING_STEMS_PER_BOX"),
        (3, "BUNCHES", 4, 100, "BUNCHES_NOT_SUPPORTED"),
        (None, None, 4, 100, 4),
        (None, "BOXES", 4, 100, 4),
        (None, None, None, 100, "MISSING_QUANTITY"),
        (0, "BOXES", 9, 100, "MISSING_QUANTITY"),
    ],
)
def test_quantities_are_never_rounded(spark, q, unit, boxes, stems, want):
    df = spark.createDataFrame([(None if q is None else D(q), unit, boxes, stems)], "q decimal(12,3), u string, b int, s int")
    r = df.select(Q.resolve_quantity(F.col("q"), F.col("u"), F.col("b"), F.col("s")).alias("r")).first()["r"]
    assert (r["boxes"] if r["ok"] else r["code"]) == want


def test_totals(spark):
    rows = [(1, 40, 10, D("0.50"), None), (1, 200, 5, D("0.99"), D("0.12")), (1, 300, 2, D("0.08"), None)]
    df = spark.createDataFrame(
        rows,
        "quote_id int, stems_per_box int, quantity_boxes int, calculated_price decimal(12,6), manual_price decimal(12,6)"
    )
    assert tuple(Q.totals(df).first()) == (1, 17, 2000, D("368"))


def test_override_and_clear(spark):
    lines = spark.createDataFrame([(1, "a", D("1")), (1, "b", None)], "quote_id int, line_id string, manual_price decimal(12,6)")
    o = spark.createDataFrame([(1, "a", None), (1, "b", D("2"))], "quote_id int, line_id string, price decimal(12,6)")
    assert {r["line_id"]: r["manual_price"] for r in Q.override_price(lines, o).collect()} == {"a": None, "b": D("2")}


def test_rates_at_each_time(spark):
    rates = spark.createDataFrame(
        [("EUR", "USD", D("1.1"), "2024-01-01", None), ("EUR", "USD", D("1.2"), "2024-02-01", "2024-02-10")],
        "base string, quote string, rate decimal(12,6), f string, t string"
    ).select("base",
    "quote",
    "rate",
    F.col("f").cast("timestamp").alias("effective_from"),
    F.col("t").cast("timestamp").alias("effective_to"))
    events = spark.createDataFrame(
        [(1, "2024-01-15"), (2, "2024-02-05"), (3, "2024-03-01"), (4, "2023-01-01")],
        "id int, at string"
    ).withColumn("currency", F.lit("USD"))
    assert {  # 3: the older rate is still valid
        r["id"]: r["fx_rate"] for r in P.rates_at_each(events, rates).collect()
    } == {1: D("1.1"), 2: D("1.2"), 3: D("1.1"), 4: None}
