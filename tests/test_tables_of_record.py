from decimal import Decimal as D

from pyspark.sql import functions as F

from offerloom.operators import enrich as E
from offerloom.operators import maintain as M
from offerloom.operators import quotes as Q
from offerloom.operators import relational as R
from offerloom.operators import reports as RP


def test_pages(spark):
    df = spark.range(120)
    page = lambda n, size: [r["id"] for r in R.page(df, ["id"], n, size).collect()]
    assert page(2, 50) == list(range(50, 100)) and page(3, 50) == list(range(100, 120))
    assert page(9, 50) == list(range(50)) and page(1, 7) == list(range(50)) and page(0, 100) == list(range(100))


def test_search_is_literal(spark):
    df = spark.createDataFrame([(1, "50%"), (2, "500"), (3, None)], "id int, v string")
    assert [r["id"] for r in R.search(df, q="0%", q_columns=("v",)).collect()] == [1]
    assert R.search(df, equal={"id": None}, like={"v": ""}, q="  ").count() == 3


def test_import(spark):
    old = spark.createDataFrame([("A",)], "name string")
    new = spark.createDataFrame([(1, " a "), (2, "B"), (3, "b"), (4, " ")], "n int, name string")
    assert {
        r["n"]: r["outcome"] for r in R.import_new(new, old, F.lower(F.trim("name")), ["n"]).collect()
    } == {1: "DUPLICATE", 2: "CREATED", 3: "DUPLICATE", 4: "INVALID"}


def test_rates_turned_round(spark):
    rows = [("EUR", "USD", "1.1"), ("USD", "EUR", "0.9"), ("GBP", "EUR", "0.8"), ("JPY", "EUR", "0"), ("USD", "GBP", "2")]
    df = spark.createDataFrame([(a, b, D(r)) for a, b, r in rows], "base string, quote string, rate decimal(12,6)")
    got = {(r["base"], r["quote"]): r["rate"] for r in M.canonical_rates(df).collect()}
    assert got == {("EUR", "USD"): D("1.1"), ("EUR", "GBP"): D("1.25"), ("JPY", "EUR"): D(0), ("USD", "GBP"): D(2)}


def test_default_destinations(spark):
    d = spark.createDataFrame(
        [(1, 1, True, 1), (1, 2, False, 3), (1, 3, False, 2), (2, 1, True, 1)],
        "customer_id int, destination_id int, is_default boolean, created_at int"
    )
    left = M.remove_destinations(d, spark.createDataFrame([(1, 1)], "customer_id int, destination_id int"))
    assert {(r["customer_id"], r["destination_id"]) for r in left.where("is_default").collect()} == {(1, 3), (2, 1)}
    chosen = M.set_default_destination(d, spark.createDataFrame([(1, 2), (2, 9)], "customer_id int, destination_id int"))
    assert {(r["customer_id"], r["destination_id"]) for r in chosen.where("is_default").collect()} == {(1, 2), (2, 1)}


def test_offer_deletion(spark):
    offers = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "offer_id int, upload_id int")
    lines = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "offer_id int, line_id string")
    quoted = spark.createDataFrame([("b",)], "line_id string")
    uploads = spark.createDataFrame([(10,), (11,)], "upload_id int")
    gone, orphans = M.delete_offers(offers.select("offer_id"), offers, lines, quoted, uploads)
    assert sorted(r["offer_id"] for r in gone.collect()) == [1, 3] and [r["upload_id"] for r in orphans.collect()] == [11]


def test_unique_and_costs(spark):
    table = spark.createDataFrame([("Quito", "Ecuador")], "city string, country string")
    req = spark.createDataFrame(
        [(1, " quito", "ECUADOR"), (2, "Cali", "Colombia"), (3, "CALI", "colombia "), (4, "", "x")],
        "n int, city string, country string"
    )
    assert {
        r["n"]: r["outcome"] for r in M.add_unique(req, table, ["city", "country"], "n").collect()
    } == {1: "EXISTS", 2: "CREATE", 3: "EXISTS", 4: "INVALID"}
    costs = spark.createDataFrame([(1, 7), (2, None)], "route_id int, cost_type_id int")
    types = spark.createDataFrame([(7, "HANDLING"), (8, "OTHER")], "cost_type_id int, category string")
    adds = spark.createDataFrame([(1, 1, 7), (2, 1, 8), (3, 1, 8), (4, 2, 9), (5, 2, 7)], "request_id int, route_id int, cost_type_id int")
    assert {r["request_id"]: (r["outcome"], r["category"]) for r in M.add_costs(adds, costs, types).collect()} == {
        1: ("EXISTS", "HANDLING"), 2: ("CREATE", "OTHER"), 3: ("EXISTS", "OTHER"), 4: ("NO_TYPE", None),
        5: ("CREATE", "HANDLING")
    }


def test_lengths_out_of_grades(spark):
    df = spark.createDataFrame([(1, "60 cm", None), (2, "premium", None), (3, "60cm", "50")], "id int, grade string, stem_length string")
    assert {
        r["id"]: (r["grade"], r["stem_length"]) for r in M.length_from_grade(df).collect()
    } == {1: (None, "60"), 2: ("premium", None), 3: ("60cm", "50")}


def test_form_codes(spark):
    rows = [("1", "USD", "PER_KG"), ("0", "USD", "PER_KG"), ("x", None, None), ("2", "", "PER_KG"), ("2", "EUR", None)]
    df = spark.createDataFrame(rows, "a string, c string, u string")
    assert [
        r[0] for r in df.select(E.freight_input_code(F.col("a"), F.col("c"), F.col("u"))).collect()
    ] == [None, "BAD_AMOUNT", "BAD_AMOUNT", "NO_CURRENCY", "NO_UNIT"]
    assert df.select(E.cost_input_code(F.lit(None).cast("string"), F.col("a"), F.col("c"), F.col("u"))).first()[0] == "NO_TYPE"


def test_deep_pages(spark, monkeypatch):
    """Pages found by ranges equal those of the whole order, with nulls, heavy values and falling keys; only a part of the rows
    is sorted.
    """
    monkeypatch.setattr(R, "SHALLOW", 100)
    rows = [(i, None if i % 11 == 0 else (i * 7919) % 300 if i % 3 else 5, f"n{(i * 31) % 1000}") for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, v int, name string").repartition(4)
    first = lambda x: (x is not None, x or 0)
    for order, key in (
        (["v", "id"], lambda r: (first(r[1]), r[0])), (["-v", "id"], lambda r: (r[1] is None, -(r[1] or 0), r[0])),
        (["name", "-id"], lambda r: (r[2], -r[0]))
    ):
        want = [r[0] for r in sorted(rows, key=key)]
        for number in (5, 37, 90, 100):
            assert [r["id"] for r in R.page(df, order, number, 50).collect()] == want[(number - 1) * 50 : number * 50]
    part, ahead = R._one_range(df, ["name", "id"], 2500, 50, 5000)
    assert part.count() < 500 and ahead <= 2500 < ahead + part.count()


def test_quote_numbers_go_on(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    old = spark.createDataFrame([(1,)], "quote_id int").withColumn("created_at", t("2024-05-01 08:00:00"))
    new = spark.createDataFrame([(5,), (4,)], "quote_id int").withColumn("created_at", t("2024-05-01 09:00:00"))
    assert {r["quote_id"]: r["quote_number"] for r in Q.numbered(new, old).collect()} == {4: "Q-20240501-0002", 5: "Q-20240501-0003"}


def test_offer_texts(spark):
    row = {
        "quote_id": 1, "position": 2, "v_product": "Rose", "product_group": None, "raw_text": "r", "v_color": "Red",
        "v_variety": "Freedom", "v_grade": None, "v_stem_length": "60", "treatment": "tinted", "box_type": "QB",
        "stems_per_box": 40, "calculated_price": D("1.155"), "manual_price": None, "quote_number": "Q-1",
        "currency": "USD", "incoterm": "CFR", "origin_country": "Ecuador", "destination_city": "Amsterdam",
        "valid_until": None, "contact": "Ann"
    }
    other = row | {
        "position": 1, "v_product": None, "v_color": None, "v_variety": None, "v_stem_length": None,
        "product_group": "Hydrangea", "treatment": "normal", "manual_price": D("2"), "box_type": None
    }
    schema = "quote_id int, position int, v_product string, product_group string, raw_text string, v_color string, v_variety string, v_grade string, v_stem_length string, treatment string, box_type string, stems_per_box int, calculated_price decimal(12,6), manual_price decimal(12,6), quote_number string, currency string, incoterm string, origin_country string, destination_city string, valid_until date, contact string"
    df = spark.createDataFrame([tuple(row.values()), tuple((row | other)[k] for k in row)], schema)
    text = RP.offer_text(df).first()["text"]
    assert text == "*Fresh Offer - Q-1*\nOrigin: Ecuador\nDelivery: C&F Amsterdam\nCurrency: USD\n\n*Hydrangea*\n• Hydrangea - 40 stems/box - $2.00 per stem\n\n*Rose*\n• Red Freedom 60 (tinted) - 40 stems/QB - $1.16 per stem\n\nAvailability subject to confirmation.\nPrices valid until further notice."
    mail = RP.offer_text(df, style="mail").first()["text"]
    assert mail.startswith(
        "Subject: Flower offer Q-1 - C&F Amsterdam\n\nDear Ann,"
    ) and "  - Red Freedom 60 (tinted) - 40 stems/QB - $1.16 per stem" in mail
