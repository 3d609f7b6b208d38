import random

import numpy as np

from pyspark.sql import functions as F

from offerloom.operators import parse as P


def parsed(spark, text):
    return [r.asDict() for r in P.parse_offer_line(spark.createDataFrame([(text,)], "line string")).orderBy("variant_no").collect()]


def test_price_variants(spark):
    a, b = parsed(spark, "12QB x 40 HYD premium blue $0.45 | tinted $0.60")
    assert (
        a["product_group"],
        a["variety"],
        a["grade"],
        a["price"],
        a["boxes"],
        a["stems_per_box"],
        a["box_type"]
    ) == ("Hydrangea", "blue", "premium", "0.45", 12, 40, "QB")
    assert (b["treatment"], b["price"], b["product_group"], b["confidence"]) == ("tinted", "0.60", "Hydrangea", "high")


def test_unreadable_variant_is_a_warning(spark):
    rows = parsed(spark, "5HB 25 roses Freedom €1,10 | mystery")
    assert len(rows) == 1 and rows[0]["warnings"] == ["VARIANT_UNREADABLE"] and rows[0]["currency"] == "EUR" and rows[0]["price"] == "1.10"


def test_missing_parts(spark):
    (r,) = parsed(spark, "Tulips mix")
    assert r["confidence"] == "low" and r["needs_review"] and r["warnings"] == [
        "PRICE_MISSING",
        "BOX_MISSING"
    ] and r["product_group"] == "Tulips"
    (r,) = parsed(spark, " | ")
    assert r["warnings"] == ["LINE_UNREADABLE"] and r["confidence"] == "low"
    assert parsed(spark, None) == []


def test_lead_time(spark):
    (r,) = parsed(spark, "3QBx20 ruscus (Additional time required 72 HR) $0.2")
    assert r["lead_time_hours"] == 72 and r["product_group"] == "Ruscus" and r["variety"] is None


def test_line_classes(spark):
    lines = ["40 cm: $0.16", "Roses", "Freedom 60cm", "40-60", "x", "Pink 0.38", "2hb Mondial", "50cm 0,18 usd"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(P.line_class(F.col("l"))).collect()]
    assert got == ["C", "A", "B", "A", "A", "B", "B", "C"]


def test_range_expansion(spark):
    doc = "40 cm 0.16\n50cm: 0,18\n60 cm $0.22\n40cm 0.19\n70 cm 0.28"
    tiers = P.shared_price_table(spark.createDataFrame([("d", doc)], "doc string, text string"), "doc")
    assert {r["length"]: r["price"] for r in tiers.collect()} == {40: "0.19", 50: "0.18", 60: "0.22", 70: "0.28"}
    rows = [
        ("a", "40–60 cm", None, ["no price for 40–60 cm", "x"]), ("b", "45-50", None, []), ("c", "80-90", "9", []),
        ("d", "50", None, []), ("e", "55", None, []), ("f", "50", "7", []), ("g", None, "1", [])
    ]
    lines = spark.createDataFrame(
        [("d", *r) for r in rows],
        "doc string, line string, length_raw string, price string, warnings array<string>"
    )
    got = {}
    for r in P.expand_length_ranges(lines, tiers, "doc", "line").orderBy("line", "child_no").collect():
        got.setdefault(r["line"], []).append((r["length_cm"], r["price"], r["warnings"]))
    assert got["a"] == [(40.0, "0.19", ["x"]), (50.0, "0.18", ["x"]), (60.0, "0.22", ["x"])]
    assert got["b"] == [(50.0, "0.18", ["END_WITHOUT_TIER:45"])]
    assert got["c"] == [(None, None, ["RANGE_OUTSIDE_TABLE"])]
    assert got["d"] == [(50.0, "0.18", [])] and got["e"] == [
        (55.0, None, ["LENGTH_NOT_IN_TABLE"])
    ] and got["f"] == [(50.0, "7", [])] and got["g"] == [(None, "1", [])]


def test_no_table_no_change(spark):
    lines = spark.createDataFrame(
        [("d", "a", "40-60", "1", ["w"])],
        "doc string, line string, length_raw string, price string, warnings array<string>"
    )
    r = P.expand_length_ranges(lines, spark.createDataFrame([], "doc string, length int, price string"), "doc", "line").collect()
    assert [(x["length_cm"], x["price"], x["warnings"]) for x in r] == [(None, "1", ["w"])]


def chunks_by_fold(kinds_and_lines):
    out, rows, size, cur = [], 0, 0, []
    for kind, raw in kinds_and_lines:
        cur.append((kind, raw))
        rows, size = rows + (kind == "B"), size + len(raw.encode()) + 1
        if rows >= P.CHUNK_ROWS or size >= P.CHUNK_BYTES:
            out.append(cur)
            cur, rows, size = [], 0, 0
    if cur and any(k == "B" for k, _ in cur):
        out.append(cur)
    elif cur and out:
        out[-1] += cur
    return out


def test_chunks(spark):
    random.seed(3)
    docs = []
    for d in range(6):
        lines = ["Offer of today", "Prices below"]
        for i in range(random.choice([5, 40, 120])):
            lines.append(
                random.choice(
                    [
                        f"Freedom {40 + i % 5 * 10}cm 0.{i % 90 + 10}", "ROSES", "some note with words only here",
                        f"{i % 9 * 10 + 10} cm 0.2", "y" * random.choice([3, 4000]) + " 5.20"
                    ]
                )
            )
        lines += [["closing words"] * 3, ["z" * 5000] * 7, []][d % 3]
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc int, text string")
    kinds = {(r["doc"], r["line_no"]): r["kind"] for r in P.numbered_lines(df).withColumn("kind", P.line_class(F.col("line"))).collect()}
    got = {}
    for r in P.chunk_offers(df, "doc").collect():
        got.setdefault(r["doc"], {})[r["chunk"]] = r
    for d, text in docs:
        lines = [(kinds[d, i], x) for i, x in enumerate(text.split("\n"))]
        n_b = sum(k == "B" for k, _ in lines)
        if n_b <= 30 and len(text.encode()) <= 12000:
            assert len(got[d]) == 1 and got[d][0]["body"] == text
            continue
        rest = [x for x in lines if x[0] != "C"]
        first = next(i for i, x in enumerate(rest) if x[0] == "B")
        want = chunks_by_fold(rest[first:])
        assert len(got[d]) == len(want) and {r["total"] for r in got[d].values()} == {len(want)}
        for i, chunk in enumerate(want):
            assert got[d][i]["body"] == "\n".join(x for _, x in chunk) and got[d][i]["product_rows"] == sum(k == "B" for k, _ in chunk)
            assert got[d][i]["header"] == "\n".join(x for _, x in rest[:first]) and got[d][i]["price_lines"] == "\n".join(
                x for k, x in lines if k == "C"
            )


def test_chunks_of_a_very_long_text(spark):
    text = "\n".join(f"Freedom {40 + i % 5 * 10}cm 0.{i % 90 + 10}" for i in range(100_000))
    got = P.chunk_offers(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc int, text string"), "doc").groupBy("doc").agg(
        F.count("*").alias("n"),
        F.sum("product_rows").alias("rows"),
        F.max("total").alias("total")
    ).collect()
    assert sorted(map(tuple, got)) == [(1, 4546, 100_000, 4546), (3, 1, 0, 1)]


def test_pastes(spark):
    rows = [
        ("Leverancier\tInkoop",), ("Farm A\tRosa Spray Pink\t60\t\t40\t8.5",), ("Farm B,Rosa Red,,HB,x,8",),
        ("Farm C,Rosa Red,,HB,50,8",), ("too,few",)
    ]
    got = P.assortment_paste(spark.createDataFrame(rows, "line string")).collect()
    assert [
        (r["supplier"], r["stem_length"], r["box_type"], r["stems_per_box"]) for r in got
    ] == [("Farm A", "60", "QB", 40), ("Farm C", None, "HB", 50)]
    farms = P.farm_paste(
        spark.createDataFrame([("Land\tNaam",), ("Kenya\tSun Roses",), ("Only Name",), ("\tNo country",), ("Peru,",)], "line string"),
        "Ecuador"
    ).collect()
    assert [(r["country"], r["name"]) for r in farms] == [("Kenya", "Sun Roses"), ("Ecuador", "Only Name"), ("Ecuador", "No country")]
    bulk = P.bulk_offer_paste(
        spark.createDataFrame([("Rose\tFreedom\tred\tsel\t10\t40\t0,45",), ("Rose\t\t\t\t\t\t0.4",), ("",)], "line string")
    ).collect()
    assert [r["valid"] for r in bulk] == [True, False, False] and bulk[0]["price"] == "0.45"


def test_chunk_bounds_are_those_of_a_fold():
    rng = np.random.default_rng(5)
    for n in (1, 21, 22, 23, 44, 300):
        products, size, heading = rng.random(n) < 0.4, rng.choice([30, 900, 13_000], n, p=[0.6, 0.3, 0.1]), rng.random(n) < 0.1
        want, rows, held = [[0]], 0, 0
        for i in range(n):
            if rows >= P.CHUNK_ROWS or held >= P.CHUNK_BYTES:
                want, rows, held = [*want, [i]], 0, 0
            rows, held = rows + int(products[i]), held + int(size[i])
        if rows == 0 and held < P.CHUNK_BYTES and len(want) > 1:
            want.pop()
        found = P.chunk_bounds(products, size, heading)
        assert [x["begin"] for x in found] == [x[0] for x in want]
        assert [x["end"] for x in found] == [x["begin"] for x in found[1:]] + [n]
        assert [x["rows"] for x in found] == [int(products[x["begin"] : x["end"]].sum()) for x in found]
        assert [x["title"] for x in found] == [max((i for i in range(x["begin"] + 1) if heading[i]), default=-1) for x in found]


def test_chunks_are_cut_in_one_pass(spark):
    text = "\n".join(["Roses", *(f"Rose {i} 50 cm 0.{i}" for i in range(100))])
    docs = spark.createDataFrame([(1, text), (2, "one line"), (3, None)], "doc int, text string")
    spark.sparkContext.setJobGroup("chunks", "chunks")
    cut = P.chunk_offers(docs, "doc")
    # before, rounds of joins over the lines ran and were written while the plan was made
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("chunks")) == []
    got = [(r["doc"], r["chunk"], r["total"], r["product_rows"]) for r in cut.orderBy("doc", "chunk").collect()]
    assert got == [*((1, i, 5, 22 if i < 4 else 12) for i in range(5)), (2, 0, 1, 0)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
