import pytest
from pyspark.sql import functions as F

from offerloom.functions import arrays as A
from offerloom.functions import numbers as N
from offerloom.functions import text as T


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("12,34", "12.34"), ("1.234,5", "1234.5"), ("1,234.5", "1234.5"), ("-3.5", "3.5"), ("1,234", "1.234"),
        ("1.234.567", None), ("abc", None), ("", None), (None, None), ("$ 0.45", "0.45")
    ]
)
def test_decimal_string(spark, raw, want):
    assert one(spark, raw, T.decimal_string) == want


@pytest.mark.parametrize("raw,want", [("60 cm", 60.0), ("7,5cm", 7.5), ("x", None), (None, None)])
def test_length(spark, raw, want):
    assert one(spark, raw, T.length_cm) == want


@pytest.mark.parametrize("raw,want", [("12QB x 40", (12, 40)), ("3hb×25 rest", (3, 25)), ("5 FB 100", (5, 100)), ("QB40", None)])
def test_box_pattern(spark, raw, want):
    got = one(spark, raw, T.box_pattern)
    assert (got and (got["boxes"], got["stems"])) == want


def test_box_type_needs_word_bounds(spark):
    assert one(spark, "30HBx40", T.box_type) == "QB"
    assert one(spark, "30 hb x 40", T.box_type) == "HB"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Crème Brûlée", "creme brulee"), ("ﬁnest  ROSE-Pink!", "finest rose pink"), ("ÅNGSTRÖM", "angstrom"),
        ("½ x", "1 2 x"), ("", ""), (None, None), ("ＡＢＣ", "abc"), ("a b﻿", "a b")
    ],
)
def test_match_key(spark, raw, want):
    assert one(spark, raw, T.match_key) == want


def test_source_key_keeps_punctuation(spark):
    assert one(spark, " Rosé\t40-60 cm!\r\n", T.source_key) == "rose 40-60 cm!"


def test_similarity(spark):
    df = spark.createDataFrame([("Freedom", "freedom!"), ("abc", "abd"), ("", "")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(T.similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.6667, 1.0]


def test_product_group(spark):
    assert tuple(one(spark, " HYD ", T.product_group)) == ("Hydrangea", True)
    assert tuple(one(spark, "bIG-one $x", T.product_group)) == ("Big-one $X", False)


@pytest.mark.parametrize("raw,want", [("Roses", "Rosa Ec"), (" ", None), ("Rose Spray", "Rose Spray"), (None, None)])
def test_rose_label(spark, raw, want):
    assert one(spark, raw, T.rose_label) == want


@pytest.mark.parametrize("raw,want", [("60", 60.0), ("40-60", None), ("40 – 60", None), ("", None)])
def test_exact_length(spark, raw, want):
    assert one(spark, raw, T.exact_length_cm) == want


def test_lengths_and_names(spark):
    assert tuple(one(spark, "60 CM", T.assortment_length)) == (True, "60")
    assert tuple(one(spark, "40-60", T.assortment_length)) == (False, None)
    assert one(spark, "Freedom 60cm", T.trailing_length) == "60"
    assert one(spark, "garden spirit", T.without_garden) == "spirit"
    assert one(spark, "Flores Ñusta S.A.S. Ltda", T.farm_key) == "flores nusta"
    assert one(spark, " hb", T.import_box_type) == "QB"
    assert one(spark, None, T.import_box_type) == "QB"
    assert one(spark, "(handmatig ingevoerd)", T.valid_source) is False
    assert tuple(one(spark, "Rosa Spray Mix Pink", T.article_parts)) == ("Rosa Spray", "Mix Pink")
    assert one(spark, "Rosa", T.article_parts) is None
    assert one(spark, 125.7, T.elapsed, "double") == "02:05"
    assert one(spark, 1234567.891, T.money_nl, "double") == "1.234.567,89"


def test_messages(spark):
    df = spark.createDataFrame([([" a", "b", " "], ["a", "c"])], "a array<string>, b array<string>")
    assert df.select(A.merge_messages(F.col("a"), F.col("b"))).first()[0] == ["a", "b", "c"]
    assert df.select(A.clean_messages(F.array(F.lit(" ")))).first()[0] is None
    warnings = F.array(F.lit("price is missing"), F.lit("hello"), F.lit("unit and price"))
    assert df.select(A.reconcile(warnings, {"UNIT": F.lit(False)})).first()[0] == ["hello", "unit and price"]
    assert df.select(A.snapshot_warnings(A.snapshot(warnings=F.col("a")))).first()[0] == [" a", "b", " "]
    assert df.select(A.snapshot_warnings(F.lit("nonsense"))).first()[0] == []


def test_selections(spark):
    df = spark.createDataFrame([([1, 2, 9], [1, 2, 3])], "s array<int>, v array<int>")
    s, v = F.col("s"), F.col("v")
    row = df.select(
        A.visible_selected(s, v), A.toggle_all(s, v, F.lit(True)), A.toggle_all(s, v, F.lit(False)),
        A.toggle_one(s, F.lit(9), F.lit(False)), A.header_state(F.lit(1), F.lit(3))
    ).first()
    assert [list(x) if not isinstance(x, str) else x for x in row] == [[1, 2], [1, 2, 9, 3], [9], [1, 2], "indeterminate"]
    ids = spark.createDataFrame([(["a", "", "a", None],), ([],)], "i array<string>").select(A.bulk_ids(F.col("i")).alias("r")).collect()
    assert [(r["r"]["ids"], r["r"]["error"]) for r in ids] == [(["a"], None), (None, "NOTHING_SELECTED")]


@pytest.mark.parametrize(
    "q,unit,stems,want",
    [
        (5.0, "BOXES", 40, 200), (1.5, "BOXES", 40, None), (7.6, "STEMS", None, 8), (3.0, "KILOGRAMS", 40, None),
        (None, "BOXES", 40, None), (2.0, "BUNCHES", 40, 20)
    ]
)
def test_total_stems(spark, q, unit, stems, want):
    df = spark.createDataFrame([(q, unit, stems)], "q double, u string, s int")
    assert df.select(N.total_stems(F.col("q"), F.col("u"), F.col("s"), F.lit(10))).first()[0] == want


def test_valid_fob(spark):
    assert [one(spark, x, N.valid_fob) for x in ("0.4", "0", "-1", "x", None)] == [True, False, False, False, False]


def test_white_space_is_the_same_in_patterns_and_trims(spark):
    old = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
    codes = [(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    c = F.col("c")
    here = spark.createDataFrame(codes, "c string").select(
        c.rlike(old).alias("old"), c.rlike(f"^{T.S}$").alias("new"), c.rlike(f"(?s)^[^{T.SPACES}]$").alias("no"),
        (T.trimmed(F.concat(c, F.lit("a b"), c, c)) == "a b").alias("cut")
    )
    assert here.where("new").count() == 25 and here.where("old <> new or cut <> new or no = new").count() == 0


def test_space_class_settles_letters_early():
    # one table for what is below 256, and the rest behind one range: before, every letter was asked of each member
    assert "&&" in T.SPACES and r"\s" not in T.SPACES
