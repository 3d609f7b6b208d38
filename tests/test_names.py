import random

import pytest
from pyspark.sql import functions as F

from offerloom.functions import text as T
from offerloom.operators import names as N
from offerloom.operators import quotes as Q
from offerloom.operators import relational as R


def test_automaton_finds_the_first_word_within():
    random.seed(5)
    for _ in range(300):
        words = ["".join(random.choices("abc", k=random.randint(1, 5))) for _ in range(random.randint(0, 12))]
        text = "".join(random.choices("abcd", k=random.randint(0, 20)))
        assert N.Automaton(words).first_within(text) == next((i for i, w in enumerate(words) if w in text), None)


@pytest.mark.parametrize("chars", [0, 1 << 20])
def test_farms_by_containment_either_way(spark, chars):
    random.seed(7)
    word = lambda: "".join(random.choices("ab c", k=random.randint(0, 9)))
    farms = [(i, word(), random.randint(0, 20)) for i in range(60)]
    names = [(i, word() if i % 9 else None) for i in range(200)]
    f = spark.createDataFrame(farms, "farm_id int, farm_name string, position int")
    n = spark.createDataFrame(names, "name_id int, name string")
    fk = {r["farm_id"]: (r["k"], r["position"]) for r in f.withColumn("k", T.farm_key(F.col("farm_name"))).collect()}
    nk = {r["name_id"]: r["k"] for r in n.withColumn("k", T.farm_key(F.col("name"))).collect()}

    def best(k):
        found = [(k != x, at, i) for i, (x, at) in fk.items() if k and x and (k in x or x in k)]
        return min(found)[2] if found else None

    out = N.match_farms(n, f, automaton_chars=chars)
    assert {r["name_id"]: r["farm_id"] for r in out.collect()} == {i: best(k) for i, k in nk.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("least", [0.2, 0.55, 0.8, 1.0])
def test_most_similar_names(spark, least):
    random.seed(11)
    word = lambda: "".join(random.choices("abcde ", k=random.randint(0, 12)))
    known = [(i, word()) for i in range(80)] + [(200, "rosa"), (201, "Rosa"), (202, "rosa!"), (203, "ROSA"), (204, None)]
    names = [(i, word()) for i in range(80)] + [(300, "rosa"), (301, "rose"), (302, ""), (303, None), (304, "rosa")]
    n, k = spark.createDataFrame(names, "name_id int, name string"), spark.createDataFrame(known, "known_id int, known_name string")
    pairs = n.crossJoin(k).select(
        "name_id",
        "known_id",
        F.round(T.similarity(F.col("name"), F.col("known_name")), 6).alias("s")
    ).where(F.col("s") >= least).collect()
    want = set()
    for i, _ in names:
        found = sorted((-r["s"], r["known_id"]) for r in pairs if r["name_id"] == i)[:3]
        want |= {(i, rank, at, -s) for rank, (s, at) in enumerate(found, 1)}
    out = N.suggest_names(n, k, least=least)
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_pairs_are_compared(spark):
    """Of names of several words, pieces and counts leave a small part of all pairs to compute a distance for."""
    random.seed(13)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(12, 24)))
    a = spark.createDataFrame([(word(),) for _ in range(400)], "_a string")
    b = spark.createDataFrame([(word(),) for _ in range(400)], "_b string")
    seen = spark.sparkContext.accumulator(0)
    real = F.levenshtein

    def counted(x, y):
        @F.udf("int")
        def one(d):
            seen.add(1)
            return d

        return one(real(x, y))

    F.levenshtein = counted
    try:
        N.similar_pairs(a, b, 0.7).collect()
    finally:
        F.levenshtein = real
    assert seen.value < 0.05 * 400 * 400


def test_numbers_in_a_global_order(spark):
    rows = [(i, (i * 7919) % 1000, i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, v int, g int").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["id"]: r["n"] for r in R.in_global_order(df, [F.desc("v"), "id"], "n").collect()}
        each = {r["id"]: r["n"] for r in R.numbered_within(df, "g", ["v", "id"], "n").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {x[0]: n for n, x in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}
    want = {}
    for g in range(3):
        want |= {x[0]: n for n, x in enumerate(sorted((x for x in rows if x[2] == g), key=lambda x: x[1:2] + x[:1]), 1)}
    assert each == want
    none = spark.createDataFrame([], "id int, v int, g int")
    assert R.in_global_order(none, ["id"], "n").collect() == []
    quotes = spark.createDataFrame(
        [(2, "2024-05-01 10:00:00"), (1, "2024-05-01 10:00:00"), (3, None)],
        "quote_id int, created_at string"
    ).withColumn("created_at", F.to_timestamp("created_at"))
    assert {
        r["quote_id"]: r["quote_number"] for r in Q.numbered(quotes, quotes.limit(0)).collect() if r["quote_id"] < 3
    } == {1: "Q-20240501-0001", 2: "Q-20240501-0002"}
