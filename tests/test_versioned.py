from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from offerloom.operators import relational as R
from offerloom.operators import textindex as TX
from offerloom.sources import versioned as V

SCHEMA = "id int, v string"


def files(folder):
    return {str(p) for p in folder.rglob("*.parquet") if p.is_file()}


def listed(table):
    return set(table.version()[1]["folders"].values())


def test_changes_touch_their_buckets_only(spark, tmp_path):
    rows = [(i, f"v{i}") for i in range(200)] + [(None, "none")]
    table = V.VersionedTable.create(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}", ["id"], buckets=32)
    old, before = files(tmp_path), listed(table)
    changes = [(3, "new", "UPSERT"), (500, "more", "UPSERT"), (7, None, "DELETE"), (None, "changed", "UPSERT"), (999, None, "DELETE")]
    assert table.change(spark.createDataFrame(changes, SCHEMA + ", op string")) == 1
    want = {i: v for i, v in rows} | {3: "new", 500: "more", None: "changed"}
    del want[7]
    assert {r["id"]: r["v"] for r in table.read().collect()} == want
    assert {r["id"]: r["v"] for r in table.read(0).collect()} == dict(rows)  # versions stay
    assert len(listed(table) - before) <= 5 and len(listed(table) & before) >= 27 and old <= files(tmp_path)
    everything = table.read().withColumn("op", F.lit("DELETE"))
    table.change(everything)
    assert table.read().collect() == [] and table.read().columns == ["id", "v"]
    assert table.change(spark.createDataFrame([], SCHEMA + ", op string")) == 3
    table.change(spark.createDataFrame([(1, "back", "UPSERT")], SCHEMA + ", op string"))
    assert [tuple(r) for r in table.read().collect()] == [(1, "back")]


def test_two_changes_of_one_key_are_an_error(spark, tmp_path):
    table = V.VersionedTable.create(spark.createDataFrame([(1, "a")], SCHEMA), f"file://{tmp_path}/t", ["id"])
    with pytest.raises(ValueError, match="id=1"):
        table.change(spark.createDataFrame([(1, "b", "UPSERT"), (1, None, "DELETE")], SCHEMA + ", op string"))
    with pytest.raises(ValueError, match="more than one row"):
        V.VersionedTable.create(spark.createDataFrame([(1, "a"), (1, "a")], SCHEMA), f"file://{tmp_path}/u", ["id"])


def test_changes_at_the_same_time_all_count(spark, tmp_path):
    table = V.VersionedTable.create(spark.createDataFrame([(0, "0")], SCHEMA), f"file://{tmp_path}", ["id"], buckets=4)
    with ThreadPoolExecutor(3) as pool:
        done = list(pool.map(lambda n: table.change(spark.createDataFrame([(n, str(n), "UPSERT")], SCHEMA + ", op string")), range(1, 4)))
    assert sorted(done) == [1, 2, 3] and {r["id"] for r in table.read().collect()} == {0, 1, 2, 3}


def test_substrings_by_trigrams(spark):
    """Patterns of one to twelve characters, with repeats and odd letters, give the rows that a scan gives."""
    texts = [
        "abcabcabc", "Rosa Freedom", "rosa  freedom 60", "CRÈME brûlée", "aaaaaaa", "ab", "", None, "freedom", "éclair",
        "xabcabz", "a_b%c"
    ]
    df = spark.createDataFrame([(i, x, texts[-1 - i]) for i, x in enumerate(texts)], "id int, a string, b string")
    index = TX.build(df, "id", ("a", "b"))
    found = lambda q, columns=None: sorted(r["id"] for r in index.search(df, q, columns).collect())
    for q in (
        "a", "ab", "abc", "cab", "abca", "bcabc", "abcabca", "abcabcabc", "aaa", "aaaaa", "aaaaaaaa", "FREEDOM",
        "rosa freedom", "ème b", "_b%", "zzz", " 60"
    ):
        assert found(q) == sorted(r["id"] for r in R.search(df, q=q, q_columns=("a", "b")).collect()), q
        assert found(q, ("b",)) == sorted(r["id"] for r in R.search(df, q=q, q_columns=("b",)).collect()), q
    assert found(None) == list(range(12)) and found("  ") == list(range(12))
    ids = index.ids("freedom")
    assert all("trigrams" in f for f in ids.inputFiles())  # the rows are not read
    assert "PushedFilters: [In(trigram" in ids._jdf.queryExecution().executedPlan().toString() or "In(trigram" in ids._sc._jvm.PythonSQLUtils.explainString(
        ids._jdf.queryExecution(),
        "formatted"
    )
