"""The pricing queries read all lines and all buyers, and the rate of each time is the newest valid one."""

import datetime as dt
import os
import random
from collections import Counter

import pytest

from offerloom.operators import pricing as PR
from offerloom.plans import queries as Q
from offerloom.plans.domain import table

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@needs_tables
def test_every_line_is_priced_for_every_buyer_of_its_order(spark):
    buyers = {r["c_custkey"] for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    of = {}
    for r in spark.read.parquet(f"{SF}/orders.parquet").collect():
        of.setdefault(r["o_orderkey"], set()).update({r["o_custkey"], r["o_custkey"] + 1} & buyers)
    want = Counter((r["line_id"], c) for r in table(spark, SF, "line").collect() for c in of.get(r["offer_id"], ()))
    got = Counter((r["line_id"], r["customer_id"]) for r in Q.QUERIES["prc_blockers"](spark, SF).select("line_id", "customer_id").collect())
    assert got == want and len(want) > 5000


@needs_tables
def test_every_line_is_judged(spark):
    got = [r["line_id"] for r in Q.QUERIES["prc_line_warnings"](spark, SF).collect()]
    assert sorted(got) == sorted(r["line_id"] for r in table(spark, SF, "line").collect())


def test_rates_at_each_time_against_brute_force(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    day = lambda n: start + dt.timedelta(hours=n)
    rates, used = [], set()
    for c in ("USD", "GBP"):
        for _ in range(25):
            a = rng.randrange(0, 9000)
            if (c, a) not in used:
                used.add((c, a))
                rates.append(("EUR", c, float(len(rates) + 1), day(a), None if rng.random() < 0.1 else day(a + rng.randrange(0, 2000))))
    rates.append(("EUR", "JPY", 7.0, day(100), None))
    rates.append(("USD", "GBP", 99.0, day(0), None))
    events = [(i, rng.choice(["USD", "GBP", "JPY", "CHF", None]), None if i == 0 else day(rng.randrange(-500, 14000))) for i in range(600)]
    events += [(1000 + i, r[1], t) for i, r in enumerate(rates) for t in r[3:5] if t]  # the ends themselves count
    want = {}
    for i, c, t in events:
        valid = [r for r in rates if t and r[0] == "EUR" and r[1] == c and r[3] <= t and (r[4] is None or r[4] >= t)]
        want.setdefault(i, []).append(max(valid, key=lambda r: r[3])[2] if valid else None)
    e = spark.createDataFrame(events, "id int, currency string, at timestamp")
    r = spark.createDataFrame(rates, "base string, quote string, rate double, effective_from timestamp, effective_to timestamp")
    got = {}
    for x in PR.rates_at_each(e, r).collect():
        got.setdefault(x["id"], []).append(x["fx_rate"])
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert {x["fx_rate"] for x in PR.rates_at_each(e, r.limit(0)).collect()} == {None}
