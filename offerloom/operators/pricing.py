"""Prices per customer: freight, additional costs, currency, margin, and what blocks a price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import money, over, rounded, times

CLEARING = ["CLEARING", "INSPECTION"]
# Where a supplier of a country ships from if nothing else is set.
DEFAULT_DEPARTURE = {"ecuador": ("Quito", "Ecuador"), "colombia": ("Bogotá", "Colombia")}
# Bounds outside of which weights and prices are unusual, and days after which a rate is stale.
STALE_DAYS, WEIGHT_KG, SELL_PRICE = 14, (0.5, 30), (0.05, 20)


def freight_per_stem(rate: Column, unit: Column, stems: Column, weight: Column) -> Column:
    """PER_KG (also if no unit is given): weight * rate / stems; PER_BOX: rate / stems; PER_STEM: rate."""
    return F.when(
        unit == "PER_STEM",
        F.when(stems > 0, money(rate))
    ).when(unit == "PER_BOX", over(rate, stems)).otherwise(over(times(weight, rate), stems))


def handling_per_stem(per_box: Column, stems: Column) -> Column:
    return over(per_box, stems)


def cost_per_stem(amount: Column, unit: Column, stems: Column, weight: Column) -> Column:
    """PER_STEM, PER_KG, or for a box: PER_BOX and FLAT."""
    return F.when(unit == "PER_STEM", money(amount)).when(
        unit == "PER_KG",
        over(times(weight, amount), stems)
    ).otherwise(over(amount, stems))


def costs_per_stem(costs: Column, stems: Column, weight: Column, which=None) -> Column:
    """The sum over an array of costs (name, category, amount, unit) whose category `which` accepts."""
    zero = F.lit(0).cast("decimal(28,18)")
    kept = F.filter(costs, lambda c: which(c["category"])) if which else costs
    return F.coalesce(F.aggregate(kept, zero, lambda s, c: money(s + cost_per_stem(c["amount"], c["unit"], stems, weight))), zero)


def cost_price(incoterm: Column, fob: Column, freight: Column, additional: Column) -> Column:
    """FOB: the price; CFR: and freight; DDP: and the additional costs."""
    return F.when(incoterm == "FOB", money(fob)).when(incoterm == "CFR", money(money(fob) + freight)).when(
        incoterm == "DDP",
        money(money(fob) + freight + additional)
    )


def converted(amount: Column, source: Column, target: Column, base: Column, quote: Column, rate: Column) -> Column:
    """In another currency by a rate in either direction; null without a rate that fits."""
    return F.when(source == target, money(amount)).when(
        (base == source) & (quote == target),
        times(amount, rate)
    ).when((base == target) & (quote == source), over(amount, rate))


def with_margin(cost: Column, percent: Column) -> Column:
    return times(cost, (F.lit(100).cast("decimal(9,3)") + percent.cast("decimal(9,3)")) * F.lit("0.01").cast("decimal(3,2)"))


def blockers(c: dict[str, Column]) -> Column:
    """Codes of what blocks a price, in order. c: incoterm, fob, stems, weight, freight_rate, freight_unit, costs, source,
    target, rate, margin.

    A cost for each kilogram needs the weight as freight does; such a line is blocked, not priced without the cost.
    """
    cif = c["incoterm"].isin("CFR", "DDP")
    ddp = c["incoterm"] == "DDP"
    has = lambda cats: F.coalesce(F.exists(c["costs"], lambda x: x["category"].isin(*cats)), F.lit(False))
    per_kg = (F.coalesce(c["freight_unit"], F.lit("PER_KG")) == "PER_KG") | (
        ddp & F.coalesce(F.exists(c["costs"], lambda x: x["unit"] == "PER_KG"), F.lit(False))
    )
    one = F.array(
        F.when(c["fob"].isNull(), "MISSING_FOB_PRICE").when(c["fob"] < 0, "NEGATIVE_PRICE").when(c["fob"] == 0, "MISSING_FOB_PRICE"),
        F.when(
            c["stems"].isNull(),
            "MISSING_STEMS_PER_BOX"
        ).when(c["stems"] == 0, "ZERO_STEMS_PER_BOX").when(c["stems"] < 0, "NEGATIVE_PRICE"),
        F.when(cif & per_kg & c["weight"].isNull(), "MISSING_WEIGHT").when(cif & (c["weight"] < 0), "NEGATIVE_WEIGHT"),
        F.when(cif & c["freight_rate"].isNull(), "MISSING_FREIGHT_RATE").when(cif & (c["freight_rate"] < 0), "NEGATIVE_PRICE"),
        F.when(ddp & ~has(CLEARING), "MISSING_DDP_CLEARING_INSPECTION"),
        F.when(ddp & ~has(["HANDLING"]), "MISSING_DDP_HANDLING"),
    )
    negative = F.when(ddp, F.transform(F.filter(c["costs"], lambda x: x["amount"] < 0), lambda x: F.lit("NEGATIVE_PRICE")))
    rest = F.array(
        F.when(c["target"].isNull(), "MISSING_CUSTOMER_CURRENCY"),
        F.when(~c["source"].eqNullSafe(c["target"]) & c["rate"].isNull(), "MISSING_EXCHANGE_RATE"),
        F.when(c["margin"].isNull(), "MISSING_MARGIN"),
    )
    return F.array_compact(F.concat(one, F.coalesce(negative, F.array().cast("array<string>")), rest))


ROUTE_CODES = ["MISSING_FREIGHT_RATE", "MISSING_DDP_CLEARING_INSPECTION", "MISSING_DDP_HANDLING"]


def with_route_issues(issues: Column, origin_missing: Column) -> Column:
    """If no origin is known, what is missing on the route is one issue, at the end: ORIGIN_NOT_CONFIGURED."""
    route = F.exists(issues, lambda i: i.isin(*ROUTE_CODES))
    return F.when(
        origin_missing & route,
        F.concat(F.filter(issues, lambda i: ~i.isin(*ROUTE_CODES)), F.array(F.lit("ORIGIN_NOT_CONFIGURED")))
    ).otherwise(issues)


def priced(lines: DataFrame, decimals: int = 2) -> DataFrame:
    """lines with issues and the build-up of the price, which is null where anything blocks it.

    lines: incoterm, fob, source_currency, target_currency, stems_per_box, margin_pct, weight_kg, freight_rate, freight_unit, costs,
    fx_base, fx_quote, fx_rate, manual_price; optionally origin_missing and route_supports (default true).
    A route that doesn't offer the incoterm is the only issue then. Prices are rounded once, at the end; a manual price wins.
    """
    has = lambda name, default: F.col(name) if name in lines.columns else F.lit(default)
    c = {
        k: F.col(v) for k, v in {
            "incoterm": "incoterm", "fob": "fob", "stems": "stems_per_box", "weight": "weight_kg",
            "freight_rate": "freight_rate", "freight_unit": "freight_unit", "costs": "costs",
            "source": "source_currency", "target": "target_currency", "rate": "fx_rate", "margin": "margin_pct"
        }.items()
    }
    issues = F.when(
        ~has("route_supports", True),
        F.array(F.lit("INCOTERM_NOT_SUPPORTED_ON_ROUTE"))
    ).otherwise(with_route_issues(blockers(c), has("origin_missing", False)))
    df = lines.withColumn("issues", issues)
    free = F.size("issues") == 0
    stems, weight = c["stems"], c["weight"]
    ddp = F.col("incoterm") == "DDP"
    zero = F.lit(0).cast("decimal(28,18)")
    part = lambda which: F.when(free, F.when(ddp, costs_per_stem(c["costs"], stems, weight, which)).otherwise(zero))
    df = df.withColumns(
        {
            "freight": F.when(
                free,
                F.when(F.col("incoterm") == "FOB", zero).otherwise(freight_per_stem(c["freight_rate"], c["freight_unit"], stems, weight))
            ),
            "clearing_inspection": part(lambda x: x.isin(*CLEARING)),
            "handling": part(lambda x: x == "HANDLING"),
            "other_costs": part(lambda x: ~x.isin(*CLEARING, "HANDLING")),
        }
    )
    df = df.withColumn("additional", money(F.col("clearing_inspection") + F.col("handling") + F.col("other_costs")))
    df = df.withColumn("cost_source", cost_price(F.col("incoterm"), c["fob"], F.col("freight"), F.col("additional")))
    df = df.withColumn(
        "cost_target",
        converted(F.col("cost_source"), c["source"], c["target"], F.col("fx_base"), F.col("fx_quote"), c["rate"])
    )
    df = df.withColumn("calculated", F.when(free, with_margin(F.col("cost_target"), c["margin"])))
    price = lambda x: rounded(x, decimals).cast("decimal(18,6)")
    return df.withColumns(
        {
            "calculated_rounded": price(F.col("calculated")), "is_manual": free & F.col("manual_price").isNotNull(),
            "final_price": F.when(free, F.coalesce(price(F.col("manual_price")), price(F.col("calculated"))))
        }
    )


def duplicate_categories(costs: DataFrame, key: str) -> DataFrame:
    """Categories of which a key has costs of several names."""
    return costs.groupBy(key, "category").agg(F.count_distinct("name").alias("n_names")).where("n_names > 1")


def line_warnings(c: dict[str, Column], as_of: Column) -> Column:
    """Codes of what is unusual. c: confidence, linked, rate_updated, weight, is_manual, final_price."""
    return F.array_compact(
        F.array(
            F.when(c["confidence"] == "LOW", "LOW_CONFIDENCE"),
            F.when(~c["linked"], "NOT_LINKED"),
            F.when(
                (as_of.cast("timestamp").cast("double") - c["rate_updated"].cast("timestamp").cast("double")) > STALE_DAYS * 86400,
                "STALE_RATE"
            ),
            F.when((c["weight"] < WEIGHT_KG[0]) | (c["weight"] > WEIGHT_KG[1]), "UNUSUAL_WEIGHT"),
            F.when(c["is_manual"], "MANUAL_PRICE"),
            F.when((c["final_price"] < SELL_PRICE[0]) | (c["final_price"] > SELL_PRICE[1]), "UNUSUAL_SELL_PRICE"),
        )
    )


# --- context -------------------------------------------------------------------------------------


def origins(lines: DataFrame, farms: DataFrame, locations: DataFrame) -> DataFrame:
    """lines (origin_id, farm_id) with resolved_origin: the line's, else the farm's, else its country's default departure, found
    by city and country in any case.
    """
    f = farms.select(F.col("farm_id").alias("_f"), F.col("origin_id").alias("_fo"), F.lower(F.trim("country")).alias("_fc"))
    # one row a country
    default = F.coalesce(
        *(
            F.when(
                (F.lower("city") == city.lower()) & (F.lower("country") == country.lower()),
                F.lit(key)
            ) for key, (city, country) in DEFAULT_DEPARTURE.items()
        )
    )
    d = locations.withColumn("_key", default).where("_key is not null").groupBy("_key").agg(F.min("location_id").alias("_do"))
    j = lines.join(f, F.col("farm_id") == F.col("_f"), "left").join(d, F.col("_fc") == F.col("_key"), "left")
    return j.select(*lines.columns, F.coalesce("origin_id", "_fo", "_do").alias("resolved_origin"))


def best_routes(routes: DataFrame) -> DataFrame:
    """One route for each origin and destination: by air if there is one, else the one created first."""
    w = Window.partitionBy("origin_id", "destination_id").orderBy((F.col("transport") != "AIR").cast("int"), "created_at", "route_id")
    return routes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def route_costs(costs: DataFrame) -> DataFrame:
    """route_id and its costs as one array; rows without type, category or unit don't count."""
    kept = costs.where("cost_type_id is not null and category is not null and unit is not null")
    item = F.struct(F.coalesce("name", "category").alias("name"), "category", F.col("amount").cast("decimal(10,4)").alias("amount"), "unit")
    return kept.groupBy("route_id").agg(F.array_sort(F.collect_list(item)).alias("costs"))


def valid_at(start: Column, end: Column, as_of: Column) -> Column:
    """Both ends count; an open end has none."""
    return (start <= as_of) & (end.isNull() | (end >= as_of))


def rates_as_of(rates: DataFrame, as_of: str, base: str = "EUR") -> DataFrame:
    """currency, fx_rate: of the base currency's rates valid at one time, the newest of each currency."""
    t = F.lit(as_of).cast("timestamp")
    now = rates.where((F.col("base") == base) & valid_at(F.col("effective_from"), F.col("effective_to"), t))
    return now.groupBy(F.col("quote").alias("currency")).agg(F.max_by("rate", "effective_from").alias("fx_rate"))


def rate_spans(rates: DataFrame, base: str = "EUR") -> DataFrame:
    """_c, _month, _last, _inside, _before: for each currency and month from its first rate to its last change, the changes
    inside and the one before.

    A change (at, rate) is a time from which another rate is the newest valid one, or none is (null). _last is the currency's last month.
    """
    r = rates.where(F.col("base") == base)
    start, end = F.col("effective_from").cast("timestamp"), F.col("effective_to").cast("timestamp")
    r = r.select(F.col("quote").alias("_c"), start.alias("_from"), end.alias("_to"), "rate")
    behind = F.col("_to") + F.make_dt_interval(secs=F.lit("0.000001").cast("decimal(18,6)"))
    points = r.select("_c", F.col("_from").alias("_p")).union(r.where("_to is not null").select("_c", behind)).distinct()
    valid = valid_at(F.col("_from"), F.col("_to"), F.col("_p"))
    newest = F.max_by("rate", F.when(valid, F.col("_from"))).alias("rate")  # null if none is valid
    changes = points.join(r, "_c").groupBy("_c", "_p").agg(newest).withColumn("_month", F.trunc("_p", "month"))
    inside = changes.groupBy("_c", "_month").agg(F.array_sort(F.collect_list(F.struct(F.col("_p").alias("at"), "rate"))).alias("_inside"))
    bounds = changes.groupBy("_c").agg(F.min("_month").alias("_first"), F.max("_month").alias("_last"))
    months = bounds.select("_c", "_last", F.explode(F.sequence("_first", "_last", F.expr("interval 1 month"))).alias("_month"))
    w = Window.partitionBy("_c").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.try_element_at("_inside", F.lit(-1)), ignorenulls=True).over(w)
    return months.join(inside, ["_c", "_month"], "left").withColumn("_before", before)


def rates_at_each(events: DataFrame, rates: DataFrame, *, at: str = "at", currency: str = "currency", base: str = "EUR") -> DataFrame:
    """events with fx_rate: of the rates valid at each event's own time, the newest; null if none is.

    The rates become changes by month; events meet them by currency and month, so that no currency is sorted
    in one task and an event looks through the changes of one month only. Windows may overlap in any way.
    """
    spans = rate_spans(rates, base)
    last = spans.select("_c", "_last").distinct().select(F.col("_c").alias("_b"), F.col("_last").alias("_until"))
    time = F.col(at).cast("timestamp")
    e = events.join(last, F.col(currency) == F.col("_b"), "left").withColumn("_m", F.least(F.trunc(time, "month"), F.col("_until")))
    j = e.join(spans.drop("_last"), (F.col("_b") == F.col("_c")) & (F.col("_m") == F.col("_month")), "left")
    now = F.try_element_at(F.filter("_inside", lambda x: x["at"] <= time), F.lit(-1))
    return j.select(*events.columns, F.coalesce(now, F.col("_before"))["rate"].alias("fx_rate"))


def with_context(
    pairs: DataFrame, routes: DataFrame, tariffs: DataFrame, costs: DataFrame, rates: DataFrame, as_of: str,
    base: str = "EUR"
) -> DataFrame:
    """Lines for customers with all that their prices need: route, freight, costs, rate.

    pairs: resolved_origin, destination_id, incoterm, source_currency, target_currency. The rate is that of the currency that isn't
    the base, towards the target currency. One join for each dimension, whatever the number of lines and customers;
    Spark sends a dimension to the pairs where its size allows that.
    """
    r = best_routes(routes).select(
        F.col("origin_id").alias("_o"),
        F.col("destination_id").alias("_d"),
        "route_id",
        "supports_cfr",
        "supports_ddp"
    )
    t = tariffs.select(F.col("route_id").alias("_tr"), F.col("rate").alias("_rate"), F.col("rate_unit").alias("_unit"))
    c = route_costs(costs).select(F.col("route_id").alias("_cr"), F.col("costs").alias("_costs"))
    x = rates_as_of(rates, as_of, base)
    j = pairs.join(r, (F.col("resolved_origin") == F.col("_o")) & (F.col("destination_id") == F.col("_d")), "left")
    j = j.join(t, F.col("route_id") == F.col("_tr"), "left").join(c, F.col("route_id") == F.col("_cr"), "left")
    other = F.when(
        F.col("source_currency") != F.col("target_currency"),
        F.when(F.col("source_currency") == base, F.col("target_currency")).otherwise(F.col("source_currency"))
    )
    j = j.withColumn("_other", other).join(x, F.col("_other") == F.col("currency"), "left")
    cif = F.col("incoterm").isin("CFR", "DDP")
    supports = F.when(
        F.col("incoterm") == "CFR",
        F.coalesce("supports_cfr", F.lit(True))
    ).when(F.col("incoterm") == "DDP", F.coalesce("supports_ddp", F.lit(True))).otherwise(F.lit(True))
    found = F.col("fx_rate").isNotNull()
    return j.select(
        *pairs.columns,
        "route_id",
        supports.alias("route_supports"),
        F.col("resolved_origin").isNull().alias("origin_missing"),
        F.when(cif, F.col("_rate")).alias("freight_rate"),
        F.when(cif, F.col("_unit")).alias("freight_unit"),
        F.when(F.col("incoterm") == "DDP", F.col("_costs")).alias("costs"),
        F.when(found, F.lit(base)).alias("fx_base"),
        F.when(found, F.col("_other")).alias("fx_quote"),
        "fx_rate",
    )


def price_for_requests(lines: DataFrame, customers: DataFrame, *context, as_of: str) -> DataFrame:
    """Every line of a request priced for every customer of it. lines, customers: request_id; context: routes, tariffs, costs, rates."""
    return priced(with_context(lines.join(customers, "request_id"), *context, as_of=as_of))
