"""Changes of tables, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cost_type_key, match_key


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows replaced or added by key; of changes to one key any one must be left."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes.select(*table.columns))


def find_or_create_articles(wanted: DataFrame, articles: DataFrame) -> DataFrame:
    """Wanted articles (want_id, farm_id, product_name, variety, stem_length, box_type, stems_per_box): with the article found
    in any case of its names, or created.

    Existing values win. Of wants for the same new article the first creates it. outcome: FOUND or CREATE; article_id is null for
    what is to be created, new_key names it.
    """
    key = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    full = F.concat_ws(
        "\u0001", F.col("farm_id").cast("string"), key("product_name"), key("variety"), key("stem_length"),
        key("box_type"), key("stems_per_box")
    )
    a = articles.groupBy(full.alias("_k")).agg(F.min("article_id").alias("article_id"))
    w = wanted.withColumn("new_key", full).join(a, F.col("new_key") == F.col("_k"), "left").drop("_k")
    first = F.row_number().over(Window.partitionBy("new_key").orderBy("want_id")) == 1
    return w.withColumn("outcome", F.when(F.col("article_id").isNotNull(), "FOUND").when(first, "CREATE").otherwise("FOUND"))


def add_costs(requests: DataFrame, costs: DataFrame, types: DataFrame) -> DataFrame:
    """New route costs (request_id, route_id, cost_type_id, amount, unit): with the type's category, and outcome CREATE, NO_TYPE
    or EXISTS. One cost a route and type.
    """
    t = types.select(F.col("cost_type_id").alias("_t"), "category")
    c = costs.where("cost_type_id is not null").select(F.col("route_id").alias("_r"), F.col("cost_type_id").alias("_ct")).distinct()
    j = requests.join(t, F.col("cost_type_id") == F.col("_t"), "left").join(
        c,
        (F.col("route_id") == F.col("_r")) & (F.col("cost_type_id") == F.col("_ct")),
        "left"
    )
    first = F.row_number().over(Window.partitionBy("route_id", "cost_type_id").orderBy("request_id")) == 1
    return j.select(
        *requests.columns, "category",
        F.when(F.col("_t").isNull(), "NO_TYPE").when(F.col("_r").isNotNull() | ~first, "EXISTS").otherwise("CREATE").alias("outcome")
    )


def replace_rates(rates: DataFrame, new: DataFrame) -> DataFrame:
    """Rates with those of the new pairs (base, quote) deleted and the new ones added; only rates of the base EUR are taken."""
    fine = new.where((F.col("base") == "EUR") & (F.col("quote") != "EUR") & (F.col("rate") > 0))
    return upsert(rates, fine, ["base", "quote"])


def canonical_rates(rates: DataFrame, base: str = "EUR") -> DataFrame:
    """Rates towards the base turned round: dropped where the direct pair exists, else 1 / rate to 6 decimals; zero rates
    towards the base stay.
    """
    direct = rates.where(F.col("base") == base).select(F.col("quote").alias("_q")).distinct()
    j = rates.join(direct, (F.col("quote") == base) & (F.col("base") == F.col("_q")), "left")
    turn = (F.col("quote") == base) & (F.col("base") != base)
    kept = j.where(~turn | F.col("_q").isNull())
    flip = turn & (F.col("rate") != 0)
    inverse = F.round(
        F.lit(1).cast("decimal(20,12)") / F.when(F.col("rate") != 0, F.col("rate")).cast("decimal(12,6)"),
        6
    ).cast("decimal(12,6)")
    new = {
        "base": F.when(flip, F.lit(base)).otherwise(F.col("base")),
        "quote": F.when(flip, F.col("base")).otherwise(F.col("quote")),
        "rate": F.when(flip, inverse).otherwise(F.col("rate").cast("decimal(12,6)"))
    }
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in rates.columns])


def remove_destinations(destinations: DataFrame, removed: DataFrame) -> DataFrame:
    """Customers' destinations (customer_id, destination_id, is_default, created_at) without the removed ones; if a default
    went, the earliest that is left becomes it.
    """
    left = destinations.join(removed, ["customer_id", "destination_id"], "left_anti")
    per = Window.partitionBy("customer_id")
    none = ~F.coalesce(F.max("is_default").over(per), F.lit(False))
    first = F.row_number().over(per.orderBy("created_at", "destination_id")) == 1
    return left.withColumn("is_default", F.col("is_default") | (none & first))


def set_default_destination(destinations: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen destination (customer_id, destination_id) as its customer's only default; a choice that isn't the customer's
    changes nothing.
    """
    c = chosen.join(
        destinations.select("customer_id", "destination_id"),
        ["customer_id", "destination_id"],
        "left_semi"
    ).select(F.col("customer_id").alias("_c"), F.col("destination_id").alias("_d"))
    j = destinations.join(c, F.col("customer_id") == F.col("_c"), "left")
    return j.select(
        *[
            F.when(
                F.col("_d").isNotNull(),
                F.col("destination_id") == F.col("_d")
            ).otherwise(F.col("is_default")).alias("is_default") if x == "is_default" else F.col(x) for x in destinations.columns
        ]
    )


def deletable(ids: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """ids with the number of rows of each child table that refers to them, and whether none does."""
    out = ids
    for name, child in children.items():
        n = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
        out = out.join(n, F.col(key) == F.col("_k"), "left").withColumn(f"n_{name}", F.coalesce("_n", F.lit(0))).drop("_k", "_n")
    free = F.lit(True)
    for name in children:
        free = free & (F.col(f"n_{name}") == 0)
    return out.withColumn("deletable", free)


def delete_articles(lines: DataFrame, deleted: DataFrame) -> DataFrame:
    """Offer lines after articles were deleted: those that were linked to one are unmatched."""
    d = deleted.select(F.col("article_id").alias("_a")).distinct()
    j = lines.join(d, F.col("article_id") == F.col("_a"), "left")
    gone = F.col("_a").isNotNull()
    new = {"article_id": F.when(~gone, F.col("article_id")), "match_status": F.when(gone, "UNMATCHED").otherwise(F.col("match_status"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in lines.columns])


def delete_offers(
    ids: DataFrame,
    offers: DataFrame,
    lines: DataFrame,
    quote_lines: DataFrame,
    uploads: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(offers deleted, uploads left without an offer by it). Offers whose lines stand in quotes stay."""
    used = lines.join(quote_lines.select("line_id"), "line_id", "left_semi").select("offer_id").distinct()
    deleted = offers.join(ids.select("offer_id"), "offer_id", "left_semi").join(used, "offer_id", "left_anti")
    left = offers.join(deleted.select("offer_id"), "offer_id", "left_anti").select("upload_id")
    return deleted, uploads.join(deleted.select("upload_id"), "upload_id", "left_semi").join(left, "upload_id", "left_anti")


def add_unique(requests: DataFrame, table: DataFrame, columns: list[str], order: str) -> DataFrame:
    """requests with outcome CREATE, EXISTS or INVALID: values that are new in any case and spacing, the first of equals in the batch."""
    key = F.concat_ws("\u0001", *(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in columns))
    known = table.select(key.alias("_k")).distinct()
    rows = requests.withColumn("_key", key)
    j = rows.join(known, F.col("_key") == F.col("_k"), "left")
    blank = F.lit(False)
    for c in columns:
        blank = blank | (F.trim(F.coalesce(c, F.lit(""))) == "")
    first = F.row_number().over(Window.partitionBy("_key").orderBy(order)) == 1
    return j.select(
        *requests.columns,
        F.when(blank, "INVALID").when(F.col("_k").isNotNull() | ~first, "EXISTS").otherwise("CREATE").alias("outcome")
    )


def length_from_grade(variants: DataFrame) -> DataFrame:
    """Variants whose grade is nothing but a length, such as `60cm`: that is their stem length, and the grade is empty."""
    only = F.col("grade").rlike(r"(?i)^\s*\d+\s*cm\s*$") & F.col("stem_length").isNull()
    length = F.regexp_extract("grade", r"(\d+)", 1)
    new = {
        "stem_length": F.when(only, length).otherwise(F.col("stem_length")),
        "grade": F.when(~F.coalesce(only, F.lit(False)), F.col("grade"))
    }
    return variants.select(*[new[c].alias(c) if c in new else F.col(c) for c in variants.columns])


def consolidate_clearing(costs: DataFrame) -> DataFrame:
    """Costs with each route's clearings and inspections in one row, their sum; other rows stay. costs: route_id, category, amount."""
    amount = lambda c: c.cast("decimal(12,4)").alias("amount")
    both = costs.where("category in ('CLEARING', 'INSPECTION')").groupBy("route_id").agg(F.sum("amount").alias("amount"))
    rest = costs.where("category not in ('CLEARING', 'INSPECTION')").select("route_id", "category", amount(F.col("amount")))
    return both.select("route_id", F.lit("CLEARING_INSPECTION").alias("category"), amount(F.col("amount"))).union(rest)


# The three types of costs that always exist, and the names that mean them.
COST_TYPES = [("Clearing", "CLEARING", "PER_STEM"), ("Handling", "HANDLING", "PER_BOX"), ("Inspection", "INSPECTION", "FLAT")]
COST_SYNONYMS = {
    "clearing": ["clearing", "inklaring", "customs clearance", "douane"],
    "handling": ["handling", "handling fee", "afhandeling"],
    "inspection": ["inspection", "inspectie", "quality inspection"],
}


def cost_type_of(name: Column) -> Column:
    """The normalized name of the type that a cost's name stands for: that of a synonym, else its own; null without one."""
    key = cost_type_key(name)
    return F.coalesce(*(F.when(key.isin(*words), F.lit(k)) for k, words in COST_SYNONYMS.items()), key)


def seed_cost_types(costs: DataFrame, types: DataFrame) -> DataFrame:
    """types (normalized_name, name, category, unit) with the three that always exist and one for each other name of costs without a type.

    costs: cost_type_id, name, category, unit. A name with several categories or units takes the least of both. No type is replaced.
    """
    fixed = costs.sparkSession.createDataFrame(
        [(n.lower(), n, c, u) for n, c, u in COST_TYPES],
        types.select("normalized_name", "name", "category", "unit").schema
    )
    loose = costs.where(
        "cost_type_id is null and name is not null and category is not null"
    ).withColumn("_key", cost_type_of(F.col("name")))
    least = F.min(F.struct("category", F.coalesce("unit", F.lit("FLAT")).alias("unit")))
    own = loose.groupBy("_key").agg(F.min(F.trim("name")).alias("name"), least.alias("_l"))
    own = own.select(F.col("_key").alias("normalized_name"), "name", "_l.category", "_l.unit")
    columns = ["normalized_name", "name", "category", "unit"]
    out = types.select(*columns)
    for more in (fixed, own):
        out = out.union(more.join(out.select("normalized_name"), "normalized_name", "left_anti").select(*columns))
    return out


def link_cost_types(costs: DataFrame, types: DataFrame) -> DataFrame:
    """costs with type_name: the normalized name of the type that a cost without cost_type_id is linked to; null where none has its name."""
    known = types.select(F.col("normalized_name").alias("type_name")).distinct()
    wanted = F.when(F.col("cost_type_id").isNull(), cost_type_of(F.col("name")))
    return costs.withColumn("_key", wanted).join(known, F.col("_key") == F.col("type_name"), "left").drop("_key")


def cost_vocabulary(costs: DataFrame) -> DataFrame:
    """The names that costs use, one for each key, spelled as its least spelling."""
    return costs.where(F.trim("name") != "").groupBy(cost_type_key(F.col("name")).alias("normalized_name")).agg(
        F.min(F.trim("name")).alias("name"),
        F.count("*").alias("n_costs")
    )


def conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def backfill_codes(locations: DataFrame, codes: dict[str, str]) -> DataFrame:
    """Locations without a code get that of their city."""
    known = F.coalesce(*(F.when(match_key(F.col("city")) == city, F.lit(code)) for city, code in codes.items()))
    return locations.withColumn("code", F.coalesce("code", known))


def backfill_default_destinations(customers: DataFrame, destinations: DataFrame, created_at: Column) -> DataFrame:
    """destinations with a default row for each customer that has a destination of its own but no row for it."""
    new = customers.where("destination_id is not null").join(destinations, ["customer_id", "destination_id"], "left_anti")
    return destinations.unionByName(
        new.select("customer_id", "destination_id", F.lit(True).alias("is_default"), created_at.alias("created_at"))
    )


def validated_manual_lines(lines: DataFrame, articles: DataFrame) -> DataFrame:
    """Lines typed in by hand (line_id, farm_id, article_id, quantity, price): outcome OK, BAD_PRICE, BAD_QUANTITY,
    OTHER_SUPPLIER or DUPLICATE (the first line of an article counts).
    """
    a = articles.select(F.col("article_id").alias("_a"), F.col("farm_id").alias("_f"))
    j = lines.join(a, F.col("article_id") == F.col("_a"), "left")
    first = F.row_number().over(Window.partitionBy("farm_id", "article_id").orderBy("line_id")) == 1
    bad_quantity = ~F.coalesce((F.col("quantity") > 0) & (F.col("quantity") == F.floor("quantity")), F.lit(False))
    outcome = F.when(~F.coalesce(F.col("price") > 0, F.lit(False)), "BAD_PRICE").when(bad_quantity, "BAD_QUANTITY").when(
        ~F.coalesce(F.col("farm_id") == F.col("_f"), F.lit(False)),
        "OTHER_SUPPLIER"
    ).when(~first, "DUPLICATE").otherwise("OK")
    return j.select(*lines.columns, outcome.alias("outcome"))


def retarget_mappings(changes: DataFrame, mappings: DataFrame, articles: DataFrame) -> DataFrame:
    """Changes of what a wording stands for (mapping_id, article_id): outcome OK, NOT_FOUND, ARTICLE_GONE or OTHER_SUPPLIER."""
    m = mappings.select(F.col("mapping_id").alias("_m"), F.col("farm_id").alias("_mf"))
    a = articles.select(F.col("article_id").alias("_a"), F.col("farm_id").alias("_af"))
    j = changes.join(m, F.col("mapping_id") == F.col("_m"), "left").join(a, F.col("article_id") == F.col("_a"), "left")
    return j.select(
        *changes.columns,
        F.when(F.col("_m").isNull(), "NOT_FOUND").when(F.col("_a").isNull(), "ARTICLE_GONE").when(
            F.col("_mf") != F.col("_af"),
            "OTHER_SUPPLIER"
        ).otherwise("OK").alias("outcome")
    )
