"""Quotes: gating, quantities, packaging, totals, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import numbered_within

QUOTABLE = ["AUTO_MATCHED", "DERIVED", "USER_LINKED"]


def gate(offer_status: Column, match_status: Column, article: Column) -> Column:
    """Why a line can't be quoted: the first of OFFER_NOT_REVIEWED, LINE_NOT_MATCHED, PROFILE_MISSING; null if it can."""
    return F.when(~offer_status.eqNullSafe(F.lit("REVIEWED")), "OFFER_NOT_REVIEWED").when(
        ~F.coalesce(match_status.isin(*QUOTABLE), F.lit(False)),
        "LINE_NOT_MATCHED"
    ).when(article.isNull(), "PROFILE_MISSING")


def canonical_packaging(profile: dict[str, Column], legacy: dict[str, Column], has_profile: Column) -> dict[str, Column]:
    """All of the article's packaging or all of the line's own, never a mix. Keys: box_type, stems_per_box, weight_kg; and
    packaging_source.
    """
    out = {k: F.when(has_profile, profile[k]).otherwise(legacy[k]) for k in ("box_type", "stems_per_box", "weight_kg")}
    return out | {"packaging_source": F.when(has_profile, "PROFILE").otherwise("LEGACY")}


def resolve_quantity(quantity: Column, unit: Column, boxes: Column, stems: Column) -> Column:
    """struct(ok, code, boxes, total_stems, source): whole boxes of a quantity. Stems must divide, bunches and kilograms can't
    be quoted, nothing is ever rounded or assumed.
    """
    stated = quantity.isNotNull()
    own = F.when((unit == "BOXES") & stated, "BOXES").when((unit == "STEMS") & stated, "STEMS").when(
        ~F.coalesce(unit.isin("BUNCHES", "KILOGRAMS"), F.lit(False)) & boxes.isNotNull(),
        "LEGACY_BOXES"
    )
    amount = F.when(own == "LEGACY_BOXES", boxes.cast("decimal(18,3)")).otherwise(quantity.cast("decimal(18,3)"))
    no_stems = stems.isNull() | (stems <= 0)
    code = (
        F.when(
            own.isNull(),
            F.when(unit == "BUNCHES", "BUNCHES_NOT_SUPPORTED").when(
                unit == "KILOGRAMS",
                "KILOGRAMS_NOT_SUPPORTED"
            ).otherwise("MISSING_QUANTITY")
        )
        .when(amount <= 0, "MISSING_QUANTITY")
        .when((own != "STEMS") & (amount != F.floor(amount)), "FRACTIONAL_BOXES")
        .when(no_stems, "MISSING_STEMS_PER_BOX")
        .when((own == "STEMS") & (amount % F.when(stems > 0, stems) != 0), "STEMS_NOT_DIVISIBLE")
    )
    n = F.when(own == "STEMS", amount / F.when(stems > 0, stems)).otherwise(amount).cast("long")
    fine = code.isNull()
    return F.struct(
        fine.alias("ok"), code.alias("code"), F.when(fine, n).alias("boxes"),
        F.when(fine, n * stems).cast("long").alias("total_stems"), F.when(fine, own).alias("source")
    )


def gating_code(c: dict[str, Column]) -> Column:
    """The first failure of a line that is to be quoted. c: exists, offer_status, match_status, article, line_farm,
    article_farm, price, currency, packaging_ok, quantity (resolve_quantity).
    """
    return (
        F.when(~c["exists"], "LINE_NOT_FOUND")
        .when(
            gate(c["offer_status"], c["match_status"], c["article"]).isNotNull(),
            gate(c["offer_status"], c["match_status"], c["article"])
        )
        .when(~F.coalesce(c["line_farm"] == c["article_farm"], F.lit(False)), "OTHER_SUPPLIER")
        .when(~F.coalesce(c["price"] > 0, F.lit(False)), "MISSING_FOB_PRICE")
        .when(c["currency"].isNull(), "MISSING_CURRENCY")
        .when(~c["packaging_ok"], "MISSING_STEMS_PER_BOX")
        .when(~c["quantity"]["ok"], c["quantity"]["code"])
    )


def all_or_nothing(lines: DataFrame, batch: str, code: str = "code") -> DataFrame:
    """lines with accepted: whether no line of the batch failed. The flag is aggregated and joined back, so a large batch isn't
    gathered in one task.
    """
    bad = lines.groupBy(F.col(batch).alias("_b")).agg(F.count(code).alias("_bad"))
    return lines.join(bad, F.col(batch).eqNullSafe(F.col("_b"))).select(*lines.columns, (F.col("_bad") == 0).alias("accepted"))


def totals(lines: DataFrame, quote: str = "quote_id", *more: Column) -> DataFrame:
    """Boxes, stems and value of each quote, and more aggregates; a line's price is its manual one, else the calculated one."""
    stems = F.col("stems_per_box").cast("long") * F.col("quantity_boxes").cast("long")
    price = F.coalesce("manual_price", "calculated_price").cast("decimal(12,6)")
    return lines.groupBy(quote).agg(
        F.sum(F.col("quantity_boxes").cast("long")).alias("total_boxes"), F.sum(stems).alias("total_stems"),
        F.sum(price * stems.cast("decimal(14,0)")).cast("decimal(28,6)").alias("total_value"), *more
    )


def numbered(quotes: DataFrame, existing: DataFrame, created: str = "created_at") -> DataFrame:
    """quotes with quote_number Q-yyyymmdd-NNNN, counted on from that day's existing quotes, in order of time and id."""
    day = F.date_format(created, "yyyyMMdd")
    before = existing.groupBy(day.alias("_day")).agg(F.count("*").alias("_before"))
    n = numbered_within(quotes.withColumn("_d", day), "_d", [created, "quote_id"], "_n").join(before, F.col("_d") == F.col("_day"), "left")
    return n.select(
        *quotes.columns,
        F.format_string("Q-%s-%04d", "_d", F.col("_n") + F.coalesce("_before", F.lit(0))).alias("quote_number")
    )


def snapshots(priced_lines: DataFrame) -> DataFrame:
    """What a quote freezes of each priced line: packaging, build-up, the rate's own currencies; blocked lines are left out.
    Prices are stored rounded.
    """
    d = lambda c: F.col(c).cast("decimal(12,6)").alias(c)
    keep = [c for c in ("quote_id", "line_id", "customer_id", "farm_id", "article_id") if c in priced_lines.columns]
    return priced_lines.where(F.size("issues") == 0).select(
        *keep, "incoterm", "box_type", "stems_per_box", "quantity_boxes",
        F.col("weight_kg").cast("decimal(10,3)").alias("weight_kg"), F.col("fob").cast("decimal(10,6)").alias("fob"),
        d("freight"), d("clearing_inspection"), d("handling"), d("other_costs"), d("cost_source"), d("cost_target"),
        "fx_base", "fx_quote", F.col("fx_rate").cast("decimal(12,6)").alias("fx_rate"),
        F.col("margin_pct").cast("decimal(6,3)").alias("margin_pct"),
        F.col("calculated_rounded").cast("decimal(12,6)").alias("calculated_price"),
        F.col("manual_price").cast("decimal(12,6)").alias("manual_price")
    )


def override_price(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """lines with the manual prices of overrides (quote_id, line_id, price); a null price clears one."""
    o = overrides.select(F.col("quote_id").alias("_q"), F.col("line_id").alias("_l"), F.col("price").alias("_p"), F.lit(True).alias("_hit"))
    j = lines.join(o, (F.col("quote_id") == F.col("_q")) & (F.col("line_id") == F.col("_l")), "left")
    return j.select(
        *[
            F.when(
                F.col("_hit"),
                F.col("_p").cast("decimal(12,6)")
            ).otherwise(F.col(c)).alias(c) if c == "manual_price" else F.col(c) for c in lines.columns
        ]
    )
