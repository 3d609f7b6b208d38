"""What leaves the system: sheets as flat projections, and offer texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How currencies and incoterms are shown.
SYMBOLS, INCOTERMS = {"USD": "$", "EUR": "€"}, {"FOB": "FOB", "CFR": "C&F", "DDP": "DDP"}

CUSTOMER_COLUMNS = [
    "position", "product", "variety", "color", "grade", "stem_length", "treatment", "box_type", "stems_per_box",
    "quantity_boxes", "total_stems", "price", "currency", "incoterm", "origin", "supplier", "notes"
]


def mapped(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in table.items()), c)


def final_price(lines: DataFrame) -> Column:
    return F.round(F.coalesce("manual_price", "calculated_price").cast("decimal(12,6)"), 2).cast("decimal(12,2)")


def customer_sheet(lines: DataFrame) -> DataFrame:
    """One row a quote line, without costs or margins. Variant fields (v_*) come before what the supplier wrote; columns that a
    table lacks are empty.
    """
    has = lambda c: F.col(c) if c in lines.columns else F.lit(None).cast("string")
    pick = lambda a, b: F.coalesce(has(a), has(b))
    new = {
        "product": pick("v_product", "product_group"),
        "variety": pick("v_variety", "variety"),
        "color": pick("v_color", "color"),
        "grade": pick("v_grade", "grade"),
        "stem_length": pick("v_stem_length", "stem_length"),
        "total_stems": F.col("stems_per_box").cast("long") * F.col("quantity_boxes").cast("long"),
        "price": final_price(lines),
    }
    return lines.select("quote_id", *[new.get(c, has(c)).alias(c) for c in CUSTOMER_COLUMNS])


def internal_sheet(lines: DataFrame) -> DataFrame:
    """The cost build-up of each quote line; what isn't clearing or handling is other, never below zero; a line's rate comes
    before the quote's.
    """
    rest = F.greatest(
        F.lit(0).cast("decimal(18,6)"),
        (F.col("additional") - F.col("clearing_inspection") - F.col("handling")).cast("decimal(18,6)")
    )
    return lines.select(
        "quote_id", "line_id", "incoterm", "stems_per_box", "quantity_boxes", "weight_kg", "fob", "freight",
        "clearing_inspection", "handling", rest.alias("other"), "cost_source", "source_currency",
        F.coalesce("fx_rate", "quote_fx_rate").alias("fx_rate"), "cost_target", "margin_pct", "calculated_price",
        "manual_price", final_price(lines).alias("final_price")
    )


# The headings of the two workbooks.
CUSTOMER_HEADINGS = [
    "Productgroep", "Product", "Variëteit", "Lengte", "Kleur", "Kwaliteit", "Behandeling", "Box type", "Stelen/doos", "Dozen",
    "Totaal stelen", "Prijs per steel", "Valuta", "Incoterm", "Herkomst", "Bestemming", "Opmerkingen",
]
INTERNAL_HEADINGS = [
    "Product", "Leverancier", "Dozen", "Stelen/doos", "Totaal stelen", "Incoterm", "FOB/steel", "Vracht/steel",
    "Clearing & Inspection/steel", "Handling/steel", "Overige kosten/steel", "Kostprijs/steel (bron)", "Bronvaluta", "Doelvaluta",
    "Wisselkoers", "Koers handmatig", "Kostprijs/steel (offertevaluta)", "Marge %", "Berekende verkoopprijs", "Handmatige prijs",
    "Definitieve verkoopprijs",
]
#: Columns of the workbooks that hold numbers, and prices of two decimals.
CUSTOMER_NUMBERS, CUSTOMER_PRICES, INTERNAL_NUMBERS = [8, 9, 10], [11], [2, 3, 4, *range(6, 12), 14, *range(16, 21)]


def _sheet_rows(
    lines: DataFrame,
    headings: list[str],
    cells: list[Column],
    first: int,
    sheet: Column,
    above: dict[int, Column]
) -> DataFrame:
    """(path, sheet, row, cells): what stands above, the headings in the row before `first`, then the lines by position.

    The rows of a path come in one partition.
    """
    of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = F.row_number().over(Window.partitionBy("_path").orderBy("position"))
    heads = above | {first - 1: F.array(*map(F.lit, headings))}
    entry = lambda r, c: F.struct(r.cast("int").alias("row"), c.cast("array<string>").alias("cells"))
    own = entry(F.col("_line") + first - 1, F.array(*map(of, cells)))
    # a sheet's first line also brings what stands above it, so that the lines are made once
    rows = F.when(F.col("_line") == 1, F.array(*(entry(F.lit(r), c) for r, c in heads.items()), own)).otherwise(F.array(own))
    dealt = lines.withColumn("_path", F.col("quote_id").cast("string")).withColumn("_line", line)
    each = dealt.select(F.col("_path").alias("path"), sheet.alias("sheet"), F.explode(rows).alias("_r"))
    return each.select("path", "sheet", "_r.row", "_r.cells")


def customer_workbook(lines: DataFrame) -> DataFrame:
    """Rows of one sheet a quote for customers: a title, places and currency, headings in the fifth row, then the lines.

    lines: quote_id, position, those of customer_sheet, and the quote's quote_number, customer_name, currency, incoterm, origin_country,
    origin_city and destination_city; columns that are missing are empty.
    """
    has = lambda c: F.col(c).cast("string") if c in lines.columns else F.lit(None).cast("string")
    pick = lambda *cs: F.coalesce(*map(has, cs))
    shown = lambda c, empty="": F.coalesce(has(c), F.lit(empty))
    cells = [
        pick(
            "v_product_group",
            "product_group"
        ),
        pick("v_product",
        "product_group"),
        pick("v_variety",
        "variety"),
        pick("v_stem_length",
        "stem_length"),
        pick("v_color",
        "color"),
        pick("v_grade",
        "grade"),
        has("treatment"),
        has("box_type"), has("stems_per_box"), has("quantity_boxes"), F.col("stems_per_box").cast("long") * F.col("quantity_boxes").cast("long"), pick(
            "manual_price",
            "calculated_price"
        ),
        has("currency"), has("incoterm"), has("origin_city"), has("destination_city"), has("notes"),
    ]
    title = F.concat(F.lit("Aanbieding "), shown("quote_number"), F.lit(" - "), shown("customer_name"))
    places = F.concat(
        F.lit("Herkomst: "), shown("origin_country", "-"), F.lit("  |  Levering: "), shown("incoterm"), F.lit(" "),
        shown("destination_city"), F.lit("  |  Valuta: "), shown("currency")
    )
    sheet = F.substring(F.concat(F.lit("Offerte "), shown("quote_number")), 1, 31)
    return _sheet_rows(lines, CUSTOMER_HEADINGS, cells, 5, sheet, {0: F.array(title), 2: F.array(places)})


def internal_workbook(lines: DataFrame) -> DataFrame:
    """Rows of one sheet a quote with costs, margin and rates; never for customers. Columns that are missing are empty, missing costs are 0.

    lines: quote_id, position, product columns, supplier, fob, freight, clearing_inspection, handling, additional, cost_source,
    source_currency,
    fx_rate, fx_base, fx_quote (and the quote's, quote_fx_*), fx_note, currency, incoterm, cost_target, margin_pct,
    calculated_price, manual_price.
    """
    has = lambda c: F.col(c).cast("string") if c in lines.columns else F.lit(None).cast("string")
    cost = lambda c: F.coalesce(has(c).cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    rate = lambda c: F.coalesce(has(f"fx_{c}"), has(f"quote_fx_{c}"))
    named = F.nullif(
        F.concat_ws(" - ", *(F.nullif(has(c), F.lit("")) for c in ("v_product", "v_variety", "v_color", "v_grade", "v_stem_length"))),
        F.lit("")
    )
    converts = rate("rate").isNotNull()
    rest = F.greatest(
        F.lit(0).cast("decimal(18,6)"),
        (cost("additional") - cost("clearing_inspection") - cost("handling")).cast("decimal(18,6)")
    )
    cells = [
        F.when(
            has("v_product").isNotNull(),
            named
        ).otherwise(has("product_group")),
        has("supplier"),
        has("quantity_boxes"),
        has("stems_per_box"),
        F.col("stems_per_box").cast("long") * F.col("quantity_boxes").cast("long"),
        has("incoterm"),
        has("fob"),
        cost("freight"),
        cost("clearing_inspection"),
        cost("handling"),
        rest,
        has("cost_source"),
        F.when(converts, rate("base")).otherwise(has("source_currency")),
        F.when(converts, rate("quote")).otherwise(has("currency")),
        rate("rate"), F.when(converts, has("fx_note")), has("cost_target"), has("margin_pct"), has("calculated_price"), has("manual_price"), F.coalesce(
            has("manual_price"),
            has("calculated_price")
        ),
    ]
    return _sheet_rows(lines, INTERNAL_HEADINGS, cells, 1, F.lit("Interne calculatie"), {})


def product_label(lines: DataFrame) -> Column:
    """Colour, variety, grade and length of the variant, else the product group, else the line's first 40 characters; and a
    treatment that isn't normal.
    """
    parts = F.nullif(
        F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("v_color", "v_variety", "v_grade", "v_stem_length"))),
        F.lit("")
    )
    base = F.coalesce(parts, F.col("v_product"), F.col("product_group"), F.substring("raw_text", 1, 40))
    return F.when(F.lower("treatment") != "normal", F.concat(base, F.lit(" ("), F.col("treatment"), F.lit(")"))).otherwise(base)


def offer_text(lines: DataFrame, *, style: str = "message") -> DataFrame:
    """quote_id and its text: a heading for each product group, in the order of first appearance, and its lines under it.

    lines: quote_id, position, product columns of product_label, box_type, stems_per_box, prices, and the quote's quote_number, currency,
    incoterm, origin_country, destination_city, valid_until, contact. style: message (for chats) or mail.
    """
    message = style == "message"
    group = F.coalesce("v_product", "product_group", F.lit("Other"))
    symbol = mapped(F.col("currency"), SYMBOLS)
    stems = F.concat(F.col("stems_per_box").cast("string"), F.lit(" stems/"), F.coalesce("box_type", F.lit("box")))
    line = F.concat(
        F.lit("• " if message else "  - "), product_label(lines), F.lit(" - "), stems, F.lit(" - "), symbol,
        final_price(lines).cast("string"), F.lit(" per stem")
    )
    quote = ["quote_id", "quote_number", "currency", "incoterm", "origin_country", "destination_city", "valid_until", "contact"]
    grouped = lines.select(*quote, group.alias("_g"), "position", line.alias("_l")).groupBy(*quote, "_g").agg(
        F.min("position").alias("_p"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_l"))), lambda x: x["_l"]), "\n").alias("_lines")
    )
    head = F.concat(F.lit("*"), F.col("_g"), F.lit("*")) if message else F.concat(F.col("_g"), F.lit(":"))
    whole = grouped.groupBy(*quote).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_p", F.concat(head, F.lit("\n"), F.col("_lines")).alias("t")))),
                lambda x: x["t"]
            ),
            "\n\n"
        ).alias("_body")
    )
    delivery = F.concat_ws(" ", mapped(F.col("incoterm"), INCOTERMS), F.col("destination_city"))
    until = F.coalesce(F.date_format("valid_until", "d-M-yyyy"), F.lit("further notice"))
    origin = F.coalesce("origin_country", F.lit("-"))
    if message:
        text = F.concat(
            F.lit("*Fresh Offer - "), F.col("quote_number"), F.lit("*\nOrigin: "), origin, F.lit("\nDelivery: "),
            delivery, F.lit("\nCurrency: "), F.col("currency"), F.lit("\n\n"), F.col("_body"),
            F.lit("\n\nAvailability subject to confirmation.\nPrices valid until "), until, F.lit(".")
        )
    else:
        text = F.concat(
            F.lit("Subject: Flower offer "), F.col("quote_number"), F.lit(" - "), delivery, F.lit("\n\nDear "),
            F.coalesce("contact", F.lit("customer")), F.lit(",\n\nOrigin "), origin, F.lit(", delivery "), delivery,
            F.lit(", prices in "), F.col("currency"), F.lit(".\n\n"), F.col("_body"),
            F.lit("\n\nAvailability subject to confirmation. Prices valid until "), until, F.lit(".")
        )
    return whole.select("quote_id", text.alias("text"))


def quote_graph(
    quotes: DataFrame, customers: DataFrame, locations: DataFrame, lines: DataFrame, articles: DataFrame,
    farms: DataFrame
) -> DataFrame:
    """Quote lines with all that exports show of quote, customer, places, article and farm."""
    place = lambda p: locations.select(
        F.col("location_id").alias(f"_{p}"),
        F.col("country").alias(f"{p}_country"),
        F.col("city").alias(f"{p}_city")
    )
    q = quotes.join(customers.select("customer_id", F.col("customer_name").alias("contact")), "customer_id")
    q = q.join(place("origin"), F.col("origin_id") == F.col("_origin"), "left").join(
        place("destination"),
        F.col("destination_id") == F.col("_destination"),
        "left"
    )
    a = articles.select(
        "article_id", F.col("product_name").alias("v_product"), F.col("variety").alias("v_variety"),
        F.col("stem_length").alias("v_stem_length")
    )
    return lines.join(q, "quote_id").join(a, "article_id", "left").join(
        farms.select("farm_id", F.col("farm_name").alias("supplier")),
        "farm_id",
        "left"
    ).drop("_origin", "_destination")
