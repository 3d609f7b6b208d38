"""Enrichment and validation of parsed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import numbers as N
from ..functions import text as T
from .parse import length_spec


def effective_currency(explicit: Column, supplier_default: Column) -> Column:
    return F.coalesce(explicit, supplier_default)


def enriched(lines: DataFrame, articles: DataFrame) -> DataFrame:
    """Lines with what a single matched article fixes: packaging, product, variety, length.

    lines: article_id, quantity, boxes, box_type, stems_per_box, weight, product_group, variety, length_cm, price, currency,
    supplier_currency, warnings. In order: the quantity (stated, else boxes, else 1) is in boxes; the box type is normalised; the
    article's packaging replaces the line's; the currency falls back to the supplier's; stems are counted; warnings that
    are settled go.
    """
    a = articles.select(
        F.col("article_id").alias("_a"), F.col("box_type").alias("_box"), F.col("stems_per_box").alias("_stems"),
        F.col("box_weight").alias("_weight"), F.col("product_name").alias("_product"),
        F.col("variety").alias("_variety"), F.col("stem_length").alias("_len")
    )
    j = lines.join(a, F.col("article_id") == F.col("_a"), "left")
    hit = F.col("_a").isNotNull()
    spec = length_spec(F.col("_len"))
    quantity = F.coalesce(F.col("quantity").cast("double"), F.col("boxes").cast("double"), F.lit(1.0))
    j = j.withColumns(
        {
            "_q": quantity, "_s": F.when(hit, F.col("_stems")).otherwise(F.col("stems_per_box")),
            "_w": F.when(hit, F.col("_weight").cast("decimal(10,3)")).otherwise(F.col("weight").cast("decimal(10,3)")),
            "_c": effective_currency(F.col("currency"), F.col("supplier_currency"))
        }
    )
    stems = N.total_stems(F.col("_q"), F.lit("BOXES"), F.col("_s"))
    resolved = {
        "STEMS_PER_BOX": F.col("_s").isNotNull(), "BOX_WEIGHT": F.col("_w").isNotNull(),
        "PRICE": N.valid_fob(F.col("price")), "CURRENCY": F.col("_c").isNotNull(), "TOTAL_STEMS": stems.isNotNull()
    }
    new = {
        "quantity": F.col("_q"),
        "unit": F.lit("BOXES"),
        "box_type": F.when(hit, F.col("_box")).otherwise(T.import_box_type(F.col("box_type"))),
        "stems_per_box": F.col("_s"),
        "weight": F.col("_w"),
        "product_group": F.when(hit, F.col("_product")).otherwise(F.col("product_group")),
        "variety": F.when(hit, F.coalesce("_variety", "variety")).otherwise(F.col("variety")),
        "length_cm": F.when(hit & (spec["kind"] == "single"), spec["min"]).otherwise(F.col("length_cm")),
        "currency": F.col("_c"),
        "warnings": A.reconcile(F.col("warnings"), resolved),
        "total_stems": stems,
    }
    return j.select(*[new.pop(c).alias(c) if c in new else F.col(c) for c in lines.columns], *[v.alias(k) for k, v in new.items()])


def to_offer_lines(lines: DataFrame) -> DataFrame:
    """Parsed lines as they are kept: rose labels canonical, the currency USD if nothing else is known, boxes from whole
    quantities, and a snapshot of what was read.
    """
    shot = A.snapshot(
        raw_text=F.col("raw_text"), product_group=F.col("product_group"), variety=F.col("variety"),
        length_cm=F.col("length_cm"), quantity=F.col("quantity"), unit=F.col("unit"),
        stems_per_box=F.col("stems_per_box"), box_type=F.col("box_type"), box_weight=F.col("weight"),
        price=F.col("price"), currency=F.col("currency"), warnings=F.col("warnings")
    )
    return lines.withColumns(
        {
            "extracted_snapshot": shot,
            "product_group": T.rose_label(F.col("product_group")),
            "box_type": T.import_box_type(F.col("box_type")),
            "currency": F.coalesce("currency", F.lit("USD")),
            "boxes": F.coalesce(F.col("boxes"), N.boxes_available(F.col("quantity"), F.col("unit"))),
            "validation_warnings": A.clean_messages(F.col("warnings")),
            "match_status": F.lit("UNMATCHED"),
        }
    )


def finalization(c: dict[str, Column]) -> tuple[Column, Column]:
    """(errors, warnings) as codes, before an offer is confirmed. c: article, product_group, variety, price, currency, unit,
    length_cm, quantity, total_stems, boxes.
    """
    blank = lambda x: x.isNull() | (T.trimmed(x.cast("string")) == "")
    unit = F.coalesce(c["unit"], F.when(c["boxes"].isNotNull(), "BOXES"))
    quantity = F.coalesce(F.when(~blank(c["quantity"]), c["quantity"].cast("string")), c["boxes"].cast("string"))
    errors = F.array(
        F.when(blank(c["article"]), "NO_ARTICLE"),
        F.when(blank(c["product_group"]), "NO_PRODUCT_GROUP"),
        F.when(blank(c["variety"]), "NO_VARIETY"),
        F.when(~N.valid_fob(c["price"].cast("string")), "NO_FOB_PRICE"),
        F.when(blank(c["currency"]), "NO_CURRENCY"),
        F.when(unit.isNull(), "NO_UNIT"),
    )
    warnings = F.array(
        F.when(c["length_cm"].isNull(), "NO_LENGTH"),
        F.when(blank(quantity), "NO_QUANTITY").when(c["total_stems"].isNull(), "NO_TOTAL_STEMS")
    )
    return F.array_compact(errors), F.array_compact(warnings)


def line_messages(snapshot: Column, resolved: dict[str, Column], warnings: Column) -> Column:
    """Warnings shown with a line: those of the snapshot that are still open, then the current ones."""
    return A.merge_messages(A.reconcile(A.snapshot_warnings(snapshot), resolved), warnings)


def confirmable(lines: DataFrame, offer: str = "offer_id", errors: str = "errors") -> DataFrame:
    """Offers with n_lines, n_bad and whether they can be confirmed: a line at least, and none with errors."""
    return lines.groupBy(offer).agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.size(errors) > 0).alias("n_bad")
    ).withColumn("confirmable", F.col("n_bad") == 0)


def review_counts(lines: DataFrame, offer: str = "offer_id") -> DataFrame:
    """Lines of each offer by what they need: total, blocking, with warnings, unmatched, needing attention, ready. lines:
    errors, warnings, match_status.
    """
    blocking, warned, unmatched = F.size("errors") > 0, F.size("warnings") > 0, F.col("match_status") == "UNMATCHED"
    attention = blocking | warned | unmatched
    return lines.groupBy(offer).agg(
        F.count("*").alias("total"), F.count_if(blocking).alias("blocking"), F.count_if(warned).alias("warned"),
        F.count_if(unmatched).alias("unmatched"), F.count_if(attention).alias("needs_attention"),
        F.count_if(~attention).alias("ready")
    )


def _positive(amount: Column) -> Column:
    return F.coalesce(amount.try_cast("decimal(18,6)") > 0, F.lit(False))


def freight_input_code(amount: Column, currency: Column, unit: Column) -> Column:
    """The first thing wrong with a freight tariff's form: BAD_AMOUNT, NO_CURRENCY, NO_UNIT; null if nothing."""
    empty = lambda x: x.isNull() | (x == "")
    return F.when(~_positive(amount), "BAD_AMOUNT").when(empty(currency), "NO_CURRENCY").when(empty(unit), "NO_UNIT")


def cost_input_code(cost_type: Column, amount: Column, currency: Column, unit: Column) -> Column:
    """The same for a route cost, which needs a type first: NO_TYPE."""
    return F.when(cost_type.isNull() | (cost_type == ""), "NO_TYPE").otherwise(freight_input_code(amount, currency, unit))
