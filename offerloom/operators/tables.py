"""Cell grids (path, sheet, row, cells) to offer lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SHEET = ["path", "sheet"]
# What headers call the fields of an offer.
SYNONYMS = {
    "product": [
        "product", "productgroup", "product group", "flower", "item", "article", "artículo", "articulo", "producto",
        "description", "descripción", "descripcion"
    ],
    "color": ["color", "colour"],
    "variety": ["variety", "varieties", "varietal", "variedad", "cultivar"],
    "grade": ["grade", "quality", "grado"],
    "length": ["length", "stem length", "largo", "longitud"],
    "boxes": ["availability (qb)", "availability", "qb", "available", "boxes", "qty", "quantity", "cantidad", "disponible"],
    "stems": ["stems x qb", "stems per box", "stems/box", "stemsxqb", "stems x box"],
    "price": [
        "fob bta", "fob", "fob price", "fob usd", "fob per stem", "price", "unit price", "price per stem", "stem price",
        "precio", "precio tallo", "usd/stem"
    ],
}
# Headers that name the goods, and headers that name their trade; a header row has one of each.
ANCHORS = [
    "product", "productgroup", "product group", "flower", "item", "article", "artículo", "articulo", "producto",
    "variety", "varieties", "varietal", "variedad", "cultivar", "description", "descripción", "descripcion"
]
COMMERCIAL = [
    "price",
    "fob",
    "fob bta",
    "fob price",
    "fob usd",
    "fob per stem",
    "unit price",
    "price per stem",
    "stem price",
    "precio",
    "precio tallo",
    "usd/stem",
    "quantity", "qty", "available", "availability", "stems", "bunches", "boxes", "cantidad", "disponible",
    "length", "stem length", "largo", "longitud", "cm",
    "box", "box type", "packing", "pack", "qb", "hb", "fb", "stems per box", "weight", "kg",
]
# Headers of the one known sheet, and how many of them beside the description make it known.
KNOWN_HEADERS = {
    "packs left": "quantity",
    "pack quantity": "stems_per_box",
    "fust code": "box_type",
    "product description": "description",
    "stem length": "length",
    "stems per bunch": "stems_per_bunch",
    "box weight": "weight",
    "fob price usd": "price",
}
KNOWN_FIELDS = 4
SCAN_SYNONYMS, SCAN_ROWS = 10, 15


def plain(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.lower(T.trimmed(F.coalesce(c, F.lit("")))))


def blank(cell: Column) -> Column:
    return cell.isNull() | (T.trimmed(cell) == "")


def numeric(cell: Column) -> Column:
    return F.coalesce(T.trimmed(cell).rlike(r"^-?\d+([.,]\d+)?$"), F.lit(False))


def synonym_headers(grid: DataFrame, scan: int = SCAN_SYNONYMS) -> DataFrame:
    """path, sheet, header: the first of the leading rows with a cell that names the goods and one that names the trade."""
    words = lambda w: F.array(*(F.lit(x) for x in w))
    hit = F.arrays_overlap(plain(F.col("cells")), words(ANCHORS)) & F.arrays_overlap(plain(F.col("cells")), words(COMMERCIAL))
    return grid.where((F.col("row") < scan) & hit).groupBy(*SHEET).agg(F.min("row").alias("header"))


def scanned_headers(grid: DataFrame, scan: int = SCAN_ROWS) -> DataFrame:
    """The first of the leading rows that looks like a header: two cells, three in five of them words, and a number within the
    next three rows.
    """
    filled = F.filter("cells", lambda c: ~blank(c))
    wordy = F.size(F.filter(filled, lambda c: ~numeric(c)))
    following = Window.partitionBy(*SHEET).orderBy("row").rangeBetween(1, 3)
    g = grid.where(F.col("row") < scan + 3).select(
        *SHEET,
        "row",
        F.size(filled).alias("_n"),
        wordy.alias("_w"),
        F.exists(filled, numeric).alias("_num")
    )
    g = g.withColumn("_data", F.coalesce(F.max("_num").over(following), F.lit(False)))
    return g.where(
        (F.col("row") < scan) & (F.col("_n") >= 2) & (F.col("_w") >= 0.6 * F.col("_n")) & F.col("_data")
    ).groupBy(*SHEET).agg(F.min("row").alias("header"))


def range_rows(ref: Column) -> Column:
    """struct(first, last) of the rows of an A1 range, from 1; null if it is none."""
    pattern = r"(?i)^\$?[A-Z]+\$?(\d+):\$?[A-Z]+\$?(\d+)$"
    a, b = T.extract(T.trimmed(ref), pattern, 1).cast("int"), T.extract(T.trimmed(ref), pattern, 2).cast("int")
    return F.when((a >= 1) & (b >= a), F.struct(a.alias("first"), b.alias("last")))


def regions(grid: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """path, sheet, header, last, source: where a sheet's table is, by a named table, a header that looks like one, or one of
    known words.
    """
    ends = grid.groupBy(*SHEET).agg(F.max("row").alias("_end"))
    found = scanned_headers(grid).select(
        *SHEET, "header", F.lit(None).cast("int").alias("last"), F.lit(1).alias("_rank"),
        F.lit("scanned-header").alias("source")
    )
    found = found.union(
        synonym_headers(grid, SCAN_ROWS).select(*SHEET, "header", F.lit(None).cast("int"), F.lit(2), F.lit("synonym-header"))
    )
    if tables is not None:
        named = tables.withColumn("_r", range_rows(F.col("ref"))).join(ends, SHEET).where((F.col("_r.first") - 1 <= F.col("_end")))
        found = found.union(
            named.groupBy(*SHEET).agg(F.min_by(F.col("_r"), "name").alias("_r")).select(
                *SHEET,
                F.col("_r.first") - 1,
                F.col("_r.last") - 1,
                F.lit(0),
                F.lit("named-table")
            )
        )
    best = found.groupBy(*SHEET).agg(F.min_by(F.struct("header", "last", "source"), "_rank").alias("_b"))
    return best.join(ends, SHEET).select(
        *SHEET, F.col("_b.header").alias("header"), F.least(F.coalesce("_b.last", "_end"), F.col("_end")).alias("last"),
        F.col("_b.source").alias("source")
    )


def table_text(grid: DataFrame, where: DataFrame) -> DataFrame:
    """path, sheet, text: header and filled rows of each region, cells between bars."""
    rows = grid.join(where, SHEET).where(
        F.col("row").between(F.col("header"), F.col("last")) & ((F.col("row") == F.col("header")) | F.exists("cells", lambda c: ~blank(c)))
    )
    line = F.array_join(F.transform("cells", lambda c: T.trimmed(F.coalesce(c, F.lit("")))), " | ")
    return rows.groupBy(*SHEET).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("t")))), lambda x: x["t"]), "\n").alias("text")
    )


def _index(cells: Column, words: list[str]) -> Column:
    """The position from 1 of the first cell that is one of the words; null without one."""
    hits = F.transform(plain(cells), lambda c: c.isin(*words))
    return F.nullif(F.array_position(hits, True), F.lit(0)).cast("int")


def whole(c: Column) -> Column:
    return T.extract(F.regexp_replace(c, r"[^\d.-]", ""), r"^(-?\d+)").cast("int")


def columns_by_synonym(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below each header with the cells of known columns: product, color, variety, grade, length, boxes, stems, price."""
    h = grid.join(headers, SHEET).where(F.col("row") == F.col("header")).select(
        *SHEET,
        "header",
        *[_index(F.col("cells"), w).alias(f"_{f}") for f, w in SYNONYMS.items()]
    )
    rows = grid.join(h, SHEET).where((F.col("row") > F.col("header")) & F.exists("cells", lambda c: F.coalesce(c != "", F.lit(False))))
    return rows.select(*SHEET, "row", "cells", *[F.try_element_at("cells", F.col(f"_{f}")).alias(f) for f in SYNONYMS])


def parse_sheet(grid: DataFrame) -> DataFrame:
    """Offer lines of sheets with known headers; rows without a product are left out."""
    r = columns_by_synonym(grid, synonym_headers(grid)).where(~blank(F.col("product")))
    r = r.withColumn("_g", T.product_group(F.col("product"))).withColumns(
        {"_p": T.decimal_string(F.col("price")), "_s": whole(F.col("stems"))}
    )
    low = F.col("_p").isNull() | (F.coalesce("_s", F.lit(0)) == 0)
    clean = lambda c: F.nullif(T.trimmed(F.col(c)), F.lit("")).alias(c)
    return r.select(
        *SHEET, "row", F.array_join(
            F.transform("cells", lambda c: F.coalesce(c, F.lit(""))),
            " | "
        ).alias("raw_text"),
        F.col("_g.name").alias("product_group"),
        clean("color"),
        clean("variety"),
        clean("grade"),
        T.length_cm(F.col("length")).alias("length_cm"),
        F.lit("QB").alias("box_type"),
        whole(F.col("boxes")).alias("boxes"),
        F.col("_s").alias("stems_per_box"),
        F.col("_p").alias("price"),
        F.lit("USD").alias("currency"),
        F.when(low, "low").when(
            F.col("_g.recognized"),
            "high"
        ).otherwise("medium").alias("confidence"), (low | ~F.col("_g.recognized")).alias("needs_review"),
        F.array_compact(F.array(F.when(F.col("_p").isNull(), "PRICE_UNREADABLE"))).alias("warnings"),
    )


def known_columns(cells: Column) -> dict[str, Column]:
    return {field: _index(cells, [h]) for h, field in KNOWN_HEADERS.items()}


def known_rows(grid: DataFrame, where: DataFrame) -> DataFrame:
    """Rows of sheets of the known kind: a description and four other known headers. row_index counts described rows from 1."""
    cols = known_columns(F.col("cells"))
    others = sum((F.when(c.isNotNull(), 1).otherwise(0) for f, c in cols.items() if f != "description"), F.lit(0))
    h = grid.join(where, SHEET).where(F.col("row") == F.col("header")).select(
        *SHEET,
        "header",
        "last",
        others.alias("_others"),
        *[c.alias(f"_{f}") for f, c in cols.items()]
    )
    h = h.where(F.col("_description").isNotNull() & (F.col("_others") >= KNOWN_FIELDS))
    rows = grid.join(h, SHEET).where((F.col("row") > F.col("header")) & (F.col("row") <= F.col("last")))
    at = lambda f: F.nullif(T.trimmed(F.try_element_at("cells", F.col(f"_{f}"))), F.lit(""))
    r = rows.withColumn("description", at("description")).where("description is not null")
    index = F.row_number().over(Window.partitionBy(*SHEET).orderBy("row"))
    return r.select(
        *SHEET, index.alias("row_index"),
        F.array_join(F.transform("cells", lambda c: T.trimmed(F.coalesce(c, F.lit("")))), " | ").alias("raw_text"),
        "description", whole(at("quantity")).alias("quantity"), whole(at("stems_per_box")).alias("stems_per_box"),
        whole(at("stems_per_bunch")).alias("stems_per_bunch"), T.decimal_string(at("weight")).alias("weight"),
        T.decimal_string(at("price")).alias("price"), at("box_type").alias("box_type"),
        T.length_cm(at("length")).alias("length_cm")
    )


def description_list(rows: DataFrame) -> DataFrame:
    """path, sheet, text: `#n | description` for each row."""
    return rows.groupBy(*SHEET).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("row_index", "description"))),
                lambda x: F.concat(F.lit("#"), x["row_index"].cast("string"), F.lit(" | "), x["description"])
            ),
            "\n"
        ).alias("text")
    )


def row_tag(c: Column) -> Column:
    return T.extract(T.trimmed(c), r"^#(\d+)\s*\|").cast("int")


def merge_descriptions(rows: DataFrame, described: DataFrame) -> DataFrame:
    """Rows with what was read of their descriptions (path, sheet, raw_text with its row tag, position, product_group, variety,
    color, grade); the first of a tag counts.

    Numbers always come from the row. A row that nothing was read of has its whole description as product group and needs review.
    """
    d = described.withColumn("_tag", row_tag(F.col("raw_text"))).where("_tag is not null")
    d = d.groupBy(*SHEET, "_tag").agg(F.min_by(F.struct("product_group", "variety", "color", "grade"), "position").alias("_d"))
    j = rows.join(d.withColumnRenamed("_tag", "row_index"), [*SHEET, "row_index"], "left")
    found = F.col("_d").isNotNull()
    warnings = F.array_compact(
        F.array(
            F.when(~found, "DESCRIPTION_UNREAD"), F.when(F.col("stems_per_bunch").isNotNull(), "STEMS_PER_BUNCH_GIVEN"),
            F.when(F.col("price").isNull(), "PRICE_UNREADABLE")
        )
    )
    review = ~found | F.col("_d.product_group").isNull() | F.col("price").isNull() | (F.coalesce("stems_per_box", F.lit(0)) == 0)
    return j.select(
        *rows.columns,
        F.when(found, F.col("_d.product_group")).otherwise(T.product_group(F.col("description"))["name"]).alias("product_group"),
        F.col("_d.variety").alias("variety"), F.col("_d.color").alias("color"), F.col("_d.grade").alias("grade"),
        review.alias("needs_review"), warnings.alias("warnings")
    )
