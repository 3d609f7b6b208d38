"""Offer texts to structured lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import S, extract

# Lines that are never offers (greetings, closings, mail headers, page numbers, links).
NOISE = [
    rf"(?i)^(hi|hello|dear|hey|buenos|good{S}+(morning|afternoon|evening))\b",
    r"(?i)^(regards|best regards|kind regards|sincerely|thank you|thanks|saludos|atentamente)\b",
    rf"(?i)^(from|sent|to|subject|cc|bcc){S}*:",
    r"^\d+$",
    r"(?i)^(let me know|following up|if you.?re looking|our farm team)",
    r"(?i)^www\.|^https?://",
]
# What makes a line a product line, and a price-tier line.
SIGNALS = [
    rf"(?i)\d{{1,3}}{S}*-{S}*\d{{1,3}}{S}*cm",
    rf"(?i)\d{{1,3}}{S}*cm",
    rf"\b\d{{2,3}}{S}*[-–—]{S}*\d{{2,3}}\b",
    rf"(?i)\b\d+{S}*(?:qb|hb|fb)\b",
    rf"(?i)\b(?:qb|hb|fb){S}*[x×*]{S}*\d+\b",
    r"\d+[.,]\d{1,3}\b",
]
TIER = rf"(?i)^{S}*(\d{{1,3}}){S}*cm\b{S}*[:=]?{S}*[$€]?{S}*(\d+(?:[.,]\d+)?){S}*(?:usd|eur|\$|€)?{S}*$"
RANGE = rf"(?i)(\d{{1,3}}(?:[.,]\d+)?){S}*(?:-|–|—|/|\bto\b|\ba\b){S}*(\d{{1,3}}(?:[.,]\d+)?)"
ROW_RANGE = rf"(?i)\b(\d{{2,3}}){S}*[-–—]{S}*(\d{{2,3}}){S}*(?:cm)?\b"
PRICE = rf"[$€]{S}*([\d.,]+)"
VARIANT = rf"(?i)^([a-z]+)\b[{T.SPACES}:]*[$€]?{S}*([\d.,]+)?"


def any_of(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def numbered_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each line of a text: line_no from 0 and line."""
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def offer_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines that look like offers: two words and a dollar price or boxes, and no noise. Null texts have none."""
    line = F.col("line")
    product = (line.rlike(rf"\$\s*[\d.,]+") | line.rlike(T.BOX)) & line.rlike(f"[^{T.SPACES}]{S}+[^{T.SPACES}]")
    return numbered_lines(docs, text).withColumn("line", T.trimmed(line)).where((line != "") & ~any_of(line, NOISE) & product)


def parse_offer_line(lines: DataFrame, line: str = "line") -> DataFrame:
    """Each line's base offer and one more offer for each price variant behind a bar.

    Added: variant_no (0: the base), product_group, variety, grade, treatment, box_type, boxes, stems_per_box, price (decimal
    string), currency, lead_time_hours, confidence, needs_review, warnings (codes). A variant has the base's fields, its
    own treatment and price and no warnings; one that can't be read leaves VARIANT_UNREADABLE with the base. A
    line without content is one offer of low confidence with the warning LINE_UNREADABLE; a null line gives none.
    """
    # what is used several times is a column of its own, so that it is made once
    found = lines.where(F.col(line).isNotNull()).withColumn("_raw", T.trimmed(F.col(line)))
    bare = T.trimmed(F.regexp_replace("_raw", rf"(?i)\({S}*additional{S}+time{S}+required[^)]*\)", ""))
    parts = F.filter(F.transform(F.split(bare, r"\|"), T.trimmed), lambda s: s != "")
    found = found.withColumns({"_parts": parts, "lead_time_hours": T.lead_time_hours(F.col("_raw"))})
    found = found.withColumn("_base", F.try_element_at("_parts", F.lit(1)))
    found = found.withColumns({"_box": T.box_pattern(F.col("_base")), "_priced": extract(F.col("_base"), PRICE, 0)})
    found = found.withColumn("_name", T.without_first(F.col("_base"), F.coalesce("_box.matched", F.lit("\u0000")), " "))
    found = found.withColumn("_name", T.collapsed(T.without_first(F.col("_name"), F.coalesce("_priced", F.lit("\u0000")), " ")))
    found = found.withColumn("grade", T.grade(F.col("_name")))
    at = F.regexp_instr("_name", F.concat(F.lit(r"(?i)\b"), F.col("grade"), F.lit(r"\b")))
    ungraded = F.concat(F.substring("_name", F.lit(1), at - 1), F.substring("_name", at + F.length("grade"), F.length("_name")))
    rest = F.when(F.col("grade").isNotNull(), T.trimmed(ungraded)).otherwise(F.col("_name"))
    words = F.filter(F.split(rest, f"{S}+"), lambda w: w != "")
    found = found.withColumn("_words", words)
    first = F.try_element_at("_words", F.lit(1))
    group = T.product_group(first)
    found = found.withColumns(
        {
            "_group": F.when(first.isNotNull(), group),
            "variety": F.nullif(F.array_join(F.slice("_words", 2, 1 << 30), " "), F.lit("")),
            "_price": T.decimal_string(extract(F.col("_base"), PRICE))
        }
    )

    def variant(s: Column) -> Column:
        price = T.decimal_string(extract(s, VARIANT, 2))
        return F.struct(F.lower(extract(s, VARIANT, 1)).alias("treatment"), price.alias("price"))

    found = found.withColumn("_variants", F.transform(F.slice("_parts", 2, 1 << 30), variant))
    found = found.withColumn("_good", F.filter("_variants", lambda v: v["price"].isNotNull() & v["treatment"].isNotNull()))
    variants, good = F.col("_variants"), F.col("_good")
    offers = F.when(
        F.size("_parts") > 0,
        F.concat(F.array(F.struct(F.lit("normal").alias("treatment"), F.col("_price").alias("price"))), good)
    ).otherwise(F.array(F.struct(F.lit("normal").alias("treatment"), F.lit(None).cast("string").alias("price"))))
    known = F.coalesce(F.col("_group.recognized"), F.lit(False))
    readable = F.size("_parts") > 0
    confidence = F.when(~readable | F.col("_box").isNull() | F.col("_price").isNull(), "low").when(~known, "medium").otherwise("high")
    warnings = F.array_compact(
        F.array(
            F.when(~readable, "LINE_UNREADABLE"),
            F.when(readable & F.col("_price").isNull(), F.when(F.col("_base").rlike(PRICE), "PRICE_UNREADABLE").otherwise("PRICE_MISSING")),
            F.when(readable & F.col("_box").isNull(), "BOX_MISSING"),
            F.when(F.size(good) < F.size(variants), "VARIANT_UNREADABLE"),
        )
    )
    keep = [c for c in lines.columns]
    out = found.select(
        *keep, "lead_time_hours", "grade", "variety", "_group", "_box", "_base", confidence.alias("confidence"),
        warnings.alias("_warnings"),
        (~readable | F.col("_box").isNull() | F.col("_price").isNull() | ~known).alias("needs_review"),
        F.posexplode(offers).alias("variant_no", "_offer")
    )
    return out.select(
        *keep,
        "variant_no",
        F.nullif(F.col("_group.name"), F.lit("")).alias("product_group"),
        "variety",
        "grade",
        F.col("_offer.treatment").alias("treatment"),
        F.when(F.col("_box").isNotNull(), T.box_type(F.col("_base"))).alias("box_type"),
        F.col("_box.boxes").alias("boxes"),
        F.col("_box.stems").alias("stems_per_box"),
        F.col("_offer.price").alias("price"),
        F.when(F.col("_base").isNotNull(), F.when(F.col("_base").contains("€"), "EUR").otherwise("USD")).alias("currency"),
        "lead_time_hours",
        "confidence",
        "needs_review",
        F.when(F.col("variant_no") == 0, F.col("_warnings")).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def line_class(c: Column) -> Column:
    """C: a price tier; B: a product line; A: anything else, as is every line without a digit."""
    return F.when(~c.rlike("[0-9]"), "A").when(price_tier(c).isNotNull(), "C").when(~c.rlike("[A-Za-z]{2,}"), "A").when(any_of(c, SIGNALS), "B").otherwise("A")


def price_tier(c: Column) -> Column:
    """struct(length, price) of a line that is nothing but a length and its price."""
    length, price = extract(c, TIER, 1).cast("int"), T.decimal_string(extract(c, TIER, 2))
    return F.when(c.rlike(TIER) & (length > 0) & price.isNotNull(), F.struct(length.alias("length"), price.alias("price")))


def shared_price_table(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, length, price: of tiers of one length the last line counts."""
    lines = numbered_lines(docs.select(key, text), text).select(key, "line_no", price_tier(F.col("line")).alias("t")).where("t is not null")
    return lines.groupBy(key, F.col("t.length").alias("length")).agg(F.max_by("t.price", "line_no").alias("price"))


def length_spec(c: Column) -> Column:
    """struct(kind, min, max): none, single or range (two different numbers)."""
    a, b = T.length_cm(extract(c, RANGE, 1)), T.length_cm(extract(c, RANGE, 2))
    ranged = a.isNotNull() & b.isNotNull() & (a != b)
    single = T.length_cm(c)
    return F.struct(
        F.when(F.coalesce(ranged, F.lit(False)), "range").when(single.isNotNull(), "single").otherwise("none").alias("kind"),
        F.when(F.coalesce(ranged, F.lit(False)), F.least(a, b)).otherwise(single).alias("min"),
        F.when(F.coalesce(ranged, F.lit(False)), F.greatest(a, b)).otherwise(single).alias("max"),
    )


def has_length_range(c: Column) -> Column:
    """Whether a whole row names two different lengths of two or three digits; dates such as 08-07 count too."""
    a, b = extract(c, ROW_RANGE, 1).cast("int"), extract(c, ROW_RANGE, 2).cast("int")
    return F.coalesce(a != b, F.lit(False))


def stale_range_warning(warning: Column, spec: Column) -> Column:
    """A warning about this range's price, which the price table has settled."""
    w = F.lower(warning)
    return F.contains(w, F.lower(spec)) & w.rlike("prijs|price")


def expand_length_ranges(lines: DataFrame, tiers: DataFrame, doc: str, line: str) -> DataFrame:
    """Lines priced by their document's price table (tiers: doc, length, price).

    lines: doc, line (a key), length_raw, price, warnings. A range becomes one row for each tier within it; the first
    has the warnings for ends that have no tier. A range without tiers stays one row without length and price. A single
    length gets its tier's price if it has none. Documents without a table are left alone. child_no counts from 0.
    """
    spec = length_spec(F.col("length_raw"))
    known = tiers.select(F.col(doc).alias("_doc"), F.col("length").cast("double").alias("_length"), F.col("price").alias("_tier_price"))
    ends = known.groupBy("_doc").agg(F.collect_set("_length").alias("_lengths"))
    base = lines.withColumn("_spec", spec).join(ends.withColumnRenamed("_doc", "_d"), F.col(doc) == F.col("_d"), "left").drop("_d")
    hit = base.join(
        known,
        (F.col(doc) == F.col("_doc")) & (F.col("_spec.kind") != "none") & F.col("_length").between(F.col("_spec.min"), F.col("_spec.max")),
        "left"
    )
    order = Window.partitionBy(doc, line).orderBy("_length")
    ranged = (F.col("_spec.kind") == "range") & F.col("_lengths").isNotNull()
    single = (F.col("_spec.kind") == "single") & F.col("_lengths").isNotNull()
    child = F.row_number().over(order) - 1
    missing = F.filter(F.array(F.col("_spec.min"), F.col("_spec.max")), lambda e: ~F.array_contains("_lengths", e))
    end_codes = F.transform(missing, lambda e: F.concat(F.lit("END_WITHOUT_TIER:"), e.cast("int").cast("string")))
    kept = F.filter("warnings", lambda w: ~stale_range_warning(w, F.col("length_raw")))
    no_tier = F.col("_length").isNull()
    warnings = (
        F.when(ranged & no_tier, F.concat("warnings", F.array(F.lit("RANGE_OUTSIDE_TABLE"))))
        .when(ranged & (F.col("child_no") == 0), F.concat(kept, end_codes))
        .when(ranged, kept)
        .when(single & F.col("price").isNull() & no_tier, F.concat("warnings", F.array(F.lit("LENGTH_NOT_IN_TABLE"))))
        .when(single & F.col("price").isNull(), kept)
        .otherwise(F.col("warnings"))
    )
    return hit.withColumn("child_no", child).select(
        *[c for c in lines.columns if c not in ("price", "warnings")],
        "child_no",
        F.when(ranged, F.col("_length")).when(single, F.col("_spec.min")).alias("length_cm"),
        F.when(ranged, F.col("_tier_price")).when(single, F.coalesce("price", "_tier_price")).otherwise(F.col("price")).alias("price"),
        warnings.alias("warnings"),
    )


# How much of a text goes into one extraction call.
CHUNK_ROWS, CHUNK_BYTES, SINGLE_ROWS, SINGLE_BYTES = 22, 12_000, 30, 12_000


def chunk_bounds(products: np.ndarray, size: np.ndarray, heading: np.ndarray) -> list[dict[str, int]]:
    """The chunks of one text's lines: begin, end, title (the last heading up to begin, -1 without) and rows (product rows).

    Running sums of product rows and bytes grow with the lines: the line that fills a chunk is looked up in both, one search a chunk.
    """
    rows, held = np.cumsum(products), np.cumsum(size)
    title = np.maximum.accumulate(np.where(heading, np.arange(len(size)), -1))
    out, begin = [], 0
    while begin < len(size):
        before = (int(rows[begin - 1]), int(held[begin - 1])) if begin else (0, 0)
        last = min(np.searchsorted(rows, before[0] + CHUNK_ROWS), np.searchsorted(held, before[1] + CHUNK_BYTES))
        end = min(int(last) + 1, len(size))
        n = int(rows[end - 1]) - before[0]
        if last >= len(size) and n == 0 and out:
            out[-1]["end"] = end
        else:
            out.append({"begin": begin, "end": end, "title": int(title[begin]), "rows": n})
        begin = end
    return out


def _bounds(marks: pa.Array, sizes: pa.Array) -> pa.Array:
    found = []
    for m, n in zip(marks.to_pylist(), sizes):
        if m is None:
            found.append(None)
            continue
        kind = np.frombuffer(m.encode(), np.uint8)
        found.append(chunk_bounds(kind == ord("B"), n.values.to_numpy(zero_copy_only=False), kind == ord("H")))
    one = pa.struct([(c, pa.int32()) for c in ("begin", "end", "title", "rows")])
    return pa.array(found, pa.list_(one))


def chunk_offers(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, chunk, total, body, header, section, price_lines, product_rows: texts cut for extraction.

    A text of at most 30 product rows and 12,000 bytes is one chunk as it is. Else a chunk ends with its 22nd product row or once it
    has 12,000 bytes; what precedes the first product row is the header of every chunk, price tiers are shared by all,
    and the last section heading before a chunk goes with it. A last chunk that is not full and has no product row goes with
    the one before it. Null texts have no chunks; keys must be unique.
    """
    raws = lambda c: F.array_join(F.transform(c, lambda x: x["raw"]), "\n")
    heading = lambda s: ~s.rlike(r"\d") & s.rlike("[A-Za-z]{2,}") & (F.size(F.split(T.trimmed(s), f"{S}+", 5)) <= 4)
    parsed = lambda s: F.struct(
        s.alias("raw"),
        line_class(s).alias("kind"),
        (F.octet_length(s) + 1).cast("long").alias("bytes")
    )
    # every text is split, classified and cut where it stands: each step is a column of its own, so that none is computed twice
    df = docs.select(key, F.col(text).alias("_text")).where(F.col("_text").isNotNull()).repartition(key)
    df = df.withColumn("_lines", F.transform(F.split("_text", r"\r?\n"), parsed))
    df = df.withColumns(
        {
            "_rows": F.size(F.filter("_lines", lambda x: x["kind"] == "B")),
            "_tiers": raws(F.filter("_lines", lambda x: x["kind"] == "C")),
            "_rest": F.filter("_lines", lambda x: x["kind"] != "C"),
        }
    )
    df = df.withColumn("_first", F.array_position(F.transform("_rest", lambda x: x["kind"]), "B").cast("int"))
    df = df.withColumn(
        "_one",
        ((F.col("_rows") <= SINGLE_ROWS) & (F.octet_length("_text") <= SINGLE_BYTES)) | (F.col("_first") == 0)
    )
    df = df.withColumn("_body", F.when(~F.col("_one"), F.slice("_rest", F.col("_first"), F.size("_rest"))))
    mark = lambda x: F.when((x["kind"] == "A") & heading(x["raw"]), "H").otherwise(x["kind"])
    df = df.withColumns({"_marks": F.array_join(F.transform("_body", mark), ""), "_bytes": F.transform("_body", lambda x: x["bytes"])})
    bounds = F.arrow_udf(_bounds, "array<struct<begin:int,end:int,title:int,rows:int>>")
    df = df.withColumn("_cuts", bounds("_marks", "_bytes"))
    nothing = F.lit(None).cast("string")

    def chunk(x: Column, i: Column) -> Column:
        top = F.col("_body")[x["begin"]]["raw"]
        title = F.when(x["title"] >= 0, F.col("_body")[x["title"]]["raw"])
        return F.struct(
            i.alias("chunk"),
            raws(F.slice("_body", x["begin"] + 1, x["end"] - x["begin"])).alias("body"),
            F.when(T.trimmed(top) == T.trimmed(title), nothing).otherwise(title).alias("section"),
            x["rows"].alias("product_rows")
        )

    whole = F.struct(F.lit(0).alias("chunk"), F.col("_text").alias("body"), nothing.alias("section"), F.col("_rows").alias("product_rows"))
    return df.select(
        key,
        F.when(F.col("_one"), 1).otherwise(F.size("_cuts")).alias("total"),
        F.when(F.col("_one"), "").otherwise(raws(F.slice("_rest", F.lit(1), F.greatest(F.col("_first") - 1, F.lit(0))))).alias("header"),
        F.when(F.col("_one"), "").otherwise(F.col("_tiers")).alias("price_lines"),
        F.explode(F.when(F.col("_one"), F.array(whole)).otherwise(F.transform("_cuts", chunk))).alias("_c")
    ).select(key, "_c.chunk", "total", "_c.body", "header", "_c.section", "price_lines", "_c.product_rows")


def assortment_paste(lines: DataFrame, line: str = "line") -> DataFrame:
    """Rows of supplier, article, length, box, stems, weight; incomplete ones and the header are left out."""
    c = T.cells(F.col(line))
    at = lambda i: F.nullif(F.try_element_at("_c", F.lit(i)), F.lit(""))
    stems = extract(at(5), r"^([+-]?\d+)").cast("int")
    # exploded, so that the conditions on cells don't cut the line anew
    rows = lines.select("*", F.explode(F.array(c)).alias("_c")).where((F.size("_c") >= 6) & (F.lower(F.col("_c")[0]) != "leverancier"))
    out = rows.select(
        *lines.columns, at(1).alias("supplier"), at(2).alias("article"), at(3).alias("stem_length"),
        F.coalesce(at(4), F.lit("QB")).alias("box_type"), stems.alias("stems_per_box"), at(6).alias("weight")
    )
    return out.where("supplier is not null and article is not null and stems_per_box > 0 and weight is not null")


def farm_paste(lines: DataFrame, default_country: str, line: str = "line") -> DataFrame:
    """Rows of country and name, or a name alone; the header and incomplete rows are left out."""
    c = F.col("_c")
    header = (F.lower(c[0]) == "land") | (
        F.lower(c[0]).isin("naam", "leverancier", "kweker") & (F.coalesce(F.try_element_at(c, F.lit(2)), F.lit("")) == "")
    )
    rows = lines.withColumn("_c", T.cells(F.col(line))).where(~header)
    several = F.size(c) >= 2
    name = F.when(several, T.trimmed(F.array_join(F.slice(c, 2, 1 << 30), " "))).otherwise(c[0])
    country = F.coalesce(F.when(several, F.nullif(c[0], F.lit(""))), F.nullif(F.lit(default_country.strip()), F.lit("")))
    return rows.select(*lines.columns, country.alias("country"), name.alias("name")).where("country is not null and name != ''")


def bulk_offer_paste(lines: DataFrame, line: str = "line") -> DataFrame:
    """Seven columns: product, variety, colour, grade, boxes, stems, price; valid says whether product, stems and price can be read."""
    at = lambda i: F.nullif(F.try_element_at("_c", F.lit(i)), F.lit(""))
    rows = lines.withColumn("_c", T.cells(F.col(line)))
    out = rows.select(
        *lines.columns, at(1).alias("product_group"), at(2).alias("variety"), at(3).alias("color"),
        at(4).alias("grade"), extract(at(5), r"^([+-]?\d+)").cast("int").alias("boxes"),
        extract(at(6), r"^([+-]?\d+)").cast("int").alias("stems_per_box"), T.decimal_string(at(7)).alias("price")
    )
    return out.withColumn("valid", F.expr("product_group is not null and coalesce(stems_per_box > 0, false) and price is not null"))


#: Lines that one structured response may give.
RESPONSE_LINES = 1000
_RESPONSE = "rawText string, productGroup string, variety string, length string, boxType string, boxesAvailable int, stemsPerBox int, fobPricePerStem string, weightPerBoxKg string, currency string, treatment string, confidence string, needsReview boolean"


def structured_lines(responses: DataFrame, text: str = "response") -> DataFrame:
    """Lines of structured responses, each a JSON object with `lines`; at most 1,000 of one response.

    Added: line_no, raw_text, product_group, variety, length_raw, length_cm, box_type, boxes, stems_per_box, price, weight, currency,
    treatment, confidence, needs_review, recovered, warnings (codes). A line whose fields have other types is recovered field by
    field, is of low confidence and needs review. Responses without such an object give no lines.
    """
    shape = F.from_json(F.col(text), "lines array<string>")
    items = F.slice(shape["lines"], 1, RESPONSE_LINES)
    df = responses.select(*[c for c in responses.columns if c != text], F.posexplode(items).alias("line_no", "_item"))
    df = df.withColumn("_strict", F.from_json("_item", _RESPONSE, {"mode": "PERMISSIVE"}))
    # all fields by one reading of the item
    fields = [f.split()[0] for f in _RESPONSE.split(", ")]
    df = df.select("*", F.json_tuple("_item", *fields).alias(*(f"_f_{f}" for f in fields)))
    df = df.withColumns({f"_f_{f}": F.nullif(T.trimmed(F.col(f"_f_{f}")), F.lit("")) for f in fields})
    at = lambda f: F.col(f"_f_{f}")
    made = {"_length": length_spec(at("length")), "_price": T.decimal_string(at("fobPricePerStem"))}
    df = df.withColumns(made | {"_weight": T.decimal_string(at("weightPerBoxKg"))})
    number = lambda f: at(f).try_cast("int")
    fits = lambda f: at(f).isNull() | F.col(f"_strict.{f}").isNotNull()
    whole = fits("boxesAvailable") & fits("stemsPerBox") & F.col("_strict.rawText").isNotNull() & F.col("_strict.confidence").isin("high", "medium", "low") & F.col("_strict.needsReview").isNotNull()
    length, price, weight = F.col("_length"), F.col("_price"), F.col("_weight")
    currency = F.when(at("currency").isin("USD", "EUR"), at("currency"))
    good = F.coalesce(whole, F.lit(False))
    warnings = F.array_compact(
        F.array(
            F.when(~good, "RECOVERED"),
            F.when(at("length").isNotNull() & (length["kind"] == "none"), "LENGTH_UNREADABLE"),
            F.when(at("fobPricePerStem").isNotNull() & price.isNull(), "PRICE_UNREADABLE"),
            F.when(at("weightPerBoxKg").isNotNull() & weight.isNull(), "WEIGHT_UNREADABLE"),
            F.when(good & currency.isNull(), "CURRENCY_NOT_STATED")
        )
    )
    review = ~good | F.coalesce(F.col("_strict.needsReview"), F.lit(True)) | at("boxType").isNull() | (
        F.coalesce(number("stemsPerBox"), F.lit(0)) == 0
    ) | price.isNull() | currency.isNull()
    return df.select(
        *[
            c for c in responses.columns if c != text
        ],
        "line_no",
        F.coalesce(at("rawText"),
        F.lit(T.PLACEHOLDERS[0])).alias("raw_text"),
        at("productGroup").alias("product_group"),
        at("variety").alias("variety"),
        at("length").alias("length_raw"),
        F.when(length["kind"] == "single",
        length["min"]).alias("length_cm"),
        at("boxType").alias("box_type"), number("boxesAvailable").alias("boxes"), number("stemsPerBox").alias("stems_per_box"), price.alias("price"), weight.alias("weight"), currency.alias("currency"), F.coalesce(
            at("treatment"),
            F.lit("normal")
        ).alias("treatment"),
        F.when(
            good,
            F.col("_strict.confidence")
        ).otherwise("low").alias("confidence"), review.alias("needs_review"), (~good).alias("recovered"), warnings.alias("warnings"),
    )
