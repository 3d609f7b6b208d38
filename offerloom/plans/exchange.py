"""Queries of what comes in and goes out: workbooks, delimited text, mails, batches; and of bulk edits and cost types."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import maintain as M
from ..operators import parse as P
from ..operators import reports as RP
from ..operators import tables as TB
from ..sources import delimited as CSV
from ..sources import files as FI
from ..sources import sinks as SK
from ..sources import workbooks as W
from ..sources import xlsx as X
from ..streaming import offers as ST
from .domain import duckdb_sql
from .queries import ORACLE, C, query, sql_decimal, sql_length
from .surface import _grid

# --- bulk edits and cost types -------------------------------------------------------------------


@query(
    """WITH e AS (SELECT *, line_id || '' AS id, part_id % 2 = 0 AS on_weight, part_id % 3 = 0 AS on_stems, part_id % 5 = 0 AS on_box,
        CASE WHEN quantity < 10 THEN 'x' ELSE CAST(quantity - 12 AS VARCHAR) || '.5' END AS weight,
          CAST(quantity - 20 AS VARCHAR) || ' stems' AS stems,
        CASE WHEN quantity % 4 = 0 THEN ' ' ELSE ' ' || substr(raw_text, 1, 4) END AS box FROM {line})
    SELECT line_id, CASE WHEN NOT (on_weight OR on_stems OR on_box) THEN 'NOTHING_ENABLED'
        WHEN on_weight AND NOT coalesce(TRY_CAST(weight AS DOUBLE) > 0, false) THEN 'BAD_WEIGHT'
        WHEN on_stems AND NOT CAST(regexp_extract(stems, '^([+-]?[0-9]+)', 1) AS BIGINT) > 0 THEN 'BAD_STEMS'
        WHEN on_box AND trim(box) = '' THEN 'NO_BOX_TYPE' END AS error,
      concat_ws('; ', CASE WHEN on_box THEN 'Box/verpakking=' || coalesce(nullif(trim(box), ''), '(leeg)') END, CASE
        WHEN on_weight THEN 'Doosgewicht (kg)=' || weight END,
        CASE WHEN on_stems THEN 'Stelen per doos=' || stems END) AS summary,
      CASE WHEN on_box THEN nullif(trim(box), '') ELSE unit END AS box_type FROM e"""
)
def arr_bulk_edit(t):
    """ARR-07: the error, the summary and a field after a bulk edit"""
    q = C("quantity")
    on = {"weight": C("part_id") % 2 == 0, "stems": C("part_id") % 3 == 0, "box_type": C("part_id") % 5 == 0}
    new = {
        "weight": F.when(q < 10, "x").otherwise(F.concat((q - 12).cast("string"), F.lit(".5"))),
        "stems": F.concat((q - 20).cast("string"), F.lit(" stems")),
        "box_type": F.when(q % 4 == 0, " ").otherwise(F.concat(F.lit(" "), F.substring("raw_text", 1, 4))),
    }
    shown = F.transform(A.edit_summary(on, new), lambda x: F.concat(x["label"], F.lit("="), x["value"]))
    box = A.edited(C("unit"), new["box_type"], on["box_type"])
    return t("line").select(
        "line_id", A.edit_error(on, new).alias("error"), F.array_join(shown, "; ").alias("summary"),
        box.alias("box_type")
    )


LOOSE_COSTS = """k AS (SELECT cost_id, CASE WHEN cost_id % 3 = 0 THEN cost_type_id END AS cost_type_id, CASE
      WHEN cost_id % 11 <> 0 THEN category END AS category, unit,
      CASE WHEN route_id % 5 = 0 THEN ' Douane' WHEN route_id % 5 = 1 THEN 'INSPECTIE '
        WHEN route_id % 5 = 2 THEN name || ' ' || CAST(route_id % 7 AS VARCHAR) ELSE name END AS name FROM {cost}),
    n AS (SELECT *, CASE WHEN lower(trim(name)) IN ('clearing', 'inklaring', 'customs clearance', 'douane') THEN 'clearing'
      WHEN lower(trim(name)) IN ('handling', 'handling fee', 'afhandeling') THEN 'handling'
      WHEN lower(trim(name)) IN ('inspection', 'inspectie', 'quality inspection') THEN 'inspection' ELSE lower(trim(name)) END AS key
        FROM k),
    types AS (SELECT 'customs 2' AS normalized_name, 'Customs 2' AS name, 'OTHER' AS category, 'FLAT' AS unit),
    fixed AS (SELECT unnest(['clearing', 'handling', 'inspection']) AS normalized_name, unnest(['Clearing', 'Handling',
      'Inspection']) AS name, unnest(['CLEARING', 'HANDLING', 'INSPECTION']) AS category, unnest(['PER_STEM', 'PER_BOX', 'FLAT']) AS unit),
    own AS (SELECT key, min(trim(name)) AS name, min({{'c': category, 'u': coalesce(unit, 'FLAT')}}) AS l FROM n WHERE cost_type_id IS NULL
      AND name IS NOT NULL AND category IS NOT NULL GROUP BY key),
    seeded AS (SELECT * FROM types UNION ALL SELECT * FROM fixed UNION ALL SELECT key, name, l.c, l.u FROM own
      WHERE key NOT IN ('customs 2', 'clearing', 'handling', 'inspection'))""".replace("{{", "{").replace("}}", "}")


def _loose_costs(t):
    r = C("route_id") % 5
    name = F.when(r == 0, " Douane").when(r == 1, "INSPECTIE ").when(
        r == 2,
        F.concat("name", F.lit(" "), (C("route_id") % 7).cast("string"))
    ).otherwise(C("name"))
    costs = t("cost").select(
        "cost_id", F.when(C("cost_id") % 3 == 0, C("cost_type_id")).alias("cost_type_id"),
        F.when(C("cost_id") % 11 != 0, C("category")).alias("category"), "unit", name.alias("name")
    )
    one = {"normalized_name": "customs 2", "name": "Customs 2", "category": "OTHER", "unit": "FLAT"}
    types = t("cost").sparkSession.range(1).select(*(F.lit(v).alias(c) for c, v in one.items()))
    return costs, M.seed_cost_types(costs, types)


@query(f"WITH {LOOSE_COSTS} SELECT * FROM seeded")
def dml_seed_cost_types(t):
    """DML-14: the vocabulary of costs"""
    return _loose_costs(t)[1]


@query(f"""WITH {LOOSE_COSTS} SELECT cost_id, CASE WHEN cost_type_id IS NULL AND key IN (SELECT normalized_name
      FROM seeded) THEN key END AS type_name FROM n""")
def dml_link_cost_types(t):
    """DML-14: costs linked to it"""
    costs, types = _loose_costs(t)
    return M.link_cost_types(costs, types).select("cost_id", "type_name")


# --- workbooks -----------------------------------------------------------------------------------


def _read_back(rows, **kinds):
    """Rows written to workbooks and read from these, with their number of cells. Empty cells at the end of a row are not written."""
    shown = F.array_join("cells", "\u001f", "")
    return X.workbook_cells(X.workbooks(rows, dealt=True, **kinds)).select(
        "path",
        "sheet",
        "row",
        F.size("cells").alias("n_cells"),
        F.md5(shown).alias("cells_md5")
    )


#: What is read back of a row whose cells stand between separators that no cell holds.
WRITTEN = """CAST(CASE WHEN rtrim(cells, chr(31)) = '' THEN 0 ELSE len(string_split(rtrim(cells, chr(31)), chr(31))) END AS INT) AS n_cells,
      md5(rtrim(cells, chr(31))) AS cells_md5"""


@query(
    """WITH b AS (SELECT CAST(quote_id AS VARCHAR) AS path, *, row_number() OVER (PARTITION BY quote_id ORDER BY line_id) AS n
      FROM {quote_line}),
    r AS (SELECT path, 4 + n AS row, concat_ws(chr(31), product_group, product_group, variety, coalesce(stem_length, ''), '', '', '',
      box_type, stems_per_box, quantity_boxes, CAST(stems_per_box AS BIGINT) * quantity_boxes,
        CAST(coalesce(manual_price, calculated_price) AS VARCHAR), 'USD', 'CFR', 'Quito & co', 'A <b>') AS cells FROM b
      UNION ALL SELECT DISTINCT path, 0, 'Aanbieding Q-' || path || ' - Buyer "x"' FROM b
      UNION ALL SELECT DISTINCT path, unnest([1, 3]), '' FROM b
      UNION ALL SELECT DISTINCT path, 2, 'Herkomst: -  |  Levering: CFR A <b>  |  Valuta: USD' FROM b
      UNION ALL SELECT DISTINCT path, 4, '__CUSTOMER__' FROM b)
    SELECT path, 'Offerte Q-' || path AS sheet, CAST(row AS INT) AS row, __CELLS__ FROM r""".replace("__CELLS__", WRITTEN).replace("__CUSTOMER__", "\x1f".join(RP.CUSTOMER_HEADINGS)).replace("__INTERNAL__", "\x1f".join(RP.INTERNAL_HEADINGS))
)
def snk_customer_workbook(t):
    """SNK-03, SRC-04, SRC-05: each quote's workbook, written and read back"""
    fixed = {"currency": "USD", "incoterm": "CFR", "origin_city": "Quito & co", "destination_city": "A <b>", "customer_name": 'Buyer "x"'}
    q = t("quote_line").withColumns(
        {
            "position": C("line_id"),
            "quote_number": F.concat(F.lit("Q-"), C("quote_id").cast("string"))
        } | {c: F.lit(v) for c, v in fixed.items()}
    )
    return _read_back(RP.customer_workbook(q), numbers=RP.CUSTOMER_NUMBERS, prices=RP.CUSTOMER_PRICES, bold=[0, 2, 4])


@query(
    """WITH q AS (SELECT *, CASE WHEN quantity_boxes % 3 = 0 THEN 'YES' END AS conv, CAST(calculated_price * 0.5 AS DECIMAL(12,6)) AS fob,
      CAST(quantity_boxes * 0.01 AS DECIMAL(12,6)) AS clearing FROM {quote_line}),
    b AS (SELECT CAST(quote_id AS VARCHAR) AS path, *, row_number() OVER (PARTITION BY quote_id ORDER BY line_id) AS n FROM q),
    r AS (SELECT path, n AS row, concat_ws(chr(31), product_group || ' - ' || variety, farm_id, quantity_boxes, stems_per_box,
      CAST(stems_per_box AS BIGINT) * quantity_boxes, 'DDP', CAST(fob AS VARCHAR), '0.000000', CAST(clearing AS VARCHAR), '0.020000',
        CAST(greatest(0, CAST(0.25 - clearing - 0.02 AS DECIMAL(18,6))) AS VARCHAR), CAST(fob AS VARCHAR), CASE WHEN conv IS NULL THEN 'USD'
          ELSE 'EUR' END, CASE WHEN conv IS NULL THEN 'EUR' ELSE 'USD' END, CASE WHEN conv IS NULL THEN '' ELSE '1.25' END,
        CASE WHEN conv IS NULL THEN '' ELSE 'ja' END, CAST(fob AS VARCHAR), '12', CAST(calculated_price AS VARCHAR),
          coalesce(CAST(manual_price AS VARCHAR), ''), CAST(coalesce(manual_price, calculated_price) AS VARCHAR)) AS cells FROM b
      UNION ALL SELECT DISTINCT path, 0, '__INTERNAL__' FROM b)
    SELECT path, 'Interne calculatie' AS sheet, CAST(row AS INT) AS row, __CELLS__ FROM r""".replace("__CELLS__", WRITTEN).replace("__CUSTOMER__", "\x1f".join(RP.CUSTOMER_HEADINGS)).replace("__INTERNAL__", "\x1f".join(RP.INTERNAL_HEADINGS))
)
def snk_internal_workbook(t):
    """SNK-04: the same for the internal sheet, with a rate on a third of the lines"""
    conv = C("quantity_boxes") % 3 == 0
    fob = (C("calculated_price") * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(12,6)")
    more = {
        "position": C("line_id"),
        "v_product": C("product_group"),
        "v_variety": C("variety"),
        "v_stem_length": F.lit(None).cast("string"),
        "supplier": C("farm_id"),
        "incoterm": F.lit("DDP"),
        "fob": fob,
        "cost_source": fob,
        "cost_target": fob,
        "clearing_inspection": (C("quantity_boxes") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,6)"),
        "handling": F.lit("0.02"),
        "additional": F.lit("0.25"),
        "source_currency": F.lit("USD"),
        "currency": F.lit("EUR"),
        "fx_rate": F.when(conv, "1.25"),
        "quote_fx_base": F.lit("EUR"),
        "fx_quote": F.lit("USD"),
        "fx_note": F.lit("ja"),
        "margin_pct": F.lit(12),
    }
    return _read_back(RP.internal_workbook(t("quote_line").withColumns(more)), numbers=RP.INTERNAL_NUMBERS, bold=[0])


# --- delimited text, mails, batches --------------------------------------------------------------


@query(
    """WITH a AS (SELECT CAST(farm_id AS VARCHAR) AS path, variety, stem_length, article_id % 10 AS k,
      row_number() OVER (PARTITION BY farm_id ORDER BY article_id) AS n FROM {article})
    SELECT path, CAST(n AS INT) AS row, md5(variety || CASE WHEN k = 1 THEN ';"' || chr(10) || 'x'
      ELSE '' END || '|' || coalesce(stem_length, '') || '|' || k) AS cells_md5 FROM a
    UNION ALL SELECT DISTINCT path, 0, md5('Product|Length|No') FROM a"""
)
def src_csv_cells(t):
    """SRC-06: quoted cells with separators, quotes and line ends"""
    k = C("article_id") % 10
    name = F.when(k == 1, F.concat(F.lit('"'), C("variety"), F.lit(';""\nx"'))).otherwise(C("variety"))
    line = F.concat_ws(";", name, F.coalesce("stem_length", F.lit("")), k.cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("article_id", line.alias("l")))), lambda x: x["l"]), "\r\n")
    texts = t("article").groupBy(C("farm_id").cast("string").alias("path")).agg(
        F.concat(F.lit("﻿Product;Length;No\r\n"), body).alias("text")
    )
    cells = FI.sheet_cells(texts.withColumn("sheet", F.lit("CSV")), ";")
    return cells.select(
        "path", "row",
        F.md5(F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "|")).alias("cells_md5")
    )


@query(
    """SELECT article_id, variety || CASE WHEN article_id % 10 = 1 THEN ';"' || chr(10) || 'x'
      WHEN article_id % 10 = 2 THEN chr(13) || chr(10) ELSE '' END AS variety, stem_length, CAST(3 AS INT) AS cells FROM {article}"""
)
def src_csv_scan(t):
    """SRC-06: delimited files written to a folder and read in blocks"""
    k = C("article_id") % 10
    quoted = F.concat(F.lit('"'), C("variety"), F.when(k == 1, F.lit(';""\nx"')).otherwise(F.lit('\r\n"')))
    line = F.concat_ws(
        ";", C("article_id").cast("string"), F.when(k.isin(1, 2), quoted).otherwise(C("variety")),
        F.coalesce("stem_length", F.lit(""))
    )
    rows = t("article").select(line.alias("value"))
    folder = SK.shared_folder(rows.sparkSession, "csv")
    rows.write.option("lineSep", "\r\n").text(folder)
    found = CSV.read_csv(rows.sparkSession, folder).select("cells")
    return found.select(
        F.get("cells", F.lit(0)).cast("long").alias("article_id"), F.get("cells", F.lit(1)).alias("variety"),
        F.get("cells", F.lit(2)).alias("stem_length"), F.size("cells").alias("cells")
    )


@query(
    """WITH a AS (SELECT farm_id, row_number() OVER (PARTITION BY farm_id ORDER BY article_id) AS n, * EXCLUDE (farm_id) FROM {article})
    SELECT farm_id, CAST(n AS INT) AS row, variety, stem_length, CAST(stems_per_box AS INT) AS stems_per_box FROM a"""
)
def src_workbook_scan(t):
    """SRC-04, SRC-05: each farm's workbook written as a file and read by the data source, its filter on the sheet pushed down"""
    path = C("farm_id").cast("string").alias("path")
    row = F.row_number().over(Window.partitionBy("farm_id").orderBy("article_id"))
    cells = F.array("variety", "stem_length", C("stems_per_box").cast("string"))
    head = t("farm").select(
        path, F.lit("List").alias("sheet"), F.lit(0).alias("row"),
        F.array(*map(F.lit, ("Variety", "Length", "Stems"))).alias("cells")
    )
    books = head.union(t("article").select(path, F.lit("List").alias("sheet"), row.alias("row"), cells.alias("cells")))
    folder = SK.shared_folder(books.sparkSession, "workbooks")
    W.write_workbooks(X.workbooks(books, numbers=[2], bold=[0]), folder)
    found = W.read_workbooks(books.sparkSession, folder).where((C("sheet") == "List") & (C("row") > 0))
    farm = F.regexp_extract("path", r"([0-9]+)\.xlsx$", 1).cast("long")
    return found.select(
        farm.alias("farm_id"), "row", F.get("cells", F.lit(0)).alias("variety"),
        F.get("cells", F.lit(1)).alias("stem_length"), F.get("cells", F.lit(2)).cast("int").alias("stems_per_box")
    )


@query(
    """WITH p AS (SELECT quote_id, product_group AS g, line_id, '  - ' || variety || CASE WHEN stem_length IS NULL THEN ''
      ELSE ' ' || stem_length END || CASE WHEN quantity_boxes % 2 = 0 THEN ' (tinted)'
      ELSE '' END || ' - ' || CAST(stems_per_box AS VARCHAR)
        || ' stems/' || box_type || ' - €' || CAST(CAST(round(coalesce(manual_price, calculated_price),
          2) AS DECIMAL(12,2)) AS VARCHAR) || ' per stem' AS l FROM {quote_line}),
    g AS (SELECT quote_id, g, min(line_id) AS f, g || ':' || chr(10) || string_agg(l, chr(10) ORDER BY line_id, l) AS b FROM p
      GROUP BY quote_id, g),
    w AS (SELECT quote_id, string_agg(b, chr(10) || chr(10) ORDER BY f) AS body FROM g GROUP BY quote_id)
    SELECT quote_id, md5('Subject: Flower offer Q-' || CAST(quote_id AS VARCHAR) || ' - DDP Amsterdam' || chr(10) || chr(10) || 'Dear ' || CASE
      WHEN quote_id % 2 = 0 THEN 'Ann' ELSE 'customer' END || ',' || chr(10) || chr(10)
      || 'Origin Kenya, delivery DDP Amsterdam, prices in EUR.' || chr(10) || chr(10) || body || chr(10) || chr(10) || 'Availability subject to confirmation. Prices valid until 5-3-2024.') AS text_md5
        FROM w"""
)
def snk_mail_offer(t):
    """SNK-06"""
    none = F.lit(None).cast("string")
    fixed = {"currency": "EUR", "incoterm": "DDP", "origin_country": "Kenya", "destination_city": "Amsterdam"}
    more = {
        "position": C("line_id"),
        "v_color": none,
        "v_variety": C("variety"),
        "v_grade": none,
        "v_stem_length": C("stem_length"),
        "v_product": C("product_group"),
        "treatment": F.when(C("quantity_boxes") % 2 == 0, "tinted").otherwise("Normal"),
        "quote_number": F.concat(F.lit("Q-"), C("quote_id").cast("string")),
        "valid_until": F.lit("2024-03-05").cast("date"),
        "contact": F.when(C("quote_id") % 2 == 0, "Ann"),
    }
    q = t("quote_line").withColumns(more | {c: F.lit(v) for c, v in fixed.items()})
    return RP.offer_text(q, style="mail").select("quote_id", F.md5("text").alias("text_md5"))


@query(
    """WITH n AS (SELECT farm_id, count(*) AS n FROM {article} GROUP BY farm_id)
    SELECT CAST(farm_id AS VARCHAR) AS path, CAST(CASE WHEN farm_id % 3 = 0 THEN 2 + farm_id % 4 ELSE 2 END AS INT) AS header, CAST(CASE
      WHEN farm_id % 3 = 0 THEN least(n + 2, 7 + farm_id % 50) ELSE n + 2 END AS INT) AS last,
      CASE WHEN farm_id % 3 = 0 THEN 'named-table' ELSE 'scanned-header' END AS source FROM n WHERE n >= 4"""
)
def tab_named_tables(t):
    """PAR-12: named tables come first; those whose range can't be read don't count"""
    i = C("farm_id")
    ref = F.when(
        i % 3 == 0,
        F.concat(F.lit("$A$"), (i % 4 + 3).cast("string"), F.lit(":g"), (i % 50 + 8).cast("string"))
    ).when(i % 3 == 1, "A9:B2").otherwise("A:B")
    tables = t("farm").select(i.cast("string").alias("path"), F.lit("S").alias("sheet"), F.lit("T").alias("name"), ref.alias("ref"))
    many = t("article").groupBy(i.cast("string").alias("path")).count().where("count >= 4")
    return TB.regions(_grid(t), tables).join(many, "path", "left_semi").select("path", "header", "last", "source")


@query(
    """SELECT q.o_orderkey AS quote_id, count(l.line_id) AS n_lines, CAST(coalesce(sum(l.quantity), 0) AS BIGINT) AS boxes
    FROM (SELECT DISTINCT o_orderkey FROM {orders}) q LEFT JOIN {line} l ON l.offer_id = q.o_orderkey GROUP BY q.o_orderkey"""
)
def snk_written_together(t):
    """SNK-01, SNK-02: quotes and their lines in two batches, one of them retried, read back; what no batch lists is not read"""
    quotes = t("orders").select(C("o_orderkey").alias("quote_id")).distinct()
    lines = t("line").select(C("offer_id").alias("quote_id"), "line_id", "quantity")
    spark = quotes.sparkSession
    folder = SK.shared_folder(spark, "batches")
    for side in (0, 1, 1):  # the last one again, as a retried driver would
        SK.write_together(
            folder, key=f"side {side}", quotes=quotes.where(C("quote_id") % 2 == side),
            lines=lines.where(C("quote_id") % 2 == side)
        )
    quotes.where("quote_id % 7 = 0").write.parquet(f"{folder}/quotes/{'0' * 32}")
    q, rows = SK.read_together(spark, folder, "quotes"), SK.read_together(spark, folder, "lines")
    each = rows.groupBy("batch", "quote_id").agg(F.count("line_id").alias("n"), F.sum("quantity").alias("q"))
    zero = F.lit(0).cast("long")
    return q.join(each, ["batch", "quote_id"], "left").select(
        "quote_id",
        F.coalesce("n", zero).alias("n_lines"),
        F.coalesce("q", zero).alias("boxes")
    )


# --- SQL of two parsers --------------------------------------------------------------------------


def _sql_group(word: str) -> str:
    """The name of a product group and whether it is known, as a struct."""
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.PRODUCT_GROUPS.items())
    other = f"list_aggregate(list_transform(string_split({word}, ' '), lambda w: regexp_extract(w, '^([^A-Za-z0-9_]*)', 1) || upper(regexp_extract(w, '^[^A-Za-z0-9_]*([A-Za-z0-9_])', 1)) || lower(regexp_extract(w, '^[^A-Za-z0-9_]*[A-Za-z0-9_](.*)$', 1))), 'string_agg', ' ')"
    return f"{{'name': coalesce(CASE lower({word}) {known} END, {other}), 'known': CASE lower({word}) {known} END IS NOT NULL}}"


_BOX = r"(?i)(\d+)\s*(?:QB|HB|FB)\s*[x×*]?\s*(\d+)"
_GRADE = " ".join(rf"WHEN regexp_matches(name, '(?i)\b{g}\b') THEN '{g}'" for g in T.GRADES)
_UNGRADED = " ".join(rf"WHEN '{g}' THEN trim(regexp_replace(name, '(?i)\b{g}\b', ''))" for g in T.GRADES)
#: `once(a, b)`: a without the first occurrence of b, which becomes a space.
_ONCE = """CASE WHEN {b} <> '' AND strpos({a}, {b}) > 0 THEN substr({a}, 1, strpos({a}, {b}) - 1) || ' ' || substr({a}, strpos({a},
      {b}) + length({b})) ELSE {a} END"""

OFFER_LINES = (
    r"""SELECT text_id, CAST(variant_no AS INT) AS variant_no, nullif(CASE
      WHEN variant_no IS NOT NULL THEN grp.name END, '') AS product_group, variety, grade, offer.treatment AS treatment,
      CASE WHEN has_box THEN coalesce(nullif(upper(regexp_extract(base, '(?i)\b(QB|HB|FB)\b', 1)), ''), 'QB') END AS box_type, CASE
        WHEN has_box THEN CAST(regexp_extract(base, '{box}', 1) AS INT) END AS boxes,
      CASE WHEN has_box THEN CAST(regexp_extract(base, '{box}', 2) AS INT) END AS stems_per_box, offer.price AS price, CASE
        WHEN base IS NOT NULL THEN CASE WHEN contains(base, '€') THEN 'EUR' ELSE 'USD' END END AS currency,
      CAST(nullif(regexp_extract(text, '(?i)additional\s+time\s+required\s+(\d+)\s*hr', 1), '') AS INT) AS lead_time_hours,
      CASE WHEN base IS NULL OR NOT has_box OR price IS NULL THEN 'low' WHEN NOT coalesce(grp.known, false) THEN 'medium'
        ELSE 'high' END AS confidence,
      base IS NULL OR NOT has_box OR price IS NULL OR NOT coalesce(grp.known, false) AS needs_review,
      CASE WHEN variant_no > 0 THEN '' ELSE concat_ws('|', CASE WHEN base IS NULL THEN 'LINE_UNREADABLE' END,
        CASE WHEN base IS NOT NULL AND price IS NULL THEN CASE WHEN regexp_matches(base, '[$€]\s*[\d.,]+') THEN 'PRICE_UNREADABLE'
          ELSE 'PRICE_MISSING' END END, CASE WHEN base IS NOT NULL AND NOT has_box THEN 'BOX_MISSING' END,
        CASE WHEN len(good) < len(variants) THEN 'VARIANT_UNREADABLE' END) END AS warnings
    FROM (SELECT *, unnest(list_concat([{{'treatment': 'normal', 'price': price}}], good)) AS offer, unnest(range(0,
      len(good) + 1)) AS variant_no FROM
      (SELECT *, list_filter(variants, lambda v: v.price IS NOT NULL AND v.treatment IS NOT NULL) AS good FROM
      (SELECT *, {group} AS grp, nullif(array_to_string(words[2:], ' '), '') AS variety, {price} AS price,
        list_transform(parts[2:],
          lambda s: {{'treatment': nullif(lower(regexp_extract(s, '{variant}', 1)), ''), 'price': {vprice}}}) AS variants FROM
      (SELECT *, list_filter(regexp_split_to_array(CASE grade {ungraded} ELSE name END, '\s+'), lambda w: w <> '') AS words FROM
      (SELECT *, CASE {grade} END AS grade FROM
      (SELECT *, trim(regexp_replace({unpriced}, '\s+', ' ', 'g')) AS name FROM
      (SELECT *, regexp_extract(base, '[$€]\s*([\d.,]+)', 0) AS priced, {unboxed} AS nobox, coalesce(regexp_matches(base, '{box}'),
        false) AS has_box FROM
      (SELECT *, parts[1] AS base FROM
      (SELECT text_id, text, list_filter(list_transform(string_split(trim(regexp_replace(trim(text),
        '(?i)\(\s*additional\s+time\s+required[^)]*\)', '', 'g')), '|'), lambda s: trim(s)), lambda s: s <> '') AS parts
        FROM {{offer_text}} WHERE text IS NOT NULL)))))))))"""
).format(
    box=_BOX,
    variant=r"(?i)^([a-z]+)\b[\s:]*[$€]?\s*([\d.,]+)?",
    vprice=sql_decimal(r"regexp_extract(s, '(?i)^([a-z]+)\b[\s:]*[$€]?\s*([\d.,]+)?', 2)"),
    price=sql_decimal(r"regexp_extract(base, '[$€]\s*([\d.,]+)', 1)"),
    group="CASE WHEN len(words) > 0 THEN " + _sql_group("words[1]") + " END",
    ungraded=_UNGRADED,
    grade=_GRADE,
    unpriced=_ONCE.format(a="nobox", b="priced"),
    unboxed=_ONCE.format(a="base", b=f"regexp_extract(base, '{_BOX}', 0)"),
)

SHEET_LINES = f"""WITH a AS (SELECT CAST(farm_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY farm_id
      ORDER BY article_id) AS n, *, '$ 0,' || CAST(variant_id % 90 + 10 AS VARCHAR) AS shown,
      {_sql_group("product_name")} AS grp FROM {{article}})
    SELECT path, CAST(n AS INT) AS row, grp.name AS product_group, nullif(trim(variety), '') AS variety,
      {sql_length("stem_length")} AS length_cm, CAST(stems_per_box AS INT) AS stems_per_box, {sql_decimal("shown")} AS price,
      CASE WHEN {sql_decimal("shown")} IS NULL OR stems_per_box = 0 THEN 'low' WHEN grp.known THEN 'high' ELSE 'medium' END AS confidence
        FROM a"""


@query(None)
def par_offer_lines(t):
    """PAR-02 to PAR-06"""
    return P.parse_offer_line(t("offer_text"), "text").drop("text").withColumn("warnings", F.array_join("warnings", "|"))


@query(None)
def par_message_offers(t):
    """PAR-07: messages to offers without a model"""
    messages = t("offer_text").select(C("text_id").cast("string").alias("path"), "text")
    return ST.parsed_offers(messages).select(
        C("path").cast("long").alias("text_id"),
        "variant_no",
        "product_group",
        "variety",
        "price",
        "confidence"
    )


@query(None)
def tab_sheet_lines(t):
    """PAR-08 to PAR-10: sheets of a farm's articles read back; odd grids are tested one by one"""
    path = C("farm_id").cast("string").alias("path")
    names = ("Product", "Variety", "Length", "Stems per box", "FOB")
    head = t("farm").select(path, F.lit("S").alias("sheet"), F.lit(0).alias("row"), F.array(*map(F.lit, names)).alias("cells"))
    row = F.row_number().over(Window.partitionBy("farm_id").orderBy("article_id"))
    price = F.concat(F.lit("$ 0,"), (C("variant_id") % 90 + 10).cast("string"))
    cells = F.array("product_name", "variety", "stem_length", C("stems_per_box").cast("string"), price)
    grid = SK.kept(head.union(t("article").select(path, F.lit("S").alias("sheet"), row.alias("row"), cells.alias("cells"))), "grid")
    lines = TB.parse_sheet(grid)
    return lines.select("path", "row", "product_group", "variety", "length_cm", "stems_per_box", "price", "confidence")


MESSAGE_OFFERS = (
    "SELECT text_id, variant_no, product_group, variety, price, confidence FROM ("
    + OFFER_LINES
    + r""") WHERE text_id IN (SELECT text_id FROM {offer_text} WHERE NOT regexp_matches(trim(text),
      '(?i)^(hi|hello|dear|hey|buenos|good\s+(morning|afternoon|evening))\b')
      AND NOT regexp_matches(trim(text), '(?i)^(from|sent|to|subject|cc|bcc)\s*:') AND regexp_matches(trim(text), '\S\s+\S')
      AND (regexp_matches(text, '\$\s*[\d.,]+') OR regexp_matches(text, '(?i)\d+\s*(?:QB|HB|FB)\s*[x×*]?\s*\d+')))"""
)

for _name, _sql in (("par_offer_lines", OFFER_LINES), ("par_message_offers", MESSAGE_OFFERS), ("tab_sheet_lines", SHEET_LINES)):
    ORACLE[_name] = duckdb_sql(_sql)
