"""Queries of the smaller operators, beside those in queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import numbers as N
from ..functions import text as T
from ..operators import enrich as E
from ..operators import maintain as M
from ..operators import match as MA
from ..operators import names as NM
from ..operators import parse as P
from ..operators import quotes as Q
from ..operators import relational as R
from ..operators import reports as RP
from ..operators import tables as TB
from ..sources import files as FI
from ..sources import mails as ML
from ..sources import sinks as SK
from .queries import MAPPINGS, MATCH, C, _mappings, query, sql_key


@query(
    """SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'Rosa Ec' ELSE product_name END AS product, CASE
      WHEN article_id % 4 < 2 THEN false ELSE true END AS valid, coalesce(nullif(trim(color), ''), 'Additional cost') AS cost_name,
    CASE WHEN article_id % 5 = 0 THEN NULL ELSE 'Farm is still used by ' || CAST(article_id % 5 AS VARCHAR) || ' offers' END AS blocked,
    lpad(CAST(article_id % 6000 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(article_id % 60 AS VARCHAR), 2, '0') AS elapsed
      FROM {article}"""
)
def str_labels(t):
    """STR-13, STR-20, STR-23, STR-28, STR-29 (elapsed)"""
    i = C("article_id")
    name = F.when(i % 3 == 0, " Roses ").when(i % 3 == 1, None).otherwise(C("product_name"))
    source = F.when(i % 4 == 0, " ").when(i % 4 == 1, "(handmatig ingevoerd)").otherwise("text")
    return t("article").select(
        "article_id", T.imported_product(name, C("product_name")).alias("product"),
        T.valid_source(source).alias("valid"), T.cost_name(F.lit(None).cast("string"), C("color")).alias("cost_name"),
        T.delete_blocked("Farm", offers=i % 5).alias("blocked"), T.elapsed(i % 6000).alias("elapsed")
    )


@query("""SELECT o_orderkey, replace(replace(replace(format('{{:,.2f}}', o_totalprice), ',', '#'), '.', ','), '#', '.') AS money,
      strftime(o_orderdate, '%d-%m-%Y') AS day FROM {orders}""".replace("{{:,.2f}}", "{:,.2f}"))
def str_money_dates(t):
    """STR-25, STR-26"""
    return t("orders").select("o_orderkey", T.money_nl(C("o_totalprice")).alias("money"), T.date_nl(C("o_orderdate")).alias("day"))


@query("""SELECT article_id, split_part(variety, ' ', 1) AS product, substr(variety, length(split_part(variety, ' ', 1)) + 2) AS variety
      FROM {article} WHERE contains(variety, ' ')""")
def par_article_parts(t):
    """PAR-30"""
    parts = F.filter(F.array(T.article_parts(C("variety"))), lambda p: p.isNotNull())
    return t("article").select("article_id", F.inline(parts).alias("product", "variety"))


@query("""SELECT farm_id, CASE WHEN farm_id % 3 = 0 THEN 'Peru' ELSE country END AS country, farm_name AS name FROM {farm}
      WHERE farm_id % 4 <> 0""")
def par_farm_paste(t):
    """PAR-31"""
    i = C("farm_id")
    line = F.when(
        i % 4 == 0,
        F.concat("country", F.lit("\t"))
    ).when(i % 3 == 0, C("farm_name")).otherwise(F.concat_ws("\t", "country", "farm_name"))
    return P.farm_paste(t("farm").select("farm_id", line.alias("line")), "Peru").select("farm_id", "country", "name")


@query(
    """SELECT CAST(article_id AS BIGINT) AS article_id, CASE WHEN variant_id % 5 <> 0 THEN product_name END AS product_group, CAST(CASE
      WHEN variant_id % 7 <> 0 THEN stems_per_box END AS INT) AS stems_per_box,
      CASE WHEN article_id % 3 <> 0 THEN '0.' || CAST(variant_id % 90 + 10 AS VARCHAR) END AS price, variant_id % 5 <> 0
        AND variant_id % 7 <> 0 AND article_id % 3 <> 0 AS valid FROM {article}"""
)
def par_bulk_paste(t):
    """PAR-32"""
    price = F.when(C("article_id") % 3 == 0, F.lit("?")).otherwise(F.concat(F.lit("$ 0,"), (C("variant_id") % 90 + 10).cast("string")))
    stems = F.when(C("variant_id") % 7 == 0, F.lit("many")).otherwise(C("stems_per_box").cast("string"))
    line = F.concat_ws(
        "\t", F.when(C("variant_id") % 5 == 0, " ").otherwise(C("product_name")), "variety", "color", F.lit(""),
        F.lit("10"), stems, price
    )
    return P.bulk_offer_paste(t("article").select("article_id", line.alias("line"))).select(
        "article_id",
        "product_group",
        "stems_per_box",
        "price",
        "valid"
    )


@query(
    """SELECT offer_id, CAST(line_no AS INT) AS line_no, product_group, CAST(CASE WHEN n % 4 = 0 THEN NULL
      ELSE quantity END AS INT) AS stems_per_box, CAST(fob AS VARCHAR) AS price, n % 4 = 0 AS recovered
    FROM (SELECT offer_id, row_number() OVER (PARTITION BY offer_id ORDER BY line_id) - 1 AS line_no, coalesce(product_name,
      'none') AS product_group, quantity, fob, part_id AS n FROM {line})"""
)
def par_structured_lines(t):
    """PAR-27, PAR-28: responses made of each offer's lines"""
    stems = F.when(C("part_id") % 4 == 0, F.lit('"many"')).otherwise(C("quantity").cast("string"))
    text = F.concat(
        F.lit('{"rawText":"r","productGroup":"'), F.coalesce("product_name", F.lit("none")), F.lit('","stemsPerBox":'),
        stems, F.lit(',"fobPricePerStem":"'), C("fob").cast("string"),
        F.lit('","confidence":"high","needsReview":false,"length":null}')
    )
    r = t("line").groupBy("offer_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", text.alias("j")))), lambda x: x["j"]), ",").alias("j")
    )
    r = r.select("offer_id", F.concat(F.lit('{"lines":['), C("j"), F.lit("]}")).alias("response"))
    return P.structured_lines(r).select("offer_id", "line_no", "product_group", "stems_per_box", "price", "recovered")


@query("""SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'plain ' || url ELSE url END AS text, CASE WHEN page_id % 3 = 0 THEN ';'
      ELSE ',' END AS delimiter, CASE WHEN page_id % 5 = 0 THEN 'NO_FARM' WHEN page_id % 5 = 1 THEN 'NOTHING'
      WHEN page_id % 5 = 2 THEN 'BOTH' WHEN page_id % 5 = 3 THEN 'TOO_LARGE' END AS code FROM {pages}""")
def src_mail_text(t):
    """SRC-07, SRC-09, SRC-12"""
    i = C("page_id")
    mail = F.when(
        i % 2 == 0,
        F.concat(
            F.lit("From: a\r\nContent-Type: multipart/x; boundary=\"bb\"\r\n\r\n--bb\r\nContent-Type: text/plain\r\n\r\nplain "),
            C("url"), F.lit("\r\n--bb--")
        )
    ).otherwise(F.concat(F.lit("Subject: x\n\n<html><p>"), C("url"), F.lit("</p></html>")))
    code = FI.upload_code(
        F.when(i % 5 != 0, i), F.when(i % 5 == 2, 1).when(i % 5 == 3, FI.UPLOAD_BYTES + 1).when(i % 5 == 4, 5),
        F.when(i % 5 == 2, "text")
    )
    return t("pages").select(
        "page_id", "url", T.trimmed(ML.mail_text(mail)).alias("text"),
        FI.delimiter(F.when(i % 3 == 0, "\na;b;\"x,y,z\"").otherwise("a,b;c,d")).alias("delimiter"), code.alias("code")
    )


@query(
    """SELECT offer_id, CAST(count(*) AS BIGINT) AS n, string_agg(line_id, ',' ORDER BY line_id) FILTER (part_id % 3 = 0) AS chosen, CASE
      WHEN count(*) FILTER (part_id % 3 = 0) = 0 THEN 'unchecked' WHEN count(*) FILTER (part_id % 3 = 0) = count(*) THEN 'checked'
      ELSE 'indeterminate' END AS header FROM {line} GROUP BY offer_id"""
)
def arr_selections(t):
    """ARR-05, ARR-06"""
    g = t("line").groupBy("offer_id").agg(
        F.array_sort(F.collect_list("line_id")).alias("v"),
        F.array_sort(F.collect_list(F.when(C("part_id") % 3 == 0, C("line_id")))).alias("s")
    )
    chosen = A.visible_selected(C("s"), C("v"))
    ids = A.bulk_ids(chosen)
    return g.select(
        "offer_id", F.size("v").cast("long").alias("n"), F.array_join(ids["ids"], ",").alias("chosen"),
        A.header_state(F.size(chosen), F.size("v")).alias("header")
    )


@query(
    """SELECT line_id, 'row ' || line_id AS raw_text, CAST(quantity AS DOUBLE) AS quantity, product_name AS product_group,
      'price ' || CAST(fob AS VARCHAR) || ' "low"' AS warning FROM {line}"""
)
def jsn_snapshot(t):
    """JSN-01, JSN-02"""
    warning = F.concat(F.lit("price "), C("fob").cast("string"), F.lit(' "low"'))
    s = A.snapshot(
        raw_text=F.concat(F.lit("row "), C("line_id")), quantity=C("quantity"), product_group=C("product_name"),
        warnings=F.array(warning)
    )
    d = t("line").select("line_id", s.alias("s"))
    j = F.from_json("s", "raw_text string, quantity double, product_group string")
    return d.select(
        "line_id", j["raw_text"].alias("raw_text"), j["quantity"].alias("quantity"),
        j["product_group"].alias("product_group"), A.snapshot_warnings(C("s"))[0].alias("warning")
    )


def _grid(t):
    """A sheet for each farm: a title, an empty row, a header, its articles. Written out, as its readers go through it several times."""
    known = ["Packs left", "Pack quantity", "Fust code", "Product description", "Stem length", "Box weight", "FOB price USD"]
    head = F.array(
        F.struct(F.lit(0).alias("row"), F.array(F.lit("Offer")).alias("cells")),
        F.struct(F.lit(1).alias("row"), F.array(F.lit(None).cast("string")).alias("cells")),
        F.struct(F.lit(2).alias("row"), F.array(*(F.lit(k) for k in known)).alias("cells"))
    )
    top = t("farm").select(
        C("farm_id").cast("string").alias("path"),
        F.lit("S").alias("sheet"),
        F.explode(head).alias("h")
    ).select("path", "sheet", "h.row", "h.cells")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("farm_id").orderBy("article_id")) + 2
    cells = F.array(
        (C("variant_id") % 50).cast("string"), C("stems_per_box").cast("string"), "box_type",
        F.when(C("variant_id") % 6 != 0, C("variety")), "stem_length", C("box_weight").cast("string"),
        F.concat(F.lit("0,"), (C("variant_id") % 90 + 10).cast("string"))
    )
    return SK.kept(top.union(t("article").select(C("farm_id").cast("string"), F.lit("S"), n.alias("row"), cells)), "grid")


@query("""SELECT CAST(f.farm_id AS VARCHAR) AS path, CAST(2 AS INT) AS header, CAST(2 + count(a.article_id) AS INT) AS last,
      'scanned-header' AS source FROM {farm} f JOIN {article} a ON a.farm_id = f.farm_id GROUP BY f.farm_id""")
def tab_regions(t):
    """PAR-11, PAR-13"""
    return TB.regions(_grid(t)).select("path", "header", "last", "source")


@query(
    """SELECT CAST(farm_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY farm_id
      ORDER BY article_id) AS INT) AS row_index, variety AS description, CAST(variant_id % 50 AS INT) AS quantity,
      CAST(stems_per_box AS INT) AS stems_per_box, '0.' || CAST(variant_id % 90 + 10 AS VARCHAR) AS price,
    CAST(regexp_extract(stem_length, '([0-9]+)', 1) AS DOUBLE) AS length_cm FROM {article} WHERE variant_id % 6 <> 0"""
)
def tab_known_rows(t):
    """PAR-15, PAR-16"""
    g = _grid(t)
    return TB.known_rows(g, TB.regions(g)).select("path", "row_index", "description", "quantity", "stems_per_box", "price", "length_cm")


@query(
    """SELECT path, CAST(row_index AS INT) AS row_index, CASE
      WHEN row_index % 3 <> 0 THEN 'G' || CAST(row_index AS VARCHAR) END AS read_group, row_index % 3 = 0 AS unread
      FROM (SELECT CAST(farm_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY farm_id ORDER BY article_id) AS row_index
      FROM {article} WHERE variant_id % 6 <> 0)"""
)
def tab_merge_descriptions(t):
    """PAR-17 (tags), PAR-18, JON-08"""
    g = _grid(t)
    rows = TB.known_rows(g, TB.regions(g))
    n = C("row_index").cast("string")
    d = rows.where("row_index % 3 <> 0").select(
        "path", "sheet", F.concat(F.lit("#"), n, F.lit(" | "), C("description")).alias("raw_text"),
        C("row_index").alias("position"), F.concat(F.lit("G"), n).alias("product_group"),
        F.lit(None).cast("string").alias("variety"), F.lit(None).cast("string").alias("color"),
        F.lit(None).cast("string").alias("grade")
    )
    m = TB.merge_descriptions(rows, d.union(d.withColumns({"position": C("position") + 1000, "product_group": F.lit("late")})))
    unread = F.array_contains("warnings", "DESCRIPTION_UNREAD")
    return m.select("path", "row_index", F.when(~unread, C("product_group")).alias("read_group"), unread.alias("unread"))


@query("""SELECT CAST(farm_id AS VARCHAR) AS path,
      md5('Packs left | Pack quantity | Fust code | Product description | Stem length | Box weight | FOB price USD' || chr(10) || string_agg(CAST(variant_id % 50 AS VARCHAR) || ' | ' || CAST(stems_per_box AS VARCHAR) || ' | ' || box_type || ' | ' || CASE
      WHEN variant_id % 6 <> 0 THEN variety ELSE '' END || ' | ' || coalesce(stem_length,
      '') || ' | ' || coalesce(CAST(box_weight AS VARCHAR), '') || ' | 0,' || CAST(variant_id % 90 + 10 AS VARCHAR), chr(10)
      ORDER BY article_id)) AS text_md5 FROM {article} GROUP BY farm_id""")
def tab_text(t):
    """PAR-14"""
    g = _grid(t)
    return TB.table_text(g, TB.regions(g)).select("path", F.md5("text").alias("text_md5"))


@query("""SELECT line_id, part_id % 20 = 0 AS preselected FROM {line} WHERE offer_status = 'REVIEWED' AND part_id % 11 <> 0
      AND (part_id % 3 <> 0 OR part_id % 20 = 0)""")
def flt_quotable(t):
    """FLT-03, FLT-14"""
    lines = t("line").select(
        "line_id", "offer_status",
        F.when(C("part_id") % 11 == 0, "AMBIGUOUS").otherwise("DERIVED").alias("match_status"),
        C("own_article").alias("article_id"), F.when(C("part_id") % 3 != 0, C("fob")).alias("price")
    )
    return R.quotable_candidates(lines, t("line").where("part_id % 20 = 0").select("line_id")).select("line_id", "preselected")


@query("SELECT id, id IN (SELECT customer_id FROM {buyer}) AS found FROM (SELECT unnest(range(0, 400, 7)) AS id)")
def jon_missing_ids(t):
    """JON-15"""
    ids = t("cost").sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(0), F.lit(399), F.lit(7))).alias("id")
    ).select(C("id").cast("long").alias("id"))
    return R.missing_ids(ids, t("buyer").withColumnRenamed("customer_id", "id"), "id")


@query("""SELECT l.quote_id, l.line_id, b.customer_name AS contact, g.country AS destination_country, f.farm_name AS supplier,
      a.variety AS v_variety FROM {quote_line} l JOIN {orders} o ON o.o_orderkey = l.quote_id JOIN {buyer} b ON b.customer_id = o.o_custkey
      LEFT JOIN {location} g ON g.location_id = b.destination_id LEFT JOIN {article} a ON a.article_id = l.article_id LEFT
      JOIN {farm} f ON f.farm_id = l.farm_id""")
def jon_quote_graph(t):
    """JON-16"""
    quotes = t("orders").select(
        C("o_orderkey").alias("quote_id"),
        C("o_custkey").alias("customer_id")
    ).join(t("buyer").select("customer_id", "destination_id"), "customer_id").withColumn("origin_id", F.lit(None).cast("int"))
    lines = t("quote_line").select("quote_id", "line_id", "article_id", "farm_id")
    return RP.quote_graph(quotes, t("buyer"), t("location"), lines, t("article"), t("farm")).select(
        "quote_id",
        "line_id",
        "contact",
        "destination_country",
        "supplier",
        "v_variety"
    )


@query(f"""WITH l AS (SELECT line_id, farm_id, raw_text, own_article FROM {{line}}), {MAPPINGS} SELECT l.line_id, EXISTS (SELECT 1 FROM mp m
      WHERE m.farm_id = l.farm_id AND m.article_id = l.own_article AND m.src = trim(regexp_replace(lower(strip_accents(l.raw_text)), '\\s+',
      ' ', 'g'))) AS has_mapping FROM l""")
def jon_mapping_flag(t):
    """JON-17"""
    lines = t("line").select("line_id", "farm_id", "raw_text", C("own_article").alias("article_id"))
    return R.mapped_flag(lines, _mappings(t), T.source_key(C("raw_text"))).select("line_id", "has_mapping")


@query(
    f"""WITH f AS (SELECT farm_id, farm_id AS position, {sql_key("replace(farm_name, '#', ' ')")} AS fk
      FROM {{farm}}), n AS (SELECT customer_id AS name_id, 'supplier ' || lpad(CAST(customer_id % 40 AS VARCHAR), 9, '0') || CASE
      WHEN customer_id % 3 = 0 THEN ' roses' ELSE '' END AS nk FROM {{buyer}}),
    h AS (SELECT name_id, farm_id, CASE WHEN nk = fk THEN 0 ELSE 1 END AS inexact, position FROM n JOIN f ON contains(fk, nk)
      OR contains(nk, fk))
    SELECT n.name_id, arg_min(farm_id, inexact * 1000000 + position) AS farm_id FROM n LEFT JOIN h USING (name_id) GROUP BY n.name_id"""
)
def jon_match_farms(t):
    """JON-18"""
    name = F.concat(
        F.lit("SUPPLIER "), F.lpad((C("customer_id") % 40).cast("string"), 9, "0"),
        F.when(C("customer_id") % 3 == 0, " Roses").otherwise(" S.A.")
    )
    farms = t("farm").select("farm_id", "farm_name", C("farm_id").alias("position"))
    return NM.match_farms(t("buyer").select(C("customer_id").alias("name_id"), name.alias("name")), farms).select("name_id", "farm_id")


@query(
    """WITH p AS (SELECT x.p_partkey AS name_id, y.n_nationkey AS known_id, """
    + f"""CASE WHEN {sql_key('x.p_name')} = {sql_key('y.n_name')} THEN 1.0
      ELSE 1.0 - CAST(levenshtein({sql_key('x.p_name')}, {sql_key('y.n_name')}) AS DOUBLE) / greatest(length({sql_key('x.p_name')}),
      length({sql_key('y.n_name')})) END"""
    + """ AS score FROM {part} x, {nation} y), r AS (SELECT *, row_number() OVER (PARTITION BY name_id
      ORDER BY round(score, 6) DESC, known_id) AS rank FROM p WHERE round(score, 6) >= 0.2)
      SELECT name_id, CAST(rank AS INT) AS rank, known_id, round(score, 6) AS score FROM r WHERE rank <= 3"""
)
def jon_suggest_names(t):
    """JON-19, SRT-07"""
    return NM.suggest_names(
        t("part").select(C("p_partkey").alias("name_id"), C("p_name").alias("name")),
        t("nation").select(C("n_nationkey").alias("known_id"), C("n_name").alias("known_name")), least=0.2
    )


@query("""SELECT quote_id, string_agg(DISTINCT CAST(farm_id AS VARCHAR), ','
      ORDER BY CAST(farm_id AS VARCHAR)) AS suppliers, count(DISTINCT farm_id) AS n FROM {quote_line} GROUP BY quote_id""")
def agg_suppliers(t):
    """AGG-10"""
    q = t("quote_line").select("quote_id", C("farm_id").cast("string").alias("farm"))
    return R.distinct_per(q, "quote_id", "farm").select("quote_id", F.array_join("values", ",").alias("suppliers"), "n")


@query(
    f"""WITH {MATCH}, o AS (SELECT l.line_id, a.article_id, row_number() OVER (PARTITION BY l.line_id
      ORDER BY a.product_name, x.variety, a.len NULLS LAST, x.box_type, x.stems_per_box, a.article_id) AS rank FROM l
      JOIN a ON a.farm_id = l.farm_id AND a.vk = l.vk AND (l.pk IS NULL OR l.pk = a.pk) JOIN {{article}} x ON x.article_id = a.article_id)
    SELECT line_id, CAST(rank AS INT) AS rank, article_id FROM o"""
)
def srt_options(t):
    """SRT-03"""
    return MA.options(t("line"), t("article"))


@query("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def srt_recent(t):
    """SRT-05, SRT-06"""
    return R.sorted_by(
        R.recent(t("orders"), "o_orderdate", "o_orderkey"),
        "o_totalprice",
        descending=True,
        tie="o_orderkey"
    ).select("o_orderkey", "o_totalprice")


@query(
    f"""WITH {MATCH} SELECT r.line_id, x.part_id % 4 = 0 AND x.length_cm IS NOT NULL OR x.part_id % 4 = 1
      AND x.variety IS NOT NULL AS rematched,
    CASE WHEN x.part_id % 4 = 0 AND x.length_cm IS NOT NULL OR x.part_id % 4 = 1 AND x.variety IS NOT NULL THEN r.match_status
      ELSE 'OLD' END AS match_status FROM r JOIN {{line}} x USING (line_id)"""
)
def mat_rematch(t):
    """MAT-06"""
    k = C("part_id") % 4
    e = t("line").select(
        "line_id", "farm_id", "product_name", "variety", "length_cm", C("product_name").alias("old_product"),
        F.when(k == 1, F.concat(C("variety"), F.lit(" old"))).otherwise(F.lower("variety")).alias("old_variety"),
        F.when(k == 0, C("length_cm") + 1).otherwise(C("length_cm")).alias("old_length"),
        F.lit("OLD").alias("old_status"), F.lit(None).cast("long").alias("old_article")
    )
    return MA.rematch_edited(e, t("article")).select("line_id", "rematched", "match_status")


@query(
    f"""WITH l AS (SELECT line_id, farm_id, raw_text FROM {{line}}), {MAPPINGS}, q AS (SELECT x.line_id, CASE
      WHEN x.part_id % 7 = 0 THEN NULL ELSE x.own_article END AS want, x.farm_id, x.raw_text,
      trim(regexp_replace(lower(strip_accents(x.raw_text)), '\\s+', ' ', 'g')) AS src FROM {{line}} x)
    SELECT q.line_id, CASE WHEN want IS NULL THEN 'NO_ARTICLE' WHEN contains(raw_text, '40-60') THEN 'LENGTH_RANGE'
      WHEN m.article_id = want THEN 'UNCHANGED' WHEN m.article_id IS NOT NULL THEN 'OTHER_TARGET' ELSE 'CREATE' END AS outcome FROM q LEFT
      JOIN mp m ON m.farm_id = q.farm_id AND m.src = q.src"""
)
def mat_save_mapping(t):
    """MAT-08"""
    r = t("line").select("line_id", "farm_id", "raw_text", F.when(C("part_id") % 7 != 0, C("own_article")).alias("article_id"))
    return MA.save_mappings(r, _mappings(t), t("article")).select("line_id", "outcome")


@query("""SELECT line_id, CASE WHEN product_name IS NOT NULL AND part_id % 2 = 0 THEN 'Rosa Ec'
      ELSE product_name END AS product_group, CAST(CASE WHEN unit = 'BOXES' THEN quantity END AS INT) AS boxes, currency,
      'UNMATCHED' AS match_status FROM {line}""")
def enr_offer_lines(t):
    """ENR-04"""
    group = F.when(C("product_name").isNotNull() & (C("part_id") % 2 == 0), " ROSES ").otherwise(C("product_name"))
    p = t("line").select(
        "line_id", "raw_text", group.alias("product_group"), "variety", "length_cm",
        C("quantity").cast("double").alias("quantity"), "unit", F.lit(None).cast("int").alias("boxes"),
        F.lit(None).cast("int").alias("stems_per_box"), F.lit("QBE").alias("box_type"),
        F.lit(None).cast("string").alias("weight"), C("fob").cast("string").alias("price"), "currency",
        F.array(F.lit(" w ")).alias("warnings")
    )
    return E.to_offer_lines(p).select("line_id", "product_group", "boxes", "currency", "match_status")


@query(
    """SELECT line_id, array_to_string(list_filter([CASE WHEN fob <= 0.5 THEN 'price missing' END, CASE
      WHEN quantity % 2 = 0 THEN 'box weight unknown' END, CASE WHEN length_cm IS NULL THEN 'NO_LENGTH' END,
      'UNIT ' || coalesce(unit, '?')], lambda m: m IS NOT NULL), '|') AS messages FROM {line}"""
)
def val_messages(t):
    """VAL-02: what was read and is still open, then what is found now, each once"""
    s = A.snapshot(warnings=F.array(F.lit("price missing"), F.lit("box weight unknown")))
    unit = F.concat(F.lit(" UNIT "), F.coalesce("unit", F.lit("?")))
    now = F.array(F.when(C("length_cm").isNull(), "NO_LENGTH").otherwise(" "), unit, unit)
    m = E.line_messages(s, {"PRICE": C("fob") > 0.5, "BOX_WEIGHT": C("quantity") % 2 == 1}, now)
    return t("line").select("line_id", F.array_join(m, "|").alias("messages"))


@query("""SELECT cost_id, CASE WHEN cost_type_id IS NULL THEN 'NO_TYPE' WHEN amount <= 0.05 THEN 'BAD_AMOUNT'
      WHEN cost_id % 3 = 0 THEN 'NO_CURRENCY' END AS code FROM {cost}""")
def val_forms(t):
    """VAL-04"""
    return t("cost").select(
        "cost_id",
        E.cost_input_code(
            C("cost_type_id").cast("string"), (C("amount") - F.lit(0.05).cast("decimal(4,2)")).cast("string"),
            F.when(C("cost_id") % 3 != 0, "EUR"), C("unit")
        ).alias("code")
    )


@query(
    """SELECT quote_id, line_id, CAST(CASE WHEN quote_id % 4 = 0 THEN NULL WHEN quote_id % 4 = 1 THEN quantity_boxes * 0.75 + stems_per_box
      ELSE manual_price END AS DOUBLE) AS manual_price
    FROM {quote_line}"""
)
def prc_override(t):
    """PRC-15"""
    q = t("quote_line").select("quote_id", "line_id", "manual_price", "quantity_boxes", "stems_per_box")
    price = F.when(C("quote_id") % 4 == 1, C("quantity_boxes") * 0.75 + C("stems_per_box")).cast("decimal(12,6)")
    o = q.where("quote_id % 4 < 2").select("quote_id", "line_id", price.alias("price"))
    return Q.override_price(q.drop("quantity_boxes", "stems_per_box"), o).withColumn("manual_price", C("manual_price").cast("double"))


@query(
    """WITH n AS (SELECT route_id, CAST(route_id % 97 * 0.125 AS DOUBLE) AS rate, 'PER_' || transport AS rate_unit FROM {route}
      WHERE route_id % 2 = 0)
    SELECT * FROM n UNION ALL SELECT route_id, CAST(rate AS DOUBLE), rate_unit FROM {current_tariff} WHERE route_id NOT IN (SELECT route_id
      FROM n)"""
)
def dml_upsert_tariff(t):
    """DML-02"""
    rate = (C("route_id") % 97 * 0.125).cast("decimal(10,4)")
    new = t("route").where("route_id % 2 = 0").select(
        "route_id",
        rate.alias("rate"),
        F.concat(F.lit("PER_"), "transport").alias("rate_unit")
    )
    return M.upsert(t("current_tariff"), new, ["route_id"]).withColumn("rate", C("rate").cast("double"))


@query("""SELECT r.route_id, CASE WHEN c.route_id IS NULL THEN 'CREATE' ELSE 'EXISTS' END AS outcome, 'HANDLING' AS category FROM {route} r
      LEFT JOIN (SELECT DISTINCT route_id FROM {cost} WHERE cost_type_id = 2) c USING (route_id)""")
def dml_add_costs(t):
    """DML-03, DML-11's guard"""
    types = t("cost").sparkSession.range(1).select(F.lit(2).alias("cost_type_id"), F.lit("HANDLING").alias("category"))
    req = t("route").select("route_id", F.lit(2).alias("cost_type_id"), C("route_id").alias("request_id"))
    return M.add_costs(req, t("cost"), types).select("route_id", "outcome", "category")


@query(
    """WITH l AS (SELECT location_id AS i, CAST(location_id * 0.37 + 1 AS DOUBLE) AS old, CAST(location_id * 0.5 + 2 AS DOUBLE) AS new
      FROM {location})
    SELECT 'EUR' AS base, 'C' || CAST(i AS VARCHAR) AS quote, CASE WHEN i % 3 = 1 THEN new ELSE old END AS rate FROM l
    UNION ALL SELECT 'EUR', 'N' || CAST(i AS VARCHAR), new FROM l WHERE i % 3 = 0"""
)
def dml_replace_rates(t):
    """DML-04"""
    i = C("location_id")
    own = lambda factor, more: (i * F.lit(factor).cast("decimal(4,2)") + more).cast("decimal(12,6)").alias("rate")
    old = t("location").select(F.lit("EUR").alias("base"), F.concat(F.lit("C"), i).alias("quote"), own("0.37", 1))
    new = t("location").select(
        F.when(i % 3 == 2, "USD").otherwise("EUR").alias("base"),
        F.concat(F.when(i % 3 == 0, "N").otherwise("C"), i).alias("quote"), own("0.50", 2)
    )
    return M.replace_rates(old, new).withColumn("rate", C("rate").cast("double"))


@query(f"""WITH l AS (SELECT line_id, farm_id, raw_text FROM {{line}}), {MAPPINGS} SELECT article_id * 2 AS mapping_id, CASE article_id % 3
      WHEN 0 THEN 'OK' WHEN 1 THEN 'ARTICLE_GONE' ELSE 'NOT_FOUND' END AS outcome FROM mp WHERE article_id % 3 < 2 UNION ALL
      SELECT -article_id, 'NOT_FOUND' FROM mp WHERE article_id % 3 = 2""")
def dml_retarget_mapping(t):
    """DML-10"""
    m = _mappings(t)
    k = C("article_id") % 3
    changes = m.select(
        F.when(k == 2, -C("article_id")).otherwise(C("mapping_id")).alias("mapping_id"),
        F.when(k == 1, F.lit(-5)).otherwise(C("article_id")).cast("long").alias("article_id")
    )
    return M.retarget_mappings(changes, m, t("article")).select("mapping_id", "outcome")


@query("""SELECT location_id, CASE WHEN location_id % 3 = 0 THEN 'EXISTS' WHEN location_id % 3 = 1 AND location_id > 1 THEN 'EXISTS'
      WHEN location_id % 3 = 1 THEN 'CREATE' ELSE 'INVALID' END AS outcome FROM {location}""")
def dml_add_unique(t):
    """DML-11"""
    i = C("location_id")
    req = t("location").select(
        "location_id", F.when(i % 3 == 0, F.upper("city")).when(i % 3 == 1, " New town ").otherwise("").alias("city"),
        F.when(i % 3 == 1, "Here").otherwise(C("country")).alias("country")
    )
    return M.add_unique(req, t("location"), ["city", "country"], "location_id").select("location_id", "outcome")


@query(
    """WITH v AS (SELECT article_id, stem_length, CASE article_id % 4 WHEN 0 THEN ' ' || CAST(variant_id % 90 + 10 AS VARCHAR) || ' CM'
      WHEN 2 THEN CAST(variant_id % 90 + 10 AS VARCHAR) || 'cm+' ELSE color END AS grade FROM {article}),
      k AS (SELECT *, stem_length IS NULL AND regexp_matches(grade, '(?i)^\\s*[0-9]+\\s*cm\\s*$') AS moved FROM v)
    SELECT article_id, CASE WHEN moved THEN regexp_extract(grade, '[0-9]+') ELSE stem_length END AS stem_length, CASE
      WHEN NOT moved THEN grade END AS grade FROM k"""
)
def dml_length_from_grade(t):
    """DML-13"""
    k, length = C("article_id") % 4, (C("variant_id") % 90 + 10).cast("string")
    grade = F.when(k == 0, F.concat(F.lit(" "), length, F.lit(" CM"))).when(k == 2, F.concat(length, F.lit("cm+"))).otherwise(C("color"))
    return M.length_from_grade(t("article").select("article_id", "stem_length", grade.alias("grade")))


@query("""SELECT location_id, coalesce(code, CASE WHEN regexp_full_match(city, 'City [0-9]*[02468]') THEN 'C' || regexp_extract(city,
      '[0-9]+') END) AS code FROM {location}""")
def dml_backfill_codes(t):
    """DML-15: codes of every second city"""
    return M.backfill_codes(t("location"), {f"city {i}": f"C{i}" for i in range(0, 100, 2)}).select("location_id", "code")


@query("""SELECT quote_id AS offer_id FROM (SELECT o_orderkey AS quote_id FROM {orders}) WHERE quote_id % 2 = 0
      AND quote_id NOT IN (SELECT quote_id FROM {quote_line} WHERE quantity_boxes > 45)""")
def dml_delete_offers(t):
    """DML-07"""
    offers = t("orders").select(C("o_orderkey").alias("offer_id"), C("o_orderkey").alias("upload_id"))
    quoted = t("quote_line").where("quantity_boxes > 45").select("line_id")
    return M.delete_offers(
        offers.where("offer_id % 2 = 0"), offers, t("line").select("offer_id", "line_id"), quoted,
        offers.select("upload_id")
    )[0].select("offer_id")


@query(
    """WITH r AS (SELECT article_id, CAST((article_id % 977 + 3) * 0.013 AS DECIMAL(12,6)) AS rate FROM {article})
    SELECT article_id, CASE article_id % 3 WHEN 1 THEN CAST(rate AS DOUBLE) WHEN 2 THEN round(1.0 / CAST(rate AS DOUBLE), 6) END AS rate
      FROM r"""
)
def num_display_rate(t):
    """NUM-04, NUM-05"""
    k = C("article_id") % 3
    rate = ((C("article_id") % 977 + 3).cast("decimal(6,0)") * F.lit("0.013").cast("decimal(4,3)")).cast("decimal(12,6)")
    shown = N.display_rate(rate, F.when(k == 1, "EUR").otherwise("USD"), F.when(k == 2, "EUR").otherwise("USD"))
    return t("article").select("article_id", shown.cast("double").alias("rate"))
