"""One query for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import numbers as N
from ..functions import text as T
from ..operators import enrich as E
from ..operators import maintain as M
from ..operators import match as MA
from ..operators import parse as P
from ..operators import pricing as PR
from ..operators import quotes as Q
from ..operators import relational as R
from ..operators import reports as RP
from ..operators import tables as TB
from ..sources import files as FI
from .domain import duckdb_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The time at which validity is judged.
AS_OF = "2024-06-15 12:00:00"
C = F.col


def query(sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda name: table(spark, sf_dir, name))

        run.__doc__, run.__name__ = build.__doc__, build.__name__
        QUERIES[build.__name__] = run
        if sql:
            ORACLE[build.__name__] = duckdb_sql(sql)
        return run

    return register


def dbl(c, scale: int = 6):
    """A rounded decimal as a double, for comparison."""
    return F.round(c.cast("decimal(28,12)"), scale).cast("double")


# --- SQL of text functions -----------------------------------------------------------------------

DECIMAL = r"""CASE WHEN regexp_full_match({p}, '[0-9]+(\.[0-9]+)?') THEN {p} END"""


def sql_decimal(x: str) -> str:
    s = f"regexp_replace({x}, '[^0-9.,]', '', 'g')"
    first = lambda y: f"regexp_replace({y}, '^([^,]*),', '\\1.')"
    plain = f"""CASE WHEN contains({s}, ',') AND contains({s}, '.') AND regexp_matches({s},
      ',[^.]*$') THEN {first(f'replace({s}, chr(46), chr(32))').replace('chr(32)', repr(''))} WHEN contains({s}, ',')
      AND contains({s}, '.') THEN replace({s}, ',', '') ELSE {first(s)} END"""
    return DECIMAL.format(p=f"({plain})")


def sql_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sql_length(x: str) -> str:
    return f"CAST(nullif(regexp_extract(regexp_replace({x}, ',', '.'), '([0-9]+(?:\\.[0-9]+)?)', 1), '') AS DOUBLE)"


# --- text ----------------------------------------------------------------------------------------


@query(f"SELECT text_id, {sql_decimal('text')} AS price, {sql_length('text')} AS length_cm FROM {{offer_text}}")
def par_decimal_normalize(t):
    """STR-01, STR-02"""
    return t("offer_text").select("text_id", T.decimal_string(C("text")).alias("price"), T.length_cm(C("text")).alias("length_cm"))


@query(
    r"""SELECT text_id, CAST(nullif(regexp_extract(text, '(?i)(\d+)\s*(?:QB|HB|FB)\s*[x×*]?\s*(\d+)', 1), '') AS INT) AS boxes,
    CAST(nullif(regexp_extract(text, '(?i)(\d+)\s*(?:QB|HB|FB)\s*[x×*]?\s*(\d+)', 2), '') AS INT) AS stems,
    coalesce(nullif(upper(regexp_extract(text, '(?i)\b(QB|HB|FB)\b', 1)), ''), 'QB') AS box_type,
    CAST(nullif(regexp_extract(text, '(?i)additional\s+time\s+required\s+(\d+)\s*hr', 1), '') AS INT) AS lead_hours,
    CASE WHEN regexp_matches(text, '(?i)\bselect\b') THEN 'select' WHEN regexp_matches(text, '(?i)\bpremium\b') THEN 'premium' END AS grade,
    CASE WHEN regexp_matches(text, '(?i)\btinted\b') THEN 'tinted' WHEN regexp_matches(text,
      '(?i)\bpainted\b') THEN 'painted' END AS treatment
    FROM {offer_text}"""
)
def str_line_patterns(t):
    """STR-03 to STR-06"""
    box = T.box_pattern(C("text"))
    return t("offer_text").select(
        "text_id", box["boxes"].alias("boxes"), box["stems"].alias("stems"), T.box_type(C("text")).alias("box_type"),
        T.lead_time_hours(C("text")).alias("lead_hours"), T.grade(C("text")).alias("grade"),
        T.treatment(C("text")).alias("treatment")
    )


@query(f"""SELECT doc_id, md5({sql_key("text")}) AS key_md5, md5(trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ',
      'g'))) AS source_md5 FROM {{documents}}""")
def str_match_key(t):
    """STR-07, STR-08 over whole documents"""
    return t("documents").select(
        "doc_id",
        F.md5(T.match_key(C("text"))).alias("key_md5"),
        F.md5(T.source_key(C("text"))).alias("source_md5")
    )


@query(
    """WITH k AS (SELECT p_partkey, p_name AS a, p_type || ' ' || p_name AS b FROM {part})
    SELECT p_partkey, CASE WHEN a = b THEN 1.0 ELSE round(1.0 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)),
      9) END AS similarity
    FROM (SELECT p_partkey, """
    + sql_key("a")
    + " AS a, "
    + sql_key("b")
    + " AS b FROM k)"
)
def str_similarity(t):
    """STR-09, STR-10"""
    return t("part").select("p_partkey", F.round(T.similarity(C("p_name"), F.concat_ws(" ", "p_type", "p_name")), 9).alias("similarity"))


@query(
    r"""WITH s AS (SELECT farm_id, farm_name, country, CASE farm_id % 5 WHEN 0 THEN ' Rosas ' WHEN 1 THEN 'hyd' WHEN 2 THEN 'ROSES'
      WHEN 3 THEN 'mini carnation' ELSE country END AS label FROM {farm})
    SELECT farm_id, label, CASE lower(trim(label)) WHEN 'hyd' THEN 'Hydrangea' WHEN 'roses' THEN 'Rose'
      WHEN 'mini carnation' THEN 'Mini Carnation' END IS NOT NULL AS recognized,
    CASE WHEN lower(trim(label)) IN ('rose', 'roses', 'rosa', 'rosa ec') THEN 'Rosa Ec' ELSE label END AS rose, """
    + sql_key("replace(farm_name, 'Supplier', 'Flores')")
    + r""" AS farm_key, country || ' - ' || label AS variant FROM s"""
)
def str_product_labels(t):
    """STR-11, STR-12, STR-18, STR-21"""
    label = F.when(C("farm_id") % 5 == 0, " Rosas ").when(C("farm_id") % 5 == 1, "hyd").when(C("farm_id") % 5 == 2, "ROSES").when(
        C("farm_id") % 5 == 3,
        "mini carnation"
    ).otherwise(C("country"))
    s = t("farm").withColumn("label", label)
    name = F.concat(F.replace("farm_name", F.lit("Supplier"), F.lit("Flores")), F.lit(" S.A.S. Ltda"))
    return s.select(
        "farm_id", "label", T.product_group(C("label"))["recognized"].alias("recognized"),
        T.rose_label(C("label")).alias("rose"), T.farm_key(name).alias("farm_key"),
        T.variant_label(C("country"), C("label"), F.lit(""), F.lit(None).cast("string"), F.lit("")).alias("variant")
    )


@query(
    r"""SELECT article_id, CASE WHEN regexp_matches(stem_length, '^\d+\s*(cm)?$')
      AND CAST(regexp_extract(stem_length, '^(\d+)', 1) AS BIGINT) > 0 THEN regexp_extract(stem_length, '^(\d+)', 1) END AS value,
    nullif(regexp_extract(variety || ' ' || coalesce(stem_length, ''), '(?i)\s(\d+)\s*cm$', 1), '') AS hint,
    CAST(regexp_extract(stem_length, '(\d+)', 1) AS DOUBLE) AS exact,
    nullif(regexp_extract("""
    + sql_key("variety")
    + r""", '^garden (.+)$', 1), '') AS garden, CASE WHEN box_type = 'HB' THEN 'QB' ELSE box_type END AS import_box FROM {article}"""
)
def str_lengths(t):
    """STR-14 to STR-17, STR-19"""
    return t("article").select(
        "article_id", T.assortment_length(C("stem_length"))["value"].alias("value"),
        T.trailing_length(F.concat_ws(" ", "variety", F.coalesce("stem_length", F.lit("")))).alias("hint"),
        T.exact_length_cm(C("stem_length")).alias("exact"), T.without_garden(T.match_key(C("variety"))).alias("garden"),
        T.import_box_type(C("box_type")).alias("import_box")
    )


@query(r"""SELECT line_id, CASE WHEN unit = 'STEMS' THEN quantity WHEN unit = 'BOXES' THEN quantity * 40
      WHEN unit = 'BUNCHES' THEN quantity * 10 END::BIGINT AS total_stems, CASE
      WHEN unit = 'BOXES' THEN quantity END::INT AS boxes, fob > 0 AS valid_fob FROM {line}""")
def num_quantities(t):
    """NUM-01 to NUM-03"""
    return t("line").select(
        "line_id", N.total_stems(C("quantity"), C("unit"), F.lit(40), F.lit(10)).alias("total_stems"),
        N.boxes_available(C("quantity"), C("unit")).alias("boxes"),
        N.valid_fob(C("fob").cast("string")).alias("valid_fob")
    )


@query(
    r"""WITH w AS (SELECT line_id, CASE WHEN length_cm IS NULL THEN ['Price per stem missing', ' ', 'box weight unknown']
      ELSE ['Farm name?', 'unit and price'] END AS a, ['box weight unknown ', 'Hello'] AS b FROM {line})
    SELECT line_id, CASE WHEN len(a) = 3 THEN 'Price per stem missing|box weight unknown|Hello'
      ELSE 'Farm name?|unit and price|box weight unknown|Hello' END AS merged,
    CASE WHEN len(a) = 3 THEN 'PRICE' ELSE 'FARM' END AS topics, CASE WHEN len(a) = 3 THEN 'Price per stem missing|box weight unknown'
      ELSE 'Farm name?|unit and price' END AS cleaned,
    CASE WHEN len(a) = 3 THEN ' ' ELSE '' END AS open FROM w"""
)
def arr_messages(t):
    """ARR-01 to ARR-04"""
    lit = lambda xs: F.array(*(F.lit(x) for x in xs))
    a = F.when(
        C("length_cm").isNull(),
        lit(["Price per stem missing", " ", "box weight unknown"])
    ).otherwise(lit(["Farm name?", "unit and price"]))
    w = t("line").select("line_id", a.alias("a"))
    return w.select(
        "line_id", F.array_join(A.merge_messages(C("a"), lit(["box weight unknown ", "Hello"])), "|").alias("merged"),
        F.array_join(A.warning_topics(C("a")[0]), "|").alias("topics"),
        F.array_join(A.clean_messages(C("a")), "|").alias("cleaned"),
        F.array_join(A.reconcile(C("a"), {}), "|").alias("open")
    )


# --- sources -------------------------------------------------------------------------------------

STRIP = r"""replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style.*?</style>', '', 'g'), '(?is)<script.*?</script>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|tr|li)>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"""


@query(f"""SELECT page_id, md5(regexp_replace(regexp_replace({STRIP}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10),
      'g')) AS text_md5 FROM {{pages}}""".replace("{3,}", "{3,}"))
def src_html_strip(t):
    """SRC-10"""
    return t("pages").select("page_id", F.md5(FI.strip_html(C("html"))).alias("text_md5"))


@query(
    r"""WITH n AS (SELECT farm_id, 'Offer ' || CASE farm_id % 7 WHEN 0 THEN 'a.b.PDF' WHEN 1 THEN 'x.csv' WHEN 2 THEN 'noext'
      WHEN 3 THEN 'm.eml' WHEN 4 THEN 'p.JPEG' WHEN 5 THEN 'q.xls' ELSE 'z.zip' END AS name, CASE farm_id % 4 WHEN 0 THEN 'text/csv'
      WHEN 1 THEN 'image/webp' END AS kind FROM {farm})
    SELECT farm_id, CASE farm_id % 4 WHEN 0 THEN 'EXCEL' WHEN 1 THEN 'IMAGE' ELSE CASE farm_id % 7 WHEN 0 THEN 'PDF' WHEN 1 THEN 'EXCEL'
      WHEN 3 THEN 'EMAIL' WHEN 4 THEN 'IMAGE' WHEN 5 THEN 'EXCEL' ELSE 'MANUAL' END END AS file_kind,
    CASE WHEN farm_id % 4 = 1 THEN 'image/webp' WHEN farm_id % 7 = 4 THEN 'image/jpeg' END AS image_type,
    CASE WHEN farm_id % 4 = 0 OR farm_id % 7 = 1 THEN 'csv' WHEN farm_id % 7 = 5 THEN 'xls' ELSE 'xlsx' END AS sheet_kind FROM n"""
)
def src_file_kinds(t):
    """SRC-01 to SRC-03"""
    names = ["a.b.PDF", "x.csv", "noext", "m.eml", "p.JPEG", "q.xls", "z.zip"]
    name = F.concat(F.lit("Offer "), F.element_at(F.array(*(F.lit(x) for x in names)), (C("farm_id") % 7 + 1).cast("int")))
    kind = F.when(C("farm_id") % 4 == 0, "text/csv").when(C("farm_id") % 4 == 1, "image/webp")
    return t("farm").select(
        "farm_id", FI.file_kind(name, kind).alias("file_kind"), FI.image_type(name, kind).alias("image_type"),
        FI.sheet_kind(name, kind).alias("sheet_kind")
    )


# --- parsing -------------------------------------------------------------------------------------


@query(
    r"""WITH l AS (SELECT text_id, trim(text, ' ' || chr(9)) AS line FROM {offer_text})
    SELECT text_id, line FROM l WHERE line <> '' AND NOT regexp_matches(line,
      '(?i)^(hi|hello|dear|hey|buenos|good\s+(morning|afternoon|evening))\b')
      AND NOT regexp_matches(line, '(?i)^(from|sent|to|subject|cc|bcc)\s*:')
    AND (regexp_matches(line, '\$\s*[\d.,]+') OR regexp_matches(line, '(?i)\d+\s*(?:QB|HB|FB)\s*[x×*]?\s*\d+'))
      AND regexp_matches(line, '\S\s+\S')"""
)
def par_segment_lines(t):
    """PAR-01"""
    return P.offer_lines(t("offer_text")).select("text_id", "line")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS line FROM {documents}),
    k AS (SELECT doc_id, CASE WHEN NOT regexp_matches(line, '[A-Za-z]{2,}') THEN 'A' WHEN regexp_matches(line, '(?i)\d{1,3}\s*cm')
      OR regexp_matches(line, '\b\d{2,3}\s*[-–—]\s*\d{2,3}\b') OR regexp_matches(line, '(?i)\b\d+\s*(?:qb|hb|fb)\b')
      OR regexp_matches(line, '(?i)\b(?:qb|hb|fb)\s*[x×*]\s*\d+\b') OR regexp_matches(line, '\d+[.,]\d{1,3}\b') THEN 'B'
        ELSE 'A' END AS kind FROM l)
    SELECT doc_id, kind, count(*) AS n FROM k GROUP BY doc_id, kind"""
)
def par_classify_lines(t):
    """PAR-19 over the lines of all documents"""
    return P.numbered_lines(t("documents").select("doc_id", "text")).groupBy(
        "doc_id",
        P.line_class(C("line")).alias("kind")
    ).agg(F.count("*").alias("n"))


@query(
    r"""WITH x AS (SELECT text_id // 7000 AS doc, text_id, CAST(nullif(regexp_extract(text,
      '(?i)^\s*(\d{1,3})\s*cm\b\s*[:=]?\s*[$€]?\s*(\d+(?:[.,]\d+)?)\s*(?:usd|eur|\$|€)?\s*$', 1), '') AS INT) AS length,
      regexp_extract(text, '(?i)^\s*(\d{1,3})\s*cm\b\s*[:=]?\s*[$€]?\s*(\d+(?:[.,]\d+)?)\s*(?:usd|eur|\$|€)?\s*$', 2) AS price
        FROM {offer_text})
    SELECT doc, length, arg_max(price, text_id) AS price FROM x WHERE length > 0 GROUP BY doc, length"""
)
def par_price_tiers(t):
    """PAR-21, PAR-22"""
    docs = t("offer_text").groupBy(F.floor(C("text_id") / 7000).alias("doc")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text_id", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    return P.shared_price_table(docs, "doc")


@query(
    r"""WITH tiers AS (SELECT farm_id AS doc, v * 10 + 20 AS length, CAST(v * 3 + farm_id % 4 AS VARCHAR) AS price
      FROM {farm}, (SELECT unnest(range(1, 6)) AS v) WHERE (farm_id + v) % 4 <> 0),
    lines AS (SELECT line_id, farm_id AS doc, CASE part_id % 4 WHEN 0 THEN '30-50' WHEN 1 THEN '40' WHEN 2 THEN '90 to 99' END AS spec, CASE
      WHEN part_id % 3 = 0 THEN '0.5' END AS price,
      CASE part_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 40 WHEN 2 THEN 90 END AS lo, CASE part_id % 4 WHEN 0 THEN 50 WHEN 1 THEN 40
        WHEN 2 THEN 99 END AS hi FROM {line}),
    j AS (SELECT l.*, t.length AS tl, t.price AS tp, row_number() OVER (PARTITION BY l.doc, l.line_id
      ORDER BY t.length) - 1 AS child_no, EXISTS (SELECT 1 FROM tiers x WHERE x.doc = l.doc) AS has FROM lines l LEFT
      JOIN tiers t ON t.doc = l.doc AND t.length BETWEEN l.lo AND l.hi)
    SELECT line_id, CAST(child_no AS INT) AS child_no, CAST(CASE WHEN NOT has OR lo IS NULL THEN NULL WHEN lo < hi THEN tl
      ELSE lo END AS DOUBLE) AS length_cm,
      CASE WHEN NOT has OR lo IS NULL THEN price WHEN lo < hi THEN tp ELSE coalesce(price, tp) END AS price,
      CAST(CASE WHEN NOT has OR lo IS NULL THEN 0 WHEN lo < hi AND tl IS NULL THEN 1 WHEN lo < hi AND child_no = 0 THEN (CASE
        WHEN EXISTS (SELECT 1 FROM tiers x WHERE x.doc = j.doc AND x.length = lo) THEN 0 ELSE 1 END) + (CASE WHEN EXISTS (SELECT 1
        FROM tiers x WHERE x.doc = j.doc AND x.length = hi) THEN 0 ELSE 1 END)
        WHEN lo = hi AND price IS NULL AND tl IS NULL THEN 1 ELSE 0 END AS INT) AS n_warnings FROM j"""
)
def par_range_expand(t):
    """PAR-23, PAR-25, PAR-26, JON-07"""
    tiers = t("farm").select(C("farm_id").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("v")).where((C("doc") + C("v")) % 4 != 0).select(
        "doc",
        (C("v") * 10 + 20).alias("length"),
        (C("v") * 3 + C("doc") % 4).cast("string").alias("price")
    )
    k = C("part_id") % 4
    lines = t("line").select(
        "line_id", C("farm_id").alias("doc"),
        F.when(k == 0, "30-50").when(k == 1, "40").when(k == 2, "90 to 99").alias("length_raw"),
        F.when(C("part_id") % 3 == 0, "0.5").alias("price"), F.array().cast("array<string>").alias("warnings")
    )
    return P.expand_length_ranges(lines, tiers, "doc", "line_id").select(
        "line_id",
        "child_no",
        "length_cm",
        "price",
        F.size("warnings").alias("n_warnings")
    )


CHUNKS = r"""WITH RECURSIVE listed AS (SELECT -1 - farm_id AS doc_id,
      'Offer of ' || farm_id || chr(10) || chr(10) || string_agg(CASE part_id % 7 WHEN 0 THEN upper(substr(raw_text, 8))
      WHEN 1 THEN part_id % 90 || ' cm 0.2' WHEN 2 THEN raw_text
        ELSE raw_text || ' ' || part_id % 90 || 'cm 0.' || quantity END, chr(10) ORDER BY line_id) || chr(10) || 'Thank you' AS text
          FROM {line} GROUP BY farm_id),
    texts AS (SELECT doc_id, text FROM {documents} UNION ALL SELECT doc_id, text FROM listed),
    l AS (SELECT doc_id, text, unnest(regexp_split_to_array(text, '\r?\n')) AS raw, generate_subscripts(regexp_split_to_array(text,
      '\r?\n'), 1) AS pos FROM texts WHERE text IS NOT NULL),
    k AS (SELECT *, strlen(raw) + 1 AS bytes, CASE WHEN CAST(nullif(regexp_extract(raw, '{tier}', 1), '') AS INT) > 0 THEN 'C'
      WHEN NOT regexp_matches(raw, '[A-Za-z]{{2,}}') THEN 'A'
      WHEN regexp_matches(raw, '(?i)\d{{1,3}}\s*cm') OR regexp_matches(raw, '\b\d{{2,3}}\s*[-–—]\s*\d{{2,3}}\b')
        OR regexp_matches(raw, '(?i)\b\d+\s*(?:qb|hb|fb)\b')
        OR regexp_matches(raw, '(?i)\b(?:qb|hb|fb)\s*[x×*]\s*\d+\b') OR regexp_matches(raw, '\d+[.,]\d{{1,3}}\b') THEN 'B'
          ELSE 'A' END AS kind FROM l),
    d AS (SELECT doc_id, any_value(text) AS text, count(*) FILTER (kind = 'B') AS b, min(pos) FILTER (kind = 'B') AS first FROM k
      GROUP BY doc_id),
    long AS (SELECT * FROM d WHERE (b > 30 OR strlen(text) > 12000) AND b > 0),
    body AS (SELECT k.*, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM k JOIN long USING (doc_id) WHERE kind <> 'C'
      AND pos >= first),
    fold AS (
      SELECT doc_id, CAST(0 AS BIGINT) AS i, 0 AS chunk, CAST(0 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS held FROM long
      UNION ALL
      SELECT f.doc_id, b.i, CASE WHEN f.rows >= 22 OR f.held >= 12000 THEN chunk + 1 ELSE chunk END, CASE WHEN f.rows >= 22
        OR f.held >= 12000 THEN 0 ELSE f.rows END + CASE WHEN kind = 'B' THEN 1 ELSE 0 END,
        CASE WHEN f.rows >= 22 OR f.held >= 12000 THEN 0 ELSE f.held END + bytes
      FROM fold f JOIN body b ON b.doc_id = f.doc_id AND b.i = f.i + 1),
    e AS (SELECT doc_id, max(chunk) AS last, arg_max(rows, i) AS rows, arg_max(held, i) AS held FROM fold GROUP BY doc_id),
    c AS (SELECT b.doc_id, b.i, b.raw, b.kind, CASE WHEN f.chunk = e.last AND e.rows = 0 AND e.held < 12000 AND f.chunk > 0 THEN f.chunk - 1
      ELSE f.chunk END AS chunk FROM body b JOIN fold f USING (doc_id, i) JOIN e USING (doc_id)),
    h AS (SELECT long.doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos), '') AS header FROM long LEFT JOIN k ON k.doc_id = long.doc_id
      AND kind <> 'C' AND pos < first GROUP BY long.doc_id)
    SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(max(chunk) OVER (PARTITION BY doc_id) + 1 AS INT) AS total,
      CAST(n AS INT) AS product_rows, body_md5, md5(header) AS header_md5
    FROM (SELECT doc_id, chunk, count(*) FILTER (kind = 'B') AS n, md5(string_agg(raw, chr(10) ORDER BY i)) AS body_md5 FROM c
      GROUP BY doc_id, chunk) JOIN h USING (doc_id)
    UNION ALL SELECT doc_id, 0, 1, CAST(b AS INT), md5(text), md5('') FROM d WHERE doc_id NOT IN (SELECT doc_id FROM long)"""


@query(
    CHUNKS.replace(
        "{tier}",
        r"(?i)^\s*(\d{1,3})\s*cm\b\s*[:=]?\s*[$€]?\s*(\d+(?:[.,]\d+)?)\s*(?:usd|eur|\$|€)?\s*$"
    ).replace("{{", "{").replace("}}", "}")
)
def par_chunks(t):
    """PAR-20: documents, and the lines of each farm as one long list"""
    k = C("part_id") % 7
    length = (C("part_id") % 90).cast("string")
    priced = F.concat(C("raw_text"), F.lit(" "), length, F.lit("cm 0."), C("quantity").cast("string"))
    line = F.when(
        k == 0,
        F.upper(F.substring("raw_text", 8, 1000))
    ).when(k == 1, F.concat(length, F.lit(" cm 0.2"))).when(k == 2, C("raw_text")).otherwise(priced)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_id", line.alias("l")))), lambda x: x["l"]), "\n")
    listed = t("line").groupBy("farm_id").agg(body.alias("body"))
    listed = listed.select(
        (-1 - C("farm_id")).alias("doc_id"),
        F.concat(F.lit("Offer of "), C("farm_id").cast("string"), F.lit("\n\n"), "body", F.lit("\nThank you")).alias("text")
    )
    chunks = P.chunk_offers(t("documents").select("doc_id", "text").unionByName(listed), "doc_id")
    return chunks.select("doc_id", "chunk", "total", "product_rows", F.md5("body").alias("body_md5"), F.md5("header").alias("header_md5"))


@query(
    """SELECT article_id, 'Farm ' || farm_id AS supplier, CAST(stems_per_box AS INT) AS stems_per_box, box_type FROM {article}
      WHERE box_weight IS NOT NULL AND article_id % 4 <> 0"""
)
def par_assortment_paste(t):
    """PAR-29: pasted rows of the assortment read back"""
    weight = F.coalesce(C("box_weight").cast("string"), F.lit(""))
    stems = F.when(C("article_id") % 4 == 0, F.lit("?")).otherwise(C("stems_per_box").cast("string"))
    rows = t("article").select(
        "article_id",
        F.concat_ws(
            "\t", F.concat(F.lit(" Farm "), C("farm_id")), F.concat_ws(" ", "product_name", "variety"),
            F.coalesce("stem_length", F.lit("")), "box_type", stems, weight
        ).alias("line")
    )
    return P.assortment_paste(rows).select("article_id", "supplier", "stems_per_box", "box_type")


# --- matching ------------------------------------------------------------------------------------

MATCH = (
    """l AS (SELECT line_id, farm_id, raw_text, """
    + f"nullif({sql_key('product_name')}, '') AS pk, nullif({sql_key('variety')}, '') AS vk, length_cm FROM {{line}}), "
    + f"""a AS (SELECT article_id, farm_id, variant_id, product_id, product_name, {sql_key("product_name")} AS pk,
      {sql_key("variety")} AS vk, CAST(regexp_extract(stem_length, '(\\d+)', 1) AS DOUBLE) AS len FROM {{article}}), """
    + """c AS (SELECT l.line_id, l.pk, l.vk, l.length_cm, a.article_id, a.variant_id, a.product_id, a.product_name, a.len, CASE
      WHEN a.vk = l.vk THEN 0 ELSE 1 END AS tier
      FROM l JOIN a ON l.farm_id = a.farm_id AND (l.pk IS NULL OR l.pk = a.pk) AND (a.vk = l.vk OR a.vk = 'garden ' || l.vk)),
    best AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY line_id) AS m FROM c) WHERE tier = m),
    s AS (SELECT l.line_id, any_value(l.pk) AS pk, any_value(l.vk) AS vk, any_value(l.length_cm) AS length_cm, count(b.article_id) AS n,
      count(b.article_id) FILTER (l.length_cm IS NULL OR b.len = l.length_cm) AS n_at,
      count(DISTINCT b.product_id) FILTER (l.length_cm IS NULL OR b.len = l.length_cm) AS np, count(DISTINCT b.variant_id) AS nv,
        count(DISTINCT b.variant_id) FILTER (l.length_cm IS NULL OR b.len = l.length_cm) AS nv_at,
      min(b.variant_id) AS v, min(b.variant_id) FILTER (l.length_cm IS NULL
        OR b.len = l.length_cm) AS v_at, min(b.article_id) FILTER (l.length_cm IS NULL
        OR b.len = l.length_cm) AS art, min(b.product_name) FILTER (l.length_cm IS NULL OR b.len = l.length_cm) AS pname
      FROM l LEFT JOIN best b USING (line_id) GROUP BY l.line_id),
    r AS (SELECT line_id, CASE WHEN vk IS NULL THEN 'UNMATCHED' WHEN pk IS NOT NULL THEN CASE WHEN length_cm IS NULL
      OR n_at = 0 THEN 'UNMATCHED' WHEN n_at = 1 THEN 'AUTO_MATCHED' ELSE 'AMBIGUOUS' END
        WHEN n_at = 0 THEN 'UNMATCHED' WHEN np = 1 AND n_at = 1 THEN 'DERIVED' ELSE 'AMBIGUOUS' END AS match_status,
      CASE WHEN vk IS NULL THEN NULL WHEN pk IS NOT NULL AND length_cm IS NULL THEN CASE WHEN nv = 1 THEN v END
        WHEN pk IS NOT NULL THEN CASE WHEN nv_at = 1 THEN v_at END WHEN np = 1 AND nv_at = 1 THEN v_at END AS variant_id,
      CASE WHEN pk IS NULL AND vk IS NOT NULL AND np = 1 THEN pname END AS derived_product, CAST(CASE WHEN vk IS NULL THEN 0
        WHEN pk IS NOT NULL AND (length_cm IS NULL OR n_at = 0) THEN n ELSE n_at END AS BIGINT) AS n_options,
      CASE WHEN n_at = 1 AND NOT (pk IS NOT NULL AND length_cm IS NULL) AND vk IS NOT NULL THEN art END AS article_id FROM s)"""
)


@query(f"WITH {MATCH} SELECT line_id, match_status, article_id, variant_id, derived_product, n_options FROM r")
def mat_outcomes(t):
    """MAT-01 to MAT-03, JON-01, JON-03 to JON-05, AGG-06: all nine outcomes"""
    return MA.match_lines(t("line"), t("article")).select(
        "line_id",
        "match_status",
        "article_id",
        "variant_id",
        "derived_product",
        "n_options"
    )


def _mappings(t):
    m = t("article").where("variant_id % 3 = 0").select(C("farm_id"), C("variant_id"), "article_id").join(
        t("part").select(C("p_partkey").alias("variant_id"), "p_name"),
        "variant_id"
    )
    text = F.concat(F.lit("row "), (C("variant_id") % 50).cast("string"), F.lit(" "), C("p_name"))
    return m.groupBy("farm_id", T.source_key(text).alias("normalized_source")).agg(F.min("article_id").alias("article_id")).withColumns(
        {"mapping_id": C("article_id") * 2, "times_used": F.lit(3).cast("long"), "last_used_at": F.lit("2024-01-01").cast("timestamp")}
    )


MAPPINGS = """mp AS (SELECT farm_id, trim(regexp_replace(lower(strip_accents('row ' || CAST(variant_id % 50 AS VARCHAR) || ' ' || p_name)),
      '\\s+', ' ', 'g')) AS src, min(article_id) AS article_id FROM {article} JOIN {part} ON variant_id = p_partkey WHERE variant_id % 3 = 0
      GROUP BY 1, 2),
    used AS (SELECT l.line_id, m.article_id, m.article_id * 2 AS mapping_id FROM l JOIN mp m ON m.farm_id = l.farm_id
      AND m.src = trim(regexp_replace(lower(strip_accents(l.raw_text)), '\\s+', ' ', 'g')) WHERE NOT contains(l.raw_text, '40-60'))"""


@query(f"""WITH {MATCH}, {MAPPINGS} SELECT r.line_id, CASE WHEN u.line_id IS NOT NULL THEN 'USER_LINKED'
      ELSE match_status END AS match_status, CASE WHEN u.line_id IS NOT NULL THEN u.article_id
      ELSE r.article_id END AS article_id, u.line_id IS NOT NULL AS matched_via_mapping FROM r LEFT JOIN used u USING (line_id)""")
def mat_mapping_first(t):
    """MAT-04, JON-02, PAR-24"""
    return MA.map_then_match(t("line"), _mappings(t), t("article")).select("line_id", "match_status", "article_id", "matched_via_mapping")


@query(f"""WITH l AS (SELECT line_id, farm_id, raw_text FROM {{line}}), {MAPPINGS}
      SELECT m.article_id * 2 AS mapping_id, CAST(3 + count(u.line_id) AS BIGINT) AS times_used, count(u.line_id) > 0 AS used_now FROM mp m
      LEFT JOIN used u ON u.mapping_id = m.article_id * 2 GROUP BY m.article_id""")
def agg_mapping_usage(t):
    """AGG-04"""
    mappings = _mappings(t)
    used = MA.mapping_usage(MA.map_then_match(t("line"), mappings, t("article")), mappings, AS_OF)
    return used.select("mapping_id", "times_used", (C("last_used_at") > F.lit("2024-01-01").cast("timestamp")).alias("used_now"))


@query(
    f"""WITH n AS (SELECT line_id, {sql_key("variety")} IS DISTINCT FROM {sql_key("lower(variety) || ' x'")} AS changed_variety,
      length_cm IS DISTINCT FROM CASE WHEN part_id % 2 = 0 THEN length_cm ELSE 7 END AS changed_length FROM {{line}})
    SELECT line_id, changed_variety, changed_length FROM n"""
)
def mat_fields_changed(t):
    """MAT-05"""
    base = {"product": C("product_name"), "variety": C("variety"), "length": C("length_cm")}
    other = F.when(C("part_id") % 2 == 0, C("length_cm")).otherwise(7.0)
    return t("line").select(
        "line_id",
        MA.match_fields_changed(base, base | {"variety": F.concat(F.lower("variety"), F.lit(" x"))}).alias("changed_variety"),
        MA.match_fields_changed(base, base | {"variety": F.lower("variety"), "length": other}).alias("changed_length")
    )


@query("""SELECT line_id, CASE WHEN a.article_id IS NULL THEN 'ARTICLE_GONE' WHEN a.farm_id <> l.farm_id THEN 'OTHER_SUPPLIER' END AS code
      FROM (SELECT line_id, farm_id, own_article + CASE part_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 10000000 ELSE 5 END AS wanted FROM {line}) l
      LEFT JOIN {article} a ON a.article_id = l.wanted""")
def mat_select_article(t):
    """MAT-07"""
    k = C("part_id") % 3
    s = t("line").select(
        "line_id", "farm_id",
        (C("own_article") + F.when(k == 0, 0).when(k == 1, 10000000).otherwise(5)).alias("article_id")
    )
    return MA.select_article(s, t("article")).select("line_id", "code")


@query(
    """SELECT line_id, CASE WHEN offer_status = 'REVIEWED' THEN 'Confirmed' WHEN part_id % 4 = 0 THEN 'Auto matched'
      WHEN part_id % 4 = 1 THEN CASE WHEN part_id % 8 = 1 THEN 'Supplier mapping' ELSE 'Manually matched' END ELSE 'Not linked' END AS label
      FROM {line}"""
)
def mat_status_label(t):
    """MAT-10"""
    k = C("part_id") % 4
    return t("line").select(
        "line_id",
        MA.status_label(
            C("offer_status"), F.when(k == 0, "DERIVED").when(k == 1, "USER_LINKED").when(k == 2, "UNMATCHED"),
            C("part_id") % 8 == 1
        ).alias("label")
    )


# --- pricing -------------------------------------------------------------------------------------

RECIPROCAL = """CASE stems_per_box WHEN 20 THEN 0.05 WHEN 25 THEN 0.04 WHEN 40 THEN 0.025 WHEN 50 THEN 0.02 WHEN 100 THEN 0.01
      WHEN 125 THEN 0.008 ELSE 0.005 END::DECIMAL(6,4)"""


def _context(t):
    """The lines of each order with their article, and the buyers each order is quoted to."""
    a = t("article").select(C("article_id").alias("own_article"), "stems_per_box", C("box_weight").alias("weight_kg"), "box_type")
    lines = PR.origins(t("line").join(a, "own_article").withColumn("origin_id", F.lit(None).cast("int")), t("farm"), t("location"))
    manual = F.when(C("part_id") % 40 == 0, C("fob") * 3).cast("decimal(12,6)").alias("manual_price")
    packaging = ["stems_per_box", "weight_kg", "quantity", "box_type"]
    lines = lines.select(
        C("offer_id").alias("request_id"), "line_id", "resolved_origin", "fob", C("currency").alias("source_currency"),
        *packaging, manual
    )
    return lines, t("request").join(t("buyer").drop("customer_name"), "customer_id")


CONTEXT = f"""x AS (
      SELECT line_id, offer_id,
        coalesce(f.origin_id, CASE lower(f.country) WHEN 'ecuador' THEN (SELECT location_id FROM {{location}}
          WHERE lower(city) = 'quito') END) AS origin,
        fob, currency, stems_per_box, box_weight AS w, quantity, {RECIPROCAL} AS r, CAST(CASE
          WHEN part_id % 40 = 0 THEN fob * 3 END AS DECIMAL(12,6)) AS manual
      FROM {{line}} JOIN {{article}} ON own_article = article_id JOIN {{farm}} f ON f.farm_id = {{line}}.farm_id),
    b AS (SELECT request_id, {{buyer}}.* FROM {{request}} JOIN {{buyer}} ON {{request}}.customer_id = {{buyer}}.customer_id),
    rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin_id, destination_id ORDER BY CASE WHEN transport = 'AIR' THEN 0
      ELSE 1 END, created_at, route_id) AS n FROM {{route}}) WHERE n = 1),
    cs AS (SELECT route_id, sum(CASE WHEN unit = 'FLAT' THEN amount ELSE 0 END) AS flat, sum(CASE WHEN unit = 'PER_KG' THEN amount
      ELSE 0 END) AS kg, sum(CASE WHEN unit = 'PER_STEM' THEN amount ELSE 0 END) AS stem, sum(CASE WHEN unit = 'PER_BOX' THEN amount
      ELSE 0 END) AS box,
      bool_or(category IN ('CLEARING', 'INSPECTION')) AS clr, bool_or(category = 'HANDLING') AS hnd, bool_or(unit = 'PER_KG') AS by_kg
        FROM {{cost}} WHERE cost_type_id IS NOT NULL GROUP BY route_id),
    fxr AS (SELECT arg_max(rate, effective_from) AS rate FROM {{fx}} WHERE effective_from <= TIMESTAMP '{AS_OF}' AND (effective_to IS NULL
      OR effective_to >= TIMESTAMP '{AS_OF}')),
    p AS (SELECT x.*, b.customer_id, b.incoterm, b.target_currency, b.margin_pct, rt.route_id, t.rate, t.rate_unit, cs.flat, cs.kg, cs.stem,
      cs.box, coalesce(cs.clr, false) AS clr, coalesce(cs.hnd, false) AS hnd, coalesce(cs.by_kg, false) AS by_kg,
      CASE b.incoterm WHEN 'CFR' THEN coalesce(rt.supports_cfr, true) WHEN 'DDP' THEN coalesce(rt.supports_ddp, true)
        ELSE true END AS supported, (SELECT rate FROM fxr) AS fx
      FROM x JOIN b ON b.request_id = x.offer_id LEFT JOIN rt ON rt.origin_id = x.origin AND rt.destination_id = b.destination_id LEFT
        JOIN {{current_tariff}} t ON t.route_id = rt.route_id LEFT JOIN cs ON cs.route_id = rt.route_id),
    i AS (SELECT *, CASE WHEN NOT supported THEN 'INCOTERM_NOT_SUPPORTED_ON_ROUTE' ELSE array_to_string(list_filter([
        CASE WHEN incoterm <> 'FOB' AND (coalesce(rate_unit, 'PER_KG') = 'PER_KG' OR (incoterm = 'DDP' AND by_kg))
          AND w IS NULL THEN 'MISSING_WEIGHT' END,
        CASE WHEN incoterm <> 'FOB' AND rate IS NULL AND origin IS NOT NULL THEN 'MISSING_FREIGHT_RATE' END,
        CASE WHEN incoterm = 'DDP' AND NOT clr AND origin IS NOT NULL THEN 'MISSING_DDP_CLEARING_INSPECTION' END, CASE WHEN incoterm = 'DDP'
          AND NOT hnd AND origin IS NOT NULL THEN 'MISSING_DDP_HANDLING' END,
        CASE WHEN currency <> target_currency AND fx IS NULL THEN 'MISSING_EXCHANGE_RATE' END, CASE
          WHEN margin_pct IS NULL THEN 'MISSING_MARGIN' END,
        CASE WHEN incoterm <> 'FOB' AND origin IS NULL THEN 'ORIGIN_NOT_CONFIGURED' END], lambda q: q IS NOT NULL), ',') END AS issues
          FROM p)"""


def _priced(t):
    return PR.price_for_requests(*_context(t), t("route"), t("current_tariff"), t("cost"), t("fx"), as_of=AS_OF)


@query(f"WITH {CONTEXT} SELECT line_id, customer_id, route_id, issues FROM i")
def prc_blockers(t):
    """PRC-07, PRC-10, PRC-11, JON-09 to JON-12, JON-14"""
    return _priced(t).select("line_id", "customer_id", "route_id", F.array_join("issues", ",").alias("issues"))


PRICED = f"""f AS (SELECT *, CAST(CASE WHEN incoterm = 'FOB' THEN 0 WHEN rate_unit = 'PER_STEM' THEN rate
      WHEN rate_unit = 'PER_BOX' THEN rate * r ELSE CAST(w AS DECIMAL(8,3)) * rate * r END AS DECIMAL(18,9)) AS freight,
      CAST(CASE WHEN incoterm <> 'DDP' THEN 0 ELSE coalesce(stem, 0) + (coalesce(flat, 0) + coalesce(box,
        0)) * r + coalesce(kg * CAST(w AS DECIMAL(8,3)) * r, 0) END AS DECIMAL(18,9)) AS extra FROM i WHERE issues = ''),
    m AS (SELECT *, CAST(fob + freight + extra AS DECIMAL(18,9)) AS cost FROM f),
    x2 AS (SELECT *, CAST(CASE WHEN currency = target_currency THEN cost WHEN currency = 'EUR' THEN cost * fx ELSE cost * CASE fx
      WHEN 1.25 THEN 0.8 WHEN 1.6 THEN 0.625 WHEN 0.8 THEN 1.25 WHEN 2 THEN 0.5 ELSE 1 END END AS DECIMAL(18,9)) AS target FROM m)"""


@query(
    f"""WITH {CONTEXT}, {PRICED}
    SELECT line_id, customer_id, CAST(round(freight, 6) AS DOUBLE) AS freight, CAST(round(extra, 6) AS DOUBLE) AS additional,
      CAST(round(cost, 6) AS DOUBLE) AS cost_source, CAST(round(target, 6) AS DOUBLE) AS cost_target,
      CAST(round(target * (100 + margin_pct) * 0.01, 2) AS DOUBLE) AS calculated, CAST(round(coalesce(manual,
        target * (100 + margin_pct) * 0.01), 2) AS DOUBLE) AS final_price, manual IS NOT NULL AS is_manual FROM x2"""
)
def prc_sell_price(t):
    """PRC-01 to PRC-06, PRC-08, PRC-09, PRC-14, JON-13, AGG-02"""
    p = _priced(t).where(F.size("issues") == 0)
    return p.select(
        "line_id", "customer_id", dbl(C("freight")).alias("freight"), dbl(C("additional")).alias("additional"),
        dbl(C("cost_source")).alias("cost_source"), dbl(C("cost_target")).alias("cost_target"),
        C("calculated_rounded").cast("double").alias("calculated"),
        C("final_price").cast("double").alias("final_price"), "is_manual"
    )


@query(
    f"""WITH {CONTEXT}, {PRICED} SELECT customer_id, count(*) AS n_lines, CAST(sum(quantity) AS BIGINT) AS total_boxes,
      CAST(sum(quantity * stems_per_box) AS BIGINT) AS total_stems,
    CAST(sum(CAST(round(coalesce(manual, target * (100 + margin_pct) * 0.01),
      2) AS DECIMAL(12,2)) * (quantity * stems_per_box)) AS DOUBLE) AS total_value FROM x2 GROUP BY customer_id"""
)
def quote_value_per_customer(t):
    """The flagship: every order's lines priced for all buyers it is quoted to, blocked lines left out, summed up per buyer."""
    p = _priced(t).where(F.size("issues") == 0).withColumnsRenamed(
        {"quantity": "quantity_boxes", "final_price": "calculated_price", "manual_price": "_manual"}
    )
    p = p.withColumn("manual_price", F.lit(None).cast("decimal(12,6)"))
    sums = Q.totals(p, "customer_id", F.count("*").alias("n_lines"))
    return sums.select("customer_id", "n_lines", "total_boxes", "total_stems", C("total_value").cast("double").alias("total_value"))


@query(
    f"""WITH a AS (SELECT *, {RECIPROCAL} AS r, CAST(article_id % 50 * 0.1 AS DECIMAL(10,4)) AS rate, CASE article_id % 3
      WHEN 0 THEN 'PER_KG' WHEN 1 THEN 'PER_BOX' ELSE 'PER_STEM' END AS u FROM {{article}})
    SELECT article_id, CAST(round(CASE u WHEN 'PER_STEM' THEN CAST(rate AS DECIMAL(18,9)) WHEN 'PER_BOX' THEN rate * r
      ELSE CAST(box_weight AS DECIMAL(8,3)) * rate * r END, 6) AS DOUBLE) AS freight, CAST(round(2.5 * r, 6) AS DOUBLE) AS handling FROM a"""
)
def prc_freight_per_stem(t):
    """PRC-01, PRC-02"""
    unit = F.when(C("article_id") % 3 == 0, "PER_KG").when(C("article_id") % 3 == 1, "PER_BOX").otherwise("PER_STEM")
    rate = (C("article_id") % 50 * F.lit(0.1).cast("decimal(2,1)")).cast("decimal(10,4)")
    return t("article").select(
        "article_id", dbl(PR.freight_per_stem(rate, unit, C("stems_per_box"), C("box_weight"))).alias("freight"),
        dbl(PR.handling_per_stem(F.lit(2.5).cast("decimal(4,2)"), C("stems_per_box"))).alias("handling")
    )


@query(
    """SELECT o_orderkey, (SELECT CAST(arg_max(rate, effective_from) AS DOUBLE) FROM {fx} f
      WHERE f.effective_from <= o_orderdate AND (f.effective_to IS NULL OR f.effective_to >= o_orderdate)) AS fx_rate FROM {orders}"""
)
def prc_fx_asof(t):
    """JON-13, FLT-02: the rate valid at each order's own time"""
    o = t("orders").select("o_orderkey", C("o_orderdate").alias("at"), F.lit("USD").alias("currency"))
    return PR.rates_at_each(o, t("fx")).select("o_orderkey", C("fx_rate").cast("double").alias("fx_rate"))


@query("""SELECT route_id, category, count(DISTINCT coalesce(name, category)) AS n_names FROM {cost}
      GROUP BY route_id, category HAVING count(DISTINCT coalesce(name, category)) > 1""")
def agg_dup_cost_category(t):
    """AGG-05, PRC-12"""
    return PR.duplicate_categories(t("cost").withColumn("name", F.coalesce("name", "category")), "route_id")


@query("""SELECT quote_id, CAST(sum(quantity_boxes) AS BIGINT) AS total_boxes,
      CAST(sum(stems_per_box * quantity_boxes) AS BIGINT) AS total_stems, CAST(sum(coalesce(manual_price,
      calculated_price) * (stems_per_box * quantity_boxes)) AS DOUBLE) AS total_value FROM {quote_line} GROUP BY quote_id""")
def agg_quote_totals(t):
    """AGG-01, RPT-02"""
    return Q.totals(t("quote_line")).withColumn("total_value", C("total_value").cast("double"))


@query(
    f"""SELECT line_id, array_to_string(list_filter([
        CASE WHEN length(raw_text) % 7 = 0 THEN 'LOW_CONFIDENCE' END,
        CASE WHEN part_id % 5 = 1 THEN 'NOT_LINKED' END,
        CASE WHEN quantity > 14 THEN 'STALE_RATE' END,
        CASE WHEN box_weight < 0.5 OR box_weight > 30 THEN 'UNUSUAL_WEIGHT' END,
        CASE WHEN part_id % 40 = 0 THEN 'MANUAL_PRICE' END,
        CASE WHEN price < 0.05 OR price > 20 THEN 'UNUSUAL_SELL_PRICE' END], lambda q: q IS NOT NULL), ',') AS warnings
      FROM (SELECT l.*, a.box_weight * (part_id % 5) AS box_weight, fob * CASE WHEN part_id % 40 = 0 THEN 30 ELSE 1 END AS price
            FROM {{line}} l JOIN {{article}} a ON own_article = article_id)"""
)
def prc_line_warnings(t):
    """PRC-13: judged on each line's text, link, age of its rate (its quantity in days), weight and price"""
    a = t("article").select(C("article_id").alias("own_article"), "box_weight")
    manual = C("part_id") % 40 == 0
    c = {
        "confidence": F.when(F.length("raw_text") % 7 == 0, "LOW").otherwise("HIGH"),
        "linked": C("part_id") % 5 != 1,
        "rate_updated": F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(days=C("quantity")),
        "weight": C("box_weight") * (C("part_id") % 5),
        "is_manual": manual,
        "final_price": C("fob") * F.when(manual, 30).otherwise(1),
    }
    return t("line").join(a, "own_article").select("line_id", F.array_join(PR.line_warnings(c, F.lit(AS_OF)), ",").alias("warnings"))


# --- quantities, gating, validation --------------------------------------------------------------

QUANTITY = """CASE WHEN unit = 'BOXES' THEN 'OK' WHEN unit = 'STEMS' THEN CASE WHEN quantity % stems_per_box <> 0 THEN 'STEMS_NOT_DIVISIBLE'
      ELSE 'OK' END WHEN unit = 'BUNCHES' THEN 'BUNCHES_NOT_SUPPORTED' WHEN unit = 'KILOGRAMS' THEN 'KILOGRAMS_NOT_SUPPORTED'
      WHEN boxes > 0 THEN 'OK' WHEN boxes = 0 THEN 'MISSING_QUANTITY' ELSE 'MISSING_QUANTITY' END"""
GATED = f"""g AS (SELECT line_id, offer_id, offer_status, unit, quantity, own_article, l.farm_id, fob, currency, stems_per_box, CASE
      WHEN part_id % 12 = 0 THEN NULL WHEN part_id % 18 = 0 THEN 0 ELSE quantity END AS boxes,
      CASE WHEN part_id % 11 = 0 THEN 'AMBIGUOUS' ELSE 'AUTO_MATCHED' END AS match_status FROM {{line}} l
        JOIN {{article}} a ON own_article = article_id)"""


def _gated(t):
    a = t("article").select(C("article_id").alias("own_article"), C("farm_id").alias("article_farm"), "stems_per_box")
    boxes = F.when(C("part_id") % 12 == 0, None).when(C("part_id") % 18 == 0, 0).otherwise(C("quantity"))
    return t("line").join(a, "own_article").withColumns(
        {
            "boxes": boxes, "match_status": F.when(C("part_id") % 11 == 0, "AMBIGUOUS").otherwise("AUTO_MATCHED"),
            "resolved": Q.resolve_quantity(C("quantity"), C("unit"), boxes, C("stems_per_box"))
        }
    )


@query(f"""WITH {GATED} SELECT line_id, nullif({QUANTITY}, 'OK') AS code, CAST(CASE WHEN {QUANTITY} = 'OK' THEN CASE
      WHEN unit = 'STEMS' THEN quantity // stems_per_box WHEN unit = 'BOXES' THEN quantity ELSE boxes END END AS BIGINT) AS boxes FROM g""")
def val_quantity_resolution(t):
    """VAL-06"""
    return _gated(t).select("line_id", C("resolved.code").alias("code"), C("resolved.boxes").alias("boxes"))


@query(f"""WITH {GATED}, h AS (SELECT *, CASE WHEN offer_status <> 'REVIEWED' THEN 'OFFER_NOT_REVIEWED'
      WHEN match_status = 'AMBIGUOUS' THEN 'LINE_NOT_MATCHED' ELSE nullif({QUANTITY}, 'OK') END AS code FROM g)
      SELECT line_id, code, bool_and(code IS NULL) OVER (PARTITION BY offer_id) AS accepted FROM h""")
def val_gating(t):
    """VAL-07, FLT-04"""
    c = {
        "exists": F.lit(True), "offer_status": C("offer_status"), "match_status": C("match_status"),
        "article": C("own_article"), "line_farm": C("farm_id"), "article_farm": C("article_farm"), "price": C("fob"),
        "currency": C("currency"), "packaging_ok": C("stems_per_box") > 0, "quantity": C("resolved")
    }
    return Q.all_or_nothing(_gated(t).withColumn("code", Q.gating_code(c)), "offer_id").select("line_id", "code", "accepted")


FINAL = """fin AS (SELECT line_id, offer_id, CASE WHEN part_id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN product_name IS NULL THEN 1
      ELSE 0 END + CASE WHEN variety IS NULL THEN 1 ELSE 0 END + CASE WHEN unit IS NULL AND part_id % 12 = 0 THEN 1 ELSE 0 END AS n_errors,
      CASE WHEN length_cm IS NULL THEN 1 ELSE 0 END + CASE WHEN unit = 'KILOGRAMS' OR unit IS NULL THEN 1 ELSE 0 END AS n_warnings, CASE
        WHEN part_id % 11 = 0 THEN 'UNMATCHED' ELSE 'AUTO_MATCHED' END AS match_status FROM {line})"""


def _finalized(t):
    boxes = F.when(C("part_id") % 12 == 0, None).otherwise(C("quantity"))
    c = {
        "article": F.when(C("part_id") % 4 != 0, C("own_article")), "product_group": C("product_name"),
        "variety": C("variety"), "price": C("fob"), "currency": C("currency"), "unit": C("unit"),
        "length_cm": C("length_cm"), "quantity": C("quantity"),
        "total_stems": N.total_stems(C("quantity"), C("unit"), F.lit(40), F.lit(10)), "boxes": boxes
    }
    errors, warnings = E.finalization(c)
    return t("line").select(
        "line_id", "offer_id", errors.alias("errors"), warnings.alias("warnings"),
        F.when(C("part_id") % 11 == 0, "UNMATCHED").otherwise("AUTO_MATCHED").alias("match_status")
    )


@query(f"WITH {FINAL} SELECT line_id, CAST(n_errors AS INT) AS n_errors, CAST(n_warnings AS INT) AS n_warnings FROM fin")
def val_finalization(t):
    """VAL-01"""
    return _finalized(t).select("line_id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


@query(
    f"""WITH {FINAL} SELECT offer_id, count(*) AS total, count(*) FILTER (n_errors > 0) AS blocking,
      count(*) FILTER (n_warnings > 0) AS warned, count(*) FILTER (match_status = 'UNMATCHED') AS unmatched,
    count(*) FILTER (n_errors > 0 OR n_warnings > 0 OR match_status = 'UNMATCHED') AS needs_attention, count(*) FILTER (NOT (n_errors > 0
      OR n_warnings > 0 OR match_status = 'UNMATCHED')) AS ready, count(*) FILTER (n_errors > 0) = 0 AS confirmable FROM fin
      GROUP BY offer_id"""
)
def agg_review_counts(t):
    """AGG-03, FLT-05, VAL-03"""
    f = _finalized(t)
    return E.review_counts(f).join(E.confirmable(f).select("offer_id", "confirmable"), "offer_id")


@query(
    """SELECT line_id, CAST(CASE WHEN part_id % 3 = 0 THEN 1 ELSE quantity END AS DOUBLE) AS quantity, CASE WHEN hit THEN box_type
      ELSE 'QB' END AS box_type, CASE WHEN hit THEN stems_per_box END AS stems_per_box, CASE WHEN hit THEN a_variety
      ELSE variety END AS variety,
    CASE WHEN hit AND a_len IS NOT NULL THEN a_len ELSE length_cm END AS length_cm, CAST(CASE WHEN hit THEN CASE WHEN part_id % 3 = 0 THEN 1
      ELSE quantity END * stems_per_box END AS BIGINT) AS total_stems, CASE WHEN hit THEN 1 ELSE 2 END AS n_warnings
    FROM (SELECT l.*, a.article_id IS NOT NULL AS hit, a.box_type, a.stems_per_box, a.variety AS a_variety,
      CAST(regexp_extract(a.stem_length, '(\\d+)', 1) AS DOUBLE) AS a_len FROM {line} l LEFT JOIN {article} a ON a.article_id = CASE
      WHEN l.part_id % 4 <> 0 THEN l.own_article END)"""
)
def enr_canonical(t):
    """ENR-01 to ENR-03, JON-06"""
    lines = t("line").select(
        "line_id",
        F.when(C("part_id") % 4 != 0, C("own_article")).alias("article_id"),
        F.when(C("part_id") % 3 != 0, C("quantity")).alias("quantity"),
        F.lit(None).cast("int").alias("boxes"),
        F.lit(" hb ").alias("box_type"),
        F.lit(None).cast("int").alias("stems_per_box"),
        F.lit(None).cast("decimal(10,3)").alias("weight"), C("product_name").alias("product_group"), "variety", "length_cm", C("fob").cast("string").alias("price"), "currency", F.lit("USD").alias("supplier_currency"), F.array(
            F.lit("stems per box unknown"),
            F.lit("please check")
        ).alias("warnings"),
    )
    return E.enriched(lines, t("article")).select(
        "line_id", "quantity", "box_type", "stems_per_box", "variety", "length_cm", "total_stems",
        F.size("warnings").alias("n_warnings")
    )


# --- relational ----------------------------------------------------------------------------------


@query("""SELECT article_id, variety, stem_length FROM {article} WHERE box_type = 'QB' AND contains(lower(variety), 'e')
      AND (contains(lower(product_name), 'br') OR contains(lower(variety), 'br') OR contains(lower(color), 'br')
      OR contains(lower(stem_length), 'br') OR contains(lower(box_type), 'br'))""")
def flt_assortment_search(t):
    """FLT-01"""
    return R.search_assortment(t("article"), box_type="QB", variety="E", q=" Br ").select("article_id", "variety", "stem_length")


@query("SELECT c_custkey, c_name FROM {customer} ORDER BY c_name, c_custkey LIMIT 25 OFFSET 50")
def srt_page(t):
    """SRT-01, SRT-02: the third page of 25"""
    return R.page(t("customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 3, 25)


@query(f"""SELECT route_id, tariff_id FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY CASE
      WHEN effective_from <= TIMESTAMP '{AS_OF}' AND (effective_to IS NULL OR effective_to >= TIMESTAMP '{AS_OF}') THEN 0
      ELSE 1 END, effective_from DESC, updated_at DESC, tariff_id DESC) AS n FROM {{tariff}}) WHERE n = 1""")
def win_current_tariff(t):
    """WIN-01"""
    return R.current_tariffs(t("tariff"), AS_OF).select("route_id", "tariff_id")


@query("""SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
      ORDER BY o_orderdate DESC, o_orderkey) AS n FROM {orders}) WHERE n = 1""")
def win_latest_per_type(t):
    """WIN-03"""
    return R.first_per(
        t("orders"),
        ["o_custkey", "o_orderpriority"],
        [F.desc("o_orderdate"), "o_orderkey"]
    ).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""SELECT origin_id, destination_id, route_id FROM (SELECT *, row_number() OVER (PARTITION BY origin_id, destination_id ORDER BY CASE
      WHEN transport = 'AIR' THEN 0 ELSE 1 END, created_at, route_id) AS n FROM {route}) WHERE n = 1""")
def jon_route_air_first(t):
    """JON-10"""
    return PR.best_routes(t("route")).select("origin_id", "destination_id", "route_id")


@query("SELECT route_id FROM {route} r WHERE NOT EXISTS (SELECT 1 FROM {tariff} x WHERE x.route_id = r.route_id)")
def jon_unrated_routes(t):
    """FLT-13, JON-21, JON-24"""
    return R.without(t("route"), t("tariff"), "route_id").select("route_id")


@query("""SELECT farm_id, coalesce(origin_id, CASE lower(country) WHEN 'ecuador' THEN (SELECT min(location_id) FROM {location}
      WHERE lower(city) = 'quito' AND lower(country) = 'ecuador') END) AS resolved_origin FROM {farm}""")
def jon_origin_fallback(t):
    """JON-09"""
    return PR.origins(
        t("farm").select("farm_id", F.lit(None).cast("int").alias("origin_id")),
        t("farm"),
        t("location")
    ).select("farm_id", "resolved_origin")


@query("""SELECT farm_id, farm_name, coalesce(n, 0) AS n_articles FROM {farm} LEFT JOIN (SELECT farm_id, count(*) AS n FROM {article}
      GROUP BY farm_id) USING (farm_id)""")
def agg_relation_counts(t):
    """AGG-07, AGG-11"""
    return R.with_counts(t("farm").select("farm_id", "farm_name"), t("article"), "farm_id", "n_articles")


@query("SELECT DISTINCT stem_length FROM {article} WHERE stem_length IS NOT NULL")
def agg_option_lists(t):
    """AGG-08"""
    return R.option_list(t("article"), "stem_length")


@query(
    """WITH k AS (SELECT customer_id, lower(trim(replace(customer_name, 'Customer#', ''))) AS key0, customer_id % 50 AS s
      FROM {buyer}), n AS (SELECT customer_id, CASE WHEN s % 10 = 0 THEN '' ELSE CAST(s AS VARCHAR) END AS name FROM k)
    SELECT customer_id, CASE WHEN name = '' THEN 'INVALID' WHEN CAST(name AS INT) < 20 THEN 'DUPLICATE'
      WHEN row_number() OVER (PARTITION BY name ORDER BY customer_id) > 1 THEN 'DUPLICATE' ELSE 'CREATED' END AS outcome FROM n"""
)
def set_dedupe_import(t):
    """SET-06"""
    s = C("customer_id") % 50
    incoming = t("buyer").select("customer_id", F.when(s % 10 == 0, " ").otherwise(F.concat(F.lit(" "), s.cast("string"))).alias("name"))
    existing = t("location").where("location_id < 20").select(C("location_id").cast("string").alias("name"))
    return R.import_new(incoming, existing, F.lower(F.trim("name")), ["customer_id"]).select("customer_id", "outcome")


@query("""SELECT offer_id, source FROM (SELECT DISTINCT offer_id, 'exact' AS source FROM {line} WHERE part_id % 5 = 1)
      UNION ALL (SELECT DISTINCT offer_id, 'model' FROM {line} WHERE offer_id NOT IN (SELECT offer_id FROM {line} WHERE part_id % 5 = 1))""")
def set_fallback_source(t):
    """SET-01, SET-02"""
    line = t("line")
    return R.deterministic_or_fallback(
        line.where("part_id % 5 = 1").select("offer_id", F.lit("exact").alias("source")).distinct(),
        line.select("offer_id", F.lit("model").alias("source")).distinct(), "offer_id"
    )


# --- maintenance ---------------------------------------------------------------------------------

RATES = """r AS (SELECT CASE WHEN location_id % 2 = 0 THEN 'EUR' ELSE 'C' || CAST(location_id AS VARCHAR) END AS base, CASE
      WHEN location_id % 2 = 0 THEN 'C' || CAST(location_id + location_id % 4 // 2 AS VARCHAR)
      ELSE 'EUR' END AS quote, CAST(CASE location_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1.25 WHEN 2 THEN 1.6 WHEN 3 THEN 0.5
      ELSE 0.8 END AS DECIMAL(12,6)) AS rate FROM {location})"""


@query(
    f"""WITH {RATES} SELECT CASE WHEN base <> 'EUR' AND rate <> 0 THEN 'EUR' ELSE base END AS base, CASE WHEN base <> 'EUR'
      AND rate <> 0 THEN base ELSE quote END AS quote,
    CAST(CASE WHEN base <> 'EUR' AND rate <> 0 THEN CASE rate WHEN 1.25 THEN 0.8 WHEN 1.6 THEN 0.625 WHEN 0.5 THEN 2 ELSE 1.25 END
      ELSE rate END AS DOUBLE) AS rate FROM r WHERE base = 'EUR' OR base NOT IN (SELECT quote FROM r WHERE base = 'EUR')"""
)
def dml_fx_canonical(t):
    """DML-12, JON-22"""
    i = C("location_id")
    name = lambda x: F.concat(F.lit("C"), x.cast("string"))
    r = t("location").select(
        F.when(i % 2 == 0, "EUR").otherwise(name(i)).alias("base"),
        F.when(i % 2 == 0, name(i + F.floor(i % 4 / 2))).otherwise("EUR").alias("quote"),
        F.when(i % 5 == 0, 0).when(i % 5 == 1, 1.25).when(i % 5 == 2, 1.6).when(i % 5 == 3, 0.5).otherwise(0.8).cast("decimal(12,6)").alias("rate")
    )
    return M.canonical_rates(r).withColumn("rate", C("rate").cast("double"))


@query(
    """WITH w AS (SELECT line_id, part_id, own_article, part_id % 3 = 0 AS other FROM {line}), k AS (SELECT line_id, CASE
      WHEN other THEN 'N' || CAST(own_article AS VARCHAR) ELSE 'E' END AS kind FROM w)
    SELECT line_id, CASE WHEN kind = 'E' THEN 'FOUND' WHEN row_number() OVER (PARTITION BY kind ORDER BY line_id) = 1 THEN 'CREATE'
      ELSE 'FOUND' END AS outcome FROM k"""
)
def dml_find_or_create(t):
    """DML-01"""
    w = t("line").select("line_id", "own_article", "part_id").join(
        t("article").withColumnRenamed("article_id", "own_article"),
        "own_article"
    )
    box = F.when(C("part_id") % 3 == 0, F.concat(F.lit("N"), C("own_article"))).otherwise(F.lower("box_type"))
    wanted = w.select(
        C("line_id").alias("want_id"), "farm_id", F.upper("product_name").alias("product_name"), "variety",
        "stem_length", box.alias("box_type"), "stems_per_box"
    )
    return M.find_or_create_articles(wanted, t("article")).select(C("want_id").alias("line_id"), "outcome")


@query(
    """SELECT route_id, 'CLEARING_INSPECTION' AS category, CAST(sum(amount) AS DOUBLE) AS amount FROM {cost}
      WHERE category IN ('CLEARING', 'INSPECTION') GROUP BY route_id
    UNION ALL SELECT route_id, category, CAST(amount AS DOUBLE) FROM {cost} WHERE category NOT IN ('CLEARING', 'INSPECTION')"""
)
def dml_consolidate_clearing(t):
    """JON-20, JON-21, DML-14"""
    return M.consolidate_clearing(t("cost").select("route_id", "category", "amount")).withColumn("amount", C("amount").cast("double"))


@query("""SELECT lower(trim(name)) AS normalized_name, min(trim(name)) AS name, count(*) AS n_costs FROM {cost} WHERE trim(name) <> ''
      GROUP BY lower(trim(name))""")
def agg_cost_vocabulary(t):
    """AGG-15, STR-22"""
    return M.cost_vocabulary(t("cost"))


@query("SELECT farm_id, part_id, count(*) AS n FROM {line} GROUP BY farm_id, part_id HAVING count(*) > 1")
def agg_conflicts(t):
    """AGG-14"""
    return M.conflicts(t("line"), ["farm_id", "part_id"])


@query("""SELECT line_id, CASE WHEN part_id % 6 = 0 THEN NULL ELSE own_article END AS article_id, CASE WHEN part_id % 6 = 0 THEN 'UNMATCHED'
      ELSE 'AUTO_MATCHED' END AS match_status FROM {line}""")
def dml_delete_articles(t):
    """DML-06, DML-07 use the same joins"""
    lines = t("line").select("line_id", C("own_article").alias("article_id"), F.lit("AUTO_MATCHED").alias("match_status"))
    return M.delete_articles(lines, t("article").where("variant_id % 6 = 0").select("article_id"))


@query(
    """SELECT farm_id, (SELECT count(*) FROM {article} a WHERE a.farm_id = f.farm_id) AS n_articles, (SELECT count(*) FROM {line} l
      WHERE l.farm_id = f.farm_id AND l.part_id % 100 = 0) AS n_lines,
    (SELECT count(*) FROM {article} a WHERE a.farm_id = f.farm_id) + (SELECT count(*) FROM {line} l WHERE l.farm_id = f.farm_id
      AND l.part_id % 100 = 0) = 0 AS deletable FROM {farm} f"""
)
def dml_deletable(t):
    """DML-06, SET-04"""
    return M.deletable(t("farm").select("farm_id"), "farm_id", articles=t("article"), lines=t("line").where("part_id % 100 = 0"))


DESTINATIONS = """d AS (SELECT customer_id, destination_id + v AS destination_id, v = customer_id % 3 AS is_default,
      TIMESTAMP '2024-01-01' + INTERVAL (10 - v) DAY AS created_at FROM {buyer}, (SELECT unnest(range(0, 3)) AS v))"""


@query(f"""WITH {DESTINATIONS}, k AS (SELECT d.* FROM d JOIN {{buyer}} b USING (customer_id) WHERE NOT (customer_id % 2 = 0
      AND d.destination_id = b.destination_id + customer_id % 3)) SELECT customer_id, destination_id, is_default
      OR (NOT bool_or(is_default) OVER (PARTITION BY customer_id) AND row_number() OVER (PARTITION BY customer_id
      ORDER BY created_at) = 1) AS is_default FROM k""")
def dml_default_destination(t):
    """DML-05, WIN-05"""
    d = t("buyer").select("customer_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("v"), "destination_id").select(
        "customer_id", (C("destination_id") + C("v")).alias("destination_id"),
        (C("v") == C("customer_id") % 3).alias("is_default"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(10) - C("v"))).alias("created_at")
    )
    gone = t("buyer").where("customer_id % 2 = 0").select(
        "customer_id",
        (C("destination_id") + (C("customer_id") % 3).cast("int")).alias("destination_id")
    )
    return M.remove_destinations(d, gone).select("customer_id", "destination_id", "is_default")


@query("""SELECT line_id, CASE WHEN part_id % 9 = 0 THEN 'BAD_PRICE' WHEN part_id % 9 = 1 THEN 'BAD_QUANTITY'
      WHEN row_number() OVER (PARTITION BY farm_id, own_article ORDER BY line_id) > 1 THEN 'DUPLICATE' ELSE 'OK' END AS outcome FROM {line}""")
def dml_manual_lines(t):
    """DML-08"""
    k = C("part_id") % 9
    lines = t("line").select(
        "line_id", "farm_id", C("own_article").alias("article_id"),
        F.when(k == 1, 1.5).otherwise(C("quantity")).alias("quantity"),
        F.when(k == 0, 0).otherwise(C("fob")).alias("price")
    )
    return M.validated_manual_lines(lines, t("article")).select("line_id", "outcome")


# --- reports -------------------------------------------------------------------------------------


@query("""SELECT quote_id, product_group AS product, variety, stem_length, stems_per_box, quantity_boxes,
      CAST(stems_per_box * quantity_boxes AS BIGINT) AS total_stems, CAST(round(coalesce(manual_price, calculated_price),
      2) AS DOUBLE) AS price FROM {quote_line}""")
def rpt_customer_sheet(t):
    """RPT-03, SNK-03"""
    return RP.customer_sheet(t("quote_line")).select(
        "quote_id", "product", "variety", "stem_length", "stems_per_box", "quantity_boxes", "total_stems",
        C("price").cast("double").alias("price")
    )


@query(
    f"""WITH {CONTEXT} SELECT line_id AS quote_line, customer_id AS quote_id, CAST(fob AS DOUBLE) AS fob, CAST(CASE
      WHEN currency = target_currency THEN NULL ELSE fx END AS DOUBLE) AS fx_rate, CAST(margin_pct AS DOUBLE) AS margin_pct FROM i
      WHERE issues = ''"""
)
def rpt_internal_sheet(t):
    """RPT-04, SNK-04, PRC-14's snapshot"""
    p = _priced(t).withColumn("quote_id", C("customer_id")).withColumn("quantity_boxes", C("quantity"))
    s = Q.snapshots(p).withColumns(
        {
            "additional": C("clearing_inspection") + C("handling") + C("other_costs"),
            "quote_fx_rate": F.lit(None).cast("decimal(12,6)"), "source_currency": F.lit("USD")
        }
    )
    return RP.internal_sheet(s).select(
        C("line_id").alias("quote_line"), "quote_id", C("fob").cast("double").alias("fob"),
        C("fx_rate").cast("double").alias("fx_rate"), C("margin_pct").cast("double").alias("margin_pct")
    )


@query(
    """SELECT (SELECT count(*) FROM {orders} WHERE o_orderstatus = 'O') AS concept_quotes, (SELECT count(*) FROM {line}
      WHERE part_id % 5 = 0) AS unlinked_lines, (SELECT count(*) FROM {article} WHERE box_weight IS NULL) AS missing_weight,
    (SELECT count(*) FROM {route} r WHERE NOT EXISTS (SELECT 1 FROM {tariff} x WHERE x.route_id = r.route_id)) AS unrated_routes"""
)
def rpt_dashboard(t):
    """RPT-01, AGG-13"""
    quotes = t("orders").select(F.when(C("o_orderstatus") == "O", "CONCEPT").alias("status"))
    return R.dashboard(
        quotes, t("line").select(F.when(C("part_id") % 5 != 0, C("part_id")).alias("variant_id")), t("article"),
        t("route"), t("tariff")
    )


@query(
    """WITH p AS (SELECT quote_id, product_group AS g, line_id, '• ' || variety || CASE WHEN stem_length IS NULL THEN ''
      ELSE ' ' || stem_length END || ' - ' || CAST(stems_per_box AS VARCHAR) || ' stems/' || box_type || ' - $' || CAST(CAST(round(coalesce(manual_price,
      calculated_price), 2) AS DECIMAL(12,2)) AS VARCHAR) || ' per stem' AS l FROM {quote_line}),
    g AS (SELECT quote_id, g, min(line_id) AS f, '*' || g || '*' || chr(10) || string_agg(l, chr(10) ORDER BY line_id, l) AS b FROM p
      GROUP BY quote_id, g)
    SELECT quote_id, md5('*Fresh Offer - Q-' || CAST(quote_id AS VARCHAR) || '*' || chr(10) || 'Origin: -' || chr(10) || 'Delivery: C&F Amsterdam' || chr(10) || 'Currency: USD' || chr(10) || chr(10) || string_agg(b,
      chr(10) || chr(10)
        ORDER BY f) || chr(10) || chr(10) || 'Availability subject to confirmation.' || chr(10) || 'Prices valid until further notice.') AS text_md5
      FROM g GROUP BY quote_id"""
)
def snk_text_offer(t):
    """SNK-05, AGG-09, STR-24"""
    q = t("quote_line").withColumns(
        {
            "position": C("line_id"), "v_color": F.lit(None).cast("string"), "v_variety": C("variety"),
            "v_grade": F.lit(""), "v_stem_length": C("stem_length"), "v_product": C("product_group"),
            "treatment": F.lit("normal"), "quote_number": F.concat(F.lit("Q-"), C("quote_id").cast("string")),
            "currency": F.lit("USD"), "incoterm": F.lit("CFR"), "origin_country": F.lit(None).cast("string"),
            "destination_city": F.lit("Amsterdam"), "valid_until": F.lit(None).cast("date"), "contact": F.lit("A")
        }
    )
    return RP.offer_text(q).select("quote_id", F.md5("text").alias("text_md5"))


@query("""SELECT o_orderkey, 'Q-' || strftime(o_orderdate,
      '%Y%m%d') || '-' || lpad(CAST(row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE)
      ORDER BY o_orderdate, o_orderkey) AS VARCHAR), 4, '0') AS quote_number FROM {orders}""")
def str_quote_number(t):
    """STR-27"""
    q = t("orders").select(C("o_orderkey").alias("quote_id"), C("o_orderdate").alias("created_at"))
    return Q.numbered(q, q.limit(0)).select(C("quote_id").alias("o_orderkey"), "quote_number")
