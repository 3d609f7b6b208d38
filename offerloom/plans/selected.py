"""Queries of costs and packaging that hold now, selections, messages, pasted texts and similar names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import names as NM
from ..operators import quotes as Q
from ..operators import relational as R
from ..operators import tables as TB
from ..operators import textindex as TX
from ..sources import files as FI
from ..sources import mails as ML
from ..sources import sinks as SK
from ..sources import versioned as V
from .queries import AS_OF, C, query, sql_key
from .surface import _grid

@query(
    f"""WITH c AS (SELECT * FROM {{cost}} WHERE route_id < 10000), again AS (
        SELECT route_id, cost_id, cost_type_id, amount, make_timestamp(2024, CAST(1 + cost_id % 12 AS BIGINT), 1, 0, 0, 0.0) AS f,
          CAST(NULL AS TIMESTAMP) AS t FROM c
        UNION ALL SELECT route_id, cost_id + 100000000, cost_type_id, amount * 2, make_timestamp(2024, CAST(1 + route_id % 9 AS BIGINT), 15,
          0, 0, 0.0), CASE WHEN cost_id % 2 = 0 THEN make_timestamp(2024, 12, 31, 0, 0, 0.0) END FROM c),
      r AS (SELECT *, row_number() OVER (PARTITION BY route_id, coalesce(CAST(cost_type_id AS VARCHAR), 'id:' || cost_id)
        ORDER BY CASE WHEN f <= TIMESTAMP '{AS_OF}' AND (t IS NULL OR t >= TIMESTAMP '{AS_OF}') THEN 0
          ELSE 1 END, f DESC, cost_id DESC) AS n FROM again)
    SELECT route_id, cost_id, CAST(amount AS DOUBLE) AS amount FROM r WHERE n = 1"""
)
def win_current_costs(t):
    """WIN-02: a route's cost of each type that holds now, else the newest; costs without a type stand for themselves"""
    day = lambda month, n: F.make_timestamp(
        F.lit(2024),
        month.cast("int"),
        F.lit(n),
        F.lit(0),
        F.lit(0),
        F.lit(0).cast("decimal(16,6)")
    )
    c = t("cost").where("route_id < 10000")
    same = ["route_id", "cost_type_id"]
    none = F.lit(None).cast("timestamp")
    old = c.select(*same, "cost_id", "amount", day(1 + C("cost_id") % 12, 1).alias("effective_from"), none.alias("effective_to"))
    until = F.when(C("cost_id") % 2 == 0, day(F.lit(12), 31))
    new = c.select(
        *same, (C("cost_id") + 100000000).alias("cost_id"), (C("amount") * 2).cast("decimal(10,4)").alias("amount"),
        day(1 + C("route_id") % 9, 15).alias("effective_from"), until.alias("effective_to")
    )
    both = old.unionByName(new).withColumn("updated_at", C("effective_from"))
    return R.current_costs(both, AS_OF).select("route_id", "cost_id", C("amount").cast("double").alias("amount"))


@query(
    """SELECT l.line_id, CASE WHEN a.article_id IS NOT NULL THEN a.box_type ELSE CASE
      WHEN l.quantity % 3 = 0 THEN l.unit END END AS box_type,
      CAST(CASE WHEN a.article_id IS NOT NULL THEN a.stems_per_box ELSE l.quantity END AS INT) AS stems_per_box, CAST(CASE
        WHEN a.article_id IS NOT NULL THEN a.box_weight ELSE l.quantity * 0.5 END AS DOUBLE) AS weight_kg,
      CASE WHEN a.article_id IS NOT NULL THEN 'PROFILE' ELSE 'LEGACY' END AS packaging_source
    FROM {line} l LEFT JOIN {article} a ON a.article_id = l.own_article AND l.part_id % 4 <> 0"""
)
def val_packaging(t):
    """VAL-05: the packaging of a line's article, or the line's own if it has none, never a mix"""
    a = t("article").select(
        "article_id", C("box_type").alias("a_box"), C("stems_per_box").alias("a_stems"),
        C("box_weight").alias("a_weight")
    )
    j = t("line").join(a, (C("own_article") == C("article_id")) & (C("part_id") % 4 != 0), "left")
    profile = {"box_type": C("a_box"), "stems_per_box": C("a_stems").cast("int"), "weight_kg": C("a_weight").cast("double")}
    own = {
        "box_type": F.when(C("quantity") % 3 == 0, C("unit")), "stems_per_box": C("quantity").cast("int"),
        "weight_kg": C("quantity") * 0.5
    }
    out = Q.canonical_packaging(profile, own, C("article_id").isNotNull())
    return j.select("line_id", *(c.alias(n) for n, c in out.items()))


@query(
    """WITH g AS (SELECT offer_id, list(line_id ORDER BY line_id) AS v, list(line_id
      ORDER BY line_id) FILTER (part_id % 3 = 0) AS s, min(line_id) AS one, sum(quantity) % 2 = 0 AS yes FROM {line} GROUP BY offer_id),
      k AS (SELECT *, list_append(coalesce(s, []), 'elsewhere') AS held FROM g)
    SELECT offer_id, array_to_string(list_sort(CASE WHEN yes THEN list_distinct(list_concat(held, v))
      ELSE ['elsewhere'] END), ',') AS all_toggled,
      array_to_string(list_sort(CASE WHEN yes THEN list_distinct(list_append(held, one))
        ELSE list_filter(held, lambda x: x <> one) END), ',') AS one_toggled FROM k"""
)
def arr_toggles(t):
    """ARR-06: all visible rows or one of them switched on or off; what is selected elsewhere stays"""
    picked = F.collect_list(F.when(C("part_id") % 3 == 0, C("line_id")))
    g = t("line").groupBy("offer_id").agg(
        F.collect_list("line_id").alias("v"), F.concat(picked, F.array(F.lit("elsewhere"))).alias("held"),
        F.min("line_id").alias("one"), (F.sum("quantity") % 2 == 0).alias("yes")
    )
    shown = lambda c: F.array_join(F.array_sort(c), ",")
    return g.select(
        "offer_id", shown(A.toggle_all(C("held"), C("v"), C("yes"))).alias("all_toggled"),
        shown(A.toggle_one(C("held"), C("one"), C("yes"))).alias("one_toggled")
    )


@query(
    """WITH a AS (SELECT CAST(farm_id AS VARCHAR) AS path, variety, row_number() OVER (PARTITION BY farm_id ORDER BY article_id) AS pos
      FROM {article} WHERE variant_id % 6 <> 0),
      n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS n FROM a)
    SELECT path, md5(string_agg('#' || n || ' | ' || variety, chr(10) ORDER BY n)) AS text_md5, CAST(count(*) AS BIGINT) AS lines FROM n
      GROUP BY path"""
)
def tab_description_list(t):
    """PAR-17: the described rows of each sheet as one tagged list"""
    g = _grid(t)
    listed = TB.description_list(TB.known_rows(g, TB.regions(g)))
    return listed.select("path", F.md5("text").alias("text_md5"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query(
    """SELECT o_orderkey, CAST(CAST(floor(s / 4) AS BIGINT) % 5 AS INT) AS message, lpad(CAST(CAST(floor(greatest(s,
      0) / 60) AS BIGINT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(greatest(s, 0)) AS BIGINT) % 60 AS VARCHAR), 2,
      '0') AS elapsed
    FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 100 AS s FROM {orders})"""
)
def str_waiting_message(t):
    """STR-29: which of five messages is shown after a time, and the time"""
    s = C("o_totalprice").cast("double") / 100
    return t("orders").select("o_orderkey", T.rotating(s, 5, 4).alias("message"), T.elapsed(s).alias("elapsed"))


@query(
    """SELECT doc_id, CASE WHEN trim(coalesce(long, ''), ' ') = '' THEN 'NOTHING'
      WHEN length(long) > 100000 THEN 'TOO_LONG' END AS code, length(long) AS chars
      FROM (SELECT doc_id, repeat(text, CAST(1 + doc_id % 60 AS INT)) AS long FROM {documents})"""
)
def src_pasted_text(t):
    """SRC-11: pasted texts of up to 100,000 characters"""
    pasted = F.repeat(C("text"), (1 + C("doc_id") % 60).cast("int"))
    return t("documents").select(
        "doc_id", FI.upload_code(F.lit(1), F.lit(None).cast("long"), pasted).alias("code"),
        F.length(pasted).cast("long").alias("chars")
    )


MISSPELLED = """CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || left(p_type, 3) WHEN 1 THEN substr(p_name, 2)
      WHEN 2 THEN replace(p_name, 'e', 'ee') ELSE reverse(p_name) END"""


@query(
    f"""WITH n AS (SELECT p_partkey AS name_id, {sql_key(MISSPELLED)} AS a
      FROM {{part}}), k AS (SELECT min(p_partkey) AS known_id, {sql_key('p_name')} AS b FROM {{part}} GROUP BY p_name),
      p AS (SELECT name_id, known_id, round(1.0 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)), 6) AS score
        FROM n, k),
      r AS (SELECT *, row_number() OVER (PARTITION BY name_id ORDER BY score DESC, known_id) AS rank FROM p WHERE score >= 0.55)
    SELECT name_id, CAST(rank AS INT) AS rank, known_id, score FROM r WHERE rank <= 3"""
)
def jon_similar_varieties(t):
    """JON-19, SRT-07: misspelled varieties and the three most similar known ones"""
    k = C("p_partkey") % 4
    name = F.when(
        k == 0,
        F.concat("p_name", F.lit(" "), F.left("p_type", F.lit(3)))
    ).when(k == 1, F.substring("p_name", 2, 1000)).when(k == 2, F.replace("p_name", F.lit("e"), F.lit("ee"))).otherwise(F.reverse("p_name"))
    known = t("part").groupBy(C("p_name").alias("known_name")).agg(F.min("p_partkey").alias("known_id"))
    return NM.suggest_names(t("part").select(C("p_partkey").alias("name_id"), name.alias("name")), known)


@query(
    """WITH n AS (SELECT line_id, fob, row_number() OVER (ORDER BY fob DESC, line_id) AS n, count(*) OVER () AS all_rows FROM {line}),
      k AS (SELECT *, CASE WHEN 2000 <= (all_rows + 24) // 25 THEN 49975 ELSE 0 END AS skip FROM n)
        SELECT line_id, CAST(fob AS DOUBLE) AS fob FROM k WHERE n > skip AND n <= skip + 25"""
)
def srt_deep_page(t):
    """SRT-01: page 2,000 of 25, found by a histogram of the order's first key"""
    return R.page(t("line").select("line_id", "fob"), ["-fob", "line_id"], 2000, 25).select("line_id", C("fob").cast("double").alias("fob"))


@query(
    """SELECT doc_id, md5(trim(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), ' ' || chr(10))) AS text_md5 FROM {documents}"""
)
def src_mail_bodies(t):
    """SRC-09: documents as nested mails, their text in base64 of two character sets or as it is"""
    text, k = F.coalesce("text", F.lit("")), C("doc_id") % 3
    wrapped = lambda charset: F.base64(F.encode(text, charset))
    head = F.when(k == 0, "utf-8\nContent-Transfer-Encoding: base64").when(
        k == 1,
        "utf-16\nContent-Transfer-Encoding: BASE64"
    ).otherwise("utf-8\nContent-Transfer-Encoding: 8bit")
    body = F.when(k == 0, wrapped("UTF-8")).when(k == 1, wrapped("UTF-16")).otherwise(text)
    start = 'Subject: an offer\nContent-Type: multipart/mixed; boundary="outer"\n\n--outer\nContent-Type: text/plain\nContent-Disposition: attachment; filename="a.txt"\n\nattached\n'
    inner = '--outer\nContent-Type: multipart/alternative; boundary="outer-1"\n\n--outer-1\nContent-Type: text/html\n\n<p>no</p>\n--outer-1\nContent-Type: text/plain; charset='
    mail = F.concat(F.lit(start), F.lit(inner), head, F.lit("\n\n"), body, F.lit("\n--outer-1--\n--outer--\n"))
    return t("documents").select("doc_id", F.md5(F.trim(ML.mail_text(mail), F.lit(" \n"))).alias("text_md5"))


PATTERNS = ("bolt", "all r", "ED WIDG", "b", "n g", "garden blue", "brand#1", " ", "no such text")


@query(
    f"""SELECT p AS pattern, article_id FROM {{article}}, (SELECT unnest([{", ".join(f"'{p}'" for p in PATTERNS if p.strip())}]) AS p)
    WHERE contains(lower(variety), lower(p)) OR contains(lower(product_name), lower(p)) OR contains(lower(color), lower(p))
    UNION ALL SELECT ' ', article_id FROM {{article}}"""
)
def flt_indexed_search(t):
    """FLT-01, FLT-06 to FLT-11: texts of one to twelve characters in an index of trigrams; the shortest by the rows themselves"""
    rows = t("article").select("article_id", "variety", "product_name", "color")
    index = TX.build(rows, "article_id", ("variety", "product_name", "color"))
    found = [index.search(rows, p).select(F.lit(p).alias("pattern"), "article_id") for p in PATTERNS]
    return reduce(DataFrame.unionAll, found)


@query(
    """WITH c AS (SELECT tariff_id, route_id, CAST(CASE WHEN tariff_id % 7 = 0 THEN rate * 2
      ELSE rate END AS DECIMAL(11,4)) AS rate, rate_unit FROM {tariff} WHERE tariff_id % 5 <> 0
        UNION ALL SELECT tariff_id + 10000000, route_id, CAST(rate AS DECIMAL(11,4)), 'PER_BOX' FROM {tariff} WHERE tariff_id % 11 = 0)
    SELECT tariff_id, route_id, CAST(rate AS DOUBLE) AS rate, rate_unit FROM c"""
)
def dml_changed_table(t):
    """DML-02, DML-04, DML-10 as writes: rates changed, added and deleted in a table of buckets, of which only the touched ones
    are rewritten
    """
    rows = t("tariff").select("tariff_id", "route_id", C("rate").cast("decimal(11,4)").alias("rate"), "rate_unit")
    table = V.VersionedTable.create(rows, SK.shared_folder(rows.sparkSession, "tariffs"), ["tariff_id"], buckets=16)
    double = rows.where("tariff_id % 7 = 0 and tariff_id % 5 <> 0").withColumn("rate", (C("rate") * 2).cast("decimal(11,4)"))
    gone = rows.where("tariff_id % 5 = 0")
    table.change(double.withColumn("op", F.lit(V.UPSERT)).unionByName(gone.withColumn("op", F.lit(V.DELETE))))
    more = rows.where("tariff_id % 11 = 0").withColumns(
        {"tariff_id": C("tariff_id") + 10000000, "rate_unit": F.lit("PER_BOX"), "op": F.lit(V.UPSERT)}
    )
    table.change(more)
    return table.read().withColumn("rate", C("rate").cast("double"))


@query(
    """SELECT doc_id, length(regexp_replace(coalesce(part, ''), '\\s+', '', 'g')) > 20 AS useful
      FROM (SELECT doc_id, substr(text, 1, CAST(doc_id % 60 AS INT)) AS part FROM {documents})"""
)
def src_pdf_text(t):
    """SRC-08: whether the text of a file is enough to go by: more than 20 characters besides white space"""
    part = F.substring(C("text"), F.lit(1), (C("doc_id") % 60).cast("int"))
    return t("documents").select("doc_id", FI.pdf_text_useful(F.coalesce(part, F.lit(""))).alias("useful"))
