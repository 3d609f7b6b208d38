"""Queries of the lists and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists as L
from ..operators import maintain as M
from .queries import MAPPINGS, MATCH, C, _mappings, query

ROUTES = """r AS (SELECT r.route_id, o.city AS from_city, o.country AS from_country, o.code AS from_code, d.city AS to_city,
      d.country AS to_country,
      d.code AS to_code, transport, CASE WHEN t.route_id IS NULL THEN NULL WHEN r.route_id % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency
    FROM {route} r JOIN {location} o ON o.location_id = origin_id JOIN {location} d ON d.location_id = destination_id LEFT
      JOIN {current_tariff} t ON t.route_id = r.route_id)"""


def _routes(t):
    place = lambda side, key: t("location").select(
        C("location_id").alias(key),
        *(C(c).alias(f"{side}_{c}") for c in ("city", "country", "code"))
    )
    r = t("route").join(place("from", "origin_id"), "origin_id").join(place("to", "destination_id"), "destination_id")
    rated = t("current_tariff").select("route_id", F.lit(True).alias("rated"))
    return r.join(rated, "route_id", "left").withColumn(
        "currency",
        F.when(C("rated"), F.when(C("route_id") % 2 == 0, "USD").otherwise("EUR"))
    )


@query(
    f"""WITH {ROUTES} SELECT route_id FROM r WHERE transport = 'AIR' AND currency = 'USD'
      AND contains(lower(concat_ws(' ', nullif(from_city, ''), nullif(from_country, ''), nullif(from_code, ''), nullif(to_city, ''),
        nullif(to_country, ''), nullif(to_code, ''), 'Luchtvracht', currency)), '_4 city 1')"""
)
def flt_route_list(t):
    """FLT-06: by transport, currency and words that go over fields"""
    return L.list_routes(_routes(t), transport="AIR", currency="USD", q="_4 City 1").select("route_id")


@query(f"""WITH {ROUTES} SELECT route_id FROM r WHERE lower(from_city) = 'quito' AND lower(to_country) = (SELECT lower(min(country))
      FROM {{location}})""")
def flt_route_places(t):
    """FLT-06: by places"""
    least = t("location").agg(F.min("country")).head()[0]
    return L.list_routes(_routes(t), from_city="QUITO", to_country=least.lower()).select("route_id")


@query(
    """SELECT c_custkey FROM {customer} JOIN {location} ON location_id = c_nationkey WHERE contains(lower(country), 'ion_1')
      AND contains(lower(concat_ws(' ', nullif(c_name, ''), nullif(country, ''), nullif(city, ''))), '5 nation')"""
)
def flt_customer_list(t):
    """FLT-07"""
    none = F.lit(None).cast("string")
    place = t("location").select(C("location_id").alias("destination_id"), "country", "city")
    c = t("customer").select(
        "c_custkey", C("c_name").alias("customer_name"), none.alias("contact"), none.alias("phone"),
        none.alias("email"), C("c_nationkey").alias("destination_id")
    )
    return L.list_customers(c.join(place, "destination_id"), country="ION_1", q="5 Nation").select("c_custkey")


@query("""SELECT effective_from FROM {fx} WHERE quote = 'USD' AND contains(lower(base || ' ' || quote || ' ' || CAST(rate AS VARCHAR)),
      'usd 1.')""")
def flt_rate_list(t):
    """FLT-08"""
    none = F.lit(None).cast("string")
    return L.list_rates(t("fx").withColumns({"notes": none, "updated_by": none}), quote="USD", q="usd 1.").select("effective_from")


@query("SELECT o_orderkey FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_nationkey = 3")
def flt_quote_list(t):
    """FLT-09: an absent filter is none"""
    c = t("customer").select(C("c_custkey").alias("customer_id"), C("c_nationkey").alias("destination_id"))
    q = t("orders").select("o_orderkey", C("o_custkey").alias("customer_id"), C("o_orderstatus").alias("status")).join(c, "customer_id")
    return L.list_quotes(q, status="O", destination=3, customer=None).select("o_orderkey")


@query("SELECT DISTINCT offer_id, farm_id FROM {line} WHERE farm_id = 3 AND offer_status = 'REVIEWED'")
def flt_offer_list(t):
    """FLT-10"""
    offers = t("line").select("offer_id", "farm_id", C("offer_status").alias("status")).distinct()
    return L.list_offers(offers, farm=3, status="REVIEWED").select("offer_id", "farm_id")


@query("WITH l AS (SELECT line_id, farm_id, raw_text FROM {line}), " + MAPPINGS + """ SELECT farm_id, article_id FROM mp
      WHERE contains(lower(src), 'row 7 ') OR contains(lower('Line ' || CAST(article_id AS VARCHAR)), 'row 7 ')""")
def flt_mapping_list(t):
    """FLT-11"""
    m = _mappings(t).withColumn("raw_source", F.concat(F.lit("Line "), C("article_id").cast("string")))
    return L.list_mappings(m, q="ROW 7 ").select("farm_id", "article_id")


@query("SELECT cost_id FROM {cost} WHERE cost_id % 3 = 0")
def flt_active_costs(t):
    """FLT-12"""
    return L.active(
        t("cost").withColumn("is_active", F.when(C("cost_id") % 3 == 0, True).when(C("cost_id") % 3 == 1, False))
    ).select("cost_id")


FLAGS = """f AS (SELECT line_id, quantity > 40 AS blocking, quantity % 5 = 0 AS warned, part_id % 4 = 0 AS unmatched FROM {line})"""


@query(
    f"""WITH {FLAGS} SELECT line_id, n FROM (SELECT line_id, 'ALL' AS n FROM f UNION ALL SELECT line_id, 'NEEDS_ATTENTION' FROM f
      WHERE blocking OR warned OR unmatched
      UNION ALL SELECT line_id, 'BLOCKING' FROM f WHERE blocking UNION ALL SELECT line_id, 'WARNINGS' FROM f WHERE warned
      UNION ALL SELECT line_id, 'UNMATCHED' FROM f WHERE unmatched UNION ALL SELECT line_id, 'READY' FROM f WHERE NOT (blocking OR warned
        OR unmatched))"""
)
def flt_review_filters(t):
    """FLT-05: all six filters"""
    some = lambda yes: F.when(yes, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>"))
    lines = t("line").select(
        "line_id", some(C("quantity") > 40).alias("errors"), some(C("quantity") % 5 == 0).alias("warnings"),
        F.when(C("part_id") % 4 == 0, "UNMATCHED").otherwise("DERIVED").alias("match_status")
    )
    passed = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in L.review_flags().items())), lambda x: x.isNotNull())
    return lines.select("line_id", F.explode(passed).alias("n"))


@query("""SELECT line_id, row_number() OVER (ORDER BY part_id % 20 = 0 DESC, farm_name, l.part_id % 97, line_id) AS place FROM {line} l
      JOIN {farm} f ON f.farm_id = l.farm_id""")
def srt_wizard_order(t):
    """SRT-04: all candidates as the wizard lists them"""
    lines = t("line").join(t("farm").select("farm_id", "farm_name"), "farm_id")
    candidates = lines.select(
        "line_id",
        "farm_name",
        (C("part_id") % 20 == 0).alias("preselected"),
        (C("part_id") % 97).alias("created_at")
    )
    return L.in_wizard_order(candidates).select("line_id", "place")


@query(
    """WITH e AS (SELECT offer_id, upper(substr(raw_text, 1, 6)) AS e, min(line_id) AS pos FROM {line} GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY pos, e) AS n FROM e) SELECT offer_id, string_agg(e, '|'
      ORDER BY n) AS errors FROM n WHERE n <= 5 GROUP BY offer_id"""
)
def agg_first_errors(t):
    """AGG-12"""
    r = t("line").select("offer_id", "line_id", F.upper(F.substring("raw_text", 1, 6)).alias("error"))
    return L.first_errors(r, "offer_id", "error", "line_id").select("offer_id", F.array_join("errors", "|").alias("errors"))


@query("""SELECT line_id, coalesce(CASE WHEN part_id % 3 <> 0 THEN l.farm_id END, f.farm_id) AS farm_id FROM {line} l LEFT
      JOIN (SELECT article_id, farm_id FROM {article} WHERE variant_id % 5 <> 0) f ON f.article_id = own_article""")
def jon_update_from(t):
    """JON-23: what is missing is taken from the joined row, the rest stays"""
    rows = t("line").select("line_id", C("own_article").alias("article_id"), F.when(C("part_id") % 3 != 0, C("farm_id")).alias("farm_id"))
    source = t("article").select("article_id", F.when(C("variant_id") % 5 != 0, C("farm_id")).alias("farm_id"))
    return L.fill_from(rows, source, "article_id", "farm_id").select("line_id", "farm_id")


@query("""SELECT o_orderkey AS offer_id, o_orderkey IN (SELECT offer_id FROM {line} WHERE part_id % 10 = 0) AS blocked
      FROM (SELECT DISTINCT o_orderkey FROM {orders})""")
def jon_blocked_offers(t):
    """JON-25"""
    return L.deletable_offers(t("orders").select(C("o_orderkey").alias("offer_id")), t("line").where("part_id % 10 = 0"))


PROFILES = """p AS (SELECT farm_id, variant_id, box_type, stems_per_box, box_weight + v AS weight, v FROM {article} CROSS
      JOIN (SELECT unnest([0, 1]) AS v) WHERE variant_id % 4 <> 0 AND box_weight IS NOT NULL)"""


@query(
    f"""WITH {MATCH}, {MAPPINGS}, {PROFILES},
    m AS (SELECT r.line_id, CASE WHEN u.line_id IS NOT NULL THEN 'USER_LINKED' ELSE match_status END AS match_status,
        CASE WHEN u.line_id IS NOT NULL THEN u.article_id % 10000000 ELSE r.variant_id END AS variant_id FROM r LEFT
          JOIN used u USING (line_id))
    SELECT m.line_id, match_status, CAST(CASE WHEN x.quantity % 3 = 0 THEN 2.5 ELSE coalesce(p.weight, CASE
      WHEN x.quantity % 3 = 1 THEN 0 END) END AS DOUBLE) AS weight
    FROM m JOIN {{line}} x ON x.line_id = m.line_id JOIN {{article}} a ON a.article_id = x.own_article
    LEFT JOIN p ON p.farm_id = x.farm_id AND p.variant_id = m.variant_id AND p.box_type = a.box_type AND p.stems_per_box = a.stems_per_box
      AND p.v = 1"""
)
def dml_bulk_lines(t):
    """DML-09, WIN-04: a third of the lines has a weight of its own, a third a zero, a third none"""
    a = t("article").select(C("article_id").alias("own_article"), "box_type", "stems_per_box")
    weight = F.when(C("quantity") % 3 == 0, F.lit(2.5)).when(C("quantity") % 3 == 1, F.lit(0.0)).cast("decimal(11,3)")
    lines = t("line").withColumn("weight_kg", weight)
    own = t("article").where("variant_id % 4 <> 0 and box_weight is not null").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    profiles = own.select(
        "farm_id", "variant_id", "box_type", "stems_per_box",
        (C("box_weight") + C("v")).cast("decimal(11,3)").alias("weight_kg"), C("v").alias("effective_from")
    )
    return L.bulk_offer_lines(lines, _mappings(t), t("article"), profiles, boxes=a).select(
        "line_id",
        "match_status",
        C("weight_kg").cast("double").alias("weight")
    )


@query(
    f"""WITH {MATCH} SELECT r.line_id, CASE WHEN x.part_id % 6 = 0 THEN 'USER_LINKED' ELSE r.match_status END AS match_status,
      CASE WHEN x.part_id % 6 = 0 THEN x.own_article ELSE r.article_id END AS article_id FROM r JOIN {{line}} x USING (line_id)"""
)
def mat_live_view(t):
    """MAT-09"""
    saved = F.when(C("part_id") % 6 == 0, "USER_LINKED").when(C("part_id") % 6 == 1, "AUTO_MATCHED")
    return L.live_view(
        t("line").withColumns({"saved_status": saved, "saved_article": C("own_article")}),
        t("article")
    ).select("line_id", "match_status", "article_id")


@query(
    """WITH d AS (SELECT customer_id, destination_id, false AS is_default FROM {buyer} WHERE customer_id % 3 = 0)
    SELECT * FROM d UNION ALL SELECT customer_id, destination_id, true FROM {buyer} WHERE customer_id % 3 <> 0 AND customer_id % 7 <> 0"""
)
def dml_backfill_destinations(t):
    """DML-15: a default row for each customer that has a destination and no row for it"""
    c = t("buyer").select(
        "customer_id",
        F.when((C("customer_id") % 7 != 0) | (C("customer_id") % 3 == 0), C("destination_id")).alias("destination_id")
    )
    d = t("buyer").where("customer_id % 3 = 0").select(
        "customer_id", "destination_id", F.lit(False).alias("is_default"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at")
    )
    return M.backfill_default_destinations(c, d, F.lit("2024-02-01").cast("timestamp")).select(
        "customer_id",
        "destination_id",
        "is_default"
    )
