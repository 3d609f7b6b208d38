"""Searches, pages, ranks and set operations over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder

# Rows on a page.
PAGE_SIZES, DEFAULT_PAGE_SIZE = (25, 50, 100), 50


def contains(c: Column, text: str) -> Column:
    """Literal containment in any case; never a pattern."""
    return F.contains(F.lower(c.cast("string")), F.lower(F.lit(text)))


def search(
    df: DataFrame, *, equal: dict | None = None, like: dict | None = None, q: str | None = None,
    q_columns: tuple[str, ...] = ()
) -> DataFrame:
    """Rows that equal all given values, contain all given texts, and contain q in one column at least. Values that are None or
    empty are no filter.
    """
    for c, v in (equal or {}).items():
        if v not in (None, ""):
            df = df.where(F.col(c) == v)
    for c, v in (like or {}).items():
        if v:
            df = df.where(contains(F.col(c), v))
    if q and q.strip():
        hit = F.lit(False)
        for c in q_columns:
            hit = hit | F.coalesce(contains(F.col(c), q.strip()), F.lit(False))
        df = df.where(hit)
    return df


ASSORTMENT_Q = ("farm_name", "country", "product_name", "variety", "color", "grade", "stem_length", "box_type", "supplier_code")


def search_assortment(
    articles: DataFrame, *, farm_id=None, product_id=None, box_type=None, box_weight=None, variety=None, length=None,
    q=None
) -> DataFrame:
    return search(
        articles, equal={"farm_id": farm_id, "product_id": product_id, "box_type": box_type, "box_weight": box_weight},
        like={"variety": variety, "stem_length": length}, q=q,
        q_columns=tuple(c for c in ASSORTMENT_Q if c in articles.columns)
    )


#: Rows up to the end of a page that are found by one top-k; deeper pages are found by ranges.
SHALLOW = 10_000
#: Ranges of a histogram, and rows of the sample that its bounds are taken from.
RANGES, SAMPLE = 128, 20_000


def _ordered(order: list[str]) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def _one_range(df: DataFrame, order: list[str], skip: int, rows: int, n: int) -> tuple[DataFrame, int]:
    """(the rows of df that hold rows skip .. skip + rows of its order, how many rows stand before them): by a histogram of the
    first key, and within one heavy value by the next key.
    """
    name, falling = order[0].lstrip("-"), order[0].startswith("-")
    c = F.col(name)
    share = min(1.0, SAMPLE / max(n, 1))
    some = df.select(c).where(c.isNotNull()).sample(share, 1).distinct().orderBy(c).limit(2 * SAMPLE).collect()
    values = [r[0] for r in some[:: max(1, len(some) // RANGES)]]
    # number of a row's range: 0 for null, then how many bounds it has reached
    bounds = F.array(*map(F.lit, values)) if values else None
    number = F.when(c.isNull(), 0).otherwise(1 + (F.size(F.filter(bounds, lambda b: b <= c)) if values else F.lit(0)))
    counts = {r["r"]: r["n"] for r in df.groupBy(number.alias("r")).agg(F.count("*").alias("n")).collect()}
    before, chosen = 0, []
    for r in sorted(counts, reverse=falling):
        if before + counts[r] > skip and (not chosen or before < skip + rows):
            chosen.append((r, before))
        before += counts[r]
    if not chosen:
        return df.limit(0), 0
    hit = F.lit(False)
    for r, _ in chosen:
        if r == 0:
            hit = hit | c.isNull()
            continue
        inside = c.isNotNull()
        inside = inside & (c >= F.lit(values[r - 2])) if r > 1 else inside
        inside = inside & (c < F.lit(values[r - 1])) if r <= len(values) else inside
        hit = hit | inside
    part, ahead = df.where(hit), chosen[0][1]
    size = sum(counts[r] for r, _ in chosen)
    if len(order) > 1 and size > SHALLOW and size > 4 * n / RANGES and part.select(c).distinct().limit(2).count() == 1:
        inner, more = _one_range(part, order[1:], skip - ahead, rows, size)
        return inner, ahead + more
    return part, ahead


def page(df: DataFrame, order: list[str], number: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page of a stable order: column names, falling with a minus before them. A page beyond the last one is the first; an
    unknown size is the default.

    A page near the top is a top-k. Of a deep one, exact counts of the ranges of a histogram tell which range holds it, and only
    the rows of that
    range, which the filter on the first key leaves of the scan, are sorted. Ties of the whole order are not told apart.
    """
    size = size if size in PAGE_SIZES else DEFAULT_PAGE_SIZE
    n = df.count()
    pages = max(1, -(-n // size))
    number = number if 1 <= number <= pages else 1
    skip = (number - 1) * size
    if skip + size <= SHALLOW:
        return df.orderBy(*_ordered(order)).offset(skip).limit(size)
    part, ahead = _one_range(df, order, skip, size, n)
    return part.orderBy(*_ordered(order)).offset(skip - ahead).limit(size)


def in_global_order(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with each row's number (from 1) in one order of all rows. Ties must be told apart by `order`.

    Rows are dealt to sorted ranges and written; a row's number is its place in its range behind the rows of all
    ranges before. Only the ranges' counts, one number each, pass through the driver: no window holds all rows.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower 33 bits of this id count the rows of a partition in their order
    placed = sorted_rows.withColumns(
        {"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    )
    path = shared_folder(df.sparkSession, "order")
    placed.write.parquet(path)
    rows = df.sparkSession.read.schema(placed.schema).parquet(path)
    counts = sorted((r["_range"], r["n"]) for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for i, n in counts:
        starts.append((i, before))
        before += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_r int, _before long"))
    return rows.join(offsets, F.col("_range") == F.col("_r")).select(*df.columns, (F.col("_before") + F.col("_place") + 1).alias(name))


def numbered_within(df: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """df with each row's number (from 1) within its group. However large a group is, no task holds it: numbers run over all
    rows, less those of the groups before.
    """
    rows = in_global_order(df, [group, *order], "_all")
    starts = rows.groupBy(F.col(group).alias("_g")).agg(F.min("_all").alias("_first"))
    return rows.join(starts, F.col(group).eqNullSafe(F.col("_g"))).select(*df.columns, (F.col("_all") - F.col("_first") + 1).alias(name))


def first_per(df: DataFrame, keys: list[str], order: list, name: str | None = None) -> DataFrame:
    """The first row of each key; with a name, all rows with their rank instead."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if name:
        return df.withColumn(name, F.row_number().over(w))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def current_tariffs(tariffs: DataFrame, as_of: str) -> DataFrame:
    """One tariff a route: a valid one first, then the newest by start, change and id."""
    t = F.lit(as_of).cast("timestamp")
    valid = (F.col("effective_from") <= t) & (F.col("effective_to").isNull() | (F.col("effective_to") >= t))
    return first_per(
        tariffs, ["route_id"],
        [F.when(valid, 0).otherwise(1), F.desc("effective_from"), F.desc("updated_at"), F.desc("tariff_id")]
    )


def current_costs(costs: DataFrame, as_of: str) -> DataFrame:
    """The same for a route's costs of one type; costs without a type never replace one another."""
    t = F.lit(as_of).cast("timestamp")
    valid = (F.col("effective_from") <= t) & (F.col("effective_to").isNull() | (F.col("effective_to") >= t))
    keyed = costs.withColumn(
        "_type",
        F.coalesce(F.col("cost_type_id").cast("string"), F.concat(F.lit("id:"), F.col("cost_id").cast("string")))
    )
    return first_per(
        keyed, ["route_id", "_type"],
        [F.when(valid, 0).otherwise(1), F.desc("effective_from"), F.desc("updated_at"), F.desc("cost_id")]
    ).drop("_type")


def option_list(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, in order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """parents with the number of their children, 0 for none."""
    n = children.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    return parents.join(n, F.col(key) == F.col("_k"), "left").select(*parents.columns, F.coalesce("_n", F.lit(0)).alias(name))


def without(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children, key, "left_anti")




def import_new(incoming: DataFrame, existing: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """incoming with outcome CREATED, DUPLICATE (known already, or again in the batch: the first counts) or INVALID (no key)."""
    k = existing.select(key.alias("_k")).distinct().withColumn("_known", F.lit(True))
    w = Window.partitionBy("_key").orderBy(*order)
    rows = incoming.withColumn("_key", F.nullif(key, F.lit("")))
    j = rows.join(k, F.col("_key") == F.col("_k"), "left")
    outcome = F.when(F.col("_key").isNull(), "INVALID").when(F.col("_known"), "DUPLICATE").when(
        F.row_number().over(w) > 1,
        "DUPLICATE"
    ).otherwise("CREATED")
    return j.select(*incoming.columns, outcome.alias("outcome"))


def deterministic_or_fallback(first: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Lines of both sources; a fallback line counts only where its document has none of the first."""
    return first.unionByName(fallback.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def missing_ids(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """ids with found: whether the table has them."""
    t = table.select(F.col(key).alias("_k")).distinct()
    return ids.join(t, F.col(key) == F.col("_k"), "left").select(*ids.columns, F.col("_k").isNotNull().alias("found"))


def dashboard(quotes: DataFrame, lines: DataFrame, articles: DataFrame, routes: DataFrame, tariffs: DataFrame) -> DataFrame:
    """One row: concept quotes, lines without a variant, articles without weight, routes without a tariff. Whole counts, without
    the cap of a list on screen.
    """
    return (
        quotes.agg(F.count_if(F.col("status") == "CONCEPT").alias("concept_quotes"))
        .crossJoin(lines.agg(F.count_if(F.col("variant_id").isNull()).alias("unlinked_lines")))
        .crossJoin(articles.agg(F.count_if(F.col("box_weight").isNull()).alias("missing_weight")))
        .crossJoin(without(routes, tariffs, "route_id").agg(F.count("*").alias("unrated_routes")))
    )


def quotable_candidates(lines: DataFrame, preselected: DataFrame) -> DataFrame:
    """Lines that may be quoted: of a reviewed offer, matched, with an article, and with a price unless they were picked before
    (preselected: line_id). Picked ones first, then by farm and time.
    """
    p = preselected.select(F.col("line_id").alias("_p")).distinct()
    j = lines.join(p, F.col("line_id") == F.col("_p"), "left").withColumn("preselected", F.col("_p").isNotNull()).drop("_p")
    fits = (F.col("offer_status") == "REVIEWED") & F.col("match_status").isin("AUTO_MATCHED", "DERIVED", "USER_LINKED") & F.col("article_id").isNotNull() & (
        F.col("price").isNotNull() | F.col("preselected")
    )
    return j.where(fits)


def mapped_flag(lines: DataFrame, mappings: DataFrame, source: Column) -> DataFrame:
    """lines with has_mapping: whether their wording stands for their article. source is only made of lines whose farm has a mapping
    to their article, and lines are dealt and sorted by numbers, not by texts.
    """
    m = mappings.groupBy(F.col("farm_id").alias("_f"), F.col("article_id").alias("_a")).agg(F.collect_set("normalized_source").alias("_s"))
    j = lines.join(m, (F.col("farm_id") == F.col("_f")) & (F.col("article_id") == F.col("_a")), "left")
    known = F.when(F.col("_s").isNotNull(), F.array_contains("_s", source))
    return j.select(*lines.columns, F.coalesce(known, F.lit(False)).alias("has_mapping"))


def distinct_per(df: DataFrame, key: str, column: str, most: int | None = None) -> DataFrame:
    """key, values (distinct, in order, at most `most`) and n, how many there are in all."""
    v = df.where(F.col(column).isNotNull()).select(key, column).distinct()
    values = F.array_sort(F.collect_list(column))
    return v.groupBy(key).agg((F.slice(values, 1, most) if most else values).alias("values"), F.count("*").alias("n"))


def sorted_by(df: DataFrame, key: str, descending: bool = False, missing=-1, tie: str | None = None) -> DataFrame:
    """df in the order of a column; missing values count as `missing`."""
    c = F.coalesce(F.col(key), F.lit(missing))
    return df.orderBy(c.desc() if descending else c.asc(), *([tie] if tie else []))


def recent(df: DataFrame, at: str, tie: str, n: int = 5) -> DataFrame:
    """The n latest rows."""
    return df.orderBy(F.col(at).desc(), tie).limit(n)
