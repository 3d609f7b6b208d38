"""Message lists, topics of warnings, selections and snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import S, trimmed

# How warnings say what they are about.
TOPICS = {
    "STEMS_PER_BOX": rf"(?i)stems?{S}*(?:per|/){S}*box",
    "BOX_WEIGHT": rf"(?i)box{S}*weight|weight{S}*per{S}*box|doosgewicht",
    "PRICE": r"(?i)price|prijs",
    "CURRENCY": r"(?i)currency|valuta",
    "TOTAL_STEMS": rf"(?i)total{S}*stems|totaal(?:{S}+aantal)?{S}+stelen",
    "QUANTITY": rf"(?i)quantity|hoeveelheid|aantal{S}+(?:dozen|boxes)",
    "UNIT": r"(?i)\bunit\b|eenheid",
    "BOX_TYPE": rf"(?i)box{S}*type|doostype",
    "FARM": rf"(?i)farm{S}*name|supplier{S}*name|leverancier(?:snaam)?",
}


def null_if_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def clean_messages(c: Column) -> Column:
    """Trimmed, without blank ones; null if none is left."""
    return null_if_empty(F.filter(F.transform(c, trimmed), lambda m: m != ""))


def merge_messages(a: Column, b: Column) -> Column:
    """Both lists in order, each message once; null if there is none."""
    empty = F.array().cast("array<string>")
    return null_if_empty(
        F.array_distinct(F.filter(F.transform(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)), trimmed), lambda m: m != ""))
    )


def warning_topics(c: Column) -> Column:
    """What a warning is about, in the order of TOPICS."""
    return F.filter(F.array(*(F.when(c.rlike(p), F.lit(t)) for t, p in TOPICS.items())), lambda t: t.isNotNull())


def reconcile(warnings: Column, resolved: dict[str, Column]) -> Column:
    """Warnings without those that are about something and whose topics are all resolved."""

    def stays(w: Column) -> Column:
        about = [w.rlike(p) for p in TOPICS.values()]
        anything, open_ = about[0], F.lit(False)
        for a in about[1:]:
            anything = anything | a
        for t, a in zip(TOPICS, about):
            open_ = open_ | (a & ~F.coalesce(resolved.get(t, F.lit(True)), F.lit(False)))
        return ~anything | open_

    return F.filter(warnings, stays)


def bulk_ids(ids: Column, most: int = 1000) -> Column:
    """struct(ids, error): distinct non-empty ids, one to `most`."""
    kept = F.array_distinct(F.filter(ids, lambda i: i.isNotNull() & (i != "")))
    error = F.when(F.coalesce(F.size(kept), F.lit(0)) < 1, "NOTHING_SELECTED").when(F.size(kept) > most, "TOO_MANY")
    return F.struct(F.when(error.isNull(), kept).alias("ids"), error.alias("error"))


def visible_selected(selected: Column, visible: Column) -> Column:
    return F.array_intersect(visible, selected)


def header_state(n_selected: Column, n_visible: Column) -> Column:
    return F.when((n_visible == 0) | (n_selected == 0), "unchecked").when(n_selected >= n_visible, "checked").otherwise("indeterminate")


def toggle_all(selected: Column, visible: Column, select_all: Column) -> Column:
    return F.when(select_all, F.array_union(selected, visible)).otherwise(F.array_except(selected, visible))


def toggle_one(selected: Column, item: Column, on: Column) -> Column:
    return F.when(on, F.array_union(selected, F.array(item))).otherwise(F.array_remove(selected, item))


def patched(old: Column, new: Column, enabled: Column) -> Column:
    """A field of a bulk edit: only enabled ones change."""
    return F.when(enabled, new).otherwise(old)


# The fields of a bulk edit, in the order in which they are shown, and their labels.
EDIT_LABELS = {
    "length": "Lengte",
    "box_type": "Box/verpakking",
    "weight": "Doosgewicht (kg)",
    "stems": "Stelen per doos",
    "code": "Leverancierscode",
    "notes": "Aantekeningen",
}
EMPTY_VALUE = "(leeg)"


def edit_error(enabled: dict[str, Column], values: dict[str, Column]) -> Column:
    """Why a bulk edit can't be made: NOTHING_ENABLED, BAD_WEIGHT, BAD_STEMS or NO_BOX_TYPE, the first that holds; null if it can."""
    on = lambda f: F.coalesce(enabled.get(f, F.lit(False)), F.lit(False))
    text = lambda f: F.coalesce(values.get(f, F.lit(None)).cast("string"), F.lit(""))
    weight = F.trim(text("weight")).try_cast("double")
    stems = F.nullif(F.regexp_extract(text("stems"), r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint")
    some = F.lit(False)
    for f in EDIT_LABELS:
        some = some | on(f)
    heavy = F.coalesce((weight > 0) & (weight < float("inf")), F.lit(False))
    return (
        F.when(~some, "NOTHING_ENABLED")
        .when(on("weight") & ~heavy, "BAD_WEIGHT")
        .when(on("stems") & ~F.coalesce(stems > 0, F.lit(False)), "BAD_STEMS")
        .when(on("box_type") & (F.trim(text("box_type")) == ""), "NO_BOX_TYPE")
    )


def edit_summary(enabled: dict[str, Column], values: dict[str, Column]) -> Column:
    """Array of struct(label, value): what a bulk edit changes, to be confirmed."""
    shown = lambda c: F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(EMPTY_VALUE))
    each = [
        F.when(
            enabled[f],
            F.struct(F.lit(label).alias("label"), shown(values[f]).alias("value"))
        ) for f, label in EDIT_LABELS.items() if f in enabled
    ]
    return F.array_compact(F.array(*each))


def edited(old: Column, new: Column, enabled: Column) -> Column:
    """A text field after a bulk edit: trimmed, empty ones null, others as they were."""
    return patched(old, F.nullif(F.trim(new.cast("string")), F.lit("")), F.coalesce(enabled, F.lit(False)))


#: Fields of the snapshot that an offer line keeps of what was read.
SNAPSHOT = [
    "raw_text", "product_group", "product_name", "variety", "length_cm", "quantity", "unit", "stems_per_box",
    "stems_per_bunch", "box_type", "box_weight", "price", "currency", "warnings", "confidence"
]


def snapshot(**fields: Column) -> Column:
    return F.to_json(F.struct(*(fields.get(f, F.lit(None)).alias(f) for f in SNAPSHOT)), {"ignoreNullFields": "false"})


def snapshot_warnings(c: Column) -> Column:
    """The warnings of a snapshot; empty if there are none or it can't be read."""
    return F.coalesce(
        F.filter(F.from_json(c, "struct<warnings: array<string>>")["warnings"], lambda w: w.isNotNull()),
        F.array().cast("array<string>")
    )
