"""Text functions of offers, as Column expressions that stay in the JVM."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as source systems see it: ASCII and Unicode spaces, line separators, the byte order mark. For use inside a character class.
#: Single characters below 256 are one table, and the rest is only asked of characters in its range: most are settled by two questions.
SPACES = r" \t\n\x0b\f\r\u00a0[\u1680-\ufeff&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]"
#: The same characters as a string.
SPACE_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
S = f"[{SPACES}]"

# Words that name a grade or a treatment, in order of precedence.
GRADES = ["select", "sel", "premium", "prem", "fancy", "super", "jumbo", "choice", "extra", "standard", "std"]
TREATMENTS = ["tinted", "painted", "dyed", "bleached", "normal"]

# What suppliers call product groups.
PRODUCT_GROUPS = {
    "hyd": "Hydrangea",
    "hydrangea": "Hydrangea",
    "alstro": "Alstroemeria",
    "alstroemeria": "Alstroemeria",
    "ruscus": "Ruscus",
    "solidago": "Solidago",
    "chrysantemums": "Chrysanthemum",
    "chrysanthemums": "Chrysanthemum",
    "chrysanthemum": "Chrysanthemum",
    "eryngium": "Eryngium",
    "eucalipto": "Eucalyptus",
    "eucalyptus": "Eucalyptus",
    "barbatus": "Barbatus (Sweet William)",
    "carnations": "Carnation",
    "carnation": "Carnation",
    "minicarnation": "Mini Carnation",
    "mini carnation": "Mini Carnation",
    "star": "Star (Alstroemeria)",
    "solomio": "Solomio (Alstroemeria)",
    "rose": "Rose",
    "roses": "Rose",
}

# Labels that only say rose, and the product they stand for.
GENERIC_ROSES, ROSE_PRODUCT = ["rose", "roses", "rosa", "rosa ec"], "Rosa Ec"

# Words of a farm's name that say its legal form.
LEGAL_FORMS = ["ci", "sas", "sa", "ltda", "cia", "eu", "inc", "corp", "s", "a", "c", "i"]

# Second words that belong to the product, not to the variety.
QUALIFIERS = ["st", "sp", "spray", "solomio", "ec"]

# Texts that the system itself writes where a line has no source text.
PLACEHOLDERS = ["(kon oorspronkelijke brontekst niet achterhalen)", "(handmatig ingevoerd)"]


def once(c: Column, use) -> Column:
    """use(c), with c evaluated once however often use refers to it: it stands in an array."""
    return F.transform(F.array(c), use)[0]


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE_CHARS))


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, f"{S}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(trimmed(c) != "", c)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def replace_first(c: Column, pattern: str, by: str) -> Column:
    """Only the first match is replaced."""
    return F.regexp_replace(c, f"(?s)^(.*?)(?:{pattern})", f"$1{by}")


def without_first(c: Column, literal: Column, by: str) -> Column:
    """c with the first occurrence of another column's text replaced."""
    at = F.position(literal, c)
    return F.when(
        at > 0,
        F.concat(F.substring(c, F.lit(1), at - 1), F.lit(by), F.substring(c, at + F.length(literal), F.length(c)))
    ).otherwise(c)


# --- decimal strings, lengths, boxes -------------------------------------------------------------


def decimal_string(c: Column) -> Column:
    """A price as plain digits with a dot. Of dot and comma the last is the decimal point; a lone comma is one; signs are dropped."""
    dotted = lambda x: F.regexp_replace(x, r"^([^,]*),", "$1.")

    def plain(s: Column) -> Column:
        comma, dot = s.contains(","), s.contains(".")
        last = F.when(s.rlike(r",[^.]*$"), dotted(F.replace(s, F.lit("."), F.lit("")))).otherwise(F.replace(s, F.lit(","), F.lit("")))
        return F.when(comma & dot, last).when(comma, dotted(s)).otherwise(s)

    found = once(F.regexp_replace(c, "[^0-9.,]", ""), plain)
    return once(found, lambda x: F.when(x.rlike(r"^\d+(\.\d+)?$"), x))


def length_cm(c: Column) -> Column:
    """The first number, a comma read as a point."""
    return extract(replace_first(c, ",", "."), r"(\d+(?:\.\d+)?)").cast("double")


BOX = rf"(?i)(\d+){S}*(?:QB|HB|FB){S}*[x×*]?{S}*(\d+)"


def box_pattern(c: Column) -> Column:
    """struct(boxes, stems, matched) of `<n>QB x <m>` and its like; null without one."""
    found = F.struct(
        extract(c, BOX, 1).cast("int").alias("boxes"), extract(c, BOX, 2).cast("int").alias("stems"),
        extract(c, BOX, 0).alias("matched")
    )
    return F.when(c.rlike(BOX), found)


def box_type(c: Column) -> Column:
    """The first box type that stands alone; QB without one, so `30HBx40` is a QB."""
    return F.coalesce(F.upper(extract(c, r"(?i)\b(QB|HB|FB)\b")), F.lit("QB"))


def lead_time_hours(c: Column) -> Column:
    return extract(c, rf"(?i)additional{S}+time{S}+required{S}+(\d+){S}*hr").cast("int")


def first_keyword(c: Column, keywords: list[str]) -> Column:
    """The first of the keywords, in their order, that stands in the text as a word. Texts without any are asked once."""
    first = F.coalesce(*(F.when(c.rlike(rf"(?i)\b{k}\b"), F.lit(k)) for k in keywords))
    return F.when(c.rlike(rf"(?i)\b(?:{'|'.join(keywords)})\b"), first)


def grade(c: Column) -> Column:
    return first_keyword(c, GRADES)


def treatment(c: Column) -> Column:
    return first_keyword(c, TREATMENTS)


# --- keys ----------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, str, str]:
    """What compatibility decomposition without accents does, by Python's Unicode tables: (from, to) for one letter to one,
    the letters and a JSON map for one to many. Alphabets, punctuation, symbols and wide forms; East Asian scripts stay as they are."""
    one_from, one_to, many = [], [], {}
    for code in (*range(0x80, 0x300), *range(0x370, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        c = chr(code)
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        if folded == c:
            continue
        if len(folded) == 1:
            one_from.append(c)
            one_to.append(folded)
        else:
            many[c] = folded
    return "".join(one_from), "".join(one_to), "".join(many), json.dumps(many)


def without_accents(c: Column) -> Column:
    """Compatibility decomposition with the combining accents dropped."""
    one_from, one_to, several, table = _decompositions()
    accents = "".join(map(chr, range(0x300, 0x370)))
    single = F.translate(c, one_from + accents, one_to)  # what has no counterpart goes

    def spelled(x: Column) -> Column:
        letters = F.transform(F.split(x, ""), lambda y: F.coalesce(F.try_element_at(F.from_json(F.lit(table), "map<string,string>"), y), y))
        return F.when(F.length(F.translate(x, several, "")) != F.length(x), F.array_join(letters, "")).otherwise(x)

    # in an array, so that the translated text is made once
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.transform(F.array(single), spelled)[0])


def match_key(c: Column) -> Column:
    """The key that products and varieties are matched on: lower case, no accents, letters and digits, single spaces."""
    return F.trim(F.regexp_replace(without_accents(F.lower(c)), "[^a-z0-9]+", " "))


def source_key(c: Column) -> Column:
    """The key that a supplier's own wording is remembered by: punctuation and digits stay."""
    return collapsed(F.lower(without_accents(c)))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, on match keys; 1 for equal keys."""
    x, y = match_key(a), match_key(b)
    return F.when(x == y, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def product_group(c: Column) -> Column:
    """struct(name, recognized): the group's name; of unknown ones each word with a capital first letter."""
    table = json.dumps(PRODUCT_GROUPS)
    known = lambda t: F.try_element_at(F.from_json(F.lit(table), "map<string,string>"), F.lower(t))
    found = lambda t: once(
        known(t), lambda k: F.struct(F.coalesce(k, capitals(t)).alias("name"), k.isNotNull().alias("recognized"))
    )
    return once(trimmed(c), found)


def capitals(c: Column) -> Column:
    """Each run of non-spaces from its first letter or digit: that in upper case, the rest in lower case."""
    marked = F.regexp_replace(c, rf"([A-Za-z0-9_][^{SPACES}]*)", "\u0001$1\u0001")
    parts = F.split(marked, "\u0001")
    return F.array_join(
        F.transform(
            parts,
            lambda x, i: F.when(i % 2 == 1, F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))).otherwise(x)
        ),
        ""
    )


def rose_label(c: Column) -> Column:
    """Labels that only say rose become the canonical rose product; blank becomes null."""
    t = trimmed(c)
    return F.when(t == "", None).when(F.lower(t).isin(*GENERIC_ROSES), F.lit(ROSE_PRODUCT)).otherwise(c)


def imported_product(name: Column, group: Column) -> Column:
    return F.coalesce(rose_label(F.nullif(trimmed(name), F.lit(""))), rose_label(F.nullif(trimmed(group), F.lit(""))))


def exact_length_cm(c: Column) -> Column:
    """The first number unless two are joined by a dash."""
    return once(
        trimmed(c),
        lambda t: F.when(~t.rlike(rf"\d+(?:[.,]\d+)?{S}*[-–—]{S}*\d+(?:[.,]\d+)?"), length_cm(t))
    )


def without_garden(key: Column) -> Column:
    """A match key without its leading `garden`; null if it has none."""
    return F.nullif(trimmed(extract(key, r"(?s)^garden (.+)$")), F.lit(""))


def assortment_length(c: Column) -> Column:
    """struct(ok, value): whole centimetres above zero, with or without `cm`."""
    n = extract(trimmed(c), rf"(?i)^(\d+){S}*(?:cm)?$").cast("decimal(38,0)")
    return F.struct(F.coalesce(n > 0, F.lit(False)).alias("ok"), F.when(n > 0, n.cast("string")).alias("value"))


def trailing_length(c: Column) -> Column:
    """The length that ends a variety's name, as in `Freedom 60cm`."""
    n = extract(c, rf"(?i){S}(\d+){S}*cm$").cast("decimal(38,0)")
    return F.when(n > 0, n.cast("string"))


def farm_key(c: Column) -> Column:
    """A farm's name without accents, punctuation and legal forms."""
    words = F.split(match_key(c), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*LEGAL_FORMS)), " ")


def import_box_type(c: Column) -> Column:
    """HB, QBE and blank ones are taken as QB."""
    t = trimmed(c)
    return F.when(t.isNull() | (t == "") | F.upper(t).isin("HB", "QBE"), F.lit("QB")).otherwise(t)


def valid_source(c: Column) -> Column:
    """Whether a line's text can be remembered: not blank, not one of the system's own."""
    t = trimmed(c)
    return F.coalesce((t != "") & ~t.isin(*PLACEHOLDERS), F.lit(False))


def variant_label(product: Column, variety: Column, color: Column, grade_: Column, length: Column) -> Column:
    return F.concat_ws(" - ", *(F.nullif(x, F.lit("")) for x in (product, variety, color, grade_, length)))


def cost_type_key(c: Column) -> Column:
    return F.lower(trimmed(c))


def cost_name(type_name: Column, row_name: Column) -> Column:
    """The name of the cost's type, else its own."""
    return F.coalesce(type_name, F.nullif(trimmed(row_name), F.lit("")), F.lit("Additional cost"))


def delete_blocked(subject: str, **counts: Column) -> Column:
    """Why something can't be deleted: what still refers to it; null if nothing does."""
    parts = F.concat_ws(", ", *(F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.lit(label))) for label, n in counts.items()))
    return F.when(parts != "", F.concat(F.lit(f"{subject} is still used by "), parts))


def elapsed(seconds: Column) -> Column:
    s = F.greatest(F.floor(seconds), F.lit(0))
    return F.format_string("%02d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60)))


def rotating(seconds: Column, count: int, interval: int) -> Column:
    """Which of `count` messages is shown after so many seconds."""
    return F.pmod(F.floor(seconds / interval), F.lit(count)).cast("int")


def money_nl(c: Column, decimals: int = 2) -> Column:
    """1.234,56"""
    return F.translate(F.format_number(c, decimals), ",.", ".,")


def date_nl(c: Column) -> Column:
    return F.date_format(c, "dd-MM-yyyy")


# --- paste rows ----------------------------------------------------------------------------------


def cells(line: Column) -> Column:
    """Cells of a pasted line: between tabs, or between commas if it has no tab."""
    return F.transform(F.when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, ",")), trimmed)


def article_parts(c: Column) -> Column:
    """struct(product, variety): the first word, with a qualifier that follows it, and the rest; null for a single word."""

    def parts(w: Column) -> Column:
        two = (F.size(w) >= 3) & F.lower(F.try_element_at(w, F.lit(2))).isin(*QUALIFIERS)
        n = F.when(two, 2).otherwise(1)
        return F.when(
            F.size(w) >= 2,
            F.struct(
                F.array_join(F.slice(w, F.lit(1), n), " ").alias("product"),
                F.array_join(F.slice(w, n + 1, F.size(w)), " ").alias("variety")
            )
        )

    return once(F.filter(F.split(collapsed(c), " "), lambda x: x != ""), parts)
