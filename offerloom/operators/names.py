"""Names against known names without pairing all with all: containment either way, and the most similar by edit distance."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Characters of all farms' keys up to which an automaton over them is sent to every task; beyond it names are cut into their
#: substrings instead.
AUTOMATON_CHARS = 16 << 20


class Automaton:
    """An Aho-Corasick automaton: of all words within a text, the one that was given first, in one pass over the text."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.least: list[int | None] = [None]
        for number, word in enumerate(words):
            state = 0
            for c in word:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.least.append(None)
                state = self.next[state][c]
            if self.least[state] is None:
                self.least[state] = number
        self.fail = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:  # by depth, so that what a state falls back to is known
            state = waiting.popleft()
            for c, child in self.next[state].items():
                self.fail[child] = self.step(self.fail[state], c) if state else 0
                found = [n for n in (self.least[child], self.least[self.fail[child]]) if n is not None]
                self.least[child] = min(found, default=None)
                waiting.append(child)

    def step(self, state: int, c: str) -> int:
        while c not in self.next[state]:
            if not state:
                return 0
            state = self.fail[state]
        return self.next[state][c]

    def first_within(self, text: str) -> int | None:
        state, best = 0, None
        for c in text:
            state = self.step(state, c)
            n = self.least[state]
            if n is not None and (best is None or n < best):
                best = n
        return best


def _substrings(c: Column) -> Column:
    """All distinct substrings."""
    n = F.length(c)
    return F.array_distinct(
        F.flatten(
            F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda size: F.substr(c, i, size)))
        )
    )


def match_farms(names: DataFrame, farms: DataFrame, *, name: str = "name", automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """names (with a key column name_id) with farm_id: the farm (farm_id, farm_name, position) of an equal key, else the first
    by position whose key holds the name's or is held by it.

    Distinct keys of names meet an index of the substrings of farms' keys by an equi-join (the name within a farm), and an
    automaton over farms' keys (a farm within the name). Farms with more than automaton_chars characters in their keys are met by the
    substrings of names instead, which is the same by another equi-join. Names without a key match nothing; of farms at one
    position the least id counts.
    """
    rank = lambda inexact: F.struct(F.lit(inexact).alias("inexact"), "position", "farm_id")
    f = farms.select("farm_id", "position", T.farm_key(F.col("farm_name")).alias("_fk")).where("_fk != ''")
    keys = names.select(T.farm_key(F.col(name)).alias("_nk")).where("_nk != ''").distinct()
    equal = f.groupBy(F.col("_fk").alias("_nk")).agg(F.min(rank(False)).alias("_equal"))
    holding = f.select(
        F.explode(_substrings(F.col("_fk"))).alias("_nk"),
        rank(True).alias("r")
    ).groupBy("_nk").agg(F.min("r").alias("_holding"))
    if (f.agg(F.sum(F.length("_fk"))).head()[0] or 0) <= automaton_chars:
        listed = f.orderBy("position", "farm_id").collect()  # within the bound
        automaton = farms.sparkSession.sparkContext.broadcast(Automaton([r["_fk"] for r in listed]))

        @F.pandas_udf("int")
        def first_within(text: pd.Series) -> pd.Series:
            return text.map(automaton.value.first_within).astype("Int32")

        numbers = farms.sparkSession.createDataFrame(
            [(i, r["position"], r["farm_id"]) for i, r in enumerate(listed)],
            f"_at int, position {f.schema['position'].dataType.simpleString()}, farm_id {f.schema['farm_id'].dataType.simpleString()}"
        )
        held = keys.withColumn("_at", first_within("_nk")).where("_at is not null").join(F.broadcast(numbers), "_at").select(
            "_nk",
            rank(True).alias("_held")
        )
    else:
        parts = keys.select("_nk", F.explode(_substrings(F.col("_nk"))).alias("_fk"))
        held = parts.join(f, "_fk").groupBy("_nk").agg(F.min(rank(True)).alias("_held"))
    best = keys.join(equal, "_nk", "left").join(holding, "_nk", "left").join(held, "_nk", "left").select(
        "_nk",
        F.coalesce("_equal", F.least("_holding", "_held"))["farm_id"].alias("farm_id")
    )
    return names.withColumn("_k", T.farm_key(F.col(name))).join(best, F.col("_k") == F.col("_nk"), "left").drop("_k", "_nk")


def _most_edits(longer: Column, least: float) -> Column:
    """Edits that two keys may differ by: d / longer <= 1 - least, as scores are rounded to six decimals."""
    return F.floor(longer * (1 - least + 5e-7)).cast("int")


def similar_pairs(names: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(_a, _b, score) of distinct keys of names (_a) and known names (_b) that are at least so similar.

    A known key of n characters may match keys of n' characters for few n'. Cut into one piece more than the edits allowed, one
    piece at least stands unchanged in the other key, shifted by no more than the edits. So pieces of known keys, for each n', meet the
    substrings of names of that length by an equi-join; the shift is checked, then how many characters the two have in
    common at all, and only then is a distance computed.
    """
    a = names.where("_a != ''").distinct().withColumn("_na", F.length("_a"))
    b = known.where("_b != ''").distinct().withColumn("_nb", F.length("_b"))
    lengths = F.sequence(
        F.greatest(F.ceil(F.col("_nb") * (least - 5e-7)).cast("int"), F.lit(1)),
        F.floor(F.col("_nb") / (least - 5e-7)).cast("int")
    )
    b = b.withColumn("_na", F.explode(lengths)).withColumn(
        "_d",
        _most_edits(F.greatest("_na", "_nb"), least)
    ).where(F.abs(F.col("_na") - F.col("_nb")) <= F.col("_d"))
    # piece j of d + 1 pieces of about equal length: characters from j * n / (d + 1) on
    cut = lambda j: F.floor(j * F.col("_nb") / (F.col("_d") + 1)).cast("int")
    piece = F.transform(
        F.sequence(F.lit(0), F.col("_d")),
        lambda j: F.struct((cut(j) + 1).alias("at"), F.substr("_b", cut(j) + 1, cut(j + 1) - cut(j)).alias("piece"))
    )
    pieces = b.select("_b", "_na", "_nb", "_d", F.explode(piece).alias("p")).select(
        "_b",
        "_na",
        "_nb",
        "_d",
        F.col("p.at").alias("_bt"),
        F.col("p.piece").alias("piece")
    )
    sizes = pieces.select("_na", F.length("piece").alias("size")).distinct()
    part = F.transform(
        F.sequence(F.lit(1), F.col("_na") - F.col("size") + 1),
        lambda i: F.struct(i.alias("at"), F.substr("_a", i, F.col("size")).alias("piece"))
    )
    parts = a.join(sizes, "_na").where("size <= _na").select("_a", "_na", F.explode(part).alias("p")).select(
        "_a",
        "_na",
        F.col("p.at").alias("_at"),
        F.col("p.piece").alias("piece")
    )
    near = (F.col("piece") == "") | (F.abs(F.col("_at") - F.col("_bt")) <= F.col("_d"))
    met = parts.join(pieces, ["_na", "piece"]).where(near).select("_a", "_b", "_d", "_na", "_nb").distinct()
    counts = lambda x: F.array(
        *(F.length(x) - F.length(F.translate(x, c, "")) for c in "abcdefghijklmnopqrstuvwxyz0123456789 ")
    )
    common = F.aggregate(F.zip_with(counts(F.col("_a")), counts(F.col("_b")), lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    fits = met.where(F.greatest("_na", "_nb") - common <= F.col("_d"))
    distance = F.levenshtein("_a", "_b")
    return fits.withColumn(
        "score",
        F.round(1.0 - distance / F.greatest("_na", "_nb"), 6)
    ).where(F.col("score") >= least).select("_a", "_b", "score")


def suggest_names(names: DataFrame, known: DataFrame, *, least: float = 0.55, top: int = 3) -> DataFrame:
    """(name_id, rank, known_id, score): of each name (name_id, name) the most similar known names (known_id, known_name), at
    least `least`, at most `top`; ties by known_id.

    Similarity is that of match keys; equal keys are 1.0, so that names without a key are like each other and like nothing else.
    Equal names are compared
    once, and of the ids of one known key only the first `top` can count.
    """
    a = names.select("name_id", T.match_key(F.col("name")).alias("_a"))
    b = known.select("known_id", T.match_key(F.col("known_name")).alias("_b"))
    by_id = Window.partitionBy("_b").orderBy("known_id")
    kept = b.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= top).drop("_n")
    blank = F.lit("").alias("_a"), F.lit("").alias("_b"), F.lit(1.0).alias("score")
    pairs = similar_pairs(a.select("_a"), b.select("_b"), least)
    pairs = pairs.unionByName(b.where("_b = ''").limit(1).select(*blank)) if least <= 1 else pairs
    order = Window.partitionBy("_a").orderBy(F.desc("score"), "known_id")
    best = pairs.join(kept, "_b").withColumn(
        "rank",
        F.row_number().over(order)
    ).where(F.col("rank") <= top).select("_a", "rank", "known_id", "score")
    return a.join(best, "_a").select("name_id", "rank", "known_id", "score")
