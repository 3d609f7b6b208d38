"""Substring search by an index of trigrams and their positions, which answers without reading the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import kept
from .relational import search


@dataclass
class TextIndex:
    """postings: (trigram, no, at) of each distinct text, sorted by trigram on disk, so that a search reads the parts of its trigrams
    only; entries: (no, field, id), where a text stands.
    """

    postings: DataFrame
    entries: DataFrame
    id_col: str
    columns: tuple[str, ...]

    def ids(self, text: str, columns: tuple[str, ...] | None = None) -> DataFrame:
        """The ids of rows that hold a text of three characters and more in one of the columns, in any case.

        Trigrams at every third place of the text and at its end cover all its characters. A field holds the text where all of
        them stand at one start, so hits need no check against the rows.
        """
        lowered = self.postings.sparkSession.range(1).select(F.lower(F.lit(text))).head()[0]
        if len(lowered) < 3:
            raise ValueError("an index of trigrams knows nothing of shorter texts")
        places = sorted({*range(0, len(lowered) - 2, 3), len(lowered) - 3})
        trigrams = {lowered[i : i + 3] for i in places}
        hit = self.postings.where(F.col("trigram").isin(*sorted(trigrams)))
        wanted = F.array(*(F.struct(F.lit(lowered[i : i + 3]).alias("t"), F.lit(i).alias("i")) for i in places))
        starts = hit.select("no", "at", F.explode(F.filter(wanted, lambda x: x["t"] == F.col("trigram"))).alias("x"))
        found = starts.groupBy("no", (F.col("at") - F.col("x.i")).alias("start")).agg(F.count("*").alias("n"))
        entries = self.entries
        if columns is not None:
            entries = entries.where(F.col("field").isin(*[self.columns.index(c) for c in columns]))
        stands = entries.join(found.where(F.col("n") == len(places)).select("no").distinct(), "no", "left_semi")
        return stands.select(F.col("id").alias(self.id_col)).distinct()

    def search(self, rows: DataFrame, text: str | None, columns: tuple[str, ...] | None = None) -> DataFrame:
        """rows that hold the text. No text is no filter; of one or two characters the rows themselves are searched."""
        text = (text or "").strip()
        if len(text) < 3:
            return search(rows, q=text, q_columns=columns or self.columns)
        return rows.join(self.ids(text, columns), self.id_col, "left_semi")


def build(rows: DataFrame, id_col: str, columns: tuple[str, ...]) -> TextIndex:
    """Indexes text columns of rows with unique ids. Null fields hold nothing. A frequent trigram's postings may lie in many
    files: numbers of texts keep them apart.
    """
    lowered = F.array(*(F.lower(F.col(c).cast("string")) for c in columns))
    each = rows.select(F.col(id_col).alias("id"), F.posexplode(lowered).alias("field", "text")).where(F.length("text") >= 3)
    # values that many rows share are cut once
    texts = kept(each.select("text").distinct().withColumn("no", F.monotonically_increasing_id()), "trigrams-texts")
    entries = kept(each.join(texts, "text").select("no", "field", "id"), "trigrams-entries")
    parts = F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substr(F.col("text"), i, F.lit(3)))
    postings = texts.select("no", F.posexplode(parts).alias("at", "trigram")).select("trigram", "no", "at")
    postings = kept(postings.repartitionByRange("trigram", "no").sortWithinPartitions("trigram", "no", "at"), "trigrams")
    return TextIndex(postings, entries, id_col, tuple(columns))
