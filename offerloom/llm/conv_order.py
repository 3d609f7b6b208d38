"""Rows of conversations in one total order that also splits a single conversation over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_batches


def mark(role: Column, text: Column) -> Column:
    """SHA-256 of a role and a text, as bytes: equal for equal pairs only."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """columns of rows (conv, turn, role, text, mark, ...) by conv and turn (nulls first), sorted within range partitions.

    Rows of one turn follow by role, then text; where the first 16 characters of role and 64 of text agree, by mark.
    These short keys are what Spark samples for the ranges. Equal rows are told apart by their place in
    the input, so that no conversation, turn or repeated row has to fit one task.
    """
    keys = ["_conv", "_turn", "_role", "_text", "_mark", "_place"]
    ordered = {
        "_conv": F.col("conv"), "_turn": F.col("turn"), "_role": F.left("role", F.lit(16)),
        "_text": F.left("text", F.lit(64)), "_mark": F.col("mark"), "_place": F.monotonically_increasing_id()
    }
    keyed = rows.withColumns(ordered).select(*columns, *keys)
    return short_batches(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*columns))
