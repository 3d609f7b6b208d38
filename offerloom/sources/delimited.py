"""Delimited files read in byte blocks: rows, numbers and quotes are right wherever a block is cut.

Spark's text reader cuts a file into blocks of lines. Whether a line lies inside a quoted cell depends on
all that precedes it, so each block is first read for both cases: it ends inside or outside quotes, after so
many rows. These outcomes compose, so a scan over a file's blocks (a few numbers each) gives each
block its true state and its first row number. The second reading emits whole rows where they lie; only rows that
cross blocks are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import delimiter, row_cells

SEPARATORS = (",", ";")
#: Rows of one Arrow batch that a task emits.
BATCH = 4096

_SUMMARY = "path string, block long, first string, states array<boolean>, rows array<long>"
_PIECES = "path string, row long, block long, text string, whole boolean, separator string"


class Quotes:
    """What a line does to the state "inside quotes", for one separator."""

    def __init__(self, separator: str):
        self.separator = separator
        self.opened = re.compile(r'"(?:[^"]|"")*"(?!")')
        self.inside = re.compile(r'(?:[^"]|"")*"(?!")')

    def after(self, line: str, inside: bool) -> bool:
        at = 0
        while True:
            if inside or line.startswith('"', at):
                found = (self.inside if inside else self.opened).match(line, at)
                if not found:
                    return True
                inside, at = False, found.end()
            at = line.find(self.separator, at) + 1
            if not at:
                return False

    def begins(self, lines: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
        """For each line whether a row begins there, and the state behind the last. Only lines with quotes are looked at."""
        marked = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
        before = np.zeros(len(lines), bool)
        at = 0
        for i in marked:
            before[at : i + 1] = inside
            inside, at = self.after(lines[i].as_py(), inside), i + 1
        before[at:] = inside
        return ~before, inside


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Runs of lines of one block, in order."""
    for batch in batches:
        paths, starts, lines = (batch.column(batch.schema.get_field_index(c)) for c in ("path", "block", "value"))
        at, n = starts.to_numpy(zero_copy_only=False), len(lines)
        names = paths.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (names[1:] != names[:-1])) + 1), n] if n else []
        for lo, hi in zip(cuts, cuts[1:]):
            yield (paths[int(lo)].as_py(), int(at[lo])), lines[int(lo) : int(hi)]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: its first line that isn't blank; for each separator and both states, how it ends and how many rows begin."""
    schema = pa.schema(
        [
            ("path", pa.string()), ("block", pa.int64()), ("first", pa.string()), ("states", pa.list_(pa.bool_())),
            ("rows", pa.list_(pa.int64()))
        ]
    )
    readers = [Quotes(s) for s in SEPARATORS]
    key, first, states, rows = None, None, [], []

    def done():
        return pa.RecordBatch.from_pylist([{"path": key[0], "block": key[1], "first": first, "states": states, "rows": rows}], schema)

    for k, lines in _blocks(batches):
        if k != key:
            if key:
                yield done()
            key, first, states, rows = k, None, [False, True] * len(readers), [0, 0] * len(readers)
        if first is None:
            said = pc.utf8_trim_whitespace(pc.replace_substring(lines, "﻿", ""))
            at = np.flatnonzero(pc.not_equal(said, "").to_numpy(zero_copy_only=False))
            first = lines[int(at[0])].as_py() if len(at) else None
        for i in range(len(states)):
            found, states[i] = readers[i // 2].begins(lines, states[i])
            rows[i] += int(found.sum())
    if key:
        yield done()


def plan(lines: DataFrame, separator: str | None = None) -> DataFrame:
    """(path, block, separator, inside, row, closed): the state and the row number with which each block begins, by a scan over
    the blocks of each file.

    lines: path, block, value. closed: whether the file ends outside quotes.
    """
    found = lines.mapInArrow(_summaries, _SUMMARY)
    chosen = F.lit(separator) if separator else delimiter(
        F.coalesce(F.try_element_at(F.filter(F.transform("blocks", lambda b: b["first"]), lambda x: x.isNotNull()), F.lit(1)), F.lit(""))
    )
    files = found.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("block", "first", "states", "rows"))).alias("blocks")
    ).withColumn("separator", chosen)
    offset = F.when(F.col("separator") == SEPARATORS[0], 0).otherwise(2)
    start = F.struct(
        F.lit(False).alias("inside"), F.lit(0).cast("long").alias("row"),
        F.array().cast("array<struct<inside:boolean,row:bigint>>").alias("seen")
    )

    def step(state, block):
        at = offset + F.when(state["inside"], 1).otherwise(0)
        return F.struct(
            F.get(block["states"], at).alias("inside"),
            (state["row"] + F.get(block["rows"], at)).alias("row"),
            F.concat(state["seen"], F.array(F.struct(state["inside"].alias("inside"), state["row"].alias("row")))).alias("seen"),
        )

    scanned = files.withColumn("end", F.aggregate("blocks", start, step))
    each = scanned.select(
        "path", "separator", (~F.col("end.inside")).alias("closed"),
        F.explode(F.arrays_zip(F.transform("blocks", lambda b: b["block"]).alias("block"), F.col("end.seen").alias("seen"))).alias("x")
    )
    return each.select(
        "path", F.col("x.block").alias("block"), "separator", F.col("x.seen.inside").alias("inside"),
        F.col("x.seen.row").alias("row"), "closed"
    )


def _rows(batches: Iterator[pa.RecordBatch], blocks: dict[tuple[str, int], tuple[str, bool, int]]) -> Iterator[pa.RecordBatch]:
    """Whole rows of each block; what belongs to a row that another block may share is a piece of it."""
    schema = pa.schema(
        [
            ("path", pa.string()), ("row", pa.int64()), ("block", pa.int64()), ("text", pa.string()),
            ("whole", pa.bool_()), ("separator", pa.string())
        ]
    )
    key, quotes, inside, row, held, first = None, None, False, 0, [], True

    def made(texts: list[str], numbers: list[int], whole: bool):
        for i in range(0, len(texts), BATCH):
            n = len(texts[i : i + BATCH])
            columns = [key[0]] * n, numbers[i : i + BATCH], [key[1]] * n, texts[i : i + BATCH], [whole] * n, [quotes.separator] * n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for k, lines in _blocks(batches):
        if k != key:
            if key:
                yield from made(["\n".join(held)], [row - 1], False)
            key, held, first = k, [], True
            separator, inside, row = blocks[k]
            quotes = Quotes(separator)
        begins, inside = quotes.begins(lines, inside)
        texts, numbers = [], []
        for line, new in zip(lines.to_pylist(), begins.tolist()):
            if new:
                if held and first:
                    yield from made(["\n".join(held)], [row - 1], False)
                elif held:
                    texts.append("\n".join(held))
                    numbers.append(row - 1)
                first = first and not held
                held, row = [line], row + 1
            else:
                held.append(line)
        yield from made(texts, numbers, True)
    if key:
        yield from made(["\n".join(held)], [row - 1], False)


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, block, value): lines as Spark's reader deals them out, in order within a block."""
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def read_csv(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """(path, sheet, row, cells) of delimited files, each with its own path, rows numbered from 0 in each file.

    The separator is each file's own (see files.delimiter) unless given: a comma or a semicolon. Cells are as in files.sheet_cells; a
    line end behind the last row makes no row. A file that ends inside quotes is an error. Empty files have no rows. The plan of the
    blocks (a few numbers for each: 800,000 blocks of 128 MB in 100 TB) goes to all tasks; lines are never shuffled, but for
    rows that cross blocks.
    """
    if separator not in (None, *SEPARATORS):
        raise ValueError(f"the separator must be one of {SEPARATORS}")
    lines = lines_of(spark, path)
    found = plan(lines, separator).collect()
    if open_files := sorted({r["path"] for r in found if not r["closed"]}):
        raise ValueError(f"{open_files[0]}: a quote isn't closed")
    blocks = spark.sparkContext.broadcast({(r["path"], r["block"]): (r["separator"], r["inside"], r["row"]) for r in found})
    pieces = lines.mapInArrow(lambda b: _rows(b, blocks.value), _PIECES)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    crossing = pieces.where("not whole").groupBy("path", "row", "separator").agg(F.array_join(in_order, "\n").alias("text"))
    rows = pieces.where("whole").select("path", "row", "separator", "text").unionByName(crossing)
    cells = F.when(F.col("separator") == ";", row_cells(F.col("text"), ";")).otherwise(row_cells(F.col("text"), ","))
    return rows.select("path", F.lit("CSV").alias("sheet"), F.col("row").cast("int").alias("row"), cells.alias("cells"))
