"""Prefix trie of conversations by partition refinement.

All conversations start in one class. In each round, the active ones go on by a block of turns, and every turn
splits the classes by what is said in it; a class is counted and named by aggregates that combine
before the shuffle, so a class of a third of all conversations is no large group. Conversations that are alone in their
class at the end of a block retire: the rest of their turns is a chain of single nodes, taken straight from
their rows. Blocks double, so that conversations which agree for n turns take about log2(n) rounds. At last the
trie is folded back: what a node adds is credited to its smallest member, summed from the end of each
conversation, and then by class.

A class goes by 128 bits of SHA-256 over its parent's and the turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_rows, stored
from .conv_order import in_order, mark

#: Turns of the first block; blocks double up to MOST_TURNS, which bounds what one task takes of a conversation in a round.
FIRST_TURNS, MOST_TURNS = 4, 4096
#: Characters of one piece of a list of members.
PIECE_CHARS = 1 << 20

ROOT = hashlib.sha256(b"").digest()[:16]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each row's number in its conversation, as far as this partition goes; at the end a row on its last conversation."""
    from pyspark import TaskContext

    part, first, conv, n, runs = TaskContext.get().partitionId(), None, None, 0, 0
    for batch in batches:
        for c, key, chars in zip(*(column(batch, x).to_pylist() for x in ("conv", "mark", "chars"))):
            if not runs or c != conv:
                conv, n, runs = c, 0, runs + 1
                first = c if runs == 1 else first
            n += 1
            yield c, part, n, key, chars, None
    if runs:
        yield conv, part, n, None, 0, first


def numbered(rows: DataFrame) -> DataFrame:
    """conv, at (from 1), mark, chars of rows in order. What conversations that cross partitions have before a partition is one
    number for each.
    """
    local = stored(
        map_rows(in_order(rows, "conv", "mark", "chars"), _numbered, "conv long, part int, at long, mark binary, chars long, first long"),
        "trie-rows"
    )
    ends = sorted(
        (r["part"], r["first"], r["conv"], r["at"]) for r in local.where("mark is null").select("part", "first", "conv", "at").collect()
    )
    before, open_conv, held = [(-1, None, 0)], None, 0
    for part, first, last, n in ends:  # one row a partition
        carried = held if first == open_conv else 0
        if carried:
            before.append((part, first, carried))
        open_conv, held = last, n + (carried if first == last else 0)
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, conv long, before long"))
    return local.where("mark is not null").join(offsets, ["part", "conv"], "left").select(
        "conv",
        (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"),
        "mark",
        "chars"
    )


def rebuilt(rows: DataFrame, *, group: int = 100, most: int = 6) -> DataFrame:
    """conv, depth, mark, chars, last: each conversation with the first h turns of its group's first one in place of its own first h.

    h = crc32(conv) % most; the group's first conversation is conv - conv % group. Depth 0 (no mark) stands for the
    conversation itself. last: the conversation ends here.
    """
    h = lambda c: (F.crc32(F.col(c).cast("string").cast("binary")) % most).cast("long")
    base = F.col("conv") - F.col("conv") % group
    heads = rows.where((F.col("conv") % group == 0) & (F.col("at") < most)).select(
        F.col("conv").alias("base"),
        F.col("at").alias("depth"),
        "mark",
        "chars"
    )
    sizes = rows.groupBy("conv").agg(F.count("*").alias("own"))
    known = heads.groupBy("base").agg(F.count("*").alias("known"))
    convs = sizes.withColumns({"base": base, "h": h("conv")}).join(known, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("known", F.lit(0))))
    convs = stored(
        convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")),
        "trie-convs"
    )
    none = convs.select(
        "conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("mark"),
        F.lit(0).cast("long").alias("chars"), "size"
    )
    borrowed = convs.join(heads, "base").where("depth <= h").select("conv", "depth", "mark", "chars", "size")
    own = rows.where(F.col("at") > h("conv")).join(convs, "conv").select(
        "conv",
        (F.col("at") - F.col("h") + F.col("taken")).alias("depth"),
        "mark",
        "chars",
        "size"
    )
    return none.unionAll(borrowed).unionAll(own).select("conv", "depth", "mark", "chars", (F.col("depth") == F.col("size")).alias("last"))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The class of each active conversation after each turn of the block. A row with a class opens its conversation; without
    one it has retired.
    """
    conv, key = None, None
    for batch in batches:
        for c, depth, said, chars, last, begin in zip(
            *(column(batch, x).to_pylist() for x in ("conv", "depth", "mark", "chars", "last", "class"))
        ):
            if begin is not None:
                conv, key = c, begin
            elif c == conv:
                parent, key = key, hashlib.sha256(key + said).digest()[:16] if depth else ROOT
                yield c, depth, key, parent if depth else None, chars, last


_CHAIN = "conv long, depth long, class binary, parent binary, chars long, last boolean"


def refine(rows: DataFrame, *, first_turns: int = FIRST_TURNS, most_turns: int = MOST_TURNS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, nodes, retired) of rows as rebuilt() returns them.

    paths: conv, depth, class, parent, chars, last of active conversations. nodes: one row a class. retired: conv, after (the
    depth after which it is alone and goes on).
    """
    active = rows.where("depth = 0").select("conv", F.lit(ROOT).alias("class"))
    low, turns, paths, nodes, retired = -1, first_turns, [], [], []
    while True:
        high = low + turns + (low < 0)
        openers = active.select(
            "conv", F.lit(low).cast("long").alias("depth"), F.lit(None).cast("binary").alias("mark"),
            F.lit(0).cast("long").alias("chars"), F.lit(False).alias("last"), "class"
        )
        block = rows.where(F.col("depth").between(low + 1, high)).withColumn("class", F.lit(None).cast("binary"))
        dealt = openers.unionByName(block).repartition("conv").sortWithinPartitions("conv", "depth")
        path = stored(map_rows(dealt, _split, _CHAIN), "trie-paths")
        ends = F.when(F.col("last"), F.col("conv"))
        found = path.groupBy("depth", "class").agg(
            F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"),
            F.first("chars").alias("chars"), F.count(ends).alias("n_ends"), F.min(ends).alias("end")
        )
        alone = (F.col("depth") == high) & (F.col("n_convs") == 1) & (F.col("n_ends") == 0)
        found = stored(found.withColumn("chain", alone), "trie-nodes")
        left = found.where("chain").select(F.col("conv_id").alias("conv"), F.col("depth").alias("after"))
        paths.append(path)
        nodes.append(found)
        retired.append(left)
        active = stored(
            path.where((F.col("depth") == high) & ~F.col("last")).join(left, "conv", "left_anti").select("conv", "class"),
            "trie-active"
        )
        if active.isEmpty():
            return tuple(reduce(DataFrame.unionAll, x) for x in (paths, nodes, retired))
        low, turns = high, min(turns * 2 if low >= 0 else first_turns * 2, most_turns)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Digests of the classes that lie within this partition; pieces of the first, the last and of long ones."""
    from pyspark import TaskContext

    part, group, held, size, piece, runs = TaskContext.get().partitionId(), None, [], 0, 0, 0
    for batch in batches:
        for depth, key, conv in zip(*(column(batch, x).to_pylist() for x in ("depth", "class", "conv"))):
            if runs and group != (depth, key):
                if runs == 1 or piece:
                    yield *group, part, piece, "".join(held), None
                else:
                    yield *group, None, None, None, hashlib.sha256("".join(held)[1:].encode()).hexdigest()
                held, size, piece = [], 0, 0
            if not runs or group != (depth, key):
                group, runs = (depth, key), runs + 1
            if size >= PIECE_CHARS:
                yield *group, part, piece, "".join(held), None
                held, size, piece = [], 0, piece + 1
            held.append(f",{conv}")
            size += len(held[-1])
    if runs:
        yield *group, part, piece, "".join(held), None


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    group, sha = None, None
    for batch in batches:
        for depth, key, text in zip(*(column(batch, x).to_pylist() for x in ("depth", "class", "text"))):
            if group == (depth, key):
                sha.update(text.encode())
                continue
            if group:
                yield *group, sha.hexdigest()
            group, sha = (depth, key), hashlib.sha256(text[1:].encode())
    if group:
        yield *group, sha.hexdigest()


def member_digests(members: DataFrame) -> DataFrame:
    """depth, class, ends_sha256 of (depth, class, conv): SHA-256 of the sorted conv ids, joined by commas. A class may cross partitions."""
    keys = ["depth", "class", "conv"]
    sorted_ids = members.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    found = stored(
        map_rows(sorted_ids, _members, "depth long, class binary, part int, piece int, text string, ends_sha256 string"),
        "trie-members"
    )
    pieces = found.where("part is not null").repartition("depth", "class").sortWithinPartitions("depth", "class", "part", "piece")
    return found.where("part is null").select("depth", "class", "ends_sha256").unionAll(
        map_rows(pieces, _hashed, "depth long, class binary, ends_sha256 string")
    )


def fold(rows: DataFrame, paths: DataFrame, nodes: DataFrame, retired: DataFrame) -> DataFrame:
    """The trie's nodes with what their subtrees hold."""
    adds = nodes.select(
        F.col("conv_id").alias("conv"), "depth",
        ((F.col("n_ends") == F.col("n_convs")) | F.col("chain")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    )
    below = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    credited = paths.select("conv", "depth", "class").join(adds, ["conv", "depth"], "left")
    credited = credited.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(below) for c in ("leaves", "saved")})
    sums = credited.groupBy("depth", "class").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    children = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"),
        F.col("parent").alias("class")
    ).agg(F.count("*").alias("children"))
    ends = member_digests(paths.where("last"))
    sha = lambda x: F.sha2(x.cast("string").cast("binary"), 256)
    whole = nodes.join(sums, ["depth", "class"]).join(children, ["depth", "class"], "left").join(ends, ["depth", "class"], "left")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("class").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    shared = whole.join(above, ["depth", "parent"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        (F.coalesce("children", F.lit(0)) + F.col("chain").cast("long")).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", sha(F.lit(""))).alias("ends_sha256")
    )
    one = F.lit(1).cast("long")
    chains = rows.join(retired, "conv").where("depth > after").select(
        F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), sha(
            F.when(F.col("last"), F.col("conv").cast("string")).otherwise("")
        ).alias("ends_sha256")
    )
    return shared.unionAll(chains)


def prefix_trie(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", group: int = 100, most: int = 6, first_turns: int = FIRST_TURNS,
    most_turns: int = MOST_TURNS
) -> DataFrame:
    """One row for each distinct sequence of first turns (role, text) of the rebuilt conversations (see rebuilt).

    conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (over the subtree:
    members beyond the first, times code points of the node's text), ends_sha256 (of the ids that end here, ascending, joined by commas).

    Null roles and texts are empty. Null turns stand first; rows of one turn by role, then text (see in_order), repeated rows
    are repeated turns. Rows without a conversation belong to none and are left out. Texts may be of any length: they
    are hashed where they are read and never shuffled. An empty table has no conversations, so no root. Other columns are not used.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    held = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
        text.alias("text")
    )
    held = held.withColumns({"mark": mark(F.col("role"), F.col("text")), "chars": F.char_length("text").cast("long")})
    turns = stored(rebuilt(numbered(held), group=group, most=most), "trie-turns")
    return fold(turns, *refine(turns, first_turns=first_turns, most_turns=most_turns))


def op13_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


#: The same in DuckDB: every prefix as a list of turns.
OP13_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab
), own AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), coded AS (
  SELECT own.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''),
    lambda x: CAST(ascii(x) AS BIGINT))),
           lambda z, b: xor(z >> 8, tab[(xor(z, b) & 255) + 1]))) % 6 AS h
  FROM own, crc_table
), rebuilt AS (
  SELECT x.c, list_concat(coalesce(b.turns, [])[1:x.h], x.turns[x.h + 1:]) AS turns
  FROM coded x LEFT JOIN own b ON b.c = x.c - x.c % 100
), prefix AS (
  SELECT c, d, turns[1:d] AS path, len(turns) = d AS final FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, coalesce(length(any_value(path[d].t)), 0) AS chars,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (final), '')) AS ends_sha256
  FROM prefix GROUP BY d, path
), child AS (
  SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL
), up AS (
  SELECT n.d AS own_d, n.n_convs, n.chars, c.n_children IS NULL AS leaf, k AS d, n.path[1:k] AS path
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM node) n LEFT JOIN child c ON c.d = n.d AND c.path = n.path
), sums AS (
  SELECT d, path, count(*) FILTER (leaf) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM up GROUP BY d, path
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens,
  n.ends_sha256
FROM node n JOIN sums s ON s.d = n.d AND s.path = n.path
LEFT JOIN child c ON c.d = n.d AND c.path = n.path
LEFT JOIN node p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""
