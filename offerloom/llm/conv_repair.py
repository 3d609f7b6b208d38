r"""Conversation structure repair: the cheapest edits that make role initials read `(s?(ua)+)?`.

A machine of four states (start, s, u, a) reads the roles. Each turn is a 4x4 matrix over elements
(cost, audit): from which state to which, at what cost, by which edits; inserted turns are closed over
on both sides of it. Elements are added by the least (cost, audit) and multiplied by adding costs and
joining audits. Two audits of equal cost never begin one another (what is left over would be
inserts, which cost something), so the product keeps the order and is associative: a conversation is
the product of its turns in any bracketing.

Conversations that lie within one range partition are multiplied there. Of those that cross partitions,
or are longer than a piece, each piece becomes one matrix; pieces are multiplied up a tree,
the states at the borders of pieces come down the same tree, and each piece then edits its own rows.

Edits: K keep, R rerole to user or assistant, D delete (the only edit of blank and duplicate turns), I insert an empty turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, column, in_batches, map_rows, short_batches, stored
from .conv_order import in_order, mark

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows and bytes of one piece of a conversation that is not settled within a partition.
PIECE_ROWS, PIECE_BYTES = 20_000, 4 << 20
#: Nodes that one node of the tree takes.
FAN = 64

SPACE = " \t\n\v\f\r"
Matrix = tuple  # of 16 elements (cost, audit) or None, row by row


def _matrix(edges: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(edges.get((i, j)) for i in range(4) for j in range(4))


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product: least cost, then the audit that is least in ASCII."""
    out = []
    for i in range(0, 16, 4):
        row = [(m, x[i + m]) for m in range(4) if x[i + m] is not None]
        for j in range(4):
            found = [(a[0] + b[0], a[1] + b[1]) for m, a in row if (b := y[4 * m + j]) is not None]
            out.append(min(found, default=None))
    return tuple(out)


#: No turn but any inserts. More than two never help: they lead back to the same state.
_CLOSURE = _matrix(
    {(i, i): (0, "") for i in range(4)}
    | {(START, USER): (INSERT, "I"), (SYSTEM, USER): (INSERT, "I"), (ASSISTANT, USER): (INSERT, "I"), (USER, ASSISTANT): (INSERT, "I")}
    | {(START, ASSISTANT): (2 * INSERT, "II"), (SYSTEM, ASSISTANT): (2 * INSERT, "II")}
)
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}


@lru_cache(64)
def turn_matrix(kind: str) -> Matrix:
    """Of one turn. kind: its role's initial (s, u, a or x for others), in upper case if its text is truncated; D if it must go."""
    edges = {(i, i): (DELETE, "D") for i in range(4)}
    if kind != "D":
        more = TRUNCATED if kind.isupper() else 0
        edges |= {(i, j): (REROLE + more, "R") for i, j in _NEXT.items()}
        kept = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
        edges |= {step: (KEEP + more, "K") for step in kept.get(kind.lower(), ())}
    return times(times(_CLOSURE, _matrix(edges)), _CLOSURE)


@lru_cache(100_000)
def _block(kinds: str) -> Matrix:
    if len(kinds) < 2:
        return turn_matrix(kinds) if kinds else _CLOSURE
    half = len(kinds) // 2
    return times(_block(kinds[:half]), _block(kinds[half:]))


def product(kinds: str) -> Matrix:
    """The matrix of a run of turns, as a balanced tree over blocks of eight."""
    level = [_block(kinds[i : i + 8]) for i in range(0, len(kinds), 8)] or [_CLOSURE]
    return reduced(level)


def reduced(level: list[Matrix]) -> Matrix:
    while len(level) > 1:
        level = [times(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def best(total: Matrix) -> tuple[int, int, str]:
    """(last state, cost, audit) of the cheapest way from the start to a valid end."""
    cost, audit, state = min((*total[j], j) for j in (START, ASSISTANT) if total[j] is not None)
    return state, cost, audit


def edited(audit: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The repaired turns: (role, text)."""
    at = 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            yield ("user" if state == USER else "assistant"), ""
            continue
        role, text = roles[at], texts[at]
        at += 1
        if edit == "R":
            state = _NEXT[state]
            yield ("user" if state == USER else "assistant"), text
        elif edit == "K":
            state = SYSTEM if role.startswith("s") else _NEXT[state]
            yield role, text


class Facts:
    """What is counted of a run of turns; facts of neighbouring runs add up."""

    FIELDS = ("n", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role", "low", "high", "turns")

    def __init__(self, values=(0, 0, 0, 0, 0, None, None, None, None, 0)):
        self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.first_role, self.last_role, self.low, self.high, self.turns = values

    def values(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    def add(self, other: Facts) -> None:
        """Takes in the run that follows this one."""
        if not other.n:
            return
        if not self.n:
            self.__init__(other.values())
            return
        self.illegal += other.illegal + (self.last_role + other.first_role not in LEGAL)
        self.last_role = other.last_role
        self.n, self.blank = self.n + other.n, self.blank + other.blank
        self.duplicate, self.truncated = self.duplicate + other.duplicate, self.truncated + other.truncated
        if other.low is not None:
            self.turns += other.turns - (self.high == other.low)
            self.low = other.low if self.low is None else self.low
            self.high = other.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


LEGAL = ("su", "ua", "au")


def judged(turns: list, roles: list[str], texts: list[str], marks: list[bytes], seen: set[bytes]) -> tuple[str, Facts]:
    """(kinds, facts) of a run of turns. seen: marks of earlier turns; those of this run are added."""
    facts, kinds = Facts(), []
    for turn, role, text, key in zip(turns, roles, texts, marks):
        said = text.rstrip(SPACE)
        initial = role[:1]
        kind = initial if initial in ("s", "u", "a") else "x"
        blank = not said
        duplicate = not blank and key in seen
        truncated = not blank and not duplicate and said[-1] not in ".!?"
        seen.add(key)
        facts.add(Facts((1, int(blank), int(duplicate), int(truncated), 0, initial, initial, turn, turn, int(turn is not None))))
        kinds.append("D" if blank or duplicate else kind.upper() if truncated else kind)
    return "".join(kinds), facts


def digest(turns: Iterator[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()


_FACTS = "n long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, low long, high long, turns long"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "part int, piece int, at array<long>, roles array<string>, texts array<string>, marks array<binary>"
_ELEMENTS = "elements array<struct<cost:long,audit:string>>"


def _elements(matrix: Matrix) -> list:
    return [None if e is None else {"cost": e[0], "audit": e[1]} for e in matrix]


def _from_elements(found: list) -> Matrix:
    return tuple(None if e is None else (e["cost"], e["audit"]) for e in found)


def _result(facts: Facts, cost: int, audit: str, sha: str) -> tuple:
    return facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, sha


def _settle(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[tuple]:
    """Whole conversations inside this partition as results; pieces of the first, the last and of long ones."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: tuple[list, ...] = ([], [], [], [])
    size = piece = runs = 0
    begun, conv = False, None

    def cut():
        nonlocal held, size, piece
        row = (conv, part, piece, *held, *[None] * 8)
        held, size, piece = ([], [], [], []), 0, piece + 1
        return row

    for batch in batches:
        for c, turn, role, text, key, dropped in zip(
            *(column(batch, x).to_pylist() for x in ("conv", "turn", "role", "text", "mark", "dropped"))
        ):
            if begun and c != conv:
                if runs == 1 or piece:
                    yield cut()
                else:
                    kinds, facts = judged(*held, set())
                    _, cost, audit = best(product(kinds))
                    yield conv, None, None, None, None, None, None, *_result(
                        facts,
                        cost,
                        audit,
                        digest(edited(audit, START, held[1], held[2]))
                    )
                held, size, piece = ([], [], [], []), 0, 0
            if not begun or c != conv:
                begun, conv, runs = True, c, runs + 1
            if dropped:
                continue
            if len(held[0]) >= piece_rows or size and size + len(text) > PIECE_BYTES:
                yield cut()
            for values, value in zip(held, (turn, role, text, key)):
                values.append(value)
            size += len(text) + len(role)
    if begun:
        yield cut()


def _judge_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for conv, part, piece, at, roles, texts, marks, earlier in zip(
            *(column(batch, x).to_pylist() for x in ("conv", "part", "piece", "at", "roles", "texts", "marks", "earlier"))
        ):
            kinds, facts = judged(at, roles, texts, marks, set(earlier or ()))
            yield conv, part, piece, _elements(product(kinds)), *facts.values()


def _node(table: pa.Table) -> pa.Table:
    """One node of the tree: the product of its children."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["piece"]))
    facts = Facts()
    for r in rows:
        facts.add(Facts(tuple(r[f] for f in Facts.FIELDS)))
    total = reduced([_from_elements(r["elements"]) for r in rows])
    row = {
        "conv": rows[0]["conv"],
        "part": rows[0]["above"],
        "piece": 0,
        "elements": _elements(total)
    } | dict(zip(Facts.FIELDS, facts.values()))
    return pa.Table.from_pylist([row], schema=table.drop_columns("above").schema)


def _states(table: pa.Table) -> pa.Table:
    """The states before and behind each child of a node whose own are known."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["piece"]))
    ways = {rows[0]["enter"]: (0, "", ())}  # state -> cost, audit, the states so far
    for r in rows:
        matrix, nexts = _from_elements(r["elements"]), {}
        for i, (cost, audit, path) in ways.items():
            for j in range(4):
                if (e := matrix[4 * i + j]) is not None:
                    way = (cost + e[0], audit + e[1], (*path, j))
                    nexts[j] = min(nexts.get(j, way), way)
        ways = nexts
    path = (rows[0]["enter"], *ways[rows[0]["leave"]][2])
    keys = ("conv", "part", "piece")
    out = [{k: r[k] for k in keys} | {"enter": path[i], "leave": path[i + 1]} for i, r in enumerate(rows)]
    return pa.Table.from_pylist(out, schema=table.select([*keys, "enter", "leave"]).schema)


def _edit_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for conv, part, piece, roles, texts, element, state in zip(
            *(column(batch, x).to_pylist() for x in ("conv", "part", "piece", "roles", "texts", "element", "enter"))
        ):
            yield conv, part, piece, "".join(f"\n{role}:{text}" for role, text in edited(element["audit"], state, roles, texts))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """SHA-256 of each conversation's repaired pieces, streamed in order."""
    begun, conv, sha, empty = False, None, hashlib.sha256(), True
    for batch in batches:
        for c, text in zip(column(batch, "conv").to_pylist(), column(batch, "text").to_pylist()):
            if begun and c != conv:
                yield conv, sha.hexdigest()
            if not begun or c != conv:
                begun, conv, sha, empty = True, c, hashlib.sha256(), True
            sha.update((text[1:] if empty else text).encode())
            empty &= not text
    if begun:
        yield conv, sha.hexdigest()


def _same(a: DataFrame, b: DataFrame, *keys: str) -> tuple[DataFrame, Column]:
    """b with other key names, and the condition that joins a to it; null keys are equal."""
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & a[k].eqNullSafe(other[f"_{k}"])
    return other, condition


def _joined(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    other, condition = _same(a, b, *keys)
    return a.join(other, condition, how).drop(*(f"_{k}" for k in keys))


def _long_conversations(pieces: DataFrame, kind: str, fan: int) -> DataFrame:
    """Results of the conversations that lie in pieces."""
    marks = pieces.select("conv", "part", "piece", F.explode(F.array_distinct("marks")).alias("mark"))
    first = marks.groupBy("conv", "mark").agg(
        F.min(F.struct("part", "piece")).alias("first"),
        F.count("*").alias("places")
    ).where("places > 1").drop("places")
    earlier = _joined(marks, first, "conv", "mark").where(F.struct("part", "piece") > F.col("first"))
    earlier = earlier.groupBy("conv", "part", "piece").agg(F.collect_list("mark").alias("earlier"))
    node = f"conv {kind}, part int, piece int, {_ELEMENTS}, {_FACTS}"
    level = stored(map_rows(_joined(pieces, earlier, "conv", "part", "piece", how="left"), _judge_piece, node), "repair-tree")
    levels, widest = [level], int(level.agg(F.max("part")).head()[0] or 0)
    while True:
        grouped = level.withColumn("above", F.col("part") if len(levels) == 1 else F.expr(f"int(part div {fan})"))
        level = stored(grouped.groupBy("conv", "above").applyInArrow(_node, node), "repair-tree")
        levels.append(level)
        if len(levels) > 2:
            widest //= fan
        if not widest:
            break
    ends = F.filter(
        F.array(
            *(
                F.when(
                    F.col("elements")[j].isNotNull(),
                    F.struct(
                        F.col("elements")[j]["cost"].alias("cost"), F.col("elements")[j]["audit"].alias("audit"),
                        F.lit(j).alias("leave")
                    )
                ) for j in (START, ASSISTANT)
            )
        ),
        lambda e: e.isNotNull()
    )
    roots = level.withColumn("best", F.array_min(ends))
    states = roots.select("conv", "part", "piece", F.lit(START).alias("enter"), F.col("best.leave").alias("leave"))
    for depth in range(len(levels) - 1, 0, -1):
        children = levels[depth - 1].select("conv", "part", "piece", "elements").withColumn(
            "above",
            F.col("part") if depth == 1 else F.expr(f"int(part div {fan})")
        )
        above = states.select("conv", F.col("part").alias("above"), "enter", "leave")
        states = stored(
            _joined(children, above, "conv", "above").groupBy("conv", "above").applyInArrow(
                _states,
                f"conv {kind}, part int, piece int, enter int, leave int"
            ),
            "repair-states"
        )
    chosen = _joined(levels[0].select("conv", "part", "piece", "elements"), states, "conv", "part", "piece")
    chosen = chosen.select(
        "conv", "part", "piece", "enter",
        F.element_at("elements", F.col("enter") * 4 + F.col("leave") + 1).alias("element")
    )
    texts = map_rows(
        _joined(pieces.select("conv", "part", "piece", "roles", "texts"), chosen, "conv", "part", "piece"), _edit_piece,
        f"conv {kind}, part int, piece int, text string"
    )
    hashes = map_rows(
        texts.repartition("conv").sortWithinPartitions("conv", "part", "piece").select("conv", "text"), _hashed,
        f"conv {kind}, repaired_sha256 string"
    )
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    facts = roots.select(
        "conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"),
        F.col("best.audit").alias("audit")
    )
    return _joined(facts, hashes, "conv")


def repair_conversations(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", dropped_col: str | None = None, piece_rows: int = PIECE_ROWS, fan: int = FAN
) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: turn numbers missing between the least and the largest. blank, duplicate, truncated: turns by their first fault.
    illegal: neighbours whose role initials are not su, ua or au. cost, audit: the cheapest repair, of several the one that is
    least in ASCII. repaired_sha256: of the repaired `role:text`, joined by newlines.

    Null roles and texts are one space. Null turns stand first and make no gap. Rows of the same turn by role, then text (see
    in_order); equal rows are duplicates of the first. A null conversation is one of its own. An empty role has no initial, so it
    is never kept. Texts may be of any length; one piece holds one text at least. dropped_col: a boolean column; rows where it is true are
    no turns, but their conversation is returned. piece_rows: of a conversation that is not settled within a partition; fan:
    children of a node of the tree. A conversation without turns has zeros, an empty audit and the
    digest of an empty text. An empty table gives an empty table. Other columns are not used.
    """
    space = F.lit(" ")
    role, text = F.coalesce(F.col(role_col).cast("string"), space), F.coalesce(F.col(text_col).cast("string"), space)
    dropped = F.coalesce(F.col(dropped_col), F.lit(False)) if dropped_col else F.lit(False)
    held = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.when(dropped, "").otherwise(role).alias("role"), F.when(dropped, "").otherwise(text).alias("text"),
        dropped.alias("dropped")
    )
    kind = held.schema["conv"].dataType.simpleString()
    source = in_order(held.withColumn("mark", mark(F.col("role"), F.col("text"))), "conv", "turn", "role", "text", "mark", "dropped")
    found = stored(map_rows(source, lambda b: _settle(b, piece_rows), f"conv {kind}, {_PIECE}, {_RESULT}"), "repair")
    whole = found.where("part is null").drop("part", "piece", "at", "roles", "texts", "marks")
    pieces = short_batches(found.where("part is not null").select("conv", "part", "piece", "at", "roles", "texts", "marks"), 8)
    return whole.unionByName(_long_conversations(pieces, kind, fan)).withColumnRenamed("conv", "conv_id")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations damaged by crc32(`conv_id:turn`) % 20; rows to drop are flagged in `dropped`."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    out = rows.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"),
        (code == 0).alias("dropped"), F.when(code == 3, 2).otherwise(1).alias("times")
    )
    return out.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times")


def op11_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_conversations(damaged(rows), dropped_col="dropped")


#: The same in DuckDB: the table of CRC-32 by its rule, then a fold over the turns with the best way to each of the four states.
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab
), source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), coded AS (
  SELECT source.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''),
    lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS code
  FROM source, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE code <> 0
), numbered AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         lag(role) OVER w AS before, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said
  FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), judged AS (
  SELECT *, said = '' AS blank, said <> '' AND nth > 1 AS duplicate,
         said <> '' AND nth = 1 AND right(said, 1) NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS initial
  FROM numbered
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (before IS NOT NULL AND left(before, 1) || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), fold AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0, 'a': '', 't': ''} AS v0, {'c': 1000000000, 'a': '', 't': ''} AS v1,
         {'c': 3, 'a': 'I', 't': chr(10) || 'user:'} AS v2, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS v3
  FROM facts
  UNION ALL
  SELECT conv_id, i, w0, w1,
         list_min([w2, {'c': w0.c + 3, 'a': w0.a || 'I', 't': w0.t || u}, {'c': w1.c + 3, 'a': w1.a || 'I', 't': w1.t || u},
           {'c': w3.c + 3, 'a': w3.a || 'I', 't': w3.t || u}]),
         list_min([w3, {'c': w2.c + 3, 'a': w2.a || 'I', 't': w2.t || a}, {'c': w0.c + 6, 'a': w0.a || 'II', 't': w0.t || u || a},
           {'c': w1.c + 6, 'a': w1.a || 'II', 't': w1.t || u || a}])
  FROM (
    SELECT conv_id, i, chr(10) || 'user:' AS u, chr(10) || 'assistant:' AS a, {'c': v0.c + 4, 'a': v0.a || 'D', 't': v0.t} AS w0,
           list_min([{'c': v1.c + 4, 'a': v1.a || 'D', 't': v1.t}, {'c': v0.c + s, 'a': v0.a || 'K', 't': v0.t || own}]) AS w1,
           list_min([{'c': v2.c + 4, 'a': v2.a || 'D', 't': v2.t},
             {'c': v0.c + ru, 'a': v0.a || 'R', 't': v0.t || chr(10) || 'user:' || text},
                     {'c': v1.c + ru, 'a': v1.a || 'R', 't': v1.t || chr(10) || 'user:' || text},
                       {'c': v3.c + ru, 'a': v3.a || 'R', 't': v3.t || chr(10) || 'user:' || text},
                     {'c': v0.c + ku, 'a': v0.a || 'K', 't': v0.t || own}, {'c': v1.c + ku, 'a': v1.a || 'K', 't': v1.t || own},
                       {'c': v3.c + ku, 'a': v3.a || 'K', 't': v3.t || own}]) AS w2,
           list_min([{'c': v3.c + 4, 'a': v3.a || 'D', 't': v3.t},
             {'c': v2.c + ru, 'a': v2.a || 'R', 't': v2.t || chr(10) || 'assistant:' || text},
                     {'c': v2.c + ka, 'a': v2.a || 'K', 't': v2.t || own}]) AS w3
    FROM (
      SELECT f.conv_id, r.i, f.v0, f.v1, f.v2, f.v3, r.text, chr(10) || r.role || ':' || r.text AS own,
             CASE WHEN blank OR duplicate THEN 1000000000 WHEN truncated THEN 6 ELSE 3 END AS ru,
             CASE WHEN blank OR duplicate OR initial <> 's' THEN 1000000000 WHEN truncated THEN 3 ELSE 0 END AS s,
             CASE WHEN blank OR duplicate OR initial <> 'u' THEN 1000000000 WHEN truncated THEN 3 ELSE 0 END AS ku,
             CASE WHEN blank OR duplicate OR initial <> 'a' THEN 1000000000 WHEN truncated THEN 3 ELSE 0 END AS ka
      FROM fold f JOIN judged r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1
    )
  )
), done AS (
  SELECT f.conv_id, facts.* EXCLUDE (conv_id), list_min([f.v0, f.v3]) AS best
  FROM fold f JOIN facts ON f.conv_id IS NOT DISTINCT FROM facts.conv_id AND f.i = facts.n
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit,
         sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN done ON c.conv_id IS NOT DISTINCT FROM done.conv_id
"""
