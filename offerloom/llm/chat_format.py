r"""Chat formatting: a declarative template and a finite-state machine over roles.

Rows are dealt by conversation and sorted by turn; one pass over the sorted rows emits text segments,
each with its loss flag. Nothing of a conversation is held but the machine's state, so a
conversation may be of any length.

The template gives each role a marker, and every turn ends with one. Control strings inside texts are
escaped with a backslash, and backslashes are doubled, so a formatted conversation reads back to exactly
its turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_rows

START = "start"


@dataclass(frozen=True)
class Template:
    """headers: of known roles. other: of any other role, with the escaped role in place of {role}. end: behind each text.

    loss_roles: whose texts count for the loss. after: the machine, state -> roles that may follow; a
    state is the last role, or "start". final: states that a valid conversation may end in.
    """

    headers: dict[str, str] = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "}
    )
    other: str = "### Role {role}: "
    end: str = "</turn>\n"
    control: tuple[str, ...] = ("### ", "</turn>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    after: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            START: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant", "tool"}),
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, ("\\", *self.control))), lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(" + "|".join(map(re.escape, ("\\", *self.control))) + ")", lambda m: m[1], text)

    def header(self, role: str) -> str:
        # a colon in a role that has no header of its own must not end the marker early
        return self.headers.get(role) or self.other.format(role=self.escape(role).replace(":", "\\:"))

    def role(self, header: str) -> str:
        for role, marker in self.headers.items():
            if marker == header:
                return role
        head, tail = self.other.split("{role}")
        return self.unescape(header[len(head) : len(header) - len(tail)].replace("\\:", ":"))


SEGMENTS = "conv {kind}, segment long, turn long, kind string, text string, loss boolean, problem string"


def _segments(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[tuple]:
    begun, conv, state, n, turns = False, None, START, 0, 0

    def closing():
        if template.final and state not in template.final:
            return f"ends after {state}"
        return None

    for batch in batches:
        for c, turn, role, text in zip(*(column(batch, x).to_pylist() for x in ("conv", "turn", "role", "text"))):
            if begun and c != conv:
                yield conv, n, None, "close", "", False, closing()
            if not begun or c != conv:
                begun, conv, state, n, turns = True, c, START, 0, 0
            role, text = role or "", text or ""
            problem = None if role in template.after.get(state, ()) else f"{role or 'no role'} after {state}"
            yield conv, n, turn, "header", template.header(role), False, problem
            yield conv, n + 1, turn, "text", template.escape(text), role in template.loss_roles, None
            yield conv, n + 2, turn, "end", template.end, False, None
            n, state = n + 3, role
    if begun:
        yield conv, n, None, "close", "", False, closing()


def format_conversations(
    rows: DataFrame, *, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Segments of every conversation, in order within a partition: conv, segment, turn, kind (header, text, end, close), text,
    loss, problem.

    The formatted conversation is its segments' texts one after the other. problem: what the machine refuses about
    this turn (at its header) or about the end (at "close"); such conversations are formatted all the same,
    and a caller may drop them. Null texts and roles are empty ones. Rows with a null conversation are one conversation.
    Turns are sorted, null first; rows with the same turn by role, then text, so repeated rows are repeated turns.
    An empty table gives no segments. Other columns are not used.
    """
    template = template or Template()
    source = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"),
        F.col(text_col).alias("text")
    )
    source = source.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kind = source.schema["conv"].dataType.simpleString()
    return map_rows(source, lambda b: _segments(b, template), SEGMENTS.format(kind=kind))


class _Reader:
    """Turns read back from the formatted text and the loss mask of one conversation, piece by piece."""

    def __init__(self, template: Template):
        self.template = template
        controls = "|".join(map(re.escape, template.control))
        # a backslash with what it guards; a marker; the end of a turn
        head, tail = map(re.escape, template.other.split("{role}"))
        other = head + r"(?:\\.|[^\\:])*?" + tail
        known = "|".join(sorted(map(re.escape, template.headers.values()), key=len, reverse=True))
        self.token = re.compile(rf"(?P<guarded>\\(?:\\|:|{controls}))|(?P<header>{known}|{other})|(?P<end>{re.escape(template.end)})", re.S)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.held, self.marks = "", []
        self.role: str | None = None

    def feed(self, text: str, loss: bool) -> None:
        self.held += text
        self.marks.append((len(self.held), loss))
        self.formatted_chars += len(text)
        if self.held.endswith(self.template.end):
            self.read()

    def read(self) -> None:
        """Reads whole turns in what is held; what is left waits for more."""
        done, begin = 0, None
        role = None
        for m in self.token.finditer(self.held):
            if m["header"] and begin is None:
                role, begin = self.template.role(m["header"]), m.end()
            elif m["end"] and begin is not None:
                text = self.template.unescape(self.held[begin : m.start()])
                self.turns.update(f"{role}\n{text}\n".encode())
                self.n_turns += 1
                at = 0
                for stop, loss in self.marks:
                    a, b = max(at, begin), min(stop, m.start())
                    if loss and a < b:
                        part = self.template.unescape(self.held[a:b])
                        self.loss.update(part.encode())
                        self.loss_chars += len(part)
                    at = stop
                done, begin = m.end(), None
        self.held = self.held[done:]
        self.marks = [(stop - done, loss) for stop, loss in self.marks if stop > done]


def _read_back(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[tuple]:
    reader, valid = _Reader(template), True
    for batch in batches:
        for conv, kind, text, loss, problem in zip(*(column(batch, c).to_pylist() for c in ("conv", "kind", "text", "loss", "problem"))):
            valid &= problem is None
            if kind != "close":
                reader.feed(text, loss)
                continue
            if reader.held:
                raise ValueError(f"conversation {conv} doesn't read back")
            yield conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.formatted_chars, valid
            reader, valid = _Reader(template), True


def read_back(segments: DataFrame, *, template: Template | None = None) -> DataFrame:
    """One row a conversation, from the formatted text and the loss flags alone.

    segments: as format_conversations returns them (rows of a conversation in order in one partition).
    """
    template = template or Template()
    kind = segments.schema["conv"].dataType.simpleString()
    return map_rows(
        segments, lambda b: _read_back(b, template),
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return read_back(format_conversations(rows.union(extra)))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), t AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS escaped,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS final
  FROM c
), f AS (
  SELECT *, CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 WHEN 'tool' THEN 10
                      ELSE 11 + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ':',
                        '\:')) END AS header,
         (CASE coalesce(before, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
           WHEN 'user' THEN role = 'assistant'
               WHEN 'assistant' THEN role IN ('user', 'tool') WHEN 'tool' THEN role IN ('assistant', 'tool') ELSE false END)
         AND (NOT final OR role = 'assistant') AS fits
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), ''
  ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(header + length(escaped) + 8) AS BIGINT) AS formatted_chars, bool_and(fits) AS valid
FROM f GROUP BY conv_id
"""
