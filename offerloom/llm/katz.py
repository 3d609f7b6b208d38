"""Language-model scores by Katz backoff: Good-Turing discounts, exactly normalised backoff weights, stored tables.

P(w | h) = d(c) * c / C(h) for an n-gram hw seen c > 0 times, else a(h) * P(w | h'), h' being h without its first word; below
single words stands one class for all unknown ones. d are Katz's discounts (Good-Turing up to DISCOUNTED
counts, 1 above) of each order. C(h) is the sum of the counts in h, one more where no discount leaves anything. a(h) gives what
is left to the words
unseen after h: (1 - sum of d * c / C(h)) / (1 - sum of P(w | h') over the words w seen after h), so that every
context adds up to 1.

1. Scan tasks turn texts into slices: the distinct words' hashes and a stream of their numbers.
2. For each order, slices ask buckets for the counts of their distinct n-grams, packed, and send what they counted
   in training texts. Buckets add up, store their part of the table and reply. Words get
   dense numbers there, small for frequent ones, so that n-grams are exact and pack well.
3. Contexts sum what they left and what their words have below; a context of many words is spread over
   buckets by word, and its parts are added up before its weight is made.
4. Each slice evaluates the recursion for all its tokens at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, column, in_batches, map_rows, shared_dir, short_batches, slices, text_bytes, unpacked
from .common import packed as pack
from .words import SPACED_LOWER, mixed, words

#: Counts up to this are discounted.
DISCOUNTED = 5
#: Text bytes of one slice, and of the texts whose n-grams one bucket takes on average.
SLICE_BYTES, BUCKET_BYTES = 12 << 20, 12 << 20
#: Contexts seen more often are spread over buckets by word.
HEAVY = 1 << 16
#: Stands for the end of a text among the words' hashes, and for what is before its start among their numbers.
END, BEGIN = np.uint64(0x5851F42D4C957F2D), 0
#: In place of a slice's number: a part of a table.
TABLE = -1

_SLICE = "slice long, kind string, part int, a binary, b binary, c binary, ids array<{id}>, held array<boolean>"
_REQUEST = "part int, slice long, kind string, keys array<binary>, counts binary, low binary, more binary"
_REPLY = "slice long, kind string, part int, a binary, b binary, keys array<binary>, stats array<long>"


@dataclass
class Model:
    """order, buckets, heavy (counts of contexts that are spread); tables: of each order, one packed row a bucket (n-grams as
    word numbers, counts, counts one order below);
    contexts: of each order above the first, packed sums by context; discounts: of each order, by count (index 0 unused);
    n, types: tokens and distinct tokens of the training texts; total, unknown: what divides the single words' counts, and the
    probability of the unknown class."""

    order: int
    buckets: int
    heavy: int = HEAVY
    tables: list[DataFrame] = field(default_factory=list)
    contexts: list[DataFrame] = field(default_factory=list)
    discounts: list[list[float]] = field(default_factory=list)
    n: int = 0
    types: int = 0
    total: float = 1.0
    unknown: float = 1.0


def discounts(seen: list[int]) -> list[float]:
    """d[0 .. DISCOUNTED] from the numbers of n-grams seen 1, 2, ... DISCOUNTED + 1 times.

    Where Katz's formula gives none between 0 and 1 (small or odd corpora), b / c of each count c is discounted
    instead, b = n1 / (n1 + 2 * max(n2, 1)); nothing where no n-gram is seen once.
    """
    k = DISCOUNTED
    n = [0, *seen]
    if all(n[1 : k + 2]) and (k + 1) * n[k + 1] != n[1]:
        rest = (k + 1) * n[k + 1] / n[1]
        out = [((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in out):
            return [1.0, *out]
    b = n[1] / (n[1] + 2 * max(n[2], 1)) if n[1] else 0.0
    return [1.0, *((r - b) / r for r in range(1, k + 1))]


def _discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """d(c) * c."""
    return np.where(counts <= DISCOUNTED, np.asarray(d)[np.minimum(counts, DISCOUNTED)], 1.0) * counts


def _encode(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[tuple]:
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 24, [], 0

    def emit():
        nonlocal number
        texts, ids, out = (pa.concat_arrays([x[i] for x in held]) for i in range(3))
        for lo, hi in slices(texts, SLICE_BYTES):
            found = words(texts[lo:hi], SPACED_LOWER)
            docs = np.arange(hi - lo)
            tokens = np.full(len(found.start) + len(docs), END)
            tokens[np.arange(len(found.start)) + found.doc] = found.hashes()
            vocabulary, stream, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            frequent = np.argsort(-counts, kind="stable")  # small numbers pack better
            rank = np.empty(len(frequent), np.int32)
            rank[frequent] = np.arange(len(frequent))
            yield number, "slice", None, pack(vocabulary[frequent]), pack(rank[stream]), pack(
                (np.diff(found.first) + 1).astype(np.int64)
            ), ids[lo:hi].to_pylist(), out[lo:hi].to_pylist()
            number += 1

    for batch in batches:
        texts = column(batch, "text")
        held.append((texts, column(batch, "id"), column(batch, "held")))
        size += texts.nbytes
        if size >= SLICE_BYTES:
            yield from emit()
            held, size = [], 0
    if size or held:
        yield from emit()


def _part(keys: list[np.ndarray], buckets: int) -> np.ndarray:
    h = np.full(len(keys[0]), np.uint64(len(keys)))
    with np.errstate(over="ignore"):
        for k in keys:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + k.astype(np.uint64))
    return (h % np.uint64(buckets)).astype(np.int64)


def _by_part(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of requests by part, and where each part is in it. The same for asking and for reading replies."""
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    return order, [(int(p), slice(a, b)) for p, a, b in zip(parts, first, [*first[1:], len(order)])]


class Slice:
    """One slice and the replies that it has got so far."""

    def __init__(self, table: pa.Table, buckets: int, heavy: int):
        self.buckets, self.heavy, self.replies = buckets, heavy, {}
        for r in table.to_pylist():
            if r["kind"] == "slice":
                self.slice, self.ids, self.held = r["slice"], r["ids"], np.array(r["held"], bool)
                self.vocabulary, self.stream, self.sizes = (
                    unpacked(r[x], t) for x, t in (("a", np.uint64), ("b", np.int32), ("c", np.int64))
                )
            else:
                self.replies[r["kind"], r["part"]] = (r["a"], r["b"])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.held, self.sizes)
        self.word_order, self.word_parts = _by_part(_part([self.vocabulary], buckets))
        self.grams = {}

    def read(self, kind: str, order: np.ndarray, parts: list, types: tuple) -> list[np.ndarray]:
        """Replies in the order of what was asked."""
        out = [np.zeros(len(order), t) for t in types]
        for p, where in parts:
            for to, data, t in zip(out, self.replies[kind, p], types):
                to[order[where]] = unpacked(data, t)
        return out

    def ask(self, kind: str, keys: list[np.ndarray], order: np.ndarray, parts: list, counts=None, low=None, more=None) -> Iterator[tuple]:
        some = lambda x, i: None if x is None else pack(x[i])
        for p, where in parts:
            i = order[where]
            yield p, self.slice, kind, [pack(k[i]) for k in keys], some(counts, i), some(low, i), some(more, i)

    def ask_words(self) -> Iterator[tuple]:
        counts = np.bincount(self.stream[self.train], minlength=len(self.vocabulary)).astype(np.int64)
        return self.ask("n1", [self.vocabulary], self.word_order, self.word_parts, counts)

    def read_words(self) -> None:
        """The first order: all tokens are grams of themselves. Behind the last gram stands the start of a text."""
        numbers, counts = self.read("n1", self.word_order, self.word_parts, (np.int64, np.int64))
        self.at, self.counts = self.stream.astype(np.int64), counts
        self.words, self.keys = numbers, [np.append(numbers, BEGIN)]
        self.often = np.append(counts, self.heavy + 1)

    def next_order(self, n: int) -> None:
        """Distinct n-grams of the slice from those of order n - 1."""
        size = len(self.words)
        before = np.empty_like(self.at)
        before[1:] = self.at[:-1]
        before[self.starts] = len(self.counts)
        codes, first, at = np.unique(before * size + self.stream, return_index=True, return_inverse=True)
        context, word = codes // size, codes % size
        # asked for: what can be known at all, for its shorter form is
        low = self.counts[self.at[first]]
        self.before, self.suffix, self.contexts = before, self.at[first], (self.keys, self.often, self.totals if n > 2 else None)
        self.keys = [*(k[context] for k in self.keys), self.words[word]]
        self.asked = np.flatnonzero((low > 0) & (self.often[context] > 0))
        heavy = self.often[context][self.asked] > self.heavy
        keys = [k[self.asked] for k in self.keys]
        part = np.where(heavy, _part(keys, self.buckets), _part(keys[:-1], self.buckets))
        self.low, self.at = low, at.astype(np.int64)
        self.order, self.parts = _by_part(part)
        # contexts that were seen in training, and the start
        self.context_asked = np.flatnonzero(self.contexts[1] > 0)
        self.context_order, self.context_parts = _by_part(_part([k[self.context_asked] for k in self.contexts[0]], self.buckets))

    def ask_grams(self, n: int, base: float) -> Iterator[tuple]:
        counts = np.bincount(self.at[self.train], minlength=len(self.low)).astype(np.int64)
        yield from self.ask(f"n{n}", [k[self.asked] for k in self.keys], self.order, self.parts, counts[self.asked], self.low[self.asked])
        below = np.full(len(self.context_asked), base) if n == 2 else self.contexts[2][self.context_asked]
        yield from self.ask(f"c{n}", [k[self.context_asked] for k in self.contexts[0]], self.context_order, self.context_parts, more=below)

    def read_grams(self, n: int) -> None:
        counts = np.zeros(len(self.low), np.int64)
        counts[self.asked] = self.read(f"n{n}", self.order, self.parts, (np.int64,))[0]
        self.counts = counts
        self.often = np.append(counts, self.heavy + 1)
        self.keys = [np.append(k, BEGIN) for k in self.keys]

    def read_contexts(self, n: int) -> None:
        """total and weight of each context of order n. Unseen ones leave all to the shorter one."""
        found = self.read(f"c{n}", self.context_order, self.context_parts, (np.float64, np.float64))
        total, weight = np.zeros(len(self.contexts[1])), np.ones(len(self.contexts[1]))
        total[self.context_asked], weight[self.context_asked] = found
        self.total, self.weight = total, weight
        # a gram as a context of the next order: what stands below is the same without its first word
        self.totals = np.append(total[self.suffix], total[-1])


def _in_groups(step: Callable, *parameters) -> Callable[[pa.Table], pa.Table]:
    """step with its parameters, as a function of a group's table alone."""

    def of_group(table: pa.Table) -> pa.Table:
        return step(table, *parameters)

    return of_group


def _ask_words(batches: Iterator[pa.RecordBatch], buckets: int, heavy: int) -> Iterator[tuple]:
    """Requests for the words of slices, made where the slices lie."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield from Slice(pa.Table.from_batches([batch.slice(i, 1)]), buckets, heavy).ask_words()


def _ask(table: pa.Table, buckets: int, heavy: int, n: int, base: float, schema: pa.Schema) -> pa.Table:
    """Requests of order n > 1 of one slice, which has the replies of the orders below."""
    s = Slice(table, buckets, heavy)
    s.read_words()
    for i in range(2, n):
        s.next_order(i)
        s.read_grams(i)
        s.read_contexts(i)
    s.next_order(n)
    return pa.Table.from_batches(list(in_batches(s.ask_grams(n, base), schema)), schema)


def _score(table: pa.Table, model: Model, schema: pa.Schema) -> pa.Table:
    s = Slice(table, model.buckets, model.heavy)
    s.read_words()
    rows = len(s.sizes)
    each = lambda x: np.add.reduceat(x, s.starts) if rows else np.zeros(0, x.dtype)
    # what depends on the word alone is looked up, not made for each token
    found, total = s.counts > 0, model.n + 0.5 * (model.types + 1)
    known, base = each(found.astype(np.int64)[s.at]), each(np.log10((s.counts + 0.5) / total)[s.at])
    p = np.where(found, _discounted(s.counts, model.discounts[0]) / model.total, model.unknown)[s.at]
    for n in range(2, model.order + 1):
        s.next_order(n)
        s.read_grams(n)
        s.read_contexts(n)
        own = _discounted(s.counts, model.discounts[n - 1])[s.at]
        lower = s.weight[s.before]
        lower *= p
        p = np.where(own > 0, own / np.maximum(s.total, 1)[s.before], lower)
    score = each(np.log10(p, out=p))
    return pa.Table.from_arrays(
        [
            pa.array(s.ids, schema.field(0).type), pa.array(s.held), pa.array(s.sizes), pa.array(known),
            pa.array(np.full(rows, model.n)), pa.array(base), pa.array(score)
        ],
        schema=schema
    )


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where sorted keys change."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _gathered(rows: list[dict], kind: str, types: dict[str, type]) -> tuple[list, dict[str, np.ndarray]]:
    """(keys, the columns of types) of packed rows, one after the other."""
    keys = [
        np.concatenate([unpacked(r["keys"][i], np.uint64 if kind == "n1" else np.int64) for r in rows]) for i in range(len(rows[0]["keys"]))
    ] if rows else []
    return keys, {k: np.concatenate([unpacked(r[k], t) for r in rows]) for k, t in types.items()} if rows else {}


def _count(table: pa.Table, n: int, buckets: int, schema: pa.Schema) -> pa.Table:
    """One bucket: its part of the table, and each slice's replies. Requests for contexts pass through: they are answered when
    the table is whole.
    """
    part = table["part"][0].as_py()
    every = table.to_pylist()
    rows = [r for r in every if r["kind"] == f"n{n}"]
    keys, sent = _gathered(rows, f"n{n}", {"counts": np.int64} | ({"low": np.int64} if n > 1 else {}))
    out = [(r["slice"], f"c{n}", part, r["more"], None, r["keys"], None) for r in every if r["kind"] == f"c{n}"]
    if rows:
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        first = _runs(keys)
        counts = np.add.reduceat(sent["counts"][order], first)
        run = np.empty(len(order), np.int64)
        run[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        known = np.flatnonzero(counts > 0)
        numbers = np.full(len(first), -1)
        if n == 1:
            known = known[np.lexsort((keys[0][first][known], -counts[known]))]
            numbers[known] = 1 + np.arange(len(known)) * buckets + part  # frequent words have small numbers
        seen = np.bincount(np.minimum(counts[known], DISCOUNTED + 2), minlength=DISCOUNTED + 2)[1 : DISCOUNTED + 2]
        stats = [int(counts[known].sum()), len(known), *seen.tolist()]
        low = pack(sent["low"][order][first][known]) if n > 1 else None
        out.append((TABLE, f"table{n}", part, pack(counts[known]), low, [pack(k[first][known]) for k in keys], stats))
        at = 0
        for r in rows:
            size = len(unpacked(r["counts"], np.int64))
            mine = run[at : at + size]
            at += size
            if r["slice"] != TABLE:
                out.append(
                    (
                        r["slice"], f"n{n}", part,
                        *((pack(numbers[mine]), pack(counts[mine])) if n == 1 else (pack(counts[mine]), None)), None,
                        None
                    )
                )
    return pa.Table.from_batches(list(in_batches(iter(out), schema)), schema)


def _sums(batches: Iterator[pa.RecordBatch], n: int, d: list[float], d_low: list[float], buckets: int) -> Iterator[tuple]:
    """Of each context in one part of a table: its counts, what discounts leave of them, and its words' discounted counts one
    order below.
    """
    for batch in batches:
        for r in batch.to_pylist():
            keys, counts, low = [unpacked(k, np.int64) for k in r["keys"]], unpacked(r["a"], np.int64), unpacked(r["b"], np.int64)
            if not len(counts):
                continue
            first = _runs(keys[:-1])
            kept, below = _discounted(counts, d), _discounted(low, d_low)
            total, left, low = (np.add.reduceat(x, first) for x in (counts, counts - kept, below))
            context = [k[first] for k in keys[:-1]]
            order, parts = _by_part(_part(context, buckets))
            for p, where in parts:
                i = order[where]
                yield p, TABLE, f"c{n}", [pack(k[i]) for k in context], pack(total[i]), pack(left[i]), pack(low[i])


def _weigh(table: pa.Table, n: int, schema: pa.Schema) -> pa.Table:
    """Replies to requests for contexts: what divides their counts, and the weight of the shorter context."""
    part = table["part"][0].as_py()
    rows, asked = ([r for r in table.to_pylist() if (r["slice"] == TABLE) == sums] for sums in (True, False))
    keys, sent = _gathered(rows, f"c{n}", {"counts": np.int64, "low": np.float64, "more": np.float64})
    wanted, below = _gathered(asked, f"c{n}", {"more": np.float64})
    out = []
    if asked:
        many = len(keys[0]) if rows else 0
        both = [np.concatenate([k, w]) for k, w in zip(keys, wanted)] if rows else wanted
        order = np.lexsort(both[::-1])
        first = _runs([k[order] for k in both])
        run = np.empty(len(order), np.int64)
        run[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        total, left, low = (
            np.bincount(run[:many], sent[x], minlength=len(first)) if many else np.zeros(len(first)) for x in ("counts", "low", "more")
        )
        nothing = left <= 0
        total, left = np.where(nothing & (total > 0), total + 1, total), np.where(nothing, 1.0, left)
        mine = run[many:]
        weight = np.where(total[mine] > 0, left[mine] / np.maximum(total[mine], 1) / (1 - low[mine] / below["more"]), 1.0)
        at = 0
        for r in asked:
            size = len(unpacked(r["more"], np.float64))
            out.append((r["slice"], f"c{n}", part, pack(total[mine][at : at + size]), pack(weight[at : at + size]), None, None))
            at += size
    return pa.Table.from_batches(list(in_batches(iter(out), schema)), schema)


def _saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, partitioned by kind."""
    path = shared_dir(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def katz(
    docs: DataFrame, *, held_out: Column | None = None, order: int = 3, model: Model | None = None,
    id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, heavy: int = HEAVY
) -> tuple[DataFrame, Model]:
    """(scores, model). Learns from the texts that are not held out, or goes on from a model, adding nothing to it.

    scores: id_col, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (the log10 probability by
    single words with
    0.5 added to each count), score (the model's). One row for each of docs. Tokens: runs of characters other than
    space, tab, line feed, vertical tab, form feed and carriage return, A-Z in lower case, then one for the end of the text.

    Null texts are empty: one token. A null held_out is false. Ids may be null or repeated: each row is a text of its own. A
    text is never split, so
    it must fit a task. With no training text every token is unknown, and both scores are 0. An empty table gives an empty table.
    Other columns are not used. Words are told apart by 64-bit hashes, n-grams by their words' numbers.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    held = F.lit(True) if model else F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    source = short_batches(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held")))
    buckets = model.buckets if model else max(8, -(-text_bytes(source) // bucket_bytes))
    learned = model or Model(order, buckets, heavy)
    learned_heavy = learned.heavy
    form = _SLICE.format(id=id_type)
    id_arrow = arrow_schema(f"id {id_type}").field(0).type
    have = _saved(map_rows(source, lambda b: _encode(b, id_arrow), form), "katz-slices")
    replies = lambda df: df.where(F.col("slice") != TABLE).select(
        "slice", "kind", "part", "a", "b", F.lit(None).cast("binary").alias("c"),
        F.lit(None).cast(f"array<{id_type}>").alias("ids"), F.lit(None).cast("array<boolean>").alias("held")
    )
    table_rows = lambda df, kind: df.select(
        "part", "slice", F.lit(kind).alias("kind"), "keys", F.col("a").alias("counts"), F.col("b").alias("low"),
        F.lit(None).cast("binary").alias("more")
    )

    for n in range(1, learned.order + 1):
        if n == 1:
            asked = map_rows(have, lambda b: _ask_words(b, buckets, learned_heavy), _REQUEST)
        else:
            step = _in_groups(_ask, buckets, learned.heavy, n, learned.total, arrow_schema(_REQUEST))
            asked = have.groupBy("slice").applyInArrow(step, _REQUEST)
        if model:
            asked = asked.unionByName(table_rows(model.tables[n - 1], f"n{n}"))
        counted = _saved(asked.groupBy("part").applyInArrow(_in_groups(_count, n, buckets, arrow_schema(_REPLY)), _REPLY), f"katz-{n}")
        have = have.unionByName(replies(counted.where(F.col("kind") == f"n{n}")))
        if not model:
            table = counted.where(F.col("kind") == f"table{n}")
            stats = table.agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(DISCOUNTED + 3))).head()
            tokens, types, *seen = (int(x or 0) for x in stats)
            learned.tables.append(table)
            learned.discounts.append(discounts(seen))
            if n == 1:
                d = learned.discounts[0]
                left = sum((1 - d[r]) * r * seen[r - 1] for r in range(1, DISCOUNTED + 1))
                learned.n, learned.types, learned.total = tokens, types, float(tokens if left > 0 else tokens + 1)
                learned.unknown = (left if left > 0 else 1.0) / learned.total
        if n > 1:
            if not model:
                d, d_low = learned.discounts[n - 1], learned.discounts[n - 2]
                learned.contexts.append(
                    map_rows(
                        learned.tables[n - 1].select("keys", "a", "b"),
                        lambda b, n=n, d=d, d_low=d_low: _sums(b, n, d, d_low, buckets), _REQUEST
                    )
                )
            none = F.lit(None).cast("binary")
            contexts = counted.where(F.col("kind") == f"c{n}").select(
                "part",
                "slice",
                "kind",
                "keys",
                none.alias("counts"),
                none.alias("low"),
                F.col("a").alias("more")
            )
            contexts = contexts.unionByName(learned.contexts[n - 2])
            weighed = _saved(
                contexts.groupBy("part").applyInArrow(_in_groups(_weigh, n, arrow_schema(_REPLY)), _REPLY),
                f"katz-weights-{n}"
            )
            have = have.unionByName(replies(weighed))
    out = f"{id_col} {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    plain = Model(
        learned.order, buckets, learned.heavy, [], [], learned.discounts, learned.n, learned.types, learned.total,
        learned.unknown
    )
    return have.groupBy("slice").applyInArrow(_in_groups(_score, plain, arrow_schema(out)), out), learned


def op12_katz(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return katz(docs, held_out=held, order=2)[0]
