r"""Benchmark decontamination by winnowing.

Of every `window - gram + 1` consecutive k-grams the one with the least hash is kept, on both sides.
Every span of `window` words that a document shares with an item therefore shares a kept k-gram.
Kept k-grams are joined on their hashes, and each hit is extended word by word as far as a window
around it can reach; where the match is a window or longer, its words are hit. Equal surroundings of a gram
extend alike, so each is held against the index once: texts that repeat themselves make no pairs of all
their places, and pairs are made in blocks of bounded size.

The items are the small side: blocks of bounded bytes form the index. One block goes to the tasks
as a broadcast variable; if the items fill more, tasks write blocks to the shared folder and every
document is held against one block after the other. Documents are never shuffled.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, column, map_rows, open_fs, shared_dir, short_batches, slices, text_bytes
from .words import ALNUM_LOWER, Words, mixed, window_hashes, words

#: Bytes of item texts in one block of the index.
BLOCK_BYTES = 8 << 20
#: Pairs of document and item grams that are extended at once.
MOST_PAIRS = 1 << 20


@dataclass
class Index:
    """Items of one block. hashes: of all words; first, last: the item's bounds for each word; item: its number; ids: the names
    of each item.

    print, at: kept k-grams, sorted, and where they begin, one of each surroundings in an item. short: length -> (hashes, item
    number) of items below a window.
    """

    ids: list[list[str]]
    hashes: np.ndarray
    item: np.ndarray
    first: np.ndarray
    last: np.ndarray
    print: np.ndarray
    at: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def kept_grams(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: (starts, hashes) of the leftmost least k-gram of each window of each row."""
    starts, grams = window_hashes(hashes, first, gram)
    at_start = np.zeros(len(hashes), np.uint64)
    at_start[starts] = grams
    room = np.maximum(np.diff(first) - window + 1, 0)
    begins = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(first[:-1], room)
    if not len(begins):
        return begins, np.zeros(0, np.uint64)
    best, place = at_start[begins], begins.copy()
    for j in range(1, window - gram + 1):
        other = at_start[begins + j]
        less = other < best
        best[less] = other[less]
        place[less] = begins[less] + j
    place = np.unique(place)
    return place, at_start[place]


def build_index(ids: list[str | None], texts: pa.Array, window: int, gram: int) -> Index:
    found = words(texts, ALNUM_LOWER)
    hashes = found.hashes()
    rows: dict[bytes, int] = {}
    names: list[list[str]] = []
    parts, bounds = [], [0]
    short: dict[int, list[tuple[int, int]]] = {}
    for i, name in enumerate(ids):
        own = hashes[found.first[i] : found.first[i + 1]]
        if not len(own):
            continue
        key = own.tobytes()
        if key in rows:
            names[rows[key]].append(name)
            continue
        rows[key] = len(names)
        names.append([name])
        if len(own) < window:
            h = window_hashes(own, np.array([0, len(own)]), len(own))[1][0]
            short.setdefault(len(own), []).append((int(h), len(names) - 1))
        parts.append(own)
        bounds.append(bounds[-1] + len(own))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    bounds = np.array(bounds)
    sizes = np.diff(bounds)
    at, prints = kept_grams(flat, bounds, window, gram)
    item, begin, end = (np.repeat(x, sizes) for x in (np.arange(len(sizes)), bounds[:-1], bounds[1:]))
    around = surroundings(flat, at, begin[at], end[at], window, gram)
    _, one = np.unique(around ^ mixed(item[at].astype(np.uint64)), return_index=True)
    at, prints = at[one], prints[one]
    by = np.argsort(prints, kind="stable")
    table = {}
    for n, found_short in short.items():
        found_short.sort()
        table[n] = (np.array([h for h, _ in found_short], np.uint64), np.array([x for _, x in found_short]))
    return Index(names, flat, item, begin, end, prints[by], at[by], table)


def surroundings(hashes: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int, gram: int) -> np.ndarray:
    """A hash of the words that a gram at `at` can be extended over, within begin and end."""
    out = np.zeros(len(at), np.uint64)
    for j in range(gram - window, window):
        inside = (at + j >= begin) & (at + j < end)
        word = np.where(inside, hashes[np.where(inside, at + j, 0)], np.uint64(0)) if len(hashes) else out
        out = mixed(out ^ word) + np.uint64(j - gram + window)
    return out


def _blocks(lo: np.ndarray, hi: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (row, place) of rows with places from lo to hi, at most so many at once."""
    sizes = hi - lo
    ends = np.cumsum(sizes)
    for start in range(0, int(ends[-1]) if len(ends) else 0, most):
        number = np.arange(start, min(start + most, int(ends[-1])))
        row = np.searchsorted(ends, number, "right")
        yield row, lo[row] + number - (ends[row] - sizes[row])


def _extended(
    hashes: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, index: Index, q: np.ndarray, window: int,
    gram: int
) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): equal words before place p of a document and q of an item, and from there on."""
    low, high = np.minimum(low, q - index.first[q]), np.minimum(high, index.last[q] - q)
    left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    more = np.ones(len(p), bool)
    for j in range(window):  # from the gram's first word: it is compared too
        more &= high > j
        i = np.flatnonzero(more)
        more[i] = hashes[p[i] + j] == index.hashes[q[i] + j]
        right += more
    more = right > 0
    for j in range(1, window - gram + 1):
        more &= low >= j
        i = np.flatnonzero(more)
        more[i] = hashes[p[i] - j] == index.hashes[q[i] - j]
        left += more
    return left, right


def find_hits(
    found: Words,
    hashes: np.ndarray,
    kept: tuple[np.ndarray, np.ndarray],
    index: Index,
    window: int,
    gram: int
) -> tuple[np.ndarray, ...]:
    """(from word, to word) of what is hit in a slice of documents, (document, item number) of who hits, each once."""
    begin, end, docs, items = ([np.zeros(0, np.int64)] for _ in range(4))
    at, prints = kept
    lo, hi = np.searchsorted(index.print, prints, "left"), np.searchsorted(index.print, prints, "right")
    if (some := np.flatnonzero(hi > lo)).size:
        p, row = at[some], found.doc[at[some]]
        low, high = p - found.first[row], found.first[row + 1] - p
        _, one, of = np.unique(
            surroundings(hashes, p, found.first[row], found.first[row + 1], window, gram), return_index=True,
            return_inverse=True
        )
        most_left, most_right = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        hits = [np.zeros((2, 0), np.int64)]
        for i, place in _blocks(lo[some][one], hi[some][one], MOST_PAIRS):
            q = index.at[place]
            left, right = _extended(hashes, p[one][i], low[one][i], high[one][i], index, q, window, gram)
            whole = np.flatnonzero(left + right >= window)
            # all matches of a place hold its first word, so they are one stretch
            np.maximum.at(most_left, i[whole], left[whole])
            np.maximum.at(most_right, i[whole], right[whole])
            hits.append(np.unique(np.stack([i[whole], index.item[q[whole]]]), axis=1))
        hit = np.flatnonzero(most_right[of])
        begin.append(p[hit] - most_left[of[hit]])
        end.append(p[hit] + most_right[of[hit]])
        who, item = np.unique(np.concatenate(hits, axis=1), axis=1)
        doc, kind = np.unique(np.stack([row[hit], of[hit]]), axis=1)
        for i, place in _blocks(np.searchsorted(who, kind, "left"), np.searchsorted(who, kind, "right"), MOST_PAIRS):
            pair = np.unique(np.stack([doc[i], item[place]]), axis=1)
            docs.append(pair[0])
            items.append(pair[1])
    for n, (keys, names) in index.short.items():
        starts, grams = window_hashes(hashes, found.first, n)
        place = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)  # items of equal words are one, so keys are distinct
        x = np.flatnonzero(keys[place] == grams)
        begin.append(starts[x])
        end.append(starts[x] + n)
        pair = np.unique(np.stack([found.doc[starts[x]], names[place[x]]]), axis=1)
        docs.append(pair[0])
        items.append(pair[1])
    return tuple(np.concatenate(v) for v in (begin, end, docs, items))


def _judge(
    batches: Iterator[pa.RecordBatch],
    schema: pa.Schema,
    blocks,
    text: str,
    window: int,
    gram: int,
    share: float
) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo, hi in slices(column(whole, text)):
            batch = whole.slice(lo, hi - lo)
            found = words(column(batch, text), ALNUM_LOWER)
            hashes = found.hashes()
            kept = kept_grams(hashes, found.first, window, gram)
            mark = np.zeros(len(hashes) + 1, np.int64)
            items: dict[int, set] = {}
            for index in blocks():
                begin, end, doc, item = find_hits(found, hashes, kept, index, window, gram)
                np.add.at(mark, begin, 1)
                np.add.at(mark, end, -1)
                for d, x in zip(doc.tolist(), item.tolist()):
                    items.setdefault(d, set()).update(index.ids[x])
            hit = (np.cumsum(mark)[: len(hashes)] > 0).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[found.first[1:]] - total[found.first[:-1]]
            n_words = np.diff(found.first)
            bad = (n_hit > 0) & (n_hit >= share * n_words)
            lists = [sorted(x for x in items.get(i, ()) if x is not None) for i in range(hi - lo)]
            spans = []
            for i in range(hi - lo):
                own = hit[found.first[i] : found.first[i + 1]] if n_hit[i] else hit[:0]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
                spans.append([{"at": int(a), "till": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            new = {
                "n_words": pa.array(n_words), "n_hit": pa.array(n_hit), "items": pa.array(lists, pa.list_(pa.string())),
                "contaminated": pa.array(bad), "spans": pa.array(spans, schema.field("spans").type)
            }
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else column(batch, f.name) for f in schema], schema=schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 13, gram: int = 7, share: float = 0.05, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """docs with n_words, n_hit (long), items (array of item ids as strings, sorted), contaminated and spans (word intervals [at, till)).

    Words: runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z. An item of
    fewer words than a window is one window; one without words is none. A document word inside any
    occurrence of a window is hit; a document is contaminated if n_hit > 0 and n_hit >= share * n_words.
    Null and empty texts have no words. Items with equal words are all named; a null item id is counted
    as a window but not named. Repeated rows of docs are each judged. Columns of the new names are
    replaced, others pass through. Without items nothing is hit.
    """
    spark = docs.sparkSession
    docs = short_batches(docs).drop("n_words", "n_hit", "items", "contaminated", "spans")
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    if text_bytes(items) <= block_bytes:
        got = items.toArrow()
        held = spark.sparkContext.broadcast(
            build_index(got["id"].to_pylist(), got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string()), window, gram)
        )

        def blocks():
            yield held.value
    else:
        folder = shared_dir(spark, "benchmark-index")

        def write(batches):
            fs, path = open_fs(folder)
            fs.create_dir(path, recursive=True)
            for batch in batches:
                for lo, hi in slices(column(batch, "text"), block_bytes):
                    part = batch.slice(lo, hi - lo)
                    name = f"{folder}/{uuid.uuid4().hex}.index"
                    with open_fs(name)[0].open_output_stream(open_fs(name)[1]) as f:
                        f.write(pickle.dumps(build_index(column(part, "id").to_pylist(), column(part, "text"), window, gram)))
                    yield (name,)

        names = [r["name"] for r in map_rows(items, write, "name string").collect()]

        def blocks():
            for name in names:
                fs, path = open_fs(name)
                with fs.open_input_stream(path) as f:
                    yield pickle.loads(f.read())

    span = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("till", T.IntegerType())]))
    out = T.StructType(
        [
            *docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType()),
            T.StructField("spans", span)
        ]
    )
    schema = arrow_schema(out)
    return docs.mapInArrow(lambda batches: _judge(batches, schema, blocks, text_col, window, gram, share), out)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS ws FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS ws FROM benchmark
), bw AS (
  SELECT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i AS beg, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)
), hits AS (
  SELECT DISTINCT doc_id, beg, dw.n AS n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), n_hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(beg, beg + n)) AS pos FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items,
  0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
