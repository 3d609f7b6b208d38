r"""Substring dedup: Rabin-Karp hashes of every window of words, grouped in Spark, merged into removal intervals.

1. Each scan task hashes every window of `width` consecutive words of whole texts. Among the
   windows of one slice of texts, those whose smallest document is in the slice too are settled
   there; only windows of that smallest document travel, so a passage that a third of all
   documents share costs each task a few entries.
2. What travels is dealt by hash prefix, as packed arrays (hash, document, position). Each bucket
   finds the smallest document of each hash and returns the windows of all other documents.
3. Those windows are gathered by groups of documents, again packed, and merged into maximal
   intervals, which are joined to the texts and cut out.

Windows are told apart by a 64-bit hash: two different windows among n collide with a probability
of about n * n / 2**61 in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, column, fresh, in_batches, offsets_of, packed, short_batches, slices, text_bytes, unpacked
from .words import SPACED, mixed, window_hashes, words

#: Text bytes whose windows one bucket takes, on average.
BUCKET_BYTES = 16 << 20
#: Stands for a null doc_id: larger than any other.
NO_ID = (1 << 63) - 1

_FORWARD = "bucket int, hash binary, doc binary, twin binary, at binary, till binary"
_REPLY = "`group` int, doc binary, twin binary, at binary, till binary"
_GONE = "doc long, twin long, at array<int>, till array<int>"


def _runs(doc: np.ndarray, twin: np.ndarray, at: np.ndarray, till: np.ndarray):
    """Interval ends of sorted (document, start) merged where they touch within one document."""
    if not len(doc):
        return doc, twin, at, till
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]) | (at[1:] > till[:-1])
    first = np.flatnonzero(new)
    return doc[first], twin[first], at[first], np.maximum.reduceat(till, first)


def _forward(batches: Iterator[pa.RecordBatch], buckets: int, width: int) -> Iterator[tuple]:
    turn = int(hashlib.md5(repr(buckets).encode()).hexdigest(), 16) % buckets
    for batch in batches:
        ids, twins, texts = (column(batch, c) for c in ("doc", "twin", "text"))
        for lo, hi in slices(texts):
            doc = ids[lo:hi].to_numpy(zero_copy_only=False)
            order = np.argsort(doc, kind="stable")
            doc = doc[order]
            twin = twins[lo:hi].to_numpy(zero_copy_only=False)[order]
            found = words(texts[lo:hi].take(pa.array(order)), SPACED)
            starts, hashes = window_hashes(found.hashes(), found.first, width)
            row = found.doc[starts].astype(np.int32)
            at = (starts - found.first[row]).astype(np.int32)
            del found, starts  # sorting takes as much again
            by = np.argsort(hashes, kind="stable")
            hashes, row, at = hashes[by], row[by], at[by]
            if not len(hashes):
                continue
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            first = np.flatnonzero(new)
            least = doc[row[first]]
            kept = doc[row] == np.repeat(least, np.diff(np.append(first, len(hashes))))
            gone = np.flatnonzero(~kept)
            if len(gone):
                gone = gone[np.lexsort((at[gone], row[gone]))]
                r = row[gone]
                d, t, a, e = _runs(doc[r], twin[r], at[gone], at[gone] + np.int32(width))
                yield turn, None, packed(d), packed(t), packed(a), packed(e)
                turn = (turn + 1) % buckets
            hashes, row, at = hashes[kept], row[kept], at[kept]
            part = _bucket(hashes, buckets)
            cuts = np.searchsorted(part, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                x = slice(cuts[b], cuts[b + 1])
                yield int(b), packed(hashes[x]), packed(doc[row[x]]), packed(twin[row[x]]), packed(at[x]), None


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_KINDS = {"hash": np.uint64, "doc": np.int64, "twin": np.int64, "at": np.int32, "till": np.int32}


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Which of the values stand there more than once."""
    by = np.argsort(hashes, kind="stable")
    ordered = hashes[by]
    same = np.zeros(len(hashes) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.empty(len(hashes), bool)
    out[by] = same[1:] | same[:-1]
    return out


def _settle(table: pa.Table, width: int, groups: int) -> Iterator[tuple]:
    """The windows of one bucket that start in a smaller document too, packed for each group of documents.

    Most windows start once; of these nothing but the hash is unpacked and kept.
    """
    gone = {"doc": [], "twin": [], "at": [], "till": []}
    sent = []
    for i in range(table.num_rows):
        if table["hash"][i].is_valid:
            sent.append(i)
            continue
        for k, to in gone.items():
            to.append(unpacked(table[k][i].as_py(), _KINDS[k]))
    if sent:
        parts = [unpacked(table["hash"][i].as_py(), _KINDS["hash"]) for i in sent]
        ends = np.cumsum([len(x) for x in parts])
        hashes = np.concatenate(parts)
        del parts
        again = _repeated(hashes)
        some = np.split(again, ends[:-1])
        hashes = hashes[again]
        doc, twin, at = (
            np.concatenate([unpacked(table[k][i].as_py(), _KINDS[k])[x] for i, x in zip(sent, some)]) for k in ("doc", "twin", "at")
        )
        by = np.lexsort((doc, hashes))
        hashes, doc = hashes[by], doc[by]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(new)
        lost = np.flatnonzero(doc != np.repeat(doc[first], np.diff(np.append(first, len(hashes)))))
        gone["doc"].append(doc[lost])
        gone["twin"].append(twin[by[lost]])
        gone["at"].append(at[by[lost]])
        gone["till"].append(gone["at"][-1] + np.int32(width))
    doc, twin, at, till = _merged(gone)
    group = (mixed(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
    by = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[by], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(cuts)):
        x = by[cuts[g] : cuts[g + 1]]
        yield int(g), packed(doc[x]), packed(twin[x]), packed(at[x]), packed(till[x])


def _merged(gone: dict[str, list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    doc, twin, at, till = (np.concatenate(gone[k]) if gone[k] else np.zeros(0, _KINDS[k]) for k in ("doc", "twin", "at", "till"))
    by = np.lexsort((at, twin, doc))
    return _runs(doc[by], twin[by], at[by], till[by])


def _gather(table: pa.Table) -> pa.Table:
    """All that goes from the documents of one group, as interval lists by document."""
    doc, twin, at, till = _merged({k: [unpacked(x.as_py(), _KINDS[k]) for x in table[k]] for k in ("doc", "twin", "at", "till")})
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1])
    first = np.flatnonzero(new)
    offsets = pa.array(np.append(first, len(doc)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (at, till)]
    return pa.table([pa.array(doc[first]), pa.array(twin[first]), *lists], names=["doc", "twin", "at", "till"])


def repeated_intervals(docs: DataFrame, *, width: int = 50, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Word intervals [at, till) to remove, by (doc, twin); see remove_repeats for these keys. docs: doc, twin, text."""
    buckets = max(8, -(-text_bytes(docs) // bucket_bytes))
    schema = arrow_schema(_FORWARD)

    def forward(batches):
        for row in _forward(batches, buckets, width):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    groups = max(4, buckets // 4)
    reply = arrow_schema(_REPLY)

    def settle(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(in_batches(_settle(table, width, groups), reply)), reply)

    sent = docs.mapInArrow(forward, _FORWARD)
    return sent.groupBy("bucket").applyInArrow(settle, _REPLY).groupBy("group").applyInArrow(_gather, _GONE)


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, names: dict[str, str], layout: str) -> Iterator[pa.RecordBatch]:
    """Cuts the intervals out of the texts. names: of the columns text, at, till, n_words, n_removed, kept, spans."""
    for whole in batches:
        texts_all = column(whole, names["text"])
        for lo, hi in slices(texts_all):
            batch = whole.slice(lo, hi - lo)
            texts = column(batch, names["text"])
            found = words(texts, SPACED)
            ends = offsets_of(texts)
            ends = ends - ends[0]
            sizes = np.diff(found.first)
            kept, n_removed, spans = [], [], []
            ats, tills = column(batch, names["at"]), column(batch, names["till"])
            for i, text in enumerate(texts):
                n = int(sizes[i])
                mark = None
                if ats[i].is_valid and n:
                    mark = np.zeros(n + 1, np.int64)
                    mark[np.asarray(ats[i].values)] += 1  # merged intervals: no start or end twice
                    mark[np.asarray(tills[i].values)] -= 1
                    mark = np.cumsum(mark)[:n] > 0
                if mark is None or not mark.any():
                    n_removed.append(0)
                    spans.append([])
                    if layout == "words" and text.is_valid:
                        kept.append(b" ".join(text.as_buffer().to_pybytes().split()))
                    else:
                        kept.append(text.as_buffer().to_pybytes() if text.is_valid else None if layout == "text" else b"")
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
                a, e = edge[::2], edge[1::2]
                n_removed.append(int(mark.sum()))
                spans.append([{"at": int(x), "till": int(y)} for x, y in zip(a, e)])
                raw = text.as_buffer().to_pybytes()
                base = int(found.first[i])
                begin = found.start[base : base + n] - ends[i]
                if layout == "words":
                    stop = found.end[base : base + n] - ends[i]
                    starts, stops = np.concatenate([[0], e]), np.concatenate([a, [n]])
                    pieces = [raw[begin[x] : stop[y - 1]] for x, y in zip(starts, stops) if y > x]
                    kept.append(b" ".join(b" ".join(pieces).split()))
                else:
                    cut_from = begin[a]
                    cut_to = np.append(begin, len(raw))[e]
                    pieces, last = [], 0
                    for x, y in zip(cut_from, cut_to):
                        pieces.append(raw[last:x])
                        last = y
                    pieces.append(raw[last:])
                    kept.append(b"".join(pieces))
            new = {
                names["n_words"]: pa.array(sizes.astype(np.int64)),
                names["n_removed"]: pa.array(n_removed, pa.int64()),
                names["kept"]: pa.array(kept, pa.binary()).cast(pa.string()),
                names["spans"]: pa.array(spans, schema.field(names["spans"]).type),
            }
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else column(batch, f.name) for f in schema], schema=schema)


def remove_repeats(
    docs: DataFrame, *, width: int = 50, id_col: str = "doc_id", text_col: str = "text", layout: str = "text",
    bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """docs with the words cut that lie in a window which also starts in a document of a smaller id.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and
    carriage return. Windows are judged on the input. Added: n_words, n_removed (long), kept (the text without those
    words: its own layout with layout="text", words joined by one space with "words"), spans
    (array of word intervals [at, till)). Columns of these names are replaced; others pass through.

    Null and empty texts have no words (kept: null or empty as it was with "text", empty with
    "words"). A null id counts as larger than all others. Rows that repeat an id are one document
    among themselves: none removes words of another, whether or not their texts are equal. An
    empty table gives an empty table.
    """
    docs = short_batches(docs).drop("n_words", "n_removed", "kept", "spans")
    doc, twin, at, till, gdoc, gtwin = fresh(docs, "_doc", "_twin", "_at", "_till", "_gdoc", "_gtwin")
    repeats = docs.groupBy(id_col).count().filter("count > 1").limit(1).count() > 0
    keyed = docs.withColumns(
        {doc: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), twin: F.xxhash64(text_col) if repeats else F.lit(0).cast("long")}
    )
    gone = repeated_intervals(
        keyed.select(F.col(doc).alias("doc"), F.col(twin).alias("twin"), F.col(text_col).alias("text")), width=width,
        bucket_bytes=bucket_bytes
    )
    gone = gone.select(F.col("doc").alias(gdoc), F.col("twin").alias(gtwin), F.col("at").alias(at), F.col("till").alias(till))
    joined = keyed.join(gone, (F.col(doc) == F.col(gdoc)) & (F.col(twin) == F.col(gtwin)), "left").drop(doc, twin, gdoc, gtwin)
    span = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("till", T.IntegerType())]))
    out = T.StructType(
        [
            *docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()), T.StructField("spans", span)
        ]
    )
    arrow = arrow_schema(out)
    names = {"text": text_col, "at": at, "till": till, "n_words": "n_words", "n_removed": "n_removed", "kept": "kept", "spans": "spans"}
    return joined.mapInArrow(lambda batches: _cut(batches, arrow, names, layout), out)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), width=50, layout="words")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


#: The same in DuckDB: every window as text.
OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents
), win AS (
  SELECT doc_id, i AS beg, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), least_doc AS (
  SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(beg, beg + 50)) AS pos FROM win JOIN least_doc USING (h) WHERE doc_id > first_doc
), kept AS (
  SELECT w.doc_id, x.pos, w.ws[x.pos] AS word
  FROM w, LATERAL (SELECT unnest(range(1, len(w.ws) + 1)) AS pos) x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.pos = x.pos)
), joined AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept_text FROM kept GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM w LEFT JOIN joined USING (doc_id)
"""
