r"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a common variant at most r bits from each. Every distinct
fingerprint stands for all its variants within r bits; variants are dealt by their leading bits. A
fingerprint of 64 bits has 2,081 variants within 2 bits, yet these fall into few prefixes (37 of
8 bits), so it travels once to each such prefix and its variants there are written out after the
shuffle. All fingerprints that share a variant are within 2r bits of each other, so each is linked
to the smallest one of them, verified, and no clique is written out. Components of these links are
found by rounds of star contraction in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, short_batches, slices, stored
from .words import SPACED_LOWER, words

_U = np.uint64
#: Variants written out at once in a task.
MOST_VARIANTS = 1 << 21


def text_fingerprints(texts: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: words in lower case (A-Z), shingles with repeats, XXH64, strict majority."""
    out = np.zeros(len(texts), _U)
    digest = xxhash.xxh64_intdigest
    for lo, hi in slices(texts, 2 << 20):
        part = texts[lo:hi]
        found = words(part, SPACED_LOWER)
        # one buffer of all words, each behind one space
        sizes = found.end - found.start
        stops = np.cumsum(sizes + 1)
        joined = np.full(int(stops[-1]) if len(stops) else 0, 32, np.uint8)
        inside = np.flatnonzero(found.buf != 32)
        joined[np.arange(len(inside)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = found.buf[inside]
        data = joined.tobytes()
        begins = stops - sizes
        for i in range(hi - lo):
            a, b = int(found.first[i]), int(found.first[i + 1])
            if a == b:
                continue
            last = max(a + 1, b - shingle + 1)
            x = begins[a:last].tolist()
            y = stops[min(a + shingle, b) - 1 : b].tolist()
            h = np.array([digest(data[p:q], seed) for p, q in zip(x, y)], dtype=">u8")
            votes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            out[lo + i] = np.packbits(votes * 2 > len(h)).view(">u8")[0]
    return out


@lru_cache(maxsize=None)
def _masks(low: int, flips: int) -> np.ndarray:
    """All masks over the lowest `low` bits with `flips` bits set."""
    if flips == 0:
        return np.zeros(1, _U)
    if low < flips:
        return np.zeros(0, _U)
    return np.array([sum(1 << b for b in c) for c in combinations(range(low), flips)], dtype=_U)


@lru_cache(maxsize=None)
def _masks_within(low: int, flips: int) -> np.ndarray:
    return np.concatenate([_masks(low, f) for f in range(flips + 1)])


def routes(prints: np.ndarray, prefix_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, prefix, flips left) of every prefix within radius bits of each fingerprint's own."""
    own = prints >> _U(64 - prefix_bits)
    rows, prefixes, left = [], [], []
    for used in range(radius + 1):
        m = _masks(prefix_bits, used)
        rows.append(np.repeat(np.arange(len(prints)), len(m)))
        prefixes.append((own[:, None] ^ m[None, :]).reshape(-1))
        left.append(np.full(len(prints) * len(m), radius - used, np.int8))
    return np.concatenate(rows), np.concatenate(prefixes), np.concatenate(left)


def _collisions(prints: np.ndarray, at: np.ndarray, left: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers, each with the first row that shares one of its variants, over the `low` lowest bits.

    at: the bits of each row above `low` have been settled. Splits by one more bit until the variants fit.
    """
    if len(prints) < 2:
        return
    sizes = [1 + low * (f >= 1) + low * (low - 1) // 2 * (f >= 2) for f in range(int(left.max()) + 1)]
    total = int(np.array(sizes)[left].sum())
    if total > MOST_VARIANTS and low > 3:
        bit = (prints >> _U(low - 1)) & _U(1)
        for side in (0, 1):
            rest = left - (bit != side).astype(np.int8)
            keep = rest >= 0
            yield from _collisions(prints[keep], at[keep], rest[keep], low - 1)
        return
    base = prints & _U((1 << low) - 1)
    values, rows = [], []
    for f in range(int(left.max()) + 1):
        of = np.flatnonzero(left == f)
        if len(of):
            m = _masks_within(low, f)
            values.append((base[of, None] ^ m[None, :]).reshape(-1))
            rows.append(np.repeat(at[of], len(m)))
    values, rows = np.concatenate(values), np.concatenate(rows)
    by = np.argsort(values)
    values, rows = values[by], rows[by]
    same = values[1:] == values[:-1]
    if not same.any():
        return
    new = np.concatenate([[True], ~same])
    first = np.flatnonzero(new)
    lead = np.minimum.reduceat(rows, first)
    sizes = np.diff(np.append(first, len(values)))
    lead = np.repeat(lead, sizes)
    hit = np.flatnonzero(rows != lead)
    pairs = np.unique(rows[hit].astype(np.int64) << 32 | lead[hit])
    yield pairs >> 32, pairs & 0xFFFFFFFF


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that each of n rows is connected to, over all pairs."""
    root = np.arange(n)

    def flatten() -> None:
        while True:
            up = root[root]
            if (up == root).all():
                return
            root[:] = up

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        flatten()
        x, y = root[a], root[b]
        apart = x != y
        if apart.any():
            for p in np.unique(np.maximum(x, y)[apart] << 32 | np.minimum(x, y)[apart]).tolist():
                x, y = find(p >> 32), find(p & 0xFFFFFFFF)
                root[max(x, y)] = min(x, y)
    flatten()
    return root


def bucket_links(table: pa.Table, prefix_bits: int, distance: int) -> pa.Table:
    """Links (node, to) that connect what shares a variant of one prefix; to: the least node connected here."""
    node = np.asarray(table["node"])
    by = np.argsort(node, kind="stable")
    node = node[by]
    prints = np.asarray(table["print"])[by].view(_U)
    left = np.asarray(table["left"])[by].astype(np.int8)

    def verified():
        for a, b in _collisions(prints, np.arange(len(node)), left, 64 - prefix_bits):
            near = np.bitwise_count(prints[a] ^ prints[b]) <= distance
            yield a[near], b[near]

    root = _forest(len(node), verified())
    linked = np.flatnonzero(root != np.arange(len(node)))
    return pa.table([pa.array(node[linked]), pa.array(node[root[linked]])], names=["node", "to"])


def near_links(prints: DataFrame, *, distance: int = 4, prefix_bits: int | None = None) -> DataFrame:
    """prints: node long, print long, one row for each distinct fingerprint. Returns links node > to."""
    radius = -(-distance // 2)
    if radius > 2:
        raise ValueError("distances above 4 need more variants than a task should hold")
    if prefix_bits is None:
        n = prints.count()
        prefix_bits = min(24, max(6, n.bit_length() - 9))
    schema = "bucket long, left tinyint, node long, print long"

    def spread(batches):
        for batch in batches:
            node = np.asarray(column(batch, "node"))
            prints = np.asarray(column(batch, "print")).view(_U)
            for lo in range(0, len(node), 2000):
                row, prefix, left = routes(prints[lo : lo + 2000], prefix_bits, radius)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(prefix.astype(np.int64)), pa.array(left), pa.array(node[lo + row]),
                        pa.array(prints[lo + row].view(np.int64))
                    ],
                    names=["bucket", "left", "node", "print"]
                )

    return prints.mapInArrow(spread, schema).groupBy("bucket").applyInArrow(
        lambda t: bucket_links(t, prefix_bits, distance),
        "node long, to long"
    ).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each linked node reaches. links: node long, to long.

    Rounds of large-star and small-star contraction; each round is stored in the shared folder and
    ends when a round changes nothing. Hubs are joined on minima that were aggregated before the
    shuffle, so no task gathers a hub's neighbours.
    """
    edges = stored(
        links.where("node != to").select(F.greatest("node", "to").alias("a"), F.least("node", "to").alias("b")).distinct(),
        "links"
    )
    size = _digest(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # each node above its neighbours: they and the node itself go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        done = _digest(following)
        edges = following
        if done == size:
            break
        size = done
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of every row of docs with an id.

    Null, empty and wordless texts have fingerprint zero and link like any other. Rows that repeat an
    id each get a row: every text is fingerprinted, and the id stands in every component of its
    texts, which joins those components. Rows with a null id take no part: nothing could name
    them. Ids are whole numbers. An empty table gives an empty table. Other columns are not used.
    """
    schema = "doc long, print long"

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc"), pa.array(text_fingerprints(column(batch, "text"), shingle).view(np.int64))],
                names=["doc", "print"]
            )

    source = short_batches(docs).where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"),
        F.col(text_col).alias("text")
    )
    prints = stored(source.mapInArrow(hashed, schema), "fingerprints")
    nodes = stored(prints.groupBy("print").agg(F.min("doc").alias("node")), "nodes")
    # an id with several texts joins their components
    twice = prints.groupBy("doc").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a != b").limit(1).count() > 0
    links = near_links(nodes, distance=distance)
    if twice:
        links = links.union(prints.join(nodes, "print").where("doc != node").select(F.col("doc").alias("node"), F.col("node").alias("to")))
    found = components(links)
    if twice:
        named = prints.join(
            found.withColumnRenamed("node", "doc"),
            "doc",
            "left"
        ).withColumn("component_id", F.coalesce("component", "doc"))
    else:
        named = prints.join(
            nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id")),
            "print"
        )
    return named.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """docs without the rows whose component has a smaller id. Rows with a null id stay; of rows that repeat an id, all stay or none."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, distance=distance, shingle=shingle)
    (gone,) = fresh(docs, "_gone")
    lost = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(lost, docs[id_col] == lost[gone], "left_anti")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
