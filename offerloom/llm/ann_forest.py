r"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product. With one more component, sqrt(M * M - |x| * |x|) for the largest
norm M, all vectors are of one length, so the largest inner product is the smallest angle to a query
that has zero there. Trees split by the hyperplane between two random vectors of a sample.

The trees are fitted on a bounded sample; every vector is then routed to one leaf of each tree. A query
takes the leaves of all trees from one priority queue, ordered by the largest margin on the way. That
margin never falls from a node to its children, so the queue yields leaves in ascending order of it: a
whole batch of queries gets its order from one pass over the nodes. A query stops when it has seen
enough leaves: as many as held the wanted share of true neighbours for queries of the sample.

Vectors and queries meet by leaf in a shuffle, in parts of bounded size: small leaves share a part,
large ones are split over several, and queries come in blocks. Leaf candidates are reranked by single-precision
products with a bound on their error; whatever could be among the best is scored in double precision.

Equal vectors are gathered first: a query with k neighbours never needs more than the k + 1 least ids of one
vector, so no leaf fills up with copies, and no neighbour is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_rows, stored

#: The trees are fitted on so many distinct vectors at most (chosen by hash); the number of leaves to visit on so many of them.
SAMPLE, TRIALS = 65_536, 128
TREES, LEAF = 2, 256
#: The share of true neighbours that the visited leaves are to hold, on the sample.
RECALL = 0.925
#: Vectors of one part and queries of one block at most, on average: a group of the shuffle holds one of each.
PART, QUERY_BLOCK = 32_768, 8192
#: Products that a task holds at once.
PRODUCTS = 4 << 20


@dataclass
class Forest:
    """normal, offset: of inner nodes; children: node numbers, leaves as -1 - number; roots: of each tree; extra: M squared."""

    normal: np.ndarray
    offset: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaves: int
    norm2: float


def _lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], 1)


def fit(sample: np.ndarray, norm2: float, trees: int, leaf: int, seed: int = 7) -> Forest:
    rng = np.random.default_rng(seed)
    points = _lifted(sample.astype(np.float64), norm2)
    normal, offset, children, roots = [], [], [], []
    leaves = 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(4):
                # between the means of two small random groups
                some = rng.choice(rows, min(len(rows), 8), replace=False)
                half = len(some) // 2
                a, b = points[some[0]], points[some[half]]
                for _ in range(3):
                    near = ((points[some] - a) ** 2).sum(1) <= ((points[some] - b) ** 2).sum(1)
                    if near.all() or not near.any():
                        break
                    a, b = points[some[near]].mean(0), points[some[~near]].mean(0)
                w = a - b
                length = np.sqrt((w * w).sum())
                if length == 0:
                    continue
                w /= length
                side = points[rows] @ w
                t = float(w @ (a + b) / 2)
                if min((side < t).sum(), (side >= t).sum()) < len(rows) // 10:
                    t = float(np.median(side))
                below = side < t
                if below.any() and not below.all():
                    n = len(normal)
                    normal.append(w)
                    offset.append(t)
                    children.append([0, 0])
                    children[n] = [split(rows[below]), split(rows[~below])]
                    return n
        leaves += 1
        return -leaves

    for _ in range(trees):
        roots.append(split(np.arange(len(points))))
    dims = sample.shape[1] + 1
    return Forest(np.array(normal).reshape(-1, dims), np.array(offset), np.array(children).reshape(-1, 2), np.array(roots), leaves, norm2)


def route(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """The leaf of every vector in every tree, as an array (vectors, trees)."""
    points = _lifted(vectors, forest.norm2)
    out = np.empty((len(points), len(forest.roots)), np.int64)
    for t, root in enumerate(forest.roots):
        node = np.full(len(points), root)
        while (active := np.flatnonzero(node >= 0)).size:
            at = node[active]
            right = (points[active] * forest.normal[at]).sum(1) >= forest.offset[at]
            node[active] = forest.children[at, right.astype(np.int64)]
        out[:, t] = -1 - node
    return out


def queue(forest: Forest, queries: np.ndarray) -> np.ndarray:
    """The leaves of all trees in the order in which one priority queue yields them, as an array (queries, leaves)."""
    length = np.sqrt((queries * queries).sum(1))
    margins = forest.normal[:, :-1] @ (queries * (np.sqrt(forest.norm2) / length)[:, None]).T - forest.offset[:, None]
    far = np.full((len(forest.normal), len(queries)), -np.inf)
    leaves = np.full((forest.leaves, len(queries)), -np.inf)
    for n, (left, right) in enumerate(forest.children.tolist()):  # parents stand before their children
        for child, margin in ((left, margins[n]), (right, -margins[n])):
            np.maximum(far[n], margin, out=far[child] if child >= 0 else leaves[-1 - child])
    return np.argsort(leaves.T, axis=1, kind="stable")


def enough_visits(forest: Forest, sample: np.ndarray, k: int, recall: float, trials: int = TRIALS, seed: int = 11) -> int:
    """Leaves to visit so that they hold this share of the k nearest, for queries of the sample against all of it."""
    n = len(sample)
    if n <= k + 1 or not len(forest.normal):
        return forest.leaves
    rows = np.random.default_rng(seed).choice(n, min(trials, n), replace=False)
    cells = route(forest, sample)
    order = queue(forest, sample[rows])
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(forest.leaves)[None, :], axis=1)
    needed = []
    for lo in range(0, len(rows), 16):
        scores = sample[rows[lo : lo + 16]] @ sample.T
        scores[np.arange(len(scores)), rows[lo : lo + 16]] = -np.inf
        near = np.argpartition(-scores, k, axis=1)[:, :k]
        needed += [place[lo + i][cells[own]].min(1) for i, own in enumerate(near)]
    return int(np.quantile(np.concatenate(needed), recall, method="higher")) + 1


@dataclass
class Parts:
    """first, split: of each leaf, the number of its first part and how many parts it is split over; count: of all parts."""

    first: np.ndarray
    split: np.ndarray
    count: int


def parted(sizes: np.ndarray, most: int) -> Parts:
    """Parts of about `most` vectors: neighbouring small leaves share one, large ones are split."""
    split = np.maximum(1, -(-sizes // most)).astype(np.int64)
    first = np.zeros(len(sizes), np.int64)
    part, held = 0, 0
    for i, (n, over) in enumerate(zip(sizes.tolist(), split.tolist())):
        if held and held + n > most:
            part, held = part + 1, 0
        first[i] = part
        held += n
        if over > 1:
            part, held = part + over, 0
    return Parts(first, split, part + (held > 0))


def _matrix(values: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return np.asarray(values.flatten()).reshape(-1, dims)


def _best(query: np.ndarray, node: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best nodes of each query, each node once."""
    by = np.lexsort((node, -score, query))
    query, node, score = query[by], node[by], score[by]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (node[1:] != node[:-1])  # a node has one score, so its repeats are neighbours
    query, node, score = query[new], node[new], score[new]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[place < k], node[place < k], score[place < k]


def _scaled(x: np.ndarray, each: bool) -> np.ndarray:
    """x in single precision, divided by its norms or by the largest of them: only the scale of products changes."""
    norm = np.sqrt((x * x).sum(1))
    return (x / (norm[:, None] if each else norm.max(initial=1e-300))).astype(np.float32)


def _rerank(vectors: pa.Table, queries: pa.Table, dims: int, k: int) -> pa.Table:
    """The k nearest of one part's vectors for each query of a block."""
    cells, ids = np.asarray(vectors["cell"]), np.asarray(vectors["node"])
    by = np.lexsort((ids, cells))
    cells, ids = cells[by], ids[by]
    x = _matrix(vectors["vector"], dims)[by].astype(np.float64)
    q, q_ids = _matrix(queries["vector"], dims).astype(np.float64), np.asarray(queries["node"])
    x_small, q_small = _scaled(x, False), _scaled(q, True)
    slack = np.float32(2 * (dims + 8) * 2.0**-23)  # products of norms below 1, each off by half of that at most
    leaf, first = np.unique(cells, return_index=True)
    stop = np.append(first[1:], len(cells))
    wanted = queries["cells"].combine_chunks()
    found = []
    step = max(1, PRODUCTS // max(1, len(x)))
    for lo in range(0, len(q) if len(x) else 0, step):
        part = wanted[lo : lo + step]
        asking, cell = np.asarray(part.value_parent_indices()), np.asarray(part.flatten())
        at = np.minimum(np.searchsorted(leaf, cell), len(leaf) - 1)
        there = leaf[at] == cell
        asking, at = asking[there], at[there]
        q_by = np.argsort(at, kind="stable")
        asking, at = asking[q_by], at[q_by]
        rough = np.full((len(part), len(x)), -np.inf, np.float32)
        edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
        for a, b in zip(edge, np.append(edge[1:], len(at))):
            rows, i, j = asking[a:b], first[at[a]], stop[at[a]]
            rough[rows, i:j] = q_small[lo + rows] @ x_small[i:j].T
        if len(x) > k:
            least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
            rough[rough < (least - slack)[:, None]] = -np.inf
        row, col = np.nonzero(rough > -np.inf)
        # summed in the same order for every pair: equal vectors have equal scores
        scores = np.concatenate(
            [(q[lo + row[m : m + 65_536]] * x[col[m : m + 65_536]]).sum(-1) for m in range(0, max(1, len(row)), 65_536)]
        )
        found.append(_best(q_ids[lo + row], ids[col], scores, k))
    cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table([pa.array(c) for c in cols], names=["query", "node", "score"])


def usable(vectors: DataFrame, id_col: str, vector_col: str, dims: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and the number of components: by default that of most rows."""
    v = F.col(vector_col)
    if dims is None:
        common = vectors.where(F.size(v) > 0).groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").head()
        dims = common["n"] if common else 1
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")), dims


def nearest(
    vectors: DataFrame, is_query, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, leaf: int = LEAF, visits: int | None = None, recall: float = RECALL, sample: int = SAMPLE,
    dims: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row where the column is_query holds, all other rows being candidates.

    Nearest first, equal scores by vec_id; fewer rows if there are fewer candidates. Vectors that are null, zero, of
    another number of components, or that hold null or non-finite components take no part, nor do rows without an
    id. Of rows that repeat an id, each counts with its own vector; a row is never a neighbour of its own id.
    An empty table has no result. Other columns are not used.
    """
    spark = vectors.sparkSession
    rows, dims = usable(vectors, id_col, vector_col, dims)
    same = Window.partitionBy("vector").orderBy("vec_id")
    distinct = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).groupBy("vector").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")
    )
    # a vector's number: its least id is not enough, for an id may repeat
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(is_query(F.col("vec_id"))).distinct().join(distinct.select("vector", "node"), "vector").select(
        F.col("vec_id").alias("query_id"),
        F.col("node").alias("query")
    )
    asked = stored(asked, "queries")

    square = F.aggregate("vector", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm2 = distinct.agg(F.max(square)).head()[0] or 1.0
    picked = distinct.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(sample).select("vector").toArrow()
    points = _matrix(picked["vector"], dims) if picked.num_rows else np.zeros((0, dims), np.float32)
    fitted = fit(points, float(norm2), trees, leaf)
    visits = visits or enough_visits(fitted, points.astype(np.float64), k, recall)
    total, n_queries = distinct.count(), asked.select("query").distinct().count()
    sizes = np.bincount(
        route(fitted, points.astype(np.float64)).reshape(-1),
        minlength=fitted.leaves
    ) * max(1, total) // max(1, len(points))
    # the number of parts only spreads the work: no result depends on it
    parts = parted(sizes, min(PART, max(LEAF, total * trees // (2 * spark.sparkContext.defaultParallelism))))
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    held = spark.sparkContext.broadcast((fitted, parts))  # bounded by the sample

    def indexed(batches: Iterator[pa.RecordBatch]):
        forest, parts = held.value
        for batch in batches:
            cells = route(forest, _matrix(column(batch, "vector"), dims).astype(np.float64))
            node = np.asarray(column(batch, "node"))
            for t in range(cells.shape[1]):
                cell = cells[:, t]
                part = (parts.first[cell] + node % parts.split[cell]) * blocks
                for block in range(blocks):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part + block), pa.array(cell), column(batch, "node"), column(batch, "vector")],
                        names=["part", "cell", "node", "vector"]
                    )

    def searched(batches: Iterator[pa.RecordBatch]):
        forest, parts = held.value
        for batch in batches:
            x, node = _matrix(column(batch, "vector"), dims).astype(np.float64), np.asarray(column(batch, "node"))
            for lo in range(0, len(x), 1024):
                cell = np.sort(queue(forest, x[lo : lo + 1024])[:, :visits], axis=1)
                row = np.repeat(np.arange(len(cell)), cell.shape[1])
                cell = cell.reshape(-1)
                over = parts.split[cell]
                row, cell, part = np.repeat(row, over), np.repeat(cell, over), np.repeat(parts.first[cell], over) + np.arange(over.sum()) - np.repeat(
                    np.cumsum(over) - over,
                    over
                )
                by = np.lexsort((cell, part, row))
                row, cell, part = row[by], cell[by], part[by]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(cell)).astype(np.int32)), pa.array(cell))
                row = lo + row[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[first] * blocks + node[row] % blocks), lists, pa.array(node[row]),
                        column(batch, "vector").take(pa.array(row))
                    ],
                    names=["part", "cells", "node", "vector"]
                )

    kind = rows.schema["vector"].dataType.simpleString()
    index = distinct.select("node", "vector").mapInArrow(indexed, f"part long, cell long, node long, vector {kind}")
    seen = distinct.join(
        asked.select(F.col("query").alias("node")).distinct(),
        "node",
        "left_semi"
    ).select("node", "vector").mapInArrow(searched, f"part long, cells array<long>, node long, vector {kind}")
    near = index.groupBy("part").cogroup(seen.groupBy("part")).applyInArrow(
        lambda v, q: _rerank(v, q, dims, k + 1),
        "query long, node long, score double"
    )

    order = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    named = near.distinct().join(distinct.select("node", "ids", F.col("ids")[0].alias("least")), "node")
    best = named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    each = asked.join(best, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), lambda i: i % 20 == 0, k=20)
