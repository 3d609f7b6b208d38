r"""SimHash near-dedup by similarity: ball hashing of several fingerprints, candidates verified by their exact shingles.

A fingerprint of all word shingles tells texts of similarity 0.8 apart by a seventh of its bits, too many for one
ball. So each text has several fingerprints of `bits` bits, independent of each other. Those of two texts meet if
any pair is at most 4 bits apart: every fingerprint stands for all its variants within 2 bits, which are
dealt by their leading bits and written out behind the shuffle (see simhash).

Fingerprints are as long as it takes for a text to meet few others by chance, and as many as it takes to miss a
pair of the wanted similarity with a probability of MISSED; both follow from the number of texts, so that chance
pairs grow with it and not with its square. Pairs that met are held apart by all their bits first; what is left is
verified by its shingles (64-bit hashes).

Equal texts are one node. Of a variant that up to SMALL nodes share, all pairs meet; of larger groups each node meets two
leaders for each of its fingerprints: of all nodes it shares such variants with, the least by number and the least by hash. No
group is gathered or written out as pairs, and links are thinned to a spanning forest where they are verified.

Leaders find what a crowd has in common, but not two texts that are like each other more than like the crowd, as copies among
pages of one template. So nodes of crowds also meet by their rarest shingles: two sets of the wanted similarity share one of the
first (rarest) fifth of each, at places that leave room for enough others in common (prefix and position filters). Of
template and text, the template's shingles are the frequent ones, so what meets is the copies.

What more than FEW nodes share among their rarest shingles is asked last, for nodes that nothing has connected so far: within
such a shingle all pairs of nodes of different components are compared, in blocks of bounded size, so that no pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh, packed, short_batches, slices, stored, unpacked
from .simhash import MOST_VARIANTS, _forest, _masks_within, components, routes
from .words import SPACED_LOWER, mixed, window_hashes, words

_U = np.uint64
#: Bits that meeting fingerprints differ by at most, and within which each writes out its variants.
APART, HALF = 4, 2
#: The probability to miss a pair of the wanted similarity.
MISSED = 0.003
#: Other texts that a fingerprint may meet by chance, on average.
BY_CHANCE = 2
#: Nodes sharing a variant that all meet each other.
SMALL = 4
#: Nodes of crowds that have one rare shingle in common and all meet each other; of more, those of different components do.
FEW = 128
#: Nodes of such a shingle that one task compares with as many others, on average.
BLOCK = 2048
#: Ids that are sent to the texts; of more, the texts are shuffled.
MOST_SENT = 4_000_000
#: Bytes of one Arrow batch: texts may be long, and a batch is held by both sides.
BATCH_BYTES = 4 << 20
#: Eight counters of one byte each: the bits of a byte apart.
_LANES = np.array([sum(1 << (8 * i) for i in range(8) if b >> (7 - i) & 1) for b in range(256)], _U)


def layout(n: int, least: float) -> tuple[int, int, int]:
    """(bits, fingerprints, bits that all fingerprints of a pair may differ by) for n texts and a similarity."""
    differ = math.acos(2 * least / (1 + least)) / math.pi  # the chance of one bit, for sets of equal size
    ball = lambda b: sum(math.comb(b, i) for i in range(APART + 1))
    bits = next(b for b in range(24, 65, 2) if b == 64 or n * ball(b) <= BY_CHANCE * 2**b)
    meet = sum(math.comb(bits, i) * differ**i * (1 - differ) ** (bits - i) for i in range(APART + 1))
    prints = max(1, math.ceil(math.log(MISSED) / math.log(1 - meet)))
    total = bits * prints
    return bits, prints, int(differ * total + 4 * math.sqrt(total * differ * (1 - differ)))


def shingles(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, hashes, first) of slices of texts: a 64-bit hash of all words of each, 0 without words; its distinct shingles,
    sorted, and where each text's begin.

    Words are split at white space, A-Z in lower case. A text of fewer words than width is one shingle.
    """
    for lo, hi in slices(texts, 2 << 20):
        found = words(texts[lo:hi], SPACED_LOWER)
        h = found.hashes()
        starts, long = window_hashes(h, found.first, width)
        at = np.searchsorted(starts, found.first).tolist()
        keys, sets = np.zeros(hi - lo, _U), []
        for i, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist())):
            if b > a:
                keys[i] = xxhash.xxh64_intdigest(h[a:b].tobytes())
            sets.append(np.unique(long[at[i] : at[i + 1]]) if b - a >= width else keys[i : i + 1] if b > a else keys[:0])
        yield keys, np.concatenate(sets) if sets else keys, np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def fingerprints(hashes: np.ndarray, first: np.ndarray, bits: int, prints: int) -> np.ndarray:
    """(rows, prints): the SimHashes of each row's shingles, from the top bit down; zero without shingles."""
    size = np.diff(first)
    rows = np.flatnonzero(size)
    out = np.zeros((len(size), prints), _U)
    if not len(rows):
        return out
    # a counter of a byte holds 255 shingles
    pieces = -(-size[rows] // 255)
    piece_first = np.cumsum(pieces) - pieces
    begins = np.repeat(first[:-1][rows], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(piece_first, pieces))
    votes = np.empty((len(rows), -(-bits * prints // 64), 8, 8), bool)
    for w in range(votes.shape[1]):
        octets = mixed(hashes ^ mixed(np.full(1, w + 1, _U))).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts = np.add.reduceat(_LANES[octets[:, j]], begins).view(np.uint8).reshape(-1, 8).astype(np.int32)
            votes[:, w, j] = np.add.reduceat(counts, piece_first, axis=0) * 2 > size[rows][:, None]
    flat = votes.reshape(len(rows), -1)[:, : bits * prints].reshape(len(rows), prints, bits)
    wide = np.zeros((len(rows), prints, 64), bool)
    wide[:, :, :bits] = flat
    out[rows] = np.packbits(wide, axis=2).view(">u8")[:, :, 0]
    return out


def _meeting(base: np.ndarray, row: np.ndarray, left: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, ...]]:
    """What shares a variant over the `low` lowest bits, at most 32: pairs (greater row << 32 | lesser row) of small groups;
    rows of large ones, each with its two leaders.
    """
    if len(base) < 2:
        return
    sizes = np.array([len(_masks_within(low, f)) for f in range(HALF + 1)])
    if sizes[left].sum() > MOST_VARIANTS and low > 3:
        bit = (base >> _U(low - 1)) & _U(1)
        for side in (0, 1):
            rest = left - (bit != side).astype(np.int8)
            keep = rest >= 0
            yield from _meeting(base[keep], row[keep], rest[keep], low - 1)
        return
    base = base & _U((1 << low) - 1)
    values = []
    for f in range(HALF + 1):
        of = np.flatnonzero(left == f)
        if len(of):
            values.append((((base[of, None] ^ _masks_within(low, f)[None, :]) << _U(32)) | row[of, None].astype(_U)).reshape(-1))
    values = np.sort(np.concatenate(values))
    variant = values >> _U(32)
    new = np.concatenate([[True], variant[1:] != variant[:-1]])
    shared = ~new | np.concatenate([~new[1:], [False]])
    if not shared.any():
        return
    row = (values[shared] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(new[shared])
    size = np.diff(np.append(first, len(row)))
    size, group = np.repeat(size, size), np.repeat(np.arange(len(first)), size)
    by_hash = np.minimum.reduceat(_hashed(row), first) & _U(0xFFFFFFFF)
    large = size > SMALL
    pairs = []
    for step in range(1, SMALL):
        i = np.flatnonzero((group[step:] == group[:-step]) & (size[step:] <= SMALL))
        pairs.append(row[i + step] << 32 | row[i])  # rows of a group ascend
    yield np.unique(np.concatenate(pairs)), row[large], row[first][group[large]], by_hash.astype(np.int64)[group[large]]


def _hashed(row: np.ndarray) -> np.ndarray:
    """Rows below a hash of 32 bits, so that the least value names the row of the least hash."""
    return (mixed(row.astype(_U)) & ~_U(0xFFFFFFFF)) | row.astype(_U)


def bucket_pairs(table: pa.Table, prefix: int, low: int) -> pa.Table:
    """Nodes (x, y) of which fingerprints of one bucket meet; of: y in small groups, else -1 or -2 and the fingerprint's number
    for the two leaders; rank: orders leaders.
    """
    blobs = table["entries"].to_pylist()
    parts = [unpacked(x, "V16") for x in blobs]
    entry = np.concatenate(parts).view(np.dtype([("no", "<i8"), ("low", "<u4"), ("left", "<i4")])) if parts else None
    if entry is None or len(entry) < 2:
        return pa.table({c: pa.array([], pa.int64()) for c in ("x", "of", "y", "rank")})
    entry = entry[np.argsort(entry["no"], kind="stable")]
    no = entry["no"]
    rows = np.arange(len(no))
    small, least, other = [np.zeros(0, np.int64)], rows.copy(), _hashed(rows)
    for pairs, row, lead, by_hash in _meeting(entry["low"].astype(_U), rows, entry["left"].astype(np.int8), low):
        small.append(pairs)
        np.minimum.at(least, row, lead)
        np.minimum.at(other, row, _hashed(by_hash))
    other = (other & _U(0xFFFFFFFF)).astype(np.int64)
    pairs = np.unique(np.concatenate(small))
    number = 2 * (table["bucket"][0].as_py() >> prefix)
    x, y = no[pairs >> 32], no[pairs & 0xFFFFFFFF]
    out = [(x, y, y, np.zeros_like(x))]
    for k, lead in ((1, least), (2, other)):
        led = np.flatnonzero(lead != rows)
        y = no[lead[led]]
        out.append((no[led], np.full(len(led), -k - number), y, y if k == 1 else mixed(y.astype(_U)).view(np.int64)))
    return pa.table({c: pa.array(np.concatenate(v)) for c, v in zip(("x", "of", "y", "rank"), zip(*out))})


def _thinned(links: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Links (a, b) with the same components: of so many at most of a task's links, a forest."""

    def forest():
        x, y = (np.concatenate([np.asarray(column(batch, c)) for batch in held]) for c in ("a", "b"))
        names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        root = _forest(len(names), iter([(at[: len(x)], at[len(x) :])]))
        other = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(names[root[other]])], names=["a", "b"])

    held, size = [], 0
    for batch in links:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield forest()
            held, size = [], 0
    if size:
        yield forest()


def _spread(batches: Iterator[pa.RecordBatch], bits: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints (no, prints) as packed entries of the buckets that their variants fall into: print number and prefix."""
    low = bits - prefix
    for batch in batches:
        no = np.asarray(column(batch, "no"))
        prints = np.frombuffer(b"".join(column(batch, "prints").to_pylist()), _U).reshape(len(no), -1)
        for k in range(prints.shape[1]):
            row, at, left = routes(prints[:, k], prefix, HALF)
            by = np.argsort(at, kind="stable")
            row, at = row[by], at[by]
            entry = np.empty(len(row), np.dtype([("no", "<i8"), ("low", "<u4"), ("left", "<i4")]))
            entry["no"], entry["left"] = no[row], left[by]
            entry["low"] = (prints[row, k] >> _U(64 - bits)) & _U((1 << low) - 1)
            edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
            blobs = [packed(entry[a:b].view("V16")) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(at)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array((at[edge] | _U(k << prefix)).astype(np.int64)), pa.array(blobs, pa.binary())],
                names=["bucket", "entries"]
            )


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _joined(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """pairs (a, b) with x and y: the value of each."""
    of = lambda key, name: side.select(F.col("no").alias(key), F.col(value).alias(name))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y")


def _filtered(pairs: DataFrame, judge, thin: bool = False) -> DataFrame:
    """The pairs that judge accepts by x and y; thin: only a forest of them, made in the same task."""

    def kept(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), _U) for v in column(batch, c)] for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array([judge(p, q) for p, q in zip(x, y)], pa.bool_()))

    return pairs.mapInArrow((lambda batches: _thinned(kept(batches))) if thin else kept, "a long, b long")


def counted(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (no, shingles) as (no, size, hash), one row for each shingle; and (hash, nodes) of the shingles of several nodes."""

    def each(batches):
        for batch in batches:
            held = [np.frombuffer(v.as_buffer(), np.int64) for v in column(batch, "shingles")]
            sizes = [len(x) for x in held]
            no = np.repeat(np.asarray(column(batch, "no")), sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(no), pa.array(np.repeat(np.array(sizes, np.int64), sizes)), pa.array(np.concatenate(held) if held else no)],
                names=["no", "size", "hash"]
            )

    shingle = sets.mapInArrow(each, "no long, size long, hash long")
    return shingle, stored(shingle.groupBy("hash").agg(F.count("*").alias("nodes")).where("nodes > 1"), "shared-shingles")


def _rarest(least: float):
    """How many of its shingles, from the rarest on, a node of `size` has to share one of with any other of similarity `least`."""
    return F.col("size") - F.ceil(F.col("size") * (least - 1e-9)) + 1


def rarest_places(shingle: DataFrame, shared: DataFrame, least: float) -> DataFrame:
    """(no, hash, size, nodes, at): the shared shingles among each node's rarest and their places in its order, by counted shingles.

    Shingles of one node only come first, so a place follows from how many shingles stand behind: each row is joined once, and no
    node's shingles are gathered.
    """
    behind = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("nodes"), F.desc("hash")))
    placed = shingle.join(shared, "hash").select("no", "hash", "size", "nodes", (F.col("size") - behind).alias("at"))
    return stored(placed.where(F.col("at") < _rarest(least)), "rarest-shingles")


def crowd_pairs(
    sets: DataFrame,
    least: float,
    few: int = FEW,
    counts: tuple[DataFrame, DataFrame] | None = None,
    places: DataFrame | None = None
) -> DataFrame:
    """(a, b), a > b: nodes (no, shingles) that can have a similarity of `least`, by their rarest shingles.

    Shingles are ordered by how many nodes have them. All pairs that share a shingle of at most `few` nodes among their rarest and
    pass both filters are found; what more nodes share is in frequent_places. counts: of counted(sets), places: of
    rarest_places(*counts, least), if made before.
    """
    first = (places or rarest_places(*(counts or counted(sets)), least)).where(F.col("nodes") <= few)
    x, y = (first.select("hash", *(F.col(c).alias(f"{c}_{side}") for c in ("no", "size", "at"))) for side in "xy")
    both = F.col("size_x") + F.col("size_y")
    room = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
    sized = F.least("size_x", "size_y") >= F.greatest("size_x", "size_y") * (least - 1e-9)
    fits = (F.col("no_x") > F.col("no_y")) & sized & (room >= both * (least / (1 + least) - 1e-9))
    return x.join(y, "hash").where(fits).select(F.col("no_x").alias("a"), F.col("no_y").alias("b")).distinct()


def frequent_places(shingle: DataFrame, shared: DataFrame, least: float, few: int = FEW, places: DataFrame | None = None) -> DataFrame | None:
    """(no, hash, size, at) of shingles of more than `few` nodes that are among a node's rarest, and their places in its order, by
    counted shingles; None without any. Two nodes of similarity `least` that share none of them are among crowd_pairs.
    """
    frequent = (places or rarest_places(shingle, shared, least)).where(F.col("nodes") > few)
    return None if frequent.isEmpty() else frequent.select("no", "hash", "size", "at")


def apart_pairs(places: DataFrame, nodes: DataFrame, found: DataFrame, least: float, differ: int, block: int = BLOCK) -> DataFrame:
    """(a, b), a > b: nodes of different components (found: node, component; others stand alone) that share one of the places
    (see frequent_places), pass the filters of crowd_pairs and have fingerprints (nodes: no, prints) at most `differ` bits apart.

    The nodes of a shingle's largest component are compared with its other nodes only. Both kinds are dealt into blocks; a task
    compares two of them, and all pairs of blocks are compared but two of the largest component.
    """
    of = found.select(F.col("node").alias("no"), "component")
    each = places.join(of, "no", "left").withColumn("component", F.coalesce("component", "no"))
    size = each.groupBy("hash", "component").agg(F.count("*").alias("n")).groupBy("hash").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("inside"), (F.sum("n") - F.max("n")).alias("outside")
    ).where("outside > 0")
    each = each.join(size, "hash").join(nodes.select("no", "prints"), "no")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    each = each.withColumns({"o": blocks("outside"), "all": blocks("outside") + blocks("inside"), "main": F.col("component") == F.col("main")})
    own = F.when(F.col("main"), F.col("o") + F.pmod(F.xxhash64("no"), F.col("all") - F.col("o"))).otherwise(F.pmod(F.xxhash64("no"), F.col("o")))
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("o")).otherwise(F.col("all")) - 1))
    each = each.withColumn("own", own.cast("int")).withColumn("other", others)
    each = each.select(
        "hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "no", "size", "at", "component", "prints"
    )

    def compared(t: pa.Table) -> pa.Table:
        no, size, at, component, own = (np.asarray(t[c]) for c in ("no", "size", "at", "component", "own"))
        prints = np.frombuffer(b"".join(t["prints"].to_pylist()), _U).reshape(len(no), -1)
        x, y = np.flatnonzero(own == t["i"][0].as_py()), np.flatnonzero(own == t["j"][0].as_py())
        out = [np.zeros((2, 0), np.int64)]
        step = max(1, (1 << 17) // max(1, len(y)))
        for lo in range(0, len(x), step):
            p = x[lo : lo + step, None]
            fits = component[p] != component[y]
            if t["i"][0].as_py() == t["j"][0].as_py():
                fits &= no[p] > no[y]
            fits &= np.minimum(size[p], size[y]) >= np.maximum(size[p], size[y]) * (least - 1e-9)
            fits &= np.minimum((size - at)[p], (size - at)[y]) >= (size[p] + size[y]) * (least / (1 + least) - 1e-9)
            r, c = np.nonzero(fits)
            r, c = x[lo : lo + step][r], y[c]
            bits = np.zeros(len(r), np.int64)
            for k in range(prints.shape[1]):
                bits += np.bitwise_count(prints[r, k] ^ prints[c, k])
            near = bits <= differ
            out.append(np.stack([no[r[near]], no[c[near]]]))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return each.groupBy("hash", "i", "j").applyInArrow(compared, "a long, b long").distinct()


def near_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    least: float = 0.8,
    few: int = FEW
) -> DataFrame:
    """(doc, component): the least id that each id is linked to by texts of similarity `least` and more.

    Texts without words are equal. Rows with a null id take no part; an id with several texts joins their components.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    source = short_batches(docs).where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"),
        F.col(text_col).alias("text")
    )
    n = source.count()
    bits, prints, differ = layout(n, least)
    prefix = max(6, n.bit_length() - 12, bits - 32)

    def hashed(batches):
        for batch in batches:
            doc, at = column(batch, "doc"), 0
            for keys, h, first in shingles(column(batch, "text"), width):
                found = [row.tobytes() for row in fingerprints(h, first, bits, prints)]
                yield pa.RecordBatch.from_arrays(
                    [doc[at : at + len(keys)], pa.array(keys.view(np.int64)), pa.array(found, pa.binary())],
                    names=["doc", "key", "prints"]
                )
                at += len(keys)

    def gathered(batches):
        for batch in batches:
            for keys, h, first in shingles(column(batch, "text"), width):
                sets = [h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sets, pa.binary())], names=["key", "shingles"])

    each = stored(source.mapInArrow(hashed, "doc long, key long, prints binary"), "fingerprints")
    texts = each.select("doc", "key")
    # equal texts have equal fingerprints, so one row of each is enough
    nodes = each.groupBy("key").agg(F.min("doc").alias("node"), F.first("prints").alias("prints"))
    nodes = stored(nodes.withColumn("no", F.monotonically_increasing_id()), "nodes")
    # a text without words has no shingles to be like another's
    dealt = nodes.where("key != 0").select("no", "prints").mapInArrow(lambda b: _spread(b, bits, prefix), "bucket long, entries binary")
    met = dealt.groupBy("bucket").applyInArrow(lambda t: bucket_pairs(t, prefix, bits - prefix), "x long, of long, y long, rank long")
    met = stored(met.groupBy("x", "of").agg(F.min_by("y", "rank").alias("y")), "met")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(no, shingles) of nodes (no)."""
        named = wanted.join(nodes.select("no", "key", "node"), "no")
        ids = stored(named.select(F.col("node").alias("doc")).distinct(), "ids")
        if ids.count() <= MOST_SENT:
            ids = F.broadcast(ids)
        found = source.join(ids, "doc", "left_semi").mapInArrow(gathered, "key long, shingles binary")
        return stored(found.join(named.select("key", "no"), "key").dropDuplicates(["no"]).select("no", "shingles"), "shingles")

    led = met.where("of < 0")
    crowd = led.select(F.col("x").alias("no")).union(led.select("y")).distinct()
    met = met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    places = None
    if not led.isEmpty():
        crowd = sets_of(crowd)
        counts = counted(crowd)
        rarest = rarest_places(*counts, least)
        met = met.union(crowd_pairs(crowd, least, few, counts, rarest))
        places = frequent_places(*counts, least, few, rarest)
    near = lambda x, y: int(np.bitwise_count(x ^ y).sum()) <= differ
    pairs = stored(_filtered(_joined(met.distinct(), nodes, "prints"), near), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("no")).union(pairs.select("b")).distinct())
    same = lambda x, y: similarity(x, y) >= least
    alike = _filtered(_joined(pairs, sets, "shingles"), same, thin=True)
    if places is not None:
        alike = stored(alike, "alike")
        found = components(alike.select(F.col("a").alias("node"), F.col("b").alias("to")))
        apart = stored(apart_pairs(places, nodes, found, least, differ), "apart")
        alike = alike.union(_filtered(_joined(apart, crowd, "shingles"), same, thin=True))
    of = lambda key, name: nodes.select(F.col("no").alias(key), F.col("node").alias(name))
    links = alike.join(of("a", "node"), "a").join(of("b", "to"), "b").select("node", "to")

    twice = texts.groupBy("doc").agg(F.min("key").alias("p"), F.max("key").alias("q")).where("p != q").limit(1).count() > 0
    if twice:
        links = links.union(texts.join(nodes, "key").where("doc != node").select(F.col("doc").alias("node"), F.col("node").alias("to")))
        found = components(links).withColumnRenamed("node", "doc")
        return texts.select("doc").distinct().join(found, "doc", "left").select("doc", F.coalesce("component", "doc").alias("component"))
    found = nodes.select("key", "node").join(components(links), "node", "left")
    return texts.join(found.select("key", F.coalesce("component", "node").alias("component")), "key").select("doc", "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """docs without the rows whose component has a smaller id. Rows with a null id stay; of rows that repeat an id, all stay or none."""
    (gone,) = fresh(docs, "_gone")
    lost = near_copies(
        docs,
        id_col=id_col,
        text_col=text_col,
        width=width,
        least=least
    ).where("doc != component").select(F.col("doc").alias(gone)).distinct()
    return docs.join(lost, docs[id_col] == lost[gone], "left_anti")
