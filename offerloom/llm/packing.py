r"""Packing token ids into sequences of bounded length by multiway Karmarkar-Karp differencing.

A document gives full sequences while it lasts; the tails that are left are packed block by block,
as the scan delivers them, so nothing is shuffled. In a block, differencing merges the two partial
partitions of the largest imbalance, the fullest windows of one with the emptiest of the other,
until one partition into k near-equal windows is left. A block takes as many tokens as k windows hold, by a
cut through its last tail, so windows come out full but for a few tokens more or less. One more window would keep
every tail whole at the price of a whole window's padding; with cuts, the few tokens too many go to
windows that lack a few. What a scan has left at its end fills sequences of exactly a power of two of tokens, which
need no padding. Without cuts (cut=False) the count rises by one and differencing begins again, until every window fits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_rows, short_batches
from .encoder import encoded, public_tokenizer, shared_encoder

#: (item, from, length)
Piece = tuple[int, int, int]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers in k windows of near-equal sums."""
    # a partial partition: windows that hold something, fullest first, as (sum, items)
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            # the fullest of one with the emptiest of the other; windows beyond the overlap meet empty ones
            low_a, low_b = len(a) - over, len(b) - over
            merged = a[:low_a] + b[:low_b] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[low_a:], reversed(b[low_b:]))]
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, turn, merged))
        turn += 1
    windows = [w[1] for w in heap[0][2]] if heap else []
    return windows + [[] for _ in range(k - len(windows))]


def pack_block(sizes: list[int], capacity: int, cut: bool = True) -> list[list[Piece]]:
    """Sequences of pieces that hold every token of every item once. Items are at most the capacity.

    With cuts nothing is padded: see cut_block and powers_of_two. Without, as few near-equal windows as hold all items whole.
    """
    if cut:
        windows, taken, part = cut_block(sizes, capacity)
        return windows + [
            [(taken + i, at + part * (i == 0), n) for i, at, n in w] for w in powers_of_two(_rest(sizes, taken, part), capacity)
        ]
    k = -(-sum(sizes) // capacity)
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [[(i, 0, sizes[i]) for i in w] for w in windows if w]
        k += 1


def _rest(sizes: list[int], taken: int, part: int) -> list[int]:
    return [n - part * (i == 0) for i, n in enumerate(sizes[taken:])]


def cut_block(sizes: list[int], capacity: int) -> tuple[list[list[Piece]], int, int]:
    """(full windows of pieces, number of items they take whole, tokens they take of the next one).

    As many windows as all items would fill, near-equal by differencing; only what exceeds a window's
    capacity is cut off, and goes to the windows with the most room.
    """
    k = sum(sizes) // capacity
    taken, part = 0, k * capacity
    while taken < len(sizes) and sizes[taken] <= part:
        part -= sizes[taken]
        taken += 1
    items = sizes[:taken] + [part] * (part > 0)
    out: list[list[Piece]] = []
    over: list[Piece] = []
    rooms: list[tuple[int, int]] = []
    for n, window in enumerate(differencing(items, k)):
        room, pieces = capacity, []
        for i in sorted(window, key=items.__getitem__):  # the largest is cut
            take = min(items[i], room)
            if take:
                pieces.append((i, 0, take))
                room -= take
            if take < items[i]:
                over.append((i, take, items[i] - take))
        out.append(pieces)
        if room:
            rooms.append((room, n))
    rooms.sort()
    for i, at, left in over:
        while left:
            room, n = rooms.pop()
            take = min(left, room)
            out[n].append((i, at, take))
            at, left = at + take, left - take
            if take < room:
                rooms.append((room - take, n))
    return out, taken, part


def powers_of_two(sizes: list[int], capacity: int) -> list[list[Piece]]:
    """All tokens of the items, one item after the other, in sequences of exactly a power of two, at most the capacity each."""
    out, rest = [], [(i, 0, n) for i, n in enumerate(sizes)][::-1]
    left = sum(sizes)
    while left:
        length = room = min(1 << left.bit_length() - 1, 1 << capacity.bit_length() - 1)
        left -= length
        out.append([])
        while room:
            i, at, n = rest.pop()
            take = min(n, room)
            out[-1].append((i, at, take))
            room -= take
            if take < n:
                rest.append((i, at + take, n - take))
    return out


def _pack(
    batches: Iterator[pa.RecordBatch],
    tokenizer: str,
    end_id: int,
    capacity: int,
    block_windows: int,
    cut: bool = True
) -> Iterator[tuple]:
    encoder = shared_encoder(tokenizer)
    end = np.array([end_id], "<u4").tobytes()
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 33
    held: list[tuple] = []
    waiting = 0

    def flush(last: bool):
        nonlocal sequence, held, waiting
        sizes = [len(h[1]) // 4 for h in held]
        if last or not cut:
            windows, taken, part = pack_block(sizes, capacity, cut), len(held), 0
        else:
            windows, taken, part = cut_block(sizes, capacity)
        for pieces in windows:
            offset = 0
            for i, a, n in pieces:
                doc, ids, before, total = held[i]
                yield doc, before + a, n, ids[4 * a : 4 * (a + n)], total, sequence, offset
                offset += n
            sequence += 1
        held = held[taken:]
        if part:
            doc, ids, before, total = held[0]
            held[0] = doc, ids[4 * part :], before + part, total
        waiting = sum(len(h[1]) // 4 for h in held)

    for batch in batches:
        for doc, ids in zip(column(batch, "doc").to_pylist(), encoded(column(batch, "text"), encoder)):
            ids += end
            total = len(ids) // 4
            full = total // capacity * capacity
            for a in range(0, full, capacity):
                yield doc, a, capacity, ids[4 * a : 4 * (a + capacity)], total, sequence, 0
                sequence += 1
            if full < total:
                held.append((doc, ids[4 * full :], full, total))
                waiting += total - full
            if waiting >= block_windows * capacity:
                yield from flush(False)
    if held:
        yield from flush(True)


def pack(
    docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096, block_windows: int = 128,
    cut: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents: the id column, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each document is its ids and end_id. Documents longer than a sequence are cut; others only with cut. A null or empty text is
    one token, its end_id. Rows that repeat an
    id, or have none, are packed one by one like any other. Sequences never hold more than `capacity` tokens;
    offsets in a sequence run from 0 without gaps. sequence_id: the task's number in the upper bits, then a
    count. An empty table gives an empty table; other columns are not used.
    """
    tokenizer = tokenizer or public_tokenizer()
    source = short_batches(docs).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    out = map_rows(
        source, lambda b: _pack(b, tokenizer, end_id, capacity, block_windows, cut),
        f"doc {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
    )
    return out.withColumnRenamed("doc", id_col)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
