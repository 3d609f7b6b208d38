"""Helpers that every training-data operator shares: the shared folder, file systems and Arrow batches."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Text bytes that one vectorised step takes at most (one longer text is still taken whole).
SLICE_BYTES = 6 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir.

    A session without that setting gets a folder of this machine if it runs on this machine alone, else an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(file system, path) of a URI; s3, gs, hdfs and mounted folders alike."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def short_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """df, with Arrow batches of its session bounded to so many rows: texts may be long, and a batch is held whole by both sides."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key, None) or 10_000) > rows:
        conf.set(key, rows)
    return df


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes in a column, to size buckets by; one column is read."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("n")).head()["n"] or 0)


def range_number(value, bounds: list[int]):
    """How many of the sorted bounds are below a value (0 for null): searched in two steps over constant arrays."""
    step = max(1, math.isqrt(len(bounds)))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    if not bounds:
        return F.lit(0)
    # in an array, so that the first step is made once
    fine = F.split(F.lit(";".join(",".join(map(str, c)) for c in chunks)), ";")
    below = lambda x: F.size(F.filter(x, lambda b: b < value))
    both = lambda n: n * step + F.coalesce(below(F.split(F.try_element_at(fine, n + 1), ",").cast("array<bigint>")), F.lit(0))
    number = F.transform(
        F.array(below(array([c[-1] for c in chunks]))),
        lambda n: F.when(n < len(chunks), both(n)).otherwise(len(bounds))
    )[0]
    return F.when(value.isNull(), 0).otherwise(number).cast("int")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that df's columns don't use, for columns that an operator needs meanwhile."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array that hold at most limit bytes each, one row at least."""
    ends = offsets_of(texts)
    lo, n = 0, len(texts)
    total = int(ends[-1] - ends[0])
    limit = -(-total // max(1, -(-total // limit)))  # even parts
    while lo < n:
        hi = int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def offsets_of(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], dtype=kind)[
        texts.offset : texts.offset + len(texts) + 1
    ].astype(np.int64) if len(texts) else np.zeros(1, np.int64)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def packed(values: np.ndarray) -> bytes:
    """Fixed-width values, byte planes apart, compressed: sorted or small values take few bytes."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of bounded rows and bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], ddl: str) -> DataFrame:
    """mapInArrow with a generator of row tuples."""
    schema = arrow_schema(ddl)
    return df.mapInArrow(lambda batches: in_batches(rows(batches), schema), ddl)
