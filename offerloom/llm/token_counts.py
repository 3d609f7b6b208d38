r"""Token counts of flat, unindexed token files by a separator scan.

Files are nothing but ids of a fixed width. They are read in blocks; in each block one vectorised
comparison finds the end-of-document ids. A document may begin blocks earlier: a prefix scan over a
file's blocks (running sums and maxima in window functions) gives each block the documents before it
and the place where its first document began.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, map_rows, open_fs, shared_dir, short_batches
from .encoder import encoded, public_tokenizer, shared_encoder

#: Bytes of one block; any multiple of the id width.
BLOCK_BYTES = 4 << 20
#: A scan task begins a new file beyond so many bytes.
FILE_BYTES = 512 << 20


def write_flat(
    docs: DataFrame, folder: str, *, tokenizer: str | None = None, eod: int | None = None, text_col: str = "text",
    file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Flat files of unsigned 16-bit ids, eod (by default the tokenizer's last id, its end-of-text token) behind each document.

    Each scan task writes its own files under temporary names and renames them. Special tokens' strings in a
    text are ordinary text, so eod never stands inside a document. Null and empty texts are eod alone.
    Returns the files that count: file (number), name, bytes; files of lost tasks are not among them.
    """
    tokenizer = tokenizer or public_tokenizer()
    eod = shared_encoder(tokenizer).tokenizer.get_vocab_size() - 1 if eod is None else eod
    if eod >= 1 << 16:
        raise ValueError("ids of more than 16 bits")

    def files(batches):
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        encoder = shared_encoder(tokenizer, special_as_text=True)
        file = TaskContext.get().partitionId() << 12
        f, name, size = None, "", 0
        end = np.array([eod], "<u2").tobytes()
        for batch in batches:
            for ids in encoded(column(batch, "text"), encoder):
                if f is None:
                    name, size = f"flat-{file:08d}-{uuid.uuid4().hex[:8]}.u16", 0
                    f = fs.open_output_stream(f"{root}/_{name}.tmp")
                data = np.frombuffer(ids, "<u4").astype("<u2").tobytes() + end
                f.write(data)
                size += len(data)
                if size >= file_bytes:
                    f.close()
                    fs.move(f"{root}/_{name}.tmp", f"{root}/{name}")
                    yield file, name, size
                    f, file = None, file + 1
        if f is not None:
            f.close()
            fs.move(f"{root}/_{name}.tmp", f"{root}/{name}")
            yield file, name, size

    spark = docs.sparkSession
    written = map_rows(  # one row a file
        short_batches(docs).select(F.col(text_col).alias("text")),
        files,
        "file long, name string, bytes long"
    ).collect()
    return spark.createDataFrame([tuple(r) for r in written], "file long, name string, bytes long")


def count_tokens(files: DataFrame, folder: str, eod: int, *, block_bytes: int = BLOCK_BYTES, width: int = 2) -> DataFrame:
    """Documents of flat files: file, doc_no (from 0 in its file), start (ids before it), n_tokens (without eod), terminated.

    files: file (number), name, bytes. Ids behind the last eod are a document that is not terminated. An empty
    file has no documents; two eod in a row hold an empty one. bytes must be a multiple of the width.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    blocks = files.where("bytes > 0").withColumn(
        "offset",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block_bytes).cast("long")))
    )
    blocks = blocks.withColumn(
        "size",
        F.least(F.lit(block_bytes).cast("long"), F.col("bytes") - F.col("offset"))
    ).repartition("file", "offset")

    def scan(batches):
        fs, root = open_fs(folder)
        for batch in batches:
            for file, name, total, offset, size in zip(
                *(column(batch, c).to_pylist() for c in ("file", "name", "bytes", "offset", "size"))
            ):
                with fs.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(size, offset), kind)
                if len(ids) * width != size:
                    raise ValueError(f"{name} is shorter than {offset + size} bytes")
                ends = np.flatnonzero(ids == eod) + offset // width
                yield file, offset // width, total // width, len(ends), ends[-1] + 1 if len(ends) else None, ends.tolist()

    found = map_rows(blocks, scan, "file long, first long, total long, n_ends long, next long, ends array<long>")
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("first").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    stitched = found.withColumns(
        {
            "docs": F.coalesce(F.sum("n_ends").over(before), F.lit(0)),
            "begin": F.coalesce(F.max("next").over(before), F.lit(0)), "last": F.max("first").over(after)
        }
    )
    closed = stitched.select("file", "docs", "begin", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("begin")).otherwise(F.try_element_at("ends", F.greatest(F.col("i"), F.lit(1))) + 1)
    closed = closed.select(
        "file", (F.col("docs") + F.col("i")).alias("doc_no"), start.alias("start"),
        (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("terminated")
    )
    left = F.coalesce("next", "begin")
    rest = stitched.where((F.col("first") == F.col("last")) & (left < F.col("total")))
    return closed.union(rest.select("file", F.col("docs") + F.col("n_ends"), left, F.col("total") - left, F.lit(False)))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Flat files of all documents, scanned: one row for each document, in the order of the files."""
    folder = shared_dir(spark, "flat-tokens")
    eod = shared_encoder(public_tokenizer()).tokenizer.get_vocab_size() - 1
    files = write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"), folder, eod=eod)
    return count_tokens(files, folder, eod)
