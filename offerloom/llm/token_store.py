r"""Token-id files: one zstandard dictionary, each document compressed by itself, an offset index per file.

File: MAGIC, 32 bytes of the dictionary's SHA-256, the frames one after the other, the index (an Arrow
table of doc_id, offset, size, n_tokens), its position as 8 bytes, MAGIC. Ids are serialized as unsigned
16-bit integers if the vocabulary allows it, 32-bit else. A document is read with its frame and the
index alone.

Documents are encoded and compressed where they are scanned; only frames are shuffled, by ranges of
ids, sorted, and written under temporary names. The manifest, renamed into place last, names the
files that count; files of lost tasks are in no manifest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, map_rows, open_fs, shared_dir, short_batches
from .encoder import encoded, public_tokenizer, shared_encoder

MAGIC = b"TOKSTOR1"
#: Text bytes that one range of ids takes on average.
RANGE_BYTES = 32 << 20
#: Frames are rolled into a new file beyond so many bytes.
FILE_BYTES = 64 << 20
#: Ranges at most: the driver holds a bound for each. Beyond, ranges grow; tasks stream them into files of FILE_BYTES.
MOST_RANGES = 4096
#: The dictionary is trained on so many distinct texts at most, on a slice of so many characters at a hashed position of each:
#: these only bound the sample, not what is stored.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 4096, 64 << 10


def _train(samples: list[bytes]) -> bytes:
    if sum(map(len, samples)) < 1024:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_checksum=False)


def write(
    docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES
) -> dict:
    """Writes the ids of all texts, end_id behind each, in ascending order of id_col (null first; repeated ids by their
    ids' bytes). A null or empty text is end_id alone. Returns the manifest. An empty table gives a manifest without files.
    """
    tokenizer = tokenizer or public_tokenizer()
    source = short_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    # one pass for the layout: ids are cut into ranges of equal counts
    grid = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    layout = source.agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"),
        F.percentile_approx("doc", grid, 20 * MOST_RANGES).alias("edges")
    ).head()
    n_ranges = min(MOST_RANGES, max(1, -(-(layout["bytes"] or 0) // range_bytes)))
    bounds = layout["edges"] or []
    edges = np.array(sorted({bounds[i * MOST_RANGES // n_ranges - 1] for i in range(1, n_ranges)}) if bounds else [], np.int64)

    # one of so many hashes, so that about twice the sample is left before copies go
    h, room = F.xxhash64("text"), F.greatest(F.char_length("text") - SAMPLE_CHARS + 1, F.lit(1))
    some = source.where("text is not null").where(F.pmod(h, F.lit(max(1, layout["n"] // (2 * SAMPLE_DOCS)))) == 0)
    some = some.select(
        h.alias("h"),
        F.substring("text", F.pmod(F.xxhash64("text", F.lit(1)), room.cast("long")).cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("text")
    )
    sample = some.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(SAMPLE_DOCS)
    wide = shared_encoder(tokenizer).tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    kind = "<u4" if wide else "<u2"

    def plain(batches):
        for batch in batches:
            for ids in encoded(column(batch, "text"), shared_encoder(tokenizer)):
                yield (np.frombuffer(ids, "<u4").astype(kind).tobytes(),)

    dictionary = _train([bytes(r["ids"]) for r in map_rows(sample, plain, "ids binary").collect()])
    digest = hashlib.sha256(dictionary).digest()

    def frames(batches):
        press = compressor(dictionary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs = column(batch, "doc")
            least = np.iinfo(np.int64).min  # a null id stands before all others
            parts = np.searchsorted(edges, np.asarray(docs.fill_null(least)), "right").tolist()
            for part, doc, ids in zip(parts, docs.to_pylist(), encoded(column(batch, "text"), shared_encoder(tokenizer))):
                ids = np.frombuffer(ids + end, "<u4")
                yield part, doc, press.compress(ids.astype(kind).tobytes()), len(ids)

    ranged = map_rows(source, frames, "part int, doc long, frame binary, n_tokens long")
    ranged = ranged.repartitionById(len(edges) + 1, "part").sortWithinPartitions("part", F.col("doc").asc_nulls_first(), "frame")

    def files(batches: Iterator[pa.RecordBatch]):
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        part, seq, out = None, 0, None

        def close():
            nonlocal out
            f, name, index, at = out
            sink = pa.BufferOutputStream()
            table = pa.table(
                {
                    "doc_id": pa.array(index[0], pa.int64()), "offset": pa.array(index[1], pa.int64()),
                    "size": pa.array(index[2], pa.int64()), "n_tokens": pa.array(index[3], pa.int64())
                }
            )
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            f.write(sink.getvalue())
            f.write(at.to_bytes(8, "little") + MAGIC)
            f.close()
            fs.move(f"{root}/_{name}.tmp", f"{root}/{name}")
            out = None
            return name, part, seq, len(index[0]), sum(index[3])

        for batch in batches:
            for p, doc, frame, n in zip(*(column(batch, c).to_pylist() for c in ("part", "doc", "frame", "n_tokens"))):
                if out and (p != part or out[3] >= file_bytes):
                    yield close()
                    seq = seq + 1 if p == part else 0
                if out is None:
                    if p != part:
                        part, seq = p, 0
                    name = f"tokens-{p:06d}-{seq:04d}-{uuid.uuid4().hex[:8]}"
                    f = fs.open_output_stream(f"{root}/_{name}.tmp")
                    f.write(MAGIC + digest)
                    out = [f, name, ([], [], [], []), len(MAGIC) + len(digest)]
                out[0].write(frame)
                for to, x in zip(out[2], (doc, out[3], len(frame), n)):
                    to.append(x)
                out[3] += len(frame)
        if out:
            yield close()

    written = sorted(
        map_rows(ranged, files, "name string, part int, seq int, n_docs long, n_tokens long").collect(),
        key=lambda r: (r["part"], r["seq"])
    )
    entries, start = [], 0
    for r in written:  # one entry a file
        entries.append({"name": r["name"], "start": start, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]})
        start += r["n_tokens"]
    manifest = {"kind": kind, "end_id": end_id, "dictionary_sha256": digest.hex(), "files": entries}
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    for name, data in (("dictionary.zdict", dictionary), ("manifest.json", json.dumps(manifest).encode())):
        with fs.open_output_stream(f"{root}/_{name}.tmp") as f:
            f.write(data)
        fs.move(f"{root}/_{name}.tmp", f"{root}/{name}")
    return manifest


def _load(folder: str) -> tuple[dict, bytes]:
    fs, root = open_fs(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    with fs.open_input_stream(f"{root}/dictionary.zdict") as f:
        dictionary = f.read()
    if hashlib.sha256(dictionary).hexdigest() != manifest["dictionary_sha256"]:
        raise ValueError(f"{folder}: the dictionary isn't the manifest's")
    return manifest, dictionary


def _index(f, dictionary: bytes) -> pa.Table:
    size = f.size()
    head = f.read_at(len(MAGIC) + 32, 0)
    if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) :] != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token file of this dictionary")
    tail = f.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
    at = int.from_bytes(tail[:8], "little")
    return pa.ipc.open_stream(f.read_at(size - 8 - len(MAGIC) - at, at)).read_all()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: doc_id, start (tokens before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    manifest, dictionary = _load(folder)
    kind = manifest["kind"]
    files = spark.createDataFrame(
        [(e["name"], e["start"]) for e in manifest["files"]],
        "name string, start long"
    ).repartition(max(1, len(manifest["files"])), "name")

    def documents(batches):
        fs, root = open_fs(folder)
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for name, start in zip(column(batch, "name").to_pylist(), column(batch, "start").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    index = _index(f, dictionary)
                    for doc, offset, size, n in zip(*(index[c].to_pylist() for c in ("doc_id", "offset", "size", "n_tokens"))):
                        ids = np.frombuffer(press.decompress(f.read_at(size, offset)), kind)
                        if len(ids) != n:
                            raise ValueError(f"{name}: {doc} has {len(ids)} ids for {n}")
                        yield doc, start, n, ids.astype("<u4").tobytes()
                        start += n

    return map_rows(files, documents, "doc_id long, start long, n_tokens long, ids binary")


def read_document(folder: str, doc_id: int) -> np.ndarray | None:
    """One document's ids: the index of each file until it is found, then its frame alone."""
    manifest, dictionary = _load(folder)
    fs, root = open_fs(folder)
    for entry in manifest["files"]:
        with fs.open_input_file(f"{root}/{entry['name']}") as f:
            index = _index(f, dictionary)
            at = np.flatnonzero(np.asarray(index["doc_id"].fill_null(-(1 << 63))) == doc_id)
            if len(at):
                i = int(at[0])
                press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
                return np.frombuffer(
                    press.decompress(f.read_at(index["size"][i].as_py(), index["offset"][i].as_py())),
                    manifest["kind"]
                ).astype(np.uint32)
    return None


def op8_token_store(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
