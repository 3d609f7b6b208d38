r"""WARC: a deterministic sharded writer, and a reader.

Equal payloads are found by digest: the least page id keeps the payload, the others become revisit
records that refer to it. Records are dealt by ranges of page ids, sorted and written, each its own
gzip member; a file is rolled when its compressed size passes a bound. Headers, record ids and
digests are made from the row alone, so the same rows give the same bytes. Files are written under
temporary names and renamed; the manifest, renamed last, names the files that count.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, map_rows, open_fs, range_number, shared_dir

#: Payload bytes that one range of page ids takes on average; compressed bytes after which a file is rolled.
RANGE_BYTES, FILE_BYTES = 32 << 20, 128 << 20
#: Ranges at most: the driver holds a bound for each. Beyond, ranges grow; tasks stream them into files.
MOST_RANGES = 4096
#: Smaller payloads are never revisits.
LEAST_REVISIT = 100
_DATE = "2020-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page: int | None, digest: str, again: int = 0) -> str:
    """Rows that repeat a page's id differ in their payload or count how often it came before."""
    return f"<urn:page:{'null' if page is None else page}:{digest[:32]}:{again}>"


def _page(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").split(":")[0]
    return None if number == "null" else int(number)


def _clean(uri: str) -> str:
    """A header value: line ends and other control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri)


def record(
    page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool,
    again: int = 0, date: str = _DATE
) -> bytes:
    """One record, its own gzip member, the same bytes for the same arguments."""
    block = _HTTP % size + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page, digest, again)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _bounds(rows: DataFrame, range_bytes: int) -> list[int]:
    """Page ids that cut the rows into ranges of about so many bytes, MOST_RANGES at most.

    The cuts follow from the rows alone, however they are partitioned: ids are sampled by hash, about 64 for each range, with
    the bytes they stand for.
    """
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).head()
    ranges = min(MOST_RANGES, max(1, -(-(total["bytes"] or 0) // range_bytes)))
    if ranges == 1:
        return []
    one_of = max(1, total["n"] // (64 * ranges))
    some = rows.where("page is not null").where(
        F.pmod(F.xxhash64("page"), F.lit(one_of)) == 0
    ).groupBy("page").agg(F.sum("size").alias("bytes"))
    held = sorted((r["page"], r["bytes"]) for r in some.collect())  # bounded by 64 ids a range, on average
    share = max(1, sum(b for _, b in held)) / ranges
    out, size = [], 0
    for page, n in held:
        size += n
        if size >= share * (len(out) + 1) and len(out) < ranges - 1:
            out.append(page)
    return out


def write(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES
) -> dict:
    """Writes every row of pages and returns the manifest: file names in order, with records and bytes.

    A null payload is empty; a null url gives no target URI. Rows are sorted by id (null first), then url, then
    digest; of rows that repeat an id and a payload, the first is the response. A null id counts as larger than
    all others when the response is chosen. An empty table gives a manifest without files.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"),
        F.coalesce(F.encode(F.col(payload_col), "utf-8"), F.lit(b"")).alias("payload")
    )
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    key = F.struct(F.col("page").isNull().alias("no"), F.col("page").alias("page"), F.coalesce("url", F.lit("")).alias("url"))
    first = rows.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min(key).alias("least"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("digest").alias("twin"), "least")

    part = range_number(F.col("page"), bounds := _bounds(rows, range_bytes))
    # Payloads are shuffled once, to where they are written. What is known of a payload that others share travels beside it
    # as a row of its own and is sorted directly before it.
    known = rows.select(
        "page",
        "url",
        "digest",
        part.cast("int").alias("part"),
        key.alias("key")
    ).join(first, F.col("digest") == F.col("twin"))
    known = known.select(
        "part", "page", "url", "digest", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("payload"),
        F.lit(None).cast("long").alias("size"), F.col("least.page").alias("to"),
        (F.col("least") < F.col("key")).alias("later")
    )
    dealt = known.union(
        rows.select(
            part.cast("int"), "page", "url", "digest", F.lit(1), "payload", "size", F.lit(None).cast("long"),
            F.lit(None).cast("boolean")
        )
    )
    dealt = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(
        "part",
        F.col("page").asc_nulls_first(),
        F.col("url").asc_nulls_first(),
        "digest",
        "kind"
    )

    def files(batches: Iterator[pa.RecordBatch]):
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        of_page, came = None, {}
        f, at_part, seq, name, temporary, n, size, before, told = None, None, 0, "", "", 0, 0, None, None

        def close():
            f.close()
            fs.move(f"{root}/{temporary}", f"{root}/{name}")  # a task that runs again writes the same bytes
            return name, at_part, seq, n, size

        for batch in batches:
            for p, page, url, digest, kind, payload, length, to, later in zip(
                *(column(batch, c).to_pylist() for c in ("part", "page", "url", "digest", "kind", "payload", "size", "to", "later"))
            ):
                same = (page, url, digest)
                if not kind:
                    told = (same, to, later)
                    continue
                if f and (p != at_part or size >= file_bytes):
                    yield close()
                    f, seq = None, seq + 1 if p == at_part else 0
                if f is None:
                    if p != at_part:
                        seq = 0
                    at_part, n, size = p, 0, 0
                    name = f"pages-{p:06d}-{seq:04d}.warc.gz"
                    temporary = f"_{name}.{uuid.uuid4().hex[:8]}.tmp"
                    f = fs.open_output_stream(f"{root}/{temporary}", compression=None)
                _, to, later = told if told and told[0] == same else (same, None, None)
                revisit = later is not None and (later or same == before)  # a repeated row refers to its first
                if page != of_page:
                    of_page, came = page, {}
                came[digest] = again = came.get(digest, -1) + 1
                data = record(page, url, payload, digest, length, (to if later else page) if revisit else None, revisit, again)
                before = same
                f.write(data)
                n, size = n + 1, size + len(data)
        if f:
            yield close()

    written = sorted(  # one row a file
        map_rows(dealt, files, "name string, part int, seq int, records long, bytes long").collect(),
        key=lambda r: (r["part"], r["seq"])
    )
    manifest = {"files": [{"name": r["name"], "records": r["records"], "bytes": r["bytes"]} for r in written]}
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/_manifest.json.tmp") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{root}/_manifest.json.tmp", f"{root}/manifest.json")
    return manifest


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream; digests are verified."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].removeprefix("sha256:"):
            raise ValueError(f"{head['warc-record-id']}: the block isn't its digest's")
        yield head, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the manifest's files: page_id, url, record_type, refers_to, payload (null for a revisit), payload_bytes,
    payload_digest.
    """
    fs, root = open_fs(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        names = [(e["name"], e["records"]) for e in json.loads(f.read())["files"]]
    files = spark.createDataFrame(names, "name string, records long").repartition(max(1, len(names)), "name")

    def records(batches):
        fs, root = open_fs(folder)
        for batch in batches:
            for name, n in zip(column(batch, "name").to_pylist(), column(batch, "records").to_pylist()):
                count = 0
                with fs.open_input_file(f"{root}/{name}") as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for head, block in parse(io.BufferedReader(plain)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        revisit = head["warc-type"] == "revisit"
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{head['warc-record-id']}: the payload isn't its digest's")
                        yield _page(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], _page(head["warc-refers-to"]) if revisit else None, None if revisit else payload, size, digest
                        count += 1
                if count != n:
                    raise ValueError(f"{name} has {count} records for {n}")

    return map_rows(
        files, records,
        "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    )


def op6_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_page FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_page < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page < page_id THEN first_page END AS refers_to
FROM f
"""
