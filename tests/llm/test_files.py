import gzip
import hashlib
import io
import json
import zlib

import numpy as np
import pytest

from offerloom.llm import chat_format as C
from offerloom.llm import packing as P
from offerloom.llm import token_counts as TC
from offerloom.llm import token_store as TS
from offerloom.llm import warc as W
from offerloom.llm.common import open_fs, shared_dir
from offerloom.llm.encoder import Encoder, public_tokenizer

DOCS = "doc_id long, text string"
ROWS = [
    (5, "Hello world"), (1, None), (3, ""), (2, "a <|endoftext|> b"), (None, "no id"), (5, "Hello world"),
    (4, "word " * 9000), (7, "x")
]


def ids_of(text, end=2):
    e = Encoder(public_tokenizer())
    return np.frombuffer(e.encode([text or ""])[0], "<u4").tolist() + [end]


def test_token_store_round_trip(spark):
    folder = shared_dir(spark, "t")
    manifest = TS.write(spark.createDataFrame(ROWS, DOCS).repartition(3), folder, range_bytes=10_000, file_bytes=2_000)
    assert len(manifest["files"]) > 1 and sum(e["n_docs"] for e in manifest["files"]) == len(ROWS)
    got = TS.read(spark, folder).orderBy("start").collect()
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0]))
    at = 0
    for r, (doc, text) in zip(got, want, strict=True):
        ids = ids_of(text)
        assert (r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (doc, at, len(ids), ids)
        at += len(ids)
    assert TS.read_document(folder, 4).tolist() == ids_of("word " * 9000)
    assert TS.read_document(folder, 99) is None
    fs, root = open_fs(folder)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(b"another")
    with pytest.raises(ValueError, match="dictionary"):
        TS.read_document(folder, 4)


def test_token_store_is_the_same_for_the_same_rows(spark):
    def digests(parts):
        folder = shared_dir(spark, "t")
        m = TS.write(spark.createDataFrame(ROWS, DOCS).repartition(parts), folder)
        fs, root = open_fs(folder)
        return [hashlib.sha256(fs.open_input_file(f"{root}/{e['name']}").readall()).hexdigest() for e in m["files"]]

    assert digests(1) == digests(4)


def test_empty_token_store(spark):
    folder = shared_dir(spark, "t")
    assert TS.write(spark.createDataFrame([], DOCS), folder)["files"] == []
    assert TS.read(spark, folder).count() == 0


@pytest.mark.parametrize("block", [2, 6, 1 << 20])
def test_separator_scan(spark, block):
    folder = shared_dir(spark, "f")
    files = TC.write_flat(spark.createDataFrame(ROWS, DOCS).coalesce(1), folder, file_bytes=40)
    got = TC.count_tokens(files, folder, 49407, block_bytes=block if block > 2 else 2 * 500).orderBy("file", "doc_no").collect()
    e = Encoder(public_tokenizer(), special_as_text=True)
    want = [len(e.encode([t or ""])[0]) // 4 for _, t in ROWS]
    assert [r["n_tokens"] for r in got] == want and all(r["terminated"] for r in got)
    assert files.count() > 1


def test_separator_scan_of_handmade_files(spark):
    folder = shared_dir(spark, "f")
    fs, root = open_fs(folder)
    fs.create_dir(root)
    cases = {1: [9, 9, 0, 0, 5, 0, 7, 7], 2: [0], 3: [4] * 7, 4: [4, 4, 4, 4, 4, 0, 1, 0], 5: []}
    for k, ids in cases.items():
        with fs.open_output_stream(f"{root}/{k}") as f:
            f.write(np.array(ids, "<u2").tobytes())
    files = spark.createDataFrame([(k, str(k), 2 * len(v)) for k, v in cases.items()], "file long, name string, bytes long")
    for block in (2, 4, 6, 100):
        got = {}
        for r in TC.count_tokens(files, folder, 0, block_bytes=block).orderBy("file", "doc_no").collect():
            got.setdefault(r["file"], []).append((r["doc_no"], r["start"], r["n_tokens"], r["terminated"]))
        assert got == {
            1: [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, True), (3, 6, 2, False)], 2: [(0, 0, 0, True)],
            3: [(0, 0, 7, False)], 4: [(0, 0, 5, True), (1, 6, 1, True)]
        }


def test_packing(spark):
    rows = [(r[0] if r[0] is not None else None, r[1]) for r in ROWS] + [(100 + i, "w " * (i * 37 % 300)) for i in range(60)]
    for capacity in (16, 256, 4096):
        got = P.pack(spark.createDataFrame(rows, DOCS).repartition(2), capacity=capacity, block_windows=8).collect()
        sequences, total = {}, 0
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == sequences.get(r["sequence_id"], 0) and r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
            sequences[r["sequence_id"]] = r["offset"] + r["length"]
            total += r["length"]
        assert max(sequences.values()) <= capacity and total == sum(len(ids_of(t)) for _, t in rows)
        pieces = {}
        for r in sorted(got, key=lambda r: r["start"]):
            if r["doc_id"] not in (None, 5):
                assert r["start"] == len(pieces.setdefault(r["doc_id"], b"")) // 4
                pieces[r["doc_id"]] += r["ids"]
        for doc, text in rows:
            if doc not in (None, 5):
                assert np.frombuffer(pieces[doc], "<u4").tolist() == ids_of(text)
    assert P.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    for k in (1, 2, 7, 40):
        sizes = rng.integers(1, 1000, 12 * k).tolist()
        windows = P.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert max(sums) - min(sums) <= 60


def test_little_padding():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1500, 700).tolist()
    pad = 0
    for pieces in P.pack_block(sizes, 4096):
        n = sum(x[2] for x in pieces)
        pad += 0 if n & (n - 1) == 0 else 4096 - n
    assert pad == 0
    whole = P.pack_block(sizes, 4096, cut=False)
    assert sorted(i for w in whole for i, a, n in w if (a, n) == (0, sizes[i])) == list(range(len(sizes)))
    assert max(sum(x[2] for x in w) for w in whole) <= 4096 and len(whole) * 4096 < 1.05 * sum(sizes)


def test_differencing_decides_the_windows():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 1500, 900).tolist()
    windows, taken, part = P.cut_block(sizes, 4096)
    assert len(windows) == sum(sizes) // 4096 and all(sum(n for _, _, n in w) == 4096 for w in windows)
    covered = {}
    for i, at, n in sorted(p for w in windows for p in w):
        assert at == covered.get(i, 0)
        covered[i] = at + n
    assert covered == {i: n for i, n in enumerate(sizes[:taken])} | ({taken: part} if part else {})
    # a fill in the order of arrival cuts an item at the end of nearly every window
    ends = np.cumsum(sizes)
    filled = sum(e not in ends for e in range(4096, int(ends[-1]), 4096))
    pieces = [i for w in windows for i, _, _ in w]
    assert sum(pieces.count(i) > 1 for i in set(pieces)) < 0.8 * filled
    assert max(abs(sum(n for i, at, n in w if at == 0) - 4096) for w in windows) <= 40


def test_powers_of_two():
    for sizes in ([], [1], [5, 9, 4000], [3, 3]):
        out = P.powers_of_two(sizes, 4096)
        assert all((n := sum(x[2] for x in w)) & (n - 1) == 0 and n <= 4096 for w in out)
        assert sum(x[2] for w in out for x in w) == sum(sizes)


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 200
    rows = [
        (3, "http://a/\r\nX: y", big), (1, None, big), (2, "http://b", "small"), (4, "http://c", "small"),
        (5, "u", None), (6, "u", ""), (3, "http://a/\r\nX: y", big), (None, "n", big), (8, "z", big + "1"),
        (9, "m", "a\r\n\r\nb" * 50)
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = shared_dir(spark, "w")
    manifest = W.write(pages, folder, range_bytes=300, file_bytes=600)
    assert sum(e["records"] for e in manifest["files"]) == len(rows) and len(manifest["files"]) > 2
    got = sorted(
        (
            (
                r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"], r["payload_bytes"],
                r["payload_digest"]
            ) for r in W.read(spark, folder).collect()
        ),
        key=str
    )
    sha = lambda x: hashlib.sha256((x or "").encode()).hexdigest()
    size = lambda x: len((x or "").encode())
    want = []
    for page, _, html in rows:
        later = html == big and page != 1
        want.append((page if page is not None else -1, "revisit" if later else "response", 1 if later else None, size(html), sha(html)))
    assert got == sorted(want, key=str)
    payloads = {r["page_id"]: r["payload"] for r in W.read(spark, folder).where("record_type = 'response'").collect()}
    assert payloads[9].decode() == "a\r\n\r\nb" * 50 and payloads[1].decode() == big


def test_warc_files_follow_from_the_rows_and_record_ids_are_unique(spark):
    big = "y" * 120
    rows = [(i % 37, f"http://{i % 5}", big if i % 3 else f"{i}" * 40) for i in range(300)] + [(None, "u", big)] * 2

    def files(parts):
        folder = shared_dir(spark, "w")
        m = W.write(
            spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts), folder,
            range_bytes=3000, file_bytes=500
        )
        fs, root = open_fs(folder)
        return {e["name"]: fs.open_input_file(f"{root}/{e['name']}").readall() for e in m["files"]}

    one, other = files(1), files(5)
    assert one == other and len(one) > 5
    ids, refers = [], []
    for name in one:
        for head, _ in W.parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(one[name])))):
            ids.append(head["warc-record-id"])
            refers += [head["warc-refers-to"]] if "warc-refers-to" in head else []
    assert len(set(ids)) == len(ids) == len(rows) and refers and set(refers) <= set(ids)


def test_range_numbers(spark):
    from pyspark.sql import functions as F
    from offerloom.llm.common import range_number

    values = [None, -5, 0, 1, 2, 3, 10, 11, 99, 100, 101, 10**12]
    for bounds in ([], [1], [1, 2], [0, 3, 10, 50, 99, 100, 10**6], list(range(0, 200, 2))):
        got = spark.createDataFrame([(v,) for v in values], "v long").select("v", range_number(F.col("v"), bounds).alias("n")).collect()
        assert {r["v"]: r["n"] for r in got} == {v: 0 if v is None else sum(b < v for b in bounds) for v in values}


def test_warc_repeated_first_page(spark):
    big = "x" * 150
    folder = shared_dir(spark, "w")
    W.write(spark.createDataFrame([(1, "u", big), (1, "u", big), (2, "u", big)], "page_id long, url string, html string"), folder)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in W.read(spark, folder).collect())
    assert got == [(1, "response", None), (1, "revisit", 1), (2, "revisit", 1)]


def test_warc_files_are_deterministic_and_standard(spark):
    rows = [(i, f"http://h/{i}", f"<html>{i % 7}" + "y" * 120) for i in range(40)]

    def files(parts):
        folder = shared_dir(spark, "w")
        m = W.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts), folder, file_bytes=2000)
        fs, root = open_fs(folder)
        assert not [f.path for f in fs.get_file_info(__import__("pyarrow.fs").fs.FileSelector(root)) if f.path.endswith(".tmp")]
        return [fs.open_input_file(f"{root}/{e['name']}").readall() for e in m["files"]]

    one = files(1)
    assert one == files(5)
    heads = [h for data in one for h, _ in W.parse(io.BytesIO(gzip.decompress(data)))]
    assert len(heads) == 40 and {h["warc-type"] for h in heads} == {"response", "revisit"}
    with pytest.raises(ValueError, match="digest"):
        list(W.parse(io.BytesIO(gzip.decompress(one[0]).replace(b"yyy", b"yyz", 1))))


def test_empty_warc(spark):
    folder = shared_dir(spark, "w")
    assert json.loads(json.dumps(W.write(spark.createDataFrame([], "page_id long, url string, html string"), folder))) == {"files": []}
    assert W.read(spark, folder).count() == 0


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "### User: \\", "", None, "</turn>\n### Assistant: ", "\\\\</turn>", "### ", "a\nb", "</turn>"]
    rows = []
    for c, n in ((1, 4), (2, 9), (3, 1)):
        for i in range(n):
            rows.append((c, i, ["user", "assistant"][i % 2], said[(c + i) % len(said)]))
    rows += [
        (4, 0, "od:d ### role\\", "x"), (4, 1, None, "y"), (None, 0, "assistant", "z"), (5, 1, "assistant", "late"),
        (5, 0, "user", "early"), (5, None, "system", "first")
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    segments = C.format_conversations(df)
    got = {r["conv_id"]: r for r in C.read_back(segments).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        by.setdefault(r[0], []).append(r)
    for conv, turns in by.items():
        h = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (
            len(turns),
            h,
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest()
        )
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False, 5: True}
    assert C.format_conversations(df.limit(0)).count() == 0


def test_chat_problems(spark):
    rows = [(1, 0, "assistant", "x"), (2, 0, "user", "q"), (2, 1, "tool", "t"), (2, 2, "assistant", "a")]
    got = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {
        (r["conv"], r["problem"]) for r in got.where("problem is not null").collect()
    } == {(1, "assistant after start"), (2, "tool after user")}


def test_crc_is_that_of_the_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
