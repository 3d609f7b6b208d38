import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from offerloom.llm import decontaminate as D
from offerloom.llm import simhash as H
from offerloom.llm import substring_dedup as S

DOCS = "doc_id long, text string"


def brute_repeats(docs, width):
    seen = {}
    split = [(i, (t or "").split()) for i, t in docs]
    for i, w in split:
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            seen[k] = min(seen.get(k, i), i)
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - width + 1):
            if seen[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def test_substring_dedup_against_brute_force(spark):
    random.seed(4)
    shared = [[random.choice("abcdefgh") for _ in range(random.randint(5, 30))] for _ in range(4)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(random.randint(0, 5)):
            w += random.choice(
                [random.choice(shared), [random.choice("xyzuvw") + str(random.randint(0, 50)) for _ in range(random.randint(1, 12))]]
            )
        docs.append((i * 3 % 61, " ".join(w)))
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = S.remove_repeats(df, width=5, layout="words", bucket_bytes=200).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_repeats(docs, 5)


def test_substring_dedup_edges(spark):
    p = "a b c d e f"
    rows = [(5, p, 1), (2, f" {p}\n\nkeep  this", 2), (9, None, 3), (8, "", 4), (2, "x " + p, 5), (None, p, 6), (7, f"start\n{p}\nend", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int").withColumn("_doc", F.lit("mine"))
    got = {r["at"]: r for r in S.remove_repeats(df, width=4).collect()}
    assert {k: (r["n_words"], r["n_removed"], r["kept"]) for k, r in got.items()} == {
        1: (6, 6, ""), 2: (8, 0, f" {p}\n\nkeep  this"), 3: (0, 0, None), 4: (0, 0, ""), 5: (7, 0, "x " + p),
        6: (6, 6, ""), 7: (8, 6, "start\nend")
    }
    assert got[7]["spans"][0].asDict() == {"at": 1, "till": 7} and got[1]["_doc"] == "mine"
    empty = S.remove_repeats(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and "kept" in empty.columns


def test_settling_unpacks_only_what_starts_twice():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 62, (20, 20_000), np.uint64)
    hashes[3, :10], hashes[7, 5:9] = hashes[11, :10], hashes[2, :4]
    kinds = [np.uint64, np.int64, np.int64, np.int32]
    rows = []
    for i, h in enumerate(np.sort(hashes, axis=1)):
        entries = (h, i * 1000 + np.arange(len(h)) % 700, np.zeros(len(h)), np.arange(len(h)))
        rows.append([0, *(S.packed(x.astype(k)) for x, k in zip(entries, kinds)), None])
    names = ["bucket", "hash", "doc", "twin", "at", "till"]
    table = pa.table([pa.array(c, pa.int32() if n == "bucket" else pa.binary()) for n, c in zip(names, zip(*rows))], names=names)
    first = {}
    for i, h in enumerate(np.sort(hashes, axis=1)):
        for j, x in enumerate(h.tolist()):
            first.setdefault(x, []).append((i * 1000 + j % 700, j, j + 50))
    want = sorted(x for v in first.values() for x in v if x[0] > min(v)[0])
    tracemalloc.start()
    try:
        out = list(S._settle(table, 50, 4))
        assert tracemalloc.get_traced_memory()[1] < 5 * hashes.nbytes
    finally:
        tracemalloc.stop()
    columns = [np.concatenate([S.unpacked(r[c], k) for r in out]).tolist() for c, k in ((1, np.int64), (3, np.int32), (4, np.int32))]
    assert len(want) == 14 and sorted(zip(*columns)) == want


def test_one_very_long_text(spark):
    long = " ".join(str(i % 700) for i in range(60_000))
    got = {r["doc_id"]: r["n_removed"] for r in S.remove_repeats(spark.createDataFrame([(1, "p " + long), (2, long)], DOCS)).collect()}
    assert got == {1: 0, 2: 60_000}


def fingerprint(text):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints, distance):
    ids = sorted({i for i, _ in prints})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(prints):
        for j, y in prints[a:]:
            if bin(x ^ y).count("1") <= distance:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    random.seed(5)
    base = ["w%d" % random.randint(0, 400) for _ in range(120)]
    docs = []
    for i in range(80):
        w = list(base)
        for _ in range(random.randint(0, 6)):
            w[random.randrange(len(w))] = "z%d" % random.randint(0, 9)
        docs.append((1000 - i, " ".join(w)))
    docs += [(1, None), (2, ""), (3, "One two"), (4, "one TWO"), (5, "a b c d"), (6, "É x")]
    got = H.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    prints = [(i, fingerprint(t)) for i, t in docs]
    want = brute_components(prints, 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{x:016x}", want[i]) for i, x in prints}
    assert len(set(want.values())) > 5


def test_links_of_clustered_fingerprints(spark):
    """Fingerprints in a tight cluster and at all distances: the balls must find every link."""
    rng = np.random.default_rng(6)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 30)}
    for x in list(prints)[:10]:
        for _ in range(30):
            y = x
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            prints.add(y)
    prints = sorted(prints)
    rows = [(i, int(np.array(x, np.uint64).view(np.int64))) for i, x in enumerate(prints)]
    for bits in (6, 9):
        links = H.near_links(spark.createDataFrame(rows, "node long, print long"), prefix_bits=bits)
        found = {r["node"]: r["component"] for r in H.components(links).collect()}
        want = brute_components(list(enumerate(prints)), 4)
        assert {i: found.get(i, i) for i in range(len(prints))} == want


def test_collisions_split_until_they_fit(monkeypatch):
    rng = np.random.default_rng(7)
    x = int(rng.integers(0, 1 << 63))
    prints = np.array(sorted({x ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 56, (40, 2))}), np.uint64)
    args = prints, np.arange(len(prints)), np.full(len(prints), 2, np.int8)

    def forest():
        return H._forest(len(prints), H._collisions(*args, 56)).tolist()

    whole = forest()
    monkeypatch.setattr(H, "MOST_VARIANTS", 3000)
    assert forest() == whole


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 100)]
    got = {r["node"]: r["component"] for r in H.components(spark.createDataFrame(path + star, "node long, to long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[1000 + i] == 1000 for i in range(1, 100))


def test_repeated_ids_and_empty_tables(spark):
    docs = [
        (1, "a b c d e"), (1, "completely other words stand here"), (2, "completely other words stand here"),
        (None, "a b c d e"), (3, "a b c d e"), (9, "nothing like these texts at all")
    ]
    got = {(r["doc_id"], r["component_id"]) for r in H.near_duplicates(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 9)}
    kept = H.keep_one(spark.createDataFrame(docs, DOCS).withColumn("_gone", F.lit(1))).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 1, 9]
    assert H.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def brute_hits(text, items, window):
    import re

    split = lambda t: re.findall(
        r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
        "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    )
    w, hit, names = split(text), set(), set()
    for name, t in items:
        x = split(t)
        n = min(window, len(x))
        for i in range(len(x) - n + 1) if x else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, block_bytes):
    random.seed(8)
    vocabulary = ["Ab", "c-d", "é", "x1", "Yy", "zz"]
    items = [
        (i, " ".join(random.choices(vocabulary, k=random.choice([1, 2, 5, 12, 13, 20, 40])))) for i in range(12)
    ] + [(90, None), (91, "!!"), (92, "zz"), (93, "ZZ")]
    docs = []
    for i in range(40):
        t = random.choices(vocabulary, k=random.randint(0, 60))
        x = random.choice(items)[1]
        if x:
            a = x.split()
            k = random.randint(0, len(a))
            t[5:5] = a[max(0, k - 15) : k]
        docs.append((i, " ".join(t)))
    docs += [(100, None), (101, "")]
    df = spark.createDataFrame(docs, DOCS).withColumn("items", F.lit("old"))
    got = D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == {i: brute_hits(t, items, 13) for i, t in docs}
    for r in got:
        assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])
        assert sum(s["till"] - s["at"] for s in r["spans"]) == r["n_hit"]


def test_decontamination_of_texts_that_repeat_themselves(spark, monkeypatch):
    items = [(1, "a " * 40), (2, "a " * 20 + "b " * 20), (3, "a b " * 15), (4, "a"), (5, "b " * 13)]
    docs = [
        (i, t) for i, t in enumerate(["a " * 90, "b " * 12, "b " * 14, "a b " * 30, "a " * 14 + "c " + "b " * 20, "a b b " * 20, "c " * 30])
    ]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items, 13) for i, t in docs}
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in D.decontaminate(df, bench).collect()} == want
    index = D.build_index(["x"], pa.array(["word " * 600]), 13, 7)
    assert len(index.print) < 30
    monkeypatch.setattr(D, "MOST_PAIRS", 3)
    texts = pa.array([t for _, t in docs])
    found = D.words(texts, D.ALNUM_LOWER)
    hashes = found.hashes()
    index = D.build_index([str(i) for i, _ in items], pa.array([t for _, t in items]), 13, 7)
    begin, end, doc, item = D.find_hits(found, hashes, D.kept_grams(hashes, found.first, 13, 7), index, 13, 7)
    for i, _ in docs:
        hit = {w for a, b in zip(begin.tolist(), end.tolist()) for w in range(a, b) if found.first[i] <= w < found.first[i + 1]}
        assert len(hit) == want[i][1] and sorted(
            {x for d, n in zip(doc.tolist(), item.tolist()) if d == i for x in index.ids[n]}
        ) == want[i][2]


def test_winnowing_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_hit"], r["contaminated"]) for r in D.decontaminate(docs, none).collect()] == [(0, False)]
    assert D.decontaminate(docs.limit(0), none).count() == 0
