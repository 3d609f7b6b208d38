import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import ann_forest as A
from offerloom.llm import toxicity as T


def brute_nearest(rows, queries, k):
    out = {}
    for q, x in queries:
        scores = sorted(
            (-(np.array(x, np.float32).astype(float) * np.array(y, np.float32).astype(float)).sum(), i) for i, y in rows if i != q
        )
        out[q] = [i for _, i in scores[:k]]
    return out


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 3
    x = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = A.nearest(df, lambda i: i % 20 == 0, k=10, leaf=32).collect()
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 10)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert math.isclose(r["score"], float((x[r["query_id"]].astype(float) * x[r["vec_id"]].astype(float)).sum()), rel_tol=1e-12)
    assert sorted(found) == list(range(0, 1500, 20)) and all(len(v) == 10 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / (10 * len(want)) >= 0.9


def test_recall_on_isotropic_vectors_in_blocks_and_split_leaves(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)

    def found():
        out = {}
        for r in A.nearest(df, lambda i: i % 20 == 0, k=20).collect():
            out.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        return out

    got = found()
    assert all(sorted(v) == list(range(1, 21)) for v in got.values()) and set(got) == set(want)
    assert sum(len(set(got[q].values()) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9
    monkeypatch.setattr(A, "PART", 100)
    monkeypatch.setattr(A, "QUERY_BLOCK", 40)
    monkeypatch.setattr(A, "PRODUCTS", 1000)
    assert found() == got


def test_one_queue_over_all_trees():
    import heapq

    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    forest = A.fit(x, float((x.astype(float) ** 2).sum(1).max()), 3, 20)
    for q, order in zip(x[:20].astype(float), A.queue(forest, x[:20].astype(float))):
        margins = forest.normal[:, :-1] @ (q * np.sqrt(forest.norm2) / np.sqrt(q @ q)) - forest.offset
        heap, popped = [(-np.inf, int(r)) for r in forest.roots], []
        while heap:
            far, node = heapq.heappop(heap)
            if node < 0:
                popped.append((far, -1 - node))
                continue
            for child, m in zip(forest.children[node].tolist(), (margins[node], -margins[node])):
                heapq.heappush(heap, (max(far, m), child))
        far = dict((leaf, f) for f, leaf in popped)
        assert sorted(order.tolist()) == sorted(far)
        assert np.allclose([f for f, _ in popped], [far[i] for i in order.tolist()])


def test_copies_ties_and_unusable_vectors(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(i, v) for i in range(60)] + [
        (100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 0.0]), (103, [float("nan"), 0.0, 0.0]),
        (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (None, v), (120, [-1.0, 0.0, 0.0]), (7, [0.5, 0.5, 0.5])
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {}
    for r in A.nearest(df, lambda i: i % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [1, 2, 3, 4, 5] and got[20] == [0, 1, 2, 3, 4] and got[40] == [0, 1, 2, 3, 4]
    assert got[120] == [7, 0, 1, 2, 3] and set(got) == {0, 20, 40, 120}


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["rank"]) for r in A.nearest(df, lambda i: i % 20 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert A.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    assert A.nearest(df.where("vec_id = 0"), lambda i: i % 20 == 0).count() == 0


def distance(a, b):
    """Edits with swaps of neighbours, each letter swapped once at most."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_edit_distances():
    random.seed(2)
    terms = {t: 1.0 for t in ("idiot", "moron", "worthless", "cat", "réseau", "disgusting")}
    stems = {"veq": 1.0}
    words = ["".join(random.choices("abcdeio tmnr", k=random.randint(1, 9))).replace(" ", "") for _ in range(300)]
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(random.randint(0, 3)):
                i = random.randrange(len(w) + 1)
                random.choice(
                    [
                        lambda i: w.insert(i, random.choice("aeiz1é")),
                        lambda i: w.pop(min(i, len(w) - 1)) if len(w) > 1 else None,
                        lambda i: w.__setitem__(min(i, len(w) - 1), random.choice("xyz@")),
                        lambda i: w.__setitem__(slice(max(i - 2, 0), i), w[max(i - 2, 0) : i][::-1])
                    ]
                )(i)
            words.append("".join(w))
    words += ["veq", "vequa", "ve", "", "xveq", "idiots"]
    a = T.Automaton(terms, stems)
    for w, s in zip(words, a.walk(words)):
        found = a.accepts[s]
        exact = w in terms or w.startswith("veq")
        best = min((distance(w, t) for t in terms if distance(w, t) <= a.allowed(t)), default=None)
        if exact:
            assert found and found[1] == 0
        elif best is None:
            assert found is None, (w, found)
        else:
            assert found and found[1] == best and distance(w, found[0]) == best, (w, found, best)


def test_quotations():
    assert T.quotation('he said "you ', '" and left') == 0.8
    assert T.quotation("„du ", "“ sagte") == 0.8
    assert T.quotation('"a" you ', ' "b"') == 0.5 * 0
    assert T.quotation("she wrote that ", " is rude") == 0.5
    assert T.quotation("you are an ", " my friend") == 0.0


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(3)
    words = ["".join(random.choices("bcdfglprs", k=2) + random.choices("aeou", k=2)) + str(i) for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        t = random.choices(words, k=40)
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                t[random.randrange(40)] = random.choice(["grumpwit", "scumlord", "vexq" + random.choice(words)])
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    copies = [(1000 + i, rows[0][1]) for i in range(80)]
    return spark.createDataFrame(rows + copies, "doc_id long, text string"), spark.createDataFrame(
        labels + [(1000 + i, 1) for i in range(80)] + [(None, 1), (5000, None)],
        "doc_id long, toxic int"
    )


def test_learning_and_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    model = T.learn(docs, T.train_labels(labels))
    assert set(model.terms) == {"grumpwit", "scumlord"} and list(model.stems) == ["vexq"]
    got = T.score(
        docs.withColumn("score", F.lit("mine")),
        model
    ).join(labels, "doc_id").withColumn("h", T.held_out("doc_id")).where("h").collect()
    assert len(got) > 80 and all(r["predicted"] == r["toxic"] for r in got)
    probes = [
        (1, "you gurmpwit"), (2, 'the word "grumpwit" is rude, she said'), (3, "you grumpwit"), (4, None), (5, ""),
        (6, "plain words"), (7, "you grumpwiit")
    ]
    s = {r["doc_id"]: r for r in T.score(spark.createDataFrame(probes, "doc_id long, text string"), model).collect()}
    assert s[3]["predicted"] == 1 and s[2]["score"] < s[3]["score"] and s[1]["score"] > s[6]["score"] and s[7]["hits"][0]["edits"] == 1
    assert s[4]["score"] == s[5]["score"] == s[6]["score"] < 0.5 and 0 <= s[4]["score"]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = T.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in T.score(docs, model).collect()] == [0, 0]
    assert T.score(docs.limit(0), model).count() == 0


def test_held_out_is_by_the_id_as_text(spark):
    import zlib

    got = {r["i"]: r["h"] for r in spark.range(200).select(F.col("id").alias("i"), T.held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)}
