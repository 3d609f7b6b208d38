import random

import numpy as np
import pytest

import corpus_pipeline as P
from offerloom.llm import near_copies as J

DOCS = "doc_id long, text string"


def brute(docs, width=5, least=0.8):
    sets = []
    for i, t in docs:
        w = (t or "").lower().split()
        sets.append((i, {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()))
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, x) in enumerate(sets):
        for j, y in sets[n + 1 :]:
            if x == y or len(x & y) >= least * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def edited(w, n, rng):
    w = list(w)
    for k in rng.sample(range(len(w)), n):
        w[k] = f"z{rng.randint(0, 10**6)}"
    return " ".join(w)


def test_stage_drops_texts_of_a_hundred_words_with_one_word_edited(spark, tmp_path):
    rng = random.Random(3)
    docs = []
    for i in range(60):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(100)]
        docs += [(i, " ".join(w)), (1000 + i, edited(w, 1, rng))]
    kept = {r["doc_id"] for r in P.drop_near_copies(spark, spark.createDataFrame(docs, DOCS), str(tmp_path)).collect()}
    assert kept == set(range(60))


def test_components_against_brute_force(spark):
    rng = random.Random(8)
    docs = []
    for i in range(25):
        w = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([6, 30, 100, 400]))]
        docs += [(i + 100 * k, edited(w, rng.randint(0, max(1, len(w) // 25)), rng)) for k in range(rng.randint(1, 4))]
    w = [f"w{rng.randint(0, 5000)}" for _ in range(100)]
    docs += [(5000 + i, edited(w, 1, rng)) for i in range(40)]  # a large group, not all of them alike
    docs += [
        (9000, None), (9001, ""), (9002, " \n"), (9003, "one Two"), (9004, "ONE two"), (9005, "two one"),
        (9006, "a b c d e"), (9007, "a b c d")
    ]
    want = brute(docs)
    df = spark.createDataFrame([*docs, (None, "x")], DOCS).repartition(3)
    assert {r["doc"]: r["component"] for r in J.near_copies(df).collect()} == want
    assert sorted(
        (r["doc_id"] is None, r["doc_id"]) for r in J.keep_one(df).where("doc_id is not null").collect()
    ) == sorted((False, i) for i, c in want.items() if i == c)
    assert J.keep_one(df).where("doc_id is null").count() == 1


@pytest.mark.parametrize("replaced", [12, 25])
def test_twins_in_a_crowd_of_one_template(spark, replaced):
    """Texts of one template, each with a twin that is more alike: every twin is found, and with many words replaced nothing else."""
    rng = random.Random(replaced)
    template = [f"t{i}" for i in range(200)]
    docs = []
    for i in range(600):
        w = edited(template, replaced, rng).split()
        docs += [(i, " ".join(w)), (10_000 + i, edited(w, 1, rng))]
    found = {r["doc"]: r["component"] for r in J.near_copies(spark.createDataFrame(docs, DOCS).repartition(3)).collect()}
    assert sum(found[i] == found[10_000 + i] for i in range(600)) == 600
    if replaced == 25:
        assert len(set(found.values())) == 600


def test_rare_shingles_meet_all_similar_pairs(spark):
    """Against all pairs of sets with many common members."""
    rng = np.random.default_rng(4)
    sets = []
    for i in range(60):
        base = rng.choice(300, 40, replace=False) if i % 3 == 0 else base
        sets.append(np.unique(np.concatenate([rng.permutation(base)[: 40 - i % 5], rng.choice(10_000, i % 5) + 1000])).astype(np.int64))
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "no long, shingles binary")
    want = {(j, i) for i in range(60) for j in range(i + 1, 60) if J.similarity(sets[i], sets[j]) >= 0.8}
    met = {(r["a"], r["b"]) for r in J.crowd_pairs(df, 0.8).collect()}
    assert want and want <= met and len(met) < 60 * 59 / 4
    few = {(r["a"], r["b"]) for r in J.crowd_pairs(df, 0.8, few=2).collect()}
    assert few < met


def test_an_id_with_several_texts_joins_them(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    df = spark.createDataFrame([(5, a), (5, b), (2, a), (7, b), (8, "other")], DOCS)
    assert {(r["doc"], r["component"]) for r in J.near_copies(df).collect()} == {(5, 2), (2, 2), (7, 2), (8, 8)}
    assert J.near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_frequent_shingles_meet_all_similar_pairs_of_different_components(spark):
    """Twins of which every shingle stands in more sets than meet each other: against all pairs."""
    rng = np.random.default_rng(6)
    sets, twins = {}, set()
    for i in range(100):
        own = rng.permutation(60)[:40]
        sets[2 * i], sets[2 * i + 1] = np.sort(own), np.sort(np.append(own[:-1], 60 + i % 2))
        twins.add((2 * i + 1, 2 * i))
    df = spark.createDataFrame([(i, bytearray(x.astype(np.int64).tobytes())) for i, x in sets.items()], "no long, shingles binary")
    counts = J.counted(df)
    assert not twins & {(r["a"], r["b"]) for r in J.crowd_pairs(df, 0.8, few=20, counts=counts).collect()}
    places = J.frequent_places(*counts, 0.8, few=20)
    nodes = spark.createDataFrame([(i, bytearray(8)) for i in sets], "no long, prints binary")
    want = {(j, i) for i in sets for j in sets if j > i and J.similarity(sets[i], sets[j]) >= 0.8}
    for together, block in ((0, 10_000), (80, 7)):
        found = spark.createDataFrame([(i, 0) for i in range(together)], "node long, component long")
        met = {(r["a"], r["b"]) for r in J.apart_pairs(places, nodes, found, 0.8, 64, block).collect()}
        assert twins <= want and {(a, b) for a, b in want if a >= together} <= met
        assert not any(a < together for a, b in met)


def test_twins_without_a_rare_shingle_in_common(spark):
    """Texts of the same passages, each with a twin: what they have in common stands in more texts than meet each other."""
    rng = random.Random(11)
    passages = [[f"p{i}w{j}" for j in range(12)] for i in range(18)]
    docs = []
    for i in range(120):
        w = [x for k in sorted(rng.sample(range(18), 12)) for x in passages[k]]
        docs += [(i, " ".join(w)), (10_000 + i, edited(w, 1, rng))]
    found = {r["doc"]: r["component"] for r in J.near_copies(spark.createDataFrame(docs, DOCS).repartition(3), few=2).collect()}
    assert found == brute(docs)


def test_places_of_rarest_shingles_take_one_join(spark, monkeypatch):
    """Places against sorting each set; no join makes a row for each shingle of a crowd but the one that brings the counts."""
    rng = np.random.default_rng(9)
    template = np.arange(1000, 1050)
    sets = [np.sort(np.concatenate([template[: 45 + i % 5], rng.choice(900, i % 12, replace=False)])).astype(np.int64) for i in range(60)]
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "no long, shingles binary")
    nodes = {h: sum(h in x for x in sets) for h in {int(h) for x in sets for h in x}}
    want = set()
    for i, x in enumerate(sets):
        order = sorted((nodes[h], h) for h in x.tolist())
        want |= {(i, h, len(x), at) for at, (n, h) in enumerate(order[: len(x) - -(-len(x) * 8 // 10) + 1]) if n > 20}
    counts, plans, keep = J.counted(df), [], J.stored
    monkeypatch.setattr(J, "stored", lambda d, name: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or keep(d, name))
    found = J.frequent_places(*counts, 0.8, few=20).select("no", "hash", "size", "at").collect()
    assert want and {tuple(r) for r in found} == want and len(found) == len(want)
    assert sum(p.count("Join ") for p in plans) == 1
