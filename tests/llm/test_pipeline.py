import random

import corpus_pipeline as P
from offerloom.llm import decontaminate, simhash, substring_dedup


def test_stages_keep_what_is_clean(spark, tmp_path):
    random.seed(9)
    pool = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(random.choices(pool, k=n))
    docs = [(i, text(120), "en", f"s{i % 3}", 0) for i in range(200)]
    toxic = set(range(0, 60, 2))
    docs = [(i, t + " grumpwit and scumlord" if i in toxic else t, *r) for i, t, *r in docs]
    passage = text(60)
    docs += [(300, passage + " " + text(100), "en", "s", 0), (301, text(100) + " " + passage, "en", "s", 0)]
    docs += [(400, docs[101][1], "en", "s", 0)]
    item = text(30)
    docs += [(500, text(100) + " " + item, "en", "s", 0), (501, "", "en", "s", 0), (502, None, "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(
        docs,
        "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(
        [(i, 1, int(i in toxic)) for i in range(200)],
        "doc_id long, quality int, toxic int"
    ).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "packing"]
    at = spark.read.parquet(f"{d}/documents.parquet")
    columns = at.columns
    kept = []
    for name, stage in P.STAGES:
        stage(spark, at, d).write.parquet(f"{d}/{name}")
        at = spark.read.parquet(f"{d}/{name}")
        if name != "packing":
            assert at.columns == columns
        kept.append({r["doc_id"]: r["text"] if name != "packing" else None for r in at.collect()})
    everything = {r[0] for r in docs}
    assert set(kept[0]) == everything - toxic
    assert set(kept[1]) == set(kept[0]) - {400, 502}  # null and empty texts have one fingerprint
    assert set(kept[2]) == set(kept[1]) and passage in kept[2][300] and passage not in kept[2][301] and len(kept[2][301].split()) == 100
    assert set(kept[3]) == set(kept[2]) - {500} and set(kept[4]) == set(kept[3])
    assert {r["doc_id"] for r in P.run(spark, d).collect()} == set(kept[4])


def test_stages_call_the_operators(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    assert simhash.keep_one(docs).count() == 1
    assert "kept" in substring_dedup.remove_repeats(docs).columns
    assert "contaminated" in decontaminate.decontaminate(docs, docs.withColumnRenamed("doc_id", "item_id")).columns
