"""The stages against a brute-force pipeline on a small table, and the registered names."""

from collections import Counter

import corpus_pipeline
from tagloom.llm import decontam, langid, pii
from tagloom.llm.queries import queries

from .test_small import DOCS, bag, overlap, prose


def make(spark, tmp_path):
    import random

    rng = random.Random(41)
    letters = {"en": "abcdefgh", "fr": "mnopqrst"}
    rows = []
    for i in range(80):
        lang = "en" if i % 3 else "fr"
        table = str.maketrans("w0123456789", "w" + letters[lang] + "xy")
        rows.append([i, prose(rng, 60).translate(table), lang, f"s{i % 4}", 0])
    item = rows[9][1].split()[10:40]
    rows[20][1] = rows[8][1]
    rows[21][1] = rows[8][1] + " ab"
    rows[30][1] += " write to a.b@example.org now"
    rows[40][1] = None
    rows[41][1] = "12 34 !!"
    rows = [tuple(r[:4]) + (len(r[1] or ""),) for r in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, " ".join(item)


def test_pipeline(spark, tmp_path):
    rows, item = make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.learn(docs)
    kept = [r for r, p in zip(rows, model.predict([r[1] or "" for r in rows]), strict=True) if p[0] != "und" and p[2] >= 0.02]
    assert len(kept) == 78
    alone = [r for k, r in enumerate(kept) if not any(overlap(bag(r[1]), bag(s[1])) >= 0.8 for s in kept[:k])]
    search = decontam.Searcher([(0, item)])
    clean = [r for r in alone if not search.search(r[1])]
    assert len(clean) == 75 and 9 not in {r[0] for r in clean}
    sizes = {r[0]: len(pii._cleaned(r[1]).split()) for r in clean}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["size"] for r in got} == sizes and len(got) == len(sizes)
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - t) <= largest[s] for s, t in target.items()) and sum(target.values()) > 0.999 * sum(sizes.values())


def test_stages_keep_the_columns(spark, tmp_path):
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 11))
