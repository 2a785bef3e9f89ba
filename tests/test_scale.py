"""Steps whose cost must not grow faster than the input."""

import csv
import hashlib
import io
import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tagloom.operators import evaluate as ev
from tagloom.operators import neardup, paste
from tagloom.schema import ALL_COLUMNS, PREDICTION
from tagloom.sources import tables as tb


def test_texts_of_the_same_words_are_no_candidates():
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(10**9, 10**9 + 400), 60)) for _ in range(600)]
    sets.append(sorted(sets[0][3:] + [5, 6, 7]))
    sizes = np.array([len(x) for x in sets])
    df = Counter(w for x in sets for w in x)
    known = np.array(sorted(df), np.int64)
    rank = np.array([df[w] for w in known.tolist()], np.int64)
    rows = neardup.neighbours(np.arange(len(sets)), sizes, np.concatenate([np.array(x, np.int64) for x in sets]), known, rank, (3, 4))
    assert len(rows["sig"]) <= sum(sizes // 2 + 5)
    order = np.lexsort((rows["key"], rows["at"], rows["sig"]))
    batch = pa.RecordBatch.from_arrays([pa.array(rows[c][order]) for c in ("sig", "key", "at", "before")], ["sig", "key", "at", "before"])
    for cut in (len(order), 1000):  # groups may go on in the next batch
        met = Counter()
        for out in neardup.common(iter([batch.slice(k, cut) for k in range(0, len(order), cut)]), (3, 4)):
            met.update(zip(*(out.column(c).to_pylist() for c in range(3))))
        found = {(a, b) for (a, b, c), k in met.items() if k >= c}
        # of 180,300 pairs, nearly all of which share a word of their prefixes, 121 are candidates
        assert (0, 600) in found and len(found) < 1000


def test_bootstrap_takes_a_bit_for_each_item(spark):
    rng = random.Random(2)
    rows = [(run, field, f"{i:04d}", "x", "x" if rng.random() < 0.7 else "y") for run in "abc" for field in ("goal", "issue", "third") for i in range(300 + 50 * (run == "c"))]
    aligned = spark.createDataFrame(rows, "run string, field string, ad_id string, gold string, pred string").repartition(5)
    by_size = ev.planes_of(aligned)
    assert {n: [(len(g), own.dtype.itemsize, len(own)) for g, own in planes] for n, planes in by_size.items()} == {300: [(6, 1, 300)], 350: [(3, 1, 350)]}
    flags = {}
    for run, field, _, gold, pred in sorted(rows):
        flags.setdefault((run, field), []).append(gold == pred)
    want = {k: ev.bootstrap_exact(own, 100, seed=3) for k, own in flags.items()}
    assert {(r["run"], r["field"]): (r["ci_lo"], r["ci_hi"]) for r in ev.bootstrap(aligned, 100, seed=3).collect()} == want
    hashed = ev.bootstrap_hashed(aligned, 20)
    places = lambda n, b: [int(hashlib.md5(f"0:{b}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
    means = {k: sorted(sum(own[p] for p in places(len(own), b)) / len(own) for b in range(20)) for k, own in flags.items()}
    assert {(r["run"], r["field"]): (r["ci_lo"], r["ci_hi"]) for r in hashed.collect()} == {k: (m[0], m[19]) for k, m in means.items()}
    assert "Join" not in hashed._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    def never(*_, **__):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", never)
    texts = [f'text {i}, "quoted"\r\nsecond\nzwölf' for i in range(200)]
    blank = {c: "" for c in ALL_COLUMNS}
    rows = [tuple((blank | {"ad_id": str(i), "ad_text": t})[c] for c in ALL_COLUMNS) + (i,) for i, t in enumerate(texts)]
    items = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ALL_COLUMNS) + ", seq long").repartition(7)
    path = tmp_path / "gold.csv"
    for _ in range(2):
        tb.write_gold(items, str(path))
    want = io.StringIO()
    csv.writer(want).writerows([ALL_COLUMNS, *(r[:-1] for r in rows)])
    assert path.read_bytes() == want.getvalue().encode() and [p.name for p in tmp_path.iterdir()] == ["gold.csv"]
    preds = spark.createDataFrame([(str(i), "", "", "", "", "v", "m", "boom" if i % 3 else None, {"input_tokens": i}, k) for k in range(2) for i in range(50)], PREDICTION).repartition(5)
    assert tb.append_predictions(preds, str(tmp_path / "p.jsonl")) == tb.append_predictions(preds, str(tmp_path / "p.jsonl")) == 66
    lines = [json.loads(x) for x in (tmp_path / "p.jsonl").read_text().splitlines()]
    assert len(lines) == 200 and lines[0]["usage"] == {"input_tokens": int(lines[0]["ad_id"])} and lines[:100] == lines[100:]


def test_a_pasted_file_is_read_in_blocks(spark, tmp_path):
    cards = [f"Library ID: {i}\r\nStarted running on May {i % 28 + 1}, 2026\nPage {i % 7}\nSponsored • Paid for by C{i}\nbody {i}\x0bmore\n" + f"line {i}\n" * (i % 9) + "Active\n" for i in range(300)]
    for k in range(2):
        (tmp_path / f"paste-{k}.txt").write_text("junk\n" + "".join(cards[k::2]), encoding="utf-8", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        stream = tb.read_pastes(spark, str(tmp_path))
        assert stream.select("file", "block").distinct().count() > 8
        got = paste.numbered(paste.parse(stream)).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["library_id"] for r in got] == [str(i) for k in range(2) for i in range(k, 300, 2)] and [r["seq"] for r in got] == list(range(300))
    assert all(r["ad_text"] == "\n".join([f"body {r['library_id']}", "more", *[f"line {r['library_id']}"] * (int(r["library_id"]) % 9)]) and r["paid_for"] == f"C{r['library_id']}" for r in got)
