"""Repeated passages and paragraphs against brute force, recall of both kinds of links, and defined results at the edges."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import bagminhash, common, links, paradedup

from .test_small import ODD, bag, docs_of, overlap

FRESH = 10**9


def fresh(rng, n):
    return [f"w{rng.randrange(FRESH)}" for _ in range(n)]


def broken(rng, words):
    """Words in lines and sentences that break anywhere."""
    return "".join(w + rng.choice([" "] * 12 + ["\n", ", ", ".\n\n", " - "]) for w in words)


def words_of(text):
    return bagminhash.normal(text or "").decode().split()


def runs_of(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def long_lines(text):
    return [w for line in (text or "").split("\n") if len(w := words_of(line)) >= paradedup.MIN_WORDS]


def sharing(texts, n):
    """Numbers of the texts that have a run of n words in common with another text."""
    seen = Counter(r for _, t in texts for r in runs_of(words_of(t), n))
    return {i for i, t in texts if any(seen[r] > 1 for r in runs_of(words_of(t), n))}


def corpus(rng, n=120):
    passages = [fresh(rng, rng.randrange(51, 70)) for _ in range(12)]
    notices = [" ".join(fresh(rng, 9)) for _ in range(3)]
    texts = []
    for i in range(n):
        lines = [" ".join(fresh(rng, rng.randrange(1, 60))) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:  # inside of a line, at either end of the text, or broken otherwise
            own = rng.choice(passages)
            body = " ".join(own) if i % 2 else broken(rng, own)
            lines.insert(rng.randrange(len(lines) + 1), " ".join(fresh(rng, rng.randrange(0, 30))) + " " + body.upper() + "! " + " ".join(fresh(rng, rng.randrange(0, 30))))
        if i % 5 == 0 and texts:  # a paragraph with few words changed
            w = rng.choice(long_lines(rng.choice(texts)[1]) or [fresh(rng, 30)])
            lines.append(" ".join("new" if k in (3, len(w) - 2) and len(w) > 25 else x for k, x in enumerate(w)))
        texts.append((i, "\n".join([*lines, rng.choice(notices), rng.choice(notices)])))
    return texts


def test_passages_equal_brute_force(spark):
    texts = corpus(random.Random(21))
    df = docs_of(spark, texts + [(i, t) for i, t in ODD if i != 904], extra=True)
    rows = paradedup.find(df).collect()
    listed = {r["doc_id"] for r in rows}
    must = sharing(texts, paradedup.WINDOW + paradedup.UNIT)
    assert len(must) > 30 and must <= listed
    lines = [(i, w, Counter(set(bag(" ".join(w))))) for i, t in texts for w in long_lines(t)]
    near = {i for i, _, a in lines for j, _, b in lines if i != j and overlap(a, b) >= 0.8}
    assert len(near & listed) >= 0.98 * len(near)
    test = paradedup.alike()
    seq = lambda w: common.word_hashes([" ".join(w).encode()])[0].tobytes()
    held = [(i, seq(w)) for i, w, _ in lines]
    may = sharing(texts, paradedup.UNIT) | {i for i, a in held for j, b in held if i != j and test(a, b)}
    assert listed <= may and len(may) < 0.8 * len(texts)
    by = dict(texts)
    for r in rows:
        assert 0 <= r["start_word"] < r["end_word"] <= len(words_of(by[r["doc_id"]])) and r["n_words"] == r["end_word"] - r["start_word"] and r["copies"] > 1
        assert r["removed"] or r["first_id"] == r["doc_id"]
    # each unit stands first in one place only
    assert paradedup.find(df.limit(0)).count() == 0


def test_every_shared_run_of_51_words_has_a_unit_in_common():
    rng = random.Random(5)
    for _ in range(300):
        run = fresh(rng, 51) if rng.random() < 0.7 else [f"v{rng.randrange(3)}" for _ in range(51)]
        units = []
        for _ in range(2):
            text = " ".join([*fresh(rng, rng.randrange(0, 90)), *run, *fresh(rng, rng.randrange(0, 90))]).encode()
            words, first = common.word_hashes([b"other text before", text])
            units.append({words[p : p + paradedup.UNIT].tobytes() for _, p in zip(*paradedup.marked(words, first), strict=True)})
        assert units[0] & units[1]


def test_places_do_not_depend_on_the_batch():
    rng = random.Random(6)
    texts = [" ".join(fresh(rng, n)).encode() for n in (0, 3, 34, 35, 36, 400, 51, 1)]
    words, first = common.word_hashes(texts)
    text, place = paradedup.marked(words, first)
    for i, t in enumerate(texts):
        alone = paradedup.marked(*common.word_hashes([t]))[1]
        assert (place[text == i] - first[i]).tolist() == alone.tolist()
    gaps = np.diff(place[text == 5])
    assert gaps.max() <= paradedup.UNIT and 8 < gaps.mean() < 16


@pytest.mark.parametrize(("n", "least"), [(20, 0.84), (40, 0.89), (80, 0.91)])
def test_edits_of_a_tenth_meet_in_a_bucket(n, least):
    rng = random.Random(n)
    met = 0
    for _ in range(500):
        a = fresh(rng, n)
        b = list(a)
        for k in rng.sample(range(n), n // 10):
            b[k] = "new"
        words, first = common.word_hashes([" ".join(x).encode() for x in (a, b)])
        x, y = paradedup.band_keys(words, first)
        met += bool(set(x.tolist()) & set(y.tolist()))
        assert paradedup.alike()(*(words[s:e].tobytes() for s, e in zip(first, first[1:], strict=False)))
    assert met >= least * 500


def test_paragraphs_linked_by_edits_are_found(spark):
    rng = random.Random(4)
    texts = []
    for k in range(100):
        a = fresh(rng, 40)
        b = list(a)
        for p in rng.sample(range(40), 4):
            b[p] = "new"
        texts += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    df = docs_of(spark, texts)
    read = paradedup.sketches(df)
    rows = paradedup.near_paragraphs(df, read, "doc_id", "text", 0.8, True).collect()
    pairs = {r["id"]: r["first"]["id"] for r in rows}
    assert all(first == i - i % 2 for i, first in pairs.items()) and len(pairs) >= 2 * 88


@pytest.mark.parametrize("others", [4, 150])
def test_edits_link_members_of_a_bucket_whose_head_is_unlike(spark, others):
    rng = random.Random(15)
    a = fresh(rng, 40)
    b = list(a)
    b[5], b[37] = "changed", "altered"
    texts = [" ".join(x) for x in (a, b, *(a[:34] + fresh(rng, 12) for _ in range(others)))]
    assert overlap(Counter(set(bag(texts[0]))), Counter(set(bag(texts[1])))) < 0.8
    df = docs_of(spark, list(enumerate(texts)))
    rows = paradedup.near_paragraphs(df, paradedup.sketches(df), "doc_id", "text", 0.8, True).collect()
    assert {(r["id"], r["first"]["id"], r["copies"]) for r in rows} == {(0, 0, 2), (1, 0, 2)}


def test_repeated_rows_null_ids_and_marked_copies(spark):
    rng = random.Random(8)
    line, other, third = (" ".join(fresh(rng, 24)) for _ in range(3))
    texts = [(1, line), (2, f"x\n{line.upper()}!"), (3, "short one"), (4, None), (None, other), (None, other), (5, third + "\n" + third), (6, other + " and more")]
    got = Counter((r["doc_id"], r["start_word"], r["removed"], r["copies"], r["first_id"]) for r in paradedup.find(docs_of(spark, texts)).collect())
    assert got[1, 0, False, 2, 1] == got[2, 1, True, 2, 1] == 1
    # the row with an id comes first, both rows without one are removed
    assert got[6, 0, False, 3, 6] == 1 and got[None, 0, True, 3, 6] == 2 and sum(got.values()) == 5
    inside = paradedup.find(docs_of(spark, [(5, third + "\n" + third)]), across=False).collect()
    assert sorted((r["start_word"], r["removed"]) for r in inside) == [(0, False), (24, True)]


def test_one_very_long_text_and_a_hot_passage(spark):
    rng = random.Random(2)
    long_ = fresh(rng, 60_000)
    hot = fresh(rng, 60)
    texts = [(0, " ".join(long_)), (1, "\n".join(" ".join(long_[i : i + 7]) for i in range(0, 60_000, 7))), (2, "x" * 300_000)]
    texts += [(10 + i, " ".join(fresh(rng, 5) + hot + fresh(rng, 5))) for i in range(400)]
    rows = paradedup.find(docs_of(spark, texts)).collect()
    covered = Counter()
    for r in rows:
        covered[r["doc_id"]] += r["n_words"]
    assert covered[0] > 59_900 and covered[1] > 59_900 and 2 not in covered
    assert {i for i in covered if i >= 10} == set(range(10, 410)) and sum(not r["removed"] for r in rows if r["doc_id"] >= 10) >= 1
    # which places near the ends of the run are marked depends on the words around it, so some of them first stand elsewhere
    assert {r["doc_id"] for r in rows if r["removed"] and r["doc_id"] >= 10} >= set(range(11, 410))


@pytest.mark.parametrize("most", [0, 10**6])
def test_keys_are_sent_or_joined(spark, monkeypatch, most):
    """Both plans for fetching texts and for filtering give the same rows."""
    monkeypatch.setattr(paradedup, "BROADCAST_ROWS", most)
    monkeypatch.setattr(bagminhash, "BROADCAST_ROWS", most)
    rng = random.Random(3)
    line = fresh(rng, 60)
    edited = [*line[:30], "new", *line[31:]]
    df = docs_of(spark, [(1, " ".join(line)), (2, " ".join(edited)), (3, " ".join(line[:40])), (4, " ".join(line))]).withColumns({"_k": F.lit(1), "_kept": F.lit("x")})
    rows = {(r["doc_id"], r["removed"]) for r in paradedup.find(df).collect()}
    assert (1, False) in rows and {(2, True), (3, True), (4, True)} <= rows
    kept = bagminhash.keep(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_texts_that_share_half_of_their_hash_stay_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 5), (5, None, None)], "id long, raw long, check long")
    got = {r["id"]: r["cid"] for r in common.apart(rows).collect()}
    assert got[1] == got[3] == 7 and got[2] not in (7, 8) and got[4] == 8 and got[5] is None


def test_overlaps_in_ranges(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 5, 400, 900)]
    sets.append(np.unique(np.concatenate((sets[2][:100], sets[3][50:300]))))
    whole = links.overlaps(sets)
    monkeypatch.setattr(links, "ELEMENTS", 64)
    assert (links.overlaps(sets) == whole).all() and whole[4, 2] == 100 and whole[4, 3] == 250


def sent_rows(monkeypatch):
    """Rows of each table that is broadcast from now on."""
    sizes, send = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: sizes.append(df.count()) or send(df))
    return sizes


def test_the_driver_holds_a_bounded_part_of_the_repeated_units(spark, monkeypatch):
    sizes, n = sent_rows(monkeypatch), 300_000
    unit = lambda k: F.array(F.xxhash64(k))
    read = spark.range(2 * n + 1000).select("id", F.col("id").alias("row"), F.array(F.lit(7).cast("bigint")).alias("place"), unit(F.when(F.col("id") < 2 * n, F.col("id") % n).otherwise(F.col("id"))).alias("raw_unit"), unit(F.lit(1)).alias("check_unit"))
    rows = paradedup.repeated_units(read, True)
    got = rows.agg(F.count("*"), F.min("copies"), F.max("copies"), F.sum((F.col("first.row") == F.col("id") % n).cast("int")), F.max("id")).first()
    assert tuple(got) == (2 * n, 2, 2, 2 * n, 2 * n - 1)
    assert sizes and max(sizes) <= common.MARKS // 64


@pytest.mark.parametrize("marks", [1 << 24, 64])
def test_marks_lose_no_row(spark, monkeypatch, marks):
    """Also where they let everything pass."""
    monkeypatch.setattr(common, "MARKS", marks)
    df = spark.range(-2000, 2000).select(F.xxhash64("id").alias("k"), "id")
    rows = common.settle(df.where("id % 3 = 0").select("k", F.lit(1).alias("n")))
    got = [r["id"] for small in (False, True) for r in common.met(df, rows, ["k"], small).collect()]
    assert sorted(got) == sorted([i for i in range(-2000, 2000) if i % 3 == 0] * 2)
    assert common.sifted(df, rows, "k").count() <= (1400 if marks > 64 else 4000)


def test_many_pairs_are_tested_as_one():
    """Jaccard or edits by their definitions, for pairs of all lengths at once."""
    rng = random.Random(21)
    xs, ys = [], []
    for _ in range(600):
        a = [rng.randrange(12 if rng.random() < 0.3 else FRESH) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(0, 9)):
            p = rng.randrange(len(b))
            b[p : p + rng.randrange(2)] = [rng.randrange(12)] * rng.randrange(2) or b[p : p + 1]
        xs.append(a)
        ys.append(b if rng.random() < 0.9 else [rng.randrange(12) for _ in range(30)])
    got = paradedup.all_alike()(*([np.array(w, dtype=np.uint64).tobytes() for w in z] for z in (xs, ys)))

    def linked(a, b):
        s, t = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
        most = int(0.1 * max(len(a), len(b)))
        return len(s & t) >= 0.8 * len(s | t) - 1e-9 or most > 0 and paradedup.edit_distance(a, b) <= most

    want = [linked(a, b) for a, b in zip(xs, ys, strict=True)]
    assert list(got) == want and 100 < sum(want) < 500


def test_small_results_are_settled_in_few_files(spark, monkeypatch):
    docs = docs_of(spark, corpus(random.Random(5), 60))
    want = sorted(map(tuple, paradedup.find(docs).collect()))
    files, before = [], type(docs).checkpoint

    def checkpoint(df, *args, **kwargs):
        out = before(df, *args, **kwargs)
        files.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(type(docs), "checkpoint", checkpoint)
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, paradedup.find(docs).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # one for each task of every step before, 50 and more
    assert len(files) > 10 and sum(n >= 50 for n in files) <= 1 and sorted(files)[len(files) // 2] == 1


def test_packed_results_are_whole_and_nothing_stays_held(spark):
    rows = spark.range(400_000, numPartitions=40).select(F.xxhash64("id").alias("h"))
    out = common.packed(rows)
    assert 1 < out.rdd.getNumPartitions() < 40 and out.count() == 400_000 and out.exceptAll(rows).isEmpty()
    none = common.packed(rows.where("h is null"))
    assert none.rdd.getNumPartitions() == 1 and none.isEmpty() and none.schema == rows.schema
    assert not rows.is_cached and rows.storageLevel.useDisk is False
