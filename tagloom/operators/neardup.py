"""Exact near-duplicate join on word sets, and first-come acceptance under per-page caps.

Equal sets are collapsed to classes first, so copies cost nothing. The join is by neighbouring words: the words of a set are
ordered rarest first, the same way for all sets. What two sets with Jaccard >= t do not share lies in few of the gaps between
words that they share, so at least ``c`` pairs of neighbours stand in both, near the beginning of both orders. Candidates
are sets with that many pairs of neighbours in common, and their overlap is counted. Words are compared by 64-bit hashes.

The acceptance, sequential by definition, runs in rounds over all pages at once: rejecting is done in bulk, and only nodes
whose earlier neighbours are decided and whose rank on their page is below what the cap leaves are accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_set
from ..lineage import settle

THRESHOLD = (3, 4)  # fixed value: 0.75 as a fraction, compared in integers
#: Most frequent words that are ordered by how frequent they are; the others come before them, ordered by hash.
ORDERED_WORDS = 200_000
#: Pairs of neighbours that two sets must have in common, if they are large enough for so many.
COMMON = 4
#: Classes whose words are fetched together when overlaps are counted.
BLOCK = 64
#: Joined rows that are passed on at once.
JOINED_ROWS = 1 << 17


def classes_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, words) of all items: sorted hashes of the word set, and a key that equal sets share.

    An empty set is a set of one empty word, so empty sets equal each other.
    """
    found = F.sort_array(word_set(F.coalesce(F.col(text_col), F.lit(""))))
    sets = items.select(F.col(id_col).alias("id"), F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found).alias("w"))
    key = F.conv(F.substring(F.sha2(F.array_join("w", " "), 256), 1, 15), 16, 10).cast("long")
    return settle(sets.select("id", key.alias("key"), F.sort_array(F.transform("w", lambda x: F.xxhash64(x))).alias("words")))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def neighbours(keys: np.ndarray, sizes: np.ndarray, words: np.ndarray, known: np.ndarray, rank: np.ndarray, threshold: tuple[int, int]) -> dict[str, np.ndarray]:
    """Pairs of neighbours of sets: sig (of the pair), key, n, i (place from 1), before (of the words just before it).

    ``known`` are the hashes of the ordered words, sorted, and ``rank`` their places. The last word's neighbour is an end mark.
    """
    num, den = threshold
    doc = np.repeat(np.arange(len(keys)), sizes)
    at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
    place = np.where(known[at] == words, rank[at], 0) if len(known) else np.zeros(len(words), np.int64)
    # words of a set are sorted by hash, and the sort is stable
    order = np.argsort(doc * (ORDERED_WORDS + 1) + place, kind="stable")
    w = words[order].view(np.uint64)
    starts = np.cumsum(sizes) - sizes
    i = np.arange(len(w)) - np.repeat(starts, sizes)
    after = np.empty_like(w)
    after[:-1] = w[1:]
    after[starts + sizes - 1] = 0x5BD1E9955BD1E995
    # no partner's pairs lie beyond this place, see class_pairs
    least = -(-sizes * num // den)
    last = np.minimum(sizes, 2 * sizes + least - 3 * num * (sizes + least) // (num + den) + COMMON + 1)
    kept = np.flatnonzero(i < np.repeat(last, sizes))
    before = mixed(np.repeat(keys, sizes).astype(np.uint64)[kept] + np.uint64(0x9E3779B97F4A7C15))
    far = i[kept] >= COMMON
    run = np.zeros(int(far.sum()), np.uint64)
    for k in range(1, COMMON + 1):
        run = mixed(run + w[kept[far] - k])
    before[far] = run
    return {"sig": mixed(mixed(w[kept]) + after[kept]).view(np.int64), "key": np.repeat(keys, sizes)[kept], "at": (np.repeat(sizes, sizes)[kept] << 32) + i[kept] + 1, "before": before.view(np.int64)}


def common(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(a, b, c): sets with a pair of neighbours in common, and how many they need, from rows (sig, key, at, before) sorted by sig, at and key."""
    held: list[np.ndarray] = []
    for batch in batches:
        cols = np.stack([batch.column(c).to_numpy() for c in range(4)])
        if held:
            cols = np.concatenate([held.pop(), cols], axis=1)
        # the last pair's rows may go on in the next batch
        whole = int(np.searchsorted(cols[0], cols[0, -1]))
        held.append(cols[:, whole:])
        yield from joined(cols[:, :whole], threshold)
    if held:
        yield from joined(held.pop(), threshold)


def joined(cols: np.ndarray, threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    num, den = threshold
    if cols.shape[1]:
        # copies of a set have the same rows
        new = np.ones(cols.shape[1], bool)
        new[1:] = (cols[:3, 1:] != cols[:3, :-1]).any(axis=0)
        cols = cols[:, new]
    sig, key, at, before = cols
    ends = np.searchsorted(sig, sig, side="right")
    n, i = at >> 32, at & 0xFFFFFFFF
    # rows of a pair are sorted by size, so partners come after a row, as long as they are not too large
    left, step = np.arange(len(sig)), 1
    out: list[np.ndarray] = []
    while True:
        left = left[left + step < ends[left]]
        left = left[n[left + step] * num <= n[left] * den]
        if not len(left) or sum(map(len, out)) > 3 * JOINED_ROWS:
            if out:
                pairs_ = np.concatenate(out).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(pairs_[:, 0]), pa.array(pairs_[:, 1]), pa.array(pairs_[:, 2].astype(np.int32))], ["a", "b", "c"])
            out = []
        if not len(left):
            return
        x, y = left, left + step
        total = n[x] + n[y]
        o = (num * total + num + den - 1) // (num + den)
        enough = np.minimum(COMMON, 3 * o - total)
        good = (before[x] != before[y]) & (key[x] != key[y]) & (i[x] <= 2 * n[x] + n[y] - 3 * o + enough) & (i[y] <= 2 * n[y] + n[x] - 3 * o + enough)
        a, b = key[x[good]], key[y[good]]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b), enough[good]], axis=1).ravel())
        step += 1


def word_order(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places from 1) of the most frequent words, the most frequent last."""
    counted = classes.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df")).where("df > 1")
    top = counted.orderBy(F.desc("df"), "w").limit(ORDERED_WORDS).toPandas()["w"].to_numpy(np.int64)
    by_hash = np.argsort(top)
    return top[by_hash], (len(top) - by_hash).astype(np.int64)


def overlaps(batches: Iterator[pa.RecordBatch], threshold: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with the similarity, from rows of a block pair: its classes (key, words) and its candidates (a, b)."""
    num, den = threshold
    for batch in batches:
        out_a, out_b = [], []
        for row in range(batch.num_rows):
            held, cand = batch.column("held")[row].values, batch.column("cand")[row].values
            keys, lists = held.field("key").to_numpy(), held.field("words")
            sizes = np.diff(lists.offsets.to_numpy())
            words = lists.flatten().to_numpy()
            order = np.argsort(keys)
            a, b = cand.field("a").to_numpy(), cand.field("b").to_numpy()
            pa_, pb_ = order[np.searchsorted(keys, a, sorter=order)], order[np.searchsorted(keys, b, sorter=order)]
            common = np.zeros(len(a), np.int64)
            starts = np.cumsum(sizes) - sizes
            # the words of one class are marked at a time, and those of its partners looked up
            distinct, place = np.unique(words, return_inverse=True)
            mark = np.zeros(len(distinct), bool)
            by_a = np.argsort(pa_, kind="stable")
            cuts = np.flatnonzero(np.diff(pa_[by_a])) + 1
            for group in np.split(by_a, cuts):
                x = pa_[group[0]]
                own = place[starts[x] : starts[x] + sizes[x]]
                mark[own] = True
                for g in group:
                    y = pb_[g]
                    common[g] = np.count_nonzero(mark[place[starts[y] : starts[y] + sizes[y]]])
                mark[own] = False
            good = den * common >= num * (sizes[pa_].astype(np.int64) + sizes[pb_] - common)
            out_a.append(a[good])
            out_b.append(b[good])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])


def class_pairs(classes: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(a, b): keys of different classes with at least the given Jaccard similarity, a < b. The threshold is above 1/2.

    Sets of n and m words with similarity t share o >= t / (1 + t) * (n + m) words. In the order of all words, o pairs of
    successive shared words (the last with the end mark) have n + m - 2 o others between them at most, so 3 o - n - m of
    the pairs are neighbours in both sets; the c-th of those stands at place 2 (n - o) + (m - o) + c at most of the set of n words.
    A run of common pairs is counted up to ``COMMON``, which is enough to tell whether c are there.
    """
    num, den = threshold
    if 2 * num <= den:
        raise ValueError("the threshold must be above 1/2")
    known, rank = word_order(classes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                lists = part.column("words")
                got = neighbours(part.column("key").to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(), known, rank, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in got.values()], list(got))

    rows = classes.select("key", "words").mapInArrow(cut, "sig long, key long, at long, before long")
    found = rows.repartition("sig").sortWithinPartitions("sig", "at", "key").mapInArrow(lambda batches: common(batches, threshold), "a long, b long, c int")
    cand = settle(found.groupBy("a", "b", "c").agg(F.count("*").alias("k")).where("k >= c").select("a", "b"))
    # classes of one neighbourhood go to the same blocks, so that words are fetched once for many candidates
    label = cand.union(cand.select("b", "a")).groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("key")).alias("label"))
    rank_in = F.row_number().over(Window.partitionBy("label").orderBy("key")) - 1
    block = settle(label.select("key", "label", (rank_in / BLOCK).cast("int").alias("sub")))
    side = lambda c: block.toDF(c, f"label_{c}", f"sub_{c}")
    at = ["label_a", "sub_a", "label_b", "sub_b"]
    dealt = cand.join(side("a"), "a").join(side("b"), "b")
    needed = block.select("key").toPandas()["key"].sort_values().to_numpy(np.int64)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            at = np.searchsorted(needed, keys)
            yield batch.filter(pa.array(np.append(needed, -1)[at] == keys))

    words = classes.select("key", "words").mapInArrow(wanted, "key long, words array<long>").groupBy("key").agg(F.any_value("words").alias("words"))
    held = dealt.select(*at, F.col("a").alias("key")).union(dealt.select(*at, "b")).distinct().join(words, "key")
    blocks = held.groupBy(*at).agg(F.collect_list(F.struct("key", "words")).alias("held")).join(dealt.groupBy(*at).agg(F.collect_list(F.struct("a", "b")).alias("cand")), at)
    return blocks.select("held", "cand").mapInArrow(lambda batches: overlaps(batches, threshold), "a long, b long")


def pairs(items: DataFrame, id_col: str, text_col: str, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(id_a, id_b) of all items with near-duplicate texts, id_a < id_b: as many rows as there are pairs."""
    sets = classes_of(items, id_col, text_col)
    ids = sets.select("id", "key")
    near = settle(class_pairs(sets, threshold))
    both = near.union(near.select("b", "a")).union(ids.select("key", "key").distinct())
    joined = both.toDF("a", "b").join(ids.select(F.col("id").alias("id_a"), F.col("key").alias("a")), "a").join(ids.select(F.col("id").alias("id_b"), F.col("key").alias("b")), "b")
    return joined.where("id_a < id_b").select("id_a", "id_b")


def earlier_twin(items: DataFrame, order_col: str, text_col: str, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(order, first): for each item with an earlier near-duplicate the first such item; no pairs of items are made."""
    sets = classes_of(items, order_col, text_col)
    first = settle(sets.groupBy("key").agg(F.min("id").alias("first")))
    near = settle(class_pairs(sets, threshold))
    both = near.union(near.select("b", "a")).toDF("a", "key")
    other = both.join(first.select(F.col("key").alias("a"), "first"), "a").groupBy("key").agg(F.min("first").alias("other"))
    joined = sets.select("id", "key").join(first, "key").join(other, "key", "left").withColumn("first", F.least("first", "other"))
    return joined.where("first < id").select(F.col("id").alias(order_col), "first")


def decide(cards: DataFrame, existing: DataFrame, dropped: DataFrame, max_per_page: int = 4, limit: int = 0) -> DataFrame:
    """Adds ``accepted`` and ``reason`` ("" if accepted) to cards (seq, library_id, page_name, ad_text).

    Checks, in order: batch limit, known id, dropped id, no body, near-duplicate of an item or an accepted card, page cap.
    Existing items (ad_id, page_name, ad_text) count as accepted before the first card.
    """
    known, gone = existing.select(F.col("ad_id").alias("library_id")).distinct(), dropped.select(F.col("ad_id").alias("library_id")).distinct()
    # texts stay where they are; only whether one is empty goes on
    base = cards.select("seq", "library_id", "page_name", (F.col("ad_text") == "").alias("no_body"))
    base = base.join(known.withColumn("known", F.lit(True)), "library_id", "left").join(gone.withColumn("gone", F.lit(True)), "library_id", "left")
    sets = classes_of(cards.select(F.col("seq").alias("id"), "ad_text").unionByName(existing.select(F.lit(-1).cast("long").alias("id"), "ad_text")), "id", "ad_text")
    near = class_pairs(sets)
    near = settle(near.union(near.select("b", "a")).toDF("key", "other").unionByName(sets.select("key", F.col("key").alias("other")).distinct()))
    keyed = base.join(sets.where("id >= 0").select(F.col("id").alias("seq"), "key"), "seq")
    held = sets.where("id < 0").select("key").distinct()
    twin_of_held = near.join(held.withColumnRenamed("key", "other"), "other", "left_semi").select("key").distinct().withColumn("held", F.lit(True))
    counts = existing.groupBy("page_name").agg(F.count("*").alias("had"))
    nodes = keyed.join(twin_of_held, "key", "left").join(counts, "page_name", "left")
    out = F.col("known").isNotNull() | F.col("gone").isNotNull() | F.col("no_body") | F.col("held").isNotNull()
    open_ = nodes.where(~out).select("seq", "library_id", "page_name", "key", F.coalesce("had", F.lit(0)).alias("had"))
    twins = lambda rows, name: near.join(rows.groupBy(F.col("key").alias("other")).agg(F.min("seq").alias("s")), "other").groupBy("key").agg(F.min("s").alias(name))
    new = taken = None
    # only undecided cards are carried on; what a round accepts is looked up by those that are left
    while True:
        if new is None:
            seen = open_.withColumn("room", max_per_page - F.col("had"))
        else:
            got = taken.groupBy("page_name").agg(F.count("*").alias("got"))
            met = open_.join(twins(new, "twin"), "key", "left").join(new.groupBy("library_id").agg(F.min("seq").alias("same")), "library_id", "left").join(got, "page_name", "left")
            met = met.withColumn("room", max_per_page - F.col("had") - F.coalesce("got", F.lit(0)))
            seen = met.where(~F.coalesce((F.col("twin") < F.col("seq")) | (F.col("same") < F.col("seq")), F.lit(False)))
        seen = settle(seen.where("room > 0").select("seq", "library_id", "page_name", "key", "had", "room"))
        # a card is safe if nothing undecided before it can reject it
        first_id = seen.groupBy("library_id").agg(F.min("seq").alias("id_first"))
        ranked = seen.join(twins(seen, "near_first"), "key").join(first_id, "library_id").withColumn("rank", F.row_number().over(Window.partitionBy("page_name").orderBy("seq")))
        # the constant bound lets each task keep only the first few cards of a page before the shuffle
        safe = ranked.where(F.col("rank") <= max_per_page).where("rank <= room and near_first >= seq and id_first >= seq")
        new = settle(safe.select("seq", "library_id", "page_name", "key"))
        taken = new if taken is None else taken.unionByName(new)
        if new.isEmpty():
            break
        open_ = seen.drop("room").join(new.select("seq"), "seq", "left_anti")
    by_key, by_id = twins(taken, "twin"), taken.groupBy("library_id").agg(F.min("seq").alias("same"))
    state = taken.select("seq", F.lit(1).alias("state"))
    final = cards.join(nodes.select("seq", "key", "known", "gone", "held", "no_body"), "seq").join(state, "seq", "left").join(by_key, "key", "left").join(by_id, "library_id", "left")
    page = F.when(F.col("page_name") == "", "unknown page").otherwise(F.col("page_name"))
    reason = (
        F.when(F.col("known").isNotNull() | (F.col("same") < F.col("seq")), "already in gold file")
        .when(F.col("gone").isNotNull(), "previously dropped (see dropped.csv)")
        .when(F.col("no_body"), F.concat(F.lit("no body text ("), page, F.lit(")")))
        .when(F.col("held").isNotNull() | (F.col("twin") < F.col("seq")), F.concat(F.lit("duplicate text ("), F.col("page_name"), F.lit(")")))
        .otherwise(F.concat(F.lit(f"page cap of {max_per_page} reached ("), F.col("page_name"), F.lit(")")))
    )
    decided = final.select(*cards.columns, F.col("state").isNotNull().alias("accepted"), F.when(F.col("state").isNotNull(), "").otherwise(reason).alias("reason"))
    if not limit:
        return decided
    decided = settle(decided)
    last = decided.where("accepted").orderBy("seq").limit(limit).agg(F.max("seq").alias("s"), F.count("*").alias("n")).first()
    over = F.lit(last["n"] >= limit) & (F.col("seq") > F.lit(last["s"] if last["s"] is not None else 0))
    return decided.withColumns({"reason": F.when(over, f"batch limit of {limit} reached").otherwise(F.col("reason")), "accepted": F.col("accepted") & ~over})


def skip_summary(decided: DataFrame) -> DataFrame:
    """(outcome, n): how many cards were added, and skipped for each kind of reason."""
    kinds = {"batch limit": "batch limit", "already in": "known id", "previously": "dropped id", "no body": "no body", "duplicate": "duplicate", "page cap": "page cap"}
    outcome = F.when(F.col("accepted"), "added")
    for start, name in kinds.items():
        outcome = outcome.when(F.col("reason").startswith(start), name)
    return decided.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def new_rows(decided: DataFrame, search_term: str, first_seq: int = 0) -> DataFrame:
    """Accepted cards as item rows without labels, to be appended after ``first_seq`` rows."""
    from ..functions.text import source_url

    blank = F.lit("")
    rows = decided.where("accepted").withColumn("seq", F.col("seq") + first_seq)
    return rows.select("seq", F.col("library_id").alias("ad_id"), "page_name", "ad_text", source_url(F.col("library_id")).alias("source_url"), blank.alias("gold_goal"), blank.alias("gold_issue"), blank.alias("notes"), F.lit(search_term).alias("search_term"), "paid_for", "started_running", *(blank.alias(c) for c in ("label_mode", "suggested_goal", "suggested_issue", "suggestion_reason")))
