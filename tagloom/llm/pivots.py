"""Embedding near-dedup with a pivot-permutation index.

Pivots are reference vectors. A vector is described by its NEAREST nearest pivots, nearest first. Its postings go to inverted
lists of SHARED pivots each: every choice of that many of its pivots whose ranks (0 for the nearest) add up to RANKS at most.
So two vectors meet if they share SHARED pivots that stand near the front of both orders; the counts of shared pivots are
taken by the lists themselves, and a list's length does not grow with the table. Vectors that meet are verified by cosine in
double precision.

Pivots come from a sample of at most SAMPLE vectors (chosen by hash; a bound on what reaches the driver), thinned by
farthest-first choice so that a crowded region takes few; their number follows the cube root of the number of vectors, so a
list's expected length stays the same up to MOST_PIVOTS (137 M vectors) and is 53 n / 1.1e10 beyond. Every vector is indexed,
in 53 lists. Two vectors of cosine exactly 0.95 in 64 dimensions (random directions, 3,000 pairs) meet with probability 0.998
at 300 pivots, 0.994 at 1,205 and 0.985 at 4,096.

A list is cut into blocks of BLOCK members and blocks are compared two by two, so no task holds a whole long list; a pair
is counted only in the first list that both are in. Tasks return, for each vector, its number of links and the least
vector of its part of the block, not pairs.

Equal vectors are one class (a 128-bit hash of their values). Vectors that are null, empty or zero, or hold null or non-finite
components link with nothing; so do vectors of different dimensions. Rows with a null id link, but a component of only such
rows has a null id. Repeated rows are vectors of their own that link with each other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, links
from .bagminhash import identity

THRESHOLD = 0.95
SAMPLE = 8192
NEAREST = 12
SHARED = 3
RANKS = 12
BLOCK = 512
#: Pivots: least, most, and the factor of the count under the cube root.
LEAST_PIVOTS, MOST_PIVOTS, CROWD = 32, 4096, 500


def vector(values) -> np.ndarray | None:
    """The vector in double precision, or None if it cannot link."""
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, dtype=np.float64)
    return x if np.isfinite(x).all() and np.abs(x).max() > 0 else None


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def classes(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, cid), and (cid, n, least id, vec) of each distinct vector."""

    def scan(batch: pa.RecordBatch):
        halves, vecs = [], []
        for value in batch.column(vec_col):
            x = vector(value.as_py())
            halves.append((None, None) if x is None else identity((x + 0.0).tobytes()))
            vecs.append(None if x is None else x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([h[0] for h in halves], pa.int64()), pa.array([h[1] for h in halves], pa.int64()), pa.array(vecs, pa.binary())], names=["id", "raw", "check", "vec"])

    rows = common.settle(common.map_batches(df, [id_col, vec_col], scan, f"id {df.schema[id_col].dataType.simpleString()}, raw bigint, check bigint, vec binary"))
    rows = common.apart(rows)
    solid = rows.where("cid is not null")
    one = solid.groupBy("cid").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    return rows.select("id", "cid"), common.settle(one.join(solid.select("cid", "vec").dropDuplicates(["cid"]), "cid"))


def choose(vectors: list[np.ndarray], wanted: int) -> dict[int, np.ndarray]:
    """Pivots of each dimension: the sample's first vector, then again and again the one farthest from all chosen."""
    out = {}
    for d in sorted({len(v) for v in vectors}):
        own = unit(np.array([v for v in vectors if len(v) == d]))
        chosen, near = [0], own @ own[0]
        while len(chosen) < min(wanted, len(own)):
            nxt = int(np.argmin(near))
            if near[nxt] > 1 - 1e-9:
                break
            chosen.append(nxt)
            near = np.maximum(near, own @ own[nxt])
        out[d] = own[chosen]
    return out


def describe(x: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Numbers of each unit vector's nearest pivots, nearest first (ties: the first)."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, : min(nearest, len(pivots))]


def lists_of(described: np.ndarray, d: int, shared: int = SHARED, ranks: int = RANKS) -> np.ndarray:
    """Keys of the inverted lists of each vector, as one number with the dimension."""
    have = described.shape[1]
    choices = [c for c in combinations(range(have), min(shared, have)) if sum(c) <= ranks]
    pivots = np.sort(described[:, choices], axis=2).astype(np.int64)
    key = np.full(pivots.shape[:2], d, dtype=np.int64)
    for k in range(pivots.shape[2]):
        key = key * MOST_PIVOTS + pivots[:, :, k]
    return key


def linked(x: np.ndarray, side: np.ndarray, mixed: bool, threshold: float) -> np.ndarray:
    """Which pairs of a list's block, or of two of its blocks, link."""
    link = x @ x.T >= threshold
    if mixed:
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    return link


def first_met(key: int, keys: np.ndarray) -> np.ndarray:
    """Which pairs of vectors, by the keys of their lists, are in no list before ``key`` together."""
    before = [np.sort(k[k < key]) for k in keys]
    if len(before) > 8:
        return links.overlaps([k.view(np.uint64) for k in before]) == 0
    sets = [set(k.tolist()) for k in before]
    return np.array([[a.isdisjoint(b) for b in sets] for a in sets])


def find(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of each row."""
    spark = df.sparkSession
    rows, distinct = classes(df, id_col, vec_col)
    total = distinct.count()
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, round((CROWD * total) ** (1 / 3)))))
    draw = F.xxhash64("cid", F.lit(5))
    sample = distinct.orderBy(draw, "cid").limit(min(SAMPLE, 8 * wanted)).select("vec").collect()
    shared_pivots = spark.sparkContext.broadcast(choose([np.frombuffer(r["vec"]) for r in sample], wanted))

    def index(batch: pa.RecordBatch):
        vecs = [np.frombuffer(v.as_buffer()) for v in batch.column("vec")]
        for d in sorted({len(v) for v in vecs}):
            at = [i for i, v in enumerate(vecs) if len(v) == d]
            if d not in shared_pivots.value:  # a dimension so rare that the sample lacks it: one list for all
                keys = np.full((len(at), 1), -d, np.int64)
            else:
                keys = lists_of(describe(unit(np.array([vecs[i] for i in at])), shared_pivots.value[d], nearest), d, shared)
            cids = batch.column("cid").take(pa.array(at))
            ends = pa.array(np.arange(len(at) + 1) * keys.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([cids, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=["cid", "keys"])

    posts = common.map_batches(distinct, ["cid", "vec"], index, "cid bigint, keys array<bigint>").select("cid", F.explode("keys").alias("key"))
    posts = common.settle(posts)
    long_ = posts.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = posts.join(long_, "key").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    member = member.withColumn("own", F.pmod(F.xxhash64("cid", "key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cid").join(distinct.select("cid", "n", "vec"), "cid")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    dealt = member.repartition(int(parts), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "cid")

    def solve(key, lo, hi, group):
        cids = np.array([g[0] for g in group])
        x = unit(np.array([np.frombuffer(g[2]) for g in group]))
        weight, side = np.array([g[1] for g in group]), np.array([g[3] for g in group])
        link = linked(x, side, lo != hi, threshold)
        at = np.flatnonzero(link.any(axis=1))
        if not len(at):
            return cids[at], weight[at], cids[at]
        cids, weight, link, pivots = cids[at], weight[at], link[np.ix_(at, at)], shared_pivots.value.get(x.shape[1])
        if pivots is not None:
            # a pair is counted only in the first list that both are in
            link &= first_met(key, lists_of(describe(x[at], pivots, nearest), x.shape[1], shared))
        counted = np.flatnonzero(link.any(axis=1))
        return cids[counted], (link @ weight)[counted], links.joined_heads(link, cids)[counted]

    def sweep(batches):
        for key, group in common.runs(batches, ("key", "lo", "hi"), ("cid", "n", "vec", "own")):
            if len(group) > 1:
                cids, n, head = solve(*key, group)
                if len(cids):
                    yield pa.RecordBatch.from_arrays([pa.array(cids), pa.array(n.astype(np.int64)), pa.array(head)], names=["cid", "links", "head"])

    found = common.settle(dealt.select("key", "lo", "hi", "own", "cid", "n", "vec").mapInArrow(sweep, "cid bigint, links bigint, head bigint"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    tree = links.components(found.select(F.col("cid").alias("a"), F.col("head").alias("b"))).withColumnRenamed("id", "cid")
    joined = distinct.select("cid", "n", "least").join(counts, "cid", "left").join(tree, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    marks = joined.join(least, "component").select("cid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(marks, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
