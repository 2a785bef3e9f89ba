"""Links between texts that meet in hash buckets, and the components they form.

Nothing here collects a bucket or a component: members of a bucket are first compared with one head, components are
found over the verified links, and only members of one bucket that are still in different components are compared with
each other: by pairs in small buckets, and in blocks within tasks, without a row for a pair, in large ones. So copies in
the thousands cost one comparison each, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Members of a bucket up to which its pairs are rows, and members of a block of a larger one where members may be long.
SMALL = 24
BLOCK = 128
#: Buckets with several members up to which they are broadcast, with 16 bytes each; of more, marks are.
BROADCAST_HEADS = 100_000
#: Heads that a group of texts which share all their buckets has.
HEADS = 4
#: Columns of an incidence matrix that are multiplied at once, and elements of all sets that are ordered at once.
COLUMNS = 4096
ELEMENTS = 1 << 19


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over the edges (a, b), for ids that have an edge.

    Each round takes the least label of the neighbours and then the label's own label, so chains shorten by doubling.
    """
    both = common.packed(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct())
    labels = common.packed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "id")
        hooked = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("mid"))
        above = hooked.select(F.col("id").alias("mid"), F.col("mid").alias("up"))
        step = common.packed(hooked.join(above, "mid").select("id", "old", F.least("mid", "up").alias("component")))
        done = step.where(F.col("component") < F.col("old")).isEmpty()
        labels = step.select("id", "component")
        if done:
            return labels


def crowds(rows: DataFrame) -> DataFrame:
    """(bucket, cid, head) of all buckets with several ids, from rows (cid, bands) with one row for each id.

    The head is the member of least cid xor a mask, of which there are HEADS: copies that share many buckets are compared
    with a few others and not with one for each bucket, and a head unlike the rest does not part a whole group.
    """
    spread = rows.select("cid", F.explode(F.array_distinct("bands")).alias("bucket"))
    mask = F.xxhash64(F.pmod("bucket", F.lit(HEADS)))
    mark = F.col("cid").bitwiseXOR(mask)
    heads = spread.groupBy("bucket").agg(F.min(mark).alias("least"), F.count("*").alias("n")).where("n > 1")
    heads = common.packed(heads.select("bucket", F.col("least").bitwiseXOR(mask).alias("head")))
    common.release(rows.sparkSession)
    # most buckets hold one text; the others, or marks of them, are sent to the rows, so the rest does not travel again
    return common.packed(common.met(spread, heads, ["bucket"], common.few(heads, BROADCAST_HEADS)))


def set_similar(threshold: float) -> Callable[[bytes, bytes], bool]:
    """Test of the Jaccard similarity of two sets given as sorted 64-bit values, or their bytes."""

    def similar(x, y) -> bool:
        if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
            return False
        a, b = (np.frombuffer(z, dtype=np.uint64) if isinstance(z, bytes) else z for z in (x, y))
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= threshold * (len(a) + len(b) - both) - 1e-9

    return similar


def one_by_one(similar: Callable[[bytes, bytes], bool]) -> Callable[[list[bytes], list[bytes]], list[bool]]:
    """A test of two as a test of many."""
    return lambda xs, ys: [similar(x, y) for x, y in zip(xs, ys, strict=True)]


def verified(pairs: DataFrame, data: DataFrame, similar: Callable[[list[bytes], list[bytes]], list[bool]]) -> DataFrame:
    """Pairs (a, b), with what other numbers they have, whose ``data`` (cid, data) pass the test."""
    own = pairs.columns

    def check(batch: pa.RecordBatch):
        yield batch.select(own).filter(pa.array(similar(batch.column("x").to_pylist(), batch.column("y").to_pylist()), pa.bool_()))

    joined = pairs.join(data.select(F.col("cid").alias("a"), F.col("data").alias("x")), "a").join(data.select(F.col("cid").alias("b"), F.col("data").alias("y")), "b")
    return common.map_batches(joined, [*own, "x", "y"], check, ", ".join(f"{c} bigint" for c in own))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets, given in order, by multiplying the incidence of the elements that several have.

    The sets are taken in ranges of their values, so long ones need no more memory than short ones.
    """
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    total = sum(map(len, sets))
    parts = max(1, -(-total // ELEMENTS))
    bounds = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    cuts = [[0, *np.searchsorted(x, bounds), len(x)] for x in sets]
    for k in range(parts):
        _overlaps([x[c[k] : c[k + 1]] for x, c in zip(sets, cuts, strict=True)], out)
    return out


def _overlaps(sets: list[np.ndarray], out: np.ndarray) -> None:
    """Adds the sizes of the intersections to ``out``."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    column = (np.cumsum(several) - 1)[place]
    keep = several[place]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part @ part.T


def joined_heads(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id that each member reaches over a symmetric relation."""
    head = ids.copy()
    while True:
        new = np.minimum(head, np.where(link, head[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == head).all():
            return head
        head = new


def compared_in_blocks(member: DataFrame, data: DataFrame, elements: Callable[[bytes], np.ndarray], threshold: float, widen: Callable | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the components of members of large buckets, enough of them to join what is linked.

    ``member`` has bucket, cid, component, base (the bucket's largest component), n_base and n_rest. Members outside the base
    component are compared with all, those inside only with those outside. No task holds more than two blocks. ``widen`` gives
    further links of a block from its data, the pairs that may be linked and are not yet joined, and the members' heads so far.
    """
    inside = F.col("component") == F.col("base")
    rest, base = (F.ceil(F.col(c) / block).cast("int") for c in ("n_rest", "n_base"))
    draw = F.xxhash64("cid", "bucket")
    dealt = member.withColumns({"own": F.when(inside, rest + F.pmod(draw, base)).otherwise(F.pmod(draw, rest)).cast("int"), "partners": F.when(inside, F.sequence(F.lit(0), rest - 1)).otherwise(F.sequence(F.lit(0), rest + base - 1))})
    dealt = dealt.withColumn("partner", F.explode("partners")).select("bucket", F.least("own", "partner").alias("lo"), F.greatest("own", "partner").alias("hi"), "own", "cid", "component")
    parts = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.join(data, "cid").repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").select("bucket", "lo", "hi", "own", "cid", "component", "data")

    def solve(batches):
        for (_, lo, hi), group in common.runs(batches, ("bucket", "lo", "hi"), ("own", "cid", "component", "data")):
            own, cid, component, data = zip(*group, strict=True)
            sets = [elements(x) for x in data]
            size = np.array([len(x) for x in sets], dtype=np.float64)
            both = overlaps(sets)
            link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            component, own, cid = np.array(component), np.array(own), np.array(cid)
            asked = component[:, None] != component[None, :]
            if lo != hi:
                asked &= own[:, None] != own[None, :]
            link &= asked
            head = joined_heads(link, cid)
            if widen is not None:
                link |= widen(data, asked & (head[:, None] != head[None, :]), head)
                head = joined_heads(link, cid)
            at = np.flatnonzero(head != cid)
            if len(at):
                # copies of one component say the same, so each two components are told once
                order = np.argsort(cid)
                links = np.unique(np.stack((component[order[np.searchsorted(cid, head[at], sorter=order)]], component[at]), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(solve, "a bigint, b bigint")


def linked(rows: DataFrame, payload: Callable[[DataFrame], DataFrame], similar: Callable[[list[bytes], list[bytes]], list[bool]], elements: Callable[[bytes], np.ndarray], threshold: float, widen: Callable | None = None, block: int = BLOCK) -> DataFrame:
    """(id, component) of the ids of rows (cid, bands) that have a verified link.

    ``payload`` gives (cid, data) of wanted cids. ``similar`` tests the data of members of a bucket, two by two. In blocks of large
    buckets the same test is the Jaccard similarity, ``threshold`` or more, of the sorted sets that ``elements`` gives, and what
    ``widen`` links besides; ``block`` is the number of members of a block, of which a task holds two.
    """
    spark = rows.sparkSession
    crowd = crowds(rows)
    common.release(spark)
    data = common.settle(payload(crowd.select("cid").distinct()))
    star = crowd.where("cid <> head").select(F.least("head", "cid").alias("a"), F.greatest("head", "cid").alias("b")).distinct()
    edges = common.packed(verified(star, data, similar))
    common.release(spark)
    found = components(edges)
    # members of one bucket that are in different components after the first comparison
    member = crowd.select("bucket", "cid").join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    shares = member.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("bucket").agg(F.max_by("component", "n").alias("base"), F.max("n").alias("n_base"), F.sum("n").alias("m")).where("m > n_base").withColumn("n_rest", F.col("m") - F.col("n_base"))
    member = common.packed(member.join(mixed, "bucket"))
    few = member.where(F.col("m") <= SMALL).select("bucket", "cid", "component")
    other = few.select("bucket", F.col("cid").alias("b"), F.col("component").alias("c2"))
    pairs = few.select("bucket", F.col("cid").alias("a"), F.col("component").alias("c1")).join(other, "bucket").where("a < b and c1 <> c2").select("a", "b", "c1", "c2").distinct()
    small = verified(pairs, data, similar).select("c1", "c2")
    large = compared_in_blocks(member.where(F.col("m") > SMALL), data, elements, threshold, widen, block)
    more = common.packed(small.union(large).toDF("a", "b").distinct())
    common.release(spark)
    return found if more.isEmpty() else merged(found, more)


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """(id, component) over ``found`` and links (a, b) between its components, or ids that are in none.

    What is joined already counts as one, so a large group's own links are not followed again.
    """
    whole = common.packed(components(more).select(F.col("id").alias("part"), F.col("component").alias("whole")))
    old = found.join(whole, F.col("component") == F.col("part"), "left").select("id", F.coalesce("whole", "component").alias("component"))
    new = whole.join(found.select(F.col("id").alias("part")), "part", "left_anti").select(F.col("part").alias("id"), F.col("whole").alias("component"))
    return common.packed(old.union(new))
