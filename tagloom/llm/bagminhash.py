"""MinHash near-dedup of whole documents with BagMinHash over bags of word shingles.

A document is the bag of its five-word shingles (lower case, words of letters and digits); one with fewer words has one
shingle of all of them. BagMinHash draws, for each shingle, points of a Poisson process over the axis of weights and
SIGNATURE registers; a register keeps the earliest point whose weight level the document reaches. The axis is cut into
strips (0,1], (1,2], (2,4], (4,8] ..., so a weight w takes about log2(w) strips, and points of the strip that w ends in are
thinned by their level. Registers of two documents agree with probability equal to the weighted Jaccard similarity.
A document's processes are followed until SIGNATURE registers are surely filled: a number of points that does not
depend on its length.

BANDS bands of ROWS registers are the buckets; a pair of similarity 0.8 meets with probability 1 - (1 - 0.8^5)^20 = 0.9997.
Links are verified with the exact overlap of the bags, 0.8 or more.

Texts that are equal after normalisation are one class (a 128-bit hash). Null and empty texts, and texts without a letter
or digit, are grouped with nothing. Of a group the row of least id stays, rows with a null id last; rows that share an id are
told apart by their texts, and rows that repeat both are one. A group of only null ids has a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, links

WIDTH = 5
THRESHOLD = 0.8
BANDS = 20
ROWS = 5
SIGNATURE = BANDS * ROWS
#: Points are drawn up to the time at which all registers are filled with probability 1 - exp(-MARGIN); if not, up to twice that.
MARGIN = 6.0
#: Rows (removed or wanted documents) up to which their keys are broadcast, with at most 40 bytes each.
BROADCAST_ROWS = 1_000_000

_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_NEXT, _PLACE, _STRIP, _OCCURRENCE, _BAND = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xD1342543DE82EF95, 0xC6BC279692B5CC83, 0xDA942042E4DD58B5))


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split())


def identity(text: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(text)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def bags(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, text number, weight) of all normalised texts."""
    return common.weighted(*common.shingle_hashes(*common.word_hashes(texts), width))


def elements(texts: list[bytes], width: int = WIDTH) -> list[bytes]:
    """Each bag as the sorted set of (shingle, occurrence), so set overlap equals bag overlap."""
    h, owner, weight = bags(texts, width)
    again = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        each = common.mix(np.repeat(h, weight) + again.astype(np.uint64) * _OCCURRENCE)
    who = np.repeat(owner, weight)
    order = np.lexsort((each, who))
    ends = np.searchsorted(who[order], np.arange(len(texts) + 1))
    each = each[order]
    return [np.unique(each[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]


def signatures(h: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, size: int = SIGNATURE) -> np.ndarray:
    """Registers of ``n`` bags; infinite where a bag is empty."""
    out = np.full(n * size, np.inf)
    total = np.bincount(owner, weights=weight, minlength=n)
    until = np.where(total > 0, size * (np.log(size) + MARGIN) / np.maximum(total, 1), 0.0)
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        low, width = 0, 1
        while len(mine):
            _strip(h[mine], owner[mine], weight[mine], low, width, until, size, out)
            low, width = low + width, max(1, low + width)
            mine = mine[weight[mine] > low]
        todo &= np.isinf(out.reshape(n, size)).any(axis=1)
        until[todo] *= 2
    return out.reshape(n, size)


def _strip(h, owner, weight, low, width, until, size, out) -> None:
    """Points of the strip (low, low + width] of each element's process, up to its bag's time."""
    with np.errstate(over="ignore"):
        state = common.mix(h + np.uint64(low + 1) * _STRIP)
        time = np.zeros(len(h))
        while len(state):
            state = common.mix(state + _NEXT)
            time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            go = time <= until[owner]
            state, time, owner, weight = state[go], time[go], owner[go], weight[go]
            place = common.mix(state ^ _PLACE)
            register = ((place >> np.uint64(40)) * np.uint64(size) >> np.uint64(24)).astype(np.int64)
            where = owner * size + register
            if width > 1:
                reached = low + 1 + (place & np.uint64(width - 1)).astype(np.int64) <= weight
                np.minimum.at(out, where[reached], time[reached])
            else:
                np.minimum.at(out, where, time)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = registers.view(np.uint64).reshape(len(registers), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _BAND, (len(registers), bands)).copy()
    for k in range(rows):
        key = common.mix(key ^ bits[:, :, k]) * _NEXT
    return key


def _sketch(texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Both halves of the hash, and the bands, of each text; null where there is no word."""
    clean = [normal(t) for t in texts]
    keys = np.zeros((len(clean), BANDS), dtype=np.uint64)
    for start, end in common.sliced(clean):
        h, owner, weight = bags(clean[start:end])
        with np.errstate(over="ignore"):
            keys[start:end] = band_keys(signatures(h, owner, weight, end - start))
    ids = [identity(t) if t else (None, None) for t in clean]
    bands = pa.ListArray.from_arrays(pa.array(np.arange(len(clean) + 1) * BANDS, pa.int32()), pa.array(common.as_long(keys).ravel()), mask=pa.array([not t for t in clean], pa.bool_()))
    return pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()), bands


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k, raw, check, bands) of each row: k is its key; the others are null where there is no word."""
    keyed = docs.select(F.col(id_col).alias("id"), common.row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))

    def scan(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), *_sketch(list(common.texts_of(batch)))], names=["id", "k", "raw", "check", "bands"])

    return common.map_batches(keyed, ["id", "k", "text"], scan, f"id {docs.schema[id_col].dataType.simpleString()}, k bigint, raw bigint, check bigint, bands array<bigint>")


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def _payload(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str):
    def of(wanted: DataFrame) -> DataFrame:
        # combined in the tasks before the join, so a large class of copies is not one group of rows
        sources = rows.groupBy("cid", "raw", "check").agg(F.min("k").alias("k")).join(wanted, "cid").select(F.col("k").alias("source"), F.col("cid").alias("want"), "raw", "check")
        sources = common.packed(sources)
        # few keys are sent to the texts, so texts that nobody wants do not travel
        near = F.broadcast(sources) if common.few(sources, BROADCAST_ROWS) else sources
        texts = docs.select(common.row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text")).join(near, F.col("k") == F.col("source"))

        def scan(batch: pa.RecordBatch):
            clean = [normal(t) for t in common.texts_of(batch)]
            want, raw, check = (batch.column(c).to_pylist() for c in ("want", "raw", "check"))
            for start, end in common.sliced(clean):
                right = [i for i in range(start, end) if clean[i] and identity(clean[i]) == (raw[i], check[i])]
                if right:
                    yield pa.RecordBatch.from_arrays([pa.array([want[i] for i in right], pa.int64()), pa.array(elements([clean[i] for i in right]), pa.binary())], names=["cid", "data"])

        return common.map_batches(texts, ["want", "raw", "check", "text"], scan, "cid bigint, data binary").dropDuplicates(["cid"])

    return of


def _decided(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, k, class_id, component_id, kept) of each row."""
    rows = common.settle(sketches(docs, id_col, text_col))
    rows = common.apart(rows)
    solid = rows.where("cid is not null")
    # copies share buckets, so one row of each class is enough
    reps = solid.select("cid", "bands").dropDuplicates(["cid"])
    found = links.linked(reps, _payload(docs, solid, id_col, text_col), links.one_by_one(links.set_similar(threshold)), unpacked, threshold)
    classes = solid.groupBy("cid").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k")).alias("first"))
    classes = classes.join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = classes.groupBy("component").agg(F.min("first").alias("whole"))
    classes = classes.join(least, "component").select("cid", F.col("first.id").alias("class_id"), F.col("whole.id").alias("component_id"), F.col("whole.k").alias("stays"))
    out = rows.select("id", "k", "cid").join(classes, "cid", "left")
    alone = F.col("cid").isNull()
    own = lambda c: F.when(alone, F.col("id")).otherwise(F.col(c)).alias(c)
    return out.select("id", "k", own("class_id"), own("component_id"), (alone | (F.col("k") == F.col("stays"))).alias("kept"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, component_id, kept) of each row: least ids of equal texts and of linked texts; kept in the row that stays."""
    return _decided(docs, id_col, text_col, threshold).select(F.col("id").alias(id_col), "class_id", "component_id", "kept")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group; all columns stay. Rows without a word stay, and rows that repeat id and text count once."""
    decided = common.settle(_decided(docs, id_col, text_col, threshold).groupBy(F.col("k").alias("_k")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows")))
    common.release(docs.sparkSession)
    gone = decided.where("not _kept or _rows > 1").select("_k", "_kept")
    # keys to look up are a small part of the rows: broadcast if they are few, else joined by a shuffle
    near = F.broadcast(gone) if common.few(gone, BROADCAST_ROWS) else gone
    # columns are taken by table, so docs may have some of the same names
    joined, own = docs.join(near, common.row_key(id_col, text_col) == near["_k"], "left"), [docs[c] for c in docs.columns]
    once = joined.where(near["_k"].isNull()).select(*own)
    repeated = joined.where(near["_kept"]).select(*own).dropDuplicates([id_col, text_col])
    return once.unionByName(repeated)
