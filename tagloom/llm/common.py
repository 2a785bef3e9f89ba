"""Shared pieces: table access, lineage cuts, Arrow row mapping and vectorised word hashing."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import packed, settle  # the operators' modules use them from here
from ..sources.tables import read_table

#: Rows and bytes of one Arrow batch; one longer row is taken alone.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: UTF-8 bytes that the vectorised code takes at once; one longer text is taken alone.
SLICE_BYTES = 1 << 20
#: Bits of the marks that are sent in place of many keys, 64 in a row: at most 2^18 rows, whatever the number of keys.
MARKS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def release(spark: SparkSession) -> None:
    """Let the driver find out which shuffles and checkpoints nothing refers to any more.

    Their files go before the next step; those of checkpoints only if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    The first round lets go of what Python held, so it takes a second one for the driver to see that nothing is left.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and in bytes, since texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def few(df: DataFrame, most: int) -> bool:
    """Whether ``df``, which is settled, has at most ``most`` rows and so may be broadcast."""
    return df.count() <= most


def sifted(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key``, a hash, may be among those of ``keys``; a bit that another key has set lets a row pass."""
    place, bit = F.shiftright(F.pmod(key, F.lit(MARKS)), 6), F.pmod(key, F.lit(64)).cast("int")
    marks = keys.select(place.alias("_place"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit")).groupBy("_place").agg(F.bit_or("_bit").alias("_bits"))
    return df.join(F.broadcast(marks), place == F.col("_place")).where(F.getbit("_bits", bit) == 1).drop("_place", "_bits")


def met(df: DataFrame, rows: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Join of ``df`` with ``rows``, which are settled, on columns of which the first is a hash.

    If they are ``small``, the rows are sent to ``df``. Else only their marks are, so the driver holds no more however many they
    are, and what the marks let pass is joined by a shuffle: the rest of ``df`` does not travel.
    """
    return df.join(F.broadcast(rows), on) if small else sifted(df, rows, on[0]).join(rows, on)


def row_key(id_col: str, text_col: str):
    """A number for a row's id and text, the same whenever the row is read; rows that repeat both share it."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def apart(rows: DataFrame) -> DataFrame:
    """Adds ``cid`` to rows with ``raw`` and ``check``, the halves of a text's 128-bit hash; null where they are.

    It is ``raw`` unless two texts share that half and differ in the other: then those but the first get a number of their own.
    """
    clash = packed(rows.where("raw is not null").groupBy("raw").agg(F.min("check").alias("lowest"), F.max("check").alias("highest")).where("lowest < highest").select(F.col("raw").alias("clash"), "lowest"))
    if clash.isEmpty():
        return rows.withColumn("cid", F.col("raw"))
    own = F.when(F.col("check") > F.col("lowest"), F.xxhash64("raw", "check")).otherwise(F.col("raw"))
    return settle(rows.join(clash, F.col("raw") == F.col("clash"), "left").withColumn("cid", own).drop("clash", "lowest"))


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over only the named columns, in batches of few rows."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.select(*columns).mapInArrow(run, schema)


def together(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """``fn`` with its small batches joined to larger ones."""

    def run(batch):
        held, size = [], 0
        for part in fn(batch):
            held.append(part)
            size += part.nbytes
            if size > BATCH_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def runs(batches, keys: tuple[str, ...], values: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal keys, as (keys, rows of values); only one run is held."""
    current, group = None, []
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in values), strict=True)
        for key, row in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), rows, strict=True):
            if key != current:
                if group:
                    yield current, group
                current, group = key, []
            group.append(row)
    if group:
        yield current, group


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts one by one; null counts as empty."""
    for value in batch.column(column):
        yield value.as_py() or ""


def sliced(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of texts with about SLICE_BYTES each."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def places_of(pattern) -> dict:
    """For each element of a sequence the bits of its places."""
    places: dict = {}
    for i, x in enumerate(pattern):
        places[x] = places.get(x, 0) | 1 << i
    return places


def edits(places: dict, m: int, text, anchored: bool) -> Iterator[int]:
    """Myers' bit-parallel distances of a pattern of ``m`` elements, not empty, after each element of ``text``.

    ``anchored``: to all of the text so far; else to the best part of it that ends there.
    """
    full, last, carry = (1 << m) - 1, 1 << (m - 1), int(anchored)
    up, down, distance = full, 0, m
    get = places.get
    for x in text:
        eq = get(x, 0)
        match = eq | down
        flat = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(flat | up)), up & flat
        if more & last:
            distance += 1
        elif less & last:
            distance -= 1
        more, less = (more << 1 | carry) & full, (less << 1) & full
        up, down = less | (full & ~(match | more)), more & match
        yield distance


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(x)


_RNG = np.random.default_rng(20240229)
#: ASCII letters and digits and every byte of a non-ASCII character belong to words.
WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_POWER_ROOT = np.uint64(0x9E3779B97F4A7C55)
_STEP = [np.uint64(x) for x in _RNG.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)]


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out[i] = out[i - 1] * _POWER_ROOT
    return out


_POWERS = _powers(256)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of already lower-cased UTF-8 texts, and the first word's index of each text (one more at the end)."""
    return word_lines(texts)[:2]


def word_lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, and the number of each word's line, counted over all texts."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    is_word = WORD_BYTE[joined]
    edge = np.diff(is_word.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate(([0], np.searchsorted(starts, text_ends)))
    if not len(starts):
        return np.empty(0, dtype=np.uint64), first, np.empty(0, dtype=np.int64)
    lengths = ends - starts
    inside = np.flatnonzero(is_word)
    offset = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(offset, lengths)
    with np.errstate(over="ignore"):
        scale = _POWERS[place & 255] + (place >> 8).astype(np.uint64)
        hashes = np.add.reduceat(_BYTE_CODE[joined[inside]] * scale, offset)
    return mix(hashes ^ lengths.astype(np.uint64)), first, np.searchsorted(np.flatnonzero(joined == 10), starts)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and their text numbers; a text with fewer words has one shingle of all of them."""
    counts = np.diff(first)
    n_shingles = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    owner = np.repeat(np.arange(len(counts)), n_shingles)
    begin = np.repeat(first[:-1], n_shingles) + np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    limit = first[1:][owner]
    padded = np.concatenate((words, np.zeros(width, dtype=np.uint64)))
    total = np.zeros(len(owner), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += np.where(begin + k < limit, padded[begin + k] * _STEP[k % 8] + np.uint64(k), np.uint64(0))
    return mix(total), owner


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash), ordered by both, with how often each occurs."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


def as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
