"""Language identification with a language-bitmask n-gram filter.

The filter is a bit-sliced Bloom filter: a slot holds one bit for each language, an n-gram sets its language's
bit in HASHES slots, and the AND of those slots returns at once all languages that may contain the n-gram.
A text's n-grams are looked up over the whole text; each language's popcount is corrected for the false
positives its slice gives, and the largest corrected count decides (ties: the first language by code point).

Null texts and texts without a letter give ``und`` with score 0. Training rows with null text or language are
not used; where nothing can be learned all predictions are ``und``. Each input row gives one row.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents a language on average that the model is fitted on (chosen by a hash of the id) and n-grams kept of each language.
FIT_DOCS = 1500
GRAMS = 3000
#: Distinct languages beyond which the column is taken for a mistake; there are fewer languages than that.
MOST_LANGUAGES = 10_000
#: log2 of the filter's slots, slots of an n-gram, and the n-gram lengths.
SLOT_BITS = 18
HASHES = 2
ORDERS = (3, 4)

_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIER = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _letters() -> np.ndarray:
    """Code point to itself for letters, to a blank otherwise."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c
    return out


_TABLE: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams whose inner characters are letters, and the text number of each."""
    if not _TABLE:
        _TABLE.append(_letters())
    framed = [f" {t.lower()} " for t in texts]
    codes = _TABLE[0][np.frombuffer("".join(framed).encode("utf-32-le", "replace"), dtype=np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in framed])
    wide, hashes, owners = codes.astype(np.uint64), [], []
    blank = codes == 32
    with np.errstate(over="ignore"):
        for n in ORDERS:
            size = len(codes) - n + 1
            if size <= 0:
                continue
            good = owner[:size] == owner[n - 1 :]
            for k in range(1, n - 1):
                good &= ~blank[k : size + k]
            at = np.flatnonzero(good)
            h = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ wide[at + k]) * _MULTIPLIER[k % 4]
                h ^= h >> np.uint64(29)
            hashes.append(h)
            owners.append(owner[at])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    return np.concatenate(hashes), np.concatenate(owners)


class Filter:
    """Slots of language bits, in as many 64-bit planes as the languages need."""

    def __init__(self, languages: list[str], learned: dict[str, np.ndarray], bits: int = SLOT_BITS, hashes: int = HASHES):
        self.languages, self.bits, self.hashes = languages, bits, hashes
        n = len(languages)
        self.kind = next((t for t, size in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if n <= size), np.uint64)
        self.width = np.dtype(self.kind).itemsize * 8
        self.planes = [np.zeros(1 << bits, dtype=self.kind) for _ in range(max(1, -(-n // self.width)))]
        for i, language in enumerate(languages):
            plane, bit = self.planes[i // self.width], self.kind(1 << (i % self.width))
            for slots in self.slots(learned[language]):
                plane[slots] |= bit
        fill = [np.count_nonzero(self.planes[i // self.width] & self.kind(1 << (i % self.width))) / (1 << bits) for i in range(n)]
        self.false = np.array([f**hashes for f in fill])

    def slots(self, h: np.ndarray):
        for k in range(self.hashes):
            yield (h >> np.uint64(64 - self.bits * (k + 1))).astype(np.int64) & ((1 << self.bits) - 1)

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        """Languages containing each n-gram, a bit for each."""
        out = None
        for slots in self.slots(h):
            found = [p[slots] for p in self.planes]
            out = found if out is None else [a & b for a, b in zip(out, found, strict=True)]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits of each text and language, and the number of its n-grams."""
        h, owner = grams(texts)
        masks = self.masks(h)
        total = np.bincount(owner, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            has = (masks[i // self.width] & self.kind(1 << (i % self.width))) != 0
            hits[:, i] = np.bincount(owner[has], minlength=len(texts))
        return np.clip((hits - total[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)), 0, None), total

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score, coverage): score is the winner's share of all languages' counts, coverage its share of the n-grams."""
        out: list[tuple[str, float, float]] = [("und", 0.0, 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        size, run = 0, []
        for i in [*asked, None]:
            if run and (i is None or size + len(texts[i]) > common.SLICE_BYTES // 4):
                hits, total = self.counts([texts[j] for j in run])
                for j, own, n in zip(run, hits, total, strict=True):
                    best = int(np.argmax(own))
                    every = float(own.sum())
                    out[j] = (self.languages[best], float(own[best]) / every if every else 0.0, min(1.0, float(own[best]) / n) if n else 0.0)
                size, run = 0, []
            if i is not None:
                size += len(texts[i])
                run.append(i)
        return out


def held_out(id_col: str = "doc_id", modulus: int = 3, part: int = 1):
    """Whether a document is kept from training, by the checksum of its id; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == part, F.lit(False))


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_docs: int = FIT_DOCS, n_grams: int = GRAMS) -> Filter:
    """Fit on about ``fit_docs`` whole documents a language; what reaches the driver is at most ``n_grams`` hashes a language.

    N-grams are ranked by how many of the sampled documents hold them.
    """
    common.small_batches(df.sparkSession)
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is {lang_col} a language?")
    sizes = {r["lang"]: r["n"] for r in found}
    languages = sorted(sizes)
    if not languages:
        return Filter([], {})
    rate = F.lit(1.0)
    for language, n in sizes.items():
        rate = F.when(F.col("lang") == language, F.lit(min(1.0, fit_docs / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < rate)

    def count(batches):
        held: dict[str, dict[int, int]] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = list(common.texts_of(batch))
            for language, text in zip(langs, texts, strict=True):
                own = held.setdefault(language, {})
                for h in np.unique(grams([text])[0]).view(np.int64).tolist():
                    own[h] = own.get(h, 0) + 1
                if len(own) > 400_000:
                    yield _counted(held.pop(language), language)
        for language, own in held.items():
            yield _counted(own, language)

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the sample is bounded, and so are a language's n-grams
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_grams).select("lang", "gram").toPandas()
    learned = {language: np.sort(own["gram"].to_numpy(dtype=np.int64)).view(np.uint64) for language, own in top.groupby("lang")}
    return Filter(languages, {language: learned.get(language, np.empty(0, np.uint64)) for language in languages})


def _counted(own: dict[int, int], language: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([language] * len(own), pa.string()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], names=["lang", "gram", "n"])


def predict(df: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and coverage of each row. The model is at most 256 KB for eight languages, and is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scan(batch: pa.RecordBatch):
        found = shared.value.predict(list(common.texts_of(batch, text_col)))
        yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())], names=[id_col, "lang_pred", "score", "coverage"])

    kind = df.schema[id_col].dataType.simpleString()
    return common.map_batches(df, [id_col, text_col], scan, f"{id_col} {kind}, lang_pred string, score double, coverage double")


def keep(df: DataFrame, model: Filter, text_col: str = "text", min_coverage: float = 0.02) -> DataFrame:
    """Rows whose text is written in a learned language: not ``und``, and its n-grams not nearly all unknown. All columns stay."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    common.small_batches(df.sparkSession)

    @F.pandas_udf("boolean")
    def known(texts):
        found = shared.value.predict([t or "" for t in texts])
        return pd.Series([x[0] != "und" and x[2] >= min_coverage for x in found], dtype=bool)

    return df.where(known(F.col(text_col)))
