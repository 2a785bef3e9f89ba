"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a text with up to k edits (k = error rate x length). It is split into k + 1 pieces;
at least one piece must then occur unchanged. One automaton finds all pieces of all items, and Myers'
bit-parallel distance verifies a window around each hit. Items and texts are compared as lower-case words
joined by one blank.

Items of fewer than ``min_chars`` normalised characters are found where all their words stand unchanged; documents are not
rejected for them unless asked, since a short phrase is no leak. Null items and those without a word, and null and empty texts,
match nothing.
Repeated items are all reported; repeated texts are each reported.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Share of an item's characters that may be edited, and the shortest item searched with edits.
ERROR_RATE = 0.08
MIN_CHARS = 24
#: Characters of benchmark text that one pass holds and broadcasts; more items take more passes.
BLOCK_CHARS = 4 << 20

_WORD = re.compile(r"\w+")


def normalise(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def best_place(pattern: str, places: dict[str, int], text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of ``pattern`` in ``text`` with at most ``budget`` edits; the first end on ties."""
    best = None
    for j, distance in enumerate(common.edits(places, len(pattern), text, False)):
        if distance <= budget and (best is None or distance < best[0]):
            best = (distance, j + 1)
            if not distance:
                break
    return best


class Searcher:
    """All items of one block with their pieces and bit vectors."""

    def __init__(self, items: list[tuple], rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, short: bool = True):
        self.items = []
        uses: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            norm = normalise(text)
            whole = len(norm) < min_chars
            if not norm or whole and not short:
                continue
            budget, n = 0 if whole else int(len(norm) * rate), len(self.items)
            self.items.append((item_id, norm, budget, common.places_of(norm), whole))
            cuts = [len(norm) * j // (budget + 1) for j in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                uses.setdefault(norm[a:b], []).append((n, a))
        self.pieces = ahocorasick.Automaton()
        for piece, own in uses.items():
            self.pieces.add_word(piece, (len(piece), own))
        if uses:
            self.pieces.make_automaton()

    def search(self, text: str) -> list[tuple]:
        """(item id, edits, end in the normalised text) of each item found, best place of each."""
        if not self.items:
            return []
        norm = normalise(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (length, own) in self.pieces.iter(norm):
            for n, at in own:
                _, item, k, _, whole = self.items[n]
                begin = end + 1 - length - at
                if whole and (norm[begin - 1 : begin] not in ("", " ") or norm[end + 1 : end + 2] not in ("", " ")):
                    continue
                # an edit budget of k shifts the item's ends by k at most
                lo, hi = max(0, begin - k), min(len(norm), begin + len(item) + k)
                if hi - lo < len(item) - k:
                    continue
                known = windows.setdefault(n, [])
                if known and lo <= known[-1][1]:  # overlapping windows are scanned as one
                    known[-1][0], known[-1][1] = min(lo, known[-1][0]), max(hi, known[-1][1])
                else:
                    known.append([lo, hi])
        out = []
        for n, known in windows.items():
            item_id, item, k, places, _ = self.items[n]
            best = None
            for lo, hi in known:
                at = norm.find(item, lo, hi)
                hit = (0, at - lo + len(item)) if at >= 0 else self.likely(norm, lo, hi, item, k) and best_place(item, places, norm[lo:hi], k)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], lo + hit[1])
            if best:
                out.append((item_id, *best))
        return out

    @staticmethod
    def likely(norm: str, lo: int, hi: int, item: str, budget: int, q: int = 5) -> bool:
        """Necessary condition: an edit destroys at most one of the item's q-grams that do not overlap."""
        part = norm[lo:hi]
        missing = 0
        for i in range(0, len(item) - q + 1, q):
            if item[i : i + q] not in part:
                missing += 1
                if missing > budget:
                    return False
        return True


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (id, item, edits, end) for each document that holds an item within its error budget.

    The benchmark's size is measured first; beyond ``block_chars`` it is taken in blocks, each against all documents.
    """
    spark = docs.sparkSession
    wanted = items.where(F.length(item_text) > 0).select(F.col(item_id).alias("item"), F.col(item_text).alias("body"))
    chars = wanted.agg(F.sum(F.length("body") + 1)).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_arrow = to_arrow_type(items.schema[item_id].dataType)
    found = None
    for b in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([(r["item"], r["body"]) for r in own.collect()])

        def scan(batch: pa.RecordBatch, held=[], shared=shared):  # noqa: B006  one searcher for each task
            if not held:
                held.append(Searcher(shared.value, rate, min_chars))
            ids, kind = batch.column(id_col).to_pylist(), batch.schema.field(id_col).type
            rows = [(d, *hit) for d, t in zip(ids, common.texts_of(batch, text_col), strict=True) if t for hit in held[0].search(t)]
            if rows:
                d, i, e, p = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, kind), pa.array(i, item_arrow), pa.array(e, pa.int64()), pa.array(p, pa.int64())], names=["doc", "item", "edits", "end"])

        part = common.map_batches(docs, [id_col, text_col], scan, f"doc {id_kind}, item {item_kind}, edits bigint, end bigint")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents that hold no item; all columns and repeated rows stay.

    The filter runs in one pass over the rows themselves, so null or repeated ids do not matter.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rate, min_chars, short = options.get("rate", ERROR_RATE), options.get("min_chars", MIN_CHARS), options.get("short", False)
    block_chars = options.get("block_chars", BLOCK_CHARS)
    body = items.where(F.length("text") > 0).select(F.col("text").alias("body"))
    chars = body.agg(F.sum(F.length("body") + 1)).first()[0] or 0
    blocks = max(1, -(-int(chars) // block_chars))
    for b in range(blocks):
        own = body if blocks == 1 else body.where(F.pmod(F.xxhash64("body"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([(i, r["body"]) for i, r in enumerate(own.collect())])  # of a checked size

        @F.pandas_udf("boolean")
        def untouched(texts, held=[], shared=shared):  # noqa: B006
            if not held:
                held.append(Searcher(shared.value, rate, min_chars, short))
            return texts.map(lambda t: not (t and held[0].search(t))).astype(bool)

        docs = docs.where(untouched(F.col(text_col)))
    return docs
