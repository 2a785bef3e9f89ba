"""Substring dedup: MinHash banding of paragraphs and of windows, exact verification, removal by components.

Words are runs of letters and digits, lower case; places in a text are counted in words, whatever its lines.

* A paragraph is a line of MIN_WORDS words or more. Its five-word shingles are MinHashed; BANDS bands of ROWS rows meet for a
  pair of Jaccard similarity 0.8 with probability 1 - (1 - 0.8^2)^16 > 0.9999. Paragraphs that meet are verified: they link if
  the exact Jaccard similarity of their shingle sets is 0.8 or more, or if the edit distance in words is at most a tenth of
  the longer one's words. A tenth of the words substituted at random places leaves a similarity near 0.4; such pairs meet with
  probability 0.86 at 20 words, 0.90 at 30, 0.92 at 40 and 0.94 at 80 (3,000 simulated pairs each).
* A passage may stand inside a longer line or be broken into other lines. Every run of WINDOW five-word shingles is therefore
  MinHashed with one function: the shingle of least hash (the first on ties) marks a place, one for many runs, about every
  16 words. The UNIT words from there are a unit, and so are the UNIT words before the next place if that is farther; units
  link if all their words are equal. Two texts that share WINDOW + UNIT = 51 words in a row share a run with its marked place
  and the unit behind it, so no such passage is missed, and between the first and the last place no word is left out.

Of each component the first member (least id, null ids last, then row and place) stays. Members that touch or overlap in a
text are one passage. Only what stands in several rows counts, unless ``across`` is off. Shorter lines are listed only as
part of a passage, since headings and notices repeat in documents that are not copies.

Members with equal words are one class (a 128-bit hash). Null and empty texts have no passages. Rows with a null id take part.
Repeated rows are texts of their own, so their passages repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, links

WIDTH = 5
MIN_WORDS = 20
THRESHOLD = 0.8
EDIT_SHARE = 0.1
BANDS = 16
ROWS = 2
#: Shingles in a run of which one marks a place, and words of the unit that begins there.
WINDOW = 31
UNIT = 20
#: Paragraphs of a large bucket that are compared at once; each is sent to every block of its bucket.
BLOCK = 512
#: Wanted paragraphs, and units that repeat, up to which they are broadcast, with at most 180 bytes each; of more, marks are.
BROADCAST_ROWS = 100_000

_SEEDS, _ODD = (np.random.default_rng(seed).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) for seed in (77, 78))
_FOLD = np.uint64(0xB492B66FBE98F273)
_HALVES = (np.uint64(0x8F14E45FCEEA167A), np.uint64(0xD1B54A32D192ED03))
#: Low bits that hold a place beside a shingle's hash.
_PLACE_BITS = np.uint64(31)


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences."""
    if not a or not b:
        return max(len(a), len(b))
    *_, distance = common.edits(common.places_of(a), len(a), b, True)
    return distance


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(common.shingle_hashes(words, np.array([0, len(words)]), WIDTH)[0])


def shingles_of(data: bytes) -> np.ndarray:
    return shingle_set(np.frombuffer(data, dtype=np.uint64))


def alike(threshold: float = THRESHOLD, share: float = EDIT_SHARE):
    """Test of two paragraphs given as sequences of 64-bit word hashes."""
    many = all_alike(threshold, share)
    return lambda x, y: bool(many([x], [y])[0])


def common_elements(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` pairs of sets, whose first ones are owned by 0 to n - 1 and second ones by n to 2 n - 1: sizes of intersection and union."""
    pair = owner % n
    order = np.lexsort((owner, h, pair))
    h, owner, pair = h[order], owner[order], pair[order]
    other = np.append(True, (h[1:] != h[:-1]) | (pair[1:] != pair[:-1]))[: len(h)]
    each = np.append(True, owner[1:] != owner[:-1])[: len(h)] | other
    union = np.bincount(pair[other], minlength=n)
    return np.bincount(pair[each], minlength=n) - union, union


def all_alike(threshold: float = THRESHOLD, share: float = EDIT_SHARE):
    """The test of many pairs at once; only those that exact bounds leave are tested for edits."""

    def similar(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
        n = len(xs)
        words = np.frombuffer(b"".join([*xs, *ys]), dtype=np.uint64)
        first = np.concatenate(([0], np.cumsum([len(z) // 8 for z in (*xs, *ys)])))
        both, union = common_elements(*common.shingle_hashes(words, first, WIDTH), n)
        link = both >= threshold * union - 1e-9
        size = np.diff(first).reshape(2, n)
        longest = size.max(axis=0)
        most = (share * longest).astype(np.int64)
        asked = np.flatnonzero(~link & (most > 0) & (longest - size.min(axis=0) <= most))
        if len(asked):
            runs = np.concatenate((asked, asked + n))
            own, ends = gathered(words, first[runs], np.diff(first)[runs])
            each, owner, weight = common.weighted(own, np.repeat(np.arange(len(runs)), np.diff(ends)))
            # each word with its number among its equals; each edit takes at most one from those that both have
            nth = np.arange(len(own)) - np.repeat(np.cumsum(weight) - weight, weight)
            both, _ = common_elements(common.mix(np.repeat(each, weight) + nth.astype(np.uint64) * _FOLD), np.repeat(owner, weight), len(asked))
            for i in asked[both >= (longest - most)[asked]]:
                link[i] = few_edits(*(words[first[k] : first[k + 1]] for k in (i, i + n)), share)
        return link

    return similar


def few_edits(a: np.ndarray, b: np.ndarray, share: float = EDIT_SHARE) -> bool:
    most = int(share * max(len(a), len(b)))
    if abs(len(a) - len(b)) > most or most == 0:
        return False
    # the same start and end need no comparison
    n = min(len(a), len(b))
    start = int(np.argmin(np.append(a[:n] == b[:n], False)))
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    end = int(np.argmin(np.append((a[::-1][:n] == b[::-1][:n]), False)))
    a, b = a[: len(a) - end], b[: len(b) - end]
    # each edit takes at most one word from the words that both have
    if len(np.intersect1d(occurrences(a), occurrences(b), assume_unique=True)) < max(len(a), len(b)) - most:
        return False
    return edit_distance(a.tolist(), b.tolist()) <= most


def occurrences(words: np.ndarray) -> np.ndarray:
    """Each word mixed with its number among its equals, so repeats are elements of their own; in order."""
    ordered = np.sort(words)
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
    place = np.arange(len(ordered))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    return np.sort(common.mix(ordered + nth.astype(np.uint64) * _FOLD))


def widened(share: float = EDIT_SHARE):
    """Links by edits in a block: exact bounds of length and common words leave few pairs, and joined ones are not tested again."""

    def widen(data: list[bytes], asked: np.ndarray, head: np.ndarray) -> np.ndarray:
        words = [np.frombuffer(x, dtype=np.uint64) for x in data]
        size = np.array([len(x) for x in words])
        longest = np.maximum(size[:, None], size[None, :])
        most = (share * longest).astype(np.int64)
        asked = asked & (most > 0) & (np.abs(size[:, None] - size[None, :]) <= most)
        link = np.zeros_like(asked)
        at = np.flatnonzero(asked.any(axis=1))
        if not len(at):
            return link
        square = np.ix_(at, at)
        close = links.overlaps([occurrences(words[i]) for i in at]) >= (longest - most)[square] - 0.5
        head = head.copy()
        for i, j in np.argwhere(np.triu(asked[square] & close)):
            a, b = at[i], at[j]
            if head[a] != head[b] and few_edits(words[a], words[b], share):
                link[a, b] = link[b, a] = True
                head[head == head[b]] = head[a]
        return link

    return widen


def encoded(texts: list[str]) -> list[bytes]:
    return [t.lower().encode("utf-8", "replace") for t in texts]


def paragraphs(first: np.ndarray, line: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word's index, words) of each line with enough words, from ``common.word_lines``."""
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(np.append(begin, len(line)))
    begin, size = begin[size >= min_words], size[size >= min_words]
    return np.searchsorted(first, begin, side="right") - 1, begin, size


def gathered(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some runs, one after the other, and where each begins (one more at the end)."""
    first = np.concatenate(([0], np.cumsum(size)))
    return words[np.repeat(begin - first[:-1], size) + np.arange(first[-1])], first


def identities(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Both halves of the hash of each run of words (none empty), as signed numbers."""
    size = np.diff(first)
    if not len(size):
        return [np.empty(0, np.int64)] * 2
    place = (np.arange(len(words)) - np.repeat(first[:-1], size)).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = (np.add.reduceat(words * (common.mix(place + salt) | np.uint64(1)), first[:-1]) for salt in _HALVES)
        return [common.as_long(common.mix(x + size.astype(np.uint64) * _FOLD)) for x in sums]


def band_keys(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bucket keys of each run of words, none empty."""
    h, owner = common.shingle_hashes(words, first, WIDTH)
    n = len(first) - 1
    starts = np.searchsorted(owner, np.arange(n))
    out = np.empty((n, BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS if n else 0):
            key = np.full(n, band + 1, dtype=np.uint64)
            for row in range(band * ROWS, (band + 1) * ROWS):
                # hashes are mixed already, so an odd factor is order enough
                key = common.mix(key ^ np.minimum.reduceat((h ^ _SEEDS[row]) * (_ODD[row] | np.uint64(1)), starts)) * _FOLD
            out[:, band] = key
    return out


def marked(words: np.ndarray, first: np.ndarray, window: int = WINDOW, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """(text, word's index) of the units: at the places that hold the least shingle of some run of ``window``, and between them."""
    n = len(words) - WIDTH + 1
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            h += words[k : n + k] * (common.mix(np.uint64([k + 1])) | np.uint64(1))
    packed = (common.mix(h) >> _PLACE_BITS << _PLACE_BITS) | np.arange(n, dtype=np.uint64)
    # least of each run: from the ends of two blocks of its length
    rows = -(-n // window)
    block = np.full(rows * window, np.iinfo(np.uint64).max)
    block[:n] = packed
    block = block.reshape(rows, window)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    runs = n - window + 1
    least = np.minimum(behind[:runs], ahead[window - 1 : window - 1 + runs])
    text = np.searchsorted(first, np.arange(runs), side="right") - 1
    inside = np.arange(runs) + window + WIDTH - 1 <= first[text + 1]
    place = (least[inside] & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    text = text[inside]
    new = np.append(True, place[1:] != place[:-1])[: len(place)] & (place + unit <= first[text + 1])
    text, place = text[new], place[new]
    # where the next place is farther than a unit, the words before it are a unit too
    far = np.flatnonzero((np.diff(place) > unit) & (text[1:] == text[:-1])) + 1
    return np.insert(text, far, text[far]), np.insert(place, far, place[far] - unit)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text: id, k, row; start, size, raw, check and bands of its paragraphs; place, raw_unit, check_unit of its units."""
    keyed = docs.select(F.col(id_col).alias("id"), common.row_key(id_col, text_col).alias("k"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))

    def arrays(text: np.ndarray, n: int, columns: list[np.ndarray], wide: int = 1) -> list[pa.Array]:
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n)))) * wide, pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in columns]

    def scan(batch: pa.RecordBatch):
        texts = encoded(list(common.texts_of(batch)))
        for a, b in common.sliced(texts):
            n = b - a
            words, first, line = common.word_lines(texts[a:b])
            text, begin, size = paragraphs(first, line)
            own, bounds = gathered(words, begin, size)
            out = arrays(text, n, [begin - first[text], size, *identities(own, bounds)])
            out += arrays(text, n, [common.as_long(band_keys(own, bounds)).ravel()], BANDS)
            text, place = marked(words, first)
            own, bounds = gathered(words, place, np.full(len(place), UNIT))
            out += arrays(text, n, [place - first[text], *identities(own, bounds)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, n) for c in ("id", "k", "row")), *out], names=["id", "k", "row", "start", "size", "raw", "check", "bands", "place", "raw_unit", "check_unit"])

    lists = ", ".join(f"{c} array<bigint>" for c in ("start", "size", "raw", "check", "bands", "place", "raw_unit", "check_unit"))
    return common.map_batches(keyed, ["id", "k", "row", "text"], scan, f"id {docs.schema[id_col].dataType.simpleString()}, k bigint, row bigint, {lists}")


def _payload(docs: DataFrame, paras: DataFrame, id_col: str, text_col: str):
    """The words of wanted classes, from the text where one member stands."""

    def of(wanted: DataFrame) -> DataFrame:
        # combined in the tasks before the join, so a frequent paragraph is not one group of rows
        sources = paras.groupBy("cid").agg(F.min(F.struct("k", "start", "size", "raw", "check")).alias("s")).join(wanted, "cid").select("cid", "s.*")
        sources = common.packed(sources)
        small = common.few(sources, BROADCAST_ROWS)
        # at most the paragraphs of one document meet in a row
        sources = common.packed(sources.groupBy("k").agg(F.collect_list(F.struct("cid", "start", "size", "raw", "check")).alias("want")))
        texts = common.met(docs.select(common.row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text")), sources, ["k"], small)

        def scan(batch: pa.RecordBatch):
            texts, wants = encoded(list(common.texts_of(batch))), batch.column("want")
            for a, b in common.sliced(texts):
                words, ends = common.word_hashes(texts[a:b])
                want = wants.slice(a, b - a)
                text = np.repeat(np.arange(b - a), want.value_lengths().to_numpy())
                cid, begin, size, raw, check = (want.flatten().field(c).to_numpy() for c in ("cid", "start", "size", "raw", "check"))
                begin = begin + ends[text]
                fits = begin + size <= ends[text + 1]
                cid, begin, size, raw, check = (x[fits] for x in (cid, begin, size, raw, check))
                own, first = gathered(words, begin, size)
                halves = identities(own, first)
                right = np.flatnonzero((halves[0] == raw) & (halves[1] == check))
                yield pa.RecordBatch.from_arrays([pa.array(cid[right]), pa.array([own[first[i] : first[i + 1]].tobytes() for i in right], pa.binary())], names=["cid", "data"])

        return common.map_batches(texts, ["want", "text"], common.together(scan), "cid bigint, data binary").dropDuplicates(["cid"])

    return of


def _first(start: str):
    return F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", F.col(start).alias("start"))).alias("first")


def near_paragraphs(docs: DataFrame, read: DataFrame, id_col: str, text_col: str, threshold: float, across: bool) -> DataFrame:
    """(id, row, start, end, first, copies) of each paragraph that repeats, exactly or nearly."""
    each = read.select("id", "k", "row", "bands", F.posexplode(F.arrays_zip("start", "size", "raw", "check")).alias("i", "p"))
    paras = common.apart(each.select("id", "k", "row", F.col("p.start").alias("start"), F.col("p.size").alias("size"), F.col("p.raw").alias("raw"), F.col("p.check").alias("check"), F.slice("bands", F.col("i") * BANDS + 1, BANDS).alias("bands")))
    # copies share buckets, so one row of each class is enough
    reps = paras.select("cid", "bands").dropDuplicates(["cid"])
    found = links.linked(reps, _payload(docs, paras, id_col, text_col), all_alike(threshold), shingles_of, threshold, widened(), BLOCK)
    slim = paras.select("id", "row", "start", "size", "cid")
    # per class first, so a paragraph with many copies is combined before it is shuffled
    classes = slim.groupBy("cid").agg(_first("start"), F.count("*").alias("n"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    classes = classes.join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    whole = classes.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("copies"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    marks = classes.select("cid", "component").join(whole.where("lo < hi" if across else "copies > 1"), "component").select("cid", "first", "copies")
    return slim.join(marks, "cid").select("id", "row", "start", (F.col("start") + F.col("size")).alias("end"), "first", "copies")


def repeated_units(read: DataFrame, across: bool) -> DataFrame:
    """(id, row, start, end, first, copies) of each unit that repeats."""
    units = read.select("id", "row", F.explode(F.arrays_zip("place", "raw_unit", "check_unit")).alias("u"))
    units = units.select("id", "row", F.col("u.place").alias("start"), F.col("u.raw_unit").alias("raw"), F.col("u.check_unit").alias("check"))
    key = ["raw", "check"]
    # numbers alone first: most units stand once and go no further
    several = units.groupBy(*key).agg(F.count("*").alias("copies"), F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi" if across else "copies > 1")
    # what is joined is settled, so a unit that a great part of the texts hold can be split over tasks, or is not dealt at all
    several = common.packed(several.select(*key, "copies"))
    met = common.settle(common.met(units, several, key, common.few(several, BROADCAST_ROWS)))
    common.release(read.sparkSession)
    first = common.packed(met.groupBy(*key).agg(_first("start")))
    near = F.broadcast(first) if common.few(first, BROADCAST_ROWS) else first
    return met.join(near, key).select("id", "row", "start", (F.col("start") + UNIT).alias("end"), "first", "copies")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, across: bool = True) -> DataFrame:
    """(id, start_word, end_word, n_words, removed, copies, first_id, first_word) of each passage that repeats.

    ``removed`` is false where the passage stands first; ``copies`` counts the members of its largest component, and
    ``first_id`` and ``first_word`` tell where its first member stays.
    """
    read = common.settle(sketches(docs, id_col, text_col))
    spans = near_paragraphs(docs, read, id_col, text_col, threshold, across).unionByName(repeated_units(read, across))
    here = (F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))
    spans = spans.withColumn("removed", ~here)
    # the spans of one text that touch are one passage
    before = Window.partitionBy("row", "removed").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    spans = spans.withColumn("passage", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("row", "removed", "passage").agg(F.first("id").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("copies").alias("copies"), F.min(F.struct("start", "first.id", F.col("first.start").alias("at"))).alias("f"))
    return merged.select(F.col("id").alias(id_col), F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), "removed", "copies", F.col("f.id").alias("first_id"), F.col("f.at").alias("first_word"))
