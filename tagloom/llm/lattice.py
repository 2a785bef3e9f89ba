"""Language-model scoring: the probability of a text as the sum over all its segmentations into subword pieces.

A text is its tokens (runs of non-blanks, A-Z lower-cased) and one end. A token's probability is the sum, over all ways to
cut it into pieces of an existing vocabulary (its first piece carries the vocabulary's word mark), of the product of the
pieces' probabilities; a log-space forward recursion gives the sum. A character that is no piece is spelled with the
vocabulary's byte pieces. The text's probability is the product over its tokens, times the end's.

The vocabulary's own scores are the first weights: log-probabilities of a unigram vocabulary as they are, ranks of a merge
vocabulary as -log(rank + 2). Expected piece counts over all training tokens then re-estimate them, EM_ROUNDS times; with
``rounds`` 0 the scores are the vocabulary's own.

Words are scored once each: training counts, lattice values and their table grow with the corpus and stay distributed. The
COMMON most frequent words (a bound on what is broadcast) are looked up where the text is; the rest by a join.

Null texts count as empty: one token, the end. Null ids are in training. Each input row gives one row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
EM_ROUNDS = 2
#: Most frequent words that are broadcast with their values: none longer than LONG characters, so at most 230 bytes each.
COMMON = 200_000
#: Distinct words that a task holds before it passes their counts on.
HELD = 300_000
#: Words scored at once.
GATHER = 50_000
#: Longer words are scored one by one.
LONG = 48

_BASE = np.uint64(0x9E6C63D0876A9A47)
_LN10 = float(np.log(10))


class Pieces:
    """The vocabulary with log-probabilities; substrings are found by hash in an open-addressing table."""

    def __init__(self, pieces: list[str], logp: np.ndarray, of_byte: np.ndarray, mark: str, end: float):
        self.pieces, self.logp, self.of_byte, self.mark, self.end = pieces, logp, of_byte, mark, end
        self.longest = max(map(len, pieces))
        self.single = {p: i for i, p in enumerate(pieces) if len(p) == 1}
        self.bits = 19
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.ids = np.full(1 << self.bits, -1, dtype=np.int32)
        for i, p in enumerate(pieces):
            if not p:  # bytes are no substrings
                continue
            h = self.hash_of(p)
            at = int(h >> np.uint64(64 - self.bits))
            while self.ids[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ids[at] = h, i

    @staticmethod
    def hash_of(text: str) -> np.uint64:
        h = np.zeros(1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for c in text:
                h = extend(h, np.array([ord(c)], dtype=np.uint64))
        return h[0]

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where the hash is no piece."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.ids[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.ids[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != h[open_])]
        return out

    def with_logp(self, logp: np.ndarray, end: float) -> Pieces:
        new = object.__new__(Pieces)
        new.__dict__.update(self.__dict__)
        new.logp, new.end = logp, end
        return new


def extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * _BASE
    return h ^ (h >> np.uint64(29))


def load(path: str = VOCABULARY) -> Pieces:
    """Read a sentencepiece vocabulary; only its pieces and scores are used."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names, scores, of_byte = [], [], np.full(256, -1, dtype=np.int64)
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(name[3:-1], 16)] = len(names)
            name = ""
        names.append(name)
        scores.append(model.get_score(i))
    score = np.array(scores)
    if np.array_equal(score, np.round(score)):  # merge ranks
        score = -np.log(np.abs(score) + 2)
    score[of_byte[of_byte >= 0]] = min(score.min(), float(np.sort(score)[len(score) // 4]))
    return Pieces(names, score - np.logaddexp.reduce(score), of_byte, "▁", float(np.log(1e-3)))


def _spelled(v: Pieces, code: int) -> tuple[float, list[int]]:
    ids = [int(v.of_byte[b]) for b in chr(code).encode("utf-8", "replace")]
    return float(sum(v.logp[i] for i in ids)), ids


def _arcs(v: Pieces, codes: np.ndarray):
    """(start, end, rows, log-probability, piece numbers or None, spelled code points) of all pieces in equally long words."""
    n, size = codes.shape
    lone = np.zeros(codes.shape, dtype=bool)
    for i in range(size):
        h = np.zeros(n, dtype=np.uint64)
        for j in range(i + 1, min(size, i + v.longest) + 1):
            h = extend(h, codes[:, j - 1])
            found = v.lookup(h)
            rows = np.flatnonzero(found >= 0)
            if j == i + 1:
                lone[rows, i] = True
            if len(rows):
                ids = found[rows]
                yield i, j, rows, v.logp[ids], ids, None
        rows = np.flatnonzero(~lone[:, i])
        if len(rows):
            chars = codes[rows, i]
            kinds, inverse = np.unique(chars, return_inverse=True)
            yield i, i + 1, rows, np.array([_spelled(v, int(k))[0] for k in kinds])[inverse], None, chars


def forward(v: Pieces, codes: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of each word; with counts, also adds the expected piece counts to ``expected``."""
    n, size = codes.shape
    alpha = np.full((size + 1, n), -np.inf)
    alpha[0] = 0
    arcs = []
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for arc in _arcs(v, codes):
            i, j, rows, lp, _, _ = arc
            alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + lp)
            if counts is not None:
                arcs.append(arc)
        if counts is not None:
            beta = np.full((size + 1, n), -np.inf)
            beta[size] = 0
            for i, j, rows, lp, ids, chars in reversed(arcs):
                beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + lp)
                post = np.exp(alpha[i, rows] + lp + beta[j, rows] - alpha[size, rows]) * counts[rows]
                if ids is not None:
                    expected += np.bincount(ids, weights=post, minlength=len(expected))
                else:
                    for c in np.unique(chars):
                        for b in _spelled(v, int(c))[1]:
                            expected[b] += post[chars == c].sum()
    return alpha[size]


def _long(v: Pieces, word: str, count: float | None, expected: np.ndarray | None) -> float:
    """The same recursion for one long word, in time and memory that grow with its length."""
    size = len(word)
    alpha, arcs = np.full(size + 1, -np.inf), []
    alpha[0] = 0
    index = v.index if hasattr(v, "index") else None
    if index is None:
        index = v.index = {p: i for i, p in enumerate(v.pieces) if p}
    for j in range(1, size + 1):
        terms = [(i, index[word[i:j]]) for i in range(max(0, j - v.longest), j) if word[i:j] in index]
        values = [alpha[i] + v.logp[p] for i, p in terms]
        spelled = word[j - 1] not in index
        if spelled:
            values.append(alpha[j - 1] + _spelled(v, ord(word[j - 1]))[0])
        alpha[j] = np.logaddexp.reduce(values)
        arcs.append((terms, spelled))
    if count is not None:
        beta = np.full(size + 1, -np.inf)
        beta[size] = 0
        for j in range(size, 0, -1):
            terms, spelled = arcs[j - 1]
            for i, p in terms:
                beta[i] = np.logaddexp(beta[i], beta[j] + v.logp[p])
                expected[p] += np.exp(alpha[i] + v.logp[p] + beta[j] - alpha[size]) * count
            if spelled:
                lp, ids = _spelled(v, ord(word[j - 1]))
                beta[j - 1] = np.logaddexp(beta[j - 1], beta[j] + lp)
                for b in ids:
                    expected[b] += np.exp(alpha[j - 1] + lp + beta[j] - alpha[size]) * count
    return float(alpha[size])


def score_words(v: Pieces, words: list[str], counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
    """Log-probabilities of words, grouped by length."""
    out = np.zeros(len(words))
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for size, own in by.items():
        if size > LONG:
            for i in own:
                out[i] = _long(v, v.mark + words[i], None if counts is None else counts[i], expected)
            continue
        for k in range(0, len(own), 4096):
            part = own[k : k + 4096]
            text = "".join(v.mark + words[i] for i in part)
            codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).reshape(len(part), size + 1).astype(np.uint64)
            out[part] = forward(v, codes, None if counts is None else counts[part], expected)
    return out


def tokens(text: str) -> list[bytes]:
    """Words of a text; bytes.lower and bytes.split know only ASCII letters and blanks."""
    return text.encode("utf-8", "replace").lower().split()


def is_held_out(value) -> bool:
    return value is not None and zlib.crc32(str(value).encode()) % 7 == 2


def gathered(batches, rows: int = GATHER):
    """Joins small batches, since words are scored in groups of equal length."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, c, seen): occurrences in training and in all documents; counted in the tasks before they are shuffled."""

    def scan(batches):
        train, rest = Counter(), Counter()

        def flush():
            words = list(train.keys() | rest.keys())
            if words:
                c = [train[w] for w in words]
                both = [x + rest[w] for x, w in zip(c, words, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array(c, pa.int64()), pa.array(both, pa.int64())], names=["word", "c", "seen"])
            train.clear()
            rest.clear()

        for batch in batches:
            for doc, text in zip(batch.column(id_col).to_pylist(), common.texts_of(batch, text_col), strict=True):
                (rest if is_held_out(doc) else train).update(tokens(text))
                if len(train) + len(rest) > HELD:
                    yield from flush()
        yield from flush()

    common.small_batches(docs.sparkSession)
    parts = docs.select(id_col, text_col).mapInArrow(scan, "word string, c bigint, seen bigint")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def learn(words: DataFrame, n_docs: int, v: Pieces, rounds: int = EM_ROUNDS) -> Pieces:
    """Re-estimate piece probabilities from rows (word, c); what reaches the driver is a number for each piece of the vocabulary."""
    spark = words.sparkSession
    first = v.logp.copy()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(v)

        def expect(batches, shared=shared):
            own = np.zeros(len(shared.value.logp))
            for batch in gathered(batches):
                score_words(shared.value, batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(np.float64), own)
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own[at])], names=["piece", "n"])

        sums = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(first))
        n[sums.column("piece").to_numpy()] = sums.column("n").to_numpy()
        # one more count a piece on average, dealt out by the vocabulary's own weights
        n += np.exp(first) * len(first)
        total = n.sum() + n_docs + 1
        v = v.with_logp(np.log(n / total), float(np.log((n_docs + 1) / total)))
        shared.unpersist()
    return v


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, common_words: int = COMMON, rounds: int = EM_ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    spark = docs.sparkSession
    counted = common.settle(word_counts(docs, id_col, text_col))
    n_docs = docs.select(F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 != 2, F.lit(True)).alias("t")).agg(F.coalesce(F.sum(F.col("t").cast("long")), F.lit(0)).alias("n")).first()["n"]
    facts = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train, n_types = facts["n"] + n_docs, facts["v"] + (n_docs > 0)
    bottom = np.log10(n_train + n_types + 1)
    model = spark.sparkContext.broadcast(learn(counted, n_docs, load(vocabulary), rounds))

    def lattice(batches):
        for batch in gathered(batches):
            lp = score_words(model.value, batch.column("word").to_pylist()) / _LN10
            yield from batch.append_column("lp", pa.array(lp)).to_batches()

    table = common.settle(counted.mapInArrow(lattice, "word string, c bigint, seen bigint, lp double"))
    common.release(spark)
    shared = spark.sparkContext.broadcast(_frequent(table, common_words))
    end_lp, end_c = model.value.end / _LN10, n_docs

    def scan(batches):
        # a row's number within its task; the rows are checkpointed before they are used, so a repeated task cannot change it
        uid = TaskContext.get().partitionId() << 36
        places, c, lp = shared.value
        logs = np.log10(c + 1.0)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(id_col).to_pylist(), common.texts_of(batch, text_col), strict=True):
                words = tokens(text)
                at = np.fromiter(map(places.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                hit = at[at >= 0]
                known = int(end_c > 0) + int(np.count_nonzero(c[hit]))
                base = float(np.log10(end_c + 1) - bottom + logs[hit].sum() - len(hit) * bottom)
                score = float(end_lp + lp[hit].sum())
                rare = [{"word": w.decode("utf-8", "replace"), "tf": n} for w, n in Counter(words[i] for i in np.flatnonzero(at < 0)).items()]
                for col, x in zip(cols, (uid, is_held_out(doc), len(words) + 1, known, base, score, rare), strict=True):
                    col.append(x)
                uid += 1
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "uid", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, uid bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<word:string,tf:bigint>>"
    rows = common.settle(docs.select(id_col, text_col).mapInArrow(scan, schema))
    rare = rows.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.word").alias("word"), F.col("r.tf").alias("tf")).join(table.select("word", "c", "lp"), "word")
    sums = rare.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * (F.log10(F.col("c") + 1) - float(bottom))).alias("b"), F.sum(F.col("tf") * F.col("lp")).alias("s"))
    out = rows.drop("rare").join(sums, "uid", "left")
    zero = F.lit(0.0)
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )


def _frequent(table: DataFrame, most: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """The most frequent words of at most LONG characters, at most ``most``, with their places in the arrays of counts and log-probabilities.

    Words are cut at a step of the frequency scale, found from a histogram, so nothing is sorted.
    """
    step = F.floor(8 * F.log2("seen")).cast("int")
    table = table.where(F.length("word") <= LONG)
    total, bound = 0, None
    for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        total += r["n"]
        if total > most:
            break
        bound = r["step"]
    rows = table.where(step >= bound if bound is not None else F.lit(False)).select("word", "c", "lp").toArrow()
    places = {w.encode(): i for i, w in enumerate(rows.column("word").to_pylist())}
    return places, rows.column("c").to_numpy(), rows.column("lp").to_numpy()
