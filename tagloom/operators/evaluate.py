"""Evaluation of label runs against gold labels.

All metrics of any number of runs, fields and subsets come from one long table (run, field, ad_id, gold, pred) and, except
for resampling and paired tests, from its confusion cells: one shuffle whose result is a few rows for each group.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ERROR_LABEL, FIELDS, taxonomy
from ..sources.tables import TableError

KEYS = ("run", "field")


def last_write_wins(preds: DataFrame, *keys: str) -> DataFrame:
    """The record with the highest seq of each ad_id (and further keys); combined before the shuffle."""
    by = [*keys, "ad_id"]
    rest = [c for c in preds.columns if c not in by]
    # the order needs only seq, and max_by carries any type
    newest = preds.groupBy(*by).agg(F.max_by(F.struct(*rest), "seq").alias("r"))
    return newest.select(*by, *(F.col(f"r.{c}").alias(c) for c in rest))


#: Runs up to which their names are part of the plan.
NAMED_RUNS = 1000


def each_run(gold: DataFrame, runs: DataFrame) -> DataFrame:
    """Every gold row once for every run: by name if runs are few, else by a product that sends neither side to all executors."""
    names = [r["run"] for r in runs.select("run").limit(NAMED_RUNS + 1).collect()]
    if len(names) > NAMED_RUNS:
        return gold.hint("shuffle_replicate_nl").crossJoin(runs.select("run"))
    return gold.withColumn("run", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))


def align(gold: DataFrame, preds: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run, field, ad_id, gold, pred): each gold item once for each run; a missing or failed prediction is the error label.

    gold has ad_id, goal, issue; preds has run and the prediction columns, one row for each run and ad_id. ``runs`` (run) lists
    the runs to score, those of preds if not given.
    """
    runs = preds.select("run").distinct() if runs is None else runs
    left = each_run(gold.select("ad_id", F.col("goal").alias("g_goal"), F.col("issue").alias("g_issue")), runs)
    joined = left.join(preds.select("run", "ad_id", "goal", "issue", F.col("error").isNull().alias("ok")), ["run", "ad_id"], "left")
    label = {f: F.when(F.col("ok"), F.col(f)).otherwise(ERROR_LABEL) for f in FIELDS}
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"g_{f}").alias("gold"), label[f].alias("pred")) for f in FIELDS))
    return joined.select("run", "ad_id", F.explode(pairs).alias("x")).select("run", "x.field", "ad_id", "x.gold", "x.pred")


def cells(aligned: DataFrame, *keys: str) -> DataFrame:
    """(keys, gold, pred, n): nonzero confusion cells."""
    return aligned.groupBy(*(keys or KEYS), "gold", "pred").agg(F.count("*").alias("n"))


def accuracy(counted: DataFrame, *keys: str) -> DataFrame:
    return counted.groupBy(*(keys or KEYS)).agg(F.sum("n").alias("n_gold"), (F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def confusion(counted: DataFrame, *keys: str) -> DataFrame:
    """Every cell of the grid of a field's labels and the error label, zeros included; labels off the taxonomy are errors of ``off_taxonomy``."""
    keys = keys or KEYS
    spark = counted.sparkSession
    dims = taxonomy(spark, with_error=True)
    groups = counted.select(*keys).distinct()
    grid = groups.join(F.broadcast(dims.select("field", F.col("label").alias("gold"), F.col("ord").alias("g_ord"))), "field").join(F.broadcast(dims.select("field", F.col("label").alias("pred"), F.col("ord").alias("p_ord"))), "field")
    return grid.join(counted, [*keys, "gold", "pred"], "left").select(*keys, "g_ord", "p_ord", "gold", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def off_taxonomy(aligned: DataFrame) -> DataFrame:
    """Rows whose gold or predicted label is in no taxonomy; callers reject runs that have any."""
    dims = F.broadcast(taxonomy(aligned.sparkSession, with_error=True))
    known = aligned.join(dims.select("field", F.col("label").alias("gold")).withColumn("kg", F.lit(1)), ["field", "gold"], "left").join(dims.select("field", F.col("label").alias("pred")).withColumn("kp", F.lit(1)), ["field", "pred"], "left")
    return known.where("kg is null or kp is null").select("run", "field", "ad_id", "gold", "pred")


def per_label(counted: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall, F1 and support of every label of the taxonomy; 0/0 is 0."""
    keys = keys or KEYS
    sides = F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)
    sums = counted.withColumn("hit", hit).select(*keys, "hit", F.explode(sides).alias("s")).groupBy(*keys, F.col("s.label").alias("label")).agg(F.sum(F.when(F.col("s.g") > 0, F.col("hit")).otherwise(0)).alias("tp"), F.sum("s.g").alias("g"), F.sum("s.p").alias("p"))
    groups = counted.select(*keys).distinct().join(F.broadcast(taxonomy(counted.sparkSession)), "field")
    joined = groups.join(sums, [*keys, "label"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tp", "g", "p")})
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = joined.withColumns({"precision": ratio(F.col("tp"), F.col("p")), "recall": ratio(F.col("tp"), F.col("g"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select(*keys, "ord", "label", "precision", "recall", f1.alias("f1"), F.col("g").cast("long").alias("support"))


def macro_f1(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean F1 of the labels that occur in gold; 0 if none does."""
    return scores.groupBy(*(keys or KEYS)).agg(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("macro_f1"))


def kappa(counted: DataFrame, *keys: str) -> DataFrame:
    """Agreement beyond chance over all labels that occur, the error label included."""
    keys = list(keys or KEYS)
    sides = F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))
    margins = counted.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, "s.label").agg(F.sum("s.g").alias("g"), F.sum("s.p").alias("p"))
    chance = margins.groupBy(*keys).agg(F.sum(F.col("g").cast("double") * F.col("p")).alias("gp"), F.sum("g").alias("n"))
    both = chance.join(accuracy(counted, *keys).select(*keys, F.col("accuracy").alias("po")), keys)
    pe = F.col("gp") / (F.col("n").cast("double") * F.col("n"))
    return both.select(*keys, F.when(pe == 1, F.when(F.col("po") == 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def mcnemar(aligned: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """(field, accuracy_a, accuracy_b, a_only, b_only, p_value): exact two-sided test on the items that one run alone gets right."""
    ok = F.col("gold") == F.col("pred")
    side = aligned.where(F.col("run").isin(run_a, run_b)).groupBy("field", "ad_id").agg(F.bool_or(ok & (F.col("run") == run_a)).alias("a"), F.bool_or(ok & (F.col("run") == run_b)).alias("b"))
    sums = side.groupBy("field").agg(F.avg(F.col("a").cast("int")).alias("accuracy_a"), F.avg(F.col("b").cast("int")).alias("accuracy_b"), F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(~F.col("a") & F.col("b")).alias("b_only"))
    return sums.withColumn("p_value", binomial_p(F.col("a_only"), F.col("b_only")))


def binomial_p(b: Column, c: Column) -> Column:
    """min(1, 2 * P(X <= min(b, c))) for X of b + c fair coins; each term is the last times (n - i) / (i + 1), in logs."""
    n = b + c
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(b, c)), start, lambda a, i: F.struct((a["t"] + F.when(i < n, F.log((n - i) / (i + 1.0))).otherwise(0.0)).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")))["s"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def counts(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """(run, n_gold, n_scored_ok, n_errors, tokens_in, tokens_out); tokens of failed predictions of gold items count."""
    joined = each_run(gold.select("ad_id"), preds.select("run").distinct()).join(preds.select("run", "ad_id", F.col("error").isNull().alias("ok"), "usage"), ["run", "ad_id"], "left")
    token = lambda k: F.sum(F.coalesce(F.col("usage")[k], F.lit(0))).cast("long")
    return joined.groupBy("run").agg(F.count("*").alias("n_gold"), F.count_if("ok").alias("n_scored_ok"), (F.count("*") - F.count_if("ok")).alias("n_errors"), token("input_tokens").alias("tokens_in"), token("output_tokens").alias("tokens_out"))


def disagreements(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """Gold items whose prediction is missing, failed or differs in a field, for one run."""
    g = gold.select("ad_id", F.col("goal").alias("g"), F.col("issue").alias("i"))
    joined = g.join(preds.select("ad_id", "goal", "issue", "confidence", "rationale", "error", F.lit(True).alias("there")), "ad_id", "left")
    ok = F.col("there").isNotNull() & F.col("error").isNull()
    slash = F.lit(" / ")
    why = F.when(ok, F.col("rationale")).when(F.col("there").isNull(), "no prediction").otherwise(F.col("error"))
    return joined.where(~ok | (F.col("goal") != F.col("g")) | (F.col("issue") != F.col("i"))).select("ad_id", F.concat("g", slash, "i").alias("gold"), F.when(ok, F.concat("goal", slash, "issue")).otherwise(ERROR_LABEL).alias("model"), F.when(ok, F.col("confidence")).otherwise("").alias("confidence"), why.alias("rationale"))


#: Items of a group that the exact bootstrap, one sequence of draws, takes: a byte for each of eight groups at most.
MOST_EXACT = 1 << 30
#: Draws that are made at once, and resamples of one unit of work.
DRAWS, UNIT = 1 << 13, 8


def bootstrap_exact(correct: list[bool], n_resamples: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """Percentile interval with Python's generator over correctness in order of ad_id; for the small tables of a report."""
    n = len(correct)
    if not n:
        return 0.0, 0.0
    rng = random.Random(seed)
    flags = [int(c) for c in correct]
    means = sorted(sum(rng.choices(flags, k=n)) / n for _ in range(n_resamples))
    return means[int(alpha / 2 * n_resamples)], means[min(n_resamples - 1, int((1 - alpha / 2) * n_resamples))]


def planes_of(aligned: DataFrame) -> dict[int, list[tuple[list[tuple[str, str, bool]], np.ndarray]]]:
    """By number of items, the groups (run, field, right or known) of that size by eights, and a byte for each item in order of ad_id, a bit for each group.

    Items are sorted where they are; a bit of each comes to the driver. Items without a label or a prediction are in neither sum.
    """
    ok = F.col("gold") == F.col("pred")
    ordered = aligned.select("run", "field", "ad_id", F.coalesce(ok.cast("int"), F.lit(2)).alias("ok")).orderBy("run", "field", "ad_id").select("run", "field", "ok")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            found = []
            for (run, field), own in batch.to_pandas().groupby(["run", "field"], sort=False, dropna=False)["ok"]:
                flags = own.to_numpy()
                found.append({"run": run, "field": field, "part": part, "k": k, "n": len(flags), "right": np.packbits(flags == 1).tobytes(), "known": np.packbits(flags != 2).tobytes()})
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("run", pa.string()), ("field", pa.string()), ("part", pa.int32()), ("k", pa.int32()), ("n", pa.int32()), ("right", pa.binary()), ("known", pa.binary())]))

    pieces: dict[tuple[str, str], list] = {}
    for r in sorted(ordered.mapInArrow(pack, "run string, field string, part int, k int, n int, right binary, known binary").collect(), key=lambda r: (r["part"], r["k"])):
        pieces.setdefault((r["run"], r["field"]), []).append(r)
    bits = lambda rows, c: np.concatenate([np.unpackbits(np.frombuffer(r[c], np.uint8), count=r["n"]) for r in rows])
    by_size: dict[int, list[tuple[list[tuple[str, str, bool]], np.ndarray]]] = {}
    for (run, field), rows in sorted(pieces.items(), key=lambda x: str(x[0])):
        planes = by_size.setdefault(sum(r["n"] for r in rows), [])
        for what in ("right", "known"):
            flags = bits(rows, what)
            if what == "known" and flags.all():
                continue
            if not planes or len(planes[-1][0]) == 8:
                planes.append(([], np.zeros(len(flags), np.uint8)))
            planes[-1][1][:] |= flags << len(planes[-1][0])
            planes[-1][0].append((run, field, what == "right"))
    return by_size


#: By bit, which bytes have it.
BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def drawn(planes: list[tuple[list[tuple[str, str, bool]], np.ndarray]], places: np.ndarray) -> np.ndarray:
    """For each plane and bit, how many of the drawn places have it."""
    return np.stack([np.bincount(own[places], minlength=256) @ BITS for _, own in planes])


def means_of(planes: list[tuple[list[tuple[str, str, bool]], np.ndarray]], sums: np.ndarray, n: int) -> list[tuple[str, str, float]]:
    right, known = {}, {}
    for (groups, _), own in zip(planes, sums, strict=True):
        for k, (run, field, is_right) in enumerate(groups):
            (right if is_right else known)[run, field] = int(own[k])
    return [(*g, x / known.get(g, n)) for g, x in right.items() if known.get(g, n)]


def as_means(found: list[tuple[str, str, float]]) -> pa.RecordBatch:
    run, field, mean = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(run, pa.string()), pa.array(field, pa.string()), pa.array(mean, pa.float64())], ["run", "field", "mean"])


def percentiles(means: DataFrame, n_resamples: int, alpha: float) -> DataFrame:
    ordered = means.groupBy("run", "field").agg(F.sort_array(F.collect_list("mean")).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k + 1))
    return ordered.select("run", "field", at(int(alpha / 2 * n_resamples)).alias("ci_lo"), at(min(n_resamples - 1, int((1 - alpha / 2) * n_resamples))).alias("ci_hi"))


def bootstrap(aligned: DataFrame, n_resamples: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(run, field, ci_lo, ci_hi) with the exact generator. Its draws are one sequence, made in one task for all groups of one size; ``bootstrap_hashed`` is the distributed form."""
    by_size = planes_of(aligned)
    if (most := max(by_size, default=0)) > MOST_EXACT:
        raise TableError(f"{most} items are too many for the exact generator; use bootstrap_hashed")
    spark = aligned.sparkSession
    held = spark.sparkContext.broadcast(by_size)

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column("n").to_pylist():
                planes = held.value[n]
                # Python's generator, whose numbers NumPy makes in bulk; choices() takes the item at floor(random() * n)
                state = random.Random(seed).getstate()[1]
                rng = np.random.RandomState()
                rng.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
                for _ in range(n_resamples):
                    sums = 0
                    for start in range(0, n, 1 << 16):
                        sums = sums + drawn(planes, (rng.random_sample(min(1 << 16, n - start)) * float(n)).astype(np.int64))
                    yield as_means(means_of(planes, sums, n))

    sizes = spark.createDataFrame([(n,) for n in by_size], "n long").repartition(max(1, len(by_size)))
    return percentiles(sizes.mapInArrow(resample, "run string, field string, mean double"), n_resamples, alpha)


#: MD5's rotations, constants and order of words by step.
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [[i, 5 * i + 1, 3 * i + 5, 7 * i][i // 16] % 16 for i in range(64)]


def md5_starts(prefix: bytes, digits: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of ``prefix`` and each row of ``digits``, 55 bytes at most in all."""
    count, size = len(digits), len(prefix) + digits.shape[1]
    text = np.zeros((count, size // 4 * 4 + 4), np.uint8)
    text[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
    text[:, len(prefix) : size] = digits
    text[:, size] = 0x80
    words: list = list(np.ascontiguousarray(text.view("<u4").T))
    words += [0] * (16 - len(words))
    words[14] = size * 8
    a, b, c, d = (np.full(count, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(count, np.uint32), np.empty(count, np.uint32)
    for i in range(61):  # the last three steps do not change a
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = words[_WORDS[i]]
        a += f
        if isinstance(word, int):
            a += np.uint32((word + _SINES[i]) & 0xFFFFFFFF)
        else:
            a += word
            a += np.uint32(_SINES[i])
        np.left_shift(a, np.uint32(_TURNS[i]), out=t)
        np.right_shift(a, np.uint32(32 - _TURNS[i]), out=a)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    # after step 60 its result stands in b
    return (b + np.uint32(0x67452301)).byteswap()


def decimals(start: int, end: int) -> np.ndarray:
    """The digits of numbers of one length, a row for each."""
    numbers, size = np.arange(start, end), len(str(end - 1))
    return np.stack([numbers // 10 ** (size - 1 - k) % 10 + 48 for k in range(size)], axis=1).astype(np.uint8)


def bootstrap_hashed(aligned: DataFrame, n_resamples: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """The interval with draws by hash, a different estimator: draw i of resample b takes the item at rank md5(seed:b:i) mod n.

    A resample's mean depends only on how many of its draws fall on right items, so every task has a bit for each item of each
    group and makes the draws of some resamples. Groups of one size have the same draws, which are hashed once for all of them.
    """
    by_size = planes_of(aligned)
    spark = aligned.sparkSession
    held = spark.sparkContext.broadcast(by_size)

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, first in zip(batch.column("n").to_pylist(), batch.column("first").to_pylist(), strict=True):
                planes = held.value[n]
                own = range(first, min(first + UNIT, n_resamples))
                sums = [0] * len(own)
                start = 0
                while start < n:
                    end = min(n, start + DRAWS, 10 ** len(str(start)))
                    digits = decimals(start, end)
                    for k, b in enumerate(own):
                        sums[k] = sums[k] + drawn(planes, md5_starts(f"{seed}:{b}:".encode(), digits) % np.uint32(n))
                    start = end
                yield as_means([x for s in sums for x in means_of(planes, s, n)])

    units = [(n, first) for n in by_size for first in range(0, n_resamples, UNIT)]
    parts = max(1, min(len(units), 4 * spark.sparkContext.defaultParallelism))
    work = spark.sparkContext.parallelize(units, parts).toDF("n long, first long")
    return percentiles(work.mapInArrow(resample, "run string, field string, mean double"), n_resamples, alpha)
