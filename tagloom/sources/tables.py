"""Readers and writers of the item table, prediction log, drop log, pastes and label sheets.

A reader returns strings as they are in the file ("" for missing), with ``seq`` = record ordinal from 0, which carries the
file's order. CSV files with quoted line breaks are one task each by nature; tables at scale are Parquet, read by
``read_table``, and every operator takes DataFrames of either origin.
"""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import OTHER_BREAKS, strip
from ..schema import ALL_COLUMNS, DROPPED_COLUMNS, GOLD_COLUMNS, PREDICTION, SHEET_COLUMNS, strings


#: Fixed value: how the note of a blind item that is looked at again begins.
RECHECK_NOTE = "BLIND. RECHECK: codebook updated ("


class TableError(ValueError):
    """A table that breaks its contract."""


#: Rows up to which the writers of hand-made files take a table. Tasks write them, but a CSV file is read by one task.
MOST_FILE_ROWS = 1 << 31


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A Parquet table. One of fewer splits than cores is dealt out first: it is small, and texts are costly to work on."""
    rows = spark.read.parquet(f"{path}/{name}.parquet" if name else path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def header_of(path: str, encoding: str = "utf-8") -> list[str]:
    with open(path, newline="", encoding=encoding) as f:
        return next(csv.reader(f), [])


def _records(spark: SparkSession, path: str, columns: list[str], encoding: str) -> DataFrame:
    raw = spark.read.csv(path, schema=strings(*columns), header=True, multiLine=True, escape='"', enforceSchema=True, encoding="UTF-8", mode="PERMISSIVE")
    # one file is one partition, so the running id is the record's ordinal
    return raw.na.fill("").withColumn("seq", F.monotonically_increasing_id())


def read_rows(spark: SparkSession, path: str, columns: tuple[str, ...] = ALL_COLUMNS, encoding: str = "utf-8") -> DataFrame:
    """CSV records without validation; a missing or empty file has no rows. Columns the file lacks are ""; extra ones stay."""
    if not os.path.exists(path) or not os.path.getsize(path):
        return spark.createDataFrame([], strings(*columns)).withColumn("seq", F.lit(0).cast("long"))
    header = header_of(path, encoding)
    rows = _records(spark, path, header, encoding)
    return rows.withColumns({c: F.lit("") for c in columns if c not in header})


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Validated items: raises with the first violation in file order; unlabelled rows stay."""
    from ..operators.validate import raise_first, violations

    missing = set(GOLD_COLUMNS) - set(header_of(path))
    if missing:
        raise TableError(f"{path}: missing columns {sorted(missing)}")
    rows = read_rows(spark, path)
    raise_first(violations(rows), path)
    return rows.withColumns({c: strip(F.col(c)) for c in ("ad_id", "ad_text", "page_name", "source_url", "gold_goal", "gold_issue")})


def labels_of(items: DataFrame) -> DataFrame:
    """(ad_id, goal, issue) of the labelled rows."""
    return items.where("gold_goal <> '' and gold_issue <> ''").select("ad_id", F.col("gold_goal").alias("goal"), F.col("gold_issue").alias("issue"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The newest record of each ad_id; a missing file has none.

    A line that is no JSON object, lacks a field other than error and usage, or has an unknown one is an error.
    """
    from ..operators.evaluate import last_write_wins

    if not os.path.exists(path):
        return spark.createDataFrame([], PREDICTION)
    plain = T.StructType([*PREDICTION, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.length(strip(F.col("value"))) > 0).withColumn("line", F.monotonically_increasing_id())
    parsed = lines.select("line", F.json_object_keys("value").alias("keys"), F.from_json("value", plain, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("p"))
    known = F.array(*(F.lit(f.name) for f in PREDICTION))
    needed = F.array(*(F.lit(f.name) for f in PREDICTION if f.name not in ("error", "usage", "seq")))
    whole = (F.size(F.array_except(needed, "keys")) == 0) & (F.size(F.array_except("keys", known)) == 0)
    bad = parsed.where(F.col("keys").isNull() | ~whole | F.expr("p is null or p._corrupt is not null or p.ad_id is null")).orderBy("line").limit(1).collect()
    if bad:
        raise TableError(f"{path}: record {bad[0]['line'] + 1} is no prediction record")
    # a log written by several tasks carries its own seq; a plain log's order is its lines'
    seq = F.coalesce("p.seq", "line")
    return last_write_wins(parsed.select(*(F.col(f"p.{f.name}") for f in PREDICTION if f.name != "seq"), seq.alias("seq")))


def read_pastes(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, line, begun) of pasted texts; any line break ends a line.

    Files are read in blocks; a line's place is that of its block in the file, and its own in the block, and ``begun`` is how many
    records have begun in the block. A task reads a block from its beginning, so it can count them as it reads. A break other than a
    line feed at the very end of a file is followed by an empty line.
    """
    from ..operators.paste import ID_LINE

    rows = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), F.col("value"))
    parts = F.split(F.regexp_replace("value", r"\r\z", ""), OTHER_BREAKS)
    each = rows.select("file", "block", "at", F.posexplode(parts).alias("k", "line"))
    placed = each.select("file", "block", F.struct("block", (F.shiftleft("at", 30) + F.col("k")).alias("at")).alias("line_no"), "line", strip(F.col("line")).rlike(ID_LINE).alias("begins"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True))
            begun = []
            for key, begins in zip(keys, batch.column("begins").to_pylist(), strict=True):
                if key != last:
                    last, total = key, 0
                total += begins
                begun.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(begun, pa.int64())], schema=pa.schema([*list(batch.schema)[:4], pa.field("begun", pa.int64())]))

    return placed.mapInArrow(count, "file string, block long, line_no struct<block: long, at: long>, line string, begun long")


def read_dropped(spark: SparkSession, gold_path: str) -> DataFrame:
    return read_rows(spark, dropped_path(gold_path), DROPPED_COLUMNS)


def dropped_path(gold_path: str) -> str:
    return str(Path(gold_path).with_name("dropped.csv"))


def read_recheck(spark: SparkSession, path: str) -> DataFrame:
    """(ad_id, note) from a file (ad_id, reason) of blind items whose labels are looked at again; a missing file has none."""
    rows = read_rows(spark, path, ("ad_id", "reason"))
    newest = rows.groupBy("ad_id").agg(F.max_by("reason", "seq").alias("reason"))
    return newest.select("ad_id", F.concat(F.lit(RECHECK_NOTE), "reason", F.lit(")")).alias("note"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A label sheet's rows: a CSV export, or a workbook's "Label" sheet where the workbook library is installed."""
    need = {"ad_id", "gold_goal", "gold_issue", "notes"}
    if path.lower().endswith(".csv"):
        header = header_of(path, "utf-8-sig")
        rows = _records(spark, path, header, "utf-8-sig")
    else:
        from openpyxl import load_workbook

        cells = load_workbook(path, read_only=True, data_only=True)["Label"].iter_rows(values_only=True)
        header = ["" if h is None else str(h) for h in next(cells)]
        data = [(*("" if v is None else str(v) for v in r), i) for i, r in enumerate(cells)]
        rows = spark.createDataFrame(data, strings(*header).add("seq", "long"))
    if missing := need - set(header):
        raise TableError(f"{path}: Label sheet is missing columns {sorted(missing)}")
    if "checked" not in header:
        rows = rows.withColumn("checked", F.lit(""))
    keep = [c for c in ("ad_id", "gold_goal", "gold_issue", "notes", "checked")]
    return rows.select(*(strip(F.col(c)).alias(c) for c in keep), "seq").where("ad_id <> ''")


def _by_hand(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` if they are few enough for a file that people edit."""
    if (n := rows.count()) > MOST_FILE_ROWS:
        raise TableError(f"{path}: {n} rows are too many for a file that is read by one task; write Parquet instead")
    return rows


def put(rows: DataFrame, encode: Callable[[pa.RecordBatch], Iterator[tuple[str, str, int]]], targets: dict[str, str]) -> int:
    """Append the rows' text, in the order of the rows, to files that the driver and all executors see; nothing goes through the driver.

    ``encode`` gives (name, text, number) for a batch, ``targets`` the path of each name. Tasks write parts, whose sizes tell
    where each belongs in its file, and then copy them there. The sum of the numbers is returned.
    """
    targets = {k: os.path.abspath(v) for k, v in targets.items()}
    spark = rows.sparkSession
    folder = Path(next(iter(targets.values()))).parent / f".parts-{uuid.uuid4().hex}"
    folder.mkdir()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, numbers, files = task.partitionId(), {}, {}
        own = lambda name: f"{folder}/{name}-{part}-{task.taskAttemptId()}"
        try:
            for batch in batches:
                for name, text, number in encode(batch):
                    if name not in files:
                        files[name] = open(own(name), "wb")
                    files[name].write(text.encode("utf-8"))
                    numbers[name] = numbers.get(name, 0) + number
        finally:
            for f in files.values():
                f.close()
        for name in files:
            yield pa.RecordBatch.from_pylist([{"name": name, "part": part, "file": own(name), "size": os.path.getsize(own(name)), "number": numbers[name]}])

    def copy(moves: Iterator[tuple[str, str, int]]) -> None:
        for source, target, at in moves:
            with open(source, "rb") as src, open(target, "r+b") as dst:
                dst.seek(at)
                shutil.copyfileobj(src, dst, 1 << 20)

    try:
        parts = rows.mapInArrow(write, "name string, part long, file string, size long, number long").collect()
        ends = {}
        moves = []
        for r in sorted(parts, key=lambda r: (r["name"], r["part"])):
            target = targets[r["name"]]
            if target not in ends:
                Path(target).touch()
                ends[target] = os.path.getsize(target)
            moves.append((r["file"], target, ends[target]))
            ends[target] += r["size"]
        if moves:
            spark.sparkContext.parallelize(moves, len(moves)).foreachPartition(copy)
        return sum(r["number"] for r in parts)
    finally:
        shutil.rmtree(folder)


def _csv(columns: tuple[str, ...]) -> Callable[[pa.RecordBatch], Iterator[tuple[str, str, int]]]:
    def encode(batch: pa.RecordBatch) -> Iterator[tuple[str, str, int]]:
        text = io.StringIO()
        csv.writer(text).writerows(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        yield "rows", text.getvalue(), 0

    return encode


def _json(batch: pa.RecordBatch) -> Iterator[tuple[str, str, int]]:
    names = ("ad_id", "goal", "issue", "confidence", "rationale", "prompt_version", "model", "error", "usage")
    lines, failures = [], 0
    for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
        r = dict(zip(names, values, strict=True))
        failures += r["error"] is not None
        lines.append(json.dumps(r | {"usage": None if r["usage"] is None else dict(r["usage"])}) + "\n")
    yield "rows", "".join(lines), failures


def _head(path: str, columns: tuple[str, ...], encoding: str = "utf-8") -> None:
    with open(path, "w", newline="", encoding=encoding) as f:
        csv.writer(f).writerow(columns)


def write_gold(items: DataFrame, path: str) -> None:
    """Rewrite the item file in order of seq, staged beside the target and renamed over it. Callers validate first."""
    items = _by_hand(items, path)
    rows = items.select("seq", *(F.coalesce(c, F.lit("")).alias(c) if c in items.columns else F.lit("").alias(c) for c in ALL_COLUMNS)).orderBy("seq")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    stage = f"{path}.tmp"
    _head(stage, ALL_COLUMNS)
    put(rows, _csv(ALL_COLUMNS), {"rows": stage})
    os.replace(stage, path)


def append_dropped(entries: DataFrame, gold_path: str) -> None:
    log = dropped_path(gold_path)
    entries = _by_hand(entries, log).select(*DROPPED_COLUMNS)
    if not os.path.exists(log):
        _head(log, DROPPED_COLUMNS)
    put(entries, _csv(DROPPED_COLUMNS), {"rows": log})


def append_predictions(preds: DataFrame, path: str, overwrite: bool = False) -> int:
    """Append records as JSON lines, ASCII only; returns the number of failed ones."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    preds = _by_hand(preds, path)
    with open(path, "w" if overwrite else "a", encoding="utf-8"):
        pass
    # many records can have one seq
    return put(preds.orderBy("seq", "ad_id"), _json, {"rows": path})


def append_prediction_log(preds: DataFrame, path: str, overwrite: bool = False) -> None:
    """The scalable log: a folder of JSON files, a part for each task, ordered by the seq they carry."""
    preds.write.mode("overwrite" if overwrite else "append").json(path)


def write_sheet(rows: DataFrame, path: str) -> None:
    """A label sheet as CSV, which spreadsheet programs open (with a byte order mark)."""
    rows = _by_hand(rows, path)
    _head(path, SHEET_COLUMNS, "utf-8-sig")
    put(rows.orderBy("#"), _csv(SHEET_COLUMNS), {"rows": path})


def write_pastes(files: DataFrame, folder: str, names: dict[int, str]) -> None:
    """Append pasted texts (n, seq, raw), each with a line break, in order of seq to the file in ``folder`` that ``names`` has for n."""

    def encode(batch: pa.RecordBatch) -> Iterator[tuple[str, str, int]]:
        for n, raw in zip(batch.column("n").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            yield str(n), raw + "\n", 0

    put(files.orderBy("n", "seq"), encode, {str(n): os.path.join(folder, name) for n, name in names.items()})
