"""Registered queries of the readers and writers of hand-made files: a table is written, read again and returned.

The files lie in a folder that the driver and all executors see, and go when the rows have been read.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import settle
from ..operators import evaluate as ev
from ..operators import labeling, paste
from ..sources import tables as tb
from . import synthetic as syn
from .synthetic import draw

#: Files over which the pasted pages are dealt.
PASTES = 8


def _folder(spark: SparkSession) -> Path:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and shared.startswith(("file:", "/")):
        path = Path(shared.removeprefix("file://").removeprefix("file:")) / f"files-{uuid.uuid4().hex}"
        path.mkdir(parents=True)
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("hand-made files need a folder that the driver and all executors share")
    return Path(tempfile.mkdtemp(prefix="tagloom-"))


def _through(spark: SparkSession, use: Callable[[Path], DataFrame]) -> DataFrame:
    folder = _folder(spark)
    try:
        return settle(use(folder))
    finally:
        shutil.rmtree(folder)


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = syn.items(spark, d)
    assisted = F.col("label_mode") == "assisted"
    return rows.select("seq", "ad_id", "page_name", "ad_text", "gold_goal", "gold_issue", "label_mode", F.when(assisted, F.col("true_goal")).otherwise("").alias("suggested_goal"), F.when(assisted, F.col("true_issue")).otherwise("").alias("suggested_issue"), F.when(assisted, F.concat(F.lit("why "), "ad_id")).otherwise("").alias("suggestion_reason"), F.concat(F.lit('a "quoted", note '), "ad_id").alias("notes"), *(F.lit("").alias(c) for c in ("source_url", "search_term", "paid_for", "started_running")))


def gold_file(spark, d):
    """The item file: written in order of seq, read with all checks."""

    def use(folder):
        path = str(folder / "gold.csv")
        tb.write_gold(_items(spark, d), path)
        return tb.read_gold(spark, path).select("ad_id", "page_name", "ad_text", "gold_goal", "gold_issue", "notes", "label_mode", "source_url")

    return _through(spark, use)


def gold_file_labels(spark, d):
    """Labelled items of the file."""

    def use(folder):
        path = str(folder / "gold.csv")
        tb.write_gold(_items(spark, d), path)
        return tb.labels_of(tb.read_gold(spark, path))

    return _through(spark, use)


def prediction_file(spark, d):
    """A run's log with failed first tries, appended in two parts; the newest record of each item is read."""

    def use(folder):
        path = str(folder / "run.jsonl")
        log = syn.log(syn.items(spark, d)).where("run = 'a'")
        for t in (0, 1):
            tb.append_predictions(log.where(F.col("seq") == t), path)
        return tb.read_predictions(spark, path).select("ad_id", "goal", "issue", "confidence", "rationale", "prompt_version", "model", "error", F.coalesce(F.col("usage")["input_tokens"], F.lit(0)).alias("tokens_in"))

    return _through(spark, use)


def prediction_file_failures(spark, d):
    """Number of failed records that the writer reports, and of records of the scalable log's newest state."""

    def use(folder):
        log = syn.log(syn.items(spark, d)).where("run = 'b'")
        failed = tb.append_predictions(log, str(folder / "run.jsonl"))
        tb.append_prediction_log(log.drop("run"), str(folder / "log"))
        newest = ev.last_write_wins(spark.read.schema(log.drop("run").schema).json(str(folder / "log")))
        return newest.agg(F.lit(failed).cast("long").alias("failed"), F.count("*").alias("items"), F.count_if(F.col("error").isNull()).alias("good"))

    return _through(spark, use)


def dropped_file(spark, d):
    """The drop log, appended twice."""

    def use(folder):
        gold = str(folder / "gold.csv")
        gone = syn.items(spark, d).where(draw("drop", F.col("ad_id")) % 40 == 0).select("ad_id", "page_name", F.concat(F.lit("off topic, "), "ad_id").alias("reason"), "ad_text")
        for half in (0, 1):
            tb.append_dropped(gone.where(F.col("ad_id").cast("long") % 2 == half), gold)
        return tb.read_dropped(spark, gold).select("ad_id", "page_name", "reason", "ad_text")

    return _through(spark, use)


def _recheck_lines(batch):
    yield "rows", "".join(f'{i},"rule {i}, new"\n' for i in batch.column("ad_id").to_pylist()), 0


def sheet_file(spark, d):
    """A label sheet with notes of items to look at again, written as CSV with a byte order mark and read as a returned sheet."""

    def use(folder):
        recheck, path = str(folder / "recheck.csv"), str(folder / "sheet.csv")
        again = syn.items(spark, d).where(draw("rechk", F.col("ad_id")) % 7 == 0)
        Path(recheck).write_text("ad_id,reason\n", encoding="utf-8")
        tb.put(again.select("ad_id"), _recheck_lines, {"rows": recheck})
        rows = settle(labeling.sheet(_items(spark, d), tb.read_recheck(spark, recheck)))
        tb.write_sheet(rows, path)
        back = tb.read_sheet(spark, path)
        return back.join(rows.select("ad_id", F.col("#").alias("row_no"), "why_suggested"), "ad_id").select("row_no", "ad_id", "gold_goal", "gold_issue", "notes", "checked", "why_suggested")

    return _through(spark, use)


def paste_files(spark, d):
    """Cards of several pasted files, numbered over all of them."""

    def use(folder):
        files = syn.file_text(syn.items(spark, d))
        number = draw("pf", F.col("file")) % PASTES
        tb.write_pastes(files.select(number.alias("n"), F.col("file").cast("long").alias("seq"), "raw"), str(folder), {n: f"paste-{n}.txt" for n in range(PASTES)})
        return paste.numbered(paste.parse(tb.read_pastes(spark, str(folder)))).select("seq", "library_id", "page_name", "paid_for", "started_running", "ad_text")

    return _through(spark, use)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (gold_file, gold_file_labels, prediction_file, prediction_file_failures, dropped_file, sheet_file, paste_files)}
