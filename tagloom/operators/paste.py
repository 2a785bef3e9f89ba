"""Record parsing from a stream of lines: a record begins at an id line and ends before the next one.

Windows run within a card, and within a file or a block of it; many files and blocks are parsed side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ZERO_WIDTH, lines_of, normalize_text, strip, tidy

# The line forms of a pasted results page.
ID_LINE = r"^Library ID:\s*(\d+)\s*$"
STARTED_LINE = r"^Started running on (.+)$"
SPONSOR_LINE = r"^Sponsored\s*•\s*Paid for by\s+(.+)$"
TIMER_LINE = r"^\d{1,2}:\d{2}\s*/\s*\d{1,2}:\d{2}$"
DOMAIN_LINE = r"^[A-Z0-9-]+(\.[A-Z0-9-]+)+$"
DISCLAIMER, NEXT_CARD, IMPRESSIONS = "NOT AFFILIATED WITH META", "Active", "Impressions:"


def is_terminator(line: Column) -> Column:
    return _ends(strip(line))


def _ends(s: Column) -> Column:
    return (s == ZERO_WIDTH) | s.rlike(TIMER_LINE) | s.rlike(DOMAIN_LINE) | (s == DISCLAIMER) | s.startswith(IMPRESSIONS) | (s == NEXT_CARD)


def lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line) from (file, raw)."""
    return files.select("file", F.posexplode(lines_of(F.col("raw"))).alias("line_no", "line"))


def parse(stream: DataFrame, fold: bool = True) -> DataFrame:
    """(file, card_no, library_id, page_name, paid_for, started_running, ad_text) from (file, line_no, line).

    The first sponsor line of a card ends its head: the line before it is the page's name, those after it, up to the first
    terminator, are the body. A stream with blocks (``read_pastes``) is numbered block by block. ``fold`` applies NFKC to bodies; without it the plan has no Python.
    """
    group = lambda p: F.regexp_extract("s", p, 1)
    # what a line is, is found before lines are dealt out
    at = ["file", "block", "begun"] if "begun" in stream.columns else ["file"]
    kinds = stream.select(*at, "line_no", "line", strip(F.col("line")).alias("s"))
    kinds = kinds.select(*at, "line_no", "line", "s", F.col("s").rlike(ID_LINE).alias("is_id"), F.col("s").rlike(SPONSOR_LINE).alias("is_sponsor"), _ends(F.col("s")).alias("stop"))
    if "begun" in at:
        # a row for each block: records that begin in the blocks of the file before it
        sizes = stream.groupBy("file", "block").agg(F.max("begun").alias("n"))
        before = sizes.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_block"))
        marked = kinds.join(F.broadcast(before), ["file", "block"]).withColumn("card_no", F.col("begun") + F.col("before_block")).drop("block", "begun", "before_block")
    else:
        marked = kinds.withColumn("card_no", F.sum(F.col("is_id").cast("int")).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.where("card_no > 0")
    card = Window.partitionBy("file", "card_no")
    order = card.orderBy("line_no")
    marked = marked.withColumns({"id": F.when(F.col("is_id"), group(ID_LINE)), "sponsor": F.min(F.when(F.col("is_sponsor"), F.col("line_no"))).over(card), "before": F.lag("s", 1, "").over(order)})
    marked = marked.withColumn("end", F.min(F.when(F.col("stop") & (F.col("line_no") > F.col("sponsor")), F.col("line_no"))).over(card))
    body = (F.col("line_no") > F.col("sponsor")) & (F.col("end").isNull() | (F.col("line_no") < F.col("end")))
    at_sponsor, started = F.col("line_no") == F.col("sponsor"), F.col("s").rlike(STARTED_LINE)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(body, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    cards = marked.groupBy("file", "card_no").agg(
        F.max("id").alias("library_id"),
        F.coalesce(F.max(F.when(at_sponsor, F.col("before"))), F.lit("")).alias("page_name"),
        F.coalesce(F.max(F.when(at_sponsor, strip(group(SPONSOR_LINE)))), F.lit("")).alias("paid_for"),
        F.coalesce(F.min_by(F.when(started, strip(group(STARTED_LINE))), F.when(started, F.col("line_no"))), F.lit("")).alias("started_running"),
        text.alias("ad_text"),
    )
    return cards.withColumn("ad_text", normalize_text(F.col("ad_text")) if fold else tidy(F.col("ad_text")))


def numbered(cards: DataFrame) -> DataFrame:
    """Adds ``seq``, the place of a card from 0 over all files in order of their names."""
    files = cards.groupBy("file").agg(F.count("*").alias("n"))
    # one row for each file that someone pasted
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("file", F.coalesce(before, F.lit(0)).alias("start"))
    return cards.join(starts, "file").withColumn("seq", F.col("start") + F.col("card_no") - 1).drop("start")
