"""Labelling workflow: blind draw, suggestions, label sheets and their return."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import strip
from ..lineage import settle
from ..schema import ASSISTED, BLIND, FIELDS
from ..sources.tables import TableError

BLIND_NOTE = "BLIND: label from scratch"


def draw_exact(items: DataFrame, n: int, seed: int) -> DataFrame:
    """Python's seeded sample of the sorted ids.

    The sample takes ids by their ranks, which depend only on how many there are; so the driver draws ``n`` ranks, and ids are
    sorted and counted where they are.
    """
    spark = items.sparkSession
    ordered = settle(items.select("ad_id").orderBy("ad_id")).select("ad_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    total, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    if n > total:
        raise TableError(f"n_blind={n} exceeds the {total} items")
    ranks = spark.createDataFrame([(r,) for r in random.Random(seed).sample(range(total), n)], "rank long")
    ranked = ordered.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part").withColumn("rank", F.col("start") + F.col("place"))
    return ranked.join(F.broadcast(ranks), "rank").select("ad_id")


def draw_hashed(items: DataFrame, n: int, seed: int) -> DataFrame:
    """The n ids with the least md5(seed:id), a draw that needs no driver; a different sample than the exact one."""
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.col("ad_id")))
    return items.select("ad_id").orderBy(rank, "ad_id").limit(n)


def assign(items: DataFrame, n_blind: int = 40, seed: int = 2026, exact: bool = True) -> DataFrame:
    """Give each item a mode, and assisted ones a suggestion.

    Items with a mode keep everything. If any has one, the blind set is fixed and new items become assisted.
    """
    mode = F.coalesce(F.col("label_mode"), F.lit(""))
    new = mode == ""
    if not items.where(~new).isEmpty():
        drawn = None
    elif exact:
        drawn = draw_exact(items, n_blind, seed)
    else:
        drawn = draw_hashed(items, n_blind, seed)
    rest = [c for c in items.columns if c not in ("label_mode", "suggested_goal", "suggested_issue", "suggestion_reason")]
    marked = rules.classify(items.withColumn("_new", new))
    if drawn is not None:
        marked = marked.join(drawn.distinct().withColumn("_blind", F.lit(True)), "ad_id", "left")
    else:
        marked = marked.withColumn("_blind", F.lit(None).cast("boolean"))
    chosen = F.when(F.col("_blind"), BLIND).otherwise(ASSISTED)
    keep = lambda c, v: F.when(F.col("_new"), F.when(F.col("_blind"), "").otherwise(F.col(v))).otherwise(F.col(c)).alias(c)
    return marked.select(*rest, F.when(F.col("_new"), chosen).otherwise(F.col("label_mode")).alias("label_mode"), keep("suggested_goal", "goal"), keep("suggested_issue", "issue"), keep("suggestion_reason", "reason"))


def mode_counts(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("ads"), F.count_if(F.col("label_mode") == BLIND).alias("blind"), F.count_if(F.col("label_mode") == ASSISTED).alias("assisted"))


def subset(gold: DataFrame, items: DataFrame, mode: str) -> DataFrame:
    """Gold rows of the items with a mode; "all" is everything, a mode without items is an error."""
    if mode == "all":
        return gold
    keep = items.where(F.col("label_mode") == mode).select("ad_id")
    if keep.isEmpty():
        raise TableError(f"no items with label_mode={mode!r}; assign modes first")
    return gold.join(keep, "ad_id", "left_semi")


def sheet(items: DataFrame, recheck: DataFrame | None = None) -> DataFrame:
    """Rows of a label sheet. Gold labels come first, then suggestions of assisted items; blind ones show neither suggestion nor reason.

    ``recheck`` (ad_id, note) gives the note of blind items that are looked at again. Items without a mode are an error.
    """
    if not items.where(F.coalesce("label_mode", F.lit("")) == "").isEmpty():
        raise TableError("some items have no label_mode; assign modes first")
    rows = items if recheck is None else items.join(recheck.select("ad_id", F.col("note").alias("_note")), "ad_id", "left")
    if recheck is None:
        rows = rows.withColumn("_note", F.lit(None).cast("string"))
    blind = F.col("label_mode") == BLIND
    filled = {f: F.coalesce(F.nullif(F.col(f"gold_{f}"), F.lit("")), F.when(blind, "").otherwise(F.col(f"suggested_{f}"))) for f in FIELDS}
    why = F.when(blind, F.coalesce("_note", F.lit(BLIND_NOTE))).otherwise(F.col("suggestion_reason"))
    return rows.select((F.col("seq") + 1).alias("#"), "ad_id", "ad_text", filled["goal"].alias("gold_goal"), filled["issue"].alias("gold_issue"), F.when(blind, BLIND).otherwise("").alias("checked"), "notes", why.alias("why_suggested"), "page_name", "source_url", "search_term", "paid_for", "started_running")


def newest_sheet_rows(rows: DataFrame) -> DataFrame:
    """One row for each id, the last in the sheet."""
    newest = rows.groupBy("ad_id").agg(F.max_by(F.struct("gold_goal", "gold_issue", "notes", "checked"), "seq").alias("r"))
    return newest.select("ad_id", *(F.col(f"r.{c}").alias(c) for c in ("gold_goal", "gold_issue", "notes", "checked")))


def returned(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Items with labels and notes from the sheet, and marks of what was done; text and suggestions stay the items' own.

    Labels of an assisted row count only if it is checked. Both sides must hold the same ids (``same_ids``).
    """
    new = newest_sheet_rows(rows).select("ad_id", *(F.col(c).alias(f"_{c}") for c in ("gold_goal", "gold_issue", "notes", "checked")))
    joined = items.join(new, "ad_id")
    assisted = F.col("label_mode") == ASSISTED
    yes = F.lower(strip(F.coalesce("_checked", F.lit("")))) == "yes"
    blank = assisted & ~yes
    rest = [c for c in items.columns if c not in ("gold_goal", "gold_issue", "notes")]
    label = lambda c: F.when(blank, "").otherwise(F.col(f"_{c}")).alias(c)
    differs = lambda f: (assisted & yes & (F.col(f"_gold_{f}") != F.coalesce(f"suggested_{f}", F.lit("")))).alias(f"{f}_override")
    return joined.select(*rest, label("gold_goal"), label("gold_issue"), F.col("_notes").alias("notes"), (blank & ((F.col("_gold_goal") != "") | (F.col("_gold_issue") != ""))).alias("unchecked"), (assisted & yes).alias("checked"), differs("goal"), differs("issue"))


def same_ids(items: DataFrame, rows: DataFrame) -> None:
    from .validate import id_difference

    diff = id_difference(rows, items).first()
    if diff["only_left"] or diff["only_right"]:
        raise TableError(f"sheet and items cover different ids; only in sheet: {diff['only_left']}, only in items: {diff['only_right']}")


def return_stats(done: DataFrame) -> DataFrame:
    labelled = (F.col("gold_goal") != "") & (F.col("gold_issue") != "")
    count = lambda c, name: F.count_if(c).alias(name)
    return done.agg(F.count("*").alias("ads"), count(labelled, "labeled"), count(labelled & (F.col("label_mode") == BLIND), "blind_labeled"), count(F.col("unchecked"), "unchecked_assisted"), count(F.col("goal_override"), "goal_overrides"), count(F.col("issue_override"), "issue_overrides"), count(F.col("checked"), "checked_assisted"))


def override_rates(done: DataFrame) -> DataFrame:
    stats = return_stats(done)
    return stats.select("checked_assisted", *(F.coalesce(F.try_divide(f"{f}_overrides", "checked_assisted"), F.lit(0.0)).alias(f"{f}_rate") for f in FIELDS))


def progress(rows: DataFrame) -> DataFrame:
    """Of a sheet: assisted rows checked, blind rows with both labels, and rows that remain."""
    yes = F.lower("checked") == "yes"
    blind = (F.col("checked") == BLIND) & (F.col("gold_goal") != "") & (F.col("gold_issue") != "")
    return rows.agg(F.count_if(yes).alias("checked"), F.count_if(blind).alias("blind_done"), (F.count("*") - F.count_if(yes) - F.count_if(blind)).alias("remaining"))


def final_counts(rows: DataFrame) -> DataFrame:
    """(field, ord, label, n) over rows that are checked or blind; labels without rows count 0."""
    from ..schema import taxonomy

    final = rows.where(F.lower("checked").isin("yes", BLIND)).select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"gold_{f}").alias("label")) for f in FIELDS))).alias("x")).groupBy("x.field", "x.label").agg(F.count("*").alias("n"))
    return F.broadcast(taxonomy(rows.sparkSession)).join(final, ["field", "label"], "left").select("field", "ord", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def drop(items: DataFrame, ad_id: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(items without the id, drop log entries); a blank reason and an unknown id are errors, in this order."""
    if not reason.strip():
        raise TableError("a reason is required")
    gone = items.where(F.col("ad_id") == ad_id)
    if gone.isEmpty():
        raise TableError(f"ad_id {ad_id!r} is not in the items")
    entry = gone.orderBy("seq").limit(1).select("ad_id", "page_name", F.lit(reason.strip()).alias("reason"), "ad_text")
    return items.where(F.col("ad_id") != ad_id), entry
