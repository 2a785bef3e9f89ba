"""Contracts of the item table as DataFrames of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import CONFIDENCE_LEVELS, GOALS, ISSUES
from ..sources.tables import TableError


def violations(rows: DataFrame) -> DataFrame:
    """(seq, rank, message), all of them; the reference order is by seq, then rank. Record numbers start at 2."""
    clean = rows.select("seq", *(strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("ad_id", "gold_goal", "gold_issue")), (strip(F.coalesce("ad_text", F.lit(""))) == "").alias("no_text"))
    again = F.row_number().over(Window.partitionBy("ad_id").orderBy("seq")) > 1
    quoted = F.concat(F.lit("'"), F.col("ad_id"), F.lit("'"))
    goal, issue = F.col("gold_goal") != "", F.col("gold_issue") != ""
    half = F.concat(F.col("ad_id"), F.lit(" has a "), F.when(goal, "goal").otherwise("issue"), F.lit(" label but no "), F.when(goal, "issue").otherwise("goal"))
    off = lambda c, known, what: F.when(goal & issue & ~F.col(c).isin(*known), F.concat(F.lit(f"unknown {what} label '"), F.col(c), F.lit("'")))
    found = F.array(
        F.struct(F.lit(1).alias("rank"), F.when(F.col("ad_id") == "", "empty ad_id").alias("message")),
        F.struct(F.lit(2).alias("rank"), F.when((F.col("ad_id") != "") & F.col("again"), F.concat(F.lit("duplicate ad_id "), quoted)).alias("message")),
        F.struct(F.lit(3).alias("rank"), F.when(F.col("no_text"), F.concat(F.lit("empty ad_text for "), quoted)).alias("message")),
        F.struct(F.lit(4).alias("rank"), F.when(goal != issue, half).alias("message")),
        F.struct(F.lit(5).alias("rank"), off("gold_goal", GOALS, "goal").alias("message")),
        F.struct(F.lit(6).alias("rank"), off("gold_issue", ISSUES, "issue").alias("message")),
    )
    return clean.withColumn("again", again).select("seq", F.explode(F.filter(found, lambda x: x["message"].isNotNull())).alias("v")).select("seq", "v.rank", "v.message")


def first_violation(found: DataFrame) -> DataFrame:
    """The one that a reader in file order meets first, as (record, message); no row if there is none."""
    first = found.agg(F.min_by("message", F.struct("seq", "rank")).alias("message"), F.min("seq").alias("seq"))
    return first.where("message is not null").select((F.col("seq") + 2).alias("record"), "message")


def raise_first(found: DataFrame, path: str) -> None:
    first = first_violation(found).first()
    if first:
        raise TableError(f"{path}:{first['record']}: {first['message']}")


def check_outputs(outputs: DataFrame, column: str = "payload") -> DataFrame:
    """Adds goal, issue, confidence, rationale and error to rows with a JSON payload of an annotator.

    Labels must be known; the rationale must be text that is not blank. An invalid payload gives empty labels and a reason.
    """
    parsed = F.from_json(column, "goal string, issue string, confidence string, rationale string")
    rows = outputs.withColumn("_p", parsed)
    known = {"goal": GOALS, "issue": ISSUES, "confidence": CONFIDENCE_LEVELS}
    error = F.lit(None).cast("string")
    blank = F.col("_p.rationale").isNull() | (strip(F.coalesce("_p.rationale", F.lit(""))) == "")
    error = F.when(blank, "field 'rationale' is missing or empty").otherwise(error)
    for name in reversed(list(known)):
        value = F.col(f"_p.{name}")
        error = F.when(value.isNull() | ~value.isin(*known[name]), F.concat(F.lit(f"field '{name}' has invalid value "), F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("None")))).otherwise(error)
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    out = {k: F.when(good, strip(F.col(f"_p.{k}"))).otherwise("") for k in (*known, "rationale")}
    return rows.withColumns(out).drop("_p")


def id_difference(left: DataFrame, right: DataFrame, shown: int = 5) -> DataFrame:
    """(only_left, only_right): the first ids, in order, that one side lacks."""
    a, b = left.select("ad_id").distinct(), right.select("ad_id").distinct()
    one = a.join(b, "ad_id", "left_anti").orderBy("ad_id").limit(shown).agg(F.sort_array(F.collect_list("ad_id")).alias("only_left"))
    two = b.join(a, "ad_id", "left_anti").orderBy("ad_id").limit(shown).agg(F.sort_array(F.collect_list("ad_id")).alias("only_right"))
    return one.crossJoin(two)
