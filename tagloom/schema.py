"""Label taxonomy, record schemas and the small dimension tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Label names and orders that results are reported in.
GOALS = ("persuasion", "mobilization", "fundraising", "other")
ISSUES = ("economy", "healthcare", "abortion", "immigration", "democracy_voting", "candidate_character", "public_safety", "other")
CONFIDENCE_LEVELS = ("high", "medium", "low")
FIELDS = {"goal": GOALS, "issue": ISSUES}
ERROR_LABEL = "(error)"
BLIND, ASSISTED = "blind", "assisted"

# Column names of the item table, the drop log and the label sheet.
GOLD_COLUMNS = ("ad_id", "page_name", "ad_text", "source_url", "gold_goal", "gold_issue", "notes")
EXTRA_COLUMNS = ("search_term", "paid_for", "started_running")
ASSIST_COLUMNS = ("label_mode", "suggested_goal", "suggested_issue", "suggestion_reason")
ALL_COLUMNS = GOLD_COLUMNS + EXTRA_COLUMNS + ASSIST_COLUMNS
DROPPED_COLUMNS = ("ad_id", "page_name", "reason", "ad_text")
SHEET_COLUMNS = ("#", "ad_id", "ad_text", "gold_goal", "gold_issue", "checked", "notes", "why_suggested", "page_name", "source_url", "search_term", "paid_for", "started_running")


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


PREDICTION = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("ad_id", "goal", "issue", "confidence", "rationale", "prompt_version", "model", "error")),
        T.StructField("usage", T.MapType(T.StringType(), T.LongType())),
        T.StructField("seq", T.LongType()),
    ]
)


def taxonomy(spark: SparkSession, with_error: bool = False) -> DataFrame:
    """(field, ord, label), a row for each label; with_error adds the error label as the last of each field."""
    rows = [(f, i, x) for f, labels in FIELDS.items() for i, x in enumerate((*labels, ERROR_LABEL) if with_error else labels)]
    return spark.createDataFrame(rows, "field string, ord int, label string")
