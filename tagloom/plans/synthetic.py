"""Item tables and prediction logs derived from the driver's tables by md5 draws, in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CONFIDENCE_LEVELS, GOALS, ISSUES
from ..sources.tables import read_table

#: Phrases of synthetic ads; every rule group and issue occurs.
PHRASES = (
    "chip in before midnight",
    "donate $5 now and every dollar counts",
    "your polling place opens early",
    "sign the petition today",
    "add your name and volunteer",
    "stream it now with a subscription",
    "vote for the governor",
    "republicans and democrats in Washington",
    "prices and taxes are up",
    "the cost of living and rent",
    "health care and Medicare premiums",
    "abortion and reproductive freedom",
    "illegal immigration at the border",
    "free speech and the Supreme Court",
    "crime, police and fentanyl",
    "a corrupt record, can't trust the liar",
    "a sunny day in the park",
    "women's health and birth control",
    "our own story begins here",
    "give $5 to keep every family safe",
)
RUNS = {"a": 4, "b": 7}


def draw(seed: str, c: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c)), 1, 8), 16, 10).cast("long")


def draw_sql(seed: str, c: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {c}), 1, 8))::BIGINT)"


def pick(names: tuple[str, ...], d: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (d % len(names) + 1).cast("int"))


def pick_sql(names: tuple[str, ...], d: str) -> str:
    listed = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    return f"list_extract([{listed}], {d} % {len(names)} + 1)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ad_id, page_name, phrases, ad_text, true_goal, true_issue, gold_goal, gold_issue, label_mode, ...): a row for each document, with its whole text."""
    i = F.col("doc_id").cast("string")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    phrases = F.concat_ws(". ", *(pick(PHRASES, draw(f"phrase{k}", i)) for k in range(4)))
    rows = docs.select(F.col("doc_id").alias("seq"), i.alias("ad_id"), F.col("source").alias("page_name"), phrases.alias("phrases"), F.col("text"), pick(GOALS, draw("goal", i)).alias("true_goal"), pick(ISSUES, draw("issue", i)).alias("true_issue"), F.when(draw("mode", i) % 4 == 0, "blind").otherwise("assisted").alias("label_mode"), (draw("lab", i) % 10 != 0).alias("labelled"))
    label = lambda c: F.when(F.col("labelled"), F.col(f"true_{c}")).otherwise("").alias(f"gold_{c}")
    return rows.select("*", F.concat("phrases", F.lit(". "), "text").alias("ad_text"), label("goal"), label("issue"))


ITEMS_SQL = f"""items AS (
  SELECT *, phrases || '. ' || text AS ad_text, CASE WHEN labelled THEN true_goal ELSE '' END AS gold_goal, CASE WHEN labelled THEN true_issue ELSE '' END AS gold_issue
  FROM (SELECT doc_id AS seq, doc_id::VARCHAR AS ad_id, coalesce(source, '') AS page_name, coalesce(text, '') AS text,
    {" || '. ' || ".join(pick_sql(PHRASES, draw_sql(f"phrase{k}", "doc_id::VARCHAR")) for k in range(4))} AS phrases,
    {pick_sql(GOALS, draw_sql("goal", "doc_id::VARCHAR"))} AS true_goal, {pick_sql(ISSUES, draw_sql("issue", "doc_id::VARCHAR"))} AS true_issue,
    CASE WHEN {draw_sql("mode", "doc_id::VARCHAR")} % 4 = 0 THEN 'blind' ELSE 'assisted' END AS label_mode, {draw_sql("lab", "doc_id::VARCHAR")} % 10 <> 0 AS labelled
    FROM documents)
), gold AS (SELECT ad_id, gold_goal AS goal, gold_issue AS issue, label_mode FROM items WHERE labelled)"""


def gold(rows: DataFrame) -> DataFrame:
    return rows.where("labelled").select("ad_id", F.col("gold_goal").alias("goal"), F.col("gold_issue").alias("issue"), "label_mode")


def log(rows: DataFrame) -> DataFrame:
    """Prediction log of two runs: wrong labels by chance, failures, missing items, and failed first tries."""
    runs = F.explode(F.array(*(F.struct(F.lit(r).alias("run"), F.lit(m).alias("m")) for r, m in RUNS.items())))
    each = rows.select("ad_id", "true_goal", "true_issue", runs.alias("r")).select("ad_id", "true_goal", "true_issue", "r.run", "r.m").withColumn("k", F.concat("run", F.lit(":"), "ad_id"))
    k = F.col("k")
    tries = F.explode(F.sequence(F.when(draw("dup", k) % 5 == 0, 0).otherwise(1), F.lit(1)))
    each = each.where(draw("mis", k) % 50 != 0).withColumn("t", tries)
    error = F.when(F.col("t") == 0, "timeout").when(draw("err", k) % 33 == 0, "refused")
    good = error.isNull()
    flip = draw("flip", k) % F.col("m") == 0
    value = lambda c, names: F.when(good, F.when(flip, pick(names, draw(f"n{c}", k))).otherwise(F.col(f"true_{c}"))).otherwise("").alias(c)
    usage = F.when(F.col("t") == 0, F.lit(None).cast("map<string,bigint>")).otherwise(F.create_map(F.lit("input_tokens"), draw("tin", k) % 500, F.lit("output_tokens"), draw("tout", k) % 50))
    return each.select("run", "ad_id", value("goal", GOALS), value("issue", ISSUES), F.when(good, pick(CONFIDENCE_LEVELS, draw("conf", k))).otherwise("").alias("confidence"), F.when(good, F.concat(F.lit("because "), k)).otherwise("").alias("rationale"), F.lit("v2").alias("prompt_version"), F.lit("m").alias("model"), error.alias("error"), usage.alias("usage"), F.col("t").cast("long").alias("seq"))


def _value_sql(c: str, names: tuple[str, ...]) -> str:
    return f"CASE WHEN error IS NULL THEN CASE WHEN {draw_sql('flip', 'k')} % m = 0 THEN {pick_sql(names, draw_sql('n' + c, 'k'))} ELSE true_{c} END ELSE '' END AS {c}"


LOG_SQL = f"""log AS (
  SELECT run, ad_id, {_value_sql("goal", GOALS)}, {_value_sql("issue", ISSUES)}, CASE WHEN error IS NULL THEN {pick_sql(CONFIDENCE_LEVELS, draw_sql("conf", "k"))} ELSE '' END AS confidence,
    CASE WHEN error IS NULL THEN 'because ' || k ELSE '' END AS rationale, error, CASE WHEN t = 1 THEN {draw_sql("tin", "k")} % 500 END AS tin, CASE WHEN t = 1 THEN {draw_sql("tout", "k")} % 50 END AS tout, t AS seq
  FROM (SELECT *, CASE WHEN t = 0 THEN 'timeout' WHEN {draw_sql("err", "k")} % 33 = 0 THEN 'refused' END AS error
    FROM (SELECT ad_id, true_goal, true_issue, run, m, run || ':' || ad_id AS k FROM items, (VALUES {", ".join(f"('{r}', {m})" for r, m in RUNS.items())}) AS r(run, m)), (VALUES (0), (1)) AS tries(t)
    WHERE {draw_sql("mis", "k")} % 50 <> 0 AND (t = 1 OR {draw_sql("dup", "k")} % 5 = 0))
), preds AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY run, ad_id ORDER BY seq DESC) = 1),
runs AS (SELECT unnest([{", ".join(f"'{r}'" for r in RUNS)}]) AS run),
aligned AS (
  SELECT r.run, f.field, g.ad_id, CASE f.field WHEN 'goal' THEN g.goal ELSE g.issue END AS gold, g.label_mode,
    CASE WHEN p.ad_id IS NULL OR p.error IS NOT NULL THEN '(error)' WHEN f.field = 'goal' THEN p.goal ELSE p.issue END AS pred
  FROM gold g CROSS JOIN runs r CROSS JOIN (VALUES ('goal'), ('issue')) AS f(field) LEFT JOIN preds p ON p.run = r.run AND p.ad_id = g.ad_id
)"""


def _labels_sql(with_error: bool) -> str:
    from ..schema import ERROR_LABEL, FIELDS

    rows = [f"('{f}', {i}, '{x}')" for f, labels in FIELDS.items() for i, x in enumerate((*labels, ERROR_LABEL) if with_error else labels)]
    return ", ".join(rows)


LABELS_SQL = f"labels_dim AS (SELECT * FROM (VALUES {_labels_sql(False)}) AS t(field, ord, label)), labels_err AS (SELECT * FROM (VALUES {_labels_sql(True)}) AS t(field, ord, label))"


def file_text(rows: DataFrame) -> DataFrame:
    """(file, raw): a pasted page of three cards for each document, the first with its whole text."""
    i = F.col("ad_id")
    raw = F.concat(F.lit("junk before\nLibrary ID: "), i, F.lit("1\nStarted running on May "), (draw("day", i) % 28 + 1).cast("string"), F.lit(", 2026\nPlatforms\n"), "page_name", F.lit("\nSponsored • Paid for by Committee "), "page_name", F.lit("\n"), "text", F.lit("\n0:00 / 0:27\nACTION.EXAMPLE.COM\nLibrary ID: "), i, F.lit("2\nActive\nLibrary ID: "), i, F.lit("3\nStarted running on x\nOther Page\nSponsored • Paid for by Other\nshort   \n\n\n\nbody\n​\nActive"))
    return rows.select(F.col("ad_id").alias("file"), raw.alias("raw"))


FILES_SQL = f"""files AS (SELECT ad_id AS file, 'junk before' || chr(10) || 'Library ID: ' || ad_id || '1' || chr(10) || 'Started running on May ' || ({draw_sql("day", "ad_id")} % 28 + 1) || ', 2026' || chr(10) || 'Platforms' || chr(10) || page_name || chr(10) || 'Sponsored • Paid for by Committee ' || page_name || chr(10) || text
  || chr(10) || '0:00 / 0:27' || chr(10) || 'ACTION.EXAMPLE.COM' || chr(10) || 'Library ID: ' || ad_id || '2' || chr(10) || 'Active' || chr(10) || 'Library ID: ' || ad_id || '3' || chr(10) || 'Started running on x' || chr(10) || 'Other Page' || chr(10) || 'Sponsored • Paid for by Other' || chr(10) || 'short   ' || chr(10) || chr(10) || chr(10) || chr(10) || 'body' || chr(10) || chr(8203) || chr(10) || 'Active' AS raw FROM items)"""
