"""Registered queries: each applies one operator to whole tables; values are rounded where both engines must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import annotate, labeling, neardup, paste, validate
from ..operators import evaluate as ev
from . import synthetic as syn
from .synthetic import draw

LINES = ("0:00 / 0:27", "SECURE.EXAMPLE.COM", "Active", "Impressions: 5K", "NOT AFFILIATED WITH META", "plain line", "GO.EXAMPLE.ORG/PATH", " Active ", "​", "12:5 / 0:27")


def _preds(rows: DataFrame) -> DataFrame:
    return ev.last_write_wins(syn.log(rows), "run")


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    rows = syn.items(spark, d)
    return ev.align(syn.gold(rows), _preds(rows))


def _cells(spark, d):
    return ev.cells(_aligned(spark, d))


def eval_align(spark, d):
    return _aligned(spark, d)


def eval_accuracy(spark, d):
    return ev.accuracy(_cells(spark, d)).select("run", "field", "n_gold", F.round("accuracy", 9).alias("accuracy"))


def eval_counts(spark, d):
    rows = syn.items(spark, d)
    return ev.counts(syn.gold(rows), _preds(rows))


def eval_confusion(spark, d):
    return ev.confusion(_cells(spark, d)).select("run", "field", "gold", "pred", "n")


def eval_per_label(spark, d):
    return ev.per_label(_cells(spark, d)).select("run", "field", "label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


def eval_macro_f1(spark, d):
    return ev.macro_f1(ev.per_label(_cells(spark, d))).select("run", "field", F.round("macro_f1", 9).alias("macro_f1"))


def eval_kappa(spark, d):
    return ev.kappa(_cells(spark, d)).select("run", "field", F.round("kappa", 9).alias("kappa"))


def eval_disagreements(spark, d):
    rows = syn.items(spark, d)
    return ev.disagreements(syn.gold(rows), _preds(rows).where("run = 'a'"))


def eval_off_taxonomy(spark, d):
    rows = syn.items(spark, d)
    odd = _preds(rows).withColumn("goal", F.when((draw("odd", F.col("ad_id")) % 20 == 0) & F.col("error").isNull(), "Fundraising").otherwise(F.col("goal")))
    return ev.off_taxonomy(ev.align(syn.gold(rows), odd))


def eval_subset_accuracy(spark, d):
    rows = syn.items(spark, d)
    out = None
    for mode in ("all", "blind", "assisted"):
        gold = labeling.subset(syn.gold(rows), rows, mode)
        one = ev.accuracy(ev.cells(ev.align(gold, _preds(rows)))).select(F.lit(mode).alias("subset"), "run", "field", "n_gold", F.round("accuracy", 9).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


def anchoring_gap(spark, d):
    """Agreement of the rules with gold labels on blind and on assisted items, and the difference."""
    rows = syn.items(spark, d)
    labelled = rules.classify(rows.where("labelled").select("ad_id", "ad_text", "gold_goal", "gold_issue", "label_mode"), reasons=False)
    hit = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (F.col(f) == F.col(f"gold_{f}")).cast("int").alias("ok")) for f in ("goal", "issue"))))
    rate = lambda m: F.avg(F.when(F.col("label_mode") == m, F.col("ok")))
    both = labelled.select("label_mode", hit.alias("x")).select("label_mode", "x.*").groupBy("field").agg(rate("blind").alias("b"), rate("assisted").alias("a"))
    return both.select("field", F.round("b", 9).alias("blind"), F.round("a", 9).alias("assisted"), F.round(F.col("a") - F.col("b"), 9).alias("gap"))


def compare_mcnemar(spark, d):
    found = ev.mcnemar(_aligned(spark, d), "a", "b")
    return found.select("field", *(F.round(c, 9).alias(c) for c in ("accuracy_a", "accuracy_b")), "a_only", "b_only", F.round("p_value", 9).alias("p_value"))


def bootstrap_ci(spark, d):
    return ev.bootstrap_hashed(_aligned(spark, d), 200).select("run", "field", F.round("ci_lo", 9).alias("ci_lo"), F.round("ci_hi", 9).alias("ci_hi"))


def bootstrap_ci_2000(spark, d):
    """The interval of the reference's 2,000 resamples. ``bootstrap_ci`` is the form of 200 that SQL checks."""
    return ev.bootstrap_hashed(_aligned(spark, d), 2000).select("run", "field", F.round("ci_lo", 9).alias("ci_lo"), F.round("ci_hi", 9).alias("ci_hi"))


def bootstrap_ci_exact(spark, d):
    """The interval of Python's generator with all 2,000 resamples, as reports show it."""
    return ev.bootstrap(_aligned(spark, d), 2000).select("run", "field", F.round("ci_lo", 9).alias("ci_lo"), F.round("ci_hi", 9).alias("ci_hi"))


def preds_last_write_wins(spark, d):
    return _preds(syn.items(spark, d)).select("run", "ad_id", "goal", "issue", "confidence", "error", "seq")


def classify_resume_todo(spark, d):
    rows = syn.items(spark, d)
    return annotate.todo(rows, _preds(rows).where("run = 'a'")).select("ad_id")


def classify_limit(spark, d):
    rows = syn.items(spark, d)
    return annotate.todo(rows, _preds(rows).where("run = 'a'"), 100).select("ad_id")


def annotate_validate(spark, d):
    """Checks of annotator answers, one for each item, a part of them wrong in each field."""
    i = F.col("ad_id")
    part = lambda c, names: syn.pick((*names, "Bad"), draw(f"p{c}", i))
    q = F.lit('"')
    why = F.when(draw("why", i) % 9 == 0, F.lit('" "')).when(draw("why", i) % 9 == 1, F.lit("null")).otherwise(F.lit('" because "'))
    body = F.concat(F.lit('{"goal":'), q, part("goal", syn.GOALS), q, F.lit(',"issue":'), q, part("issue", syn.ISSUES), q, F.when(draw("noc", i) % 11 == 0, "").otherwise(F.concat(F.lit(',"confidence":'), q, part("conf", syn.CONFIDENCE_LEVELS), q)), F.lit(',"rationale":'), why, F.lit("}"))
    return validate.check_outputs(syn.items(spark, d).select("ad_id", body.alias("payload"))).select("ad_id", "goal", "issue", "confidence", "rationale", "error")


def rules_labels(spark, d):
    return rules.classify(syn.items(spark, d).select("ad_id", "ad_text"), reasons=False).select("ad_id", "goal", "issue", "confidence")


def rules_reason(spark, d):
    return rules.classify(syn.items(spark, d).select("ad_id", "ad_text")).select("ad_id", "goal", "issue", "confidence", "reason")


def rules_hits(spark, d):
    named = {"money": rules.MONEY_ASK, "voting": rules.VOTING_INFO, "civic": rules.CIVIC_ACTION, "political": rules.POLITICAL, "offer": rules.NON_POLITICAL_OFFER, **rules.ISSUE_WORDS}
    rows = syn.items(spark, d).select("ad_id", "ad_text", rules.lowered(F.col("ad_text")).alias("low"))
    return rows.select("ad_id", *(rules.count(F.col("ad_text"), x, F.col("low")).cast("long").alias(k) for k, x in named.items()))


def rules_label_counts(spark, d):
    return rules.classify(syn.items(spark, d).select("ad_id", "ad_text"), reasons=False).groupBy("goal", "issue", "confidence").agg(F.count("*").alias("n"))


def rules_predictions(spark, d):
    rows = rules.predictions(syn.items(spark, d).select("ad_id", "ad_text", "seq"))
    return rows.select("ad_id", "goal", "issue", "confidence", "rationale", "prompt_version", "model", "error", "seq")


def word_sets(spark, d):
    return syn.items(spark, d).select("ad_id", F.array_join(F.sort_array(text.word_set(F.col("ad_text"))), " ").alias("words"))


def near_dup_pairs(spark, d):
    return neardup.pairs(syn.items(spark, d).select("seq", "text"), "seq", "text").select("id_a", "id_b")


def near_dup_earlier(spark, d):
    return neardup.earlier_twin(syn.items(spark, d).select("seq", "text"), "seq", "text").select("seq", "first")


def _import(spark, d):
    rows = syn.items(spark, d)
    i = F.col("ad_id")
    existing = rows.where(draw("old", i) % 20 == 0).select("ad_id", "page_name", F.col("text").alias("ad_text"))
    dropped = rows.where(draw("drop", i) % 40 == 0).select("ad_id")
    cards = rows.select("seq", F.col("ad_id").alias("library_id"), "page_name", F.when(draw("nob", i) % 50 == 0, "").otherwise(F.col("text")).alias("ad_text"), F.lit("p").alias("paid_for"), F.lit("s").alias("started_running"))
    return existing, neardup.decide(cards, existing, dropped, 12)


def import_decisions(spark, d):
    return _import(spark, d)[1].select("seq", "library_id", "accepted", "reason")


def import_skip_summary(spark, d):
    return neardup.skip_summary(_import(spark, d)[1])


def import_new_rows(spark, d):
    return neardup.new_rows(_import(spark, d)[1], "term").select("seq", "ad_id", "page_name", "ad_text", "source_url", "gold_goal", "search_term")


def page_counts(spark, d):
    return syn.items(spark, d).groupBy("page_name").agg(F.count("*").alias("n"))


def parse_cards(spark, d):
    return paste.parse(paste.lines(syn.file_text(syn.items(spark, d)))).select("file", F.col("card_no").cast("int").alias("card_no"), "library_id", "page_name", "paid_for", "started_running", "ad_text")


def terminators(spark, d):
    rows = syn.items(spark, d).select("ad_id", F.explode(F.concat(F.split("text", "\n"), F.array(syn.pick(LINES, draw("line", F.col("ad_id")))))).alias("line"))
    return rows.select("ad_id", "line", paste.is_terminator(F.col("line")).alias("stop"))


def normalize_text(spark, d):
    c = F.concat(F.lit("  \n"), "page_name", F.lit("  \n\n\n\n"), "text", F.lit("​ \n"), "phrases", F.lit("\n\n"))
    return syn.items(spark, d).select("ad_id", text.normalize_text(c).alias("body"))


def row_heights(spark, d):
    return syn.items(spark, d).select("ad_id", text.row_height(F.col("text")).cast("int").alias("height"))


def _assigned(spark, d, exact):
    rows = syn.items(spark, d).select("seq", "ad_id", "ad_text", F.lit("").alias("label_mode"), *(F.lit("").alias(c) for c in ("suggested_goal", "suggested_issue", "suggestion_reason")))
    return labeling.assign(rows, 40, 2026, exact=exact).select("ad_id", "label_mode", "suggested_goal", "suggested_issue", "suggestion_reason")


def blind_assign(spark, d):
    """The draw by hash, which any engine can repeat."""
    return _assigned(spark, d, False)


def blind_assign_exact(spark, d):
    """The draw of Python's generator, as the command line makes it."""
    return _assigned(spark, d, True)


def assist_counts(spark, d):
    return labeling.mode_counts(syn.items(spark, d))


def _workflow(spark, d):
    """Items with suggestions, and sheet rows with changes by chance."""
    i = F.col("ad_id")
    rows = syn.items(spark, d)
    assisted = F.col("label_mode") == "assisted"
    blank = F.lit("")
    items = rows.select("seq", "ad_id", "ad_text", "page_name", "gold_goal", "gold_issue", blank.alias("notes"), "label_mode", F.when(assisted, F.col("true_goal")).otherwise("").alias("suggested_goal"), F.when(assisted, F.col("true_issue")).otherwise("").alias("suggested_issue"), F.when(assisted, F.concat(F.lit("why "), i)).otherwise("").alias("suggestion_reason"), *(blank.alias(c) for c in ("source_url", "search_term", "paid_for", "started_running")))
    label = lambda c, names: F.when(draw("sl", i) % 8 == 0, "").when(draw(f"s{c}", i) % 6 == 0, syn.pick(names, draw(f"v{c}", i))).otherwise(F.col(f"true_{c}")).alias(f"gold_{c}")
    sheet = rows.select("seq", "ad_id", label("goal", syn.GOALS), label("issue", syn.ISSUES), F.concat(F.lit("note "), i).alias("notes"), F.when(assisted, F.when(draw("chk", i) % 3 == 0, "").otherwise(" Yes ")).otherwise("blind").alias("checked"))
    return items, sheet


def workbook_rows(spark, d):
    items, _ = _workflow(spark, d)
    recheck = items.where(draw("rechk", F.col("ad_id")) % 7 == 0).select("ad_id", F.concat(F.lit("look again "), "ad_id").alias("note"))
    return labeling.sheet(items, recheck).select(F.col("#").alias("row_no"), "ad_id", "gold_goal", "gold_issue", "checked", "why_suggested")


def import_labels_rows(spark, d):
    return labeling.returned(*_workflow(spark, d)).select("ad_id", "gold_goal", "gold_issue", "notes", "unchecked", "checked", "goal_override", "issue_override")


def import_labels_stats(spark, d):
    return labeling.return_stats(labeling.returned(*_workflow(spark, d)))


def override_rates(spark, d):
    return labeling.override_rates(labeling.returned(*_workflow(spark, d))).select("checked_assisted", F.round("goal_rate", 9).alias("goal_rate"), F.round("issue_rate", 9).alias("issue_rate"))


def workbook_progress(spark, d):
    return labeling.progress(_workflow(spark, d)[1].withColumn("checked", text.strip(F.col("checked"))))


def label_final_counts(spark, d):
    return labeling.final_counts(_workflow(spark, d)[1].withColumn("checked", text.strip(F.col("checked")))).select("field", "label", "n")


def validate_gold(spark, d):
    i = F.col("ad_id")
    rows = syn.items(spark, d)
    faulty = rows.select("seq", F.when(draw("v1", i) % 97 == 0, " ").when(draw("v2", i) % 53 == 0, (F.col("seq") - 1).cast("string")).otherwise(i).alias("ad_id"), F.when(draw("v3", i) % 61 == 0, "").otherwise(F.col("text")).alias("ad_text"), F.when(draw("v4", i) % 71 == 0, "").when(draw("v5", i) % 67 == 0, "Fundraising").otherwise(F.col("gold_goal")).alias("gold_goal"), "gold_issue")
    return validate.violations(faulty)


def id_set_diff(spark, d):
    rows = syn.items(spark, d)
    left, right = rows.where(draw("il", F.col("ad_id")) % 30 != 0), rows.where(draw("ir", F.col("ad_id")) % 30 != 0)
    diff = validate.id_difference(left, right)
    return diff.select(F.array_join("only_left", ",").alias("only_left"), F.array_join("only_right", ",").alias("only_right"))


def drop_item(spark, d):
    return labeling.drop(syn.items(spark, d), "7", " off topic ")[0].groupBy("page_name").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import files

    own = {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k != "queries"}
    return own | files.queries()
