"""Command line: classify, evaluate, compare, import-library, drop-ad, import-labels, make-sheet, assist, baseline."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import report
from .functions import rules
from .operators import annotate, labeling, neardup, paste
from .operators import evaluate as ev
from .operators.validate import raise_first, violations
from .schema import ALL_COLUMNS
from .sources import tables as tb


def session() -> SparkSession:
    return SparkSession.builder.appName("tagloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def classify(spark, a) -> int:
    if not os.environ.get("ANTHROPIC_API_KEY"):
        print("ANTHROPIC_API_KEY is not set.", file=sys.stderr)
        return 2

    def client():
        import anthropic

        return anthropic.Anthropic()

    items = tb.read_gold(spark, a.gold)
    left = annotate.todo(items, tb.read_predictions(spark, a.out), a.limit)
    failed = tb.append_predictions(annotate.annotate(left, client, prompt_version=a.prompt, model=a.model), a.out)
    print(f"Done. {failed} failures.")
    return int(failed > 0)


def _gold(spark, a):
    items = tb.read_gold(spark, a.gold)
    return labeling.subset(tb.labels_of(items), items, a.subset)


def evaluate(spark, a) -> int:
    if not os.path.exists(a.preds):
        print(f"There is no predictions file {a.preds}; run classify or baseline first.", file=sys.stderr)
        return 2
    gold, preds = _gold(spark, a).cache(), tb.read_predictions(spark, a.preds).cache()
    found = report.evaluate(gold, preds)
    title = f"Evaluation: {Path(a.preds).stem}" + (f" ({a.subset} ads only)" if a.subset != "all" else "")
    rows = [r.asDict() for r in ev.disagreements(gold, preds).orderBy("ad_id").collect()]
    report.emit(report.render(title, found, rows), a.report)
    return 0


def compare(spark, a) -> int:
    gold = _gold(spark, a).cache()
    both = tb.read_predictions(spark, a.preds_a).withColumn("run", F.lit("a")).unionByName(tb.read_predictions(spark, a.preds_b).withColumn("run", F.lit("b")))
    aligned = ev.align(gold, both, spark.createDataFrame([("a",), ("b",)], "run string"))
    rows = [r.asDict() for r in ev.mcnemar(aligned, "a", "b").orderBy("field").collect()]
    report.emit(report.render_comparison(Path(a.preds_a).stem, Path(a.preds_b).stem, rows, gold.count()), a.report)
    return 0


def import_library(spark, a) -> int:
    existing = tb.read_rows(spark, a.gold)
    cards = paste.numbered(paste.parse(tb.read_pastes(spark, a.raw))).drop("file", "card_no")
    decided = neardup.settle(neardup.decide(cards, existing, tb.read_dropped(spark, a.gold), a.max_per_page, a.limit))
    fresh = neardup.new_rows(decided, a.search, existing.count())
    tb.write_gold(existing.select("seq", *ALL_COLUMNS).unionByName(fresh), a.gold)
    skipped = decided.where("not accepted")
    print(f"Added {decided.where('accepted').count()} items to {a.gold}; skipped {skipped.count()}.")
    for r in skipped.where("not startswith(reason, 'batch limit')").orderBy("seq").toLocalIterator():
        print(f"  skipped {r['library_id']}: {r['reason']}")
    if over := skipped.where("startswith(reason, 'batch limit')").count():
        print(f"  {over} items are past the limit of {a.limit}")
    return 0


def drop_ad(spark, a) -> int:
    items = neardup.settle(tb.read_rows(spark, a.gold))
    rest, entry = labeling.drop(items, a.id, a.reason)
    entry = neardup.settle(entry)
    tb.write_gold(rest, a.gold)
    tb.append_dropped(entry, a.gold)
    r = entry.first()
    print(f"Dropped {r['ad_id']} ({r['page_name']}): {r['reason']}")
    return 0


def import_labels(spark, a) -> int:
    items, rows = neardup.settle(tb.read_rows(spark, a.gold)), tb.read_sheet(spark, a.xlsx)
    labeling.same_ids(items, rows)
    done = neardup.settle(labeling.returned(items, rows))
    raise_first(violations(done), a.gold)  # nothing is written unless all labels are valid
    tb.write_gold(done, a.gold)
    s = labeling.return_stats(done).first()
    print(f"{a.gold}: {s['labeled']} of {s['ads']} items labelled; blind {s['blind_labeled']}, assisted checked {s['checked_assisted']}.")
    if s["checked_assisted"]:
        print(f"  suggestions changed: goal {s['goal_overrides']}/{s['checked_assisted']}, issue {s['issue_overrides']}/{s['checked_assisted']}")
    if s["unchecked_assisted"]:
        print(f"  {s['unchecked_assisted']} assisted rows had labels but were not checked; they stay unlabelled")
    return 0


def assist(spark, a) -> int:
    items = neardup.settle(labeling.assign(tb.read_rows(spark, a.gold), a.blind, a.seed))
    tb.write_gold(items, a.gold)
    s = labeling.mode_counts(items).first()
    print(f"{a.gold}: {s['blind']} blind, {s['assisted']} assisted (of {s['ads']}).")
    return 0


def baseline(spark, a) -> int:
    items = tb.read_gold(spark, a.gold)
    tb.append_predictions(rules.predictions(items), a.out, overwrite=True)
    print(f"Wrote rule predictions of {items.count()} items to {a.out}")
    return 0


def make_sheet(spark, a) -> int:
    rows = labeling.sheet(tb.read_rows(spark, a.gold), tb.read_recheck(spark, a.recheck))
    tb.write_sheet(rows, a.out)
    print(f"Wrote {a.out} with {rows.count()} items to label")
    return 0


GOLD = (("--gold",), {"default": "data/gold.csv"})
SUBSET = (("--subset",), {"choices": ["all", "blind", "assisted"], "default": "all"})
COMMANDS = {
    "classify": (classify, [GOLD, (("--prompt",), {"default": "v2"}), (("--model",), {"default": annotate.DEFAULT_MODEL}), (("--out",), {"required": True}), (("--limit",), {"type": int, "default": 0})]),
    "evaluate": (evaluate, [GOLD, SUBSET, (("--preds",), {"required": True}), (("--report",), {})]),
    "compare": (compare, [GOLD, SUBSET, (("--preds-a",), {"required": True}), (("--preds-b",), {"required": True}), (("--report",), {})]),
    "import-library": (import_library, [GOLD, (("--raw",), {"required": True}), (("--search",), {"required": True}), (("--max-per-page",), {"type": int, "default": 4}), (("--limit",), {"type": int, "default": 0})]),
    "drop-ad": (drop_ad, [GOLD, (("--id",), {"required": True}), (("--reason",), {"required": True})]),
    "import-labels": (import_labels, [GOLD, (("--xlsx",), {"required": True})]),
    "make-sheet": (make_sheet, [GOLD, (("--recheck",), {"default": "data/recheck.csv"}), (("--out",), {"required": True})]),
    "assist": (assist, [GOLD, (("--blind",), {"type": int, "default": 40}), (("--seed",), {"type": int, "default": 2026})]),
    "baseline": (baseline, [GOLD, (("--out",), {"required": True})]),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tagloom", description="Label short texts by rules or an annotator and evaluate labels.")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (run, options) in COMMANDS.items():
        own = sub.add_parser(name)
        for flags, settings in options:
            own.add_argument(*flags, **settings)
        own.set_defaults(run=run)
    a = parser.parse_args(argv)
    return a.run(session(), a)


if __name__ == "__main__":
    raise SystemExit(main())
