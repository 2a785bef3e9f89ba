import pytest
from pyspark.sql import functions as F

from tagloom import report
from tagloom.operators import evaluate as ev
from tagloom.schema import PREDICTION


def aligned(spark, gold, pred, field="goal", run="r"):
    rows = [(run, field, f"{i:03d}", g, p) for i, (g, p) in enumerate(zip(gold, pred, strict=True))]
    return spark.createDataFrame(rows, "run string, field string, ad_id string, gold string, pred string")


def kappa(spark, gold, pred):
    return ev.kappa(ev.cells(aligned(spark, gold, pred))).first()["kappa"]


def test_accuracy(spark):
    assert ev.accuracy(ev.cells(aligned(spark, "abab", "abbb"))).first()["accuracy"] == 0.75


def test_per_label_and_macro(spark):
    names = {"a": "persuasion", "b": "mobilization"}
    table = aligned(spark, [names[c] for c in "aaabb"], [names[c] for c in "aabba"])
    rows = {r["label"]: r for r in ev.per_label(ev.cells(table)).collect()}
    a, b = rows["persuasion"], rows["mobilization"]
    assert a["precision"] == pytest.approx(2 / 3) and a["recall"] == pytest.approx(2 / 3) and a["f1"] == pytest.approx(2 / 3) and a["support"] == 3
    assert b["f1"] == pytest.approx(0.5) and b["support"] == 2
    assert rows["fundraising"]["f1"] == 0 and rows["fundraising"]["support"] == 0
    same = aligned(spark, ["persuasion", "mobilization"], ["persuasion", "mobilization"])
    assert ev.macro_f1(ev.per_label(ev.cells(same))).first()["macro_f1"] == 1.0


def test_zero_precision(spark):
    rows = {r["label"]: r for r in ev.per_label(ev.cells(aligned(spark, ["other"] * 2, ["persuasion"] * 2))).collect()}
    assert (rows["other"]["precision"], rows["other"]["recall"], rows["other"]["f1"]) == (0, 0, 0)


def test_confusion_sums_to_items(spark):
    table = aligned(spark, ["persuasion", "persuasion", "other"], ["persuasion", "other", "(error)"])
    grid = {(r["gold"], r["pred"]): r["n"] for r in ev.confusion(ev.cells(table)).collect()}
    assert len(grid) == 25 and sum(grid.values()) == 3
    assert grid["persuasion", "persuasion"] == grid["persuasion", "other"] == grid["other", "(error)"] == 1


def test_kappa(spark):
    assert kappa(spark, "abab", "abab") == 1.0
    assert kappa(spark, "aabb", "abab") == pytest.approx(0.0)
    assert kappa(spark, "aa", "aa") == 1.0


def test_bootstrap(spark):
    table = aligned(spark, "a" * 20, "a" * 15 + "b" * 5)
    one, two = ev.bootstrap(table).first(), ev.bootstrap(table.repartition(3)).first()
    assert one == two and one["ci_lo"] < 0.75 < one["ci_hi"]
    hashed = ev.bootstrap_hashed(table).first()
    assert hashed["ci_lo"] < 0.75 < hashed["ci_hi"]
    assert ev.bootstrap_exact([]) == (0.0, 0.0)


def test_bootstrap_query_takes_2000_resamples(spark, tmp_path):
    import hashlib

    from tagloom.plans import queries

    spark.createDataFrame([(i, f"text {i}", "s") for i in range(30)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    flags = {}
    for r in sorted(queries.eval_align(spark, str(tmp_path)).collect(), key=lambda r: r["ad_id"]):
        flags.setdefault((r["run"], r["field"]), []).append(r["gold"] == r["pred"])
    n = len(next(iter(flags.values())))
    places = [[int(hashlib.md5(f"0:{b}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)] for b in range(2000)]
    want = {}
    for key, own in flags.items():
        means = sorted(sum(own[p] for p in places[b]) / n for b in range(2000))
        want[key] = (round(means[50], 9), round(means[1950], 9))
    got = {(r["run"], r["field"]): (r["ci_lo"], r["ci_hi"]) for r in queries.bootstrap_ci_2000(spark, str(tmp_path)).collect()}
    assert len(got) == 4 and got == want


def test_mcnemar(spark):
    both = aligned(spark, "a" * 6, "aaaaab", run="a").union(aligned(spark, "a" * 6, "bbbbaa", run="b"))
    r = ev.mcnemar(both, "a", "b").first()
    assert (r["a_only"], r["b_only"]) == (4, 1) and r["p_value"] == pytest.approx(0.375)
    same = aligned(spark, "ab", "aa", run="a").union(aligned(spark, "ab", "aa", run="b"))
    assert ev.mcnemar(same, "a", "b").first()["p_value"] == 1.0


def test_binomial_matches_exact(spark):
    from math import comb

    cases = [(b, c) for b in range(0, 30, 3) for c in range(0, 30, 4)]
    got = spark.createDataFrame(cases, "b long, c long").withColumn("p", ev.binomial_p(F.col("b"), F.col("c"))).collect()
    for r in got:
        n = r["b"] + r["c"]
        want = 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(min(r["b"], r["c"]) + 1)) / 2**n)
        assert r["p"] == pytest.approx(want, abs=1e-12)


def predictions(spark, rows):
    full = [(i, g, s, "high", "why", "v2", "m", e, u, q) for i, g, s, e, u, q in rows]
    return spark.createDataFrame(full, PREDICTION)


def test_last_write_wins(spark):
    preds = predictions(spark, [("1", "", "", "boom", None, 0), ("1", "other", "other", None, {}, 1), ("2", "other", "other", None, {}, 0)])
    got = {r["ad_id"]: r for r in ev.last_write_wins(preds).collect()}
    assert got["1"]["error"] is None and got["1"]["goal"] == "other" and len(got) == 2


def test_errors_count_as_wrong(spark):
    gold = spark.createDataFrame([(str(i), "other", "other") for i in range(3)], "ad_id string, goal string, issue string")
    preds = predictions(spark, [("0", "other", "other", None, {"input_tokens": 5, "output_tokens": 1}, 0), ("1", "", "", "boom", {"input_tokens": 7}, 0)])
    r = report.evaluate(gold, preds, resamples=50)
    assert (r["n_gold"], r["n_scored_ok"], r["n_errors"]) == (3, 1, 2)
    assert r["fields"]["goal"]["accuracy"] == pytest.approx(1 / 3)
    assert r["tokens"] == {"input": 12, "output": 1}
    rows = {d["ad_id"]: d for d in ev.disagreements(gold, preds).collect()}
    assert rows["1"]["rationale"] == "boom" and rows["2"]["rationale"] == "no prediction" and len(rows) == 2
    text = report.render("T", r, [d.asDict() for d in rows.values()])
    assert "## goal" in text and "33.3%" in text and "Items labelled otherwise (2)" in text


def test_many_runs_are_not_named_in_the_plan(spark, monkeypatch):
    gold = spark.createDataFrame([(str(i), "other", "other") for i in range(5)], "ad_id string, goal string, issue string")
    preds = spark.createDataFrame([(f"r{k}", str(i), "other", "economy", "low", "", "v", "m", None, None, 0) for k in range(4) for i in range(5 - k)], "run string, ad_id string, goal string, issue string, confidence string, rationale string, prompt_version string, model string, error string, usage map<string,bigint>, seq long")
    few = (sorted(map(str, ev.align(gold, preds).collect())), sorted(map(str, ev.counts(gold, preds).collect())))
    monkeypatch.setattr(ev, "NAMED_RUNS", 3)
    assert (sorted(map(str, ev.align(gold, preds).select("run", "field", "ad_id", "gold", "pred").collect())), sorted(map(str, ev.counts(gold, preds).collect()))) == few and len(few[0]) == 40


def test_exact_bootstrap_is_bounded(spark, monkeypatch):
    aligned = spark.createDataFrame([("a", "goal", str(i), "x", "x") for i in range(9)], "run string, field string, ad_id string, gold string, pred string")
    monkeypatch.setattr(ev, "MOST_EXACT", 8)
    with pytest.raises(ValueError, match="too many"):
        ev.bootstrap(aligned)


def test_no_predictions_at_all(spark):
    gold = spark.createDataFrame([("1", "other", "other")], "ad_id string, goal string, issue string")
    r = report.evaluate(gold, spark.createDataFrame([], PREDICTION), resamples=10)
    assert r["n_errors"] == 1 and r["fields"]["goal"]["accuracy"] == 0


def test_percent_rounds_by_binary_value():
    assert report.percent(0.0625) == "6.2%"


def test_results_do_not_depend_on_partitions(spark):
    table = aligned(spark, ["persuasion", "other", "other"] * 7, ["persuasion", "other", "persuasion"] * 7)
    one, many = (ev.per_label(ev.cells(table.repartition(n))).orderBy("label").collect() for n in (1, 16))
    assert one == many
