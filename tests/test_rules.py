import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tagloom.functions import rules, text


def run(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, ad_text string")
    return [r for r in rules.classify(rows).orderBy("i").collect()]


def test_goal_order(spark):
    got = run(spark, "Early voting is on, chip in!", "Find your polling place and make a plan to vote", "Sign the petition", "Vote Jane Doe on May 5 for an affordable state", "Election special: stream it now", "hello")
    assert [r["goal"] for r in got] == ["fundraising", "mobilization", "mobilization", "persuasion", "other", "persuasion"]
    assert "rule 1" in got[0]["reason"] and got[3]["issue"] == "economy" and "no ask found" in got[5]["reason"]


def test_issue_vote(spark):
    got = run(spark, "border and illegal immigration and prices", "abortion and taxes", "please chip in today")
    assert got[0]["issue"] == "immigration"
    assert got[1]["issue"] == "abortion" and "tie with economy" in got[1]["reason"] and got[1]["confidence"] == "low"
    assert got[2]["issue"] == "other" and '"chip in"' in got[2]["reason"]


def test_leftmost_first_and_digits(spark):
    got = run(spark, "the cost of living", "give $5 now", "give $50 now", "we can’t trust him", "we can't trust him")
    assert '"cost"' in got[0]["reason"]
    assert [r["goal"] == "fundraising" for r in got[1:3]] == [True, False]
    assert got[3]["issue"] == "other" and got[4]["issue"] == "candidate_character"


def test_confidence_is_never_high(spark):
    assert {r["confidence"] for r in run(spark, "donate: prices prices prices", "x", "vote taxes taxes")} <= {"low", "medium"}


@pytest.mark.parametrize("glue", ["️", "‍", "​", "́", "‿", "⃣", "ⓥ", "é", "²", "Ⅷ", "७", "_", "x", " ", "-"])
def test_word_borders_match_python(spark, glue):
    samples = [f"{glue}vote now", f"go vote{glue} now", f"a {glue}vote{glue}"]
    rx = re.compile(r"\b(?:" + "|".join(rules.POLITICAL) + r")\b", re.IGNORECASE)
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = [r["n"] for r in rows.select("i", rules.count(F.col("t"), rules.POLITICAL).alias("n")).orderBy("i").collect()]
    assert got == [len(rx.findall(s)) for s in samples]


def test_prediction_records(spark):
    rows = rules.predictions(spark.createDataFrame([("1", "chip in")], "ad_id string, ad_text string")).collect()
    assert rows[0]["prompt_version"] == "rules-v1" and rows[0]["model"] == "keyword-baseline" and rows[0]["error"] is None


def python_rules(t):
    found = lambda *lexicons: [m.lower() for x in lexicons for m in re.findall(r"\b(?:" + "|".join(x) + r")\b", t, re.IGNORECASE)]
    short = lambda h: ", ".join(f'"{x}"' for x in list(dict.fromkeys(h))[:3])
    money, civic, offer, political = found(rules.MONEY_ASK), found(rules.VOTING_INFO, rules.CIVIC_ACTION), found(rules.NON_POLITICAL_OFFER), found(rules.POLITICAL)
    goal = "fundraising" if money else "mobilization" if civic else "other" if offer else "persuasion"
    why = f"money ask {short(money)} (rule 1)" if money else f"civic action {short(civic)} (rule 2)" if civic else f"product/lead-gen offer {short(offer)}" if offer else f"political, no ask {short(political)}" if political else "no ask found; default for political ads"
    topics = {k: found(rules.ISSUE_WORDS[k]) for k in rules.ISSUE_PRIORITY}
    top = max(map(len, topics.values()))
    ties = [k for k, h in topics.items() if len(h) == top]
    sure = bool(money or civic or offer or political) and top > 1 and len(ties) == 1
    about = f"{ties[0]} {short(topics[ties[0]])}" + (f" (tie with {', '.join(ties[1:])})" if len(ties) > 1 else "") if top else "no topic keywords"
    return goal, ties[0] if top else "other", "medium" if sure else "low", f"goal: {why}; issue: {about}"


def test_queries_read_whole_texts(spark, tmp_path):
    from tagloom.plans import queries
    from tagloom.plans import synthetic as syn

    ends = ["prices, rent and tariffs; Wages fell", "Donate now", "stream it now, use code X", "the sheriff and the police — crime", "register to vote", "café immigrants, asylum and deportation", "", None]
    docs = [(i, None if e is None else "filler words \n" * 2000 + e, "s") for i, e in enumerate(ends * 6)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {r["ad_id"]: python_rules(r["ad_text"]) for r in syn.items(spark, str(tmp_path)).collect()}
    from_phrases = {r["ad_id"]: python_rules(r["phrases"]) for r in syn.items(spark, str(tmp_path)).collect()}
    assert sum(want[i] != from_phrases[i] for i in want) > 20
    assert {r["ad_id"]: tuple(r[c] for c in ("goal", "issue", "confidence", "reason")) for r in queries.rules_reason(spark, str(tmp_path)).collect()} == want
    assert {r["ad_id"]: tuple(r[c] for c in ("goal", "issue", "confidence", "rationale")) for r in queries.rules_predictions(spark, str(tmp_path)).collect()} == want
    assigned = queries.blind_assign(spark, str(tmp_path)).collect()
    assert sum(r["label_mode"] == "blind" for r in assigned) == 40
    for r in assigned:
        w = want[r["ad_id"]]
        assert (r["suggested_goal"], r["suggested_issue"], r["suggestion_reason"]) == (("", "", "") if r["label_mode"] == "blind" else (w[0], w[1], w[3]))
    assert {r["ad_id"]: r["ad_text"] for r in queries._workflow(spark, str(tmp_path))[0].collect()} == {r["ad_id"]: r["ad_text"] for r in syn.items(spark, str(tmp_path)).collect()}


def test_plan_has_no_python(spark):
    df = rules.classify(spark.createDataFrame([("1", "x")], "ad_id string, ad_text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def python_normal(t):
    t = unicodedata.normalize("NFKC", t).replace("​", "")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in t.splitlines())).strip()


def test_normalize_text(spark):
    samples = ["\U0001d413\U0001d421\U0001d422\U0001d42c  \r\n\r\n\r\n\r\nx ", " a\t\n\n b​\n", "", "ﬁne\x0bprint", "one\n\n\ntwo\n\n", " edge "]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = [r["n"] for r in rows.select("i", text.normalize_text(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [python_normal(s) for s in samples]


def test_word_set_and_jaccard(spark):
    rows = spark.createDataFrame([("Café's $5 a", "cafs A"), ("", "!!"), ("a b c d", "a b c e")], "a string, b string")
    got = rows.select(F.sort_array(text.word_set(F.col("a"))).alias("w"), text.jaccard(text.word_set(F.col("a")), text.word_set(F.col("b"))).alias("j")).collect()
    assert got[0]["w"] == ["$5", "'s", "a", "caf"]
    assert [round(r["j"], 3) for r in got] == [0.2, 1.0, 0.6]
