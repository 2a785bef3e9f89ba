"""Keyword rules as column expressions: a goal cascade and an issue vote, no Python in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import short_list

PROMPT_VERSION, MODEL = "rules-v1", "keyword-baseline"  # fixed values

# The rule keywords. Each entry begins and ends with a word character.
MONEY_ASK = (
    r"chip(?:ping)? in", r"pitch in", r"donat(?:e|es|ed|ing|ion|ions)", r"contribut(?:e|ion|ions)",
    r"give (?:now|today|\$\d|anything|whatever|what you can|\d)", r"rush (?:a |\$|over a )?(?:donation|\d)",
    r"(?:make|send) (?:a |your )?(?:gift|donation|contribution)", r"gift of", r"founding donor",
    r"monthly (?:gift|donor|donation)", r"every dollar", r"fund(?:raising)? (?:goal|deadline)", r"matched", r"your gift",
)
VOTING_INFO = (
    r"register(?:ed)? to vote", r"voter registration", r"registration (?:is|deadline)", r"your registration",
    r"polling place", r"where to vote", r"early voting", r"absentee", r"mail ballot", r"request (?:a |your )?ballot",
    r"make a plan to vote", r"plan to vote", r"voting information", r"election day is",
)
CIVIC_ACTION = (
    r"sign (?:the |our |this )?petition", r"sign here", r"sign now", r"sign your name", r"add your name",
    r"pledge", r"volunteer", r"rsvp", r"join (?:us|our) (?:at|on)",
)
POLITICAL = (
    r"vote", r"voters?", r"elect(?:ed|ion)?", r"re-?elect", r"governor", r"congress(?:man|woman)?", r"senat(?:e|or)",
    r"assembly", r"state (?:house|rep\w*)", r"legislat\w+", r"mayor", r"judge", r"attorney general", r"district attorney",
    r"trump", r"democrat\w*", r"republican\w*", r"gop", r"maga", r"campaign", r"candidate", r"vetoe?d?s?",
    r"washington", r"politicians?", r"too extreme", r"radical\w*",
)
NON_POLITICAL_OFFER = (
    r"free (?:e-?book|pdf|review|quiz)", r"take the quiz", r"stream (?:it|now)", r"subscription", r"shop now",
    r"call us", r"book your appointment", r"schedule a\w*", r"click follow", r"sign up free", r"use code",
)
ISSUE_WORDS = {
    "economy": (
        r"inflation", r"prices?", r"costs?", r"cost of living", r"afford\w*", r"tax(?:es)?", r"wages?", r"jobs",
        r"grocer\w*", r"gas", r"rent", r"utilit(?:y|ies)", r"electric\w*", r"bills", r"tariffs?", r"econom\w+",
        r"budget", r"small business\w*", r"paychecks?", r"housing", r"rate hikes?",
    ),
    "healthcare": (
        r"health ?care", r"health insurance", r"insurance", r"medicare", r"medicaid", r"premiums",
        r"drug (?:companies|prices)", r"prescriptions?", r"coverage", r"hospitals?", r"aca", r"obamacare", r"social security",
    ),
    "abortion": (
        r"abortions?", r"roe", r"reproductive", r"pro-?life", r"pro-?choice", r"preborn", r"unborn",
        r"birth control", r"contracepti\w+", r"mifepristone", r"ivf", r"planned parenthood", r"save babies",
        r"life defender", r"women'?s (?:health|bodies|rights)", r"their bodies",
    ),
    "immigration": (
        r"borders?", r"illegal aliens?", r"illegal immigration", r"immigra\w+", r"migrants?", r"asylum",
        r"deport\w*", r"the wall", r"a wall", r"sanctuary", r"border patrol", r"refugees?",
    ),
    "democracy_voting": (
        r"democracy", r"voting rights", r"election (?:integrity|rigging)", r"rigging", r"supreme court",
        r"constitution\w*", r"ballot access", r"project 2025", r"power grab", r"first amendment",
        r"free speech", r"censorship", r"the courts?", r"justices?",
    ),
    "public_safety": (
        r"crime", r"criminals?", r"police", r"law enforcement", r"sheriff", r"prosecut\w+", r"violent",
        r"public safety", r"safer", r"keep \w+ (?:families |communities )?safe", r"guns?", r"fentanyl", r"cartels?",
        r"traffick\w+", r"murder", r"victims", r"back(?:ing)? the blue", r"exploitation", r"predators?",
    ),
    "candidate_character": (
        r"corrupt\w*", r"scandal", r"lies", r"liar", r"can'?t trust", r"cannot trust", r"too extreme",
        r"veteran", r"navy seal", r"outsider", r"grew up", r"generation", r"father of", r"mother of",
        r"his record", r"her record", r"honest\w*",
    ),
}
ISSUE_PRIORITY = ("abortion", "immigration", "public_safety", "healthcare", "democracy_voting", "economy", "candidate_character")


#: Letters beyond ASCII that match an ASCII letter whatever their case, and the sigma, whose lower case depends on its place.
ODD_LETTERS = "[\u017f\u0130\u0131\u03a3]"
WORD = r"\p{L}\p{N}_"


def first_letters(entry: str) -> str:
    """The letters that an entry can begin with; entries begin with a letter or with a group of plain alternatives."""
    starts = entry[3 : entry.index(")")].split("|") if entry.startswith("(?:") else (entry,)
    return "".join(sorted({x[0] for x in starts}))


def java_pattern(entries: tuple[str, ...], lowered: bool = False) -> str:
    """Whole-word match with Unicode letters, digits and underscore as word characters; Java's own \\b counts marks too.

    A look at the first letter comes before all else, so most places of a text cost one test; then come the entries that can
    begin with that letter, in their order. ``lowered`` is for texts in lower case, where letters are compared as they are.
    """
    java = [(first_letters(e), e.replace(r"\w", rf"[{WORD}]").replace(r"\d", r"\p{Nd}")) for e in entries]
    letters = sorted({x for first, _ in java for x in first})
    if lowered:
        by_letter = (f"(?={x})(?:" + "|".join(e for first, e in java if x in first) + ")" for x in letters)
        return rf"(?=[{''.join(letters)}])(?<![{WORD}])(?:{'|'.join(by_letter)})(?![{WORD}])"
    return rf"(?iu)(?=[{''.join(letters)}])(?<![{WORD}])(?:" + "|".join(e for _, e in java) + rf")(?![{WORD}])"


def lowered(text: Column) -> Column:
    """The text in lower case, which costs less to search; null where a search of it could find something else."""
    return F.when(~text.rlike(ODD_LETTERS), F.lower(text))


def hits(text: Column, *lexicons: tuple[str, ...], low: Column | None = None) -> Column:
    """All matches of each lexicon, lower case, in order, repeats kept. ``low`` is ``lowered(text)`` where it is at hand."""
    low = lowered(text) if low is None else low
    found = [F.when(low.isNotNull(), F.regexp_extract_all(low, F.lit(java_pattern(x, True)), F.lit(0))).otherwise(F.transform(F.regexp_extract_all(text, F.lit(java_pattern(x)), F.lit(0)), F.lower)) for x in lexicons]
    return found[0] if len(found) == 1 else F.concat(*found)


def count(text: Column, lexicon: tuple[str, ...], low: Column | None = None) -> Column:
    low = lowered(text) if low is None else low
    return F.when(low.isNotNull(), F.regexp_count(low, F.lit(java_pattern(lexicon, True)))).otherwise(F.regexp_count(text, F.lit(java_pattern(lexicon))))


def classify(items: DataFrame, text_col: str = "ad_text", reasons: bool = True) -> DataFrame:
    """Adds goal, issue, confidence and, if asked, reason.

    The goal is the first group with a hit: money ask, civic action, product offer, political; else persuasion. The issue
    is the topic with most hits, ties by priority. Confidence is the lower of the two; the issue never exceeds medium.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.col("_low")
    counted = items.withColumn("_low", lowered(text)).withColumns({f"_n_{k}": count(text, v, low) for k, v in ISSUE_WORDS.items()})
    groups = {"money": (MONEY_ASK,), "civic": (VOTING_INFO, CIVIC_ACTION), "offer": (NON_POLITICAL_OFFER,), "political": (POLITICAL,)}
    # the first group with a hit decides, so later ones are searched only where all before are empty
    before = F.lit(True)
    for k, v in groups.items():
        there = F.when(low.isNotNull(), low.rlike(java_pattern(sum(v, ()), True))).otherwise(text.rlike(java_pattern(sum(v, ()))))
        counted = counted.withColumn(f"_has_{k}", F.when(before, there).otherwise(False))
        before = before & ~F.col(f"_has_{k}")
    has = {k: F.col(f"_has_{k}") for k in groups}
    n = {k: F.col(f"_n_{k}") for k in ISSUE_PRIORITY}
    top = F.greatest(*n.values())
    ties = F.filter(F.array(*(F.when(n[k] == top, F.lit(k)) for k in ISSUE_PRIORITY)), lambda x: x.isNotNull())
    scored = counted.withColumns({"_top": top, "_ties": ties})
    goal = F.when(has["money"], "fundraising").when(has["civic"], "mobilization").when(has["offer"], "other").otherwise("persuasion")
    none = F.col("_top") == 0
    issue = F.when(none, "other").otherwise(F.element_at("_ties", 1))
    sure = (has["money"] | has["civic"] | has["offer"] | has["political"]) & (F.col("_top") > 1) & (F.size("_ties") == 1)
    out = {"goal": goal, "issue": issue, "confidence": F.when(sure, "medium").otherwise("low")}
    if reasons:
        shown = {k: short_list(hits(text, *v, low=low)) for k, v in groups.items()}
        why_goal = (
            F.when(has["money"], F.concat(F.lit("money ask "), shown["money"], F.lit(" (rule 1)")))
            .when(has["civic"], F.concat(F.lit("civic action "), shown["civic"], F.lit(" (rule 2)")))
            .when(has["offer"], F.concat(F.lit("product/lead-gen offer "), shown["offer"]))
            .when(has["political"], F.concat(F.lit("political, no ask "), shown["political"]))
            .otherwise("no ask found; default for political ads")
        )
        quoted = F.lit(None).cast("string")
        for k in reversed(ISSUE_PRIORITY):
            quoted = F.when(F.element_at("_ties", 1) == k, short_list(hits(text, ISSUE_WORDS[k], low=low))).otherwise(quoted)
        tie = F.when(F.size("_ties") > 1, F.concat(F.lit(" (tie with "), F.array_join(F.expr("slice(_ties, 2, size(_ties))"), ", "), F.lit(")"))).otherwise("")
        why_issue = F.when(none, "no topic keywords").otherwise(F.concat(F.element_at("_ties", 1), F.lit(" "), quoted, tie))
        out["reason"] = F.concat(F.lit("goal: "), why_goal, F.lit("; issue: "), why_issue)
    kept = [c for c in items.columns if c not in out]
    return scored.select(*kept, *(v.alias(k) for k, v in out.items()))


def predictions(items: DataFrame) -> DataFrame:
    """Rule labels as prediction records; ``seq`` is kept if the items have it."""
    seq = F.col("seq") if "seq" in items.columns else F.lit(0).cast("long")
    labelled = classify(items.select("ad_id", "ad_text", seq.alias("seq")))
    return labelled.select("ad_id", "goal", "issue", "confidence", F.col("reason").alias("rationale"), F.lit(PROMPT_VERSION).alias("prompt_version"), F.lit(MODEL).alias("model"), F.lit(None).cast("string").alias("error"), F.create_map().cast("map<string,bigint>").alias("usage"), "seq")
