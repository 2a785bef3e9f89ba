"""DuckDB SQL of the registered queries, written from the operators' definitions and not from their plans."""

from __future__ import annotations

import random

from ..functions import rules
from ..schema import CONFIDENCE_LEVELS, GOALS, ISSUES
from .queries import LINES
from .synthetic import FILES_SQL, ITEMS_SQL, LABELS_SQL, LOG_SQL, draw_sql, pick_sql

WITH_ITEMS = f"WITH {ITEMS_SQL}"
WITH_LOG = f"WITH {ITEMS_SQL}, {LOG_SQL}, {LABELS_SQL}, cells AS (SELECT run, field, gold, pred, count(*) AS n FROM aligned GROUP BY ALL)"

# RE2 knows only ASCII word borders, so letters and digits beyond ASCII become an underscore first.
PLAIN = r"regexp_replace({t}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\p{{M}}]', '_', 'g')"


def _found(t: str, entries: tuple[str, ...]) -> str:
    body = "|".join(entries).replace("'", "''")
    return rf"list_transform(regexp_extract_all({t}, '\b(?:{body})\b', 0, 'i'), lambda x: lower(x))"


def _short(h: str) -> str:
    return f"""array_to_string(list_transform(list_filter({h}, lambda x, i: list_position({h}, x) = i)[1:3], lambda x: '"' || x || '"'), ', ')"""


def _rules(source: str, column: str, plain: bool) -> str:
    """CTEs h (hits) and ruled (goal, issue, confidence, reason) over a relation."""
    t = PLAIN.format(t=column) if plain else column
    topics = ", ".join(f"{_found('t', w)} AS h_{k}" for k, w in rules.ISSUE_WORDS.items())
    n = {k: f"len(h_{k})" for k in rules.ISSUE_PRIORITY}
    ties = "list_filter([" + ", ".join(f"CASE WHEN {n[k]} = top THEN '{k}' END" for k in rules.ISSUE_PRIORITY) + "], lambda x: x IS NOT NULL)"
    quoted = "CASE ties[1] " + " ".join(f"WHEN '{k}' THEN {_short('h_' + k)}" for k in rules.ISSUE_PRIORITY) + " END"
    return f"""h AS (SELECT *, greatest({", ".join(n.values())}) AS top FROM (SELECT *, {_found("t", rules.MONEY_ASK)} AS money, list_concat({_found("t", rules.VOTING_INFO)}, {_found("t", rules.CIVIC_ACTION)}) AS civic, {_found("t", rules.NON_POLITICAL_OFFER)} AS offer, {_found("t", rules.POLITICAL)} AS political, {topics} FROM (SELECT *, {t} AS t FROM {source}))),
ruled AS (SELECT *, CASE WHEN len(money) > 0 THEN 'fundraising' WHEN len(civic) > 0 THEN 'mobilization' WHEN len(offer) > 0 THEN 'other' ELSE 'persuasion' END AS goal,
  CASE WHEN top = 0 THEN 'other' ELSE ties[1] END AS issue,
  CASE WHEN len(money) + len(civic) + len(offer) + len(political) > 0 AND top > 1 AND len(ties) = 1 THEN 'medium' ELSE 'low' END AS confidence,
  'goal: ' || CASE WHEN len(money) > 0 THEN 'money ask ' || {_short("money")} || ' (rule 1)' WHEN len(civic) > 0 THEN 'civic action ' || {_short("civic")} || ' (rule 2)' WHEN len(offer) > 0 THEN 'product/lead-gen offer ' || {_short("offer")} WHEN len(political) > 0 THEN 'political, no ask ' || {_short("political")} ELSE 'no ask found; default for political ads' END
  || '; issue: ' || CASE WHEN top = 0 THEN 'no topic keywords' ELSE ties[1] || ' ' || {quoted} || CASE WHEN len(ties) > 1 THEN ' (tie with ' || array_to_string(ties[2:], ', ') || ')' ELSE '' END END AS reason
  FROM (SELECT *, {ties} AS ties FROM h))"""


SETS = """sets AS (SELECT seq, CASE WHEN len(w) = 0 THEN [''] ELSE w END AS w FROM (SELECT seq, list_distinct(regexp_extract_all(lower(text), '[a-z0-9$'']+')) AS w FROM items)),
near AS (SELECT a.seq AS a, b.seq AS b FROM sets a JOIN sets b ON a.seq < b.seq AND 4 * least(len(a.w), len(b.w)) >= 3 * greatest(len(a.w), len(b.w))
  WHERE 4 * len(list_intersect(a.w, b.w)) >= 3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))"""

# One step for each card in order; what was accepted so far is carried in lists.
IMPORT = f"""WITH RECURSIVE {ITEMS_SQL},
old AS (SELECT *, {draw_sql("old", "ad_id")} % 20 = 0 AS held, {draw_sql("drop", "ad_id")} % 40 = 0 AS gone, CASE WHEN {draw_sql("nob", "ad_id")} % 50 = 0 THEN '' ELSE text END AS body FROM items),
ex AS (SELECT 'e' || seq AS k, text AS body FROM old WHERE held), cd AS (SELECT 'c' || seq AS k, body FROM old),
ws AS MATERIALIZED (SELECT k, unnest(w) AS word, len(w) AS n FROM (SELECT k, CASE WHEN len(w) = 0 THEN [''] ELSE w END AS w FROM (SELECT k, list_distinct(regexp_extract_all(lower(body), '[a-z0-9$'']+')) AS w FROM (FROM ex UNION ALL FROM cd)))),
tw AS MATERIALIZED (SELECT substr(a, 1, 1) AS side, substr(a, 2)::BIGINT AS a, substr(b, 2)::BIGINT AS b FROM (
  SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS o FROM ws a JOIN ws b ON a.word = b.word AND a.k <> b.k AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) WHERE b.k LIKE 'c%' GROUP BY ALL) WHERE 4 * o >= 3 * (na + nb - o)),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS i, seq, ad_id, page_name, held, gone, body, seq IN (SELECT b FROM tw WHERE side = 'e') AS twin, coalesce(p.had, 0) AS had, coalesce(t.nbr, []::BIGINT[]) AS nbr
  FROM old LEFT JOIN (SELECT page_name AS pn, count(*) AS had FROM old WHERE held GROUP BY page_name) p ON p.pn = page_name LEFT JOIN (SELECT b, list(a) AS nbr FROM tw WHERE side = 'c' AND a < b GROUP BY b) t ON t.b = seq),
s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS acc, []::VARCHAR[] AS pages UNION ALL
  SELECT c.i, CASE WHEN ok THEN list_append(acc, seq) ELSE acc END, CASE WHEN ok THEN list_append(pages, page_name) ELSE pages END
  FROM (SELECT c.*, s.acc, s.pages, NOT (held OR gone OR body = '' OR twin OR list_has_any(s.acc, nbr) OR had + len(list_filter(s.pages, lambda x: x = c.page_name)) >= 12) AS ok FROM s JOIN c ON c.i = s.i + 1) c),
f AS (SELECT arg_max(acc, i) AS acc FROM s),
decided AS (SELECT seq, ad_id AS library_id, page_name, body, list_contains(acc, seq) AS accepted, CASE WHEN list_contains(acc, seq) THEN '' WHEN held THEN 'already in gold file' WHEN gone THEN 'previously dropped (see dropped.csv)' WHEN body = '' THEN 'no body text (' || CASE WHEN page_name = '' THEN 'unknown page' ELSE page_name END || ')'
  WHEN twin OR list_has_any(acc, nbr) THEN 'duplicate text (' || page_name || ')' ELSE 'page cap of 12 reached (' || page_name || ')' END AS reason FROM c, f)"""

STOP = r"""(s = chr(8203) OR regexp_full_match(s, '\d{1,2}:\d{2}\s*/\s*\d{1,2}:\d{2}') OR regexp_full_match(s, '[A-Z0-9-]+(\.[A-Z0-9-]+)+') OR s = 'NOT AFFILIATED WITH META' OR starts_with(s, 'Impressions:') OR s = 'Active')"""
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _tidy(c: str) -> str:
    lines = rf"array_to_string(list_transform(string_split(replace({c}, chr(8203), ''), chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10))"
    return TRIM.format(rf"regexp_replace({lines}, '\n{{3,}}', chr(10) || chr(10), 'g')")


CARDS = f"""WITH {ITEMS_SQL}, {FILES_SQL}, ln AS (SELECT file, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM (SELECT file, string_split(raw, chr(10)) AS l FROM files)),
m AS (SELECT *, {TRIM.format("line")} AS s, lag({TRIM.format("line")}) OVER (PARTITION BY file ORDER BY no) AS before FROM ln),
c AS (SELECT *, sum(regexp_full_match(s, 'Library ID:\\s*\\d+')::INT) OVER (PARTITION BY file ORDER BY no) AS card_no FROM m),
p AS (SELECT file, card_no, min(no) FILTER (s LIKE 'Sponsored%Paid for by %') AS sp FROM c WHERE card_no > 0 GROUP BY ALL),
q AS (SELECT p.file, p.card_no, p.sp, min(no) FILTER (no > sp AND {STOP}) AS stop FROM p JOIN c USING (file, card_no) GROUP BY ALL)
SELECT file, card_no::INT AS card_no, max(regexp_extract(s, '^Library ID:\\s*(\\d+)', 1)) FILTER (s LIKE 'Library ID:%') AS library_id, coalesce(max(before) FILTER (no = sp), '') AS page_name,
  coalesce(max(regexp_extract(s, 'Paid for by\\s+(.+)$', 1)) FILTER (no = sp), '') AS paid_for, coalesce(arg_min(regexp_extract(s, '^Started running on (.+)$', 1), no) FILTER (s LIKE 'Started running on _%'), '') AS started_running,
  {_tidy("coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (no > sp AND (stop IS NULL OR no < stop)), '')")} AS ad_text
FROM q JOIN c USING (file, card_no) GROUP BY file, card_no""".replace("\\\\", "\\")

SHEET = f"""sheet AS (SELECT seq, ad_id, label_mode, true_goal, true_issue, CASE WHEN {draw_sql("sl", "ad_id")} % 8 = 0 THEN '' WHEN {draw_sql("sgoal", "ad_id")} % 6 = 0 THEN {pick_sql(GOALS, draw_sql("vgoal", "ad_id"))} ELSE true_goal END AS goal, CASE WHEN {draw_sql("sl", "ad_id")} % 8 = 0 THEN '' WHEN {draw_sql("sissue", "ad_id")} % 6 = 0 THEN {pick_sql(ISSUES, draw_sql("vissue", "ad_id"))} ELSE true_issue END AS issue,
  CASE WHEN label_mode = 'blind' THEN 'blind' WHEN {draw_sql("chk", "ad_id")} % 3 = 0 THEN '' ELSE 'yes' END AS checked FROM items),
done AS (SELECT *, label_mode = 'assisted' AND checked <> 'yes' AS blank, label_mode = 'assisted' AND checked = 'yes' AS yes FROM sheet)"""

PER_LABEL = """scores AS (SELECT run, field, ord, label, coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(g, 0), 0) AS recall, coalesce(2 * tp / nullif(p + g, 0), 0) AS f1, g AS support
  FROM (SELECT r.run, d.field, d.ord, d.label, coalesce(sum(n) FILTER (gold = label AND pred = label), 0) AS tp, coalesce(sum(n) FILTER (gold = label), 0) AS g, coalesce(sum(n) FILTER (pred = label), 0) AS p
    FROM runs r CROSS JOIN labels_dim d LEFT JOIN cells c ON c.run = r.run AND c.field = d.field GROUP BY ALL))"""

TODO = "SELECT i.ad_id FROM {src} i WHERE NOT EXISTS (SELECT 1 FROM preds p WHERE p.run = 'a' AND p.error IS NULL AND p.ad_id = i.ad_id)"


def _payload_error() -> str:
    def known(names):
        return ", ".join(f"'{x}'" for x in names)

    def part(c, names):
        return pick_sql((*names, "Bad"), draw_sql(f"p{c}", "ad_id"))

    bad = lambda c, names: f"WHEN {c} IS NULL OR {c} NOT IN ({known(names)}) THEN 'field ''{c}'' has invalid value ' || coalesce('''' || {c} || '''', 'None')"
    return f"""{WITH_ITEMS}, p AS (SELECT ad_id, {part("goal", GOALS)} AS goal, {part("issue", ISSUES)} AS issue, CASE WHEN {draw_sql("noc", "ad_id")} % 11 <> 0 THEN {part("conf", CONFIDENCE_LEVELS)} END AS confidence, CASE {draw_sql("why", "ad_id")} % 9 WHEN 0 THEN '' WHEN 1 THEN '' ELSE 'because' END AS rationale FROM items),
e AS (SELECT *, CASE {bad("goal", GOALS)} {bad("issue", ISSUES)} {bad("confidence", CONFIDENCE_LEVELS)} WHEN rationale = '' THEN 'field ''rationale'' is missing or empty' END AS error FROM p)
SELECT ad_id, {", ".join(f"CASE WHEN error IS NULL THEN {c} ELSE '' END AS {c}" for c in ("goal", "issue", "confidence", "rationale"))}, error FROM e"""


SUGGESTED = "SELECT r.ad_id, CASE WHEN b.ad_id IS NULL THEN 'assisted' ELSE 'blind' END AS label_mode, CASE WHEN b.ad_id IS NULL THEN goal ELSE '' END AS suggested_goal, CASE WHEN b.ad_id IS NULL THEN issue ELSE '' END AS suggested_issue, CASE WHEN b.ad_id IS NULL THEN reason ELSE '' END AS suggestion_reason FROM ruled r LEFT JOIN b ON b.ad_id = r.ad_id"
#: Python's draws of 40 ranks, as lists, for the sizes of the test tables.
DRAWS = " ".join(f"WHEN {n} THEN {sorted(random.Random(2026).sample(range(n), 40))}" for n in (200, 1000, 10_000, 51_282, 256_410))


def oracle_sql() -> dict[str, str]:
    v = {k: draw_sql(k, "ad_id") for k in ("v1", "v2", "v3", "v4", "v5")}
    named = {"money": rules.MONEY_ASK, "voting": rules.VOTING_INFO, "civic": rules.CIVIC_ACTION, "political": rules.POLITICAL, "offer": rules.NON_POLITICAL_OFFER, **rules.ISSUE_WORDS}
    goals, issues = (", ".join(f"'{x}'" for x in names) for names in (GOALS, ISSUES))
    whole = _rules("items", "ad_text", True)
    accuracy = "count(*) AS n_gold, round(avg((gold = pred)::INT), 9) AS accuracy"
    return {
        "eval_align": f"{WITH_LOG} SELECT run, field, ad_id, gold, pred FROM aligned",
        "eval_accuracy": f"{WITH_LOG} SELECT run, field, {accuracy} FROM aligned GROUP BY ALL",
        "eval_counts": f"{WITH_LOG} SELECT r.run, count(*) AS n_gold, count(*) FILTER (p.ad_id IS NOT NULL AND p.error IS NULL) AS n_scored_ok, count(*) - count(*) FILTER (p.ad_id IS NOT NULL AND p.error IS NULL) AS n_errors, coalesce(sum(tin), 0)::BIGINT AS tokens_in, coalesce(sum(tout), 0)::BIGINT AS tokens_out FROM gold g CROSS JOIN runs r LEFT JOIN preds p ON p.run = r.run AND p.ad_id = g.ad_id GROUP BY ALL",
        "eval_confusion": f"{WITH_LOG} SELECT r.run, g.field, g.label AS gold, p.label AS pred, coalesce(max(n), 0)::BIGINT AS n FROM runs r CROSS JOIN labels_err g JOIN labels_err p ON p.field = g.field LEFT JOIN cells c ON c.run = r.run AND c.field = g.field AND c.gold = g.label AND c.pred = p.label GROUP BY ALL",
        "eval_per_label": f"{WITH_LOG}, {PER_LABEL} SELECT run, field, label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM scores",
        "eval_macro_f1": f"{WITH_LOG}, {PER_LABEL} SELECT run, field, round(coalesce(avg(f1) FILTER (support > 0), 0), 9) AS macro_f1 FROM scores GROUP BY ALL",
        "eval_kappa": f"""{WITH_LOG}, o AS (SELECT run, field, avg((gold = pred)::INT) AS po, count(*) AS n FROM aligned GROUP BY ALL), g AS (SELECT run, field, gold AS label, count(*) AS g FROM aligned GROUP BY ALL), p AS (SELECT run, field, pred AS label, count(*) AS p FROM aligned GROUP BY ALL),
e AS (SELECT g.run, g.field, sum(g.g * p.p)::DOUBLE AS gp FROM g JOIN p USING (run, field, label) GROUP BY ALL) SELECT run, field, round(CASE WHEN gp / (n * n) = 1 THEN (po = 1)::INT ELSE (po - gp / (n * n)) / (1 - gp / (n * n)) END, 9) AS kappa FROM o JOIN e USING (run, field)""",
        "eval_disagreements": f"{WITH_LOG} SELECT g.ad_id, g.goal || ' / ' || g.issue AS gold, CASE WHEN p.ad_id IS NULL OR p.error IS NOT NULL THEN '(error)' ELSE p.goal || ' / ' || p.issue END AS model, CASE WHEN p.ad_id IS NULL OR p.error IS NOT NULL THEN '' ELSE p.confidence END AS confidence, CASE WHEN p.ad_id IS NULL THEN 'no prediction' WHEN p.error IS NOT NULL THEN p.error ELSE p.rationale END AS rationale FROM gold g LEFT JOIN (SELECT * FROM preds WHERE run = 'a') p ON p.ad_id = g.ad_id WHERE p.ad_id IS NULL OR p.error IS NOT NULL OR p.goal <> g.goal OR p.issue <> g.issue",
        "eval_off_taxonomy": f"{WITH_LOG} SELECT run, field, ad_id, gold, 'Fundraising' AS pred FROM aligned WHERE field = 'goal' AND pred <> '(error)' AND {draw_sql('odd', 'ad_id')} % 20 = 0",
        "eval_subset_accuracy": f"{WITH_LOG} SELECT s.subset, run, field, {accuracy} FROM aligned JOIN (VALUES ('all'), ('blind'), ('assisted')) AS s(subset) ON s.subset = 'all' OR s.subset = label_mode GROUP BY ALL",
        "anchoring_gap": f"{WITH_ITEMS}, {whole} SELECT f.field, round(avg(ok) FILTER (label_mode = 'blind'), 9) AS blind, round(avg(ok) FILTER (label_mode = 'assisted'), 9) AS assisted, round(avg(ok) FILTER (label_mode = 'assisted') - avg(ok) FILTER (label_mode = 'blind'), 9) AS gap FROM (SELECT label_mode, unnest([{{'field': 'goal', 'ok': (goal = gold_goal)::INT}}, {{'field': 'issue', 'ok': (issue = gold_issue)::INT}}], recursive := true) FROM ruled WHERE labelled) f GROUP BY ALL",
        "compare_mcnemar": f"""{WITH_LOG}, s AS (SELECT field, ad_id, bool_or(run = 'a' AND gold = pred) AS a, bool_or(run = 'b' AND gold = pred) AS b FROM aligned GROUP BY ALL), t AS (SELECT field, round(avg(a::INT), 9) AS accuracy_a, round(avg(b::INT), 9) AS accuracy_b, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only FROM s GROUP BY ALL)
SELECT t.*, round(CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2))) FROM range(0, least(a_only, b_only) + 1) AS r(i))) END, 9) AS p_value FROM t""",
        "bootstrap_ci": f"""{WITH_LOG}, k AS (SELECT run, field, (gold = pred)::INT AS ok, row_number() OVER (PARTITION BY run, field ORDER BY ad_id) - 1 AS rank FROM aligned), z AS (SELECT run, field, count(*) AS n FROM k GROUP BY ALL),
d AS (SELECT run, field, n, b, unnest(range(0, n)) AS i FROM z, range(0, 200) AS r(b)), e AS (SELECT run, field, b, (('0x' || substr(md5('0:' || b || ':' || i), 1, 8))::BIGINT) % n AS rank FROM d), m AS (SELECT run, field, b, avg(ok) AS mean FROM e JOIN k USING (run, field, rank) GROUP BY ALL)
SELECT run, field, round(list_sort(list(mean))[6], 9) AS ci_lo, round(list_sort(list(mean))[196], 9) AS ci_hi FROM m GROUP BY ALL""",
        "preds_last_write_wins": f"{WITH_LOG} SELECT run, ad_id, goal, issue, confidence, error, seq::BIGINT AS seq FROM preds",
        "classify_resume_todo": f"{WITH_LOG} {TODO.format(src='items')}",
        "classify_limit": f"{WITH_LOG} {TODO.format(src='(SELECT * FROM items ORDER BY seq LIMIT 100)')}",
        "annotate_validate": _payload_error(),
        "rules_labels": f"{WITH_ITEMS}, {whole} SELECT ad_id, goal, issue, confidence FROM ruled",
        "rules_reason": f"{WITH_ITEMS}, {whole} SELECT ad_id, goal, issue, confidence, reason FROM ruled",
        "rules_hits": f"{WITH_ITEMS} SELECT ad_id, {', '.join(f'len({_found("t", w)})::BIGINT AS {k}' for k, w in named.items())} FROM (SELECT ad_id, {PLAIN.format(t='ad_text')} AS t FROM items)",
        "rules_label_counts": f"{WITH_ITEMS}, {whole} SELECT goal, issue, confidence, count(*) AS n FROM ruled GROUP BY ALL",
        "rules_predictions": f"{WITH_ITEMS}, {whole} SELECT ad_id, goal, issue, confidence, reason AS rationale, 'rules-v1' AS prompt_version, 'keyword-baseline' AS model, NULL::VARCHAR AS error, seq FROM ruled",
        "word_sets": f"{WITH_ITEMS} SELECT ad_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(ad_text), '[a-z0-9$'']+'))), ' ') AS words FROM items",
        "near_dup_pairs": f"{WITH_ITEMS}, {SETS} SELECT a AS id_a, b AS id_b FROM near",
        "near_dup_earlier": f"{WITH_ITEMS}, {SETS} SELECT b AS seq, min(a) AS first FROM near GROUP BY b",
        "import_decisions": f"{IMPORT} SELECT seq, library_id, accepted, reason FROM decided",
        "import_skip_summary": f"{IMPORT} SELECT CASE WHEN accepted THEN 'added' WHEN reason LIKE 'already%' THEN 'known id' WHEN reason LIKE 'prev%' THEN 'dropped id' WHEN reason LIKE 'no body%' THEN 'no body' WHEN reason LIKE 'dup%' THEN 'duplicate' ELSE 'page cap' END AS outcome, count(*) AS n FROM decided GROUP BY ALL",
        "import_new_rows": f"{IMPORT} SELECT seq, library_id AS ad_id, page_name, body AS ad_text, 'https://www.facebook.com/ads/library/?id=' || library_id AS source_url, '' AS gold_goal, 'term' AS search_term FROM decided WHERE accepted",
        "page_counts": f"{WITH_ITEMS} SELECT page_name, count(*) AS n FROM items GROUP BY ALL",
        "parse_cards": CARDS,
        "terminators": f"{WITH_ITEMS}, l AS (SELECT ad_id, unnest(list_append(string_split(text, chr(10)), {pick_sql(LINES, draw_sql('line', 'ad_id'))})) AS line FROM items) SELECT ad_id, line, {STOP} AS stop FROM (SELECT *, {TRIM.format('line')} AS s FROM l)",
        "normalize_text": f"{WITH_ITEMS} SELECT ad_id, {_tidy('c')} AS body FROM (SELECT ad_id, '  ' || chr(10) || page_name || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || text || chr(8203) || ' ' || chr(10) || phrases || chr(10) || chr(10) AS c FROM items)",
        "row_heights": f"{WITH_ITEMS} SELECT ad_id, greatest(30, least(409, 15 * list_sum(list_transform(string_split(text, chr(10)), lambda x: greatest(1, ceil(length(x) / 85))))))::INT AS height FROM items",
        "blind_assign": f"{WITH_ITEMS}, {whole}, b AS (SELECT ad_id FROM items ORDER BY md5('2026:' || ad_id), ad_id LIMIT 40) {SUGGESTED}",
        "blind_assign_exact": f"{WITH_ITEMS}, {whole}, o AS (SELECT ad_id, row_number() OVER (ORDER BY ad_id) - 1 AS rank, count(*) OVER () AS n FROM items), b AS (SELECT ad_id FROM o WHERE list_contains(CASE n {DRAWS} END, rank)) {SUGGESTED}",
        "assist_counts": f"{WITH_ITEMS} SELECT count(*) AS ads, count(*) FILTER (label_mode = 'blind') AS blind, count(*) FILTER (label_mode = 'assisted') AS assisted FROM items",
        "workbook_rows": f"{WITH_ITEMS} SELECT seq + 1 AS row_no, ad_id, CASE WHEN gold_goal <> '' THEN gold_goal WHEN label_mode = 'blind' THEN '' ELSE true_goal END AS gold_goal, CASE WHEN gold_issue <> '' THEN gold_issue WHEN label_mode = 'blind' THEN '' ELSE true_issue END AS gold_issue, CASE WHEN label_mode = 'blind' THEN 'blind' ELSE '' END AS checked, CASE WHEN label_mode = 'assisted' THEN 'why ' || ad_id WHEN {draw_sql('rechk', 'ad_id')} % 7 = 0 THEN 'look again ' || ad_id ELSE 'BLIND: label from scratch' END AS why_suggested FROM items",
        "import_labels_rows": f"{WITH_ITEMS}, {SHEET} SELECT ad_id, CASE WHEN blank THEN '' ELSE goal END AS gold_goal, CASE WHEN blank THEN '' ELSE issue END AS gold_issue, 'note ' || ad_id AS notes, blank AND (goal <> '' OR issue <> '') AS unchecked, yes AS checked, yes AND goal <> true_goal AS goal_override, yes AND issue <> true_issue AS issue_override FROM done",
        "import_labels_stats": f"{WITH_ITEMS}, {SHEET} SELECT count(*) AS ads, count(*) FILTER (NOT blank AND goal <> '' AND issue <> '') AS labeled, count(*) FILTER (label_mode = 'blind' AND goal <> '' AND issue <> '') AS blind_labeled, count(*) FILTER (blank AND (goal <> '' OR issue <> '')) AS unchecked_assisted, count(*) FILTER (yes AND goal <> true_goal) AS goal_overrides, count(*) FILTER (yes AND issue <> true_issue) AS issue_overrides, count(*) FILTER (yes) AS checked_assisted FROM done",
        "override_rates": f"{WITH_ITEMS}, {SHEET} SELECT count(*) FILTER (yes) AS checked_assisted, round(count(*) FILTER (yes AND goal <> true_goal) / count(*) FILTER (yes), 9) AS goal_rate, round(count(*) FILTER (yes AND issue <> true_issue) / count(*) FILTER (yes), 9) AS issue_rate FROM done",
        "workbook_progress": f"{WITH_ITEMS}, {SHEET} SELECT count(*) FILTER (checked = 'yes') AS checked, count(*) FILTER (checked = 'blind' AND goal <> '' AND issue <> '') AS blind_done, count(*) - count(*) FILTER (checked = 'yes') - count(*) FILTER (checked = 'blind' AND goal <> '' AND issue <> '') AS remaining FROM done",
        "label_final_counts": f"{WITH_ITEMS}, {SHEET}, {LABELS_SQL} SELECT d.field, d.label, count(s.ad_id) AS n FROM labels_dim d LEFT JOIN done s ON s.checked IN ('yes', 'blind') AND d.label = CASE d.field WHEN 'goal' THEN s.goal ELSE s.issue END GROUP BY ALL",
        "validate_gold": f"""{WITH_ITEMS}, f AS (SELECT seq, CASE WHEN {v["v1"]} % 97 = 0 THEN '' WHEN {v["v2"]} % 53 = 0 THEN (seq - 1)::VARCHAR ELSE ad_id END AS ad_id, CASE WHEN {v["v3"]} % 61 = 0 THEN '' ELSE {TRIM.format("text")} END AS body, CASE WHEN {v["v4"]} % 71 = 0 THEN '' WHEN {v["v5"]} % 67 = 0 THEN 'Fundraising' ELSE gold_goal END AS goal, gold_issue AS issue FROM items), g AS (SELECT *, row_number() OVER (PARTITION BY ad_id ORDER BY seq) > 1 AS again FROM f)
SELECT seq, 1 AS rank, 'empty ad_id' AS message FROM g WHERE ad_id = '' UNION ALL SELECT seq, 2, 'duplicate ad_id ''' || ad_id || '''' FROM g WHERE ad_id <> '' AND again UNION ALL SELECT seq, 3, 'empty ad_text for ''' || ad_id || '''' FROM g WHERE body = ''
UNION ALL SELECT seq, 4, ad_id || ' has a ' || CASE WHEN goal <> '' THEN 'goal label but no issue' ELSE 'issue label but no goal' END FROM g WHERE (goal = '') <> (issue = '') UNION ALL SELECT seq, 5, 'unknown goal label ''' || goal || '''' FROM g WHERE goal <> '' AND issue <> '' AND goal NOT IN ({goals}) UNION ALL SELECT seq, 6, 'unknown issue label ''' || issue || '''' FROM g WHERE goal <> '' AND issue <> '' AND issue NOT IN ({issues})""",
        "id_set_diff": f"{WITH_ITEMS}, l AS (SELECT ad_id FROM items WHERE {draw_sql('il', 'ad_id')} % 30 <> 0), r AS (SELECT ad_id FROM items WHERE {draw_sql('ir', 'ad_id')} % 30 <> 0) SELECT array_to_string(list_sort((SELECT list(ad_id) FROM (SELECT ad_id FROM l WHERE ad_id NOT IN (FROM r)))) [1:5], ',') AS only_left, array_to_string(list_sort((SELECT list(ad_id) FROM (SELECT ad_id FROM r WHERE ad_id NOT IN (FROM l)))) [1:5], ',') AS only_right",
        "gold_file": f"{WITH_ITEMS} SELECT ad_id, {TRIM.format('page_name')} AS page_name, {TRIM.format('ad_text')} AS ad_text, gold_goal, gold_issue, 'a \"quoted\", note ' || ad_id AS notes, label_mode, '' AS source_url FROM items",
        "gold_file_labels": f"{WITH_ITEMS} SELECT ad_id, goal, issue FROM gold",
        "prediction_file": f"{WITH_LOG} SELECT ad_id, goal, issue, confidence, rationale, 'v2' AS prompt_version, 'm' AS model, error, coalesce(tin, 0)::BIGINT AS tokens_in FROM preds WHERE run = 'a'",
        "prediction_file_failures": f"{WITH_LOG} SELECT (SELECT count(*) FROM log WHERE run = 'b' AND error IS NOT NULL) AS failed, count(*) AS items, count(*) FILTER (error IS NULL) AS good FROM preds WHERE run = 'b'",
        "dropped_file": f"{WITH_ITEMS} SELECT ad_id, page_name, 'off topic, ' || ad_id AS reason, ad_text FROM items WHERE {draw_sql('drop', 'ad_id')} % 40 = 0",
        "sheet_file": f"{WITH_ITEMS} SELECT seq + 1 AS row_no, ad_id, CASE WHEN gold_goal <> '' THEN gold_goal WHEN label_mode = 'blind' THEN '' ELSE true_goal END AS gold_goal, CASE WHEN gold_issue <> '' THEN gold_issue WHEN label_mode = 'blind' THEN '' ELSE true_issue END AS gold_issue, 'a \"quoted\", note ' || ad_id AS notes, CASE WHEN label_mode = 'blind' THEN 'blind' ELSE '' END AS checked, CASE WHEN label_mode = 'assisted' THEN 'why ' || ad_id WHEN {draw_sql('rechk', 'ad_id')} % 7 = 0 THEN 'BLIND. RECHECK: codebook updated (rule ' || ad_id || ', new)' ELSE 'BLIND: label from scratch' END AS why_suggested FROM items",
        "paste_files": f"SELECT row_number() OVER (ORDER BY {draw_sql('pf', 'file')} % 8, file::BIGINT, card_no) - 1 AS seq, library_id, page_name, paid_for, started_running, ad_text FROM ({CARDS})",
        "drop_item": f"{WITH_ITEMS} SELECT page_name, count(*) AS n FROM items WHERE ad_id <> '7' GROUP BY ALL",
    }
