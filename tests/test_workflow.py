import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagloom import cli
from tagloom.operators import annotate, labeling, neardup, paste
from tagloom.operators import evaluate as ev
from tagloom.schema import ALL_COLUMNS, GOLD_COLUMNS, PREDICTION
from tagloom.sources import tables as tb


def page(number, name, body, ends="0:00 / 0:27"):
    return f"Library ID: {number}\nStarted running on May 12, 2026\nActive\n{name}\nSponsored • Paid for by Committee\n{body}\n{ends}\nheadline\n"


BODY = "We need your help before the deadline.\n\nPlease stand with our campaign this week."
PASTE = (
    "intro\n"
    + page("111", "Example Page", BODY, "SECURE.EXAMPLE.COM")
    + page("222", "Video Page", "SECURE.EXAMPLE.COM")
    + page("333", "Example Page", BODY)
    + page("444", "Other Page", "\U0001d413\U0001d421\U0001d422\U0001d42c is a quite different text about roads and bridges")
    + page("555", "Example Page", "A third body that talks of schools, teachers and class sizes", "NOT AFFILIATED WITH META")
)


def cards_of(spark, raw):
    files = spark.createDataFrame([("f", raw)], "file string, raw string")
    return paste.parse(paste.lines(files)).withColumn("seq", (F.col("card_no") - 1).cast("long"))


def empty(spark):
    return spark.createDataFrame([], "ad_id string, page_name string, ad_text string")


def decisions(spark, raw, cap=4, limit=0, existing=None, dropped=None):
    found = neardup.decide(cards_of(spark, raw), existing if existing is not None else empty(spark), dropped if dropped is not None else empty(spark), cap, limit)
    return {r["library_id"]: (r["accepted"], r["reason"]) for r in found.collect()}


def test_cards(spark):
    got = {r["library_id"]: r for r in cards_of(spark, PASTE).collect()}
    assert list(sorted(got)) == ["111", "222", "333", "444", "555"]
    assert got["111"]["ad_text"] == BODY and got["111"]["page_name"] == "Example Page" and got["111"]["paid_for"] == "Committee"
    assert got["111"]["started_running"] == "May 12, 2026" and got["222"]["ad_text"] == ""
    assert got["444"]["ad_text"].startswith("This is")


def test_cards_without_sponsor_and_crlf(spark):
    raw = "Library ID: 9\r\nStarted running on x\r\nLibrary ID: 10\r\nP\r\nSponsored • Paid for by Q\r\nbody  \r\n​\r\nnot body\r\n"
    got = {r["library_id"]: r for r in cards_of(spark, raw).collect()}
    assert (got["9"]["page_name"], got["9"]["ad_text"], got["9"]["started_running"]) == ("", "", "x")
    assert (got["10"]["page_name"], got["10"]["ad_text"]) == ("P", "body")


def test_terminator_needs_a_bare_domain(spark):
    rows = spark.createDataFrame([(x,) for x in ("GO.EXAMPLE.ORG/PATH", "GO.EXAMPLE.ORG", " Active ", "Actively", "Impressions: 5K", "​", "1:23 / 4:56")], "line string")
    got = [r["s"] for r in rows.select(paste.is_terminator(F.col("line")).alias("s")).collect()]
    assert got == [False, True, True, False, True, True, True]


def test_import_reasons(spark):
    got = decisions(spark, PASTE, cap=1)
    assert [k for k, v in got.items() if v[0]] == ["111", "444"] or {k for k, v in got.items() if v[0]} == {"111", "444"}
    assert got["222"][1] == "no body text (Video Page)" and got["333"][1] == "duplicate text (Example Page)" and got["555"][1] == "page cap of 1 reached (Example Page)"
    assert {k for k, v in decisions(spark, PASTE).items() if v[0]} == {"111", "444", "555"}


def test_import_limit(spark):
    got = decisions(spark, PASTE, limit=1)
    assert [k for k, v in got.items() if v[0]] == ["111"]
    assert all(v[1] == "batch limit of 1 reached" for k, v in got.items() if k != "111")


def test_known_and_dropped(spark):
    existing = spark.createDataFrame([("111", "Example Page", BODY)], "ad_id string, page_name string, ad_text string")
    dropped = spark.createDataFrame([("444",)], "ad_id string")
    got = decisions(spark, PASTE, existing=existing, dropped=dropped)
    assert got["111"][1] == "already in gold file" and got["444"][1].startswith("previously dropped") and got["333"][1].startswith("duplicate")


def greedy(cards, cap):
    """Brute force: one card after the other."""
    out, taken, pages = {}, [], {}
    for seq, number, name, words in cards:
        if any(number == n for _, n, _ in taken):
            out[seq] = "already"
        elif not words:
            out[seq] = "no body"
        elif any(len(words & w) * 4 >= 3 * len(words | w) for _, _, w in taken):
            out[seq] = "duplicate"
        elif pages.get(name, 0) >= cap:
            out[seq] = "page cap"
        else:
            out[seq] = ""
            taken.append((seq, number, words))
            pages[name] = pages.get(name, 0) + 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_decisions_match_one_by_one(spark, seed):
    import random

    rng = random.Random(seed)
    cards = []
    for seq in range(70):
        words = {f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 9))}
        cards.append((seq, str(rng.randrange(60)), f"p{rng.randrange(5)}", words))
    rows = spark.createDataFrame([(s, n, p, " ".join(sorted(w))) for s, n, p, w in cards], "seq long, library_id string, page_name string, ad_text string")
    got = {r["seq"]: r["reason"] for r in neardup.decide(rows, empty(spark), empty(spark), 4).collect()}
    want = greedy(cards, 4)
    assert all(got[s].startswith(want[s]) and bool(got[s]) == bool(want[s]) for s in want)


def test_pairs_match_all_pairs(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 14))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if not (sets[i] | sets[j]) or (len(sets[i] & sets[j]) * 4 >= 3 * len(sets[i] | sets[j]) and sets[i] and sets[j])}
    assert {tuple(r) for r in neardup.pairs(rows, "id", "t").collect()} == want
    twins = {r["id"]: r["first"] for r in neardup.earlier_twin(rows, "id", "t").collect()}
    assert twins == {j: min(i for i, k in want if k == j) for j in {k for _, k in want}}


def write_gold(path, rows, columns=GOLD_COLUMNS):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.DictWriter(f, fieldnames=list(columns))
        w.writeheader()
        w.writerows({c: r.get(c, "") for c in columns} for r in rows)


ROWS = [
    {"ad_id": "001", "ad_text": "first\n\ntext, \"quoted\"", "gold_goal": "persuasion", "gold_issue": "economy"},
    {"ad_id": "002", "ad_text": "second", "gold_goal": "mobilization", "gold_issue": "other"},
    {"ad_id": "003", "ad_text": "third", "gold_goal": "fundraising", "gold_issue": "healthcare"},
    {"ad_id": "004", "ad_text": "fourth"},
]


def test_gold_reader(spark, tmp_path):
    write_gold(tmp_path / "g.csv", ROWS)
    items = tb.read_gold(spark, str(tmp_path / "g.csv"))
    assert items.count() == 4 and tb.labels_of(items).count() == 3
    first = items.orderBy("seq").first()
    assert first["ad_id"] == "001" and first["ad_text"] == 'first\n\ntext, "quoted"' and first["label_mode"] == ""


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ({"ad_id": "002"}, ":3: duplicate ad_id '002'"),
        ({"gold_goal": "Fundraising"}, ":2: unknown goal label"),
        ({"gold_issue": ""}, ":2: 001 has a goal label but no issue"),
        ({"ad_text": "  "}, ":2: empty ad_text for '001'"),
        ({"ad_id": " "}, ":2: empty ad_id"),
    ],
)
def test_gold_reader_rejects(spark, tmp_path, change, message):
    write_gold(tmp_path / "g.csv", [{**ROWS[0], **change}, *ROWS[1:]])
    with pytest.raises(tb.TableError, match=message):
        tb.read_gold(spark, str(tmp_path / "g.csv"))


def test_missing_columns(spark, tmp_path):
    write_gold(tmp_path / "g.csv", ROWS, ("ad_id", "ad_text"))
    with pytest.raises(tb.TableError, match="missing columns"):
        tb.read_gold(spark, str(tmp_path / "g.csv"))


def test_missing_and_empty_files(spark, tmp_path):
    assert tb.read_rows(spark, str(tmp_path / "no.csv")).count() == 0
    assert tb.read_predictions(spark, str(tmp_path / "no.jsonl")).count() == 0


def test_prediction_log(spark, tmp_path):
    path = str(tmp_path / "p.jsonl")
    row = {"ad_id": "1", "goal": "", "issue": "", "confidence": "", "rationale": "", "prompt_version": "v", "model": "m", "error": "boom", "usage": {}}
    with open(path, "w") as f:
        f.write(json.dumps(row) + "\n\n" + json.dumps({**row, "goal": "other", "issue": "other", "error": None, "usage": {"input_tokens": 3}}) + "\n")
    got = tb.read_predictions(spark, path).collect()
    assert len(got) == 1 and got[0]["error"] is None and got[0]["usage"] == {"input_tokens": 3}
    with open(path, "a") as f:
        f.write("no json\n")
    with pytest.raises(tb.TableError):
        tb.read_predictions(spark, path)


@pytest.mark.parametrize("change", [{"goal": None}, {"extra": 1}, {"ad_id": None}, {"model": None}])
def test_prediction_records_are_strict(spark, tmp_path, change):
    path = str(tmp_path / "p.jsonl")
    good = {"ad_id": "1", "goal": "other", "issue": "other", "confidence": "low", "rationale": "r", "prompt_version": "v", "model": "m"}
    bad = {**good, **{k: v for k, v in change.items() if v is not None}}
    for k in (k for k, v in change.items() if v is None):
        del bad[k]
    Path(path).write_text(json.dumps(good) + "\n")
    assert tb.read_predictions(spark, path).count() == 1  # error and usage may be absent
    Path(path).write_text(json.dumps(good) + "\n" + json.dumps(bad) + "\n")
    with pytest.raises(tb.TableError, match="record 2"):
        tb.read_predictions(spark, path)


def test_files_of_one_process_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tb, "MOST_FILE_ROWS", 5)
    with pytest.raises(tb.TableError, match="too many"):
        tb.write_gold(workflow_items(spark, 6), str(tmp_path / "g.csv"))
    assert not (tmp_path / "g.csv").exists()


def test_several_pasted_files_are_numbered_together(spark, tmp_path):
    raw, gold = tmp_path / "raw", str(tmp_path / "gold.csv")
    raw.mkdir()
    (raw / "a.txt").write_text(PASTE, encoding="utf-8")
    (raw / "b.txt").write_text(PASTE.replace("Library ID: ", "Library ID: 9"), encoding="utf-8")
    cards = paste.numbered(paste.parse(tb.read_pastes(spark, str(raw)))).orderBy("seq").collect()
    assert [r["seq"] for r in cards] == list(range(10)) and [r["library_id"] for r in cards] == ["111", "222", "333", "444", "555", "9111", "9222", "9333", "9444", "9555"]
    assert cli.main(["import-library", "--raw", str(raw), "--search", "s", "--gold", gold]) == 0
    assert [r["ad_id"] for r in csv.DictReader(open(gold, encoding="utf-8"))] == ["111", "444", "555"]


def test_sheet_command(spark, tmp_path):
    gold, out = str(tmp_path / "gold.csv"), str(tmp_path / "sheet.csv")
    tb.write_gold(workflow_items(spark, 8), gold)
    with pytest.raises(tb.TableError, match="label_mode"):
        cli.main(["make-sheet", "--gold", gold, "--out", out])
    assert cli.main(["assist", "--gold", gold, "--blind", "8", "--seed", "1"]) == 0
    (tmp_path / "recheck.csv").write_text('ad_id,reason\n003,"rule 4, new"\n')
    assert cli.main(["make-sheet", "--gold", gold, "--recheck", str(tmp_path / "recheck.csv"), "--out", out]) == 0
    rows = {r["ad_id"]: r for r in csv.DictReader(open(out, encoding="utf-8-sig"))}
    assert len(rows) == 8 and rows["003"]["why_suggested"] == "BLIND. RECHECK: codebook updated (rule 4, new)" and rows["004"]["why_suggested"] == labeling.BLIND_NOTE
    assert tb.read_recheck(spark, str(tmp_path / "none.csv")).count() == 0


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from tagloom.lineage import settle

    made = []
    context = lambda master: SimpleNamespace(getCheckpointDir=lambda: None, master=master, setCheckpointDir=made.append)
    frame = lambda master, folder: SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context(master), conf=SimpleNamespace(get=lambda k, d: folder)), checkpoint=lambda eager: "done")
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            settle(frame(master, None))
    assert settle(frame("yarn", "hdfs:///shared")) == "done" and made == ["hdfs:///shared"] and settle(frame("local[4]", None)) == "done"


def workflow_items(spark, n=60):
    blank = {c: "" for c in ALL_COLUMNS}
    rows = [{**blank, "ad_id": f"{i:03d}", "ad_text": "chip in" if i % 2 else "vote", "page_name": "p"} for i in range(n)]
    return spark.createDataFrame([tuple(r[c] for c in ALL_COLUMNS) + (i,) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in ALL_COLUMNS) + ", seq long")


def test_blind_draw_is_seeded_and_fixed(spark):
    import random

    items = workflow_items(spark)
    one = labeling.assign(items, 10, 7).cache()
    blind = {r["ad_id"] for r in one.where("label_mode = 'blind'").collect()}
    assert blind == set(random.Random(7).sample([f"{i:03d}" for i in range(60)], 10))
    again = labeling.assign(one, 5, 99)
    assert {r["ad_id"] for r in again.where("label_mode = 'blind'").collect()} == blind
    assert one.where("(label_mode = 'blind') <> (suggested_goal = '')").count() == 0
    with pytest.raises(tb.TableError, match="exceeds"):
        labeling.assign(items, 61)


def test_new_items_become_assisted(spark):
    old = labeling.assign(workflow_items(spark, 20), 5, 1)
    fresh = workflow_items(spark, 25).where("seq >= 20")
    both = labeling.assign(old.unionByName(fresh), 5, 1)
    assert both.where("seq >= 20 and label_mode = 'assisted'").count() == 5 and both.where("label_mode = 'blind'").count() == 5


def test_labels_return(spark):
    items = labeling.assign(workflow_items(spark, 3), 1, 1)
    modes = {r["ad_id"]: r["label_mode"] for r in items.collect()}
    blind = next(i for i, m in modes.items() if m == "blind")
    checked, unchecked = (i for i, m in modes.items() if m == "assisted")
    suggestion = {r["ad_id"]: r["suggested_issue"] for r in items.collect()}
    rows = [(blind, "other", "other", "", "", 0), (checked, "mobilization", suggestion[checked], "n", " YES ", 1), (unchecked, "other", "other", "kept", "", 2)]
    sheet = spark.createDataFrame(rows, "ad_id string, gold_goal string, gold_issue string, notes string, checked string, seq long")
    done = labeling.returned(items, sheet)
    s = labeling.return_stats(done).first().asDict()
    assert s == {"ads": 3, "labeled": 2, "blind_labeled": 1, "unchecked_assisted": 1, "goal_overrides": 1, "issue_overrides": 0, "checked_assisted": 1}
    assert {r["ad_id"] for r in tb.labels_of(done).collect()} == {blind, checked}
    assert done.where(F.col("ad_id") == unchecked).first()["notes"] == "kept"
    with pytest.raises(tb.TableError, match="only in sheet"):
        labeling.same_ids(items.where(F.col("ad_id") != blind), sheet)


class Fake:
    """A client that answers from a list."""

    def __init__(self, *answers):
        self.answers, self.calls, self.messages = list(answers), [], self

    def create(self, **request):
        self.calls.append(request)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


class Thing:
    def __init__(self, **k):
        self.__dict__.update(k)


def answer(kind="tool_use", **change):
    payload = {"goal": "other", "issue": "economy", "confidence": "high", "rationale": " ok "} | change
    return Thing(content=[Thing(type=kind, name=annotate.TOOL_NAME, input={k: v for k, v in payload.items() if v is not None})], usage=Thing(input_tokens=9, output_tokens=None))


def test_annotator_accepts():
    client = Fake(answer())
    got = annotate.Annotator(client).label("1", " text ")
    assert (got["goal"], got["issue"], got["rationale"], got["error"]) == ("other", "economy", "ok", None) and got["usage"] == {"input_tokens": 9, "output_tokens": 0}
    request = client.calls[0]
    assert request["temperature"] == 0 and request["max_tokens"] == 400 and request["tool_choice"] == {"type": "tool", "name": annotate.TOOL_NAME}
    assert "<ad>\ntext\n</ad>" in request["messages"][0]["content"]
    assert request["tools"][0]["input_schema"]["properties"]["goal"]["enum"] == list(annotate.GOALS)


@pytest.mark.parametrize("bad", [answer(issue="sports"), answer("text"), answer(rationale="  "), answer(confidence=None)])
def test_invalid_answers_are_not_tried_again(bad):
    client = Fake(bad, answer())
    got = annotate.Annotator(client).label("1", "t")
    assert got["error"] and got["goal"] == "" and len(client.calls) == 1 and got["usage"]["input_tokens"] == 9


def test_retries():
    naps = []
    client = Fake(OSError("x"), answer())
    assert annotate.Annotator(client, sleep=naps.append).label("1", "t")["error"] is None and naps == [2.0]
    naps.clear()
    client = Fake(*[OSError("x")] * 3)
    assert "after 3 attempts" in annotate.Annotator(client, sleep=naps.append).label("1", "t")["error"] and naps == [2.0, 4.0]


def test_annotate_in_tasks(spark):
    def factory():
        from types import SimpleNamespace as N

        payload = {"goal": "other", "issue": "economy", "confidence": "high", "rationale": "ok"}
        response = N(content=[N(type="tool_use", name="record_classification", input=payload)], usage=None)
        return N(messages=N(create=lambda **request: response))

    items = spark.createDataFrame([(str(i), "t", i) for i in range(9)], "ad_id string, ad_text string, seq long")
    got = annotate.annotate(items, factory, parallel=3)
    assert got.where("error is null and goal = 'other'").count() == 9
    done = got.where("seq < 4")
    assert {r["ad_id"] for r in annotate.todo(items, done, 6).collect()} == {"4", "5"}


def test_prompts():
    assert "tool" in annotate.load_prompt("v1") and "fundraising" in annotate.load_prompt("v2")
    with pytest.raises(ValueError):
        annotate.load_prompt("v9")


def test_command_line(spark, tmp_path, capsys):
    gold, raw, preds = (str(tmp_path / x) for x in ("gold.csv", "raw.txt", "preds.jsonl"))
    (tmp_path / "raw.txt").write_text(PASTE, encoding="utf-8")
    assert cli.main(["import-library", "--raw", raw, "--search", "s", "--gold", gold]) == 0
    assert "Added 3 items" in capsys.readouterr().out
    assert cli.main(["import-library", "--raw", raw, "--search", "s", "--gold", gold]) == 0
    assert "Added 0 items" in capsys.readouterr().out
    assert cli.main(["drop-ad", "--id", "444", "--reason", "off topic", "--gold", gold]) == 0
    assert cli.main(["import-library", "--raw", raw, "--search", "s", "--gold", gold]) == 0
    assert "previously dropped" in capsys.readouterr().out
    assert cli.main(["assist", "--gold", gold, "--blind", "1", "--seed", "1"]) == 0
    items = tb.read_gold(spark, gold)
    tb.write_sheet(labeling.sheet(items), str(tmp_path / "sheet.csv"))
    rows = list(csv.DictReader(open(tmp_path / "sheet.csv", encoding="utf-8-sig")))
    for r in rows:
        r.update(gold_goal="other", gold_issue="other", checked="yes", ad_text="edited")
    with open(tmp_path / "sheet.csv", "w", newline="", encoding="utf-8-sig") as f:
        w = csv.DictWriter(f, fieldnames=list(rows[0]))
        w.writeheader()
        w.writerows(rows)
    assert cli.main(["import-labels", "--xlsx", str(tmp_path / "sheet.csv"), "--gold", gold]) == 0
    items = tb.read_gold(spark, gold)
    assert tb.labels_of(items).count() == 2 and items.where("ad_text = 'edited'").count() == 0
    assert cli.main(["evaluate", "--gold", gold, "--preds", preds]) == 2
    assert cli.main(["baseline", "--gold", gold, "--out", preds]) == 0
    out = str(tmp_path / "r" / "report.md")
    assert cli.main(["evaluate", "--gold", gold, "--preds", preds, "--report", out]) == 0
    assert "# Evaluation: preds" in open(out).read()
    assert cli.main(["compare", "--gold", gold, "--preds-a", preds, "--preds-b", preds, "--subset", "blind"]) == 0
    assert "McNemar" in capsys.readouterr().out
    bad = [{**r, "gold_goal": "Wrong"} for r in rows]
    with open(tmp_path / "sheet.csv", "w", newline="", encoding="utf-8-sig") as f:
        w = csv.DictWriter(f, fieldnames=list(rows[0]))
        w.writeheader()
        w.writerows(bad)
    before = open(gold).read()
    with pytest.raises(tb.TableError):
        cli.main(["import-labels", "--xlsx", str(tmp_path / "sheet.csv"), "--gold", gold])
    assert open(gold).read() == before


def test_classify_needs_a_key(monkeypatch, tmp_path):
    monkeypatch.delenv("ANTHROPIC_API_KEY", raising=False)
    assert cli.main(["classify", "--gold", "x", "--out", str(tmp_path / "o")]) == 2


def test_streaming_labels(spark, tmp_path):
    from tagloom.streaming import tail

    src, dst, chk = (str(tmp_path / x) for x in ("src", "dst", "chk"))
    make = lambda rows: spark.createDataFrame(rows, "ad_id string, ad_text string, at string").select("ad_id", "ad_text", F.to_timestamp("at").alias("arrived")).write.mode("append").parquet(src)
    make([("1", "chip in", "2026-01-01 00:00:00"), ("2", "vote", "2026-01-01 00:10:00")])
    tail.label_new(spark, src, dst, chk).awaitTermination()
    make([("1", "chip in", "2026-01-01 00:20:00"), ("3", "sign here", "2026-01-01 01:10:00")])
    tail.label_new(spark, src, dst, chk).awaitTermination()
    got = {r["ad_id"]: r["goal"] for r in spark.read.parquet(dst).collect()}
    assert got == {"1": "fundraising", "2": "persuasion", "3": "mobilization"}
    counts = tail.label_counts(spark.read.parquet(src)).collect()
    assert sum(r["n"] for r in counts) == 4
    log, table, chk2 = (str(tmp_path / x) for x in ("log", "table", "chk2"))
    tb.append_prediction_log(spark.createDataFrame([("1", "", "", "", "", "v", "m", "boom", {}, 0), ("1", "other", "other", "low", "r", "v", "m", None, {}, 1)], PREDICTION), log)
    tail.newest_predictions(spark, log, table, chk2, PREDICTION).awaitTermination()
    assert [r["goal"] for r in tail.read_newest(spark, table, PREDICTION).collect()] == ["other"]
    for goal in ("persuasion", "fundraising", "mobilization"):
        tb.append_prediction_log(spark.createDataFrame([("2", goal, "other", "low", "r", "v", "m", None, {}, 5 + len(goal))], PREDICTION), log)
        tail.newest_predictions(spark, log, table, chk2, PREDICTION).awaitTermination()
    assert sorted((r["ad_id"], r["goal"]) for r in tail.read_newest(spark, table, PREDICTION).collect()) == [("1", "other"), ("2", "mobilization")]
    folders = sorted(str(p.relative_to(table)) for p in Path(table).glob("batch=*/part=*"))
    assert len(folders) == 3  # the part of the first item, and the last two of the second's
    assert ev.last_write_wins(spark.read.schema(PREDICTION).json(log)).count() == 2
