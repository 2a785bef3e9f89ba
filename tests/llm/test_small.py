"""The operators against brute force on small tables, and their defined results at the edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import bagminhash, common, decontam, langid, lattice, licenses, links, mixing, paradedup, pii, pivots, quotes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Odd rows: null and empty texts, blanks, marks only, repeats, null ids.
ODD = [(900, None), (901, ""), (902, "  \n\t "), (903, "!!! ???"), (904, "one"), (904, "one"), (905, "x" * 5000), (None, "null id text of five words"), (906, "é ü"), (907, "\n\n\n")]


def docs_of(spark, texts, lang="en", source="s", extra=False):
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"id": F.lit("clash"), "cid": F.lit(1), "size": F.lit(2), "found": F.lit("x"), "word": F.lit("w")}) if extra else df


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
PIECES = ["a@b.c", "a@b.c_d@e.f", "@", "a@@b.co", "x.y+z@q-r.st.uv", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "01.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 9 0 ", "12345", " ", "\n", "é", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789 ", "-", ".", "_"]


def brute_spans(t):
    out = []
    for k, (name, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, t):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else True, "card": 14 <= len(digits) <= 19 and sum(int(c) for i, d in enumerate(reversed(digits)) for c in str(int(d) * (1 + i % 2))) % 10 == 0, "phone": 10 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_expressions():
    rng = random.Random(5)
    for _ in range(4000):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 9)))
        assert sorted(pii.base_spans(t)) == brute_spans(t), t


def test_pii_is_linear_on_runs():
    for t in ("a" * 200_000, "1" * 200_000, "a." * 100_000 + "@", "+1" + "(" * 200_000, "1." * 100_000):
        pii.base_spans(t)


def test_pii_digest(spark):
    texts = [(1, "mail a@b.co or +1 555 123 4567"), (2, "IBAN GB82 WEST 1234 5698 7654 32, social security 123-45-6789"), *ODD]
    rows = pii.digest(pii.find(docs_of(spark, texts, extra=True))).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) and (got[1]["n_email"], got[1]["n_phone"]) == (1, 1)
    assert got[1]["spans"] == "email:5:11,phone:15:30" and got[1]["base_sha256"] == hashlib.sha256(got[1]["spans"].encode()).hexdigest()
    assert (got[2]["n_iban"], got[2]["n_ssn"]) == (1, 1) and got[2]["base_sha256"] == hashlib.sha256(",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in brute_spans(texts[1][1])).encode()).hexdigest()
    assert got[900]["spans"] == "" and got[900]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(docs_of(spark, [])).count() == 0


def brute_added(t):
    """Added spans by trying every start and every length, without expressions."""
    word = lambda c: c.isascii() and c.isalnum()
    digit = lambda c: c in "0123456789" and c != ""
    upper = lambda s: all("A" <= c <= "Z" or digit(c) for c in s)
    free = lambda i, ok: not (0 <= i < len(t) and ok(t[i]))
    out, at = [], 0
    while at < len(t):
        end = None
        if free(at - 1, word) and len(t) >= at + 4 and all("A" <= c <= "Z" for c in t[at : at + 2]) and all(map(digit, t[at + 2 : at + 4])):
            stops, p = [], at + 4
            for _ in range(7):
                q = p + (t[p : p + 1] == " ")
                if len(t[q : q + 4]) < 4 or not upper(t[q : q + 4]):
                    break
                p = q + 4
                stops.append(p)
            for s in reversed(stops[1:]):
                tails = [(s + b + k) for b in ((1, 0) if t[s : s + 1] == " " else (0,)) for k in (3, 2, 1) if len(t[s + b : s + b + k]) == k and upper(t[s + b : s + b + k])]
                end = next((e for e in (*tails, s) if free(e, word)), None)
                if end:
                    break
        if end:
            if pii.mod97(t[at:end]):
                out.append((at, 4, end))
            at = end
        else:
            at += 1
    dash = lambda c: digit(c) or c == "-"
    for i in range(len(t) - 10):
        s = t[i : i + 11]
        if free(i - 1, dash) and free(i + 11, dash) and s[3] == s[6] == "-" and all(map(digit, s[:3] + s[4:6] + s[7:])) and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000":
            out.append((i, 5, i + 11))
    part = lambda c: word(c) or c in "_/+-"
    i = 0
    while i < len(t):
        j = i
        while j < len(t) and part(t[j]):
            j += 1
        if j - i >= 20:
            e = j + (t[j : j + 1] == "=") + (t[j : j + 2] == "==")
            if len(set(t[i:e])) >= 8 and any(map(digit, t[i:e])) and any(c.isalpha() for c in t[i:e]):
                out.append((i, 6, e))
        i = max(j, i + 1)
    return sorted(x for x in out if pii.score(t, pii.KINDS[x[1]], x[0], x[2]) >= pii.MIN_SCORE)


def test_added_spans_equal_brute_force():
    rng = random.Random(6)
    parts = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 33", "FR76 3000 6000 0112 3456 7890 189", "ssn 123-45-6789", "social 666-12-1234", "security: 123-00-1234", "-", "1", " ", "account ", "A", "token=6df57b16f87eabefefcab67b433efd90636bb6bd", "key aaaaaaaaaaaaaaaaaaaaaaaa1", "api AbC123/+xyzQWE987_tok==", "6df57b16f87eabefefcab67b433efd90636bb6bd", " and some more words that keep things well apart from one another ", "example ", "sample"]
    found = 0
    for _ in range(4000):
        t = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 7)))
        want = brute_added(t)
        found += len(want)
        assert sorted(pii.added_spans(t)) == want, t
    assert found > 1000
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 31")


def test_context_moves_the_score():
    at = lambda t, s: (t.index(s), t.index(s) + len(s))
    for kind, plain, hinted in (("phone", "see +1 555 123 4567", "phone +1 555 123 4567"), ("ssn", "no 123-45-6789", "ssn 123-45-6789")):
        s = plain[plain.index("+") :] if kind == "phone" else "123-45-6789"
        assert pii.score(hinted, kind, *at(hinted, s)) == pytest.approx(pii.score(plain, kind, *at(plain, s)) + 0.3)
        assert pii.score("test " + plain, kind, *at("test " + plain, s)) == pytest.approx(max(0, pii.score(plain, kind, *at(plain, s)) - 0.3))


def test_redaction(spark):
    df = docs_of(spark, [(1, "to a@b.co, 1.2.3.4!"), (2, None), (3, "clean")], extra=True)
    got = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert got[1]["text"] == "to [EMAIL], [IP]!" and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] is None and got[3]["text"] == "clean"
    assert pii.redact(df).columns == df.columns


# --- licenses


def test_license_base_equals_brute_force(spark):
    rng = random.Random(7)
    parts = ["MIT", "license", "LICENSE.", "cc", "by", "apache-license", "gnu general", "public", "license", "é", "x", "\n", "cc by cc by", "gnu_general(public)license"]
    texts = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 15)))) for i in range(300)] + ODD
    got = licenses.digest(licenses.find(docs_of(spark, texts, extra=True))).collect()
    assert len(got) == len(texts)
    want = Counter()
    for i, t in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        want[i, len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places}))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got if r["base_labels"])


def test_license_notices_equal_brute_force():
    """A notice is reported exactly where the text has it within its budget of edits; its span holds such a place."""
    rng = random.Random(17)
    scanner = licenses.Scanner()
    found = 0
    for _ in range(250):
        label, notice = rng.choice(licenses.NOTICES)
        text = list(notice)
        for _ in range(rng.randrange(0, int(len(notice) * licenses.ERROR_RATE) + 4)):
            k = rng.randrange(len(text))
            text[k : k + 1] = rng.choice([[], ["z"], [text[k], "q"]])
        body = prose(rng, rng.randrange(0, 12), 30) + " " + "".join(text).replace(" ", rng.choice([" ", ", ", "\n"])) + " " + prose(rng, rng.randrange(0, 12), 30)
        norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", body.lower())) + " "
        want = {n for n, (_, t) in enumerate(licenses.NOTICES) if lowest_edits(t, norm) <= int(len(t) * licenses.ERROR_RATE)}
        got = scanner.fuzzy(norm)
        assert {n for *_, n in got} == want, body
        for start, end, edits, n in got:
            t = licenses.NOTICES[n][1]
            assert edits <= int(len(t) * licenses.ERROR_RATE) and whole_edits(t, norm[start:end]) == edits
        found += len(want)
        labels = set(scanner.scan(body)["labels"])
        assert {licenses.NOTICES[n][0] for n in want} <= labels
    assert found > 100


def whole_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_license_notice_with_errors(spark):
    text = "Intro. Permision is herebby granted, free of charge to any prson. More " + "the words of it " * 50
    r = licenses.digest(licenses.find(docs_of(spark, [(1, text), (2, "permission to land was granted to any person of the crew")]))).orderBy("doc_id").collect()
    assert r[0]["labels"] == "mit" and r[0]["n_base"] == 0 and 0.8 < r[0]["score"] < 1
    label, start, end, edits = r[0]["notices"].split(":")
    assert label == "mit" and 1 <= int(edits) <= 5 and text[int(start) : int(end)].startswith("Permision") and r[1]["labels"] == ""


# --- decontamination


def lowest_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randrange(5, 25), 50)) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (53, "w1 w2")]
    texts = []
    for i in range(60):
        body = prose(rng, 40, 50)
        if i % 2:
            item = list(rng.choice(items[:12])[1])
            for _ in range(rng.randrange(0, 9)):
                k = rng.randrange(len(item))
                item[k : k + 1] = rng.choice(["", "Z", item[k] + "q"])
            body += " " + "".join(item).upper().replace(" ", " \n") + " " + prose(rng, 20, 50)
        texts.append((i, body))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts + ODD, extra=True)
    got = {(r["doc"], r["item"]): r["edits"] for r in decontam.find(docs, bench).collect()}
    want, short = {}, {}
    for d, t in texts + ODD:
        for i, s in items:
            a, b = decontam.normalise(s), decontam.normalise(t)
            if len(a) >= decontam.MIN_CHARS and (e := lowest_edits(a, b)) <= int(len(a) * decontam.ERROR_RATE):
                want[d, i] = e
            elif 0 < len(a) < decontam.MIN_CHARS and f" {a} " in f" {b} ":
                short[d, i] = 0
    assert got == want | short and len(want) > 10 and short
    assert {(r["doc"], r["item"]) for r in decontam.find(docs, bench, block_chars=300).collect()} == set(want | short)
    assert decontam.clean(docs, bench, short=True).count() == docs.count() - sum(d in {k[0] for k in want | short} for d, _ in texts + ODD)
    small = bench.withColumn("item_id", F.col("item_id").cast("smallint"))
    assert {(r["doc"], r["item"]) for r in decontam.find(docs, small).collect()} == set(want | short)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in texts + ODD if d not in {k[0] for k in want})
    assert decontam.clean(docs, bench.limit(0)).count() == docs.count() and decontam.find(docs.limit(0), bench).count() == 0


# --- language identification


def test_language_filter_returns_all_languages():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    f = langid.Filter(["a", "b", "c"], {"a": h[:1000], "b": h[500:1500], "c": h[2000:2001]})
    m = f.masks(h)[0]
    assert (m[:1000] & 1).all() and (m[500:1500] & 2).all() and m[2000] & 4
    assert np.count_nonzero(m[1500:2000]) < 10


def brute_languages(rows, texts, n_grams):
    """Counts of exact n-gram sets in plain Python: (language, score, coverage) of each text."""

    def grams(t):
        framed = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        return [framed[i : i + n] for n in langid.ORDERS for i in range(len(framed) - n + 1) if " " not in framed[i + 1 : i + n - 1]]

    counts = defaultdict(Counter)
    for t, lang in rows:
        counts[lang].update(set(grams(t)))
    known = {lang: {g for g, _ in sorted(c.items(), key=lambda x: -x[1])[:n_grams]} for lang, c in counts.items()}
    out = []
    for t in texts:
        own = grams(t)
        hits = {lang: sum(g in known[lang] for g in own) for lang in sorted(known)}
        best = max(hits, key=lambda x: (hits[x], [-ord(c) for c in x]))
        every = sum(hits.values())
        out.append((best if any(c.isalpha() for c in t) else "und", hits[best] / every if every else 0.0, hits[best] / len(own) if own else 0.0))
    return out


def test_predictions_equal_exact_sets(spark):
    rng = random.Random(13)
    stems = {"de": ["schau", "heit", "und", "ung", "öhe"], "en": ["the", "thing", "other", "house"], "fr": ["eaux", "tion", "leur", "mais", "été"]}
    text = lambda x, n: " ".join(rng.choice(stems[x]) + rng.choice(["", "s", rng.choice(stems[x])]) for _ in range(n))
    rows = [(i, text(x, rng.randrange(3, 60)), x, "s", 0) for i in range(150) for x in [rng.choice(list(stems))]]
    model = langid.learn(spark.createDataFrame(rows, DOCS), n_grams=10**6)
    texts = [text(x, n) for x in stems for n in (1, 2, 5, 40)] + [text("de", 5) + " " + text("en", 9), "zzz qqq", "12 !", "", "the " * 60_000 + "und", "x" * 200_000]
    got, want = model.predict(texts), brute_languages([(r[1], r[2]) for r in rows], texts, 10**6)
    for t, g, w in zip(texts, got, want, strict=True):
        assert g[0] == w[0] or w[2] == 0, t[:50]
        assert abs(g[1] - w[1]) < 0.03 or w[2] < 0.01, (t[:50], g, w)
        assert abs(g[2] - w[2]) < 0.01
    # ties go to the first language by code point
    tied = langid.Filter(["a", "b"], {x: langid.grams(["same"])[0] for x in "ab"})
    assert tied.predict(["same same"])[0][:2] == ("a", pytest.approx(0.5, abs=1e-3))


def test_folds_by_checksum(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id")).withColumn("held", langid.held_out()).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows) and 60 < sum(r["held"] for r in rows) < 140


def test_many_languages_use_several_planes():
    rng = np.random.default_rng(2)
    names = [f"l{i:03d}" for i in range(70)]
    learned = {n: rng.integers(0, 2**63, 50, dtype=np.uint64) for n in names}
    f = langid.Filter(names, learned)
    assert len(f.planes) == 2 and all((f.masks(learned[n])[i // 64] >> np.uint64(i % 64) & np.uint64(1)).all() for i, n in enumerate(names))


def test_language_id(spark):
    rng = random.Random(3)
    stems = {"en": ["the", "thing", "other", "house"], "fr": ["eaux", "tion", "leur", "mais"], "gr": ["αλφα", "βητα", "γαμα"]}
    rows = [(i, " ".join(rng.choice(stems[x]) for _ in range(rng.randrange(3, 60))), x, "s", 0) for i in range(120) for x in [rng.choice(list(stems))]]
    docs = spark.createDataFrame(rows + [(i, t, None, "s", 0) for i, t in ODD], DOCS)
    model = langid.learn(docs.where(~langid.held_out()))
    got = langid.predict(docs.withColumn("coverage", F.lit(9)), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == docs.count() and sum(by[r[0]]["lang_pred"] == r[2] for r in rows) >= 119
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903, 907)] == ["und"] * 5 and by[904]["lang_pred"] != "und"
    assert langid.predict(docs, langid.learn(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    kept = langid.keep(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {r[0] for r in rows} and kept.where("doc_id in (900, 901, 903)").count() == 0


# --- mixing


def brute_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, total, fixed = set(order), float(sum(sizes.values())), {}
    while left:
        unit = total / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * unit > cap * sizes[s]}
        if not over:
            fixed |= {s: weight[s] * unit for s in left}
            break
        fixed |= {s: float(cap * sizes[s]) for s in over}
        total -= sum(cap * sizes[s] for s in over)
        left -= over
    return fixed


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        s = rng.choice(["a", "b", "c", "é", "Z", None, "hot", "hot", "hot"])
        rows.append((i, None if i % 50 == 0 else prose(rng, 7 if s == "hot" and i % 2 else int(rng.expovariate(1 / 60))), "en", s, 0))
    rows += [(501, "tiny", "en", "small", 0), (502, None, "en", "void", 0), (503, "", "en", "void", 0), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("x"), "h": F.lit("y"), "part": F.lit("z")})
    got = mixing.digest(mixing.copies(docs)).collect()
    again = mixing.digest(mixing.copies(docs.repartition(7))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = brute_targets(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9)
    sizes_of = defaultdict(list)
    for r in got:
        sizes_of[source[r["doc_id"]]].append((r["size"], r["rate"]))
    for s, t in want.items():
        words = [z for z, _ in sizes_of[s] if z]
        assert abs(taken[s] - t) < (max(words, default=1) + 1 if len(words) < 30 else max(min(words), 1e-3 * t)), (s, taken[s], t)
        # the rates are the balance's: an exponential tilt of the size, cut at three, that meets the target
        if words and t < 3 * sum(words) * (1 - 1e-9):
            mean = sum(words) / len(sizes_of[s])
            lo, hi = -4096.0, 4096.0
            for _ in range(200):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(z * min(3.0, math.exp(min(60.0, mid * z / mean))) for z in words) < t else (lo, mid)
            assert all(r == pytest.approx(min(3.0, math.exp(min(60.0, lo * z / mean))), rel=1e-4) for z, r in sizes_of[s] if z)


def test_mixing_without_balance_is_an_error(spark):
    docs = docs_of(spark, [(i, prose(random.Random(i), 5 + 40 * (i % 7)), ) for i in range(60)]).withColumn("source", F.when(F.col("doc_id") % 5 == 0, "a").otherwise("b"))
    with pytest.raises(RuntimeError, match="no balance"):
        mixing.copies(docs, steps=1).count()


def test_mixing_empty_and_native(spark):
    docs = docs_of(spark, [])
    assert mixing.copies(docs).count() == 0
    plan = mixing.copies(docs_of(spark, [(1, "a b"), (2, "c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- quotation linking


def test_quotes(spark):
    rows = [
        (1, 0, "user", "hello there\nhow are you"),
        (1, 1, "assistant", "> Hello   there\nfine\n"),
        (1, 2, "user", "> fine\n>> hello there\ngood"),
        (1, 3, "assistant", ">> hello there\ndeep"),
        (1, 4, "user", "unrelated"),
        (1, 5, "user", "> never said\nsure"),
        (2, 0, "user", "> hello there\nother conversation"),
        (None, 0, "user", "> x\ny"),
        (3, None, None, "z"),
        (4, 0, "user", None),
        (4, 1, "user", ">\n> \n"),
        (5, 0, "u", "line a"),
        (5, 0, "u", "line b"),
        (5, 1, "u", "> line b\nyes"),
        (6, 0, "u", "> later\nx"),
        (6, 1, "u", "later"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"parent": F.lit("clash"), "lines": F.lit(0)})
    got = quotes.link(df).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"], r["body"]): r for r in got}
    at = lambda c, t, b: tuple(by[c, t, b][k] for k in ("parent_turn", "thread_turn", "depth", "n_quoted", "n_linked"))
    assert at(1, 1, "fine") == (0, 0, 1, 1, 1) and at(1, 2, "good") == (1, 0, 2, 2, 2) and at(1, 3, "deep") == (0, 0, 1, 1, 1)
    assert at(1, 4, "unrelated") == (None, 4, 0, 0, 0) and at(1, 5, "sure") == (None, 5, 0, 1, 0) and at(2, 0, "other conversation") == (None, 0, 0, 1, 0)
    assert at(None, 0, "y")[0] is None and at(3, None, "z")[1] is None and at(4, 0, "")[3] == 0 and at(4, 1, "") == (None, 1, 0, 2, 0)
    assert at(5, 1, "yes") == (0, 0, 1, 1, 1) and at(6, 0, "x") == (None, 0, 0, 1, 0)
    assert by[3, None, "z"]["formatted"] == "<|unknown|>\nz"
    assert quotes.link(df.limit(0)).count() == 0


def test_long_reply_chain_in_one_conversation(spark):
    n = 1300
    rows = [(1, i, "u", (f"> text number {i - 1}\n" if i else "") + f"text number {i}") for i in range(n)]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r["depth"] == r["turn"] and r["thread_turn"] == 0 for r in got)


# --- embeddings


def test_pivot_index_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])
        rows.append((i, [float(np.float32(x)) for x in v], 0))
    rows += [(500 + i, rows[7][1], 0) for i in range(40)] + [(600, None, 0), (601, [], 0), (602, [0.0] * 16, 0), (603, [float("nan")] * 16, 0), (604, [1.0, None], 0), (605, [1.0, 2.0], 0), (606, [2.0, 4.0], 0), (607, [float("inf")] * 16, 0), (5, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"cid": F.lit("x"), "n": F.lit(1)})
    good = [(i, pivots.vector(v)) for i, v, _ in rows]
    cos = lambda a, b: float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))
    n, parent = Counter(), list(range(len(good)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(good):
        for j in range(i):
            b = good[j][1]
            if a is not None and b is not None and len(a) == len(b) and cos(a, b) >= 0.95:
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (v, _) in enumerate(good):
        least[root(i)] = min(v, least.get(root(i), v))
    want = Counter((good[i][0], n[i], least[root(i)]) for i in range(len(good)))
    for block in (512, 16):
        got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in pivots.find(df, block=block).collect())
        found, links_ = sum(r[1] * c for r, c in got.items()), sum(n.values())
        assert 0.97 * links_ <= found <= links_ and sum((got & want).values()) >= 0.97 * len(rows)
    assert pivots.find(df.limit(0)).count() == 0


def test_pivot_recall_at_the_threshold_holds_with_many_pivots():
    rng = np.random.default_rng(3)
    for wanted, least in ((300, 0.99), (1200, 0.98), (4096, 0.96)):
        chosen = pivots.choose(list(rng.normal(size=(2 * wanted, 64))), wanted)[64]
        x = pivots.unit(rng.normal(size=(1000, 64)))
        away = rng.normal(size=x.shape)
        away = pivots.unit(away - (away * x).sum(axis=1, keepdims=True) * x)
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * away
        a, b = (pivots.lists_of(pivots.describe(v, chosen), 64) for v in (x, y))
        assert np.mean([len(np.intersect1d(s, t)) > 0 for s, t in zip(a, b, strict=True)]) >= least


def test_quotes_that_are_wrapped_anew(spark):
    long_ = "The committee will meet on Tuesday to discuss the budget, and all members are asked to bring figures."
    rows = [(1, 0, "user", f"Hello,\n\n{long_}\n\nBye"), (1, 1, "user", "Something else"), (1, 2, "user", "> The committee will meet on Tuesday to\n> discuss the budget, and all members\n> are asked to bring figures.\n\nI agree"), (1, 3, "user", f"two lines\nwritten here\n>> {long_}\nnow"), (1, 4, "user", "> two lines written here\n>\n> no such text"), (2, 0, "user", "> two lines written here")]
    got = {(r["conv_id"], r["turn"]): (r["parent_turn"], r["n_linked"]) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): (None, 0), (1, 1): (None, 0), (1, 2): (0, 3), (1, 3): (0, 1), (1, 4): (3, 1), (2, 0): (None, 0)}


# --- components


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["id"]: r["component"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


# --- whole-document near-duplicates


def bag(t):
    w = bagminhash.normal(t or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def overlap(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(1)
    errors = []
    for _ in range(40):
        a = prose(rng, 150, 3 + rng.randrange(200)).split()
        b = list(a)
        for _ in range(rng.randrange(0, 20)):
            b[rng.randrange(len(b))] = "new"
        texts = [" ".join(a).encode(), " ".join(b).encode()]
        s = bagminhash.signatures(*bagminhash.bags(texts), 2, 2000)
        errors.append(np.mean(s[0] == s[1]) - overlap(bag(texts[0].decode()), bag(texts[1].decode())))
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.02


def test_signatures_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [prose(rng, n).encode() for n in (1, 3, 5, 50, 4000)]
    together = bagminhash.signatures(*bagminhash.bags(texts), 5)
    alone = [bagminhash.signatures(*bagminhash.bags([t]), 1)[0] for t in texts]
    assert np.isfinite(together).all() and all((a == b).all() for a, b in zip(together, alone, strict=True))


def variants(rng, n):
    """Texts with copies, near copies on either side of the threshold, and repeated passages."""
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            w = rng.choice(texts)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(99)}"
            texts.append((i, " ".join(w)))
        else:
            texts.append((i, (prose(rng, rng.randrange(1, 12)) + " ") * rng.choice([1, 1, 9]) + prose(rng, rng.randrange(1, 120))))
    return texts


def grouped(texts, linked):
    parent = {i: i for i, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(texts):
        for j, b in texts[:k]:
            if linked(a, b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def test_near_duplicates_equal_brute_force(spark):
    texts = variants(random.Random(8), 220)
    bags = {t: bag(t) for _, t in texts}
    want = grouped(texts, lambda a, b: overlap(bags[a], bags[b]) >= 0.8)
    df = docs_of(spark, texts + ODD, extra=True)
    rows = bagminhash.groups(df).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == len(texts) + len(ODD) and sum(got[i] == c for i, c in want.items()) >= 0.99 * len(want)
    assert all(want[i] == want[c] for i, c in got.items() if i in want)
    assert got[900] == 900 and got[903] == 903 and got[904] == 904
    kept = bagminhash.keep(df)
    counts = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == df.columns and counts[904] == 1 and counts[None] == 1 and counts[900] == 1
    assert {i for i in counts if i is not None and i < 900} == {c for i, c in got.items() if i is not None and i < 900}
    assert bagminhash.groups(df.limit(0)).count() == 0 and bagminhash.keep(df.limit(0)).count() == 0


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(12)
    base = prose(rng, 200).split()
    texts = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = f"n{i}"
        texts.append((i, " ".join(w)))
    bags = {t: bag(t) for _, t in texts}
    want = grouped(texts, lambda a, b: overlap(bags[a], bags[b]) >= 0.8)
    got = {r["doc_id"]: r["component_id"] for r in bagminhash.groups(docs_of(spark, texts)).collect()}
    assert sum(got[i] == c for i, c in want.items()) >= 297


# --- paragraphs


def test_few_edits_equals_distance():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randrange(2)] = [rng.randrange(6)] * rng.randrange(2)
        most = int(0.1 * max(len(a), len(b)))
        x, y = (np.array(z, dtype=np.uint64) for z in (a, b))
        assert paradedup.few_edits(x, y) == (most > 0 and paradedup.edit_distance(a, b) <= most)


# --- language-model scoring

VOCAB = lattice.VOCABULARY


def brute_logp(v, word):
    word = v.mark + word
    index = {p: i for i, p in enumerate(v.pieces) if p}
    total = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            if word[i:j] in index:
                total[j] += total[i] * math.exp(v.logp[index[word[i:j]]])
        if word[j - 1] not in index:
            total[j] += total[j - 1] * math.exp(sum(v.logp[v.of_byte[b]] for b in word[j - 1].encode()))
    return math.log(total[-1])


def test_lattice_sums_all_segmentations():
    v = lattice.load(VOCAB)
    assert np.logaddexp.reduce(v.logp) == pytest.approx(0, abs=1e-6)
    words = ["the", "thing", "é", "日本語x", "a", "12.5%", "unbelievable", "😀", "zz" * 40]
    assert lattice.score_words(v, words) == pytest.approx([brute_logp(v, w) for w in words], rel=1e-9)


def test_expected_counts_are_a_gradient():
    v = lattice.load(VOCAB)
    words, counts = ["thing", "notation", "é", "ing" * 20], np.array([2.0, 1.0, 3.0, 1.0])
    expected = np.zeros(len(v.logp))
    lattice.score_words(v, words, counts, expected)
    for piece in ("▁th", "ing", "at", "n"):
        i, step = v.pieces.index(piece), 1e-6
        up = v.logp.copy()
        up[i] += step
        moved = v.with_logp(up, v.end)
        moved.__dict__.pop("index", None)
        slope = (lattice.score_words(moved, words) - lattice.score_words(v, words)) @ counts / step
        assert expected[i] == pytest.approx(slope, rel=1e-3, abs=1e-6)


def test_scores(spark):
    rng = random.Random(31)
    texts = [(i, " ".join(rng.choice(["The", "thing", "other", "É", "rare" + str(rng.randrange(300))]) for _ in range(rng.randrange(0, 40)))) for i in range(90)] + ODD
    df = docs_of(spark, texts, extra=True)
    few, many = (lattice.scored(df, common_words=n).collect() for n in (3, 100_000))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    few.sort(key=key)
    many.sort(key=key)
    train = Counter()
    for i, t in texts:
        if not lattice.is_held_out(i):
            train.update(lattice.tokens(t or ""))
            train["end"] += 1
    n, v = sum(train.values()), len(train)
    ordered = sorted(texts, key=lambda x: (x[0] is None, x[0] or 0))
    assert len(few) == len(texts)
    for a, b, (i, t) in zip(few, many, ordered, strict=True):
        tokens = [*lattice.tokens(t or ""), "end"]
        assert (a["doc_id"], a["n_tokens"], a["n_known"], a["train_tokens"]) == (i, len(tokens), sum(train[x] > 0 for x in tokens), n)
        assert a["base_score"] == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in tokens)) and a["base_score"] == pytest.approx(b["base_score"])
        assert a["score"] == pytest.approx(b["score"]) and a["score"] < 0 and a["held_out"] == lattice.is_held_out(i)
    assert lattice.scored(df.limit(0)).count() == 0
    # without re-estimation the scores are sums over the vocabulary's own
    v = lattice.load(VOCAB)
    plain = {r["doc_id"]: r["score"] for r in lattice.scored(df, rounds=0).collect()}
    for i, t in texts[:12]:
        assert plain[i] == pytest.approx((v.end + sum(brute_logp(v, w.decode()) for w in lattice.tokens(t))) / math.log(10))


def test_frequent_words_are_bounded_in_length(spark):
    rows = spark.createDataFrame([("y" * 5000, 9, 9, -1.0), ("the", 5, 5, -2.0), ("a", 1, 1, -3.0)], "word string, c long, seen long, lp double")
    places, c, lp = lattice._frequent(rows, 10)
    assert set(places) == {b"the", b"a"} and c[places[b"the"]] == 5 and lp[places[b"a"]] == -3.0


def test_what_is_joined_is_not_followed_again(spark, monkeypatch):
    """Second links are taken between components, not beside all the first ones."""
    rng = random.Random(12)
    base = prose(rng, 200).split()
    texts = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(200)] = f"n{i}"
        texts.append((i, " ".join(w)))
    calls, found = [], links.components

    def watched(edges):
        calls.append(([(r["a"], r["b"]) for r in edges.collect()], out := found(edges)))
        return out

    monkeypatch.setattr(links, "components", watched)
    got = {r["doc_id"]: r["component_id"] for r in bagminhash.groups(docs_of(spark, texts)).collect()}
    bags = {t: bag(t) for _, t in texts}
    want = grouped(texts, lambda a, b: overlap(bags[a], bags[b]) >= 0.8)
    assert sum(got[i] == c for i, c in want.items()) >= 297 and all(want[i] == want[c] for i, c in got.items())
    (_, first), (more, _) = calls
    head = {r["id"]: r["component"] for r in first.collect()}
    assert any(i != c for i, c in head.items()) and more and all(head.get(x, x) == x for link in more for x in link)


def test_merged_components(spark):
    """Links between components, ids that had none, and components without further links."""
    found = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "id long, component long")
    more = spark.createDataFrame([(5, 4), (4, 3), (10, 11), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in links.merged(found, more).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 8: 8, 9: 8, 10: 10, 11: 10}
