"""License scans: exact phrases, and short notices found with a bounded number of edits.

A notice with budget k is split into k + 1 pieces; a text within k edits of it holds one piece unchanged,
so piece hits (one automaton for all notices) locate windows in which the regex library's bounded-error
matching confirms the notice. Null and empty texts have no words and no labels. Each input row gives one row.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Phrases and labels of the base part (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices searched with errors, as normalised words (fixed values).
NOTICES = (
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person"),
    ("bsd", "redistribution and use in source and binary forms with or"),
    ("cc-by", "licensed under a creative commons attribution"),
    ("cc-by", "this work is licensed under cc by"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this"),
    ("unlicense", "free and unencumbered software released into the public"),
    ("reserved", "all rights reserved unauthorized copying is prohibited"),
)
#: Share of a notice's characters that may be edited, and the length of the pieces counted before the costly match.
GRAM = 4
ERROR_RATE = 0.1

_LOWER_OR_SPACE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def pieces(notice: str, budget: int) -> list[tuple[int, str]]:
    cuts = [len(notice) * j // (budget + 1) for j in range(budget + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Holds the automaton and the bounded-error expressions; made once in each Python worker."""

    def __init__(self, notices=NOTICES, rate=ERROR_RATE):
        self.notices = [(label, text, int(len(text) * rate)) for label, text in notices]
        self.match = [regex.compile(f"(?e)(?:{regex.escape(t)}){{e<={k}}}") for _, t, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.notices):
            for at, piece in pieces(text, k):
                seeds.setdefault(piece, []).append((n, at))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def base(self, norm: bytes) -> list[tuple[int, str]]:
        """(first word's index, label) of each place of a phrase in words joined and framed by single blanks."""
        out = []
        for phrase, label in PHRASES.items():
            needle = f" {phrase} ".encode()
            at = norm.find(needle)
            while at >= 0:
                out.append((norm.count(b" ", 0, at), label))
                at = norm.find(needle, at + 1)
        return out

    def fuzzy(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, notice number), best match in each window where windows of one notice are merged."""
        windows: dict[int, list[list[int]]] = {}
        for end, (length, uses) in self.seeds.iter(norm):
            for n, at in uses:
                k, size = self.notices[n][2], len(self.notices[n][1])
                begin = end + 1 - length - at
                lo, hi = max(0, begin - k), min(len(norm), begin + size + k)
                own = windows.setdefault(n, [])
                own.append([lo, hi])
        out = set()
        for n, own in windows.items():
            own.sort()
            size, merged = len(self.notices[n][1]), []
            for lo, hi in own:
                if merged and lo - merged[-1][0] <= self.notices[n][2] and hi - merged[-1][0] <= 2 * size:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                if self.hopeless(n, norm[lo:hi]):
                    continue
                for m in self.match[n].finditer(norm, lo, hi):
                    out.add((m.start(), m.end(), sum(m.fuzzy_counts), n))
        return sorted(out)

    def hopeless(self, n: int, window: str) -> bool:
        """An edit destroys at most one of a notice's pieces that do not overlap, so more missing pieces than the budget rule a match out."""
        _, notice, budget = self.notices[n]
        return sum(notice[i : i + GRAM] not in window for i in range(0, len(notice) - GRAM + 1, GRAM)) > budget

    def scan(self, text: str) -> dict:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER_OR_SPACE).split()
        norm = b" " + b" ".join(words) + b" "
        base = self.base(norm)
        shown = norm.decode("utf-8", "replace")
        found = self.fuzzy(shown)
        best: dict[str, float] = {label: 1.0 for _, label in base}
        spans = []
        if found:
            blanks = [i for i, c in enumerate(shown) if c == " "]
            places = [m.span() for m in _WORD.finditer(text)]
            for start, end, edits, n in found:
                label, notice, _ = self.notices[n]
                value = 1 - edits / len(notice)
                best[label] = max(best.get(label, 0.0), value)
                first = min(max(0, bisect_left(blanks, start + 1) - 1), len(places) - 1)
                last = min(max(first, bisect_left(blanks, end) - 1), len(places) - 1)
                spans.append({"label": label, "start": places[first][0], "end": places[last][1], "edits": edits})
        return {"n_words": len(words), "base": [{"word": w, "label": x} for w, x in sorted(base)], "labels": sorted(best), "spans": spans, "score": max(best.values(), default=0.0)}


_RESULT = pa.struct([("n_words", pa.int64()), ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), ("labels", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))), ("score", pa.float64())])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, rate: float = ERROR_RATE) -> DataFrame:
    """The id and ``found``: n_words, base places, labels, spans of notices in code points, score."""

    def scan(batch: pa.RecordBatch, own=[]):  # noqa: B006  one scanner for each worker's copy of this function
        if not own:
            own.append(Scanner(notices, rate))
        rows = [own[0].scan(t) for t in common.texts_of(batch, text_col)]
        yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(rows, type=_RESULT)], names=[id_col, "found"])

    kind = df.schema[id_col].dataType.simpleString()
    return common.map_batches(df, [id_col, text_col], scan, f"{id_col} {kind}, found struct<n_words:bigint,base:array<struct<word:bigint,label:string>>,labels:array<string>,spans:array<struct<label:string,start:bigint,end:bigint,edits:bigint>>,score:double>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``find``, and the notices' spans."""
    base = F.col("found.base")
    words = F.transform(base, lambda x: x["word"])
    return found.select(
        id_col,
        F.col("found.n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join("found.labels", ",").alias("labels"),
        F.col("found.score").alias("score"),
        F.array_join(F.transform("found.spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["edits"].cast("string"))), ",").alias("notices"),
    )
