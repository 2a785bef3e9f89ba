"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Null and empty texts have no spans. Each row of the input gives one row, repeated ids included; columns
other than the id and the text are not read, so extra ones cannot clash.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in output order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
#: Least score of a kind that the method itself adds.
MIN_SCORE = 0.5
#: Characters on either side of a span in which context words count.
CONTEXT = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive runs after a look-behind: same matches as the plain patterns, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NON_DIGIT = re.compile(r"[^0-9]+")
# A key or token: long, of letters and digits in no order; what it is shows in the words beside it.
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+={0,2}")
_LEAST_DISTINCT = 8
#: Words near a span that make a kind likelier (fixed values).
_HINTS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "key", "secret", "password", "passwd", "api", "credential", "credentials", "bearer"),
}
#: Words that make any kind less likely (fixed values).
_DOUBTS = ("example", "sample", "test", "dummy", "version")
#: Score before context: a checksum is strong evidence, a shape alone is weak.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.35, "secret": 0.35}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost matches, found from each '@' outward: a local part never holds '@', so this equals the plain scan but is linear."""
    done = 0
    at = text.find("@")
    while at >= 0:
        if at > done:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done = m.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the four base kinds."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NON_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(re.findall(r"[a-z]+", (text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]).lower()))
    value = _PRIOR[kind] + 0.3 * bool(near.intersection(_HINTS[kind])) - 0.3 * bool(near.intersection(_DOUBTS))
    return min(1.0, max(0.0, value))


def random_looking(token: str) -> bool:
    """Letters and digits, several of each kind of character, as in keys and digests but not in words or numbers."""
    return len(set(token)) >= _LEAST_DISTINCT and any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token)


def added_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 4, m.end()) for m in _IBAN.finditer(text) if mod97(m[0])]
    out += [(m.start(), 5, m.end()) for m in _SSN.finditer(text)]
    out += [(m.start(), 6, m.end()) for m in _SECRET.finditer(text) if random_looking(m[0])]
    return [x for x in out if score(text, KINDS[x[1]], x[0], x[2]) >= MIN_SCORE]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``found`` (array of kind, start, end, score by start, then kind)."""

    def scan(batch: pa.RecordBatch):
        rows = []
        for text in common.texts_of(batch, text_col):
            spans = sorted(base_spans(text) + added_spans(text)) if text else []
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "score": score(text, KINDS[k], s, e)} for s, k, e in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(rows, type=kind)], names=[id_col, "found"])

    kind = df.schema[id_col].dataType.simpleString()
    return common.map_batches(df, [id_col, text_col], scan, f"{id_col} {kind}, found array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``find``."""
    base = KINDS[:4]

    def joined(array):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    only_base = F.filter("found", lambda s: s["kind"].isin(*base))
    return found.select(id_col, *(number(k) for k in base), F.sha2(joined(only_base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), *(number(k) for k in KINDS[4:]), F.size("found").cast("long").alias("n_found"))


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans are replaced as one. Null texts stay null. All columns stay, in order."""

    common.small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(_cleaned)

    out = df.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType)) if length_col else out


def _cleaned(text):
    if not text:
        return text
    spans = sorted(base_spans(text) + added_spans(text))
    if not spans:
        return text
    parts, done, end = [], 0, -1
    for s, k, e in spans:
        if s >= end:
            parts += [text[max(done, 0) : s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
        done = end
    return "".join([*parts, text[done:]])
