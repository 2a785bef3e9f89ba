"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO_WIDTH = "​"
URL_PREFIX = "https://www.facebook.com/ads/library/?id="  # fixed value
#: Whitespace as Python's strip() sees it; U+200B is not part of it.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _plain(c: Column) -> Column:
    """Whether a character is one of ASCII that is no blank."""
    return (c >= "!") & (c <= "~")


def strip(c: Column) -> Column:
    """Most texts have plain ends and need no search."""
    return F.when(_plain(F.left(c, F.lit(1))) & _plain(F.right(c, F.lit(1))), c).otherwise(F.regexp_replace(c, _EDGES, ""))


@F.pandas_udf(T.StringType())
def fold_compatible(texts: pd.Series) -> pd.Series:
    """NFKC; there is no built-in for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


#: Line breaks besides the line feed.
OTHER_BREAKS = r"[\r\x0b\x0c\x1c-\x1e\x85  ]"


def lines_of(c: Column) -> Column:
    """Lines like Python's splitlines(): no empty element after a last line break."""
    return F.split(F.regexp_replace(c, r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def tidy(c: Column) -> Column:
    """Zero-width spaces off, lines right-trimmed, three or more line breaks to two, ends trimmed; without the NFKC folding."""
    trimmed = F.array_join(F.transform(lines_of(F.replace(c, F.lit(ZERO_WIDTH), F.lit(""))), lambda x: F.when(_plain(F.right(x, F.lit(1))), x).otherwise(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+$", ""))), "\n")
    return strip(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"))


def normalize_text(c: Column) -> Column:
    return tidy(fold_compatible(c))


def word_set(c: Column) -> Column:
    """Distinct lower-case words of ASCII letters, digits, $ and apostrophe."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9$']+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; two empty sets are equal."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def source_url(c: Column) -> Column:
    return F.concat(F.lit(URL_PREFIX), c)


def row_height(c: Column) -> Column:
    """Points for a sheet row: 15 for every 85 characters of each line, between 30 and 409."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.greatest(F.lit(1), F.ceil(F.length(x) / 85).cast("int")))
    return F.greatest(F.lit(30), F.least(F.lit(409), 15 * F.aggregate(lines, F.lit(0), lambda a, x: a + x)))


def short_list(hits: Column, n: int = 3) -> Column:
    """The first n distinct entries in order of appearance, quoted."""
    return F.array_join(F.transform(F.slice(F.array_distinct(hits), 1, n), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
