"""Quotation linking: reply-ordered conversations without quotes, in DataFrame operations only.

A message's lines that begin with '>' are quoted; the number of '>' (blanks between them allowed) is the quote level.
Each quoted line is normalised (marks off, lower case, white space joined) and hashed, and looked up among the own
lines of earlier messages of the conversation; the latest earlier message that wrote the line is its origin. The
message from which most level-1 lines come (ties: the latest) is the parent; deeper levels count when no level-1
line is linked. Threads are the trees of this relation; a thread's messages stand together, by turn, so a parent
always precedes its replies, and threads stand by their first turn.

A client may wrap a quote anew, so that no line is left whole. Contiguous quoted lines of one level, joined, are a passage; own
lines between blank or quoted ones, joined, are a paragraph. A passage none of whose lines is linked is looked up among
earlier paragraphs and lines and votes with the number of its lines. A part of a paragraph, broken anew, is not found.

Texts are compared by 96 bits of hashes, within one conversation. ``position`` is a message's place in the reply order of its
conversation, from 1: one more than the number of messages that stand before it.

Null text is empty. Rows with null conversation or turn are kept, linked with nothing and have no position. Rows that share
conversation and turn are one message of several texts: each row stays, and all get the same parent and position. Blank quoted
lines link with nothing. Quote lines are taken out of the text; blank lines at its ends too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns in one window group when origins are looked up and messages are numbered, so a long conversation is many groups.
TURNS = 512

_MARKS = r"^[\x20\x09]*(>[\x20\x09]*)+"


def level(line):
    """Number of quote marks before the line's text."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 0), r"[^>]", ""))


def normal(line):
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"[\x20\x09-\x0D]+", " "))


def hashed(text):
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def parsed(messages: DataFrame) -> DataFrame:
    """conv, turn, role, body (text without quoted lines), n_quoted, lines (level, hash) without blank ones, and passages."""
    raw = F.split(common.text_or_empty("text"), r"\r?\n")
    read = messages.withColumn("read", F.transform(raw, lambda x: F.struct(level(x).alias("level"), normal(x).alias("text"), x.alias("raw"))))
    body = F.array_join(F.transform(F.filter("read", lambda x: x["level"] == 0), lambda x: x["raw"]), "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"^([\x20\x09]*\r?\n)+", ""), r"(\r?\n[\x20\x09]*)+$", "")
    lines = F.transform(F.filter("read", lambda x: x["text"] != ""), lambda x: F.struct(x["level"].alias("level"), hashed(x["text"]).alias("hash")))
    n_quoted = F.size(F.filter("read", lambda x: x["level"] > 0)).cast("long")
    return read.select("conv", "turn", "role", body.alias("body"), n_quoted.alias("n_quoted"), lines.alias("lines"), passages(F.col("read")).alias("passages"))


def passages(read):
    """(level, hash, hashes, n) of runs of lines of one level, none blank: their joined text, their lines' hashes, and their number."""
    marked = F.transform(read, lambda x: F.struct(F.when(x["text"] == "", -1).otherwise(x["level"]).alias("level"), x["text"].alias("text")))
    before = lambda i: F.when(i > 0, F.element_at(marked, i)["level"])
    # a passage starts where the level changes; the lines from one start to the next are one slice
    starts = F.filter(F.transform(marked, lambda x, i: F.when(~x["level"].eqNullSafe(before(i)), i + 1)), lambda p: p.isNotNull())
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(marked) + 1))
    parts = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.slice(marked, z["s"], z["e"] - z["s"]))
    # own passages of one line are lines
    parts = F.filter(parts, lambda p: (p[0]["level"] > 0) | ((p[0]["level"] == 0) & (F.size(p) > 1)))
    return F.transform(parts, lambda p: F.struct(p[0]["level"].alias("level"), hashed(F.array_join(F.transform(p, lambda x: x["text"]), " ")).alias("hash"), F.transform(p, lambda x: hashed(x["text"])).alias("hashes"), F.size(p).cast("long").alias("n")))


def origins(read: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked) of messages with a linked quote: by lines, and by passages that no line links."""
    keyed = read.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    lines = keyed.select("conv", "turn", F.explode("lines").alias("x")).select("conv", "turn", "x.hash", "x.level", F.lit(1).cast("long").alias("n"))
    by_line = common.settle(found_in(lines))
    # rows that share conversation and turn are one message, so a line linked in one is linked in all
    linked = by_line.groupBy("conv", "turn").agg(F.collect_set("hash").alias("linked"))
    parts = keyed.select("conv", "turn", F.explode("passages").alias("x")).select("conv", "turn", "x.*")
    asked = parts.where("level > 0").join(linked, ["conv", "turn"], "left")
    asked = common.settle(asked.where(~F.coalesce(F.arrays_overlap("hashes", "linked"), F.lit(False))).select("conv", "turn", "hash", "level", "n"))
    found = by_line
    if not asked.isEmpty():
        written = parts.where("level = 0").select("conv", "turn", "hash", "level", "n")
        found = by_line.unionByName(found_in(written.unionByName(lines.where("level = 0")).unionByName(asked)))
    votes = found.groupBy("conv", "turn", "origin").agg(F.sum(F.when(F.col("level") == 1, F.col("n")).otherwise(0)).alias("direct"), F.sum("n").alias("n"))
    best = F.max(F.struct("direct", "n", "origin"))
    return votes.groupBy("conv", "turn").agg(best.alias("b"), F.sum("n").alias("n_linked")).select("conv", "turn", F.col("b.origin").alias("parent"), "n_linked")


def found_in(lines: DataFrame) -> DataFrame:
    """(conv, turn, hash, level, n, origin) of quoted rows of (conv, turn, hash, level, n) that an earlier turn has at level 0.

    For each conversation and line hash, writers and quoters are put in order of turn and the last writer before each
    quoter is found by a running maximum, in groups of TURNS turns with the carry from earlier groups; no pairs are made.
    """
    quoted = lines.where("level > 0").groupBy("conv", "turn", "hash").agg(F.min("level").alias("level"), F.sum("n").alias("n"))
    # only lines that someone quotes are looked up
    asked = quoted.select("conv", "hash").distinct()
    written = lines.where("level = 0").join(asked, ["conv", "hash"], "left_semi").groupBy("conv", "turn", "hash").agg(F.lit(0).alias("level"), F.lit(0).cast("long").alias("n"))
    both = written.unionByName(quoted).withColumn("group", F.floor(F.col("turn") / TURNS))
    own = F.when(F.col("level") == 0, F.col("turn"))
    carried = both.groupBy("conv", "hash", "group").agg(F.max(own).alias("last")).withColumn("carry", F.max("last").over(Window.partitionBy("conv", "hash").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    run = Window.partitionBy("conv", "hash", "group").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("inner", F.max(own).over(run)).join(carried, ["conv", "hash", "group"]).where("level > 0").withColumn("origin", F.coalesce("inner", "carry")).where("origin is not null").select("conv", "turn", "hash", "level", "n", "origin")


def rooted(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked, root, depth): each step doubles the way that a message's pointer has gone up."""
    state = common.settle(links.withColumns({"root": F.col("parent"), "depth": F.lit(1).cast("long")}))
    while True:
        up = state.select("conv", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        step = state.join(up, ["conv", "root"], "left")
        moved = step.select("conv", "turn", "parent", "n_linked", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"))
        state = common.settle(moved)
        if state.where("moved").isEmpty():
            return state.drop("moved")


def positions(order: DataFrame) -> DataFrame:
    """(conv, thread, turn, position) from rows (conv, thread, turn, n) with n messages each.

    Messages are counted in groups of threads, in threads and in groups of turns, and the sums of what stands before are added
    up, so no window holds a whole conversation or thread.
    """
    order = order.withColumns({"threads": F.floor(F.col("thread") / TURNS), "turns": F.floor(F.col("turn") / TURNS)})
    out = order.withColumn("position", F.lit(1).cast("long"))
    levels = [(["conv"], "threads"), (["conv", "threads"], "thread"), (["conv", "threads", "thread"], "turns"), (["conv", "threads", "thread", "turns"], "turn")]
    for group, key in levels:
        before = F.sum("n").over(Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
        counted = order.groupBy(*group, key).agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
        out = out.join(counted, [*group, key]).withColumn("position", F.col("position") + F.col("before")).drop("before")
    return out.select("conv", "thread", "turn", "position")


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, body, n_quoted, n_linked, parent_turn, thread_turn, depth, position, and ``formatted`` (role tag and body)."""
    named = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    read = common.settle(parsed(named))
    found = common.settle(origins(read))
    tree = found.withColumns({"root": F.col("parent"), "depth": F.lit(1).cast("long")}) if found.isEmpty() else rooted(found)
    whole = read.where(F.col("conv").isNotNull() & F.col("turn").isNotNull()).groupBy("conv", "turn").agg(F.count("*").alias("n")).join(tree, ["conv", "turn"], "left")
    whole = common.settle(whole.withColumn("thread", F.coalesce("root", "turn")))
    placed = positions(whole.select("conv", "thread", "turn", "n"))
    whole = whole.drop("n", "root").join(placed, ["conv", "thread", "turn"])
    rows = read.select("conv", "turn", "role", "body", "n_quoted").join(whole, ["conv", "turn"], "left")
    return rows.select(
        F.col("conv").alias(conv_col),
        F.col("turn").alias(turn_col),
        F.col("role").alias(role_col),
        "body",
        "n_quoted",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("thread", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "position",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body")).alias("formatted"),
    )


def ordered(linked: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The reply-ordered conversations: messages without quotes, sorted by conversation and position over all partitions."""
    return linked.orderBy(conv_col, "position")
