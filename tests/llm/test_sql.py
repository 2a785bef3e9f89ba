"""Queries against their SQL, on the smallest tables and on a conversation that has quotes."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tagloom.llm import quotes, sql
from tagloom.llm.queries import queries

DATA = "/root/testdata/sf0.001"


def shown(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries()[name](spark, DATA)
    r = c.execute(sql.ORACLES[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns) and shown(df.collect(), df.columns) == shown(r.fetchall(), columns)


def test_quotes_equal_sql(spark):
    import random

    rng = random.Random(6)
    rows = []
    for c in range(12):
        said = ["start"]
        for t in range(rng.randrange(1, 25)):
            lines = []
            for _ in range(rng.randrange(0, 4)):
                mark = ">" * rng.randrange(1, 4) + rng.choice(["", " ", "  "])
                words = rng.choice(said).upper().split(" ")
                cut = rng.randrange(len(words)) if rng.random() < 0.5 else 0  # some quotes are wrapped anew
                lines += [mark + " ".join(x) for x in (words[:cut], words[cut:]) if x]
            lines += [f"line {rng.randrange(9)}" for _ in range(rng.randrange(0, 3))] + rng.choice([[], [""]])
            own = [x for x in lines if x and x[0] != ">"]
            said += [*own, " ".join(own)] if own else []
            rows.append((c, t, rng.choice(["user", "assistant", None]), "\n".join(lines)))
    rows += [(1, 1, "user", "> start\nagain"), (None, 0, "user", "> start"), (2, None, "user", None)]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = quotes.link(df)
    r = c.execute(sql.OP2)
    found = got.collect()
    assert shown(found, got.columns) == shown(r.fetchall(), [x[0] for x in r.description])
    # links by whole passages occur as well as links by lines
    by_lines = c.execute("SELECT count(*) FROM (" + sql.OP2 + ") WHERE n_linked > 0").fetchone()[0]
    assert sum(x["n_linked"] > 0 for x in found) == by_lines > 50
    order = [(x["conv_id"], x["position"]) for x in quotes.ordered(got.where("position is not null")).collect()]
    assert order == sorted(order)
    for conv in range(12):
        own = sorted((x for x in found if x["conv_id"] == conv and x["turn"] is not None), key=lambda x: (x["thread_turn"], x["turn"]))
        assert [x["position"] for x in own] == [1 + sum((y["thread_turn"], y["turn"]) < (x["thread_turn"], x["turn"]) for y in own) for x in own]


def test_quotes_run_no_python(spark):
    df = spark.createDataFrame([(1, 0, "u", "a b c\nd e"), (1, 1, "u", "> a b c d\n> e\nyes")], "conv_id long, turn long, role string, text string")
    messages = df.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    read = quotes.parsed(messages)
    frames = [read, quotes.origins(read), quotes.rooted(quotes.origins(read)), quotes.positions(read.select("conv", F.col("turn").alias("thread"), "turn", F.lit(1).alias("n"))), quotes.link(df)]
    for x in frames:
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert {(r["turn"], r["parent_turn"], r["n_linked"]) for r in frames[-1].collect()} == {(0, None, 0), (1, 0, 2)}
