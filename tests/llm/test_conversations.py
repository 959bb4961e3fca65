"""Conversation repair against DuckDB's plain recursion over whole conversations."""

import random

import duckdb
import pandas as pd
import pytest

from storyline.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, block long, part string"
NAME = "op12_conversation_repair"


def rows_of(turns):
    return [(*t, 7, "x") for t in turns]


def expected(turns):
    table = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    db = duckdb.connect()
    db.register("given", table)
    db.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM given")
    relation = db.sql(queries.SQL[NAME])
    return sorted((dict(zip(relation.columns, row, strict=True)) for row in relation.fetchall()), key=str)


def found(spark, turns, rows=None):
    df = spark.createDataFrame(rows_of(turns) if rows is None else rows, SCHEMA)
    out = conversations.digest(conversations.repair(*conversations.damaged(df)))
    return sorted((r.asDict() for r in out.collect()), key=str)


def random_turns(seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "sage", "", None, "user", "assistant"], ["", " \t", "a.", "b", "c! ", None, "d?\n", "é.", "x\x85"]
    turns = [(conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{turn}." * rng.randint(0, 2)) for conv in range(40) for turn in range(rng.randint(1, 9))]
    turns += [(99, rng.choice([None, *range(150)]), rng.choice(roles), rng.choice([*texts, f"t{k}", f"t{k}."])) for k in range(160)]
    turns += [(None, 1, "user", "a."), (None, 1, "user", "a."), (-5, None, None, None), (7, 3, "user", "z" * 100_000)]
    return turns


@pytest.mark.parametrize("segment, fan", [(256, 64), (4, 2)])
def test_against_whole_recursion(spark, monkeypatch, segment, fan):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    monkeypatch.setattr(conversations, "FAN", fan)
    turns = random_turns(segment)
    assert found(spark, turns) == expected(turns)


def test_empty_and_all_dropped(spark):
    assert found(spark, []) == []
    gone = next(t for t in range(1000) if __import__("zlib").crc32(f"1:{t}".encode()) % 20 == 0)
    (row,) = found(spark, [(1, gone, "user", "a.")])
    assert (row["cost"], row["gaps"], row["audit"]) == (0, 0, "")
    assert row["repaired_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi there?"), (1, 2, "user", " ")], "conv_id long, turn long, role string, text string")
    segments = conversations.repair(df).collect()
    turns = [tuple(t) for s in sorted(segments, key=lambda s: s["block"]) for t in s["turns"] or []]
    tail = "".join(s["tail"] or "" for s in segments)
    # Insert, keep, keep, insert costs 4; insert, keep, delete would cost 5. The blank row must go.
    assert turns == [("user", ""), ("assistant", "Hello."), ("user", "Hi there?")] and tail == "Ia"
