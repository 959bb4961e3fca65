"""MATCH expressions against plain evaluation, and the kept index after updates, removals and merges."""

import random
import re
import unicodedata

import pytest

from storyline.operators import search
from storyline.sources.store import Store


def plain_tokens(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", bare)


TITLES = [(1, "Big model news, big cat"), (2, "The big cat sat"), (3, None), (4, "Modèle Éclair 3.14 released"), (5, "cat big model"), (6, ""), (7, "modelling the CAT news"), (8, "a_b c-d e.f")]


@pytest.mark.parametrize("expression, expected", [
    ("big", {1, 2, 5}), ("BIG cat", {1, 2, 5}), ("big AND cat NOT sat", {1, 5}), ("sat OR news", {1, 2, 7}), ('"big cat"', {1, 2}), ("big + cat", {1, 2}), ('"big model" OR "cat sat"', {1, 2, 5}),
    ("mod*", {1, 4, 5, 7}), ('"big mod" *', {1, 5}), ("(big OR modelling) NOT (sat OR model)", {7}), ("eclair", {4}), ("3.14", {4}), ("a b", {8}), ('"a b"', {8}), ("c-d", {8}),
    ("big OR cat NOT cat", {1, 2, 5}), ('""', set()), ("none", set()),
])
def test_match(spark, expression, expected):
    index = search.positional(spark.createDataFrame(TITLES, "id long, title string"))
    assert {r["id"] for r in search.Match(expression).keys(index).collect()} == expected


@pytest.mark.parametrize("expression", ["(big", "big AND", "OR big", "big )", "NOT big", "", '"open'])
def test_unreadable(expression):
    with pytest.raises(ValueError):
        search.Match(expression)


def test_folding_like_decomposition(spark):
    text = "".join(chr(c) for c in (*range(0x20, 0x250), *range(0x1E00, 0x1F00))).replace("İ", "")
    row = spark.createDataFrame([(text,)], "t string").select(search.tokens(search.F.col("t")).alias("w")).first()
    assert [w for w in row["w"] if w.isascii()] == [w for w in plain_tokens(text) if w.isascii()]


def test_kept_index_follows_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "FANOUT", 3)
    index, dice = search.TitleIndex(Store(spark, str(tmp_path))), random.Random(4)
    assert index.search("big").count() == 0
    words = "alpha beta gamma delta epsilon zeta".split()
    now = {str(k): " ".join(dice.choices(words, k=4)) for k in range(40)}
    written = []
    for step in range(6):
        table = spark.createDataFrame(list(now.items()), "id string, title string")
        before = {k: v for k, v in index.store.transaction().entries.items()}
        assert sum(index.sync(table).values()) == (40 if not step else 3)
        written.append(len({k for k, v in index.store.transaction().entries.items() if before.get(k) != v}))
        for expression, test in (
            ("alpha beta", lambda w: {"alpha", "beta"} <= set(w)), ('"alpha beta"', lambda w: "alpha beta" in " ".join(w)), ("gam* NOT zeta", lambda w: "gamma" in w and "zeta" not in w), ("fresh", lambda w: "fresh" in w),
        ):
            assert {r["id"] for r in index.search(expression).collect()} == {k for k, t in now.items() if test(t.split())}, (step, expression)
        ranked = {r["id"]: r["rank"] for r in index.ranked("alpha OR fresh").collect()}
        plain = search.bm25(search.postings(table), ["alpha", "fresh"]).collect()
        assert ranked == pytest.approx({r["id"]: r["rank"] for r in plain})
        gone = dice.choice(sorted(now))
        del now[gone]
        changed = dice.choice(sorted(now))
        now[changed] = "fresh " + now[changed]
        now[f"new{step}"] = "alpha fresh"
    # A change writes a segment of its own, not the whole index.
    assert min(written[1:]) <= 2 and len(index.store.transaction().entries) < 12
    index.update(spark.createDataFrame([("x", "omega")], "id string, title string"), spark.createDataFrame([("new0",)], "id string"))
    assert {r["id"] for r in index.search("omega").collect()} == {"x"} and "new0" not in {r["id"] for r in index.search("fresh").collect()}
