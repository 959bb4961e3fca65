"""Clashing column names, map columns, repeated rows and very large values."""

import random

import numpy as np
import pytest

from storyline.llm import packing, shingles, simhash, vectors

CLASHING = "doc_id long, text string, _chosen long, chosen long, chosen_id long, own_id long, _row string, row long, json string, _set long, set_keys string, fp long, _chosen_fp long, tags map<string,int>"


@pytest.mark.parametrize("keep", [shingles.keep_one, simhash.keep_one])
def test_keep_one_with_clashing_names_and_maps(spark, keep):
    dice = random.Random(2)
    text = " ".join("".join(dice.choices("abcdefgh", k=5)) for _ in range(60))
    other = " ".join("".join(dice.choices("abcdefgh", k=5)) for _ in range(60))
    rows = [(4, text), (2, text), (2, text), (9, other), (None, other), (None, None)]
    made = [(k, t, 1, 2, 3, 4, "r", 5, "j", 6, "k", 7, 8, {"a": n}) for n, (k, t) in enumerate(rows)]
    kept = keep(spark.createDataFrame(made, CLASHING)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [2, 9, None]
    assert all(r["_chosen"] == 1 and r["row"] == 5 and len(r["tags"]) == 1 for r in kept)
    assert next(r["tags"]["a"] for r in kept if r["doc_id"] == 2) == 1


def test_pack_keeps_columns_of_its_own_names(spark):
    rows = spark.createDataFrame([(100, "mine", 1, 2, 3, 4), (50, "yours", 5, 6, 7, 8)], "length long, _row string, _slice long, _base long, _n long, _rank long")
    assert sorted(tuple(r)[:6] for r in packing.pack(rows, 200).collect()) == [(50, "yours", 5, 6, 7, 8), (100, "mine", 1, 2, 3, 4)]


def plain_top(rows, k=20):
    """Scores in whole numbers, those past a long at its end."""
    usable = {i: [int(np.floor(64 * float(x))) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and v}
    out = []
    for q, a in usable.items():
        if q % 20 == 0:
            scored = []
            for c, b in usable.items():
                if c != q and len(a) == len(b):
                    scored.append((-max(-vectors.MOST_SCORE, min(vectors.MOST_SCORE, sum(x * y for x, y in zip(a, b, strict=True)))), c))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_large_components(spark):
    dice = random.Random(4)
    rows = [(20, [1e9]), (21, [1.0]), (40, [-3.0]), (41, [1e16]), (42, [-1e16]), (60, [1e16]), (61, [float("nan")]), (62, [None]), (63, None), (80, [float("inf")])]
    rows += [(k, [dice.choice([1, -1]) * dice.random() * 10 ** dice.randint(0, 9) for _ in range(3)]) for k in range(100, 180)]
    rows += [(200, [1e200, 1.0, 0.0]), (201, [1e200, -1e200, 5.0]), (202, [0.0, 1e6, 1e-3])]
    found = vectors.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in found.collect()) == plain_top(rows)


def test_products_at_every_width():
    dice = np.random.default_rng(3)
    for scale in (10, 1e4, 1e8, 3e9, 1e12, 1e18):
        a, b = (np.floor(dice.normal(0, scale, (6, 5))) for _ in range(2))
        bound = float(np.sqrt((a * a).sum(1).max() * (b * b).sum(1).max()))
        whole = [[max(-vectors.MOST_SCORE, min(vectors.MOST_SCORE, sum(int(x) * int(y) for x, y in zip(r, s, strict=True)))) for s in b.tolist()] for r in a.tolist()]
        assert vectors._products(a, b, bound).tolist() == whole
