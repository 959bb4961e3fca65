"""Recall of links by the forest, at planted cosines, against every pair in double precision."""

import numpy as np
import pytest

from storyline.llm import vectors


@pytest.mark.parametrize("cosine", [0.901, 0.92, 0.97])
def test_recall_of_links(spark, cosine):
    dice = np.random.default_rng(int(cosine * 1000))
    x = dice.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = dice.standard_normal((3000, 64))
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(1 - cosine**2) * away
    every = np.vstack([x, y]) * dice.uniform(0.5, 2, (6000, 1))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(every)], "vec_id long, embedding array<double>")
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    # Small leaves: as deep as trees of a hundred times the rows with leaves of production size.
    rows = vectors.near_duplicate_vectors(table, leaf=64).collect()
    found = {r["vec_id"]: r["n_links"] for r in rows}
    links = near.sum(1)
    assert links.sum() >= 6000 and all(found[k] <= links[k] for k in found)
    recall = sum(found.values()) / links.sum()
    print(f"recall of links at cosine {cosine}: {recall:.4f}")
    assert recall >= 0.97
