"""Repeated passages against plain loops over every string, with periodic, copied, null and very long texts."""

import random

import numpy as np
import pytest

from storyline.llm import passages

SCHEMA = "doc_id long, text string, block int, spans string, data binary"  # clash with inner names


def brute(docs):
    rows = [(k, passages.LAST if k is None else k, (text or "").encode()) for k, text in docs]
    first = {}
    for _, key, data in rows:
        for i in range(len(data) - 49):
            s = data[i : i + 50]
            first[s] = min(first.get(s, key), key)
    out = []
    for k, key, data in rows:
        covered = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < key:
                covered[i : i + 50] = True
        spans, edge = [], np.flatnonzero(np.diff(np.r_[False, covered]))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            spans.append((a, b))
        out.append((k, len(data), spans, bytes(np.frombuffer(data, np.uint8)[~covered[:-1]])))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in passages.repeated(df).collect()), key=str)


def documents(seed):
    dice = random.Random(seed)
    prose = ["".join(dice.choices("abcdefgh é", k=dice.randint(60, 400))) for _ in range(30)]
    docs = [(k, text) for k, text in enumerate(prose)]
    for k in range(100, 160):
        a, b = dice.choice(prose), dice.choice(prose)
        cut = a[dice.randint(0, len(a) // 2) :][: dice.randint(40, 160)]
        docs.append((k, "".join(dice.choices("xyz ", k=dice.randint(0, 80))) + cut + dice.choice(["", "#"]) + b[: dice.randint(0, len(b))]))
    docs += [(200 + k, "-" * n + tail) for k, (n, tail) in enumerate([(49, ""), (50, ""), (51, "x"), (500, ""), (130, "y"), (3000, "z")])]
    docs += [(300 + k, "ab" * n) for k, n in enumerate([25, 40, 300])] + [(400, "abcab" * 100), (401, "abcab" * 90 + "q")]
    docs += [(500, None), (501, ""), (None, prose[3]), (None, prose[4] + "!"), (3, prose[3]), (3, prose[5]), (502, prose[7]), (502, prose[7]), (-4, prose[8])]
    return docs


@pytest.mark.parametrize("block, part, size", [(4 << 20, 64, 2 << 20), (900, 3, 300)])
def test_against_plain_loops(spark, monkeypatch, block, part, size):
    for name, value in (("BLOCK_BYTES", block), ("LEAST_PARTS", part), ("SLICE_BYTES", size)):
        monkeypatch.setattr(passages, name, value)
    docs = documents(block)
    df = spark.createDataFrame([(k, text, 1, "s", b"d") for k, text in docs], SCHEMA).repartition(4)
    assert found(df) == brute(docs)


def test_long_text_and_empty_table(spark):
    dice = random.Random(9)
    long = "".join(dice.choices("abcdefghijklmnop ", k=300_000))
    docs = [(1, long), (2, long[1000:200_000] + "!" + long[250_000:]), (3, "x" + long[5:70])]
    (one, two, three) = found(spark.createDataFrame(docs, "doc_id long, text string"))
    assert one[2] == [] and len(one[3]) == 300_000
    assert two[2] == [(0, 199_000), (199_001, 249_001)] and two[3] == b"!"
    assert three[2] == [(1, 66)] and three[3] == b"x"
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
