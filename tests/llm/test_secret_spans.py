"""Secret spans against the patterns as stated and a plain loop over characters, and recall by alphabet."""

import random
import string

import pytest
from pyspark.sql import functions as F

from storyline.llm import queries, secret_scan

from .test_llm import base_of

PLAIN = "the quick brown fox jumps over a lazy dog while many long identifier names are plain and ordinary but something is kept 2024 17 "


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.train(spark.createDataFrame([(k, PLAIN * 20) for k in range(5)], "doc_id long, text string"))


def plain_spans(text, model):
    """All spans, character by character: a run is what lies between characters that no run holds or a base span covers."""
    base = secret_scan.base_spans(text)
    covered = {k for start, _, end, *_ in base for k in range(start, end)}
    found, at = [s[:3] for s in base], 0
    for k in range(len(text) + 1):
        # The run must be long enough before base spans take their part, and after.
        if k < len(text) and text[k] in secret_scan.ALPHABET:
            continue
        if k - at >= 16:
            part = at
            for j in range(at, k + 1):
                if j == k or j in covered:
                    if j - part >= 16 and model.random(text[part:j]):
                        found.append((part, 3, j))
                    part = j + 1
        at = k + 1
    return ",".join(f"{secret_scan.KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(found))


def test_spans_equal_plain_loops(spark, model):
    dice = random.Random(4)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", ":", "=", " = ", '"', "'", "AKIA", "AKIA" + "Z9" * 7, "0123456789abcdef" * 2, "é", " ", "\n", "ordinaryname", "-", "_"]
    texts = []
    for k in range(600):
        words = [dice.choice([*parts, "".join(dice.choices(string.ascii_letters + string.digits, k=dice.randint(1, 40)))]) for _ in range(dice.randint(0, 14))]
        texts.append((k, "".join(words)))
    texts += [(700, "x" * 400_000 + " " + "Zq8" * 30), (None, "token=abcdefgh1"), (701, "token=" + "aB3dE6gH9" * 40_000), (5, texts[5][1])]
    rows = spark.createDataFrame([(k, t, 1, "n") for k, t in texts], "doc_id long, text string, n_hex long, spans string")
    found = secret_scan.find_secrets(rows, model).collect()
    by = sorted((str(r["doc_id"]), r["base_spans"], r["spans"]) for r in found)
    assert by == sorted((str(k), base_of(t), plain_spans(t, model)) for k, t in texts)
    for r in found:
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == len([x for x in r["base_spans"].split(",") if x])


@pytest.mark.parametrize(
    ("alphabet", "length", "least"),
    [(string.ascii_letters + string.digits, 32, 0.99), (string.ascii_letters, 32, 0.99), (string.ascii_lowercase, 32, 0.95), (secret_scan.ALPHABET, 40, 0.99), (string.ascii_uppercase + string.digits, 24, 0.95)],
)
def test_recall_by_alphabet(model, alphabet, length, least):
    dice = random.Random(7)
    keys = ["".join(dice.choices(alphabet, k=length)) for _ in range(500)]
    assert sum(model.random(k) for k in keys) >= least * len(keys)


def test_ordinary_names_are_left_alone(model):
    dice = random.Random(8)
    words = PLAIN.split()[:-2]
    for sign in ("", "_", "-", "/"):
        for _ in range(200):
            name = sign.join(dice.choices(words, k=6))
            assert not model.random(name), name


def test_query_over_whole_table(spark, tmp_path):
    rows = [(1, PLAIN * 40), (2, "my token=abcdefgh9 ok " + PLAIN), (3, None), (4, ""), (None, "AKIA" + "B7" * 8)]
    spark.createDataFrame([(k, t, "en", 1) for k, t in rows], "doc_id long, text string, lang string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    own = secret_scan.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    found = queries.op4_secret_scans(spark, str(tmp_path)).collect()
    expected = sorted((str(k), secret_scan.base_digest(base_of(t or "")), plain_spans(t or "", own)) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"], r["spans"]) for r in found) == expected
    assert spark.createDataFrame([("",)], "s string").select(F.sha2("s", 256)).first()[0] == secret_scan.base_digest("")
