"""Random strings of letters alone are secrets; long ordinary words are not."""

import random
import string

from storyline.llm import secret_scan

WORDS = "the quick brown fox jumps over a lazy dog while many long identifier names are plain and ordinary but something is kept internationalization responsibility characteristically misunderstanding telecommunications".split()
ORDINARY = ["internationalization", "characteristically", "misunderstanding_of_it", "telecommunications", "somethingordinarybutlongandplain", "OverResponsibilityNames", "1234567890123456"]


def test_letters_only_runs(spark):
    dice = random.Random(3)
    plain = [(k, " ".join(dice.choices(WORDS, k=200))) for k in range(60)]
    model = secret_scan.train(spark.createDataFrame(plain, "doc_id long, text string"))
    for alphabet in (string.ascii_letters, string.ascii_lowercase):
        for n in (20, 32, 40):
            runs = ["".join(dice.choices(alphabet, k=n)) for _ in range(200)]
            assert sum(model.spans(f"see {r} here", []) == [(4, 3, 4 + n)] for r in runs) >= 190, (alphabet[:3], n)
    assert [w for w in ORDINARY if model.spans(w, [])] == []
    key = "".join(dice.choices(string.ascii_letters, k=32))
    assert secret_scan._redacted(f"key {key} leaks", model, "[SECRET]") == "key [SECRET] leaks"
