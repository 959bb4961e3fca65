"""The pipeline's near-duplicate stage against brute force: five-word shingles, similarity 0.8."""

import random

import corpus_pipeline
from storyline.llm import shingles as module, simhash
from tests.llm.test_llm import SCHEMA, brute_components


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_near_copies_from_four_fifths_on(spark):
    dice = random.Random(7)
    vocabulary = ["".join(dice.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows = []
    for group in range(40):
        words = dice.choices(vocabulary, k=248)
        rows.append((10 * group, " ".join(words)))
        for copy in range(1, 4):
            changed = list(words)
            for at in dice.sample(range(248), dice.randint(1, 7)):
                changed[at] = dice.choice(vocabulary)
            rows.append((10 * group + copy, " ".join(changed)))
    words = dice.choices(vocabulary, k=248)
    rows += [(1000, " ".join(words))]
    for copy in range(90):  # one large group, whose members are near the original but hardly each other
        changed = list(words)
        for at in dice.sample(range(0, 248, 6), 5):
            changed[at] = dice.choice(vocabulary)
        rows.append((1001 + copy, " ".join(changed)))
    rows += [(2000, None), (2001, " \n"), (2002, "one two"), (2003, "One  two"), (2004, "one three"), (None, "no id"), (None, "no id"), (None, rows[0][1]), (0, rows[0][1])]
    dice.shuffle(rows)
    sets = [shingles(t) for _, t in rows]

    def similar(a, b):
        x, y = sets[a], sets[b]
        return not x and not y or 5 * len(x & y) >= 4 * len(x | y)

    labels = brute_components([k for k, _ in rows], similar)
    docs = spark.createDataFrame([(k, t, "en", "s", None, "clash") for k, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    found = [r["doc_id"] for r in kept.collect()]
    assert sorted(k for k in found if k is not None) == sorted({c for c in labels if c is not None})
    assert found.count(None) == 1
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_simhash_finds_links_that_sets_confirm(spark):
    """SimHash with Golay keys alone: all links within 3 bits join, and no pair below four fifths does."""
    dice = random.Random(9)
    rows = []
    for group in range(30):
        words = dice.choices([f"w{k}" for k in range(2000)], k=900)
        for copy in range(3):
            changed = list(words)
            for at in dice.sample(range(900), copy):
                changed[at] = "other"
            rows.append((10 * group + copy, " ".join(changed)))
    # Few distinct shingles, unlike numbers of repeats: one majority, sets far apart.
    rows += [(1000, "a b c d e " * 50), (1001, "a b c d e " * 50 + " ".join(f"x{k}" for k in range(9)))]
    docs = spark.createDataFrame([(k, t, "en", "s", None, "clash") for k, t in rows], SCHEMA).repartition(3)
    marked = module._with_set(docs, "_set").localCheckpoint()
    of = {r["doc_id"]: (r["_set"], r["_set_fp"] % (1 << 64)) for r in marked.collect()}
    assert all(fp == simhash._fingerprint(t.encode().split(), module.WIDTH) for (k, t), fp in ((r, of[r[0]][1]) for r in rows))
    found = {frozenset((r["a"], r["b"])) for r in module._near_prints(marked, "_set").collect()}
    sets = {of[k][0]: shingles(t) for k, t in rows}
    assert found and all(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in map(tuple, found))
    near = [(k, j) for k, _ in rows for j, _ in rows if k < j and (of[k][1] ^ of[j][1]).bit_count() <= 3 and of[k][0] != of[j][0]]
    near = [(k, j) for k, j in near if 5 * len(sets[of[k][0]] & sets[of[j][0]]) >= 4 * len(sets[of[k][0]] | sets[of[j][0]])]
    labels = brute_components(sorted(of), lambda x, y: frozenset((of[sorted(of)[x]][0], of[sorted(of)[y]][0])) in found)
    assert near and all(labels[sorted(of).index(k)] == labels[sorted(of).index(j)] for k, j in near)


def test_texts_are_not_dealt_out_whole(spark):
    """Only texts that others are like leave their place: shuffles stay below the texts' own bytes."""
    dice = random.Random(11)
    rows = [(k, " ".join(f"{dice.getrandbits(40):x}" for _ in range(1500)), "x", k) for k in range(200)]
    rows += [(1000, f"{rows[0][1]} more", "x", 1), (1, rows[1][1], "w", 2), (None, "alone", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string, bucket long").repartition(4).localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        executors = store.executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        found = module.keep_one(docs).collect()
        after = written()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(map(tuple, found), key=str) == sorted((r for r in rows if r[0] != 1000 and r != rows[1]), key=str)
    assert after - before < sum(len(r[1]) for r in rows) // 2
