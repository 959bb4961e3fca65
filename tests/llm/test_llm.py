"""The training-data operators against brute force, on small tables with nulls, ties, empties and repeats."""

import hashlib
import importlib.util
import math
import os
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from storyline.llm import chat, lm, packing, queries, secret_scan, sentencepiece_viterbi, simhash, toxicity, vectors, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"  # fp clashes with an inner name
needs_tokenizers = pytest.mark.skipif(not (os.environ.get("STORYLINE_TOKENIZERS") or importlib.util.find_spec("public_tokenizers")), reason="no tokenizer files")


def prose(dice, n):
    return " ".join("".join(dice.choices(["the", "on", "er", "ing", "st", "ra", "é"], k=dice.randint(1, 4))) + dice.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(5)
    out = [(k, prose(dice, dice.randint(0, 120))) for k in range(80)]
    long = prose(dice, 9000)
    out += [(100, None), (101, ""), (102, "   \n\t"), (103, "one"), (104, "Two words"), (105, long), (106, long), (107, long.replace("ra", "RA", 1)), (None, "null id here now"), (3, out[3][1]), (3, out[3][1])]
    out += [(108, "it's  odd \x1c sep… «q» Ñ J̌ <|ENDOFTEXT|> Σς."), (109, "x" * 5000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", None, "clash") for k, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@needs_tokenizers
def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    expected = Counter()
    for k, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expected[k, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    found = packing.pack_documents(docs, path).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= math.ceil(sum(r["length"] for r in found) / 4096) + 1
    assert packing.pack_documents(empty, path).count() == 0
    sliced = packing.pack(packing.token_pieces(docs, path), slice_rows=3).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in sliced}) == len(found) and len({r["sequence_id"] for r in sliced}) == len(places)


@needs_tokenizers
def test_chunk_encoder_equals_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        encoder = packing.ChunkEncoder(file.read())
    dice = random.Random(6)
    parts = [*"abzABZéÉßàíÿ÷×ñ019.,'\"!?-_ \t\n\x1c\u00a0\u0301…日", "'s", "'ll", "the", "<|endoftext|>", "word", "...", "İ", "K"]
    texts = ["".join(dice.choices(parts, k=dice.randint(0, 25))) for _ in range(4000)]
    for _ in range(2):
        ids, ends = encoder.encode(pa.array([t.encode() for t in texts], pa.binary()))
        found = [x.tolist() for x in np.split(ids, ends)[:-1]]
        assert found == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def least_sequences(counts, capacity):
    """Martello and Toth's lower bound: two pieces longer than half share no sequence, and the gaps beside them hold only so much."""
    size, best = np.arange(capacity + 1), 0
    for k in range(capacity // 2 + 1):
        alone, large = counts[size > capacity - k].sum(), counts * ((size > capacity // 2) & (size <= capacity - k))
        small = counts * ((size <= capacity // 2) & (size >= k))
        rest = (small * size).sum() - (large.sum() * capacity - (large * size).sum())
        best = max(best, int(alone + large.sum() + max(0, -(-rest // capacity))))
    return best


def test_packing_plan_places_everything():
    dice = np.random.default_rng(2)
    for capacity in (8, 64, 1000):
        counts = np.zeros(capacity + 1, np.int64)
        counts[1:] = dice.integers(0, 50, capacity)
        plan = packing.packing_plan(counts, capacity)
        placed = np.zeros_like(counts)
        for times, parts in plan:
            assert sum(x * n for x, n in parts) <= capacity
            for x, n in parts:
                placed[x] += times * n
        assert (placed == counts).all()
        assert sum(t for t, _ in plan) <= 1.01 * least_sequences(counts, capacity) + 1
    # Pieces that go together exactly: singles, pairs and triples fill whole sequences.
    exact = np.zeros(101, np.int64)
    for parts in ((100,), (61, 39), (50, 27, 23), (97, 2, 1)):
        exact[list(parts)] += 7
    assert sum(t for t, _ in packing.packing_plan(exact, 100)) == 28
    skewed = np.zeros(4097, np.int64)
    skewed[3], skewed[4000] = 10**9, 5
    assert sum(t * n for t, p in packing.packing_plan(skewed, 4096) for x, n in p if x == 3) == 10**9


def brute_components(ids, linked):
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [least.get(top(k)) for k in range(len(ids))]


def test_golay_keys_meet_within_three_bits():
    dice = random.Random(1)
    pairs = []
    for _ in range(3000):
        a = dice.getrandbits(64)
        b = a
        for bit in dice.sample(range(64), dice.randint(1, 3)):
            b ^= 1 << bit
        pairs.append((a, b))
    fps = np.array(pairs, np.uint64).ravel().view(np.int64)
    keys, who, probe = simhash.fuzzy_keys(fps)
    buckets = {}
    for key, w, p in zip(keys.tolist(), who.tolist(), probe.tolist(), strict=True):
        buckets.setdefault(w, {})[key] = p
    for k in range(0, len(fps), 2):
        shared = buckets[k].keys() & buckets[k + 1].keys()
        assert any(not (buckets[k][s] and buckets[k + 1][s]) for s in shared)


def test_bucket_links_at_every_bit():
    dice = random.Random(2)
    for size in (2, 3, simhash.LARGE_BUCKET + 1):
        for bit in range(64):
            base = dice.getrandbits(64)
            near = {base, base ^ 1 << bit} | {base ^ ((1 << 64) - 1) ^ k for k in range(size - 2)}
            fp = np.array(sorted(near), np.uint64).view(np.int64)
            links = set()
            for a, b in simhash._bucket_links(fp, np.zeros(len(fp), bool), np.array([0]), np.array([len(fp)]), 3):
                assert 0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
                links.add(frozenset((a & (1 << 64) - 1, b & (1 << 64) - 1)))
            assert frozenset((base, base ^ 1 << bit)) in links


def test_simhash(docs, empty, rows):
    from xxhash import xxh64_intdigest

    def fingerprint(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
        shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(t) for _, t in rows]
    labels = brute_components([k for k, _ in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    expected = Counter((k, f"{p:016x}", c) for (k, _), p, c in zip(rows, prints, labels, strict=True))
    assert Counter(tuple(r) for r in simhash.simhash_components(docs).collect()) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # A group whose rows lack ids keeps one row all the same.
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({c for c in labels if c is not None})
    assert kept.where("doc_id is null").count() == 1
    assert simhash.simhash_components(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_large_bucket_is_joined():
    dice = random.Random(4)
    base = dice.getrandbits(64)
    fps = np.array(sorted({base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}), np.uint64).view(np.int64)
    forest = simhash._Forest()
    n = len(fps)
    joined = [p for p in simhash._bucket_links(fps, np.zeros(n, bool), np.array([0]), np.array([n]), 3) if forest.join(*p)]
    assert len(joined) == n - 1


def test_secrets(spark, docs, empty):
    dice = random.Random(9)
    random_run = "".join(dice.choices(string.ascii_letters + string.digits, k=32))
    texts = [
        (1, 'é token = "abcdefgh1" then Password: short and API_KEY=12345678'), (2, "AKIA" + "B7" * 8 + " " + "0a" * 16), (3, "token: secret: abcdefghij"),
        (4, f"send {random_run} now"), (5, "somethingordinarybutlongandplain a_long_identifier_name 4836077759563273"), (6, None), (7, ""), (1, "passwd=" + "q" * 8),
    ]
    plain = "the quick brown fox jumps over a lazy dog while many long identifier names are plain and ordinary but something is kept 48360777 59563273 1402 "
    model = secret_scan.train(spark.createDataFrame([(k, plain * 20) for k in range(5)] + [(9, None)], "doc_id long, text string"))
    found = secret_scan.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    first = next(r for r in by[1] if r["n_assign"] == 2)
    assert first["base_spans"] == "assign:2:20,assign:47:63" and base_of(texts[0][1]) == first["base_spans"]
    assert by[2][0]["base_spans"] == "access:0:20,hex:21:53"
    assert by[3][0]["n_assign"] == 0
    assert by[4][0]["n_markov"] == 1 and by[4][0]["spans"] == f"markov:5:{5 + 32}"
    assert by[5][0]["spans"] == "" and by[6][0]["spans"] == "" and by[7][0]["spans"] == ""
    assert hashlib.sha256(first["base_spans"].encode()).hexdigest() == secret_scan.base_digest(first["base_spans"])
    assert secret_scan.find_secrets(empty).count() == 0
    masked = secret_scan.redact(docs.sparkSession.createDataFrame([(1, "my token=abcdefgh9 ok", 1), (2, None, 7)], "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in masked] == [(1, "my token=[SECRET] ok", 20), (2, None, 7)]


def base_of(text):
    """Base spans straight from the patterns as they are stated."""
    found = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m.group()) >= least]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_levenshtein_trie_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    dice = random.Random(8)
    terms = ["stupid", "worthless", "disgusting", "idiot", "mad"]
    trie = toxicity.Trie(terms)
    for _ in range(4000):
        word = list(dice.choice(terms))
        for _ in range(dice.randint(0, 3)):
            at = dice.randrange(len(word) + 1)
            word[at : at + dice.randint(0, 1)] = dice.choice(["", "x", "i", "s"])
        word = "".join(word)
        assert trie.within(word) == any(0 < distance(word, t) <= toxicity.edits(t) for t in terms), word
    stems = toxicity.Trie(["stupid*", "mad*", "idiotic"])
    for word, near in (("stupod", True), ("stupodness", True), ("tupidity", True), ("stupid", False), ("stup", False), ("madx", False), ("idiotik", True), ("idxotikx", False)):
        assert stems.within(word) == near, word


def test_toxicity(spark, empty):
    dice = random.Random(3)
    insults = ["stupid", "idiot", "worthless"]
    data, labels = [], []
    for k in range(400):
        words = prose(dice, 40).split()
        if k % 4 == 0:
            for _ in range(3):
                words.insert(dice.randrange(len(words)), dice.choice(insults))
        data.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    extra = [(1000, "they are a stupld woman and an idi0t here"), (1001, None), (1002, ""), (None, "plain words"), (1003, "x" * 200_000)]
    docs = spark.createDataFrame(data + extra, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(5, None), (None, 1), (1, 0), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.training_labels(known))
    assert set(insults) <= set(model.terms)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all((score[k] >= toxicity.THRESHOLD) == (k % 4 == 0) for k in held)
    assert score[1000] > score[1002] and score[1001] == score[1002] and all(0 <= s <= 1 for s in score.values())
    reader = toxicity.Reader(["stupid"], frozenset(), {})
    quoted, direct = reader.features('she said "you stupid" today'), reader.features("oh you stupid thing")
    assert quoted[0] == 0 and quoted[1] > 0 and direct[0] > 0 and direct[1] == 0
    for text, inside in (('a "b stupid c" d', 1), ('"a" stupid "b"', 0), ('a "stupid" b', 1), ('say «stupid thing»', 1), ('"stupid but never closed', 0), ('closed stupid" only', 0)):
        assert (reader.features(text)[1] > 0) == inside, text
    # The query's result by a plain reading of each text with the model that it learned.
    plain = toxicity.Reader(list(model.terms), model.ordinary, model.context)
    for k, text in [*data, *extra]:
        assert score[k] == pytest.approx(float(model.probability(np.array([plain.features(text or "")]))[0]))
    # Windows that report are told from windows that abuse by what the labels say.
    told = [(k, " ".join([*prose(dice, 5).split(), *(["moderators", "removed", "stupid", "comment"] if k % 2 else ["shut", "up", "stupid", "fool"]), *prose(dice, 5).split()]), 1 - k % 2) for k in range(300)]
    frame = spark.createDataFrame(told, "doc_id long, text string, toxic int")
    weights = toxicity._context(frame, ["stupid"], frozenset())
    assert weights["removed"] < toxicity.QUOTING and weights["shut"] > 1
    assert toxicity.Reader(["stupid"], frozenset(), weights).features("moderators removed stupid comment")[1] > 0
    # Of rows that share an id one is learned from.
    many = docs.unionByName(spark.createDataFrame([(0, "stupid " * 3)] * 50, "doc_id long, text string"))
    assert toxicity.train(many, toxicity.training_labels(known)).terms
    assert toxicity.score(empty.select("doc_id", "text"), model).count() == 0
    assert toxicity.train(empty, known).terms == ()


def tokens_of(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())), b""]


class PlainModel:
    """The backoff automaton walked token by token: arcs of states, failure arcs, and the state that is carried."""

    def __init__(self, texts):
        self.counts = Counter()
        for own in texts:
            for n in (1, 2, 3):
                self.counts.update(tuple(own[k : k + n]) for k in range(len(own) - n + 1))
        self.tokens = sum(c for g, c in self.counts.items() if len(g) == 1)
        self.total = self.tokens + sum(len(g) == 1 for g in self.counts) + 1

    def arc(self, state, word):
        """Weight of a state's arc; of the root every word has one."""
        below = (self.counts[(word,)] + 1) / self.total
        for n in range(1, len(state) + 1):
            history = state[-n:]
            m = lm.WEIGHTS[n - 1]
            below = (self.counts[(*history, word)] + m * below) / (self.counts[history] + m)
        return below

    def score(self, own):
        state, sum_ = (), 0.0
        for word in own:
            while state and not self.counts[(*state, word)]:
                m = lm.WEIGHTS[len(state) - 1]
                sum_ += math.log10(m / (self.counts[state] + m))
                state = state[1:]
            sum_ += math.log10(self.arc(state, word))
            state = (*state, word)[-2:]
            while state and not self.counts[state]:
                state = state[1:]
        return sum_


def test_language_model(spark, docs, empty, rows, monkeypatch):
    tokens = [(k, tokens_of(t)) for k, t in rows]
    trained = [own for k, own in tokens if zlib.crc32(("" if k is None else str(k)).encode()) % 7 != 2]
    model = PlainModel(trained)
    counts, n = model.counts, model.tokens
    expected = sorted(
        (len(own), sum(counts[(w,)] > 0 for w in own), round(sum(math.log10((counts[(w,)] + 1) / model.total) for w in own), 6), round(model.score(own), 6))
        for _, own in tokens
    )
    for size, tokens_at_once in ((lm.BLOCK_BYTES, lm.AUTOMATON_TOKENS), (2000, 100)):
        monkeypatch.setattr(lm, "BLOCK_BYTES", size)
        monkeypatch.setattr(lm, "AUTOMATON_TOKENS", tokens_at_once)
        found = lm.score(docs).collect()
        assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in found) == expected
        assert {r["train_tokens"] for r in found} == {n}
        assert Counter(r["doc_id"] for r in found) == Counter(k for k, _ in rows)
    assert lm.score(empty).count() == 0
    trained_id = next(k for k in range(9) if zlib.crc32(str(k).encode()) % 7 != 2)
    alone = spark.createDataFrame([(trained_id, None, 0)], "doc_id long, text string, train int")
    assert [(r["n_tokens"], r["score"]) for r in lm.score(alone).collect()] == [(1, pytest.approx(math.log10(2 / 3)))]
    # Each state's probabilities, unseen words as one, sum to one.
    words = [g[0] for g in counts if len(g) == 1]
    dice = random.Random(1)
    for state in [(), *dice.sample([g for g in counts if len(g) < 3 and g[-1]], 12)]:
        assert sum(model.arc(state, w) for w in [*words, b"never seen"]) == pytest.approx(1)


def test_byte_planes():
    dice = np.random.default_rng(1)
    for top in (1, 300, 1 << 40, (1 << 64) - 1):
        for n in (0, 1, 1000):
            values = dice.integers(0, top, n, np.uint64, endpoint=True)
            assert (lm._got(lm._put(values)) == values).all()


def test_near_duplicate_vectors(spark):
    dice = np.random.default_rng(1)
    x = dice.standard_normal((300, 16))
    x[200:260] = x[:60] + 0.1 * dice.standard_normal((60, 16))
    x[260:300] = x[0]
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 2.0]), (905, []), (7, x[7].tolist())]
    table = spark.createDataFrame([(k, v, 1, 2) for k, v in data], "vec_id long, embedding array<double>, label int, leaf int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.vstack([unit, np.zeros((6, 16)), unit[7]])
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    labels = brute_components([k for k, _ in data], lambda a, b: near[a, b])
    expected = Counter((k, int(near[i].sum()), labels[i], labels[i] == k) for i, (k, _) in enumerate(data))
    assert Counter(tuple(r) for r in vectors.near_duplicate_vectors(table).collect()) == expected
    small = vectors.near_duplicate_vectors(table, leaf=32, trees=8).collect()
    links = {r["vec_id"]: r["n_links"] for r in small}
    apart = [i for i in range(300) if i not in range(260, 300) and i != 0]  # the group of copies would hide what is missed elsewhere
    assert sum(min(links[i], 1) for i in apart) >= 0.9 * sum(bool(near[i].any()) for i in apart)
    assert vectors.near_duplicate_vectors(table.limit(0)).count() == 0


def test_exact_top_k(spark):
    dice = np.random.default_rng(2)
    x = dice.standard_normal((260, 8)).astype(np.float32)
    x[100:200] = x[0]
    data = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(300, None), (320, [float("inf")] * 8), (40, [float(c) for c in x[40]])]
    table = spark.createDataFrame([(k, v, 0) for k, v in data], "vec_id long, embedding array<float>, rank int").repartition(3)
    usable = [(k, np.floor(64 * np.array(v, float)).astype(int)) for k, v in data if v is not None and np.isfinite(v).all()]
    expected = Counter()
    for i, (q, a) in enumerate(usable):
        if q % 20 == 0:
            best = sorted((-int(a @ b), c) for j, (c, b) in enumerate(usable) if j != i)[:20]
            expected.update((q, rank, c, -s) for rank, (s, c) in enumerate(best, 1))
    assert Counter(tuple(r) for r in vectors.exact_top_k(table).collect()) == expected
    assert vectors.exact_top_k(table.limit(0)).count() == 0
    few = vectors.exact_top_k(spark.createDataFrame([(20, [1e6]), (21, [1.0]), (22, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(20, 1, 22), (20, 2, 21)]
    assert Counter(tuple(r) for r in vectors.exact_top_k(table, wave_bytes=400).collect()) == expected
    odd = spark.createDataFrame([(20, []), (None, [1.0]), (40, [1.0, 2.0]), (41, [3.0, 1.0]), (60, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.exact_top_k(odd).collect()] == [(40, 1, 41, 64 * 64 * 5)]
    past = vectors.exact_top_k(spark.createDataFrame([(20, [1e30]), (21, [1.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in past.collect()] == [(20, 1, 21, vectors.MOST_SCORE)]


@needs_tokenizers
def test_sentencepiece(docs, empty, rows):
    path = queries.tokenizer("piece_bpe_32k.model")
    with open(path, "rb") as file:
        model = sentencepiece_viterbi.PieceModel(file.read())
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    dice = random.Random(2)
    texts = [t or "" for _, t in rows] + ["".join(dice.choices([*"abethin \n\t.,é日▁", "  ", "ing", "the", "\U0001f600"], k=dice.randint(0, 14))) for _ in range(2000)]
    for _ in range(2):
        ids, ends = model.encode_all(texts)
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == library.encode(texts)
    assert model.decode_all(ids, ends) == [t.replace("▁", " ").encode() for t in texts]
    assert [model.best(model.normalised(t)) for t in texts[-300:]] == library.encode(texts[-300:])
    # The same pieces read as a unigram model: the best sum of scores.
    model.kind = sentencepiece_viterbi.UNIGRAM
    scores = {own[1]: own[2] for own in model._own if own}

    def value(ids):
        return sum(scores.get(k, model.unknown_score) for k in ids)

    def brute(text):
        best = [0.0] + [-math.inf] * len(text)
        lookup = {model.pieces[k]: s for k, s in scores.items()}
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 48), end):
                if (s := lookup.get(text[start:end])) is not None:
                    best[end] = max(best[end], best[start] + s)
            if text[end - 1] not in lookup:
                best[end] = max(best[end], best[end - 1] + model.unknown_score)
        return best[-1]

    for _ in range(60):
        text = model.normalised(prose(dice, 5))
        assert value(model.best(text)) == pytest.approx(brute(text))
    model.kind = sentencepiece_viterbi.BPE
    for text in ["", " ", "  a   b ", "日本 \n\t x\U0001f600", "a▁b"]:
        assert model.decode(model.encode(text)) == text.replace("▁", " ")
    found = sentencepiece_viterbi.audit(docs, path).collect()
    expected = Counter()
    for k, t in rows:
        own = library.encode(t or "")
        expected[k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), len(t or ""), True] += 1
    assert Counter(tuple(r) for r in found) == expected
    coded = sentencepiece_viterbi.encode(docs, path)
    back = sentencepiece_viterbi.decode(coded, path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((k, t or "") for k, t in rows)
    assert sentencepiece_viterbi.audit(empty, path).count() == 0


def test_chat(spark):
    schema = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi <|x|>"), (1, 1, "assistant", "good"), (2, 0, "user", None), (None, 0, "user", "x"), (3, 0, "user", "only")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "hi <|x|>"), (1, 1, "assistant", "bad one"), (1, 2, "user", "?"), (2, 0, "user", None)], schema)
    found = {r["pair_id"]: r for r in chat.format_preferences(chosen, rejected).collect()}
    assert set(found) == {1, 2, 3}
    one = found[1]
    assert (one["n_common"], one["prompt"]) == (1, "<|user|>\nhi < |x|><|end|>\n")
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n"
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_spans"]] == ["good<|end|>\n"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_spans"]] == ["bad one<|end|>\n"]
    assert found[2]["chosen"] == found[2]["rejected"] == "" and found[2]["n_common"] == 1
    assert found[3]["prompt"] == "" and found[3]["rejected"] == "" and found[3]["chosen_spans"] == []
    assert chat.format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0
    talks = spark.createDataFrame([(4, 0, "user", "q"), (4, 1, "assistant", "a"), (5, 0, "user", "r"), (5, 1, "assistant", "b"), (8, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    pairs = {r["pair_id"]: (r["chosen"], r["rejected"]) for r in chat.format_preferences(*chat.swapped_replies(talks)).collect()}
    assert pairs[4] == ("<|assistant|>\na<|end|>\n", "<|assistant|>\nb<|end|>\n") and pairs[8] == ("", "")


def test_swapped_replies_against_sql(spark, tmp_path):
    import duckdb

    dice = random.Random(5)
    texts = [None, "", "same", "hi <|x|>", "y" * 200_000]
    talks = [(k, t, dice.choice([None, "user", "assistant", "assistant"]), dice.choice(texts[:4])) for k in [None, *range(-3, 12)] for t in [None, *range(dice.randint(0, 9))]]
    talks += [talks[5], talks[5], (20, 0, "assistant", texts[4]), (21, 0, "assistant", "b")]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(path)
    found = queries.op5_chat_formatting(spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS FROM read_parquet('{path}/*.parquet')")
        expected = db.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.SQL['op5_chat_formatting']})").fetchall()
    assert Counter(map(tuple, found.collect())) == Counter(expected)
    assert len({row[1] for row in expected}) > 3


def test_warc(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k}é</p>", 0) for k in range(600)] + [(None, "u", None, 1), (None, None, "h", 1), (5, "http://x/5", "<p>5é</p>", 0)], "page_id long, url string, html string, start int")
    same = warc.audit(pages, pages.repartition(5)).collect()
    assert len(same) == 602 and {r["status"] for r in same} == {"ok"}
    assert [(r["copies"]) for r in same if r["page_id"] == 5] == [2]
    changed = pages.where("page_id <> 300 or page_id is null").withColumn("html", F.when(F.col("page_id") == 17, "bad").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(9999, "n", "n", 0)], pages.schema))
    status = {r["page_id"]: r["status"] for r in warc.audit(pages, changed).collect() if r["status"] != "ok"}
    assert status == {300: "missing", 17: "corrupt", 9999: "extra"}
    first = sorted((r for r in same if r["volume"] == 0), key=lambda r: r["start"])
    at = 0
    for r in first:
        assert r["start"] == at
        at += r["length"] * r["copies"]
    assert warc.audit(pages.limit(0), pages.limit(0)).count() == 0
    assert {r["status"] for r in warc.audit(pages, pages.limit(0)).collect()} == {"missing"}


@needs_tokenizers
@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    docs = [(k, t, "en", "s", len(t or "")) for k, t in rows if k is not None]
    docs += [(2000 + k, f"some stupid idiot text number {k} goes {'on ' * (k % 7)}", "en", "s", 1) for k in range(40)] + [(3000, "the token=abcdefgh12 leaks here", "en", "s", 31)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1 if 2000 <= k < 2040 else 0) for k, *_ in docs]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = current.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == columns, name
        current.write.parquet(f"{tmp_path}/{name}")
        current = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append({r["doc_id"]: r["text"] for r in current.collect()})
    assert not any(2000 <= k < 2040 for k in counts[0]) and {k for k, *_ in docs if k < 2000} <= set(counts[0])
    assert len(counts[1]) == current.count() and 106 not in counts[1] and 105 in counts[1]
    assert counts[2][3000] == "the token=[SECRET] leaks here" and set(counts[2]) == set(counts[1])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(counts[2])


@needs_tokenizers
@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_equals_plain_stages(spark, tmp_path):
    """run() against each stage worked out text by text: scores read plainly, all pairs of shingle sets, the tokenizer itself."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    dice = random.Random(12)
    docs = [(k, prose(dice, dice.randint(0, 80))) for k in range(60)]
    near = prose(dice, 200)
    docs += [(100 + k, " ".join([*near.split()[:-k], *prose(dice, k).split()]) if k else near) for k in (0, 1, 3, 60)]
    docs += [(200 + k, " stupid ".join(prose(dice, 4) for _ in range(4))) for k in range(40)]
    docs += [(300, None), (301, ""), (302, " \n"), (None, "no id but token=abcdefgh12 inside"), (303, "key " + "aZ3kQ9xV7mP2rT8w" * 2 + " end"), (304, "x" * 60_000), (7, docs[7][1]), (305, docs[9][1])]
    labels = [(k, int(200 <= k < 240)) for k, _ in docs if k is not None]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "en", "s", None) for k, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, known = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train(table, toxicity.training_labels(known))
    reader = toxicity.Reader(list(model.terms), model.ordinary, model.context)
    kept = [(k, t) for k, t in docs if model.probability(np.array([reader.features(t or "")]))[0] < toxicity.THRESHOLD]
    assert 0 < len(docs) - len(kept) <= 41

    def shingles_of(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles_of(t) for _, t in kept]
    label = brute_components([k for k, _ in kept], lambda a, b: sets[a] == sets[b] or bool(sets[a] & sets[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    alone = {}
    for (k, t), c in zip(kept, label, strict=True):
        if k == c:
            alone.setdefault((k, c), t)
    kept = [(k, t) for (k, _), t in alone.items()]
    frame = spark.createDataFrame([(k, t, "en", "s", None) for k, t in kept], schema)
    secrets = secret_scan.train(frame)
    whole = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    expected = Counter()
    for k, t in kept:
        ids = [*whole.encode(secret_scan._redacted(t or "", secrets, "[SECRET]"), add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            expected[k, piece, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    nothing = tmp_path / "empty"
    table.limit(0).write.parquet(f"{nothing}/documents.parquet")
    known.limit(0).write.parquet(f"{nothing}/labels.parquet")
    assert corpus_pipeline.run(spark, str(nothing)).count() == 0


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert isinstance(T.StructType(), T.DataType)
