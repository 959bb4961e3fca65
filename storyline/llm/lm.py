"""Language-model scores from a weighted backoff automaton whose arcs are all n-grams of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import durable
from .text import id_remainder, pieces, text_bytes

MODULUS, HELD_OUT = 7, 2
#: Pseudo-counts that a history of one and of two words gives to the shorter history's distribution.
WEIGHTS = (500.0, 20.0)
#: Bytes of text in a block, n-gram tokens aimed at in a part, and the least number of parts.
BLOCK_BYTES, PART_TOKENS, LEAST_PARTS = 6 << 20, 2_000_000, 64
#: Tokens of texts that one automaton is made for; a longer text has one of its own.
AUTOMATON_TOKENS = 1 << 18
#: Bits of an n-gram's hash that choose its part, and bits that tell it from others there.
PART_BITS, KEY_BITS = 23, 40
SEED = 42
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_TRIPLE = np.uint64(0x165667B19E3779F9)

BLOCK_SCHEMA = "n_tokens long, n_train long, ids array<long>, train binary, lengths binary, codes binary, hashes binary"


def _put(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed; planes of nothing but zeros are left out."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max((k + 1 for k in range(8) if planes[k].any()), default=1)
    return len(values).to_bytes(7, "little") + bytes([used]) + pa.compress(np.ascontiguousarray(planes[:used]).tobytes(), codec="zstd", asbytes=True)


def _got(data: bytes) -> np.ndarray:
    """What _put was given, as uint64."""
    n, used = int.from_bytes(data[:7], "little"), data[7]
    planes = np.frombuffer(pa.decompress(data[8:], n * used, codec="zstd", asbytes=True), np.uint8).reshape(used, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u8").reshape(-1)


def _gaps(rising: np.ndarray) -> np.ndarray:
    return np.diff(rising, prepend=np.uint64(0))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a >> np.uint64(31)
    x ^= a
    x *= _FACTORS[0]
    x += b
    x ^= x >> np.uint64(29)
    x *= _FACTORS[1]
    x ^= x >> np.uint64(32)
    return x


def _parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes & np.uint64((1 << PART_BITS) - 1)) % np.uint64(parts)


class Block:
    """Consecutive texts as word codes, with the hashes of their words and n-grams.

    Positions are the tokens of all texts in order, each text's end among them.
    Histories don't reach over the start of a text.
    """

    def __init__(self, lengths: np.ndarray, train: np.ndarray, codes: np.ndarray, hashes: np.ndarray, parts: int) -> None:
        self.lengths, self.codes, self.hashes = lengths, codes, hashes
        self.starts = np.cumsum(lengths) - lengths
        self.train = np.repeat(train, lengths)
        self.second = np.ones(len(codes), bool)
        self.second[self.starts] = False
        self.third = self.second & np.r_[False, self.second[:-1]]
        own = hashes[codes]
        pairs = np.zeros(len(codes), np.uint64)
        pairs[1:] = _mix(own[:-1], own[1:])
        grams = np.concatenate([pairs[self.second], np.zeros(int(self.third.sum()), np.uint64)])
        pairs ^= _TRIPLE
        grams[int(self.second.sum()) :] = _mix(pairs[:-1], own[1:])[self.third[1:]]
        del own, pairs
        #: Each n-gram's part and key, in one number that sorts by part.
        self.grams = _parts_of(grams, parts)
        self.grams <<= np.uint64(KEY_BITS)
        grams >>= np.uint64(64 - KEY_BITS)
        self.grams |= grams
        del grams
        word_parts = _parts_of(hashes, parts)
        self.word_order = np.lexsort((hashes, word_parts))
        self.word_parts = word_parts[self.word_order]
        self.parts = parts

    def questions(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Per part: its words and n-grams as rising hashes, each once, and how often training texts hold them here."""
        trained = np.concatenate([self.train[self.second], self.train[self.third]])
        marked = self.grams << np.uint64(1)
        marked |= trained
        marked.sort()
        grams = marked >> np.uint64(1)
        first = np.flatnonzero(np.diff(grams, prepend=~grams[:1]))
        times = np.add.reduceat(marked & np.uint64(1), first) if len(first) else np.zeros(0, np.uint64)
        grams = grams[first]
        words = self.hashes[self.word_order]
        word_times = np.bincount(self.codes[self.train], minlength=len(words))[self.word_order].astype(np.uint64)
        bounds = np.arange(self.parts + 1, dtype=np.uint64)
        cut, word_cut = np.searchsorted(grams, bounds << np.uint64(KEY_BITS)).tolist(), np.searchsorted(self.word_parts, bounds).tolist()
        keys = grams & np.uint64((1 << KEY_BITS) - 1)
        for part in range(self.parts):
            a, b, c, d = cut[part], cut[part + 1], word_cut[part], word_cut[part + 1]
            if b > a or d > c:
                yield part, _put(_gaps(words[c:d])), _put(_gaps(keys[a:b])), _put(np.concatenate([word_times[c:d], times[a:b]]))

    def answered(self, word_counts: np.ndarray, gram_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each position's word, pair and triple, from the answers to questions() in order; none counts 0."""
        by_word = np.empty(len(self.hashes))
        by_word[self.word_order] = word_counts
        order = np.argsort(self.grams)
        rising = self.grams[order]
        first = np.flatnonzero(np.diff(rising, prepend=~rising[:1]))
        del rising
        each = np.empty(len(order))
        each[order] = np.repeat(gram_counts, np.diff(np.r_[first, len(order)]))
        del order
        pairs, triples, cut = np.zeros(len(self.codes)), np.zeros(len(self.codes)), int(self.second.sum())
        pairs[self.second], triples[self.third] = each[:cut], each[cut:]
        return by_word[self.codes], pairs, triples


class Automaton:
    """The backoff automaton as far as some texts of a block can reach it: states, their arcs and failure arcs as arrays.

    States are histories of up to two words that training texts hold: the root
    (0), one for each word, one for each pair. A state h has an arc for every
    n-gram hw of the corpus, of weight (c(hw) + m P(w | shorter h)) / (c(h) + m)
    with m of WEIGHTS, to the longest history that ends in w; and a failure arc
    to the shorter history of weight m / (c(h) + m), so each state's
    probabilities sum to one. The root has all words by (c + 1) / total, of
    which unseen ones are one. Weights are kept as log10.
    """

    def __init__(self, codes: np.ndarray, second: np.ndarray, third: np.ndarray, n: int, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, total: float, weights: tuple[float, float] = WEIGHTS) -> None:
        """``codes`` are words below ``n``; ``second`` and ``third`` say where a pair and a triple of a text end; the rest are corpus counts of what ends there."""
        count = np.zeros(n)
        count[codes] = words
        # Distinct pairs and triples that the corpus holds, by where they end; a pair is known by two codes, a triple by its pair and a code.
        ends = np.flatnonzero(second & (pairs > 0))
        keys, first, pair_of = np.unique(codes[ends - 1] * n + codes[ends], return_index=True, return_inverse=True)
        own = ends[first]
        state = np.full(len(codes), -1)
        state[ends] = pair_of
        long = np.flatnonzero(third & (triples > 0))
        triple_keys, triple_first = np.unique(state[long - 1] * n + codes[long], return_index=True)
        last = long[triple_first]

        seen = np.flatnonzero(count > 0)
        single = np.zeros(n, np.int64)  # of a word: its state; the root where the corpus has none of it
        single[seen] = np.arange(1, len(seen) + 1)
        base = len(seen) + 1
        root = (count + 1) / total
        by_own = (pairs[own] + weights[0] * root[codes[own]]) / (count[codes[own - 1]] + weights[0])
        by_pair = np.zeros(len(codes))
        by_pair[ends] = by_own[pair_of]
        by_last = (triples[last] + weights[1] * by_pair[last]) / (pairs[last - 1] + weights[1])
        self.root, self.single, self.n = np.log10(root), single, n
        #: Arcs of longer histories, by state and word.
        arcs = np.r_[single[codes[own - 1]] * n + codes[own], (base + state[last - 1]) * n + codes[last]]
        target, weight = np.r_[base + np.arange(len(own)), base + state[last]], np.log10(np.r_[by_own, by_last])
        order = np.argsort(arcs)
        self.arcs, self.target, self.weight = arcs[order], target[order], weight[order]
        #: Failure arcs by state.
        self.shorter = np.r_[0, np.zeros(len(seen), np.int64), single[codes[own]]]
        self.failure = np.log10(np.r_[1.0, weights[0] / (count[seen] + weights[0]), weights[1] / (pairs[own] + weights[1])])

    def walk(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of each text's probability: one traversal from left to right, all texts side by side, each with its own state."""
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        order = np.argsort(-lengths, kind="stable")
        ongoing = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
        for step, left in enumerate(ongoing.tolist()):
            at = order[:left]  # texts with a token at this step
            word, now, sums = codes[starts[at] + step], state[at], total[at]
            open_ = np.arange(left)
            while len(open_):
                # At the root every word has an arc; elsewhere without one the failure arc is taken.
                here, asked = now[open_], word[open_]
                place = np.minimum(np.searchsorted(self.arcs, here * self.n + asked), max(len(self.arcs) - 1, 0))
                hit = (self.arcs[place] == here * self.n + asked) if len(self.arcs) else np.zeros(len(open_), bool)
                by_root = ~hit & (here == 0)
                fails = ~hit & ~by_root
                sums[open_[hit]] += self.weight[place[hit]]
                now[open_[hit]] = self.target[place[hit]]
                sums[open_[by_root]] += self.root[asked[by_root]]
                now[open_[by_root]] = self.single[asked[by_root]]
                open_ = open_[fails]
                sums[open_] += self.failure[now[open_]]
                now[open_] = self.shorter[now[open_]]
            state[at], total[at] = now, sums
        return total


def _path(block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, total: float) -> np.ndarray:
    """log10 of each text's probability, by automata of some texts at a time."""
    out, first = np.zeros(len(block.lengths)), 0
    ends = np.cumsum(block.lengths)
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, block.starts[first] + AUTOMATON_TOKENS, "right")))
        part = slice(int(block.starts[first]), int(ends[last - 1]))
        made = Automaton(block.codes[part], block.second[part], block.third[part], len(block.hashes), words[part], pairs[part], triples[part], total)
        out[first:last] = made.walk(block.codes[part], block.starts[first:last] - part.start, block.lengths[first:last])
        first = last
    return out


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts in blocks of about BLOCK_BYTES: words as codes and what they are hashed to. Columns: BLOCK_SCHEMA."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        from xxhash import xxh3_64_intdigest

        batch = pa.concat_batches(held)
        chunks = pc.ascii_split_whitespace(pc.ascii_lower(batch["data"].view(pa.string())))
        offsets = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        coded = chunks.flatten().view(pa.binary()).dictionary_encode()
        del chunks
        listed, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        word = codes != (listed.index(b"") if b"" in listed else -1)
        lengths = np.diff(np.r_[0, np.cumsum(word)][offsets])
        # No word is empty, so the empty string's hash can be the end's; its code is that after the words'.
        hashes = np.array([*(xxh3_64_intdigest(w, SEED) for w in listed), xxh3_64_intdigest(b"\0end", SEED)], np.uint64)
        used, codes = np.unique(np.insert(codes[word], np.cumsum(lengths), len(listed)), return_inverse=True)
        train = batch["train"].to_numpy(zero_copy_only=False)
        columns = [
            pa.array([len(codes)]), pa.array([int((lengths + 1)[train].sum())]), pa.array([batch["doc_id"]], pa.list_(pa.int64())),
            *(pa.array([x], pa.binary()) for x in (train.tobytes(), _put(lengths + 1), _put(codes), hashes[used].tobytes())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["n_tokens", "n_train", "ids", "train", "lengths", "codes", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces(batches, "data"):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch["data"])).as_py() or 0
            if size >= BLOCK_BYTES:
                yield block(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield block(held)

    train = (id_remainder("doc_id", MODULUS) != HELD_OUT).alias("train")
    rows = docs.select(F.col("doc_id").cast("long"), train, text_bytes().alias("data")).mapInArrow(run, BLOCK_SCHEMA)
    return durable(rows.withColumn("block", F.monotonically_increasing_id()), row_group_bytes=16 << 20)


def _block(row: dict, parts: int) -> Block:
    train = np.frombuffer(row["train"], bool)
    return Block(_got(row["lengths"]).astype(np.int64), train, _got(row["codes"]).astype(np.int64), np.frombuffer(row["hashes"], np.uint64), parts)


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """For each list of keys the sums of their times over all lists, and how many keys have any."""
    every, own = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(every)
    every = every[order]
    first = np.flatnonzero(np.diff(every, prepend=~every[:1]))
    sums = np.add.reduceat(own[order], first) if len(first) else own
    out = np.empty(len(every), np.uint64)
    out[order] = np.repeat(sums, np.diff(np.r_[first, len(every)]))
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1]), int((sums > 0).sum())


def _answers(blocks: DataFrame, parts: int) -> DataFrame:
    """``(block, part, counts, known)``: corpus counts of what each block asks of each part; known words once a part."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.slice(row, 1).to_pylist()[0]
                asked = list(_block(own, parts).questions())
                columns = [pa.array([own["block"]] * len(asked), pa.int64())]
                columns += [pa.array(c, t) for c, t in zip(zip(*asked, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "words", "grams", "times"])

    def answer(part: int, rows: list[tuple]) -> pa.RecordBatch:
        asked, words, grams, times = zip(*rows, strict=True)
        words, grams, times = ([_got(x) for x in column] for column in (words, grams, times))
        words, grams = [np.cumsum(w) for w in words], [np.cumsum(g) for g in grams]
        by_word, known = _summed(words, [t[: len(w)] for t, w in zip(times, words, strict=True)])
        by_gram, _ = _summed(grams, [t[len(w) :] for t, w in zip(times, words, strict=True)])
        counts = [_put(np.concatenate(pair)) for pair in zip(by_word, by_gram, strict=True)]
        n = len(rows)
        columns = [pa.array(asked, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([len(w) for w in words], pa.int64()), pa.array(counts, pa.binary()), pa.array([known] + [0] * (n - 1), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "part", "n_words", "counts", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for own, *row in zip(*(batch[c].to_pylist() for c in ("part", "block", "words", "grams", "times")), strict=True):
                if own != part and rows:
                    yield answer(part, rows)
                    rows = []
                part = own
                rows.append(row)
        if rows:
            yield answer(part, rows)

    asked = blocks.mapInArrow(ask, "block long, part int, words binary, grams binary, times binary")
    return asked.repartition("part").sortWithinPartitions("part").mapInArrow(run, "block long, part int, n_words long, counts binary, known long")


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every whole text.

    All words, pairs and triples of all training texts count; none is dropped.
    Blocks of texts ask parts, which n-grams are dealt to by hash, for the
    corpus counts of the n-grams they hold, each once, so that a frequent one
    burdens no part; a row between a block and a part holds an n-gram at least,
    so rows grow with the corpus and no faster. The block then builds the
    automaton of what its texts can reach and walks it. Words are told apart by
    64 bits of their hash, n-grams by 40 bits within a part (an unseen one is
    taken for another's once in some 100,000 times). What is shuffled grows with
    the corpus; two numbers reach the driver. Null texts are the end alone; null ids count as the id "" for
    the split; repeated rows and extra columns are passed by; an empty table
    gives an empty one.
    """
    blocks = _blocks(docs)
    every, tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    parts = min(max(LEAST_PARTS, every // PART_TOKENS), 1 << PART_BITS)
    answers = durable(_answers(blocks, parts))
    total = float(tokens + (answers.agg(F.sum("known")).first()[0] or 0) + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _block(left.to_pylist()[0], parts)
        counts = [_got(x) for x in right.sort_by("part")["counts"].to_pylist()]
        n_words = right.sort_by("part")["n_words"].to_pylist()
        words, pairs, triples = block.answered(np.concatenate([c[:n] for c, n in zip(counts, n_words, strict=True)]), np.concatenate([c[n:] for c, n in zip(counts, n_words, strict=True)]))
        path = _path(block, words, pairs, triples, total)
        ids = left["ids"].combine_chunks().flatten()
        sums = [np.add.reduceat(x, block.starts) for x in ((words > 0).astype(np.int64), np.log10((words + 1) / total))]
        columns = [ids, pa.array(block.lengths), pa.array(sums[0]), pa.array(np.full(len(ids), tokens)), pa.array(sums[1]), pa.array(path)]
        return pa.table(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(answers.select("block", "part", "n_words", "counts").groupBy("block")).applyInArrow(finish, schema)
