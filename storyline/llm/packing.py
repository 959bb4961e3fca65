"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.durable import durable
from .gathered import LENGTH, Runs, ends_of
from .text import free_names, pieces, text_bytes

MEMO_ENTRIES = 800_000
#: Words whose ids are merged in one call.
WORDS_AT_ONCE = 1000
#: Letters that the pattern takes as one word in UTF-8, and ASCII signs that it takes as one after them (an apostrophe may begin a suffix).
LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The byte-level signs of those bytes of LATIN's small letters that are no printing character of Latin-1.
BYTE_SIGNS = {"\x9f": "\u0141", "\xa0": "\u0142", "\xad": "\u0143"}
#: Pieces of one length that are ranked together.
SLICE_ROWS = 500
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkEncoder:
    """Token ids of whole texts, put together from the ids of their white-space separated chunks.

    The tokenizer's pattern never crosses white space, so a text's ids are those
    of its chunks in order. ASCII letters are lowered first to share more chunks;
    texts where that could matter (combining marks, special-token strings) are not.
    A chunk's ids are kept as a run; the memo says where.
    """

    def __init__(self, tokenizer_json: str, end_id: int = 1) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._merger, self._ends = _bare_merger(tokenizer_json)
        self._end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self._memo: dict[bytes, int] = {}
        self._runs = Runs()
        self._end = int(self._runs.append(np.array([self._end_id]), np.array([1]))[0])

    def encode(self, data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 as binary), each with the end id, and where each text's ids end."""
        if len(self._memo) > MEMO_ENTRIES:
            self._forget()
        raw = data.view(pa.string())
        exact = pa.array([b"\xcc" in x or b"\xcd" in x or b"<|" in x for x in data.to_pylist()], pa.bool_())
        chunks = pc.ascii_split_whitespace(pc.if_else(exact, raw, pc.ascii_lower(raw)))
        offsets = chunks.offsets.to_numpy()
        coded = chunks.flatten().view(pa.binary()).dictionary_encode()
        places = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        places = np.insert(places, offsets[1:] - offsets[0], self._end)
        return self._runs.gather(places), ends_of(places, np.diff(offsets) + 1)

    def _places(self, chunks: list[bytes]) -> np.ndarray:
        """Where each chunk's ids lie: start << 32 | length."""
        places = np.fromiter(map(self._memo.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(missing := np.flatnonzero(places < 0)):
            self._learn([chunks[k] for k in missing.tolist()])
            places[missing] = np.fromiter((self._memo[chunks[k]] for k in missing.tolist()), np.int64, len(missing))
        return places

    def _learn(self, chunks: list[bytes]) -> None:
        """Memorises chunks. One of letters and signs after them has the ids of the letters, then those of the signs."""
        memo, whole, plain = self._memo, [], []
        for c in chunks:
            word = c.rstrip(SIGNS)
            if self._ends is not None and word and (word.isalpha() or LATIN.fullmatch(word)):
                plain.append((c, word.lower() if word.isascii() else word.decode().lower().encode(), c[len(word) :]))
            else:
                whole.append(c)
        whole += {signs for _, _, signs in plain if signs not in memo}.difference(whole)
        coded = [e.ids for e in self._tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in whole], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(coded), "<u4")
        memo.update(zip(whole, self._runs.append(flat, np.fromiter(map(len, coded), np.int64, len(coded))).tolist(), strict=True))
        words = [w for w in dict.fromkeys(w for _, w, _ in plain) if w not in memo]
        for at in range(0, len(words), WORDS_AT_ONCE):
            self._learn_words(words[at : at + WORDS_AT_ONCE])
        signed = [(c, word, signs) for c, word, signs in plain if c != word]
        parts = np.fromiter((memo[x] for _, word, signs in signed for x in (word, signs)), np.int64, 2 * len(signed))
        memo.update(zip([c for c, _, _ in signed], self._runs.append(self._runs.gather(parts), (parts & LENGTH).reshape(-1, 2).sum(axis=1)).tolist(), strict=True))

    def _learn_words(self, words: list[bytes]) -> None:
        """Memorises words of lower-case letters, merged in one go; each word's last id is one that ends words."""
        joined = b" ".join(words).decode("latin-1")
        for byte, sign in BYTE_SIGNS.items():
            joined = joined.replace(byte, sign)
        ids = np.array(self._merger.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        self._memo.update(zip(words, self._runs.append(ids, np.diff(np.flatnonzero(self._ends[ids]), prepend=-1)).tolist(), strict=True))


def _bare_merger(tokenizer_json: str):
    """The tokenizer's merges alone, without its normaliser and pattern, and which ids end words (None: it marks no ends)."""
    from tokenizers import Tokenizer

    rules = json.loads(tokenizer_json)
    suffix = rules["model"].get("end_of_word_suffix")
    if not suffix:
        return None, None
    rules |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
    ends = np.zeros(max(rules["model"]["vocab"].values()) + 1, bool)
    ends[[k for piece, k in rules["model"]["vocab"].items() if piece.endswith(suffix)]] = True
    return Tokenizer.from_str(json.dumps(rules)), ends


_encoders: dict[tuple[int, int], ChunkEncoder] = {}


def _encoder(tokenizer_json: str, end_id: int) -> ChunkEncoder:
    """The worker's own encoder, kept with what it has memorised from task to task."""
    key = (zlib.crc32(tokenizer_json.encode()), end_id)
    return _encoders.get(key) or _encoders.setdefault(key, ChunkEncoder(tokenizer_json, end_id))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of at most ``capacity`` ids of each document's ids and ``end_id``.

    A null or empty text is the end id alone. Columns: PIECE_SCHEMA.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value, end_id)
        for batch in pieces(batches, "data"):
            out: list[tuple] = []
            ids, ends = encoder.encode(batch["data"])
            ids, ends = memoryview(ids), ends.tolist()
            for doc, first, end in zip(batch["doc_id"].to_pylist(), [0, *ends], ends, strict=False):
                for piece, at in enumerate(range(first, end, capacity)):
                    part = ids[at : min(end, at + capacity)]
                    out.append((doc, piece, at - first, len(part), zlib.crc32(part)))
            columns = list(zip(*out, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("data")).mapInArrow(run, PIECE_SCHEMA)


class _Sums:
    """Which lengths, pair sums and triple sums the remaining lengths can make."""

    def __init__(self, counts: np.ndarray) -> None:
        size = 1 << int(np.ceil(np.log2(3 * len(counts))))
        there = np.fft.rfft((counts > 0).astype(float), size)
        self.pairs = np.rint(np.fft.irfft(there * there, size))[: len(counts)] > 0
        self.triples = np.rint(np.fft.irfft(there * there * there, size))[: len(counts)] > 0


def _exact_fill(left: np.ndarray, sums: _Sums, gap: int) -> list[int]:
    """At most three lengths that are all still there and make exactly ``gap``; few and large ones first."""
    if left[gap] > 0:
        return [gap]
    if sums.pairs[gap] and (pair := _pair(left, gap, gap - 1)):
        return pair
    if sums.triples[gap]:
        for large in np.flatnonzero(left[:gap] > 0)[::-1].tolist():
            if 3 * large < gap:
                break
            left[large] -= 1
            pair = sums.pairs[gap - large] and _pair(left, gap - large, large)
            left[large] += 1
            if pair:
                return [large, *pair]
    return []


def _pair(left: np.ndarray, total: int, most: int) -> list[int]:
    low, high = (total + 1) // 2, min(total - 1, most)
    if high < low:
        return []
    fits = (left[low : high + 1] > 0) & (left[total - high : total - low + 1][::-1] > 0)
    if total % 2 == 0 and low == total // 2 and left[low] < 2:
        fits[0] = False
    found = np.flatnonzero(fits)
    return [low + int(found[-1]), total - low - int(found[-1])] if len(found) else []


def packing_plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(times, [(length, copies), ...])`` patterns that place ``counts[length]`` pieces of each length.

    Sequences open with the longest piece left. As soon as one, two or three
    lengths make the gap exactly they close it; before that, the longest fitting
    piece goes in (best fit). A pattern is repeated for as long as its pieces
    last, so the plan's size follows the number of lengths, not of pieces.
    """
    counts, plan = counts.astype(np.int64).copy(), []
    while (there := np.flatnonzero(counts)).size:
        sums, left, gap, took = _Sums(counts), counts.copy(), capacity, Counter()
        put = int(there[-1])
        copies = 1
        while True:
            took[put] += copies
            left[put] -= copies
            gap -= put * copies
            if not gap:
                break
            if fill := _exact_fill(left, sums, gap):
                took.update(fill)
                break
            fitting = np.flatnonzero(left[: gap + 1] > 0)
            if not fitting.size:
                break
            put = int(fitting[-1])
            copies = max(1, min(int(left[put]), gap // put - 3))
        times = min(int(counts[x]) // n for x, n in took.items())
        for x, n in took.items():
            counts[x] -= n * times
        plan.append((times, sorted(took.items(), reverse=True)))
    return plan


class _Places:
    """Sequence and offset of the ``rank``-th piece of a length, by binary search in the plan."""

    SHIFT = 45

    def __init__(self, plan: list[tuple[int, list[tuple[int, int]]]]) -> None:
        used: Counter = Counter()
        rows, sequence = [], 0
        for times, parts in plan:
            offset = 0
            for length, copies in parts:
                rows.append(((length << self.SHIFT) + used[length], sequence, copies, offset))
                used[length] += times * copies
                offset += length * copies
            sequence += times
        self.key, self.sequence, self.copies, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 4).T

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << self.SHIFT) + rank, "right") - 1
        nth = (length << self.SHIFT) + rank - self.key[at]
        return self.sequence[at] + nth // self.copies[at], self.offset[at] + nth % self.copies[at] * length


def pack(rows: DataFrame, capacity: int = 4096, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds sequence_id and offset to ``rows``, which hold ``length`` (1 to capacity).

    Only the histogram of lengths (at most ``capacity`` numbers) reaches the
    driver. Pieces of one length are ranked in slices of about ``slice_rows``
    rows, dealt by row and not by value, so a length that most pieces share, and
    equal rows too, go to many tasks. Repeated rows are placed each on its own;
    an empty table stays empty.
    """
    columns = list(rows.columns)
    row, part, base, nth, rank = free_names(columns, "_row", "_slice", "_base", "_n", "_rank")
    numbered = durable(rows.withColumn(row, F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, np.int64)
    for found in numbered.groupBy("length").count().collect():
        counts[found["length"]] = found["count"]
    places = rows.sparkSession.sparkContext.broadcast(_Places(packing_plan(counts, capacity)))
    slices = F.element_at(F.lit([int(n) for n in counts // slice_rows + 1]), F.col("length").cast("int") + 1)
    sliced = numbered.withColumn(part, F.pmod(F.xxhash64(row), slices))
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = sliced.groupBy("length", part).count().select("length", part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy("length", part).orderBy(row)
    ranked = sliced.withColumn(nth, F.row_number().over(within) - 1).join(bases, ["length", part]).select(*columns, (F.col(base) + F.col(nth)).alias(rank))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value(batch["length"].to_numpy(), batch[rank].to_numpy())
            kept = [batch[c] for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` tokens.

    Null texts are empty, null ids stay null, extra columns are not looked at,
    repeated rows are packed each; an empty table gives an empty one.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity)
