"""Passages that repeat across documents, by prefix-free parsing: triggers cut phrases, and sorted phrases put equal strings side by side.

A trigger is the least rolling hash of GRAM bytes in a string of LENGTH; a
phrase is all consecutive strings with one trigger. Strings are equal only if
their triggers are, at the same distance from their starts, so phrases need
comparing within a trigger alone. Per trigger the phrases are sorted by what
follows it and, once more, by what stands before it, backwards: a suffix array
each, whose common prefixes say for every distance which strings are equal.
Of the classes that both give, the least document counts.

Whatever a phrase occurs in, only distinct phrases of a block of texts leave
it, and of those only such whose trigger occurs in another phrase somewhere:
blocks ask parts, which triggers are dealt to, for that first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from storyline.operators.durable import durable

from .text import pieces, text_bytes

#: Bytes of a string that counts as repeated, and of what triggers are hashed from.
LENGTH, GRAM = 50, 16
#: Strings that a trigger may lie in: it starts up to SPAN - 1 bytes after them.
SPAN = LENGTH - GRAM + 1
#: Bytes of text in a block, handled at a time, and per part of triggers.
BLOCK_BYTES, SLICE_BYTES, PART_BYTES = 4 << 20, 2 << 20, 4 << 20
LEAST_PARTS = 64
#: What a null id counts as: greater than all others.
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_ALL = (1 << SPAN) - 1


def _hashes(data: np.ndarray) -> np.ndarray:
    """The rolling (Rabin-Karp) hash of every GRAM bytes, stirred so that its order tells nothing of the text."""
    value, size = data.astype(np.uint32) + np.uint32(1), 1
    while size < GRAM:
        value = value[: len(value) - size] * np.uint32(pow(_BASE, size, 1 << 32)) + value[size:]
        size *= 2
    value ^= value >> np.uint32(16)
    value *= np.uint32(0x85EBCA6B)
    value ^= value >> np.uint32(13)
    return value


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` values in a row."""
    size = 1
    while size < span:
        step = min(size, span - size)
        values = np.minimum(values[: len(values) - step], values[step:])
        size += step
    return values


def _stirred(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    value = (value ^ word) * np.uint64(_BASE)
    return value ^ value >> np.uint64(31)


class Phrases:
    """The phrases of one block of texts: where they start, their strings' number, their trigger, and which text they lie in.

    Two 64-bit hashes, of trigger and whole, tell the phrases of a block apart.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray) -> None:
        self.data, self._ends = data, np.cumsum(lengths)
        self._starts = self._ends - lengths
        found = [self._of(a, min(a + SLICE_BYTES, len(data))) for a in range(0, len(data) - LENGTH + 1, SLICE_BYTES)]
        self.start, self.count, self.place, self.text = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
        self.hash, self.mixed = np.zeros(len(self.start), np.uint64), (self.place << 8 | self.count).astype(np.uint64)
        if len(self.start):
            words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
            for k in range(0, GRAM, 8):
                self.hash = _stirred(self.hash, words[self.start + self.place + k])
            for k in range(0, LENGTH + SPAN, 8):
                self.mixed = _stirred(self.mixed, words[self.start + np.minimum(k, self.count + LENGTH - 9)])

    def _of(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Phrases of the strings that start from a up to b, whatever texts or part of one these are: where they are cut changes nothing."""
        data = self.data[a : b + LENGTH - 1]
        n = len(data) - LENGTH + 1
        hashes = _hashes(data)
        least = _least(hashes, SPAN)
        begins = np.ones(n, bool)
        begins[1:] = (least[1:] != least[:-1]) | (hashes[: n - 1] == least[:-1])
        texts = slice(np.searchsorted(self._starts, a), np.searchsorted(self._starts, a + n))
        begins[self._starts[texts] - a] = True
        # No string crosses a text's end.
        texts = slice(np.searchsorted(self._ends, a, "right"), np.searchsorted(self._ends, a + n + LENGTH - 1))
        crossing = (self._ends[texts] - a)[:, None] - np.arange(1, LENGTH)
        begins[crossing[(crossing >= 0) & (crossing < n)]] = False
        start = np.flatnonzero(begins)
        text = np.searchsorted(self._ends, start + a, "right")
        until = np.minimum(np.r_[start[1:], n], self._ends[text] - a - LENGTH + 1)
        # Either a lesser hash has come in at the end, or the first of the least is to be looked for.
        place = np.full(len(start), SPAN - 1)
        sought = np.flatnonzero((start == 0) | (least[start] >= least[start - 1]))
        within = hashes[start[sought, None] + np.arange(SPAN)]
        place[sought] = (within == least[start[sought], None]).argmax(1)
        return start + a, until - start, place, text

    def distinct(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One of each distinct phrase, ordered by trigger; of each its least id; and which of them every phrase is."""
        order = np.lexsort((self.mixed, self.hash))
        same = (self.hash[order[1:]] == self.hash[order[:-1]]) & (self.mixed[order[1:]] == self.mixed[order[:-1]])
        group = np.r_[0, np.cumsum(~same)] if len(order) else order
        first = np.flatnonzero(np.r_[True, ~same]) if len(order) else order
        which = np.empty(len(order), np.int64)
        which[order] = group
        least = np.minimum.reduceat(ids[self.text[order]], first) if len(order) else np.zeros(0, np.int64)
        return order[first], least, which

    def bytes_of(self, chosen: np.ndarray) -> np.ndarray:
        """The chosen phrases' bytes, one after another."""
        sizes = self.count[chosen] + LENGTH - 1
        before = np.cumsum(sizes) - sizes
        return self.data[np.repeat(self.start[chosen] - before, sizes) + np.arange(int(sizes.sum()))]


def parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which part each trigger is dealt to; rises with the trigger."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _padded(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of ``width`` bytes from ``starts`` on, forwards or backwards, zero beyond their lengths."""
    at = np.arange(width)
    rows = flat[np.clip(starts[:, None] + step * at, 0, max(len(flat) - 1, 0))]
    rows[at >= lengths[:, None]] = 0
    return rows


def _suffix_order(group: np.ndarray | int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (group, bytes), and how many bytes each has in common with the one before it (-1: another group)."""
    group = np.broadcast_to(group, len(rows))
    keys = rows.view(">u8").astype(np.uint64)
    order = np.lexsort((*(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)), group))
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.r_[-1, common]


def earlier(places: np.ndarray, counts: np.ndarray, flat: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each phrase, as bits by distance from string to trigger, which of its strings a lesser id's phrase holds.

    Phrases come with bytes one after another; those of one trigger all have
    to be here.
    """
    sizes = counts + LENGTH - 1
    starts = np.cumsum(sizes) - sizes
    trigger = starts + places
    after, after_common = _suffix_order(0, _padded(flat, trigger, sizes - places, 56, 1))
    found = np.zeros(len(places), np.int64)
    right, left = np.empty(len(places), np.int64), np.empty(len(places), np.int64)
    right[after] = np.cumsum(after_common < GRAM)  # equal triggers
    before, before_common = _suffix_order(right.copy(), _padded(flat, trigger - 1, places, 40, -1))
    for distance in range(SPAN):
        held = np.flatnonzero((places >= distance) & (places - counts < distance))
        if len(held) < 2:
            continue
        right[after], left[before] = np.cumsum(after_common < LENGTH - distance), np.cumsum(before_common < distance)
        pair = right[held] << 32 | left[held]
        order = np.argsort(pair)
        first = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0])
        least = np.repeat(np.minimum.reduceat(ids[held[order]], first), np.diff(np.r_[first, len(order)]))
        found[held[order]] |= (least < ids[held[order]]).astype(np.int64) << distance
    return found


def _rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by ``key``, all of one value at a time."""
    now, rows = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if rows and row[key] != now:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


class Block:
    """A block's texts as phrases, from its row."""

    def __init__(self, row: dict, parts: int) -> None:
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        data = np.frombuffer(pa.decompress(row["data"], int(self.lengths.sum()), "zstd"), np.uint8)
        self.phrases = Phrases(data, self.lengths)
        self.chosen, self.least, self.which = self.phrases.distinct(self.ids)
        self.hashes = self.phrases.hash[self.chosen]
        self.firsts = np.flatnonzero(np.r_[True, self.hashes[1:] != self.hashes[:-1]]) if len(self.hashes) else np.zeros(0, np.int64)
        self.triggers = self.hashes[self.firsts]
        self.cuts = np.searchsorted(parts_of(self.triggers, parts), np.arange(parts + 1))

    def asked(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which distinct phrases have a trigger that other phrases have too, here or in the answers of the parts."""
        shared = np.diff(np.r_[self.firsts, len(self.hashes)]) > 1
        for part, blob in answers.items():
            a, b = self.cuts[part], self.cuts[part + 1]
            shared[a:b] |= _flags(blob, b - a)
        return np.repeat(shared, np.diff(np.r_[self.firsts, len(self.hashes)]))


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts in blocks of about BLOCK_BYTES, a longer one alone, with their ids as given."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.concat_batches(held)
        lengths = pc.binary_length(batch["data"]).to_numpy().astype(np.int64)
        data = b"".join(x.as_buffer().to_pybytes() for x in batch["data"])
        ids = pc.fill_null(batch["doc_id"], LAST).to_numpy()
        columns = [pa.array([x], pa.binary()) for x in (pa.compress(data, "zstd", asbytes=True), lengths.tobytes(), ids.tobytes(), np.packbits(batch["doc_id"].is_null().to_numpy(zero_copy_only=False)).tobytes())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([len(data)])], names=["data", "lengths", "ids", "nulls", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in pieces(batches, "data"):
            more = pc.sum(pc.binary_length(batch["data"])).as_py() or 0
            if held and size + more > BLOCK_BYTES:
                yield block(held)
                held, size = [], 0
            held.append(batch)
            size += more
        if held:
            yield block(held)

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("data")).mapInArrow(run, "data binary, lengths binary, ids binary, nulls binary, size long")
    return durable(rows.withColumn("block", F.monotonically_increasing_id()), row_group_bytes=8 << 20)


def _with(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks, each followed by the answers to it."""
    both = blocks.withColumn("part", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "part")


def _by_part(rows: DataFrame, answer, schema: str) -> DataFrame:
    """``answer`` to all rows of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, asked in _rows(batches, "part"):
            blobs = answer(asked)
            some = [k for k, blob in enumerate(blobs) if blob is not None]
            if some:
                columns = [pa.array([asked[k]["block"] for k in some], pa.int64()), pa.array([part] * len(some), pa.int32()), pa.array([blobs[k] for k in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "answer"])

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def _shared(asked: list[dict]) -> list[bytes | None]:
    """For each row's triggers, which of them another row has, by 32 bits within a part: now and then one is asked for in vain."""
    hashes = [np.frombuffer(row["hashes"], np.uint32) for row in asked]
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    equal = every[order[1:]] == every[order[:-1]]
    many = np.empty(len(every), bool)
    many[order] = np.r_[False, equal] | np.r_[equal, False]
    return [np.packbits(x).tobytes() if x.any() else None for x in np.split(many, np.cumsum([len(h) for h in hashes])[:-1])]


def _judged(asked: list[dict]) -> list[bytes | None]:
    """For each row's phrases, their strings that a lesser id holds."""
    columns = {c: [np.frombuffer(row[c], t) for row in asked] for c, t in (("places", np.uint8), ("counts", np.uint8), ("least", np.int64))}
    every = {c: np.concatenate(x) for c, x in columns.items()}
    flat = np.frombuffer(b"".join(pa.decompress(row["bytes"], row["size"], "zstd", asbytes=True) for row in asked), np.uint8)
    bits = earlier(every["places"].astype(np.int64), every["counts"].astype(np.int64), flat, every["least"])
    return [x.tobytes() if x.any() else None for x in np.split(bits, np.cumsum([len(p) for p in columns["places"]])[:-1])]


def repeated(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: maximal runs of bytes covered by a string of LENGTH bytes that also starts in a document of a lesser id.

    Texts are UTF-8 (null: empty); strings never cross texts and are judged on
    the texts as given. ``spans`` are pairs of start and end, ``kept`` is what
    remains. Rows of equal ids are not each other's lesser; a null id is
    greater than all others. Extra columns are passed by; an empty table gives
    an empty one. A block's texts (one long text alone), and a part's triggers
    or phrases, distinct in each block, are the most that one task holds; rows
    between blocks and parts never outnumber triggers.
    """
    blocks = _blocks(docs)
    parts = max(LEAST_PARTS, (blocks.agg(F.sum("size")).first()[0] or 0) // PART_BYTES)

    def triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (row,) in _rows(batches, "block"):
            block = Block(row, parts)
            some = np.flatnonzero(np.diff(block.cuts)).tolist()
            blobs = [block.triggers[block.cuts[p] : block.cuts[p + 1]].astype(np.uint32).tobytes() for p in some]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "part", "hashes"])

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (row, *answers) in _rows(batches, "block"):
            block = Block(row, parts)
            asked = np.flatnonzero(block.asked({a["part"]: a["answer"] for a in answers}))
            chosen = block.chosen[asked]
            of = parts_of(block.hashes[asked], parts)
            some, first = np.unique(of, return_index=True)
            cuts = np.r_[first, len(of)].tolist()
            flat, ends = block.phrases.bytes_of(chosen), np.r_[0, np.cumsum(block.phrases.count[chosen] + LENGTH - 1)]
            values = [block.phrases.place[chosen].astype(np.uint8), block.phrases.count[chosen].astype(np.uint8), block.least[asked]]
            columns = [pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int32())]
            columns += [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for x in values]
            columns.append(pa.array([pa.compress(flat[ends[a] : ends[b]].tobytes(), "zstd", asbytes=True) for a, b in zip(cuts, cuts[1:])], pa.binary()))
            columns.append(pa.array([int(ends[b] - ends[a]) for a, b in zip(cuts, cuts[1:])], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "places", "counts", "least", "bytes", "size"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (row, *answers) in _rows(batches, "block"):
            block = Block(row, parts)
            told = {a["part"]: a["answer"] for a in answers if a["kind"] == 1}
            asked = np.flatnonzero(block.asked({a["part"]: a["answer"] for a in answers if a["kind"] == 0}))
            bits, of = np.zeros(len(block.chosen), np.int64), parts_of(block.hashes[asked], parts)
            for part, blob in told.items():
                bits[asked[of == part]] = np.frombuffer(blob, np.int64)
            yield _covered(block, bits, _flags(row["nulls"], len(block.ids)))

    asked = blocks.select("block", "data", "lengths", "ids").mapInArrow(triggers, "block long, part int, hashes binary")
    shared = durable(_by_part(asked, _shared, "block long, part int, answer binary"))
    rows = _with(blocks.drop("nulls", "size"), shared).mapInArrow(phrases, "block long, part int, places binary, counts binary, least binary, bytes binary, size long")
    judged = durable(_by_part(rows, _judged, "block long, part int, answer binary"))
    answers = shared.withColumn("kind", F.lit(0)).unionByName(judged.withColumn("kind", F.lit(1)))
    return _with(blocks.drop("size").withColumn("kind", F.lit(-1)), answers).mapInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _covered(block: Block, bits: np.ndarray, nulls: np.ndarray) -> pa.RecordBatch:
    """Each text's spans and what remains, from which strings of which distinct phrases a lesser id holds."""
    own, texts = block.phrases, len(block.ids)
    # A phrase that a lesser id of this block has too goes whole.
    bits = np.where(block.least[block.which] < block.ids[own.text], _ALL, bits[block.which])
    every = (2 << own.place) - (1 << own.place - own.count + 1)
    bits &= every
    whole, some = np.flatnonzero(bits == every), np.flatnonzero((bits != 0) & (bits != every))
    row, distance = np.nonzero(bits[some, None] >> np.arange(SPAN) & 1)
    begin = np.r_[own.start[whole], (own.start + own.place)[some[row]] - distance]
    until = np.r_[(own.start + own.count)[whole] + LENGTH - 1, begin[len(whole) :] + LENGTH]
    text = np.r_[own.text[whole], own.text[some[row]]]
    order = np.argsort(begin, kind="stable")
    begin, until, text = begin[order], np.maximum.accumulate(until[order]), text[order]
    new = np.flatnonzero(np.r_[True, (begin[1:] > until[:-1]) | (text[1:] != text[:-1])]) if len(begin) else order
    begin, text = begin[new], text[new]
    until = until[np.r_[new[1:] - 1, len(until) - 1]] if len(new) else until

    starts = np.cumsum(block.lengths) - block.lengths
    spans = pa.StructArray.from_arrays([pa.array(begin - starts[text]), pa.array(until - starts[text])], ["start", "end"])
    cuts = np.r_[0, np.cumsum(np.bincount(text, minlength=texts))].astype(np.int32)
    keep = np.ones(len(own.data), bool)
    for a, b in zip(begin.tolist(), until.tolist(), strict=True):
        keep[a:b] = False
    sizes = block.lengths - np.bincount(text, until - begin, texts).astype(np.int64)
    offsets = pa.py_buffer(np.r_[0, np.cumsum(sizes)].tobytes())
    remains = pa.Array.from_buffers(pa.large_binary(), texts, [None, offsets, pa.py_buffer(own.data[keep])]).cast(pa.binary())
    columns = [pa.array(block.ids, mask=nulls), pa.array(block.lengths), pa.ListArray.from_arrays(pa.array(cuts), spans), remains]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])
