"""SimHash near-duplicates, found by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.components import connected_components
from ..operators.durable import durable
from .text import free_names, one_row, pieces

#: Bits and generator polynomial of the perfect binary Golay code; the hash's seed.
GOLAY_BITS, GOLAY_CHECK_BITS, GOLAY_POLYNOMIAL = 23, 11, 0b101011100011
SEED = 42
#: First bit and number of bits of each fingerprint segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
MAX_DISTANCE = 3
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 17
#: Rows of a bucket from which it is compared row by row.
LARGE_BUCKET = 64


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)``: 64-bit SimHash of each whole text as a signed long.

    Words are runs without ASCII white space, A-Z lowered. A text of fewer than
    ``width`` words is one shingle; one without words (or null) has fingerprint 0.
    """
    return with_fingerprint(docs.select(F.col("doc_id").cast("long"), "text"), "fp", width).select("doc_id", "fp")


def with_fingerprint(docs: DataFrame, name: str, width: int = 3) -> DataFrame:
    """``docs``, all columns, and their text's fingerprint as ``name``."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data = batch["text"].cast(pa.binary()).to_pylist()
            prints = np.array([_fingerprint((x or b"").lower().split(), width) for x in data], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(prints)], names=[*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _fingerprint(words: list[bytes], width: int) -> int:
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    blocks = []
    for at in range(0, n, BLOCK):
        if n == 1:
            shingles = [b" ".join(words)]
        else:
            part = words[at : at + BLOCK + width - 1]
            shingles = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        blocks.append(np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64))
    return fingerprint_of(np.concatenate(blocks))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of shingles by their hashes, repeats included; none have 0."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


class Golay:
    """Codewords near a 23-bit word, by its syndrome.

    Every word has exactly one codeword within distance 3. Of two words that
    differ in at most one bit, either both decode to the same codeword, or each
    is at distance 3 from its own and at 4 from the other's: a word at distance
    3 has five codewords at distance 4. Those five are the word's probes.
    """

    def __init__(self) -> None:
        single = []
        for bit in range(GOLAY_BITS):
            value = 1 << bit
            for high in range(GOLAY_BITS - 1, GOLAY_CHECK_BITS - 1, -1):
                if value >> high & 1:
                    value ^= GOLAY_POLYNOMIAL << (high - GOLAY_CHECK_BITS)
            single.append(value)
        self._single = np.array(single, np.int64)
        self._near = np.zeros(1 << GOLAY_CHECK_BITS, np.int64)
        self._weight = np.zeros(1 << GOLAY_CHECK_BITS, np.int64)
        farther: dict[int, list[int]] = {}
        for weight in range(5):
            for bits in combinations(range(GOLAY_BITS), weight):
                error, syndrome = sum(1 << b for b in bits), 0
                for b in bits:
                    syndrome ^= single[b]
                if weight < 4:
                    self._near[syndrome], self._weight[syndrome] = error, weight
                else:
                    farther.setdefault(syndrome, []).append(error)
        self._far = np.zeros((1 << GOLAY_CHECK_BITS, 5), np.int64)
        for syndrome, errors in farther.items():
            self._far[syndrome] = errors

    def index(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of each word's codeword, whether it has probes, and the indices of its five probes."""
        syndrome = np.zeros(len(words), np.int64)
        for bit in range(GOLAY_BITS):
            syndrome ^= np.where(words >> bit & 1, self._single[bit], 0)
        own = (words ^ self._near[syndrome]) >> GOLAY_CHECK_BITS
        probes = (words[:, None] ^ self._far[syndrome]) >> GOLAY_CHECK_BITS
        return own, self._weight[syndrome] == 3, probes


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket key, row of ``fps`` and whether it is a probe, so that any two fingerprints at most 3 bits
    apart meet in a bucket where at least one of them is no probe.

    At most 3 errors over three segments leave either one segment without any
    and another with at most one (one exact, the other fuzzy: six kinds of 30 or
    35 bits), or each with just one (all three fuzzy: 36 bits). Words one bit
    apart differ in parity, so a segment's even word alone needs its probes. In
    the last kind either of two may probe, in different segments: none counts as
    a probe there.
    """
    golay = _golay()
    parts = [(fps.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in SEGMENTS]
    coded = []
    for part in parts:
        own, far, more = golay.index(part)
        coded.append((own, far & (np.bitwise_count(part) % 2 == 0), more))
    rows = np.arange(len(fps))
    keys, who, probe = [], [], []

    def add(kind: int, value: np.ndarray, row: np.ndarray, is_probe: bool) -> None:
        keys.append(value | kind << 40)
        who.append(row)
        probe.append(np.full(len(row), is_probe))

    value, row = np.zeros(len(fps), np.int64), rows
    for own, far, more in coded:
        probing = far[row]
        found = [(value << 12 | own[row], row)]
        found += [(value[probing] << 12 | more[row[probing], k], row[probing]) for k in range(5)]
        value, row = (np.concatenate(x) for x in zip(*found, strict=True))
    add(0, value, row, False)
    for kind, (exact, fuzzy) in enumerate(permutations(range(len(SEGMENTS)), 2), 1):
        own, far, more = coded[fuzzy]
        add(kind, parts[exact] << 12 | own, rows, False)
        for k in range(5):
            add(kind, parts[exact][far] << 12 | more[far, k], rows[far], True)
    return np.concatenate(keys), np.concatenate(who), np.concatenate(probe)


_made: list[Golay] = []


def _golay() -> Golay:
    if not _made:
        _made.append(Golay())
    return _made[0]


class _Forest:
    """Keeps the links that join two sets not joined before."""

    def __init__(self) -> None:
        self._up: dict[int, int] = {}

    def _top(self, x: int) -> int:
        up = self._up
        path = []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self._top(x), self._top(y)
        if x == y:
            return False
        self._up[max(x, y)] = min(x, y)
        return True


def _bucket_links(fp: np.ndarray, probe: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Pairs at distance 1 to ``most`` within buckets of consecutive rows; of large buckets only a spanning part."""
    bits = fp.view(np.uint64)  # of a negative number bitwise_count takes the absolute value
    small = sizes <= LARGE_BUCKET
    at, n = starts[small], sizes[small]
    left = np.repeat(np.concatenate([np.arange(a, a + m) for a, m in zip(at, n, strict=True)]) if len(at) else np.zeros(0, int), np.repeat(n, n))
    ends = np.repeat(at, n)
    width = np.repeat(n, n)
    right = np.repeat(ends, width) + (np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width))
    keep = (left < right) & ~(probe[left] & probe[right])
    left, right = left[keep], right[keep]
    apart = np.bitwise_count(bits[left] ^ bits[right])
    near = (apart > 0) & (apart <= most)
    yield from zip(fp[left[near]].tolist(), fp[right[near]].tolist(), strict=True)
    for a, m in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
        own = bits[a : a + m]
        label = np.arange(m)
        for row in np.flatnonzero(~probe[a : a + m]).tolist():
            near = np.bitwise_count(own ^ own[row]) <= most
            if not (joins := near & (label != label[row])).any():
                continue
            groups, first = np.unique(label[joins], return_index=True)
            for other in np.flatnonzero(joins)[first].tolist():
                if own[other] != own[row]:
                    yield int(fp[a + row]), int(fp[a + other])
            label[np.isin(label, groups)] = label[row]


def linked_fingerprints(prints: DataFrame, most: int = MAX_DISTANCE) -> DataFrame:
    """``(a, b)`` links between distinct ``fp`` values that join all within ``most`` (at most 3) bits.

    ``prints`` holds distinct fps. Rows of a bucket lie together in one
    partition and stream through it; each partition returns a spanning forest
    of the links it finds, never all pairs of a group.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch["fp"].slice(at, 4096).to_numpy()
                keys, rows, probe = fuzzy_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows]), pa.array(probe)], names=["key", "fp", "probe"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = _Forest(), None

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            key, fp, probe = columns
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            own = np.add.reduceat((~probe).astype(np.int64), starts)
            useful = (sizes > 1) & (own > 0)
            found = [p for p in _bucket_links(fp, probe, starts[useful], sizes[useful], most) if forest.join(*p)]
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch[c].to_numpy(zero_copy_only=False) for c in ("key", "fp", "probe")]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            if cut:
                yield links([c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
        if held is not None and len(held[0]):
            yield links(held)

    return (
        prints.mapInArrow(keyed, "key long, fp long, probe boolean")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(compare, "a long, b long")
    )


def simhash_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per document.

    Documents are linked when their fingerprints differ in at most 3 bits;
    component_id is the smallest doc_id reachable. Equal fingerprints are
    compared once for all their documents. Null ids are kept: they belong to
    their text's component and never name one that has other ids. Repeated rows
    stay; an empty table gives an empty one; other columns are not looked at.
    """
    prints = durable(fingerprints(docs, width))
    names = _components(prints)
    return prints.join(names, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _components(prints: DataFrame) -> DataFrame:
    """``(fp, least, component_id)`` of each distinct fingerprint; least is its own least doc_id."""
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = connected_components(linked_fingerprints(distinct.select("fp")))
    labelled = durable(distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "least"
    ))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return labelled.join(least, "component").select("fp", "least", "component_id")


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept.

    The row of the group's least doc_id stays (of repeated ones, the first as JSON; null ids
    lose to others, and a group without ids keeps one row of one fingerprint).
    """
    mark, chosen_mark, chosen_id, own_id = free_names(docs.columns, "fp", "chosen", "chosen_id", "own_id")
    marked = durable(with_fingerprint(docs, mark, width))
    names = _components(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).alias("fp")))
    own = names.where(F.col("least").eqNullSafe(F.col("component_id")))
    # Of a group without ids the least fingerprint stands for it.
    kept = own.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min("fp").alias("fp"), F.min("least").alias("least"))
    chosen = kept.select(F.col("fp").alias(chosen_mark), F.col("least").alias(chosen_id))
    same = (F.col(mark) == F.col(chosen_mark)) & F.col("doc_id").cast("long").eqNullSafe(F.col(chosen_id))
    kept = marked.join(chosen, same, "left_semi").withColumn(own_id, F.col("doc_id"))
    return one_row(kept, docs.columns, [own_id, mark])
