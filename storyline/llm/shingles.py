"""Near-duplicates by five-word shingle similarity: SimHash with Golay keys finds candidates, whole shingle sets decide.

SimHash reaches pairs within 3 bits; for those at a similarity of 0.8 or more
that lie farther apart, MinHash bands find further candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..operators.components import connected_components
from ..operators.durable import durable, release
from .simhash import _Forest, fingerprint_of, linked_fingerprints
from .text import free_names, one_row, pieces

#: Words of a shingle, least similarity (a ratio of whole numbers), the hash's seed.
WIDTH, SIMILAR, SEED = 5, (4, 5), 42
#: Keys of a text and MinHashes in each. Two texts of similarity 0.8 share no key with a chance of (1 - 0.8^4)^24 = 3e-6.
BANDS, ROWS = 24, 4
#: Shingles whose MinHashes are taken at a time.
BLOCK = 1 << 14
#: Bits of the bitmap of marks, 4 MB.
BITS = 1 << 25
#: Ends of the names of the columns added to a mark.
ADDED = ("keys", "fp")

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None) -> np.ndarray:
    """Hashes of the text's shingles, in order. Fewer than WIDTH words are one shingle; no words have none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) < WIDTH:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(WIDTH)), strict=False))
    return np.array([xxh64_intdigest(s, SEED) for s in shingles], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(text))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One signed long for each band, its number mixed in."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), BLOCK):
        part = own[at : at + BLOCK, None]
        mixed = (part ^ (part >> np.uint64(31))) * _FACTORS[0] + _FACTORS[1]
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _with_set(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, their shingle set's hash as ``name``, the set's band keys as ``name``_keys and the SimHash of all shingles as ``name``_fp."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in pieces(batches, "text"):
            hashes = [shingle_hashes(x) for x in batch["text"].to_pylist()]
            prints = np.array([fingerprint_of(h) for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            marks = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(marks), keys, pa.array(prints)], names=[*columns, name, *(f"{name}_{x}" for x in ADDED)])

    added = [T.StructField(name, T.LongType()), T.StructField(f"{name}_keys", T.ArrayType(T.LongType())), T.StructField(f"{name}_fp", T.LongType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def bucket_links(marks: list[int], sets: list[np.ndarray], forest: _Forest) -> Iterator[tuple[int, int]]:
    """Links that join all similar sets of a bucket, without those between sets joined before.

    Sets whose shingles most others hold come first: the original of many copies joins them in one step.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    central = np.add.reduceat(count[place], starts) / sizes
    label = np.array([forest._top(m) for m in marks])
    held = np.zeros(len(values), bool)
    for row in np.argsort(-central, kind="stable").tolist():
        others = np.flatnonzero(label != label[row])
        others = others[SIMILAR[1] * np.minimum(sizes[others], sizes[row]) >= SIMILAR[0] * np.maximum(sizes[others], sizes[row])]
        if not len(others):
            continue
        own = place[starts[row] : starts[row] + sizes[row]]
        held[own] = True
        if 4 * len(others) > len(marks):
            shared = np.add.reduceat(held[place], starts, dtype=np.int64)[others]
        else:
            shared = np.array([np.count_nonzero(held[place[starts[k] : starts[k] + sizes[k]]]) for k in others.tolist()])
        held[own] = False
        # shared / (sum - shared) >= SIMILAR, in whole numbers
        for other in others[sum(SIMILAR) * shared >= SIMILAR[0] * (sizes[others] + sizes[row])].tolist():
            if label[other] != label[row]:
                forest.join(marks[row], marks[other])
                label[(label == label[other]) | (label == label[row])] = min(label[other], label[row])
                yield marks[row], marks[other]


def alike(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sets of distinct hashes reach SIMILAR, in whole numbers."""
    return sum(SIMILAR) * len(np.intersect1d(one, other, True)) >= SIMILAR[0] * (len(one) + len(other))


def _flagged(rows: DataFrame, name: str, marks: DataFrame, flag: str) -> DataFrame:
    """``rows`` and whether their mark may be among ``marks``: false is certain, so that such rows need no shuffle to be told apart.

    A bitmap of fixed size, broadcast; the more marks there are, the oftener others share their bits.
    """
    bucket, bits = free_names(rows.columns, "bucket", "bits")
    places = marks.select(F.expr(f"pmod(mark, {BITS})").alias("place"))
    maps = places.groupBy(F.expr("bitmap_bucket_number(place)").alias(bucket)).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias(bits))
    at = f"bitmap_bit_position(pmod(`{name}`, {BITS}))"
    byte = f"cast(conv(hex(substring({bits}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"coalesce(getbit({byte}, cast({at} % 8 as int)) = 1, false)")
    found = rows.join(F.broadcast(maps), F.expr(f"bitmap_bucket_number(pmod(`{name}`, {BITS}))") == F.col(bucket), "left")
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), bit.alias(flag))


def _texts(marked: DataFrame, name: str, marks: DataFrame) -> DataFrame:
    """``(mark, text)``, one text of each of the ``marks`` asked for and of few others, dealt by mark."""
    texts = _flagged(marked.select(F.col(name).alias("mark"), "text"), "mark", marks, "asked").where("asked")
    return texts.groupBy("mark").agg(F.min("text").alias("text"))


def _sets(marked: DataFrame, name: str, marks: DataFrame) -> DataFrame:
    """``(mark, set)`` of the ``marks`` asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = [shingle_set(x).tobytes() for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["mark"], pa.array(sets, pa.binary())], names=["mark", "set"])

    return _texts(marked, name, marks).join(marks.distinct(), "mark", "left_semi").select("mark", "text").mapInArrow(run, "mark long, set binary")


def _near_prints(marked: DataFrame, name: str) -> DataFrame:
    """``(a, b)`` links between marks of similar sets that SimHash finds: of one fingerprint, or of two that Golay keys link."""
    prints = durable(marked.where(F.size(f"{name}_keys") > 0).groupBy(F.col(f"{name}_fp").alias("fp"), F.col(name).alias("mark")).agg(F.count("*").alias("n")).drop("n"))
    first = durable(prints.groupBy("fp").agg(F.min("mark").alias("first")))
    equal = prints.join(first, "fp").where("mark != first").select(F.col("first").alias("a"), F.col("mark").alias("b"))
    apart = linked_fingerprints(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    met = durable(equal.unionByName(apart.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    sets = durable(_sets(marked, name, met.select(F.col("a").alias("mark")).unionByName(met.select(F.col("b").alias("mark")))))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "one"):
            near = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch["one"].to_pylist(), batch["other"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = met.join(sets.select(F.col("mark").alias("a"), F.col("set").alias("one")), "a").join(sets.select(F.col("mark").alias("b"), F.col("set").alias("other")), "b")
    return both.select("a", "b", "one", "other").mapInArrow(check, "a long, b long")


def _bands(marked: DataFrame, name: str) -> DataFrame:
    """``(mark, keys)``: each mark's band keys (BANDS at most) that bring it together with others; of keys that bring the same ones, one."""
    sets = marked.groupBy(F.col(name).alias("mark")).agg(F.min(f"{name}_keys").alias("keys"))
    own = Window.partitionBy("key")
    keyed = sets.select(F.explode("keys").alias("key"), "mark")
    met = durable(keyed.withColumns({"n": F.count("*").over(own), "least": F.min("mark").over(own), "all": F.expr("bit_xor(xxhash64(mark))").over(own)}).where("n > 1"))
    buckets = met.groupBy("n", "least", "all").agg(F.min("key").alias("key")).select("key")
    bands = durable(met.join(buckets, "key").groupBy("mark").agg(F.collect_list("key").alias("keys")))
    release(met)
    return bands


def _links(marked: DataFrame, name: str) -> DataFrame:
    """``(a, b)`` links between marks of different sets that join all similar ones sharing a band key."""
    bands = _bands(marked, name)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = pa.array([shingle_set(x).tobytes() for x in batch["text"].to_pylist()], pa.binary())
            keys = batch["keys"].to_pylist()
            for k in range(max(map(len, keys))):
                rows = [row for row, own in enumerate(keys) if len(own) > k]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([keys[row][k] for row in rows], pa.int64()), batch["mark"].take(at), sets.take(at)], names=["key", "mark", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, key, marks, sets = _Forest(), None, [], []

        def links() -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if (found := list(bucket_links(marks, sets, forest)) if marks else []) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for own_key, mark, data in zip(batch["key"].to_pylist(), batch["mark"].to_pylist(), batch["set"].to_pylist(), strict=True):
                if own_key != key:
                    yield links()
                    key, marks, sets = own_key, [], []
                marks.append(mark)
                sets.append(np.frombuffer(data, np.uint64))
        yield links()

    # A mark's set is made once and goes to each of its keys (BANDS at most); no table of sets is kept.
    rows = _texts(marked, name, bands).join(bands, "mark").select("mark", "keys", "text").mapInArrow(spread, "key long, mark long, set binary")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of texts linked by a shingle similarity of 0.8 or more, all columns kept.

    The row of the group's least doc_id stays (of repeated ones, the first as JSON; null ids
    lose to others, and a group without ids keeps one row). Texts without words
    are one group. An empty table gives an empty one.
    """
    mark = "_set"
    while {mark, *(f"{mark}_{x}" for x in ADDED)} & set(map(str.lower, docs.columns)):
        mark = f"_{mark}"
    chosen_mark, chosen_id, own_id, flag = free_names([*docs.columns, mark, *(f"{mark}_{x}" for x in ADDED)], "chosen", "chosen_id", "own_id", "flag")
    marked = durable(_with_set(docs, mark), compression="zstd")
    distinct = durable(marked.groupBy(F.col(mark).alias("mark")).agg(F.min(F.col("doc_id").cast("long")).alias("least"), F.count("*").alias("n")))
    joined = connected_components(_near_prints(marked, mark).unionByName(_links(marked, mark))).withColumnRenamed("node", "mark")
    labelled = distinct.join(joined, "mark", "left").select("mark", "least", "n", F.coalesce("component", "mark").alias("component"))
    # Structs order nulls first, so whether the id is missing comes before it.
    best = F.min(F.struct(F.col("least").isNull(), "least", "mark", "n")).alias("best")
    groups = durable(labelled.groupBy("component").agg(best, F.sum("n").alias("n")))
    chosen = groups.select(F.col("best.mark").alias(chosen_mark), F.col("best.least").alias(chosen_id), F.col("best.n").alias("n"))
    # Rows that are a group of their own stay where they are; the others are looked up.
    shared = labelled.join(groups.where("n > 1").select("component"), "component", "left_semi").select("mark")
    told = _flagged(marked, mark, shared, flag)
    same = (F.col(mark) == F.col(chosen_mark)) & F.col("doc_id").cast("long").eqNullSafe(F.col(chosen_id))
    alone = told.where(~F.col(flag))
    single = told.where(flag).join(chosen.where("n = 1"), same, "left_semi")
    several = told.where(flag).join(chosen.where("n > 1"), same, "left_semi").withColumn(own_id, F.col("doc_id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return alone.select(columns).unionByName(single.select(columns)).unionByName(one_row(several, docs.columns, [own_id, mark]))
