"""Vectors: near-duplicates by a random-projection tree forest, and exact top-k search by histograms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.components import connected_components
from ..operators.durable import durable

LEAST_COSINE = 0.9
TREES = 6
#: Vectors the trees' splits are fitted on at most; every vector is routed.
FIT_SAMPLE = 32_768
#: Vectors aimed at in a leaf, and compared at a time; a larger leaf is compared block by block.
LEAF = 1024
#: Half width of the band around a split whose vectors go both ways, in 1/sqrt(dimension).
SPILL = 0.2
#: Least part of a node that a split must take away; a node that cannot be split so is a leaf.
LEAST_GAIN, TRIES = 0.1, 4
SEED = 20


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def _finite(embedding: str) -> F.Column:
    """Whether a vector is neither null nor empty and all its components are finite numbers."""
    return F.coalesce(
        (F.size(embedding) > 0)
        & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))),
        F.lit(False),
    )


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Forest:
    """Recursive random splits of one dimension's vectors, in flat arrays."""

    def __init__(self, sample: np.ndarray, rows: int, leaf: int = LEAF, trees: int = TREES, seed: int = SEED) -> None:
        self._dice = np.random.default_rng(seed)
        self._directions: list[np.ndarray] = []
        self._nodes: list[tuple[float, int, int]] = []  # threshold, left, right; leaves have left = -1
        width = sample.shape[1] if len(sample) else 1
        self._band = SPILL / math.sqrt(width)
        least = max(16, leaf * len(sample) // max(1, rows))
        self.roots = [self._grow(sample, least) for _ in range(trees)]

    def _add(self, direction: np.ndarray, threshold: float) -> int:
        self._directions.append(direction)
        self._nodes.append((threshold, -1, -1))
        return len(self._nodes) - 1

    def _grow(self, sample: np.ndarray, least: int) -> int:
        width = sample.shape[1]
        for _ in range(TRIES if len(sample) > least else 0):
            direction = self._dice.standard_normal(width)
            direction /= np.linalg.norm(direction)
            along = sample @ direction
            threshold = float(np.median(along))
            left, right = along <= threshold + self._band, along > threshold - self._band
            if max(left.sum(), right.sum()) <= (1 - LEAST_GAIN) * len(sample):
                node = self._add(direction, threshold)
                self._nodes[node] = (threshold, self._grow(sample[left], least), self._grow(sample[right], least))
                return node
        return self._add(np.zeros(width), 0.0)

    def freeze(self) -> Forest:
        """Without the generator, for sending."""
        self._dice = None
        self._directions = np.array(self._directions, np.float32)
        return self

    def route(self, x: np.ndarray) -> list[list[int]]:
        """The leaves, over all trees, that each row falls into."""
        leaves: list[list[int]] = [[] for _ in range(len(x))]
        stack = [(root, np.arange(len(x))) for root in self.roots]
        while stack:
            node, rows = stack.pop()
            threshold, left, right = self._nodes[node]
            if not len(rows):
                continue
            if left < 0:
                for r in rows.tolist():
                    leaves[r].append(node)
                continue
            along = x[rows] @ self._directions[node]
            stack.append((left, rows[along <= threshold + self._band]))
            stack.append((right, rows[along > threshold - self._band]))
        return leaves


def _leaf_links(x: np.ndarray, y: np.ndarray | None, rows: np.ndarray, weights: np.ndarray, leaves: list[np.ndarray], leaf: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, links counted here, least row joined here) of the rows that have a link in a leaf or a pair of its blocks.

    ``x`` holds the leaf's vectors, or ``y`` the second block's; ``rows``,
    ``weights`` and ``leaves`` are theirs in that order. A link counts as often
    as its other end has copies. A pair is counted in the first leaf
    (by number) that its vectors share, so once over all trees.
    """
    n = len(x)
    near = np.zeros((len(rows), len(rows)), bool) if y is None else None
    if y is None:
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        some = np.flatnonzero(near.any(axis=1))
        near = near[np.ix_(some, some)]
    else:
        across = x @ y.T >= least
        a, b = np.flatnonzero(across.any(axis=1)), np.flatnonzero(across.any(axis=0))
        some = np.concatenate([a, n + b])
        near = np.zeros((len(some), len(some)), bool)
        near[: len(a), len(a) :] = across[np.ix_(a, b)]
        near |= near.T
    if not len(some):
        return rows[:0], np.zeros(0, np.int64), rows[:0]
    earlier = [own[own < leaf] for own in (leaves[k] for k in some.tolist())]
    places, spot = np.unique(np.concatenate(earlier), return_inverse=True)
    member = np.zeros((len(some), max(1, len(places))), np.float32)
    member[np.repeat(np.arange(len(some)), [len(e) for e in earlier]), spot] = 1
    counted = (near & (member @ member.T == 0)) @ weights[some]
    own = rows[some]
    label = own.copy()
    while True:
        new = np.array([min(label[k], label[near[k]].min()) for k in range(len(some))])
        if (new == label).all():
            return own, counted, label
        label = new


def near_duplicate_vectors(vectors: DataFrame, least: float = LEAST_COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = FIT_SAMPLE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors`` (vec_id, embedding).

    Pairs that share a leaf of the forest are compared in double precision.
    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and vectors of unlike lengths not with each other.
    Repeated rows are vectors of their own and link; extra columns (labels) are
    not looked at; an empty table gives an empty one; a null vec_id stays null.
    Of equal vectors one goes through the forest, with their number as its
    weight, so a group of copies costs what one vector does.
    """
    rows = durable(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "embedding"))
    usable = rows.where(_finite("embedding")).where(F.exists("embedding", lambda x: x != 0))
    distinct = durable(usable.groupBy("embedding").agg(F.min("row").alias("row"), F.count("*").alias("weight")))
    found = None
    for width, count in [tuple(r) for r in distinct.groupBy(F.size("embedding")).count().collect()]:
        own = _links(distinct.where(F.size("embedding") == width), count, least, trees, leaf, sample)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = durable(found)
    counts = found.groupBy("row").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("row").alias("a"), F.col("joined").alias("b")))
    # What holds for one of equal vectors holds for each; they link with each other.
    facts = distinct.join(components.withColumnRenamed("node", "row"), "row", "left").join(counts, "row", "left").select(
        "embedding", F.coalesce("component", "row").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")
    )
    named = durable(rows.select("row", "vec_id").join(usable.join(facts, "embedding").select("row", "component", "links"), "row", "left").withColumn("component", F.coalesce("component", "row")))
    least_id = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return named.join(least_id, "component").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _links(usable: DataFrame, count: int, least: float, trees: int, leaf: int, sample: int) -> DataFrame:
    """``(row, links, joined)`` partial counts and joins from each leaf."""
    spark = usable.sparkSession
    fitted = usable.select("embedding").orderBy(F.xxhash64("row")).limit(sample).toArrow()["embedding"].combine_chunks()
    forest = spark.sparkContext.broadcast(Forest(_unit(_matrix(fitted)), count, leaf, trees).freeze())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch["x"])) if batch.num_rows else np.zeros((0, 1))
            leaves = pa.array(forest.value.route(x.astype(np.float32)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["weight"], batch["x"], leaves], names=["row", "weight", "x", "leaves"])

    kind = usable.schema["embedding"].dataType.simpleString()
    routed = durable(usable.select("row", "weight", F.col("embedding").alias("x")).mapInArrow(route, f"row long, weight long, x {kind}, leaves array<int>"))
    # Leaves are bounded by trees * sample / 16.
    sizes = routed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
    blocks = sizes.where("count > 1").select("leaf", F.ceil(F.col("count") / (2 * leaf)).cast("int").alias("blocks"))
    dealt = (
        routed.withColumn("leaf", F.explode("leaves")).join(F.broadcast(blocks), "leaf")
        .withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leaf", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "row", "weight", "x", "leaves")
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, own = _unit(_matrix(table["x"].combine_chunks())), table["own"].to_numpy()
        low, high, at = table["low"][0].as_py(), table["high"][0].as_py(), table["leaf"][0].as_py()
        rows, weights = table["row"].to_numpy(), table["weight"].to_numpy()
        leaves = [np.asarray(v) for v in table["leaves"].to_pylist()]
        if low == high:
            found = _leaf_links(x, None, rows, weights, leaves, at, least)
        else:
            order = np.argsort(own != low, kind="stable")
            n = int((own == low).sum())
            x, rows, weights, leaves = x[order], rows[order], weights[order], [leaves[k] for k in order.tolist()]
            found = _leaf_links(x[:n], x[n:], rows, weights, leaves, at, least)
        return pa.table(dict(zip(("row", "links", "joined"), map(pa.array, found), strict=True)))

    return dealt.groupBy("leaf", "low", "high").applyInArrow(compare, "row long, links long, joined long")


TOP_K, SCALE, BIN_BITS = 20, 64, 10
BINS = 1 << BIN_BITS
#: Integer types blocks are packed in, by the largest component; wider ones stay doubles.
NARROW = (("<i1", 127), ("<i2", 32767), ("<i4", 2147483647))
#: Scores up to here are exact: differences of two fit 64 bits.
#: Scores beyond are this, with their sign.
MOST_SCORE = (1 << 63) - 1
CANDIDATE_BLOCK = 4096
#: Bytes of queries that go to all candidates at a time, as doubles.
WAVE_BYTES = 32 << 20


def _blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length: ids and floor(scale * x) as packed doubles, by vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array([len(v) for v in batch["embedding"]], np.int64)
            for width in np.unique(widths).tolist():
                own = batch.filter(pa.array(widths == width)).sort_by("vec_id")
                for at in range(0, own.num_rows, size):
                    part = own.slice(at, size)
                    x = np.nan_to_num(np.floor(scale * _matrix(part["embedding"])), posinf=1e300, neginf=-1e300)
                    kind = next((t for t, most in NARROW if np.abs(x).max() <= most), "<f8")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([width], pa.int32()), pa.array([kind]), pa.array([part.num_rows], pa.int32()),
                            pa.array([float((x * x).sum(axis=1).max())]),
                            pa.array([part["row"].to_numpy().tobytes()]), pa.array([part["vec_id"].to_numpy().tobytes()]),
                            pa.array([x.astype(kind).tobytes()]),
                        ],
                        names=["width", "kind", "n", "norm", "rows", "ids", "x"],
                    )

    packed = rows.mapInArrow(run, "width int, kind string, n int, norm double, rows binary, ids binary, x binary")
    return durable(packed.withColumn("block", F.monotonically_increasing_id()))


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Integer inner products, in the narrowest arithmetic that is exact for them; those that a long can't hold are MOST_SCORE, signed."""
    if bound < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    a, b = a.astype(np.float64), b.astype(np.float64)
    near, size = a @ b.T, np.abs(a) @ np.abs(b).T
    # Longs wrap, but a sum that a long holds comes out right. What comes near the end, or has components past it, is summed in whole numbers.
    fits = (np.abs(a).max(axis=1, initial=0) < 2.0**62)[:, None] & (np.abs(b).max(axis=1, initial=0) < 2.0**62)
    error = size * (1e-15 * (len(a.T) + 2))
    exact = np.clip(a, -(2.0**62), 2.0**62).astype(np.int64) @ np.clip(b, -(2.0**62), 2.0**62).astype(np.int64).T
    past = np.abs(near) - error >= 2.0**63
    exact[past] = np.where(near[past] > 0, MOST_SCORE, -MOST_SCORE)
    for i, j in np.argwhere(~past & ~(fits & (np.abs(near) + error < 2.0**63))).tolist():
        whole = sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True) if x and y)
        exact[i, j] = max(-MOST_SCORE, min(MOST_SCORE, whole))
    return exact


def exact_top_k(vectors: DataFrame, k: int = TOP_K, every: int = 20, scale: int = SCALE, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest integer inner products.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all
    rows but the query's own; ties go to the smaller vec_id. Blocks of
    candidates stay where they are; queries come to them in waves of about
    ``wave_bytes``. Each round sums the scores' histograms over all blocks and
    narrows every query's range to the bin that holds its kth score, until the
    bin is one score wide; a last pass takes what lies above and, of the ties,
    the first ids. Vectors that are null or hold null or non-finite components,
    and null ids, take no part; empty vectors neither, and vectors of unlike
    lengths don't meet. Repeated rows count each. Scores are exact as far as a
    long reaches; beyond they are MOST_SCORE or its negative.
    """
    usable = durable(
        vectors.where(_finite("embedding") & F.col("vec_id").isNotNull())
        .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    )
    candidates = _blocks(usable, CANDIDATE_BLOCK, scale)
    asked = usable.where(F.col("vec_id") % every == 0)
    widths = {r["width"]: r["norm"] for r in candidates.groupBy("width").agg(F.max("norm").alias("norm")).collect()}
    found = None
    for width, count in [tuple(r) for r in asked.groupBy(F.size("embedding")).count().orderBy(F.size("embedding")).collect()]:
        own = asked.where(F.size("embedding") == width)
        waves = math.ceil(count * (8 * width + 64) / wave_bytes)
        for wave in range(waves):
            part = own.where(F.pmod(F.xxhash64("row"), F.lit(waves)) == wave).toArrow().sort_by("row")
            if part.num_rows:
                best = _wave(candidates.where(F.col("width") == width), part, k, scale, widths[width])
                found = best if found is None else found.unionByName(best)
    return usable.sparkSession.createDataFrame([], RESULT) if found is None else found


RESULT = "query_id long, rank int, vec_id long, score long"


def _wave(candidates: DataFrame, queries: pa.Table, k: int, scale: int, norm: float) -> DataFrame:
    """RESULT rows of the queries (row, vec_id, embedding), a bounded number of equal length."""
    context = candidates.sparkSession.sparkContext
    x = np.floor(scale * _matrix(queries["embedding"].combine_chunks()))
    kind = next((t for t, most in NARROW if np.abs(x).max() <= most), "<f8")
    fixed = context.broadcast((x.astype(kind), queries["row"].to_numpy(), queries["vec_id"].to_numpy()))
    most = min(int(min(norm, 1e300)), MOST_SCORE)
    rounds = max(1, -(-(2 * most + 3).bit_length() // BIN_BITS))
    low, need = np.full(len(x), -most - 1), np.full(len(x), k)
    for step in range(rounds):
        shift = BIN_BITS * (rounds - 1 - step)
        state = context.broadcast((low, need))
        counts = candidates.mapInArrow(_histogram(fixed, state, shift), "pos int, bin int, n long").groupBy("pos", "bin").agg(F.sum("n").alias("n"))
        through = F.sum("n").over(Window.partitionBy("pos").orderBy(F.desc("bin")))
        asked = F.element_at(F.lit(need.tolist()), F.col("pos") + 1)
        # The bin that holds the kth score, and how many of it are needed; with fewer scores than k the lowest bin, all of it.
        hit = F.max(F.when(F.col("through") >= asked, F.struct("bin", (asked - F.col("through") + F.col("n")).alias("need"))))
        chosen = counts.withColumn("through", through).groupBy("pos").agg(F.coalesce(hit, F.min(F.struct("bin", F.col("n").alias("need")))).alias("c")).select("pos", "c.bin", "c.need").toArrow()
        at = chosen["pos"].to_numpy()
        low, need = low.copy(), need.copy()
        low[at] = (low[at].view(np.uint64) + (chosen["bin"].to_numpy().astype(np.uint64) << np.uint64(shift))).view(np.int64)
        need[at] = chosen["need"].to_numpy()
        state.unpersist()
    state = context.broadcast((low, need))
    found = candidates.mapInArrow(_at_least(fixed, state), "query_row long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return durable(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


#: Queries scored at a time against a block of candidates.
QUERIES_AT_ONCE = 512


def _scored(batches: Iterator[pa.RecordBatch], fixed, state) -> Iterator[tuple]:
    x, rows, ids = fixed.value
    low, need = state.value
    norms = {at: float(np.square(x[at : at + QUERIES_AT_ONCE].astype(np.float64)).sum(axis=1).max()) for at in range(0, len(x), QUERIES_AT_ONCE)}
    for batch in batches:
        for row in batch.to_pylist():
            own = np.frombuffer(row["x"], row["kind"]).reshape(-1, row["width"])
            own_rows, own_ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
            for at in range(0, len(x), QUERIES_AT_ONCE):
                part = slice(at, at + QUERIES_AT_ONCE)
                there = rows[part, None] != own_rows[None, :]
                yield at, _products(x[part], own, math.sqrt(min(norms[at], 1e300)) * math.sqrt(min(row["norm"], 1e300))), there, low[part, None], need[part], rows[part], ids[part], own_rows, own_ids


def _histogram(fixed, state, shift: int):
    """Per query the counts of scores in bins of 2**``shift`` from its low, from the top as far as its need could reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, scores, there, low, need, *_ in _scored(batches, fixed, state):
            # As unsigned numbers differences never wrap where the score is not below.
            there &= scores >= low
            bins = (scores.view(np.uint64) - low.view(np.uint64)) >> np.uint64(shift)
            there &= bins < BINS
            bins = bins.astype(np.int64)
            query, place = np.nonzero(there)
            counts = np.bincount(query * BINS + bins[query, place], minlength=len(need) * BINS).reshape(-1, BINS)[:, ::-1]
            above = np.cumsum(counts, axis=1) - counts
            query, place = np.nonzero((counts > 0) & (above < need[:, None]))
            columns = [pa.array((at + query).astype(np.int32)), pa.array((BINS - 1 - place).astype(np.int32)), pa.array(counts[query, place])]
            yield pa.RecordBatch.from_arrays(columns, names=["pos", "bin", "n"])

    return run


def _at_least(fixed, state):
    """All scores above each query's kth one, and as many first ids of those equal to it as it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, scores, there, low, need, q_rows, q_ids, c_rows, c_ids in _scored(batches, fixed, state):
            ties = there & (scores == low)
            ties &= np.cumsum(ties, axis=1) <= need[:, None]
            query, place = np.nonzero(there & (scores > low) | ties)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (q_rows[query], q_ids[query], c_ids[place], c_rows[place], scores[query, place])],
                names=["query_row", "query_id", "vec_id", "row", "score"],
            )

    return run
