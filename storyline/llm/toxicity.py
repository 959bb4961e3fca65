"""Toxicity scores from a learned lexicon, met through Levenshtein automata and read in context."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import durable
from .text import id_remainder, pieces

#: Labelled rows of either label that the lexicon and the weights are fitted on at most.
SAMPLE_PER_LABEL = 10_000
#: What a word or word start needs to be an entry of the lexicon.
LEAST_SHARE, LEAST_DOCUMENTS, LEAST_PRECISION = 0.01, 4, 0.97
#: Different words that must precede an entry in toxic documents (counted in CONTEXTS classes): copies of one text show few.
LEAST_CONTEXTS, CONTEXTS = 12, 60
STEM_LENGTHS, STEM_LEAST_WORDS, STEM_MOST_ONE_WORD, STEM_SAME = (4, 5, 6), 4, 0.5, 0.9
#: Term lengths from which one and two edits are allowed.
ONE_EDIT, TWO_EDITS = 5, 9
#: Length from which a word start allows one edit too.
STEM_EDIT = 6
#: Words looked at on either side of a term.
WINDOW = 6
MEMO_ENTRIES = 400_000
THRESHOLD = 0.3
#: Documents without any evidence that a context word's weight is drawn to 0 by, and the window's score from which it says quotation.
CONTEXT_PRIOR, QUOTING = 20.0, -1.0
#: Characters stripped from words, signs of quoting.
EDGES = ".,;:!?*#$%&@|()[]{}<>-_/\\~^+=\"'`«»„“”‚‘’…"
QUOTES = frozenset("\"«»„“”‘’")


class Trie:
    """The lexicon; ``*`` at the end of an entry takes any ending."""

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        self.stems = tuple(t[:-1] for t in terms if t.endswith("*"))
        self.words = frozenset(t for t in terms if not t.endswith("*"))
        # A word within k edits of an entry holds one of the entry's k+1 parts unchanged, moved by k places at most.
        self.parts: set[tuple[int, str]] = set()
        for term in (t for t in terms if edits(t)):
            node = self.root
            for c in term.removesuffix("*"):
                node = node.setdefault(c, {})
            node["*" if term.endswith("*") else ""] = term
            for at, part in _split(term.removesuffix("*"), edits(term) + 1):
                self.parts |= {(at + move, part) for move in range(-edits(term), edits(term) + 1) if at + move >= 0}
        self.looks = sorted({(at, at + len(part)) for at, part in self.parts})

    def within(self, word: str) -> bool:
        """Whether an entry is within its number of edits of ``word`` (a word start: of a start of ``word``): the trie
        walked with the word's Levenshtein automaton, whose state is the row of edit distances to the word's prefixes.
        """
        parts = self.parts
        if not any((a, word[a:b]) in parts for a, b in self.looks):
            return False
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, state = stack.pop()
            for c, below in node.items():
                if len(c) != 1 or c == "*" and isinstance(below, str):
                    if 0 < (state[-1] if not c else min(state)) <= edits(below):
                        return True
                    continue
                row = [state[0] + 1]
                for k, x in enumerate(word, 1):
                    row.append(min(row[-1] + 1, state[k] + 1, state[k - 1] + (x != c)))
                if min(row) <= 2:
                    stack.append((below, row))
        return False


def edits(term: str) -> int:
    """Edits that still make a word a misspelling of ``term``, or let it begin with one of a word start."""
    if term.endswith("*"):
        return int(len(term) > STEM_EDIT)
    return 0 if len(term) < ONE_EDIT else 1 if len(term) < TWO_EDITS else 2


def _split(term: str, n: int) -> list[tuple[int, str]]:
    cuts = [len(term) * k // n for k in range(n + 1)]
    return [(a, term[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Reader(dict):
    """Kind of each raw word, found when first met: 0 plain, 1 term or stem, 2 misspelling."""

    def __init__(self, terms: list[str], ordinary: frozenset[str], context: dict[str, float]) -> None:
        super().__init__()
        self.trie, self.ordinary, self.context = Trie(terms), ordinary, context

    def __missing__(self, raw: str) -> int:
        word = raw.strip(EDGES)
        if word in self.trie.words or word.startswith(self.trie.stems):
            kind = 1
        else:
            kind = 2 if len(word) >= ONE_EDIT - 1 and word not in self.ordinary and self.trie.within(word) else 0
        self[raw] = kind
        return kind

    def met(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """Words, their kinds, and where terms are."""
        words = text.lower().split()
        if len(self) > MEMO_ENTRIES:
            self.clear()
        kinds = [self[w] for w in words]
        return words, kinds, [k for k, kind in enumerate(kinds) if kind]

    def features(self, text: str) -> list[float]:
        """Logarithms of: direct terms, quoted terms, misspelt terms, abusive windows' scores; then the terms' share."""
        words, kinds, terms = self.met(text)
        direct = quoted = misspelt = 0
        abusive = 0.0
        for at in terms:
            leaning = self.leaning(words, at)
            if in_quotes(words, at) or leaning <= QUOTING:
                quoted += 1
            elif kinds[at] == 2:
                misspelt += 1
            else:
                direct += 1
            abusive += max(0.0, leaning)
        share = (direct + misspelt) / max(1, len(words))
        return [*np.log1p([direct, quoted, misspelt, abusive]).tolist(), min(1.0, 10 * share)]

    def leaning(self, words: list[str], at: int) -> float:
        """Score of the window around a term: the sum of its words' weights; below 0 it reports rather than abuses."""
        return sum(self.context.get(w, 0.0) for w in near(words, at)) if self.context else 0.0


def near(words: list[str], at: int) -> set[str]:
    """The words of the window around ``at``, without their edges."""
    return {w.strip(EDGES) for w in (*words[max(0, at - WINDOW) : at], *words[at + 1 : at + 1 + WINDOW])} - {""}


def in_quotes(words: list[str], at: int) -> bool:
    """Whether, within the window, a quotation is opened before the word at ``at`` or by it, and closed by it or after it."""
    for k in range(at, max(-1, at - WINDOW - 1), -1):
        if k < at and not QUOTES.isdisjoint(words[k][1:]):
            return False
        if words[k][0] in QUOTES:
            break
    else:
        return False
    for k in range(at, min(len(words), at + WINDOW + 1)):
        if not QUOTES.isdisjoint(words[k][1:]):
            return True
        if k > at and words[k][0] in QUOTES:
            return False
    return False


#: Weights before any label is seen, which the fit is drawn to: bias, then one for each feature.
PRIOR = np.array([-4.0, 5.0, 1.0, 3.0, 0.5, 2.0])
RIDGE = 0.5


_readers: dict[int, tuple] = {}


def _reader(model: ToxicityModel) -> Reader:
    """The model's reader, kept in each worker with the words it has met."""
    if (held := _readers.get(0)) is None or held[0] is not model:
        _readers[0] = held = (model, Reader(list(model.terms), model.ordinary, model.context))
    return held[1]


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[str, ...]
    ordinary: frozenset[str]
    context: dict[str, float]
    weights: np.ndarray

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -30, 30)))


def fit_weights(features: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge around PRIOR, by Newton steps."""
    x = np.column_stack([np.ones(len(features)), features])
    w = PRIOR.copy()
    for _ in range(30 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + RIDGE * np.eye(len(w)), x.T @ (label - p) - RIDGE * (w - PRIOR))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample_labels(labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """At most ``per_label`` ids of each label, the least by hash; ids with two labels count by the larger."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for t in (0, 1)]
    return one[0].unionByName(one[1])


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Lexicon, ordinary look-alikes, context words and weights from ``labels`` (doc_id, toxic).

    The sample of labelled rows is bounded by ``per_label``: of rows that share
    an id the least text is learned from. With no labelled document the model
    has no terms and PRIOR weights.
    """
    chosen = durable(sample_labels(labels.select("doc_id", "toxic"), per_label))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    texts = durable(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            word, label, before = [], [], []
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                words = [w.strip(EDGES) for w in text.lower().split()]
                own = dict(zip(words, ["", *words], strict=False))
                word += own
                label += [toxic] * len(own)
                before += [1 << zlib.crc32(w.encode("utf-8", "replace")) % CONTEXTS if toxic else 0 for w in own.values()]
            columns = [pa.array(word, pa.string()), pa.array(label, pa.int64()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "context"])

    seen = durable(
        texts.mapInArrow(words_of, "word string, toxic long, context long").where("length(word) > 2")
        .groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), F.bit_or("context").alias("context"))
    )
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    terms = _lexicon(seen, bad, good) if bad else []
    ordinary = _ordinary(seen, terms) if terms else frozenset()
    context = _context(texts, terms, ordinary) if terms else {}
    reader = docs.sparkSession.sparkContext.broadcast((terms, ordinary, context))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(*reader.value)
        for batch in pieces(batches, "text"):
            rows = [read.features(x) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = texts.select("toxic", "text").mapInArrow(describe, "toxic int, x array<double>").collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, len(PRIOR) - 1)
    return ToxicityModel(tuple(terms), ordinary, context, fit_weights(x, np.array([r["toxic"] for r in rows], float)))


def _context(texts: DataFrame, terms: list[str], ordinary: frozenset[str]) -> dict[str, float]:
    """Weights of the words around terms: above 0 where windows of toxic documents hold them more than the terms tell.

    How often toxic windows hold a word is held against what is expected from
    the terms it stands by, so that a term's language or topic weighs nothing,
    and CONTEXT_PRIOR keeps words with little evidence near 0. Bounded by the
    sample's words.
    """
    shared = texts.sparkSession.sparkContext.broadcast((terms, ordinary))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(*shared.value, {})
        for batch in pieces(batches, "text"):
            rows: list[tuple[str, str, int]] = []
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                words, kinds, at = read.met(text)
                # What only looks like a term may be an ordinary word of another language: no evidence of how terms are used.
                rows += {(words[k].strip(EDGES), w, toxic) for k in at if kinds[k] == 1 for w in ("", *near(words, k))}
            term, word, label = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(word, pa.string()), pa.array(label, pa.int64())], names=["term", "word", "toxic"])

    seen = texts.select("text", "toxic").mapInArrow(windows, "term string, word string, toxic long")
    pairs = durable(seen.groupBy("term", "word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")))
    # The empty word stands for all documents that hold the term.
    rates = pairs.where("word = ''").select("term", ((F.col("bad") + 1) / (F.col("n") + 1)).alias("rate"))
    counts = pairs.where("word <> ''").join(rates, "term").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rate")).alias("expected"))
    out = {}
    for word, bad, n, expected in counts.where("n > 1").collect():
        toxic, clean = (math.log((k + CONTEXT_PRIOR) / (of + CONTEXT_PRIOR)) for k, of in ((bad, expected), (n - bad, max(0.0, n - expected))))
        out[word] = max(-3.0, min(3.0, toxic - clean))
    return out


def _lexicon(seen: DataFrame, bad: int, good: int) -> list[str]:
    """Words, and starts shared by many words, that toxic documents hold and others hardly do; bounded by the sample's words.

    A word that a chosen start covers stays, for its misspellings.
    """
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * bad)
    precise = F.col("bad") / bad / (F.col("bad") / bad + (F.col("good") + 0.1) / max(1, good)) >= LEAST_PRECISION
    varied = F.bit_count("context") >= min(LEAST_CONTEXTS, least)
    kept = seen.where(precise & varied & (F.col("bad") >= least)).orderBy(F.desc("bad"), "word").collect()
    starts = seen.select(F.explode(F.array(*(F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STEM_LENGTHS))).alias("start"), "bad", "good", "context").where("start is not null")
    stems = (
        starts.groupBy("start")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.bit_or("context").alias("context"), F.max("bad").alias("most"), F.count_if(F.col("bad") > 0).alias("words"))
        .where(precise & varied & (F.col("bad") >= 2 * least) & (F.col("words") >= STEM_LEAST_WORDS) & (F.col("most") <= STEM_MOST_ONE_WORD * F.col("bad")))
        .collect()
    )
    weight = {r["start"]: r["bad"] for r in stems}
    # A longer start that keeps nearly all of a shorter one's documents says more; else the shorter stands for it.
    same = {s[:-1] for s in weight if weight[s] >= STEM_SAME * weight.get(s[:-1], math.inf)}
    chosen: list[str] = []
    for start in sorted(weight.keys() - same, key=lambda s: (len(s), s)):
        if not start.startswith(tuple(chosen)):
            chosen.append(start)
    return [*(c + "*" for c in chosen), *(r["word"] for r in kept)]


def _ordinary(seen: DataFrame, terms: list[str]) -> frozenset[str]:
    """Words of untoxic documents that look like misspelt terms; they aren't. Bounded by the lexicon's neighbourhood."""
    shared = seen.sparkSession.sparkContext.broadcast(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            words = [w for w in batch["word"].to_pylist() if trie.within(w)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    return frozenset(r["word"] for r in seen.where("good > 0").select("word").repartition("word").mapInArrow(near, "word string").collect())


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, score)`` of every whole text; a null or empty one has the bias alone.

    Null ids, repeated rows and extra columns are passed by; an empty table
    gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(shared.value)
        for batch in pieces(batches, "text"):
            x = np.array([read.features(t) for t in batch["text"].to_pylist()]).reshape(-1, len(PRIOR) - 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(shared.value.probability(x))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(shared.value)
        for batch in pieces(batches, "text"):
            x = np.array([read.features(t or "") for t in batch["text"].to_pylist()]).reshape(-1, len(PRIOR) - 1)
            yield batch.filter(pa.array(shared.value.probability(x) < threshold))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: those whose crc32(doc_id) mod 4 isn't 2."""
    return labels.where(id_remainder("doc_id", 4) != 2)
